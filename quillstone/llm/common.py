"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if a session on one machine names no checkpoint folder (tests).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


#: The tables written within the innermost ``scratch``.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables written inside once the block is done, so what reads them must have run by then.

    A query's own tables are read when its result is, so nothing deletes them but the owner of the folder.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for path in written:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage: lost executors cost only the tasks they ran, since the files
    outlive them. Void columns are not expected here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, beside which an operator's own columns can clash with none."""
    return docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))


def unboxed(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that ``boxed`` packed, some of them changed."""
    return df.select(*[(changed[name] if name in changed else F.col("row")[name]).alias(name) for name in columns])


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column):
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A word is a run of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = re.compile("[^\x20\x09-\x0d]+")
