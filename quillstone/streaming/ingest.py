"""Incremental ingest of filings as a stream of files, with state by filing. The batch engine has no stream; this is an addition."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows cross the stateful step as JSON with all digits, since pandas has no integers that may be null.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "dateFormat": "yyyy-MM-dd"}


class Filings(StatefulProcessor):
    """What is known of each filing: the hash of its source, its rows so far, how often each column was missing, and of each row its name and a hash of its content.

    A row that was not seen before goes on; one that was, with the same content, does not. Another source hash for a filing, or
    another content for one of its rows, is an error, and the batch leaves no trace. A filing's rows may come in any number of batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._source = handle.getValueState("source", "source_hash string, row_count long, missing_fields string")
        self._rows = handle.getListState("rows", "name string, content long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._source.get() if self._source.exists() else None
        known = dict(self._rows.get()) if held else {}
        source, new = held[0] if held else None, []
        missing = Counter(json.loads(held[2]) if held else {})
        for frame in rows:
            hashes = set(frame["source_hash"])
            source = source if held or new else next(iter(hashes))
            if hashes != {source}:
                raise ValueError(f"source changed: {key[0]}")
            fresh = []
            for at, (name, content, absent) in enumerate(zip(frame["name"], frame["content"].tolist(), frame["absent"])):
                if name not in known:
                    known[name] = content
                    new.append((name, content))
                    fresh.append(at)
                    missing.update(absent.split("\n") if absent else ())
                elif known[name] != content:
                    raise ValueError(f"row changed: {key[0]} {name}")
            if fresh:
                yield frame.iloc[fresh][["payload"]]
        if new:
            self._rows.appendList(new) if held else self._rows.put(new)
            self._source.update((source, (held[1] if held else 0) + len(new), json.dumps(missing, sort_keys=True)))

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, source_hash: str | None, row_keys: tuple[str, ...]) -> DataFrame:
    """The rows of ``rows`` (a stream) that their filing did not hold yet."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in row_keys]) if row_keys else F.sha2(F.to_json(whole, _JSON), 256)
    absent = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in rows.columns])), "\n")
    packed = rows.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("filing"), F.coalesce(F.col(source_hash) if source_hash else F.lit(""), F.lit("")).alias("source_hash"),
        name.alias("name"), F.xxhash64(F.to_json(whole, _JSON)).alias("content"), F.to_json(whole, _JSON).alias("payload"), absent.alias("absent"),
    )
    new = packed.groupBy("filing").transformWithStateInPandas(statefulProcessor=Filings(), outputStructType="payload string", outputMode="Append", timeMode="None")
    return new.select(F.from_json("payload", rows.schema, _JSON).alias("r")).select("r.*")


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str = "accession", source_hash: str | None = None, row_keys: tuple[str, ...] = ()) -> StreamingQuery:
    """Append to ``target`` (Parquet) what the files at ``source`` add to their filings, and end once all are read.

    ``key`` names the filing of a row, ``source_hash`` the column with the hash of its source, ``row_keys`` what names a row within its filing
    (else equal rows count once). State stands in the checkpoint, so neither ``target`` nor its keys are read: a batch looks up
    its own filings only. ``ingested_sources`` reads the state as a table. Files, batches and restarts change nothing in the result.
    """
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the stream takes the setting along when it starts
    try:
        stream = _stateful(spark.readStream.schema(schema).parquet(source), key, source_hash, row_keys)
        return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def ingested_sources(spark: SparkSession, checkpoint: str) -> DataFrame:
    """filing, source_hash, row_count, missing_fields (a map of columns to their nulls): the record of what was ingested, read from the stream's state as of its last batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "source").load()
    return state.select(F.col("key.filing").alias("filing"), "value.source_hash", "value.row_count", F.from_json("value.missing_fields", "map<string,bigint>").alias("missing_fields"))


def known_at(panel: DataFrame, origin) -> DataFrame:
    """What was accepted by the origin about periods before it: a filter on two times, not a watermark."""
    at = F.lit(origin).cast("timestamp")
    return panel.where((F.col("acceptance_time") <= at) & (F.col("period_end").cast("timestamp") < at))


def event_counts(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling counts and cents by event type with a watermark; works on streams and batches."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
