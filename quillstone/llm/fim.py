"""Fill-in-middle: whole texts cut at unit borders into prefix, middle and suffix, and set in another order between marks."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

_SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint32)
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Settings:
    """unit: what a text is cut between, "line", "word" (with the white space after it) or "char"; rate: texts of a hundred
    that are transformed; spm: of these, how many of a hundred have the suffix first; seed: of the hash that decides;
    prefix, suffix, middle: the marks. No end of a mark may be the start of one, or a text could not be told from its marks.
    """

    unit: str = "line"
    rate: int = 100
    spm: int = 50
    seed: int = 7
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if self.unit not in ("line", "word", "char"):
            raise ValueError(f"unknown unit {self.unit!r}")
        if not all(self.marks) or len({*self.marks}) < 3:
            raise ValueError("the marks must be three different strings")
        for one, two in product(self.marks, repeat=2):
            if one != two and two in one or any(one.endswith(two[:n]) for n in range(1, len(two))):
                raise ValueError(f"{one!r} and {two!r} overlap")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_ends(points: np.ndarray, unit: str) -> np.ndarray:
    """Where the units of a text end, as places in its code points; the last is its length.

    Each point has a class; neighbours whose classes say that one unit stops and another starts have a border between them.
    """
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    if unit == "line":
        stops = points[:-1] == 0x0A
    elif unit == "word":
        space = np.isin(points, _SPACES)
        stops = space[:-1] & ~space[1:]
    else:
        stops = np.ones(len(points) - 1, dtype=bool)
    return np.append(np.flatnonzero(stops) + 1, len(points))


def ranks(doc_id: str, seed: int) -> list[int]:
    """The first four groups of eight digits of the hex sha256 of seed, colon, id."""
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digits[at : at + 8], 16) for at in range(0, 32, 8)]


def transform(text: str, doc_id: str, settings: Settings) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = unit_ends(points, settings.unit)
    n = len(ends)
    h1, h2, h3, h4 = ranks(doc_id, settings.seed)
    if not n or h3 % 100 >= settings.rate or any(mark in text for mark in settings.marks):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    cuts = [int(ends[rank - 1]) if rank else 0 for rank in (first, second)]
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in np.split(points, cuts))
    mark = settings
    if h4 % 100 < settings.spm:
        form, output = "spm", f"{mark.suffix}{suffix}{mark.prefix}{prefix}{mark.middle}{middle}"
    else:
        form, output = "psm", f"{mark.prefix}{prefix}{mark.suffix}{suffix}{mark.middle}{middle}"
    return n, form, cuts[0], cuts[1] - cuts[0], output


def fill_in_middle(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of ``docs``.

    A hash of doc_id chooses the ranks of the two borders, whether the text is transformed, and the order; so a task that runs again
    gives the same rows, and rows of one doc_id are cut at the same ranks. A null doc_id hashes as an empty id. Null text counts as empty; empty
    texts and texts that hold a mark stay plain. Very long texts are read whole, four bytes a code point while they are cut.
    Repeated rows each give a row, an empty table none. Other columns are not read. No shuffle.
    """

    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        done = [transform(text.as_py(), doc_id.as_py(), settings) for doc_id, text in zip(ids, texts)]
        columns = list(zip(*done)) if done else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=["n", "form", "prefix_chars", "middle_chars", "output"])

    run.__annotations__ = {"ids": pa.Array, "texts": pa.Array, "return": pa.Array}
    # What is not deterministic is worked out once, however many columns read it.
    cut = F.arrow_udf(run, _SCHEMA).asNondeterministic()
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", cut(name, text_or_empty()).alias("cut")).select("doc_id", "cut.*")


def restored(output: Column | str, form: Column | str, settings: Settings = Settings()) -> Column:
    """The text that ``fill_in_middle`` turned into ``output`` of that form. Null gives null."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def pieces(first: str, second: str, third: str) -> list[Column]:
        """What stands after each mark, in the order in which the marks stand."""
        head = F.substring_index(output, second, 1)
        rest = F.substring(output, F.length(head) + len(second) + 1, F.length(output))
        inner = F.substring_index(rest, third, 1)
        return [F.substring(head, F.lit(len(first) + 1), F.length(head)), inner, F.substring(rest, F.length(inner) + len(third) + 1, F.length(rest))]

    prefix, suffix, middle = pieces(settings.prefix, settings.suffix, settings.middle)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(settings.suffix, settings.prefix, settings.middle)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda column: F.sha2(column.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))


#: For DuckDB: lines by their newlines, borders by the first lines' lengths.
OP12_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), l AS (
    SELECT doc_id, t, string_split(t, chr(10)) AS parts,
        CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS h2,
        CAST(('0x' || substr(h, 25, 8)) AS BIGINT) AS h4
    FROM d
), u AS (
    SELECT *, CAST(len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n FROM l
), r AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS first, greatest(h1 % (n + 1), h2 % (n + 1)) AS second,
        n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
    FROM u
), b AS (
    SELECT *, CASE WHEN first > 0 THEN least(length(t), length(array_to_string(parts[1:first], chr(10))) + 1) ELSE 0 END AS c1,
        CASE WHEN second > 0 THEN least(length(t), length(array_to_string(parts[1:second], chr(10))) + 1) ELSE 0 END AS c2
    FROM r
), o AS (
    SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        substr(t, 1, CAST(c1 AS BIGINT)) AS p, substr(t, CAST(c1 AS BIGINT) + 1, CAST(c2 - c1 AS BIGINT)) AS m, substr(t, CAST(c2 AS BIGINT) + 1) AS s
    FROM b
)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN CAST(c1 AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(c2 - c1 AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM o
"""
