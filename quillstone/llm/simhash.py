"""SimHash fingerprints, linked through the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, table, unboxed
from .components import connected_components

SEED = 42
#: Hashes whose bits are counted at a time: bounds memory on very long texts.
CHUNK = 1 << 14

# The code: two words of the perfect binary Golay code, on bits 0-22 and 23-45 of a fingerprint.
# Its length, dimension and covering radius, and its generator polynomial
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
LENGTH, DIMENSION, RADIUS, GENERATOR = 23, 12, 3, 0b110001110101


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``words`` words, repeats included."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower() changes A-Z alone
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[at:] for at in range(words))))
    total, n, chunk = np.zeros(64, dtype=np.int64), 0, []
    for shingle in shingles:
        chunk.append(digest(shingle, SEED))
        if len(chunk) == CHUNK:
            total += _bits(chunk)
            n += CHUNK
            chunk = []
    if chunk:
        total += _bits(chunk)
        n += len(chunk)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingles that are hashed already."""
    total = sum((_bits(hashes[start : start + CHUNK]) for start in range(0, len(hashes), CHUNK)), np.zeros(64, dtype=np.int64))
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _bits(hashes) -> np.ndarray:
    """How often each bit is set, least significant first."""
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(len(hashes), 8)
    counts = np.empty((8, 8), dtype=np.int64)
    for octet in range(8):
        seen = np.bincount(octets[:, octet], minlength=256)
        counts[octet] = seen @ _OCTET_BITS
    return counts.ravel()


_OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One pass, no shuffle."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(text.as_py(), words) for text in texts], dtype=np.uint64).view(np.int64))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.select("doc_id", F.arrow_udf(run, "long").asNondeterministic()(F.col("text").cast("string")).alias("fp"))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of words of LENGTH bits by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - (LENGTH - DIMENSION)), 0)
    return rest


@cache
def _cosets(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of up to RADIUS + threshold bits, by syndrome: offsets, patterns, and weights beyond RADIUS (0 for the pattern that leads home)."""
    patterns = np.array([sum(1 << bit for bit in bits) for weight in range(RADIUS + threshold + 1) for bits in combinations(range(LENGTH), weight)], dtype=np.int64)
    excess = np.maximum(0, np.bitwise_count(patterns).astype(np.int64) - RADIUS)
    syndrome = _syndromes(patterns)
    order = np.lexsort((excess, syndrome))
    offsets = np.searchsorted(syndrome[order], np.arange((1 << (LENGTH - DIMENSION)) + 1))
    return offsets, patterns[order], excess[order]


@cache
def _syndrome_tables() -> tuple[np.ndarray, np.ndarray]:
    return _syndromes(np.arange(1 << 12)), _syndromes(np.arange(1 << 11) << 12)


def anchors(fps: np.ndarray, threshold: int, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, anchor) of the home anchor, or of all anchors within the radius plus threshold.

    An anchor is a pair of code words. The code is perfect: each half of a
    fingerprint has one word within RADIUS, its home. If two fingerprints differ
    in at most ``threshold`` bits, e of them in one half and f in the other, the
    halves of the second are within RADIUS + e and RADIUS + f of the first's home.
    """
    mask = (1 << LENGTH) - 1
    low, high = _syndrome_tables()
    offsets, patterns, excess = _cosets(threshold)
    halves = [fps & mask, fps >> LENGTH & mask]
    cosets = [low[half & 0xFFF] ^ high[half >> 12] for half in halves]
    if home:
        words = [half ^ patterns[offsets[coset]] for half, coset in zip(halves, cosets)]
        return np.arange(len(fps)), words[0] << LENGTH | words[1]
    starts = [offsets[coset] for coset in cosets]
    counts = [offsets[coset + 1] - start for coset, start in zip(cosets, starts)]
    each = counts[0] * counts[1]
    index = np.repeat(np.arange(len(fps)), each)
    place = np.arange(len(index)) - np.repeat(np.cumsum(each) - each, each)
    first, second = starts[0][index] + place // counts[1][index], starts[1][index] + place % counts[1][index]
    near = excess[first] + excess[second] <= threshold
    index, first, second = index[near], first[near], second[near]
    return index, (halves[0][index] ^ patterns[first]) << LENGTH | (halves[1][index] ^ patterns[second])


def _at_anchors(fps: DataFrame, threshold: int, home: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for start in range(0, len(values), 2048):
                part = values[start : start + 2048]
                index, anchor = anchors(part, threshold, home)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): each pair of distinct fingerprints that differ in at most ``threshold`` bits, once.

    Each fingerprint goes home to one anchor and visits all anchors within the covering
    radius plus threshold; at each anchor, those at home meet the visitors. The
    exchange is a merge join that Spark may split where many fingerprints share an anchor: a visitor
    has about 61 anchors, of which Spark's estimate by the size of ``fps`` knows nothing, so it would send them all to the driver for a broadcast.
    ``fps`` has a row for each distinct fingerprint (fp), so copies and ties make no pairs; a null one meets none, and an empty
    table gives no rows. Other columns are not read.
    """
    at_home = _at_anchors(fps, threshold, True).select("anchor", F.col("fp").alias("a"))
    visiting = _at_anchors(fps, threshold, False).select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return at_home.join(visiting.hint("merge"), (at_home.anchor == visiting.anchor) & near).select("a", "b")


def components_of(prints: DataFrame, threshold: int) -> DataFrame:
    """(fp, first_id, root) of each distinct fingerprint of ``prints`` (fp, doc_id); root names its component under links of at most ``threshold`` bits."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    joined = connected_components(links(distinct, threshold), "a", "b")
    return distinct.join(joined.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, words: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document.

    component_id is the smallest doc_id that links of at most ``threshold``
    differing bits reach, over any number of steps. Texts without words have
    fingerprint 0 and are linked like any other; null text counts as empty. Null doc_ids
    keep their rows and take part in links, but name no component; one without any
    other id has a null component_id. Only distinct fingerprints are compared, so
    copies cost nothing. Rows that repeat an id get a row each; an empty table gives none; very long
    texts are read whole; other columns are not read.

    The anchors use 46 of the 64 bits: a fingerprint meets, besides its links, about 61 / 2**24 of all
    distinct ones by chance, each of which costs one comparison of two longs.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    rooted = components_of(prints, threshold)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Written, so that the join below has exchanges that Spark can split at a hot fingerprint.
    named = materialize(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(doc_id="doc_id", text="text") -> list[Column]:
    """What orders the rows of a group: doc_id, null ids last, then a hash of the text."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return [doc_id.isNull().alias("__no_id"), F.coalesce(doc_id, F.lit(0)).alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__hash")]


def one_of_each(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each row key in ``keep``. Rows of one key are alike in id and text; any one of them stays."""
    keyed = boxed(docs).select("row", *row_key(F.col("row")["doc_id"], F.col("row")["text"]))
    stay = keyed.join(keep, ["__no_id", "__id", "__hash"], "left_semi")
    # Of many copies of a key, Spark's group limit lets one of each task through before the exchange.
    alone = Window.partitionBy("__no_id", "__id", "__hash").orderBy("__hash")
    return unboxed(stay.withColumn("copy", F.row_number().over(alone)).where("copy = 1"), docs.columns)


def deduplicate(docs: DataFrame, *, words: int = 3, threshold: int = 2) -> DataFrame:
    """``docs`` with one row of each component, all columns.

    The row with the smallest doc_id stays, null ids last; of rows that share it, the
    first by a hash of the text; of rows equal in both, any one. Null texts count as empty ones, and
    texts without words are copies of each other. An empty table gives no rows. Columns of any other name are carried along.
    """
    prints = materialize(fingerprints(docs.select(F.struct(*row_key()).alias("doc_id"), "text"), words).select(F.col("doc_id").alias("row"), "fp"), "fingerprints")
    rooted = materialize(components_of(prints.select("fp", F.col("row.__id").alias("doc_id")), threshold).select("fp", "root"), "components")
    keep = prints.join(rooted, "fp").groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    return one_of_each(docs, keep)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
