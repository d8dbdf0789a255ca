"""Near-copy dedup: candidates by SimHash and by bands of shingle minima, each verified by the exact Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .simhash import SEED, components_of, of_hashes, one_of_each, row_key

#: Texts of Jaccard similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8, 0.014 at 0.3.
BANDS, ROWS = 20, 6
#: Shingles whose minima are taken at a time: bounds memory on very long texts.
CHUNK = 1 << 12

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``words`` words; a shorter text is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower() changes A-Z alone
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    shingles = zip(*(tokens[at:] for at in range(words))) if len(tokens) > words else [tokens]
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(shingle), SEED) for shingle in shingles}), dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key for each band: a hash of its number and of the minima of its ROWS hash functions."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), CHUNK):
        np.minimum(least, ((shingles[start : start + CHUNK] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), at) for at, band in enumerate(least.reshape(BANDS, ROWS))]


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _sketches(words: int):
    """fp, the hash of a text's shingle set, its SimHash and its band keys."""

    def run(texts: pa.Array) -> pa.Array:
        fps, prints, keys, ends = [], [], [], [0]
        for text in texts:
            shingles = shingle_set(text.as_py(), words)
            fps.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
            prints.append(of_hashes(shingles))
            keys += band_keys(shingles)
            ends.append(len(keys))
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(keys)))
        return pa.StructArray.from_arrays([pa.array(_signed(fps)), pa.array(_signed(prints)), bands], names=["fp", "print", "bands"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "fp long, print long, bands array<long>").asNondeterministic()


def _print_keys(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, key): a key for each component of SimHashes that links of at most ``bits`` bits join, through the anchors of op4_simhash."""
    sets = prints.select("fp", "print").distinct()
    groups = components_of(sets.select(F.col("print").alias("fp"), F.col("fp").alias("doc_id")), bits).select(F.col("fp").alias("print"), "root")
    return sets.join(groups, "print").select("fp", F.xxhash64(F.lit("print"), "root").alias("key"))


def _sets(words: int):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(text.as_py(), words).view(np.int64) for text in texts], pa.list_(pa.int64()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<long>").asNondeterministic()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets reach the Jaccard similarity.

    b's sets are joined last: where many pairs share a b, its set stands on one side of the join once, and is not carried along with each.
    """
    one, two = (sets.select(F.col("fp").alias(side), F.col("shingles").alias(f"of_{side}")) for side in "ab")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    compared = pairs.join(one, "a").join(two, "b").where(F.least(F.size("of_a"), F.size("of_b")) >= similarity * F.greatest(F.size("of_a"), F.size("of_b")))
    return compared.where(shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _prefixes(sets: DataFrame, apart: DataFrame, similarity: float) -> DataFrame:
    """token, fp, root, n, at: the rarest shingles of each set, as many as leave too few others to be similar by.

    Sets that are similar share a shingle among these, whatever the order, so long as it is one for all sets.
    """
    tokens = apart.join(sets, "fp").select("fp", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    spread = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ordered = tokens.join(spread, "token").groupBy("fp", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
    length = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    return ordered.select("fp", "root", "n", F.posexplode(F.slice("all", F.lit(1), length.cast("int"))).alias("at", "one")).select(F.col("one.token").alias("token"), "fp", "root", "n", "at")


def _meeting(prefixes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The postings of shingles that sets of different groups share, and those of them that are indexed.

    Of two similar sets the larger one's first common shingle lies in its prefix. The smaller one's lies in a shorter one, as it has to
    share as much as with a set of its own size at least: only this shorter prefix is indexed. Sets that share a core, but too little of it
    to be similar, have rarer shingles of their own in front, which fill it; so a core that any number of sets hold is in no index and meets nothing.
    """
    several = prefixes.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    kept = materialize(prefixes.join(several, "token"), "prefixes")
    return kept, kept.where(F.col("n") - F.col("at") >= _needed(2 * F.col("n"), similarity))


def _needed(both, similarity: float):
    """The shingles that two sets of so many together must share."""
    return both * (similarity / (1 + similarity)) - 1e-9


def _across(prefixes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of sets of different groups that share a prefix shingle after which enough of both is left."""
    kept, indexed = _meeting(prefixes, similarity)
    index = indexed.select("token", *[F.col(c).alias(f"{c}_b") for c in ("fp", "root", "n", "at")])
    left = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    larger = (F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("fp") != F.col("fp_b")))
    near = larger & (F.col("root") != F.col("root_b")) & (left >= _needed(F.col("n") + F.col("n_b"), similarity))
    met = kept.join(index, (kept["token"] == index["token"]) & near)
    return met.select(F.least("fp", "fp_b").alias("a"), F.greatest("fp", "fp_b").alias("b")).distinct()


def deduplicate(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns.

    Two texts are near copies if their sets of ``words``-word shingles have a Jaccard
    similarity of at least ``similarity``; groups are closed over any number of such steps. Texts
    without words, null ones included, are copies of each other. The smallest doc_id of a group stays, null ids last; of
    rows that share it, the first by a hash of the text; of rows equal in both, any one. Very long texts are read whole. An empty
    table gives no rows. Columns of any other name are carried along.

    Equal sets fold into one first. Their SimHashes are linked at ``bits`` or fewer differing bits, through anchors, and a component of these is a band. As two
    texts at the least similarity differ in more bits, bands of shingle minima stand beside it. Texts that share a band are candidates: each is compared with
    three leaders of its band, first of them the one that shares most bands with others. The members of a band that these
    comparisons have left in different groups are then joined by the rarest of their shingles (prefix and position
    filters), which leaves out no pair. A large group of copies, or of texts about one core that are not similar, thus costs about its size, not
    its square: copies are in one group by then, and of the others' common shingles none is among those that are indexed.
    """
    prints = materialize(docs.select(F.struct(*row_key()).alias("row"), _sketches(words)(F.col("text").cast("string")).alias("s")).select("row", "s.fp", "s.print", "s.bands"), "sketches")
    distinct = materialize(prints.groupBy("fp").agg(F.min("row").alias("row")), "distinct")

    banded = prints.select("fp", F.explode("bands").alias("key")).distinct().unionByName(materialize(_print_keys(prints, bits), "print_keys"))
    bands = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(banded.join(bands, "key"), "shared")
    degree = shared.groupBy("fp").agg(F.sum("n").alias("degree"))
    leaders = [F.max_by("fp", F.struct("degree", "fp")), F.min("fp"), F.max("fp")]
    led_by = shared.join(degree, "fp").groupBy("key").agg(F.array_distinct(F.array(*leaders)).alias("leaders"))
    members = materialize(shared.select("key", "fp").join(led_by, "key"), "members")
    # Shingles are made again for the candidates alone: those of all texts would take more room than the texts.
    wanted = members.select("fp").distinct().join(distinct, "fp").select("fp", "row.*")
    texts = docs.select(*row_key(), F.col("text").cast("string").alias("__text")).join(wanted, ["__no_id", "__id", "__hash"])
    # Rows that are equal in all of the key have equal texts.
    sets = materialize(texts.select("fp", _sets(words)(F.col("__text")).alias("shingles")).dropDuplicates(["fp"]), "sets")

    led = members.select("fp", F.explode("leaders").alias("leader")).where("fp != leader")
    first = materialize(led.select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    links = materialize(_similar(first, sets, similarity), "links")
    roots = connected_components(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = materialize(members.select("key", "fp").join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    apart = rooted.join(split, "key").select("fp", "root").distinct()
    second = _across(materialize(_prefixes(sets, apart, similarity), "prefixes"), similarity)
    links = links.unionByName(_similar(materialize(second, "pairs"), sets, similarity))

    joined = connected_components(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    keep = distinct.join(joined, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row")).select("row.*")
    return one_of_each(docs, keep)
