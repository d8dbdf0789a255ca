"""Collocations: phrases grown word by word over inverted lists of their positions, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, materialize, table, text_or_empty

#: What ends a piece of text; between two words stand spaces and tabs.
_STOPS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_STOPS + b"\t", b"\n" * len(_STOPS) + b" ")
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20
#: Lists of a block, and of it how many its number within a task leaves room for.
LOCAL_BITS, BLOCKS_OF_TASK = 23, 20
#: Words of the corpus for each part that phrases are counted in, and parts at least.
PART, LEAST_PARTS = 1 << 21, 16
#: Groups of phrases of a language that are ranked apart first, so that no task ranks all of them.
RANKED_APART = 64


@dataclass(frozen=True)
class Settings:
    """least: occurrences that a phrase needs; longest: its words at most; share: of a hundred occurrences, those that a longer
    phrase must hold to replace it; top: phrases of each language; block: words whose lists are held together.
    """

    least: int = 100
    longest: int = 5
    share: int = 100
    top: int = 2000
    block: int = 1 << 21

    def __post_init__(self):
        if self.longest < 2 or self.least < 1 or not 1 <= self.block <= 1 << LOCAL_BITS - 1:
            raise ValueError(f"phrases of two words and occurrences of one at least, and at most {1 << LOCAL_BITS - 1} words in a block")


class _Numbers(dict):
    """The numbers of words, in the order in which they are met. The end of a piece is -1, what stands between two separators -2."""

    def __init__(self):
        super().__init__({b"\n": -1, b"": -2})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 2
        return number


def word_slices(text: bytes, least: int = 8) -> Iterator[list[bytes]]:
    """The words of a text, with b"\\n" where a piece ends and some empty strings, in slices that bound the memory a text takes.

    A slice ends with a word and holds ``least`` words and ends of pieces, but for the last.
    """
    plain = text.lower().translate(_PLAIN)  # bytes.lower() changes A-Z alone
    low, size = 0, SLICE
    while low < len(plain):
        high = low + size
        if high < len(plain):
            high = max(plain.rfind(b" ", low, high), plain.rfind(b"\n", low, high)) + 1
        words = plain[low:high].replace(b"\n", b" \n ").split(b" ") if high > low else []
        if high < len(plain) and sum(map(bool, words)) < least:
            size *= 2
            continue
        yield words
        low, size = max(high, low), SLICE


def _packed(*columns: np.ndarray, rising: int = 0) -> bytes:
    """Equally long columns of integers as one compressed string; the first ``rising`` as steps. Bytes of one weight stand together, so that
    small numbers take little room in any type."""
    stored = [np.diff(column, prepend=column.dtype.type(0)) if at < rising else np.ascontiguousarray(column) for at, column in enumerate(columns)]
    planes = b"".join(column.view(np.uint8).reshape(len(column), -1).T.tobytes() for column in stored) if len(columns[0]) else b"\0"
    return f"{len(columns[0])} {rising} {''.join(column.dtype.char for column in columns)}\n".encode() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> list[np.ndarray]:
    head, _, body = packed.partition(b"\n")
    n, rising, kinds = head.decode().split(" ")
    n, rising, kinds = int(n), int(rising), [np.dtype(kind) for kind in kinds]
    if not n:
        return [np.zeros(0, dtype=kind) for kind in kinds]
    plain = np.frombuffer(pa.decompress(body, decompressed_size=n * sum(kind.itemsize for kind in kinds), codec="zstd"), dtype=np.uint8)
    out, low = [], 0
    for at, kind in enumerate(kinds):
        high = low + n * kind.itemsize
        column = np.ascontiguousarray(plain[low:high].reshape(kind.itemsize, n).T).view(kind).ravel()
        out.append(np.cumsum(column, dtype=kind) if at < rising else column)
        low = high
    return out


def _lists(at: np.ndarray, phrase: np.ndarray, own: int) -> bytes:
    """Rising positions and the phrase that starts at each; positions from ``own`` on are the next block's."""
    return b"%d " % own + _packed(at.astype(np.int32), phrase.astype(np.int32), rising=1)


def _positions(packed: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    own, _, rest = packed.partition(b" ")
    at, phrase = _unpacked(rest)
    return at, phrase, int(own)


def _blocks(docs: DataFrame, settings: Settings) -> DataFrame:
    """block, lang, n, words, counts, lists: the words of some ``settings.block`` positions of one language, joined by newlines, how often each
    is counted there, and the positions that hold them; a word's number is its place.

    A text that goes on in the next block leaves its next words here as well, without counting them, so that
    each phrase is found whole in the block in which it starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number = TaskContext.get().partitionId() << BLOCKS_OF_TASK
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0

        def written(open_lang: str | None = None, ahead: tuple = ()) -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            for lang, (numbers, parts) in held.items():
                if number - first >> BLOCKS_OF_TASK:
                    raise ValueError("too many blocks in one task: take larger blocks or more partitions")
                own = sum(map(len, parts))
                if lang == open_lang:
                    parts.append(np.array([numbers[word] for word in ahead], dtype=np.int32))
                ids = np.concatenate(parts)
                at = np.flatnonzero(ids >= 0)
                ids = ids[at]
                counts = np.bincount(ids[at < own], minlength=len(numbers) - 2).astype(np.int32)
                words = pa.compress(b"\n".join(islice(numbers, 2, None)) or b"\0", codec="zstd", asbytes=True)
                size_of = sum(map(len, numbers)) - 1 + max(0, len(numbers) - 3)
                columns = [pa.array([value], kind) for value, kind in ((number, pa.int64()), (lang, pa.string()), (int(counts.sum()), pa.int64()), (max(1, size_of), pa.int64()), (words, pa.binary()), (_packed(counts), pa.binary()), (_lists(at, ids, own), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "n", "size", "words", "counts", "lists"])
                number += 1
            held.clear()
            size = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for words in word_slices(text.as_py(), settings.longest):
                    if size >= settings.block:
                        ahead = islice(takewhile(lambda word: word != b"\n", filter(None, words)), settings.longest - 1)
                        yield from written(lang, tuple(ahead))
                    numbers, parts = held.setdefault(lang, (_Numbers(), []))
                    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    ids = ids[ids > -2]
                    parts.append(ids)
                    size += len(ids)
                if lang in held:
                    held[lang][1].append(np.array([-1], dtype=np.int32))
                    size += 1
        yield from written()

    return docs.mapInArrow(run, "block long, lang string, n long, size long, words binary, counts binary, lists binary")


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of each part that occurs."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    for low, high in zip(edges, [*edges[1:], len(order)]):
        yield int(part[order[low]]), order[low:high]


def _words_by_part(blocks: DataFrame, parts: int) -> DataFrame:
    """block, lang, part, words, size, held: the words of each block, dealt to parts by a hash of word and lang, with their numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, size, packed, counted in zip(*(column.to_pylist() for column in batch.columns)):
                counts, seed = _unpacked(counted)[0], crc32(lang.encode())
                words = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).split(b"\n") if len(counts) else []
                part = np.fromiter((crc32(word, seed) % parts for word in words), np.int64, len(words))
                rows = []
                for number, places in _dealt(part):
                    joined = b"\n".join([words[at] for at in places.tolist()])
                    rows.append((block, lang, number, pa.compress(joined, codec="zstd", asbytes=True), len(joined), _packed(places.astype(np.int32), counts[places], rising=1)))
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=["block", "lang", "part", "words", "size", "held"])

    return blocks.select("block", "lang", "size", "words", "counts").mapInArrow(run, "block long, lang string, part long, words binary, size long, held binary")


def _alive(blocks: list[int], numbers: list[np.ndarray], gids: np.ndarray) -> list[tuple[int, bytes]]:
    """(block, numbers and gids of its lists that stay) for each block that has any; ``gids`` are those of all blocks' lists, -1 where one goes."""
    cuts = np.cumsum([len(of_block) for of_block in numbers])[:-1]
    out = []
    for block, local, gid in zip(blocks, numbers, np.split(gids, cuts)):
        stays = gid >= 0
        if stays.any():
            out.append((block, _packed(local[stays], gid[stays], rising=1)))
    return out


def _frequent_words(dealt: DataFrame, parts: int, least: int) -> DataFrame:
    """The words that all blocks of a language together hold ``least`` times: a row for each block of a part that holds some (block, alive), and one for each part (gid, a, lang, word)."""

    def run(table: pa.Table) -> pa.Table:
        blocks, langs, part = table.column("block").to_pylist(), table.column("lang").to_pylist(), table.column("part")[0].as_py()
        held = [_unpacked(packed) for packed in table.column("held").to_pylist()]
        words = []
        for lang, packed, size in zip(langs, table.column("words").to_pylist(), table.column("size").to_pylist()):
            end = b"\n" + lang.encode()  # no word holds a newline
            words += [word + end for word in pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")]
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        code = coded.indices.to_numpy()
        sums = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(sums, code, np.concatenate([counts for _, counts in held]).astype(np.int64))
        named = sorted((coded.dictionary[at].as_py(), at) for at in np.flatnonzero(sums >= least).tolist())
        kept = np.array([at for _, at in named], dtype=np.int64)
        gids = np.full(len(sums), -1, dtype=np.int64)
        gids[kept] = np.arange(len(kept)) * parts + part
        rows = [(block, alive, None, None, None, None) for block, alive in _alive(blocks, [local for local, _ in held], gids[code])]
        texts = [name.split(b"\n", 1) for name, _ in named]
        rows.append((None, None, gids[kept], sums[kept], [lang.decode() for _, lang in texts], [word.decode() for word, _ in texts]))
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["block", "alive", "gid", "a", "lang", "word"])

    return dealt.groupBy("part").applyInArrow(run, "block long, alive binary, gid array<long>, a array<long>, lang array<string>, word array<string>")


def _grown(lists: DataFrame, frequent: DataFrame, parts: int) -> DataFrame:
    """block, lists, part, held: the lists of phrases of one word more, a row for each block (lists), and what they are called, dealt to parts (part, held).

    The list of a frequent phrase is merge-joined with the lists that hold the next position: those of the frequent phrases of the same length
    which start one word later and so add the word that stands behind it. All lists of a block are joined in one pass over its
    positions. A new phrase is called by the gids of these two; held has its number in the block, them, and its list's length.
    """

    def run(table: pa.Table, alive: pa.Table) -> pa.Table:
        rows = []
        stays = [_unpacked(packed) for packed in alive.column("alive").to_pylist()] or [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))]
        for block, packed in zip(table.column("block").to_pylist(), table.column("lists").to_pylist()):
            at, phrase, own = _positions(packed)
            # Frequent phrases are numbered anew by rising gids, so that names and numbers of what grows rise together.
            local, gid = (np.concatenate([of_part[at_] for of_part in stays]) for at_ in (0, 1))
            order = np.argsort(gid)
            gids = gid[order]
            rank = np.full(int(max(phrase.max(initial=-1), local.max(initial=-1))) + 1, -1, dtype=np.int64)
            rank[local[order]] = np.arange(len(order))
            phrase = rank[phrase]
            kept = phrase >= 0
            at, phrase = at[kept], phrase[kept]
            meet = np.flatnonzero(at[1:] == at[:-1] + 1)
            pairs, number = np.unique(phrase[meet] * len(gids) + phrase[meet + 1], return_inverse=True)
            at = at[meet]
            counts = np.bincount(number[at < own], minlength=len(pairs)).astype(np.int32)
            rows.append((block, _lists(at, number, own), None, None))
            left, right = gids[pairs // max(1, len(gids))], gids[pairs % max(1, len(gids))]
            hashed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            part = ((hashed ^ (hashed >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)
            rows += [(block, None, number, _packed(places.astype(np.int32), left[places], right[places], counts[places], rising=2)) for number, places in _dealt(part)]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return pa.table([pa.array(column, kind) for column, kind in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["block", "lists", "part", "held"])

    grouped = lists.select("block", "lists").groupBy("block").cogroup(frequent.groupBy("block"))
    return grouped.applyInArrow(run, "block long, lists binary, part long, held binary")


def _frequent_pairs(dealt: DataFrame, parts: int, least: int) -> DataFrame:
    """As ``_frequent_words``, for phrases that are called by two gids: (block, alive), and (gid, a, left, right) for each part."""

    def run(table: pa.Table) -> pa.Table:
        blocks, part = table.column("block").to_pylist(), table.column("part")[0].as_py()
        held = [_unpacked(packed) for packed in table.column("held").to_pylist()]
        left, right = (np.concatenate([of_block[at] for of_block in held]) for at in (1, 2))
        counts = np.concatenate([of_block[3] for of_block in held]).astype(np.int64)
        order = np.lexsort((right, left))
        new = np.flatnonzero((np.diff(left[order], prepend=-1) != 0) | (np.diff(right[order], prepend=-1) != 0))
        sums = np.add.reduceat(counts[order], new)
        kept = np.flatnonzero(sums >= least)
        of_pair = np.full(len(new), -1, dtype=np.int64)
        of_pair[kept] = np.arange(len(kept)) * parts + part
        gids = np.empty(len(order), dtype=np.int64)
        gids[order] = np.repeat(of_pair, np.diff(new, append=len(order)))
        rows = [(block, alive, None, None, None, None) for block, alive in _alive(blocks, [of_block[0] for of_block in held], gids)]
        rows.append((None, None, of_pair[kept], sums[kept], left[order][new[kept]], right[order][new[kept]]))
        kinds = (pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4)
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["block", "alive", "gid", "a", "left", "right"])

    return dealt.groupBy("part").applyInArrow(run, "block long, alive binary, gid array<long>, a array<long>, left array<long>, right array<long>")


def _dictionary(frequent: DataFrame, *columns: str) -> DataFrame:
    """A row for each phrase of the parts' rows."""
    return frequent.where("gid IS NOT NULL").select(F.explode(F.arrays_zip("gid", "a", *columns)).alias("p")).select("p.*")


def _forget(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        delete(table.sparkSession, folder)


def phrases(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases of ``docs`` (text, lang), and n, the words of each lang.

    Of a phrase: gid (its number among those of so many words), lang, phrase, last (its last word), a (its occurrences), heads and tails (the occurrences of its first one, two, ...
    words, and of what is left then), left and right (the phrases without the last and without the first word).
    """
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("string").alias("text"))
    blocks = materialize(_blocks(source, settings), "blocks")
    totals = materialize(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    # A part's phrases are counted by one task, so there are as many as the corpus is long.
    parts = max(LEAST_PARTS, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // PART))
    alive = lambda found: found.where("block IS NOT NULL").select("block", "alive")
    frequent = materialize(_frequent_words(_words_by_part(blocks, parts), parts, settings.least), "frequent")
    none, no_phrase = F.array().cast("array<long>"), F.lit(None).cast("long")
    words = _dictionary(frequent, "lang", "word").select("gid", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails"), no_phrase.alias("left"), no_phrase.alias("right"))
    of_length = [materialize(words, "phrases")]
    lists, done = blocks, [blocks, frequent]
    for _ in range(settings.longest - 1):
        grown = materialize(_grown(lists, alive(frequent), parts), "lists")
        for read in done:  # what was grown from is read no more
            _forget(read)
        lists = grown.where("lists IS NOT NULL")
        frequent = materialize(_frequent_pairs(grown.where("part IS NOT NULL").select("block", "part", "held"), parts, settings.least), "frequent")
        # Phrases are joined as a dictionary, a row for each; their occurrences stay in the blocks.
        l, r = of_length[-1].alias("l"), of_length[-1].alias("r")  # noqa: E741
        joined = _dictionary(frequent, "left", "right").alias("p").join(l, F.col("p.left") == F.col("l.gid")).join(r, F.col("p.right") == F.col("r.gid"))
        longer = joined.select("p.gid", "l.lang", F.concat_ws(" ", "l.phrase", "r.last").alias("phrase"), "r.last", "p.a", F.concat("l.heads", F.array("l.a")).alias("heads"), F.concat(F.array("r.a"), "r.tails").alias("tails"), "p.left", "p.right")
        of_length.append(materialize(longer, "phrases"))
        done = [grown, frequent]
    for read in done:
        _forget(read)
    every = of_length[0]
    for one in of_length[1:]:
        every = every.unionByName(one)
    return every, totals


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two words or more of each language.

    The corpus is dealt in blocks of positions, which hold for each phrase the list of its positions. A phrase grows by the merge join
    of its list with those of the next positions; the lengths of its lists in all blocks add up to its frequency, which is exact.
    Lists stay with their block; what travels is a phrase's name and its list's length, packed by block and part of the phrases, and
    phrases below ``least`` go before they grow, as no longer phrase can be more frequent. So no task holds a frequent phrase's
    positions in the whole corpus, and a part's phrases are as many whatever the corpus's size.

    Null text counts as empty, a null lang as ``und``. Repeated rows count again. Words and phrases are told apart by their bytes. Of equal
    scores and frequencies the phrase comes first whose UTF-8 bytes do. Very long texts are read in slices and go on in further blocks. An empty table gives no rows;
    other columns are not read.
    """
    every, totals = phrases(docs, settings)
    longer = every.where("left IS NOT NULL").withColumn("cuts", F.size("heads"))
    holds = longer.select((F.col("cuts") - 1).alias("cuts"), F.explode(F.array("left", "right")).alias("gid"), "a").groupBy("cuts", "gid").agg(F.max("a").alias("most"))
    alone = longer.join(holds, ["cuts", "gid"], "left").where(F.col("most").isNull() | (100 * F.col("most") < settings.share * F.col("a")))
    # Products of three counts take up to 33 digits; a score is at most ten times n.
    exact = lambda column: F.col(column).cast("decimal(17,0)")
    of_n = alone.join(totals, "lang").withColumn("number", (F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).cast("decimal(38,0)"))
    cut = "transform(arrays_zip(heads, tails), (c, at) -> struct(number div (cast(c.heads AS decimal(17,0)) * cast(c.tails AS decimal(17,0))) AS score, at, c.heads AS l, c.tails AS r))"
    scored = of_n.select("lang", "phrase", "a", "n", F.array_min(F.expr(cut)).alias("cut")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART))
    best = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= settings.top).drop("part", "rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= settings.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: For DuckDB: every run of one to five words within a piece, counted.
OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9), repeat(chr(10), 9) || ' '), chr(10))) AS piece
    FROM documents
), cut AS (
    SELECT lang, string_split(trim(regexp_replace(piece, ' +', ' ', 'g'), ' '), ' ') AS words FROM pieces WHERE trim(piece, ' ') <> ''
), starts AS (
    SELECT lang, words, unnest(generate_series(1, len(words))) AS s FROM cut
), runs AS (
    SELECT lang, k, words[s:s + k - 1] AS w FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE s + k - 1 <= len(words)
), f AS (
    SELECT lang, k, w, CAST(count(*) AS BIGINT) AS a FROM runs GROUP BY lang, k, w HAVING count(*) >= 100
), n AS (
    SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM cut GROUP BY lang
), held AS (
    SELECT lang, w[1:k - 1] AS w, a FROM f WHERE k > 2 UNION ALL SELECT lang, w[2:k] AS w, a FROM f WHERE k > 2
), most AS (
    SELECT lang, w, max(a) AS most FROM held GROUP BY lang, w
), candidates AS (
    SELECT f.lang, f.k, f.w, f.a, n.n FROM f JOIN n ON f.lang = n.lang LEFT JOIN most ON most.lang = f.lang AND most.w = f.w
    WHERE f.k > 1 AND (most.most IS NULL OR 100 * most.most < 100 * f.a)
), cuts AS (
    SELECT lang, k, w, a, n, unnest(generate_series(1, k - 1)) AS c FROM candidates
), scores AS (
    SELECT cuts.lang, cuts.w, cuts.a, n, c, x.a AS l, y.a AS r, CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.w = cuts.w[1:c] JOIN f y ON y.lang = cuts.lang AND y.w = cuts.w[c + 1:cuts.k]
), weakest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, c) AS place FROM scores
), ranked AS (
    SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM weakest WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank FROM ranked)
WHERE rank <= 2000
"""
