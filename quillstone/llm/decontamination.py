"""Benchmark decontamination: BM25 with block-max WAND over passages, then word overlap."""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

_STRIP = b".,;:!?\"'()[]{}<>*_`~|"
_SPLIT_AT = re.compile(r"(?<=\?)\s+|\n+")
_ASKS = re.compile(r"[^\n]*?\?(?:\s|$)")
#: Raw words whose term numbers are remembered before the memory starts anew.
REMEMBERED = 500_000
#: Where a list stands that has no unit left.
_END = 1 << 62


@dataclass(frozen=True)
class Settings:
    """unit_words: longest stretch of an item that is indexed as one unit;
    least_words: shortest question that is a unit apart from its answer; block: units of
    a block of the index, which has maxima of its own; floor: share of a unit's own score that a passage must reach;
    apart: share of the floor that a passage's commonest terms may take together in the first bound, at their largest for all blocks alike;
    shingle: words of a shingle; overlap: share of an item's question shingles, and
    of all its shingles, that a document must hold; whole: share of all its shingles
    that is enough whatever it holds of the question; a first line is a question by
    itself only with a question mark and ``least_words``, else the item is verified
    by all its shingles alone; index_bytes: text of test items
    in one index, which is broadcast; larger sets take several.
    """

    k1: float = 1.2
    b: float = 0.75
    unit_words: int = 64
    least_words: int = 12
    block: int = 2
    floor: float = 0.4
    apart: float = 0.5
    shingle: int = 5
    overlap: float = 0.5
    whole: float = 0.8
    index_bytes: int = 8_000_000


def terms_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, lower-cased, without punctuation at their ends."""
    words = (word.strip(_STRIP) for word in (text or "").lower().encode("utf-8", "replace").split())
    return [word for word in words if word]


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Cut after the first question mark or at the first line end; without either, all is the question."""
    parts = _SPLIT_AT.split((text or "").strip(), maxsplit=1)
    return terms_of(parts[0]), terms_of(parts[1] if len(parts) > 1 else "")


def parts_of(text: str | None, settings: Settings) -> tuple[list[bytes], list[bytes], bool]:
    """Question and answer of an item, and whether the question is judged apart from its answer."""
    question, answer = question_and_answer(text)
    if not question:
        question, answer = answer, []
    return question, answer, not answer or len(question) >= settings.least_words and bool(_ASKS.match((text or "").strip()))


def units_of(question: list, answer: list, settings: Settings) -> Iterator[list]:
    """The stretches of an item that are indexed: the whole item, and a question that is long enough to be told from common words by itself."""
    for part in [question + answer] + [question] * (bool(answer) and len(question) >= settings.least_words):
        pieces = -(-len(part) // settings.unit_words)
        for piece in range(pieces):
            yield part[len(part) * piece // pieces : len(part) * (piece + 1) // pieces]


#: Listed maxima that are added up at once when passages look for their blocks.
TOUCHED = 1 << 20


@dataclass(frozen=True)
class Statistics:
    """Of all units of all test items, however many indexes these are cut into: units, their mean length, and the units that hold each term."""

    units: int
    mean: float
    df: dict[bytes, int]

    @staticmethod
    def of(texts: list[str | None], settings: Settings) -> Statistics:
        df, sizes = Counter(), []
        for text in texts:
            for unit in units_of(*parts_of(text, settings)[:2], settings):
                df.update(set(unit))
                sizes.append(len(unit))
        return Statistics(len(sizes), sum(sizes) / max(1, len(sizes)), df)


class Index:
    """Inverted index of test items: for each term the units that hold it in order, with weights, their maximum, and maxima by block of units.

    A weight is the term's BM25 score as a share of the score that the unit has by all its own terms, so that
    one threshold, ``floor``, holds for all units.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], settings: Settings, statistics: Statistics | None = None):
        self.settings = settings
        known = statistics or Statistics.of([text for _, text in items], settings)
        self.items = []  # (item id, shingles of the question, shingles of the answer), as tuples of term numbers
        self.asks: list[bool] = []
        self.vocabulary: dict[bytes, int] = {}
        units: list[tuple[int, int, dict[int, float]]] = []  # (terms, item, share of each term)
        for item_id, text in items:
            question, answer, asks = parts_of(text, settings)
            if not question:
                continue
            for unit in units_of(question, answer, settings):
                norm = settings.k1 * (1 - settings.b + settings.b * len(unit) / known.mean)
                weights = {}
                for term, tf in Counter(unit).items():
                    idf = math.log(1 + (known.units - known.df[term] + 0.5) / (known.df[term] + 0.5))
                    weights[term] = idf * tf * (settings.k1 + 1) / (tf + norm)
                own = sum(weights.values())
                units.append((len(weights), len(self.items), {self.vocabulary.setdefault(term, len(self.vocabulary)): weight / own for term, weight in weights.items()}))
            numbers = [[self.vocabulary[term] for term in part] for part in (question, answer)]
            self.items.append((item_id, self.shingles(numbers[0]), self.shingles(numbers[1])))
            self.asks.append(asks)
        self.unknown = n_terms = len(self.vocabulary)
        # Units of like size share a block: a short one, whose few terms weigh much, does not raise the maxima of long ones.
        units.sort(key=lambda unit: unit[:2])
        self.item_of = [item for _, item, _ in units]
        self.n_blocks = -(-len(units) // settings.block)
        postings = sorted((term, unit, weight) for unit, (_, _, shares) in enumerate(units) for term, weight in shares.items())
        terms = np.array([term for term, _, _ in postings], dtype=np.int64)
        places = np.array([unit for _, unit, _ in postings], dtype=np.int64)
        weights = np.array([weight for _, _, weight in postings])
        # Sums of bounds stay bounds when rounded.
        above = weights * (1 + 1e-9)
        self.list_start = np.searchsorted(terms, np.arange(n_terms + 2)).tolist()
        self.list_units, self.list_weights = array("i", places.tolist()), array("d", weights.tolist())
        self.list_max = np.zeros(n_terms + 1)
        np.maximum.at(self.list_max, terms, above)
        # Block maxima by term, ordered by block, as the lists are by unit.
        cell, place = np.unique(terms * self.n_blocks + places // settings.block, return_inverse=True) if len(terms) else (terms, terms)
        block_weights = np.zeros(len(cell))
        np.maximum.at(block_weights, place, above)
        of_term, block_of = np.divmod(cell, max(1, self.n_blocks))
        self.block_start = np.searchsorted(of_term, np.arange(n_terms + 2)).tolist()
        self.block_of, self.block_weights = array("i", block_of.tolist()), array("d", block_weights.tolist())
        by_block = np.lexsort((of_term, block_of))
        self.terms_start = np.searchsorted(block_of[by_block], np.arange(self.n_blocks + 1)).tolist()
        self.terms_of = array("i", of_term[by_block].tolist())
        # For the first bound, terms with many blocks and small maxima are taken at their largest: those come first in this order.
        self.cells = np.diff(self.block_start)
        self.cell, self.cell_block, self.cell_weight = cell, block_of, block_weights
        self.common = np.argsort(np.argsort(-self.cells / np.maximum(self.list_max, 1e-12), kind="stable"))
        self.least = settings.floor * (1 - 1e-9)
        self._known: dict[bytes, int] = {}

    def shingles(self, numbers: list[int]) -> set[tuple]:
        n = self.settings.shingle
        return {tuple(numbers[at : at + n]) for at in range(max(1, len(numbers) - n + 1))} if numbers else set()

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of the texts' words, and the text that each is of; words of punctuation alone are left out."""
        known, words, counts = self._known, [], []
        for text in texts:
            before = len(words)
            words += (text or "").lower().encode("utf-8", "replace").split()
            counts.append(len(words) - before)
        out = list(map(known.get, words))
        if None in out:
            if len(known) >= REMEMBERED:
                known.clear()
            for at, number in enumerate(out):
                if number is None:
                    term = words[at].strip(_STRIP)
                    out[at] = known[words[at]] = self.vocabulary.get(term, self.unknown) if term else -1
        numbers, of_text = np.array(out, dtype=np.int64), np.repeat(np.arange(len(texts)), counts)
        kept = numbers >= 0
        return (numbers, of_text) if kept.all() else (numbers[kept], of_text[kept])

    def block_max(self, term: int, block: int) -> float:
        high = self.block_start[term + 1]
        at = bisect_left(self.block_of, block, self.block_start[term], high)
        return self.block_weights[at] if at < high and self.block_of[at] == block else 0.0

    def wand(self, terms: list[int], live: list[int]) -> Iterator[tuple[int, float]]:
        """(unit, score) of the units in ``live`` blocks (ascending) whose score by these distinct terms reaches the floor.

        Block-max WAND: lists are kept in the order of the units they stand at. The pivot is the unit at
        which the maxima of the lists up to it first reach the floor: no earlier unit can. If the maxima
        of these lists in the pivot's block reach it too, lists that lag are moved to the pivot, and it is scored once all
        stand there; else the lists skip the block, or as far as the next list begins to matter. Blocks that are not live are skipped.
        """
        units, weights, size = self.list_units, self.list_weights, self.settings.block
        asked, held = set(terms), set()
        for block in live:
            held |= asked.intersection(self.terms_of[self.terms_start[block] : self.terms_start[block + 1]])
        # [unit, place, end, term] of each list that reaches a live block.
        lists = [[0, self.list_start[term], self.list_start[term + 1], term] for term in held]

        def seek(entry: list, unit: int) -> None:
            """To the first unit of the list at or after ``unit``, in a live block."""
            while True:
                place = bisect_left(units, unit, entry[1], entry[2])
                entry[1] = place
                if place == entry[2]:
                    entry[0] = _END
                    return
                entry[0] = found = units[place]
                at = bisect_left(live, found // size)
                if at == len(live):
                    entry[0] = _END
                    return
                if live[at] == found // size:
                    return
                unit = live[at] * size

        def move(entries: list[list], unit: int) -> None:
            nonlocal lists
            for entry in entries:
                seek(entry, unit)
            lists = sorted(entry for entry in lists if entry[0] != _END)

        move(lists, 0)
        while lists:
            bound, pivot = 0.0, None
            for place, entry in enumerate(lists):
                bound += self.list_max[entry[3]]
                if bound >= self.least:
                    pivot = entry[0]
                    break
            if pivot is None:
                return
            while place + 1 < len(lists) and lists[place + 1][0] == pivot:
                place += 1
            upto, block = lists[: place + 1], pivot // size
            if sum(self.block_max(entry[3], block) for entry in upto) < self.least:
                after = (block + 1) * size
                move(upto, min(after, lists[place + 1][0]) if place + 1 < len(lists) else after)
            elif upto[0][0] < pivot:
                move([entry for entry in upto if entry[0] < pivot], pivot)
            else:
                score = math.fsum(weights[entry[1]] for entry in upto)
                if score >= self.least:
                    yield pivot, score
                move(upto, pivot + 1)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item place, best score, question overlap, overlap of all) of items that the texts hold.

        Passages are windows of twice ``unit_words`` that start every
        ``unit_words``, so each stretch of ``unit_words`` lies whole in one.
        """
        s = self.settings
        if not self.items:
            return
        numbers, of_text = self.numbers(texts)
        if not len(numbers):
            return
        # Half windows are numbered through all texts, with one left free after each text.
        starts = np.searchsorted(of_text, np.arange(len(texts) + 1))
        halves = -(-np.diff(starts) // s.unit_words) + 1
        first_half = np.cumsum(halves) - halves
        half = first_half[of_text] + (np.arange(len(numbers)) - starts[of_text]) // s.unit_words
        begins = np.zeros(int(halves.sum()), dtype=bool)
        begins[first_half] = True
        live = self._live(half, numbers, begins)
        text_of = np.searchsorted(first_half, np.array(sorted(live), dtype=np.int64), side="right") - 1
        found: dict[tuple[int, int], list] = {}
        for text, passage in zip(text_of.tolist(), sorted(live)):
            start = int(starts[text]) + (passage - int(first_half[text])) * s.unit_words
            end = int(starts[text + 1])
            window = numbers[start : min(end, start + 2 * s.unit_words)]
            terms = np.unique(window)
            shingles = None
            for unit, value in self.wand((terms[:-1] if terms[-1] == self.unknown else terms).tolist(), live[passage]):
                if shingles is None:
                    run = numbers[start : min(end, start + 2 * s.unit_words + s.shingle - 1)].tolist()
                    shingles = {tuple(run[at : at + s.shingle]) for at in range(len(run))}
                item = self.item_of[unit]
                _, question, answer = self.items[item]
                hit = found.setdefault((text, item), [0.0, set(), set()])
                hit[0] = max(hit[0], value)
                for part, held in ((question, hit[1]), (answer, hit[2])):
                    held |= {x for x in part if x in shingles} if len(next(iter(part), ())) == s.shingle else {x for x in part if _runs(window, x)}
        for (text, item), (value, asked, answered) in sorted(found.items()):
            _, question, answer = self.items[item]
            of_question = len(asked) / len(question)
            of_all = (len(asked) + len(answered)) / (len(question) + len(answer))
            if of_all >= s.whole or of_all >= s.overlap and (of_question >= s.overlap or not self.asks[item]):
                yield text, item, value, of_question, of_all

    def _live(self, half: np.ndarray, numbers: np.ndarray, first: np.ndarray) -> dict[int, list[int]]:
        """The blocks of each passage in which the block maxima of its distinct terms add up to the floor.

        A passage, named by its first half window, is made of that half and the next; ``first`` marks halves that begin a
text and so end no passage. A passage's commonest terms, as many as make up less than a share of the floor by their
        largest weights, touch no block: only blocks that hold others of its terms do, which have to make up the rest. In the blocks that
        are left, the common terms are looked up as well.
        """
        inside, width = numbers < self.unknown, self.unknown + 1
        pairs = _distinct(half[inside] * width + numbers[inside])
        if not len(pairs):
            return {}
        pairs = _distinct(np.concatenate([pairs, pairs[~first[pairs // width]] - width]))
        passage, term = pairs // width, pairs % width
        order = np.argsort(passage * width + self.common[term], kind="stable")
        term = term[order]  # passages stay in order, their commonest terms first
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        edges = np.append(starts, len(term))
        largest = np.cumsum(self.list_max[term])
        before = np.repeat(np.append(0, largest)[starts], np.diff(edges))
        common = largest - before <= self.settings.apart * self.least
        apart = np.add.reduceat(np.where(common, self.list_max[term], 0), starts)
        counts = np.where(common, 0, self.cells[term])
        n_common = np.add.reduceat(common.astype(np.int64), starts)  # they stand first
        out: dict[int, list[int]] = defaultdict(list)
        # Passages at a time whose terms have so many block maxima: bounds what is sorted at once.
        upto = np.append(0, np.cumsum(np.add.reduceat(counts, starts)))
        list_start = np.asarray(self.block_start)
        low = 0
        while low < len(starts):
            n = max(1, int(np.searchsorted(upto, upto[low] + TOUCHED, side="right")) - 1 - low)
            own = slice(edges[low], edges[low + n])
            local = np.repeat(np.arange(n), np.diff(edges[low : low + n + 1]))
            of_cell = np.repeat(local, counts[own])
            flat = np.arange(len(of_cell)) + np.repeat(list_start[term[own]] - np.cumsum(counts[own]) + counts[own], counts[own])
            cells, weights = of_cell * self.n_blocks + self.cell_block[flat], self.cell_weight[flat]
            if n * self.n_blocks <= 4 * len(cells):  # most blocks are touched: a table of all is smaller than what would be sorted
                table = np.bincount(cells, weights=weights, minlength=n * self.n_blocks)
                found = np.flatnonzero(table + np.repeat(apart[low : low + n], self.n_blocks) >= self.least)
                sums = table[found]
            else:
                order = np.argsort(cells, kind="stable")
                cells = cells[order]
                heads = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else cells
                sums = np.add.reduceat(weights[order], heads) if len(cells) else np.zeros(0)
                kept = sums + apart[low + cells[heads] // self.n_blocks] >= self.least
                found, sums = cells[heads][kept], sums[kept]
            at, block = np.divmod(found, self.n_blocks)
            asked = n_common[low + at]
            of_found = np.repeat(np.arange(len(found)), asked)
            places = np.arange(len(of_found)) + np.repeat(starts[low + at] - np.cumsum(asked) + asked, asked)
            wanted = term[places] * self.n_blocks + block[of_found]
            cell_at = np.minimum(np.searchsorted(self.cell, wanted), len(self.cell) - 1)
            there = np.where(self.cell[cell_at] == wanted, self.cell_weight[cell_at], 0.0)
            whole = sums + np.bincount(of_found, weights=there, minlength=len(found))
            reached = whole >= self.least
            for passage_at, number in zip(at[reached].tolist(), block[reached].tolist()):
                out[int(passage[starts[low + passage_at]])].append(number)
            low += n
        return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _runs(window: np.ndarray, part: tuple) -> bool:
    """Whether a stretch shorter than a shingle occurs in the window."""
    at = np.flatnonzero(window[: len(window) - len(part) + 1] == part[0])
    for step, term in enumerate(part[1:], 1):
        at = at[window[at + step] == term]
    return bool(len(at))


def _parts(texts: pa.Array, most_bytes: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of runs of texts of about that size."""
    some, size, at = [], 0, 0
    for place, text in enumerate(texts):
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size >= most_bytes:
            yield at, some
            some, size, at = [], 0, place + 1
    if some:
        yield at, some


_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, overlap double"


def indexes(benchmark: DataFrame, settings: Settings) -> Iterator[Index]:
    """One index for each part of the test items with at most ``index_bytes`` of text on average; all share the statistics of all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // settings.index_bytes))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each term of each unit; and one without a term for the units of an item, with their words."""
        for batch in batches:
            part, term, units, words = [], [], [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(units_of(*parts_of(text, settings)[:2], settings))
                for terms, n, size in [*(([*set(unit)], 1, 0) for unit in found), ([None], len(found), sum(map(len, found)))]:
                    term += terms
                    part += [number] * len(terms)
                    units += [n] * len(terms)
                    words += [size] * len(terms)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(term, pa.binary()), pa.array(units, pa.int64()), pa.array(words, pa.int64())], names=["part", "term", "units", "words"])

    cut = materialize(dealt.select("part", "text").mapInArrow(count, "part int, term binary, units long, words long"), "unit_terms")
    counts = materialize(cut.groupBy("term").agg(F.sum("units").alias("units"), F.sum("words").alias("words")), "unit_counts")
    whole = counts.where("term IS NULL").first()
    units, words = (whole.units, whole.words) if whole else (0, 0)
    for part in range(parts):
        mine = cut.where((F.col("part") == part) & F.col("term").isNotNull()).select("term").distinct()
        df = {bytes(row.term): row.units for row in counts.join(mine, "term").collect()}
        rows = dealt.where(F.col("part") == part).orderBy("item_id", "text").collect()
        yield Index([(row.item_id, row.text) for row in rows], settings, Statistics(units, words / max(1, units), df))


def search(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each document and test item that it holds.

    Every passage of every document queries the index; hits over the threshold
    are verified by the share of the item's word shingles that the document's
    matching passages hold (``question_overlap``, and ``overlap`` with the answer; see
    ``Settings`` for when the question is asked for by itself);
    ``score`` is the best BM25 score as a share of the unit's own. The index of the
    test items is broadcast, and the documents scanned once; test items of more than
    ``index_bytes`` take an index and a scan for each such part, one after the other, with the same scores. No shuffle. Null texts, and
    items without words, match nothing; very long texts are cut into passages like any other.
    Equal doc_ids get rows each; null doc_ids and item_ids are kept; equal items count once. An empty table, of either kind, gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, shared = None, None
    for index in indexes(benchmark, settings):
        if shared is not None:
            # Each index leaves the executors before the next comes.
            out = materialize(out, "found")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            local = shared.value
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1)
                rows = []
                for part in _parts(texts):
                    at, some = part
                    rows += [(keys[at + text], local.items[item][0], *rest) for text, item, *rest in local.search(some)]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)], names=["doc_id", "item_id", "score", "question_overlap", "overlap"])

        found = slim.mapInArrow(run, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay, in one pass without a join.

    A document with null text stays; so do repeated rows and null ids that hold none. See ``search`` for other cases.
    """
    out, shared = docs, None
    for index in indexes(benchmark, settings):
        if shared is not None:
            out = materialize(out, "clean")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = out.where(_holds_none(shared)(F.col("text").cast("string")))
    return out


def _holds_none(shared):
    def run(texts: pa.Array) -> pa.Array:
        clean = np.ones(len(texts), dtype=bool)
        for at, some in _parts(texts):
            clean[[at + text for text, *_ in shared.value.search(some)]] = False
        return pa.array(clean)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "boolean")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
