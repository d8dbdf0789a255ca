"""Collocations against a count of every phrase, on whole tables, odd rows and blocks of any size."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import collocations
from quillstone.llm.collocations import Settings
from quillstone.llm.queries import QUERIES, SQL

from .conftest import CLASHES, ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, settings=Settings()):
    """(lang, rank, phrase, a, l, r, n, score) from (text, lang) rows, in Python's integers."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, settings.longest + 1):
                for at in range(len(words) - size + 1):
                    counts[lang][tuple(words[at : at + size])] += 1
    out = []
    for lang, f in counts.items():
        n = totals[lang]
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= settings.least}
        held = set()
        for p, a in found.items():
            for size in range(2, len(p)):
                held |= {q for at in range(len(p) - size + 1) if 100 * a >= settings.share * f[q := p[at : at + size]]}
        scored = []
        for p, a in found.items():
            if p not in held:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[: settings.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(docs, settings=Settings()):
    return sorted(map(tuple, collocations.collocations(docs, settings).collect()))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_collocations"](spark, "/root/testdata/sf0.01").collect()))
    assert got == plain([(r.text, r.lang) for r in docs.select("text", "lang").collect()])
    assert len(got) > 50 and len({row[0] for row in got}) > 1


def test_sql_agrees():
    import duckdb

    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(db.sql(SQL["op11_collocations"]).fetchall()) == plain(db.sql("SELECT text, lang FROM documents").fetchall())


def made(seed, n=400):
    """Words of a few letters, so that phrases recur, overlap and lie within each other; texts of one language and of many."""
    rng = random.Random(seed)
    words = ["a", "b", "A", "c", "é", "x\x1cy", " ", "a b", "new york city", "漢字"]
    ends = [" ", "  ", "\t", ", ", ".", "\n", " \r\n", "?! ", " - "]
    texts = ["".join(rng.choice(words) + rng.choice(ends[:1] * 12 + ends) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(text, rng.choice(["en", "en", "de", None, "und", ""])) for text in texts] + [(None, "en"), ("", None), (" \t.\n", "zz")]


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 21])
def test_blocks_of_any_size(spark, block, monkeypatch):
    rows = made(block)
    settings = Settings(least=5, block=block, top=300)
    assert found(spark.createDataFrame(rows, "text string, lang string"), settings) == plain(rows, settings)


@pytest.mark.parametrize("settings", [Settings(least=3, longest=2), Settings(least=4, longest=3, share=60), Settings(least=2, longest=5, share=90, top=20)])
def test_settings(spark, settings):
    rows = made(99, 200)
    assert found(spark.createDataFrame(rows, "text string, lang string"), settings) == plain(rows, settings)


def test_texts_that_go_on_in_the_next_block(spark, monkeypatch):
    """Texts of several slices, with words longer than a slice, are cut nowhere."""
    monkeypatch.setattr(collocations, "SLICE", 16)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bb", "c" * 40, " ", " ", ".", "\t", "\n"]) for _ in range(rng.randint(0, 120)))
        whole = [word for word in text.replace(".", "\n").replace("\t", " ").replace("\n", " \n ").split(" ") if word]
        slices = list(collocations.word_slices(text.encode(), 3))
        assert [word.decode() for words in slices for word in words if word] == whole
        assert all(sum(map(bool, words)) >= 3 for words in slices[:-1])
    text = " ".join(rng.choice("abc") for _ in range(3000))
    settings = Settings(least=20, block=100)
    # One partition and a small slice in the task itself.
    docs = spark.createDataFrame([(text, "en"), (text[:999], "en")], "text string, lang string").coalesce(1)
    assert found(docs, settings) == plain([(text, "en"), (text[:999], "en")], settings)


def test_a_long_text_spans_blocks(spark):
    """Two slices of a text whose blocks end within a sentence."""
    rng = random.Random(6)
    text = " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(600_000))
    settings = Settings(least=1000, block=50_000)
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    blocks = collocations._blocks(docs.select("lang", "text"), settings).select("block", "n").collect()
    assert len(blocks) > 1 and sum(r.n for r in blocks) == 600_000
    assert found(docs, settings) == plain([(text, "en")], settings)


def test_odd_rows(spark, odd):
    settings = Settings(least=1)
    assert found(odd, settings) == plain([(row[1], row[2]) for row in ODD], settings)
    assert found(odd.limit(0)) == []


def test_counts_beyond_64_bits(spark):
    """The score of counts whose products pass 64 bits, as the operator works it out."""
    every = [(1, "en", "x", "x", 3 * 10**12, [], [], None, None), (2, "en", "y", "y", 2 * 10**12, [], [], None, None), (3, "en", "x y", "y", 10**12, [3 * 10**12], [2 * 10**12], 1, 2)]
    schema = "gid long, lang string, phrase string, last string, a long, heads array<long>, tails array<long>, left long, right long"
    n = 10**14 + 7

    def made_up(docs, settings):
        return spark.createDataFrame(every, schema), spark.createDataFrame([("en", n)], "lang string, n long")

    kept, collocations.phrases = collocations.phrases, made_up
    try:
        (row,) = collocations.collocations(None).collect()
    finally:
        collocations.phrases = kept
    assert tuple(row) == ("en", 1, "x y", 10**12, 3 * 10**12, 2 * 10**12, n, 1000 * 10**12 * n // (6 * 10**24))


def test_parts_split_the_counting(spark, monkeypatch):
    """Many parts and blocks give the phrases of one."""
    rows = made(31)
    monkeypatch.setattr(collocations, "PART", 50)
    settings = Settings(least=5, block=60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert found(docs, settings) == plain(rows, settings)


def test_lists_do_not_travel_to_the_parts(spark):
    """What is counted by part holds names and lengths, no positions: a list of any length takes the same room."""
    short, long = (spark.createDataFrame([("one two " * n, "en")], "text string, lang string").select("lang", "text") for n in (50, 5000))
    sizes = []
    for docs in (short, long):
        blocks = collocations.materialize(collocations._blocks(docs, Settings()), "blocks")
        frequent = collocations._frequent_words(collocations._words_by_part(blocks, 4), 4, 1)
        grown = collocations._grown(blocks, frequent.where("block IS NOT NULL").select("block", "alive"), 4)
        sizes.append(grown.where("part IS NOT NULL").agg(F.sum(F.length("held"))).first()[0])
    assert abs(sizes[0] - sizes[1]) < 16


@pytest.mark.parametrize("columns", [[[], [], []], [[1, 2, 3], [9, -9, 2**31 - 1], [5, 6, 2**62]]])
def test_packed_columns_come_back(columns):
    import numpy as np

    arrays = [np.array(column, dtype=kind) for column, kind in zip(columns, (np.int32, np.int32, np.int64))]
    for rising in (0, 1, 3):
        back = collocations._unpacked(collocations._packed(*arrays, rising=rising))
        assert [(one.dtype, one.tolist()) for one in back] == [(one.dtype, one.tolist()) for one in arrays]


def test_clashing_names(spark):
    rows = [("one two. one two", "en", *("own" for _ in CLASHES))] * 60
    docs = spark.createDataFrame(rows, "text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES) + "")
    assert found(docs.withColumn("gid", F.lit("own")).withColumn("n", F.lit("own"))) == [("en", 1, "one two", 120, 120, 120, 240, 2000)]
