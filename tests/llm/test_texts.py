"""Fill-in-middle and byte-level BPE against plain versions, on whole tables and on odd rows."""

import base64
import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe, fim
from quillstone.llm.queries import QUERIES

from .conftest import CLASHES, ODD

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 12


def plain_cut(text, doc_id):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(digits[at : at + 8], 16) for at in (0, 8, 16, 24))
    n = len(lines)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_every_document_is_cut_and_restored(spark, texts):
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, SF).collect()}
    want = {}
    for doc_id, text in texts.items():
        *rest, output = plain_cut(text or "", doc_id)
        want[doc_id] = (doc_id, *rest, sha(output), sha(text or ""))
    assert got == want
    assert {"psm", "spm"} <= {row[2] for row in got.values()}


def test_odd_texts_are_cut_and_restored(spark, odd):
    marks = [(20, "a <P> b"), (21, "<S>"), (22, "x<M>\ny"), (23, "<\n<P\n<<\nS>\nM>\n>"), (24, "\n"), (25, "\n\n\n"), (26, "a\r\nb\r\nc"), (27, "😀\n漢 字\n")]
    docs = odd.select("doc_id", "text", "size", "row").unionByName(spark.createDataFrame([(*m, "own", "own") for m in marks], "doc_id long, text string, size string, row string"))
    cut = fim.fill_in_middle(docs).withColumn("back", fim.restored("output", "form"))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in cut.collect()), key=str)
    rows = [row[:2] for row in ODD] + marks
    assert got == sorted(((doc_id, *plain_cut(text or "", doc_id), text or "") for doc_id, text in rows), key=str)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_units_and_marks(spark, unit):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab \n\t[<|é") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    settings = fim.Settings(unit=unit, rate=70, spm=30, seed=11, prefix="[pre]", suffix="<|suf|>", middle="[mid]")
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), settings).withColumn("back", fim.restored("output", "form", settings)).collect()
    units = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \n\t]*[^ \n\t]+[ \n\t]*|[ \n\t]+", "char": r"(?s)."}
    forms = []
    for r in out:
        text = dict(rows)[r.doc_id]
        assert r.back == text
        if unit != "word":
            assert r.n == len(re.findall(units[unit], text))
        ends = {0, *(m.end() for m in re.finditer(units[unit], text))}
        if r.form != "plain":
            assert unit == "word" or {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends
        forms.append(r.form)
    assert 150 < len(forms) - forms.count("plain") < 260 and 20 < forms.count("spm") < forms.count("psm")


def test_word_ends():
    ends = lambda text: fim.unit_ends(fim.np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), "word").tolist()
    assert ends("one  two\nthree") == [5, 9, 14] and ends(" one ") == [1, 5] and ends("") == [] and ends("  ") == [2]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aba", "x", "y"), ("a", "xay", "z")])
def test_marks_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Settings(prefix=marks[0], suffix=marks[1], middle=marks[2])


# ---- 13


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_document_is_encoded_and_decoded(spark, texts, library):
    want = {}
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text or "")
        want[doc_id] = (doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or ""))
    assert {r.doc_id: tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SF).collect()} == want


HARD = [
    (1, None), (2, ""), (3, "x" * 5000), (3, "it's we'll I'D'' 's 'll'll  \n\n a \r\n b" * 200), (None, "漢字 ひら 한글。" * 700), (None, None), (5, " " * 4000 + "x"), (6, "a " * 3000), (7, "'" * 3000 + "s"),
    (8, "1234567890" * 300), (9, "!a'll" * 900), (10, "\x1c\x1d a  b" * 300), (11, "一二三1½Ⅷ" * 400), (12, "<|endoftext|> " * 300), (13, "՘a\U0001e6c0 1՘" * 400), (14, "á‍😀👩‍👧 " * 300),
]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 8), (37, 36), (1000, 100), (1 << 15, 1 << 9)])
def test_chunks_of_any_size_give_the_ids_of_the_whole(spark, library, chunk, overlap):
    docs = spark.createDataFrame([(*row, *("own" for _ in CLASHES)) for row in HARD], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    got = sorted(((r.doc_id, list(r.ids), bytes(r.bytes).decode()) for r in bpe.encode(docs, chunk=chunk, overlap=overlap).withColumn("bytes", bpe.decoded("ids")).collect()), key=str)
    assert got == sorted(((doc_id, library.encode_ordinary(text or ""), text or "") for doc_id, text in HARD), key=str)
    assert bpe.encode(docs.limit(0), chunk=chunk, overlap=overlap).count() == 0


def test_chunks_of_any_code_points(spark, library):
    rng = random.Random(1)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(rng.choice(points) + rng.choice(["", "a", "1", " ", "'s", "! ", "\n ", "'"]) for _ in range(30_000))
    (row,) = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), chunk=100, overlap=30).collect()
    assert list(row.ids) == library.encode_ordinary(text)


def test_chunks_meet_and_few_are_joined(spark):
    """Prose is cut at nearly every chunk; an endless word is one segment."""
    texts = spark.createDataFrame([(1, "some words, and others. " * 1000), (2, "x" * 24_000)], "doc_id long, text string")
    chunks = bpe.materialize(bpe._chunks(texts, 1000, 100), "chunks")
    n = {r.doc_id: r["count"] for r in bpe._stitched(chunks, "byte_bpe_multi_50k.tiktoken", 1000, 100).groupBy("doc_id").count().collect()}
    assert n == {1: 24, 2: 1}


def test_endless_white_space_is_encoded(spark):
    text = " " * 1_500_000 + "x"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("ids").alias("n"), bpe.decoded("ids").alias("bytes")).first()
    assert bytes(row.bytes).decode() == text


def test_an_overlap_that_cannot_stitch_is_refused(spark):
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "x")], "doc_id long, text string"), chunk=100, overlap=100)


def test_ids_leave_a_worker_in_slices(library):
    """However many texts come in one batch, the ids and bytes of few of them are held at once."""
    texts = ["one of many texts " * 1500 + str(n) for n in range(100)] + ["", "漢字", "x"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([*range(102), None], pa.int64()), "text": texts})
    slices = list(bpe._slices(iter([batch, batch.slice(0, 0)]), "byte_bpe_multi_50k.tiktoken", True))
    assert len(slices) == 3 and max(sum(map(len, each["decoded"].to_pylist())) for each in slices) < bpe.SLICE + 30_000
    got = pa.Table.from_batches(slices)
    assert got["doc_id"].to_pylist() == batch["doc_id"].to_pylist()
    assert got["ids"].to_pylist() == [library.encode_ordinary(text) for text in texts]
    assert [each.decode() for each in got["decoded"].to_pylist()] == texts


def test_no_task_of_the_query_needs_two_workers(spark):
    def most(node, above=0):
        """Python workers on one way through a stage."""
        name, children = node.nodeName(), node.children()
        here = 0 if "Exchange" in name else above + ("Python" in name or "InArrow" in name)
        return max([here, *(most(children.apply(n), here) for n in range(children.size()))])

    assert most(QUERIES["op13_byte_bpe"](spark, SF)._jdf.queryExecution().executedPlan().executedPlan()) == 1


def test_ids_of_null_have_no_bytes(spark):
    rows = spark.createDataFrame([(1, [72, 105]), (2, None), (3, []), (4, [33])], "n int, ids array<int>").coalesce(1)
    tokens = bpe.byte_bpe("byte_bpe_multi_50k.tiktoken")._bytes.to_pylist()
    got = {r.n: r.bytes if r.bytes is None else bytes(r.bytes) for r in rows.select("n", bpe.decoded("ids").alias("bytes")).collect()}
    assert got == {1: tokens[72] + tokens[105], 2: None, 3: b"", 4: tokens[33]}
