"""The whole pipeline against a plain version of every stage, on a whole table with odd rows added."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest

from quillstone.llm import quality

from .conftest import ODD
from .test_brute import plain_leaks, plain_line_dedup
from .test_whole import groups_of, near_pairs


def plain_stages(docs, items):
    """(doc_id, text) rows after each stage but the last; ids differ."""
    out = {}
    out["quality_rules"] = {k: j["clean_text"] for k, text in docs.items() for j in [quality.judge(text, quality.Rules())] if j["kept"]}
    out["line_dedup"] = plain_line_dedup(out["quality_rules"])
    pairs, sets = near_pairs(out["line_dedup"])
    empty = sorted(k for k, held in sets.items() if not held)
    pairs |= {(empty[0], k) for k in empty[1:]}
    out["near_dedup"] = {k: out["line_dedup"][k] for k, root in groups_of(out["line_dedup"], pairs).items() if k == root}
    leaks = {d for d, _ in plain_leaks(out["near_dedup"], items)}
    out["decontaminate"] = {k: text for k, text in out["near_dedup"].items() if k not in leaks}
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The tables of sf0.001 with odd rows and clashing columns, in a folder of their own."""
    top = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6 + at, row[1], *row[2:]) for at, row in enumerate(ODD)], docs.schema)
    whole = docs.unionByName(odd).selectExpr("*", "'own' AS row", "'own' AS gone", "'own' AS __id")
    whole.write.parquet(f"{top}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_every_stage_and_the_packed_rows(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()}
    want = plain_stages({r.doc_id: r.text for r in docs.collect()}, items)
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, corpus)
        assert held.columns == docs.columns
        got = held.collect()
        assert {r.doc_id: r.text for r in got} == want[name] and len(got) == len(want[name]), name
        assert all((r.row, r.gone, r["__id"]) == ("own",) * 3 for r in got)
        if name in ("quality_rules", "line_dedup"):
            assert all(r.n_chars == len(r.text) for r in got)
        held = spark.createDataFrame(got, docs.schema)
    sizes = [len(want[name]) for name, _ in corpus_pipeline.STAGES[:-1]]
    assert len(docs.collect()) > sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, corpus).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want["decontaminate"])
    for k, text in want["decontaminate"].items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_null_ids_repeats_and_an_empty_table(spark, odd, tmp_path):
    """Odd rows as they are, with null and repeated ids, and none at all."""
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, name in ((odd, "odd"), (odd.limit(0), "none")):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert [r.doc_id for r in got if r.start == 0].count(1) == 1 and all(r.doc_id == 1 for r in got)
