"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest

from quillstone.llm import chat, decontamination, linededup, packing, pii, quality, sharding, simhash, toxicity, urls

from .conftest import ODD


def bench(spark):
    return spark.createDataFrame([(1, "no id here at all"), (2, None), (None, "x"), (3, ""), (3, "?"), (4, "One line of plain words that goes on for a while, as clean prose does,")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (5, 0, 7)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "quality": lambda s, d: quality.assess(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "pii": lambda s, d: pii.find(d),
    "redacted": lambda s, d: pii.redacted(d),
    "line_report": lambda s, d: linededup.report(d),
    "line_clean": lambda s, d: linededup.clean(d, linededup.Settings(min_docs=1)),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
    "sharding": lambda s, d: sharding.shard(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, odd, name):
    out = PER_ROW[name](spark, odd).collect()
    assert len(out) == len(ODD)
    assert sorted(str(r.doc_id) for r in out) == sorted(str(row[0]) for row in ODD)
    assert PER_ROW[name](spark, odd.limit(0)).count() == 0


STAGES = {
    "quality": lambda s, d: quality.clean(d),
    "line_dedup": lambda s, d: linededup.clean(d),
    "near_dedup": lambda s, d: simhash.deduplicate(d),
    "decontaminate": lambda s, d: decontamination.decontaminate(d, bench(s)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, odd, name):
    out = STAGES[name](spark, odd)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows = out.collect()
    assert all(r.shard == "own" for r in rows)
    assert STAGES[name](spark, odd.limit(0)).count() == 0
    kept = {
        "quality": {"1": 2, "5": 0, "6": 0},  # words over and over, and a single word, are no prose
        "line_dedup": {"1": 2, "3": 1, "None": 2},
        "near_dedup": {"1": 1, "2": 1, "3": 0, "4": 0, "None": 1},  # empty texts are copies of each other
        "decontaminate": {"1": 0, "3": 1, "None": 2},
    }[name]
    ids = [str(r.doc_id) for r in rows]
    assert {k: ids.count(k) for k in kept} == kept


def test_packing_of_odd_rows(spark, odd):
    out = packing.pack(odd).collect()
    assert {r.doc_id for r in out} == {row[0] for row in ODD}
    assert [(r.length, r.doc_tokens) for r in out if r.doc_id == 2] == [(1, 1)]
    assert packing.pack(odd.limit(0)).count() == 0


def test_search_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.item_id) for r in decontamination.search(odd, bench(spark)).collect()}
    assert got == {(1, 4)}
    assert decontamination.search(odd, bench(spark).limit(0)).count() == 0 and decontamination.search(odd.limit(0), bench(spark)).count() == 0


def test_odd_urls(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "://"), (4, "http://"), (None, "x://ORG/?a"), (5, "a://b://c"), (6, "http://" + "a." * 3000 + "org/" + "p" * 5000), (7, "HTTP://Example.ORG/es/\nx"), (8, "no scheme"), (9, "http://xorg/")]
    pages = spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id long, url string, host string, rule string")
    got = [(r.page_id, r.host[:11], r.path[:8], r.rule, r.verdict) for r in urls.judge(pages).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (None, "org", "/", "org/", "allow"), (5, "b:", "//c", None, "allow"),
         (6, "a.a.a.a.a.a", "/ppppppp", "org/", "allow"), (7, "example.org", "/es/\nx", "example.org/es/", "block"), (8, "", "", None, "allow"), (9, "xorg", "/", None, "allow")], key=str)
    assert urls.judge(pages.limit(0)).count() == 0


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "nobody", "x\ny"), (None, None, None, ""), (2, 0, "assistant", "a\n" * 3000), (3, 5, "SYSTEM", "be brief\nUser: inside")]
    conv = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, block string")
    out = chat.format_chats(conv, chat.fit(conv)).collect()
    assert {r.conv_id for r in out} == {1, 2, 3, None}
    assert sum(r.n_lines for r in out if r.conv_id == 2) == 3001
    assert [r.role for r in sorted((r for r in out if r.conv_id == 3), key=lambda r: r.part)] == ["system", "user"]
    assert chat.format_chats(conv.limit(0), chat.fit(conv.limit(0))).count() == 0


OWN_NAMES = ("row", "id", "gone", "gone_id", "n_gone", "word", "bits", "of_word", "__id", "__hash", "__no_id", "__copy", "__gone", "__gone_id", "__quality", "__text", "doc", "root", "fp", "bands", "leader", "a", "b", "leaf", "line", "at", "p")


@pytest.mark.parametrize("name", STAGES)
def test_stages_bear_columns_with_the_operators_names(spark, name):
    rows = [(i, "One line of plain words that goes on for a while, as clean prose does, and that says more than twenty words in all of it.\nline") for i in (1, 2, None)]
    docs = spark.createDataFrame([(*row, *("own" for _ in OWN_NAMES)) for row in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in OWN_NAMES))
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == {"near_dedup": 1, "decontaminate": 0}.get(name, 3) and all(r[c] == "own" for r in got for c in OWN_NAMES)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from quillstone.llm import common

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    Context.master = "local[2]"
    assert common.shared_dir(Session()) == common.LOCAL_CHECKPOINTS


def test_scratch_deletes_what_was_written(spark):
    import os

    from quillstone.llm import common

    with common.scratch(spark):
        (path,) = {os.path.dirname(f) for f in common.materialize(spark.range(3), "some").inputFiles()}
        assert os.path.isdir(path.removeprefix("file:").replace("///", "/"))
    assert not os.path.exists(path.removeprefix("file:").replace("///", "/"))
