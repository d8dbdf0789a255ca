"""What the first review found left out."""

from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontamination, linededup, nearcopies


def near_pairs(texts, similarity=0.8):
    """All pairs of texts of that five-word Jaccard similarity, by an inverted list of every shingle."""
    sets = {}
    for k, text in texts.items():
        words = (text or "").encode("utf-8", "replace").lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    holders, shared = defaultdict(list), defaultdict(int)
    for k in sorted(sets):
        for x in sets[k]:
            for other in holders[x]:
                shared[other, k] += 1
            holders[x].append(k)
    return {(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)}, sets


def groups_of(ids, pairs):
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in ids}


def test_near_copies_go(spark):
    """Every group of near copies on sf0.01 keeps its smallest id alone, in the stage of the pipeline."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pairs, sets = near_pairs(texts)
    assert any(sets[a] != sets[b] for a, b in pairs)
    want = {k for k, root in groups_of(texts, pairs).items() if k == root}
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_close_over_members_no_leader_reaches(spark):
    """A chain whose ends are not near copies, and texts just below the similarity."""
    words = [f"w{i}" for i in range(400)]
    chain = {i: " ".join(words[10 * i : 10 * i + 200]) for i in range(12)}
    below = {100: " ".join(f"x{i}" for i in range(100)), 101: " ".join(f"x{i}" for i in range(14, 114))}
    df = spark.createDataFrame(list((chain | below).items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.deduplicate(df).collect()) == [0, 100, 101]


@pytest.mark.parametrize("size", [1000, 40_000])
def test_fields_stay_fields_at_every_size(spark, size):
    """20 categories by 2000 authors: each author is in some 20 of 40,000 documents, which makes no constant."""
    line = F.concat(F.lit("Posted in category "), F.translate((F.col("id") % 20).cast("string"), "0123456789", "abcdefghij"), F.lit(" by "), F.translate(F.pmod(F.xxhash64("id"), F.lit(2000)).cast("string"), "0123456789", "abcdefghij"), F.lit(" for all of our readers"))
    docs = spark.range(size).select(F.col("id").alias("doc_id"), line.alias("text"))
    left = linededup.clean(docs.withColumn("n_chars", F.lit(0).cast("long"))).where("text != ''").count()
    assert left == 20  # the first document of each category


def test_constancy_counts_distinct_documents(spark):
    """Six documents hold a word on two lines each: it is in six documents, not in twelve, and so a field."""
    texts = {i: f"see the note {chr(97 + i)}x word\nsee the note {chr(97 + i)}y word" for i in range(6)} | {10 + i: f"see the note {chr(97 + i)}z other" for i in range(3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.clean(df, linededup.Settings(min_docs=9, similarity=0.6)).collect()}
    assert got == {k: text if k == 0 else "" for k, text in texts.items()}


def test_copies_made_of_numbers_go(spark):
    """Lines of fields alone go where the fields are the same, and stay where they differ."""
    same = ["Call 555 1234 567 now", "Page 1 2 3 4 5", "2024-01-02 10:22 2024-01-03 11:00"]
    texts = {i: "\n".join([*same, f"{i}1 {i}2 {i}3 {i}4 {i}5 {i}6"]) for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.clean(df).collect()}
    assert got == {i: text if i == 0 else text.split("\n")[-1] for i, text in texts.items()}


def test_passages_without_their_first_line_are_found(spark):
    """A short first line is no question; a long question may be missing if nearly all the rest is there."""
    body = " ".join(f"w{i}" for i in range(120))
    asked = "which of these many words would a reader of this long question choose first?"
    bench = spark.createDataFrame([(1, f"A heading\n{body}"), (2, asked + " " + body.replace("w", "v")), (3, asked.replace("e", "i") + " " + " ".join(f"u{i}" for i in range(20)))], "item_id long, text string")
    texts = {1: body, 2: f"A changed heading\n{body}", 3: body.replace("w", "v"), 4: " ".join(f"u{i}" for i in range(20)), 5: " ".join(f"w{i}" for i in range(30))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.search(docs, bench).collect()} == {(1, 1), (2, 1), (3, 2)}
    assert [r.doc_id for r in decontamination.decontaminate(docs, bench).collect()] == [4, 5]


def test_a_large_group_of_edited_copies(spark):
    """400 copies of one text, each with edits of its own, about the similarity: the groups are those of all pairs."""
    import random

    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for k in range(400):
        words = list(base)
        for place in rng.sample(range(150), rng.randint(0, 9)):
            words[place] = f"e{rng.randint(0, 40)}x{place}"
        texts[k] = " ".join(words)
    pairs, _ = near_pairs(texts)
    want = {k for k, root in groups_of(texts, pairs).items() if k == root}
    got = [r.doc_id for r in nearcopies.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and 10 < len(want) < 300


@pytest.mark.parametrize("n", [500, 4000])
def test_a_core_that_many_texts_share_meets_nothing(spark, n):
    """Texts of 20 words, alike but for the first and the last, have 14 of 18 shingles in common, too few: what is joined grows with their number, not its square."""
    core = " ".join(f"w{i}" for i in range(18))
    texts = {k: f"a{k}x {core} z{k}y" for k in range(n)}
    sets = spark.createDataFrame([(k, nearcopies.shingle_set(text, 5).view("int64").tolist()) for k, text in texts.items()], "fp long, shingles array<long>")
    prefixes = nearcopies._prefixes(sets, sets.select("fp", F.col("fp").alias("root")), 0.8)
    kept, indexed = nearcopies._meeting(prefixes, 0.8)
    assert kept.count() > n and kept.join(indexed.select("token"), "token").count() <= n
    assert nearcopies._across(prefixes, 0.8).count() == 0
    if n == 500:
        docs = spark.createDataFrame([*texts.items(), (n, texts[3]), (n + 1, texts[4] + " more")], "doc_id long, text string")
        assert sorted(r.doc_id for r in nearcopies.deduplicate(docs).collect()) == list(range(n))


def test_prefixes_of_unequal_sets_still_meet(spark):
    """Sets of all sizes around the similarity, with a common core: the pairs are those of all pairs."""
    import random

    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for k in range(150):
        low, high = rng.randint(0, 9), rng.randint(48, 60)
        words = base[low:high]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 30)}"
        texts[k] = " ".join(words)
    pairs, _ = near_pairs(texts)
    sets = spark.createDataFrame([(k, nearcopies.shingle_set(text, 5).view("int64").tolist()) for k, text in texts.items()], "fp long, shingles array<long>")
    prefixes = nearcopies._prefixes(sets, sets.select("fp", F.col("fp").alias("root")), 0.8)
    found = nearcopies._similar(nearcopies._across(prefixes, 0.8), sets, 0.8)
    assert {(r.a, r.b) for r in found.collect()} == pairs and len(pairs) > 100


@pytest.fixture
def many_ranges(spark):
    """Small tables are dealt to as many tasks as large ones."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_rows_of_one_conversation_spread(spark, many_ranges):
    """Every row under a null id, with turn numbers that repeat: bounded blocks in many ranges, and the roles of a conversation that has an id."""
    from quillstone.llm import chat

    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").withColumn("turn", F.col("turn") % 7)
    nulls, named = conv.withColumn("conv_id", F.lit(None).cast("long")), conv.withColumn("conv_id", F.lit(5).cast("long"))
    source = nulls.select("conv_id", "turn", "text", chat.given_role().alias("given"))
    cut = chat.lines(source, 16, "given")
    blocks = cut.where("at = 0").groupBy("conv_id", "block").count().collect()
    assert len(blocks) > 4 and max(r["count"] for r in blocks) <= 16 and len({r.block >> chat.BLOCK_BITS for r in blocks}) > 1
    settings = chat.Settings(block=16)
    read = lambda c: sorted(tuple(r)[1:] for r in chat.recover(c, settings).drop("held_out").collect())
    model = chat.fit(conv)
    whole = lambda c, s: sorted((r.turn, r.part, r.role, r.n_lines, r.rendered) for r in chat.format_chats(c, model, s, marked=False).collect())
    assert whole(nulls, settings) == whole(named, chat.Settings(block=100_000)) and len(whole(nulls, settings)) >= conv.count()
    assert len(read(named)) >= conv.count()


def test_what_a_turn_follows_crosses_ranges(spark, many_ranges):
    """before and first of every turn, against a window over the conversation."""
    from pyspark.sql import Window

    from quillstone.llm import chat

    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    source = conv.withColumn("conv_id", F.when(F.col("conv_id") % 3 > 0, F.col("conv_id") % 5)).select("conv_id", "turn", "text", chat.given_role().alias("given"))
    turns = chat.materialize(chat.lines(source, 8, "given").where("at = 0"), "turns")
    order = Window.partitionBy("conv_id").orderBy("turn", "tie", "copy")
    want = turns.select("given", F.lag("given").over(order).alias("before"), (F.row_number().over(order) == 1).alias("first"))
    count = lambda df: {(r.given, r.before, r.first): r["count"] for r in df.groupBy("given", "before", "first").count().collect()}
    assert count(chat._followed(turns)) == count(want)


def test_links_broadcast_no_anchors(spark):
    """A small table of fingerprints has many anchors, and the rounds of components many edges: neither is sent to the driver."""
    from pyspark.sql import DataFrame

    from quillstone.llm import components, simhash

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    fps = spark.createDataFrame([(i,) for i in (0, 1, 3, 255)], "fp long")
    found = simhash.links(fps)
    assert "BroadcastHashJoin" not in plan(found) and sorted(map(tuple, found.collect())) == [(0, 1), (0, 3), (1, 3)]
    plans, held = [], components.materialize
    components.materialize = lambda df, name: plans.append(plan(df)) or held(df, name)
    try:
        assert isinstance(components.connected_components(found, "a", "b"), DataFrame)
    finally:
        components.materialize = held
    assert len(plans) > 1 and not any("BroadcastHashJoin" in p for p in plans)


def test_near_copies_meet_by_simhash(spark):
    """Two similar texts whose minima share no band, but whose SimHashes differ in at most two bits."""
    one = lambda text: int(nearcopies.shingle_set(text, 5)[0])
    first = min((f"a{i} b c d e" for i in range(20_000)), key=lambda text: one(text).bit_count())
    bands = lambda text: set(nearcopies.band_keys(nearcopies.shingle_set(text, 5)))
    apart = lambda word: (one(first) & ~one(f"b c d e {word}")).bit_count()
    second = next(f"{first} f{i}" for i in range(100_000) if apart(f"f{i}") <= 2 and not bands(first) & bands(f"{first} f{i}"))
    df = spark.createDataFrame([(1, first), (2, second), (3, "something else that is no copy"), (4, None), (5, "")], "doc_id long, text string")
    got = lambda **k: sorted(r.doc_id for r in nearcopies.deduplicate(df, **k).collect())
    assert got(similarity=0.5) == [1, 3, 4]
    assert got(similarity=0.8) == [1, 2, 3, 4]  # linked, but verified
