"""Line dedup by a log-template tree: lines of one shape that recur across documents go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, materialize, table, unboxed

#: Stands for a variable field.
FIELD = "<*>"


@dataclass(frozen=True)
class Settings:
    """depth: leading tokens that lead to a leaf, below the token count; min_docs:
    documents in which a template recurs to be dropped; similarity: share of a
    template's tokens that are constant at least; keep_first: whether the document
    with the smallest doc_id keeps its lines; common: share of a leaf's documents that
    hold a token, below which it is a field in the templates of large leaves; passage_words: tokens of
    a line from which it is a passage, which recurs if two documents hold it.
    """

    depth: int = 3
    min_docs: int = 10
    similarity: float = 0.7
    keep_first: bool = True
    common: float = 0.01
    passage_words: int = 50


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, at, line: the lines of each text with their place from 0, trimmed; null text has none."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("at", "line"))
    return cut.select("doc_id", "at", F.btrim("line", F.lit(" \t\r\x0b\f")).alias("line"))


def tokens_of(line: Column) -> Column:
    """Tokens between single spaces; any that holds a digit counts as a variable field."""
    return F.transform(F.split(line, " "), lambda word: F.when(word.rlike("[0-9]"), F.lit(FIELD)).otherwise(word))


def leaf_of(line: Column, depth: int) -> Column:
    """The leaf that a line falls to: token count, then its leading tokens. Null for blank lines.

    Made of byte counts and a prefix, so that long lines are not cut into tokens for it.
    """
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    leading = F.substring_index(line, " ", depth)
    masked = F.when(leading.rlike("[0-9]"), F.regexp_replace(leading, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(leading)
    return F.when(line != "", F.xxhash64(spaces, masked))


def _templates(pairs: DataFrame, shapes: DataFrame, least: DataFrame, settings: Settings) -> DataFrame:
    """(key, template) of the shapes that keep enough constant tokens, in the leaves that ``least`` lists.

    ``pairs`` has leaf, key, doc_id, each once; ``shapes`` has leaf, key, shape, docs; a token is
    constant if ``least`` distinct documents of the leaf hold it at its place.
    """
    place = F.posexplode(F.split("shape", " ")).alias("place", "token")
    placed = shapes.join(least, "leaf").select("leaf", "key", "docs", "least", place)
    # A document with several shapes in a leaf has been counted once for each.
    several = pairs.join(least, "leaf").groupBy("leaf", "doc_id").agg(F.collect_list("key").alias("keys")).where(F.size("keys") > 1)
    again = several.select("leaf", "doc_id", F.explode("keys").alias("key")).join(shapes.select("key", "shape"), "key").select("leaf", "doc_id", place)
    extra = again.groupBy("leaf", "place", "token", "doc_id").agg((1 - F.count("*")).alias("docs")).where("docs < 0")
    counted = placed.select("leaf", "place", "token", "docs").unionByName(extra.select("leaf", "place", "token", "docs"))
    constant = counted.where(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs")).join(least, "leaf").where("docs >= least")
    held = placed.select("leaf", "key", "place", "token").join(constant.select("leaf", "place", "token", F.lit(True).alias("constant")), ["leaf", "place", "token"], "left")
    template = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(F.lit(FIELD)).alias("token")))), lambda x: x["token"]), " ")
    share = F.count("constant") / F.count("*")
    return held.groupBy("leaf", "key").agg(template.alias("template"), share.alias("share")).where(F.col("share") >= settings.similarity).select("key", "template")


def dropped_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, at, template) of the lines that go; ``at`` counts a text's lines from 0.

    1. Documents are counted by leaf. A leaf that fewer than min_docs
       documents reach can hold no recurring template, so its lines go no further:
       of most text, only an integer and the id of each line are shuffled.
    2. In the leaves that are left, a token is constant at its position if min_docs
       distinct documents have it there; other positions become variable fields. A
       line that keeps at least ``similarity`` of its tokens has a template. In a leaf so
       large that the values of a field pass min_docs too, lines have a second template, whose
       constants are held by the share ``common`` of the leaf's documents.
    3. Templates that min_docs documents share are dropped.
    4. Lines whose masked shape has no template, for it has too many fields, but which min_docs
       documents hold are judged once more among the lines of that shape, with
       digits unmasked: a field that is the same in min_docs documents counts as constant.
    """
    lines = lines_of(docs).withColumn("leaf", leaf_of(F.col("line"), settings.depth)).where(F.col("line") != "")
    # Pairs of one document meet in its task, before the exchange.
    own = lines.select("leaf", "doc_id").distinct()
    leaves = materialize(own.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= settings.min_docs), "leaves")

    # A line's masked tokens, as one string: its shape.
    shaped = lines.join(leaves.select("leaf"), "leaf").select("doc_id", "at", "leaf", F.array_join(tokens_of(F.col("line")), " ").alias("shape"), "line")
    shaped = materialize(shaped.withColumn("key", F.xxhash64("leaf", "shape")), "shapes")

    # Copies of a line fold into one shape with its documents, before any token is looked at.
    pairs = shaped.select("leaf", "key", "doc_id").distinct()
    shapes = materialize(shaped.select("leaf", "key", "shape", "doc_id").distinct().groupBy("leaf", "key", "shape").agg(F.count("*").alias("docs")), "folded")
    every = leaves.select("leaf", F.lit(settings.min_docs).cast("double").alias("least"))
    large = leaves.select("leaf", (F.col("n") * settings.common).alias("least")).where(F.col("least") > settings.min_docs)
    named = _templates(pairs, shapes, every, settings)
    if not large.isEmpty():
        named = named.unionByName(_templates(pairs, shapes, large, settings)).distinct()
    named = materialize(named, "templates")

    matched = shaped.select("doc_id", "at", "key").join(named, "key").select("doc_id", "at", "template")
    masked = shapes.where(F.col("docs") >= settings.min_docs).join(named, "key", "left_anti").select(F.col("key").alias("leaf"))
    raw = shaped.select("doc_id", "at", "key", "line").withColumnRenamed("key", "leaf").join(masked, "leaf").withColumn("key", F.xxhash64("leaf", "line"))
    raw = materialize(raw.withColumnRenamed("line", "shape"), "raw")
    copies = raw.select("leaf", "key", "doc_id").distinct()
    folded = materialize(raw.select("leaf", "key", "shape", "doc_id").distinct().groupBy("leaf", "key", "shape").agg(F.count("*").alias("docs")), "folded")
    unmasked = _templates(copies, folded, masked.withColumn("least", F.lit(settings.min_docs).cast("double")), settings)
    matched = matched.unionByName(raw.select("doc_id", "at", "key").join(unmasked, "key").select("doc_id", "at", "template"))
    matched = materialize(matched, "matched")
    recurring = matched.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id")).where(F.col("docs") >= settings.min_docs)
    recurring = materialize(recurring, "recurring")
    gone = matched.join(recurring, "template")
    if settings.keep_first:
        gone = gone.where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    return gone.select("doc_id", "at", "template")


def repeated_passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, at, is_first) of the lines of at least ``passage_words`` tokens whose masked shape two documents or more hold.

    So long a line is its own template: at no other place does chance bring it forth, so it needs no leaf. Lines meet by the hash of
    their shape and its length; each task folds its lines to one row a shape before the exchange.
    """
    long = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) >= settings.passage_words - 1
    shape = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", "[^ ]*[0-9][^ ]*", FIELD)).otherwise(F.col("line"))
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    keyed = materialize(lines_of(docs).where(long).select("doc_id", "at", F.xxhash64(shape).alias("key"), F.octet_length(shape).alias("size")), "passages")
    recurring = keyed.groupBy("key", "size").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low != high")
    # Written, so that both sides of the join are exchanges that Spark can split at a line which many documents hold.
    recurring = materialize(recurring, "recurring_passages")
    return keyed.join(recurring, ["key", "size"]).select("doc_id", "at", (who == F.col("low")).alias("is_first"))


def _drop(docs: DataFrame, settings: Settings, passages: bool) -> DataFrame:
    """row, all columns of docs; gone, the lines that go as bits of longs, or null; and how many they are; the same of repeated passages."""
    marked = dropped_lines(docs, settings).select("doc_id", "at", F.lit(True).alias("gone"), F.lit(False).alias("passage"), F.lit(False).alias("extra"))
    if passages:
        found = repeated_passages(docs, settings).select("doc_id", "at", F.lit(False), F.lit(True), ~F.col("is_first") if settings.keep_first else F.lit(True))
        marked = marked.union(found)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63))
    bits = lambda c: F.coalesce(F.bit_or(F.when(F.col(c), bit)), F.lit(0).cast("long"))
    words = marked.groupBy("doc_id", F.shiftright("at", 6).alias("word")).agg(bits("gone").alias("gone"), bits("passage").alias("passage"), bits("extra").alias("extra"))
    held = words.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.struct("gone", "extra")))).alias("of_word"), F.max("word").alias("top"),
        F.sum(F.bit_count("gone")).alias("n_gone"), F.sum(F.bit_count("passage")).alias("n_passages"), F.sum(F.bit_count("extra")).alias("n_extra"),
    )
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.col("top")), lambda word: F.coalesce(F.col("of_word")[word][c], F.lit(0).cast("long")))
    counts = ["n_gone", "n_passages", "n_extra"]
    gone = materialize(held.select(F.col("doc_id").alias("gone_id"), dense("gone").alias("gone"), dense("extra").alias("extra"), *counts), "gone")
    # The places grow with the input, so they are not broadcast, however few a small input has. A hash of one
    # partition's places spares a sort of whole texts.
    rows = boxed(docs).withColumn("id", F.col("row")["doc_id"])
    found = rows.where("id IS NOT NULL").join(gone.hint("shuffle_hash"), F.col("id") == F.col("gone_id"), "left").select("row", "gone", "extra", *counts)
    # Rows with a null id lose no line; they need no partner, so they are not gathered in one task to seek one.
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in found.dtypes if name != "row"]
    return found.unionByName(rows.where("id IS NULL").select("row", *nothing))


def _left(text: Column, *marks: str) -> Column:
    """The text without the lines that the bits in ``marks`` mark, in time linear in its lines."""

    def kept(at: Column) -> Column:
        out = F.lit(True)
        for mark in marks:
            out = out & (F.coalesce(F.getbit(F.get(mark, F.shiftright(at, 6)), at.bitwiseAND(63)), F.lit(0)) == 0)
        return out

    lines = F.filter(F.split(text, "\n"), lambda line, at: kept(at))
    return F.when(F.col("gone").isNull(), text).otherwise(F.array_join(lines, "\n"))


def clean(docs: DataFrame, settings: Settings = Settings(), *, passages: bool = False) -> DataFrame:
    """``docs`` without its recurring lines, and where asked without repeated ``passages``; all columns stay, n_chars is counted anew.

    A document that has lost every line stays with an empty text. Null text stays null. Rows that
    share a doc_id count as one document and lose the lines that any of them loses at
    that place; rows with a null id count as one document and lose none. An empty table gives no rows.
    Columns of any other name are carried along.
    """
    text = _left(F.col("row")["text"], "gone", *["extra"] * passages)
    return unboxed(_drop(docs, settings, passages), docs.columns, text=text, n_chars=F.length(text).cast("long"))


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, for every document. See ``clean`` for special cases.

    n_passages counts the document's lines of ``passage_words`` or more that another document holds too, the first
    document's own included; text_without_passages is the text that is left once these go as well from all but the first document, null where none goes.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    text = F.col("row")["text"]
    return _drop(slim, settings, True).select(
        F.col("row")["doc_id"].alias("doc_id"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_dropped"),
        _left(text, "gone").alias("text"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.when(F.col("n_extra") > 0, _left(text, "gone", "extra")).alias("text_without_passages"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
