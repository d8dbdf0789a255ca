"""HTML tables, numbered certificates, plain text, manifests and hash chains."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import parse_cents
from .archives import archives


class _Cells(HTMLParser):
    """Rows of cell texts, white space folded to single spaces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self._row: list[str] | None = None
        self._cell: list[str] | None = None

    def _end_cell(self):
        if self._cell is not None and self._row is not None:
            self._row.append(" ".join("".join(self._cell).split()))
        self._cell = None

    def _end_row(self):
        self._end_cell()
        if self._row is not None:
            self.rows.append(self._row)
        self._row = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._end_row()
            self._row = []
        elif tag in ("td", "th"):
            self._end_cell()
            if self._row is not None:
                self._cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def table_rows(html: str | None) -> list[list[str]]:
    parser = _Cells()
    parser.feed(html or "")
    parser.close()
    parser._end_row()
    return parser.rows


def html_rows(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, row_no, cells: each table row of each page, in order. Pages without tables give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["rows"] = [[{"row_no": at, "cells": row} for at, row in enumerate(table_rows(text))] for text in frame["__html"]]
            yield frame.drop(columns="__html")

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", rows array<struct<row_no:int,cells:array<string>>>"
    cut = pages.select(*keys, F.col(html).cast("string").alias("__html")).mapInPandas(run, schema)
    return cut.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.*")


#: Marks of a dollar cell whose amount was not reported.
NOT_REPORTED = ("�", "—", "–", "-")


def numbered_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_key, label, money_cents: the rows of a numbered certificate.

    A cell ``N.`` opens a section, ``a. ...`` a line of it with the key Na; the first row of a key counts. Amounts
    are the cells after each ``$``; one that was not reported is null, one that is absent an error.
    """
    order = Window.partitionBy(*keys).orderBy("row_no")
    filled = F.filter("cells", lambda c: c != "")
    f = rows.withColumn("__filled", filled).where(F.size("__filled") > 0).withColumn("__first", F.get("__filled", F.lit(0)))
    section = F.when(F.col("__first").rlike(r"^[0-9]+\.$"), F.regexp_replace("__first", r"\.$", ""))
    f = f.withColumn("__section", F.last(section, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.col("__first").rlike(r"^[a-z]\.\s")
    key = F.when(section.isNotNull(), section).when(line & F.col("__section").isNotNull(), F.concat("__section", F.substring("__first", 1, 1)))
    f = f.withColumn("row_key", key).where(F.col("row_key").isNotNull())
    places = F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda at: F.get("cells", at) == "$")
    after = lambda at: F.get(F.filter(F.slice("cells", at + 2, F.greatest(F.size("cells") - at - 1, F.lit(0))), lambda c: c != ""), F.lit(0))

    def money(at: Column) -> Column:
        cell = after(at)
        return F.when(cell.isNull(), F.raise_error(F.concat(F.lit("no amount in row "), "row_key"))).when(cell.isin(*NOT_REPORTED), F.lit(None).cast("bigint")).otherwise(parse_cents(F.translate(cell, ",", ""), signed=True))

    f = f.withColumns({"label": F.array_join("__filled", " | "), "money_cents": F.transform(places, money)})
    first = F.min_by(F.struct("label", "money_cents"), "row_no")
    return f.groupBy(*keys, "row_key").agg(first.alias("r")).select(*keys, "row_key", "r.*")


# Certificate rows of the single amounts, and of those that add up several rows.
SIMPLE_ROWS = {
    "pool_begin": "1", "principal_collected": "2", "repurchases": "3", "defaults": "4", "pool_end": "5", "interest_collected": "17a",
    "recoveries": "77", "investment_income": "20", "available_collections": "23", "reserve_draw": "24", "servicing_fee": "26c",
    "reserve_deposit": "44d", "residual_distribution": "44e", "total_distributions": "44f", "reserve_begin": "50", "reserve_interest": "51",
    "reserve_end": "57", "gross_loss": "76", "net_loss": "78", "note_begin": "8i",
}
SUMMED_ROWS = {"trustee_fee": ("28b", "28e", "41a", "41b"), "total_note_principal": tuple("45" + c for c in "ijklmnop"), "reserve_release": ("55a", "55b", "56")}
INTEREST_ROWS, TOTAL_ROW = tuple("45" + c for c in "abcdefgh"), "45q"


def certificate_amounts(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, amounts (a map of cents), missing_interest: the 25 amounts of each certificate.

    A row that is absent or unreported is an error, but for interest of retired notes: then total interest is the
    reported total less principal.
    """
    cells = numbered.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("row_key", "money_cents"))).alias("rows"))

    def cell(key: str, at: int = 0) -> Column:
        value = F.get(F.try_element_at("rows", F.lit(key)), F.lit(at))
        return F.when(value.isNull(), F.raise_error(F.lit(f"missing certificate row {key}")).cast("bigint")).otherwise(value)

    total = lambda names: sum((cell(k) for k in names[1:]), cell(names[0]))
    unreported = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.get(F.try_element_at("rows", F.lit(k)), F.lit(0)).alias("v")) for k in INTEREST_ROWS]), lambda x: x["v"].isNull())
    interest = F.when(F.size(unreported) > 0, cell(TOTAL_ROW) - total(SUMMED_ROWS["total_note_principal"])).otherwise(total(INTEREST_ROWS))
    amounts = {name: cell(key) for name, key in SIMPLE_ROWS.items()} | {name: total(names) for name, names in SUMMED_ROWS.items()} | {"total_note_interest": interest, "note_end": cell("8i", 1)}
    pairs = [x for name, value in amounts.items() for x in (F.lit(name), value)]
    return cells.select(*keys, F.create_map(*pairs).alias("amounts"), F.transform(unreported, lambda x: x["k"]).alias("missing_interest"))


def short_date(text: Column, pattern: str) -> Column:
    """A date with a year of two digits, from 1969 to 2068."""
    day = F.to_date(text, pattern)
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def document_date(url: Column, header_date: Column) -> Column:
    """The date in an exhibit's file name (MMddyy), else the header's."""
    found = F.regexp_extract(url, r"ex991([0-9]{6})\.htm", 1)
    return F.coalesce(short_date(F.when(found != "", found), "MMddyy"), header_date)


def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if text is None else unescape(text) for text in texts.to_pylist()], pa.string())


def plain_text(html: Column) -> Column:
    """Tags out, all entities back, white space folded."""
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    # Only texts that hold an entity pay for the way through Python.
    text = F.when(bare.contains("&"), F.arrow_udf(_unescaped, "string")(bare)).otherwise(bare)
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def keyword_hits(texts: DataFrame, keys: list[str], text: str, pattern: str, context: int = 40) -> DataFrame:
    """keys, hit_no, start, match, before, after: every match, its place from 0, and the text around it.

    The text is split at its matches, so that offsets come from lengths and no Python runs. A match takes along only what
    is shown of the gaps beside it; a running sum over the lengths gives its place, so a text costs as much as it is long.
    """
    cut = texts.select(*keys, F.monotonically_increasing_id().alias("__row"), F.split(text, pattern).alias("__gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("__hits"))
    # The last gap stands behind the last match.
    gap = lambda at: F.get("__gaps", at)
    each = F.transform("__hits", lambda hit, at: F.struct(
        at.alias("hit_no"), hit.alias("match"), F.length(gap(at)).alias("gap"), F.right(gap(at), F.lit(context)).alias("before"), F.left(gap(at + 1), F.lit(context)).alias("after")))
    f = cut.select(*keys, "__row", F.explode(each).alias("h")).select(*keys, "__row", "h.*")
    so_far = Window.partitionBy("__row").orderBy("hit_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("match")).over(so_far) - F.length("match")
    return f.select(*keys, "hit_no", start.cast("int").alias("start"), "match", "before", "after")


def manifest_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sources of JSON manifests: of equal urls the first by manifest, then place; ordered by deal, period and acceptance."""
    out = None
    for number, path in enumerate(paths):
        part = spark.read.option("multiLine", True).json(path).select(F.lit(number).alias("__manifest"), F.posexplode("sources").alias("__at", "s")).select("__manifest", "__at", "s.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy("url").orderBy("__manifest", "__at")
    kept = out.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place", "__manifest", "__at")
    return kept.orderBy("deal_id", "report_period", "acceptance_time")


def zip_columns(documents: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a document that stores a table as parallel arrays."""
    return documents.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")


def select_filings(filings: DataFrame, forms: list[str], first: str, last: str, periods: int) -> DataFrame:
    """Filings of these forms in a window of dates, of the first so many report periods of each deal."""
    rank = F.dense_rank().over(Window.partitionBy("deal_id").orderBy("report_period"))
    kept = filings.where(F.col("form").isin(*forms) & F.col("filing_date").between(first, last))
    return kept.withColumn("__rank", rank).where(F.col("__rank") <= periods).drop("__rank")


def set_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: what is NEW and what is MISSING."""
    added = new.join(old, key, "left_anti").select(key, F.lit("NEW").alias("change"))
    return added.unionByName(old.join(new, key, "left_anti").select(key, F.lit("MISSING").alias("change")))


def archive_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, archived and original byte counts and SHA-256 of gzipped or plain files, each read once and in pieces."""
    return archives(spark, path)
