"""Servicer certificates: the rows of their HTML tables, and all that a certificate states."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.waterfall import NOTES
from .documents import INTEREST_ROWS, certificate_amounts, document_date, numbered_rows, short_date, table_rows

# The rows of the notes' balances and principal, by note; of the principal that priorities name; of cash beside the 25 amounts; of the index rate and of the count of loans; the header's labels.
BALANCE_ROWS = tuple("8" + c for c in "abcdefgh")
PRINCIPAL_ROWS = tuple("45" + c for c in "ijklmnop")
EXPECTED_ROWS = {"priority_principal": "30", "secondary_principal": "32", "tertiary_principal": "34", "quaternary_principal": "36", "regular_principal": "39", "reported_oc_target": "10"}
CASH_ROWS = {"finance_charge_repurchases": "17c", "advances": "21", "unreimbursed_advances": "27", "finance_charge_liquidation_receipts": "17b", "principal_liquidation_receipts": "18b"}
RATE_ROW, COUNT_ROW = "16.", "6."
HEADERS = ("Collection Period", "Determination Date", "Distribution Date")


@udtf(returnType="row_no int, cells array<string>")
class HtmlRows:
    """The table rows of a page, in order; white space in a cell folded. Null has none."""

    def eval(self, html: str) -> Iterator[tuple[int, list[str]]]:
        yield from enumerate(table_rows(html))


def html_rows(pages: DataFrame, html: str) -> DataFrame:
    """``pages`` without ``html``, row_no, cells: each table row of each page, by a lateral join with a table function. Pages without tables give none."""
    return pages.lateralJoin(HtmlRows(F.col(html).outer())).drop(html)


def _stated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, header (a map), reported_distribution, floating_note_rate, outstanding_loan_count: what stands outside the numbered amounts."""
    first_cell = F.get("cells", F.lit(0))
    rest = F.get(F.filter(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: c != ""), F.lit(0))
    headers = {label: F.when(first_cell == label, F.struct("row_no", rest.alias("value"))) for label in HEADERS}
    numeric = F.filter(F.transform("cells", lambda c: F.translate(c, ",", "")), lambda c: c.rlike(r"^[0-9]+(?:\.[0-9]+)?$"))
    counts = F.filter("cells", lambda c: c.rlike(r"^[0-9,]+$"))
    last = lambda found: F.get(found, F.size(found) - 1)
    at = lambda label, value: F.min(F.when(first_cell == label, F.struct("row_no", value.alias("value"))))["value"]
    f = rows.groupBy(*keys).agg(
        *[F.max(one)["value"].alias(f"__{n}") for n, one in enumerate(headers.values())],  # of equal labels the last row counts
        at("Distribution Date", rest).alias("__paid"), at(RATE_ROW, last(numeric)).alias("__rate"), at(COUNT_ROW, last(counts)).alias("__count"),
    )
    header = F.map_filter(F.create_map(*[x for n, label in enumerate(HEADERS) for x in (F.lit(label), F.col(f"__{n}"))]), lambda _, v: v.isNotNull())
    return f.select(
        *keys, header.alias("header"), F.to_date("__paid", "MM/dd/yyyy").alias("reported_distribution_date"),
        (F.col("__rate").cast("decimal(20,8)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,10)").alias("floating_note_rate"),
        F.translate("__count", ",", "").cast("bigint").alias("outstanding_loan_count"),
    )


def certificates(pages: DataFrame, html: str = "html") -> DataFrame:
    """All that each certificate states, in cents: one row for each of ``pages`` (deal_id, accession, report_period, url, ``html``).

    amounts, the 25; note_begin, note_end, interest and principal by note (a note whose interest was not reported has none); expected, the principal by
    priority; additional_cash; header, floating_note_rate, outstanding_loan_count; missing_interest, the notes without; exceptions, where the header
    differs from the filing: the exhibit's name gives the payment date, the filing the period. A row that is not there, a date or
    a count that cannot be read is an error. Every other column of ``pages`` is carried along. (deal_id, accession) names a certificate.
    """
    keys = ["deal_id", "accession"]
    rows = html_rows(pages.select(*keys, html), html)
    numbered = numbered_rows(rows, keys)
    cells = numbered.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("row_key", "money_cents"))).alias("__rows"))

    def cell(key: str, at: int = 0) -> Column:
        value = F.get(F.try_element_at("__rows", F.lit(key)), F.lit(at))
        return F.when(value.isNull(), F.raise_error(F.lit(f"missing certificate row {key}")).cast("bigint")).otherwise(value)

    def named(names, keys_of, at: int = 0) -> Column:
        return F.create_map(*[x for name, key in zip(names, keys_of) for x in (F.lit(name), cell(key, at))])

    interest = F.create_map(*[x for note, key in zip(NOTES, INTEREST_ROWS) for x in (F.lit(note), F.get(F.try_element_at("__rows", F.lit(key)), F.lit(0)))])
    facts = cells.select(
        *keys, named(NOTES, BALANCE_ROWS).alias("note_begin"), named(NOTES, BALANCE_ROWS, 1).alias("note_end"), F.map_filter(interest, lambda _, v: v.isNotNull()).alias("interest"),
        named(NOTES, PRINCIPAL_ROWS).alias("principal"), named(EXPECTED_ROWS, EXPECTED_ROWS.values()).alias("expected"), named(CASH_ROWS, CASH_ROWS.values()).alias("additional_cash"),
    )
    amounts = certificate_amounts(numbered, keys).drop("missing_interest")
    f = pages.drop(html).join(_stated(rows, keys), keys, "left").join(amounts, keys, "left").join(facts, keys, "left")

    period = F.col("report_period").cast("date")
    start = F.trunc(period, "month").cast("date")
    paid = document_date(F.col("url"), F.col("reported_distribution_date"))
    stated = F.split(F.element_at("header", F.lit("Collection Period")), "-")
    other_period = (short_date(F.trim(F.get(stated, F.lit(0))), "MM/dd/yy") != start) | (short_date(F.trim(F.get(stated, F.lit(1))), "MM/dd/yy") != period)
    exceptions = F.array_compact(F.array(
        F.when(paid != F.col("reported_distribution_date"), F.concat(F.lit("header pays on "), F.col("reported_distribution_date").cast("string"), F.lit(", exhibit on "), paid.cast("string"))),
        F.when(other_period, F.concat(F.lit("header covers "), F.element_at("header", F.lit("Collection Period")), F.lit(", filing ends "), period.cast("string"))),
    ))
    whole = lambda column, what: F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit(f"no {what} in certificate "), "accession"))).otherwise(F.col(column))
    absent = F.filter(F.array(*map(F.lit, NOTES)), lambda note: ~F.map_contains_key("interest", note))
    return f.withColumns({
        "reported_distribution_date": whole("reported_distribution_date", "distribution date"), "outstanding_loan_count": whole("outstanding_loan_count", "count of loans"), "amounts": whole("amounts", "amounts"),
        "collection_period_start": start, "collection_period_end": period, "distribution_date": paid, "missing_interest": absent, "exceptions": exceptions,
    })
