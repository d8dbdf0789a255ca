"""Exact-cent identities of certificates, from a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import is_full_month
from ..functions.money import WIDE, parse_cents

# Identity, signed operands, reported field.
RULES = (
    ("pool_rollforward", "+pool_begin -principal_collected -defaults -repurchases", "pool_end"),
    ("collections_total", "+interest_collected +principal_collected +recoveries +investment_income +repurchases", "available_collections"),
    ("collections_to_distributions", "+available_collections +reserve_draw", "total_distributions"),
    ("distribution_components", "+servicing_fee +trustee_fee +total_note_interest +total_note_principal +reserve_deposit +residual_distribution", "total_distributions"),
    ("note_rollforward", "+note_begin -total_note_principal", "note_end"),
    ("reserve_rollforward", "+reserve_begin +reserve_interest +reserve_deposit -reserve_draw -reserve_release", "reserve_end"),
    ("net_loss", "+gross_loss -recoveries", "net_loss"),
)


def known_fields(rules=RULES) -> set[str]:
    return {term[1:] for _, terms, _ in rules for term in terms.split()} | {reported for _, _, reported in rules}


def parse_amounts(amounts: Column, rules=RULES) -> Column:
    """A map of dollar texts to one of exact cents. Unknown names, explicit nulls and malformed amounts are errors."""
    allowed = F.array(*[F.lit(x) for x in sorted(known_fields(rules))])
    unknown = F.array_except(F.map_keys(amounts), allowed)
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown amount: "), F.array_join(unknown, ", ")))).otherwise(amounts)
    cents = lambda name, text: F.when(text.isNull(), F.raise_error(F.concat(F.lit("amount is null: "), name))).otherwise(parse_cents(text, wide=True))
    return F.transform_values(checked, cents)


def reconcile(certificates: DataFrame, keys: list[str], amounts: str = "amounts", rules=RULES) -> DataFrame:
    """keys, check_id, computed_cents, reported_cents, residual_cents, status for every certificate and rule.

    ``amounts`` is a map of exact cents. All rules are worked out within the certificate's own row, without an
    exchange; a missing operand or reported amount makes the check SKIPPED, else a residual of zero is PASS.
    """

    def amount(name: str) -> Column:
        return F.try_element_at(F.col(amounts), F.lit(name)).cast(WIDE)

    def check(check_id: str, terms: str, reported: str) -> Column:
        computed = F.lit(0).cast(WIDE)
        for term in terms.split():
            value = amount(term[1:])
            computed = (computed + value if term[0] == "+" else computed - value).cast(WIDE)  # null as soon as one is
        return F.struct(F.lit(check_id).alias("check_id"), computed.alias("computed_cents"), amount(reported).alias("reported_cents"))

    checks = certificates.select(*keys, F.explode(F.array(*[check(*rule) for rule in rules])).alias("c")).select(*keys, "c.*")
    residual = (F.col("computed_cents") - F.col("reported_cents")).cast(WIDE)
    status = F.when(residual.isNull(), "SKIPPED").when(residual == 0, "PASS").otherwise("FAIL")
    return checks.select("*", residual.alias("residual_cents"), status.alias("status"))


def summarize(checks: DataFrame, keys: list[str]) -> DataFrame:
    """passed, failed, skipped and the status that dominates: FAIL, then INCOMPLETE, then PASS."""
    n = lambda s: F.count_if(F.col("status") == s)
    status = F.when(n("FAIL") > 0, "FAIL").when((n("SKIPPED") > 0) | (F.count("*") == 0), "INCOMPLETE").otherwise("PASS")
    return checks.groupBy(*keys).agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIPPED").alias("skipped"), status.alias("status"))


def gate_counts(checks: DataFrame) -> DataFrame:
    """check_id and how many of its results are PASS, FAIL and SKIPPED."""
    return checks.groupBy("check_id").agg(*[F.count_if(F.col("status") == status).alias(status) for status in ("PASS", "FAIL", "SKIPPED")])


def bad_metadata(certificates: DataFrame) -> DataFrame:
    """Certificates without an id or source, or whose dates are no full calendar month before the distribution."""
    start, end, paid = (F.try_to_date(F.col(c), F.lit("yyyy-MM-dd")) if dict(certificates.dtypes)[c] == "string" else F.col(c) for c in ("collection_period_start", "collection_period_end", "distribution_date"))
    named = F.lit(True)
    for c in ("deal_id", "source_url", "extraction_method"):
        named = named & (F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    return certificates.where(~F.coalesce(named & is_full_month(start, end) & (end < paid), F.lit(False)))
