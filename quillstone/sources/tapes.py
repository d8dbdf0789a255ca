"""Monthly loan tapes in XML, to normalized loan-months in cents."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import is_full_month, months_between, parse_month, parse_xml_date
from ..functions.money import fail_unless, parse_cents, strict_integer, strict_number
from .archives import fields, tape_records

# The tape's money fields by output column, its other fields, and those that may repeat.
MONEY_FIELDS = {
    "original_balance_cents": "originalLoanAmount",
    "begin_balance_cents": "reportingPeriodBeginningLoanBalanceAmount",
    "end_balance_cents": "reportingPeriodActualEndBalanceAmount",
    "scheduled_payment_cents": "reportingPeriodScheduledPaymentAmount",
    "scheduled_principal_cents": "scheduledPrincipalAmount",
    "principal_paid_cents": "actualPrincipalCollectedAmount",
    "interest_paid_cents": "actualInterestCollectedAmount",
    "other_principal_adjustment_cents": "otherPrincipalAdjustmentAmount",
    "chargeoff_cents": "chargedoffPrincipalAmount",
    "recovery_cents": "recoveredAmount",
    "repurchase_cents": "repurchaseAmount",
    "vehicle_value_cents": "vehicleValueAmount",
}
OTHER_FIELDS = (
    "assetNumber", "reportingPeriodBeginningDate", "reportingPeriodEndingDate", "originationDate", "remainingTermToMaturityNumber",
    "originalLoanTerm", "loanMaturityDate", "obligorCreditScore", "currentDelinquencyStatus", "reportingPeriodInterestRatePercentage",
    "paymentToIncomePercentage", "obligorGeographicLocation", "zeroBalanceCode", "zeroBalanceEffectiveDate", "repossessedIndicator",
    "reportingPeriodModificationIndicator",
)
REPEATABLE = ("zeroBalanceCode", "subvented", "modificationTypeCode", "repurchaseReplacementReasonCode")
REQUIRED = ("original_balance_cents", "begin_balance_cents", "end_balance_cents", "principal_paid_cents", "interest_paid_cents")
NAMESPACE = "http://www.sec.gov/edgar/document/absee/autoloan/assetdata"


def scan(spark: SparkSession, path: str, row_tag: str = "assets") -> DataFrame:
    """Raw records with every field as an array of texts, and the file each is from; plain or gzipped.

    All fields are declared as arrays, since a scalar would silently keep the last of repeated elements; more than
    one value in a field that may not repeat is an error once the field is read. Plain files are split among tasks. ``read`` checks what a scan cannot.
    """
    names = sorted({*MONEY_FIELDS.values(), *OTHER_FIELDS})
    schema = ", ".join(f"{name} array<string>" for name in names)
    raw = spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)
    raw = raw.withColumn("__file", F.col("_metadata.file_path"))
    checked = raw.withColumns({name: _single(name) for name in names if name not in REPEATABLE})
    return checked


def _single(name: str) -> Column:
    c = F.col(name)
    return F.when(F.size(c) > 1, F.raise_error(F.lit(f"repeated element {name}"))).otherwise(F.get(c, F.lit(0)))


def wrong_roots(spark: SparkSession, path: str, namespace: str = NAMESPACE) -> DataFrame:
    """Files whose first bytes do not declare the namespace; the XML reader would not mind."""
    heads = spark.read.format("text").option("wholetext", False).option("lineSep", ">").load(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    root = heads.where(F.col("value").rlike(r"<[A-Za-z]") & ~F.col("value").contains("<?xml"))
    return root.groupBy("file").agg(F.min_by("value", "at").alias("root")).where(~F.col("root").contains(namespace))


def read(spark: SparkSession, path: str, row_tag: str = "assets", namespace: str = NAMESPACE, root: str = "assetData") -> DataFrame:
    """The records of ``scan``, checked in the same pass that reads them: a namespace or root of another kind, any element that repeats
    and may not, and a loan-month that a file holds twice or does not name, is an error once the record is read. A file is one task, plain or gzipped.
    """
    names = sorted({*MONEY_FIELDS.values(), *OTHER_FIELDS})
    records = tape_records(spark, path, namespace=namespace, root=root, row=row_tag, repeatable=",".join(REPEATABLE), identity="assetNumber,reportingPeriodEndingDate")
    return fields(records, names, REPEATABLE).withColumnRenamed("file", "__file")


def load(spark: SparkSession, path: str, row_tag: str = "assets", namespace: str = NAMESPACE) -> DataFrame:
    """``read``, once every file has been read through without an error; an error is a ValueError that says what was found."""
    records = read(spark, path, row_tag, namespace)
    try:
        records.agg(F.count("__file")).collect()
    except PySparkException as error:
        raise ValueError(f"a tape was refused: {error}") from error
    return records


def normalize(raw: DataFrame) -> DataFrame:
    """Loan-months of raw records that carry deal_id, accession, acceptance_time and report_period of their filing.

    Missing fields stay null, never zero. A period other than the filing's or not a full month, a missing
    core amount, a malformed number or date is an error.
    """
    text = lambda name: F.col(name)
    start, end = parse_xml_date(text("reportingPeriodBeginningDate")), parse_xml_date(text("reportingPeriodEndingDate"))
    ok = (end == F.col("report_period").cast("date")) & is_full_month(start, end)
    f = raw.withColumns({"period_start": start, "period_end": fail_unless(ok, end, "reporting period", text("reportingPeriodEndingDate"))})
    for out, name in MONEY_FIELDS.items():
        cents = parse_cents(text(name), signed=True)
        f = f.withColumn(out, fail_unless(cents.isNotNull(), cents, f"required amount omitted: {out}") if out in REQUIRED else cents)
    month_text = lambda c: F.date_format(parse_month(c), "yyyy-MM")
    percent = lambda name: strict_number(text(name)) * 100
    truth = lambda name: F.when(text(name).isNotNull(), (text(name) == "true").cast("int"))
    codes = F.array_join(F.col("zeroBalanceCode"), "|")
    zero = F.lit(0)
    return f.select(
        "deal_id", F.col("assetNumber").alias("loan_id"), "period_start", "period_end", F.col("acceptance_time").cast("timestamp").alias("acceptance_time"), "accession", *MONEY_FIELDS,
        month_text(text("originationDate")).alias("origination_month"), months_between(F.col("period_start"), parse_month(text("originationDate"))).alias("age_months"),
        strict_integer(text("remainingTermToMaturityNumber")).alias("remaining_months"), strict_integer(text("originalLoanTerm")).alias("original_term_months"),
        month_text(text("loanMaturityDate")).alias("maturity_month"), strict_number(text("obligorCreditScore")).alias("credit_score"),
        strict_integer(text("currentDelinquencyStatus")).alias("delinquency_days"), percent("reportingPeriodInterestRatePercentage").alias("interest_rate_pct"),
        F.when(F.col("vehicle_value_cents") != 0, F.col("original_balance_cents") / F.col("vehicle_value_cents") * 100).alias("orig_ltv_pct"),
        percent("paymentToIncomePercentage").alias("payment_to_income_pct"), text("obligorGeographicLocation").alias("state"),
        F.when(F.col("zeroBalanceCode").isNotNull(), codes).alias("zero_balance_code"), month_text(text("zeroBalanceEffectiveDate")).alias("zero_balance_month"),
        F.lit(None).cast("date").alias("liquidation_date"), F.coalesce(F.nullif(codes, F.lit("")), F.lit("ACTIVE")).alias("status_code"),
        truth("repossessedIndicator").alias("repossessed"), truth("reportingPeriodModificationIndicator").alias("modified"),
        zero.alias("first_default_event"), zero.alias("prepayment_event"), zero.alias("repurchase_event"), zero.alias("maturity_event"), F.lit(None).cast("bigint").alias("prepayment_cents"),
    )


def new_sources(sources: DataFrame, ingested: DataFrame) -> DataFrame:
    """Sources not yet ingested; one that was ingested with another hash is an error."""
    known = ingested.select(F.col("accession").alias("__known"), F.col("sha256").alias("__hash"))
    joined = sources.join(known, F.col("accession") == F.col("__known"), "left")
    changed = F.col("__hash").isNotNull() & (F.col("__hash") != F.col("sha256"))
    checked = joined.withColumn("accession", F.when(changed, F.raise_error(F.concat(F.lit("source changed: "), "accession"))).otherwise(F.col("accession")))
    return checked.where(F.col("__known").isNull() | changed).drop("__known", "__hash")


def write_panel(loan_months: DataFrame, amended: Column, path: str) -> None:
    """Amendments to their own table, by deal, period and accession, the rest by deal and period, each file sorted by loan.

    Partitions are overwritten one by one, so that a filing that is loaded again replaces itself; of several
    amendments of a period each keeps its own.
    """
    for name, part, keys in (("loan_month", loan_months.where(~amended), ["deal_id", "period_end"]), ("loan_amendment", loan_months.where(amended), ["deal_id", "period_end", "accession"])):
        writer = part.repartition(*keys).sortWithinPartitions(*keys, "loan_id").write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/{name}")
