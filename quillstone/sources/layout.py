"""The panel as a table of buckets, so that what works loan by loan needs no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = ("deal_id", "loan_id")
#: Buckets of a table; a bucket is one file, sorted by loan and period.
BUCKETS = 64


def write_clustered(loan_months: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``loan_months`` to ``path`` as the table ``name`` and return it: one sorted file a bucket of loans, with Bloom filters of loan_id.

    Buckets go by loan_id alone, which serves every key that holds it: a window or an aggregate over (deal_id, loan_id) of the table, and a join with another
    table of as many buckets, needs no exchange, and a look-up of a loan reads one bucket, and of its row groups those whose range and
    filter admit the loan. A table of that name is replaced.
    """
    writer = loan_months.repartition(buckets, "loan_id").write.mode("overwrite").bucketBy(buckets, "loan_id").sortBy(*KEYS, "period_end")
    writer.option("path", path).option("parquet.bloom.filter.enabled#loan_id", "true").saveAsTable(name)
    return loan_months.sparkSession.table(name)


def loan_history(spark: SparkSession, name: str, deal_id: str, loan_id) -> DataFrame:
    """The months of one loan."""
    table = spark.table(name)
    return table.where((table["deal_id"] == deal_id) & (table["loan_id"] == loan_id))
