"""Dashboard figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import live


def percent(part: Column, whole: Column) -> Column:
    """One decimal, half to even, 0 where there is nothing."""
    return F.coalesce(F.bround(F.try_divide(part * 100, whole).cast("decimal(20,6)"), 1), F.lit(0)).cast("decimal(5,1)")


def summary(transactions: DataFrame, postings: DataFrame, invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """Counts by company.  All transactions count and any posting reconciles, deleted or not; live postings are counted apart."""
    reconciled = transactions.join(postings.select("tx_id"), "tx_id", "left_semi")
    counts = [
        transactions.groupBy("company_id").agg(F.count("*").alias("transactions")),
        reconciled.groupBy("company_id").agg(F.count("*").alias("reconciled")),
        live(postings).groupBy("company_id").agg(F.count("*").alias("postings")),
        invoices.groupBy("company_id").agg(F.count("*").alias("invoices")),
        receipts.groupBy("company_id").agg(F.count("*").alias("receipts")),
    ]
    joined = reduce(lambda a, b: a.join(b, "company_id", "left"), counts)
    names = ["transactions", "reconciled", "postings", "invoices", "receipts"]
    full = joined.select("company_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return full.withColumn("percent", percent(F.col("reconciled"), F.col("transactions")))


def months(first: str, n: int) -> Column:
    start = F.lit(first).cast("date")
    return F.sequence(start, F.add_months(start, n - 1), F.expr("INTERVAL 1 MONTH"))


def monthly(facts: dict[str, tuple[DataFrame, str]], keys: DataFrame, first: str, n: int) -> DataFrame:
    """Counts of each fact by company and month; months without any are there with 0."""
    rows = [d.select("company_id", F.date_format(c, "yyyy-MM").alias("month"), F.lit(k).alias("fact")) for k, (d, c) in facts.items()]
    counted = reduce(DataFrame.unionByName, rows).groupBy("company_id", "month").agg(
        *[F.count_if(F.col("fact") == k).alias(k) for k in facts]
    )
    grid = keys.select("company_id", F.explode(months(first, n)).alias("m")).select("company_id", F.date_format("m", "yyyy-MM").alias("month"))
    return grid.join(counted, ["company_id", "month"], "left").na.fill(0, list(facts))


def by_account(transactions: DataFrame, postings: DataFrame, banks: DataFrame) -> DataFrame:
    """Reconciled and open transactions of each active bank account."""
    marked = transactions.join(postings.select("tx_id").distinct().withColumn("hit", F.lit(True)), "tx_id", "left")
    counts = marked.groupBy("bank_id").agg(F.count_if("hit").alias("reconciled"), F.count_if(F.col("hit").isNull()).alias("open"))
    label = F.concat("acronym", F.lit(" - Ag. "), "branch", F.lit(" / "), "number")
    return banks.filter("active").join(counts, "bank_id", "left").select(
        "bank_id", label.alias("label"), F.coalesce("reconciled", F.lit(0)).alias("reconciled"), F.coalesce("open", F.lit(0)).alias("open")
    )


def month_series(rows: DataFrame, key: str, at: str) -> DataFrame:
    """key, month and n: rows of each month from a key's first to its last one, 0 where there are none."""
    month = F.trunc(at, "month")
    counted = rows.groupBy(key, month.alias("m")).agg(F.count("*").alias("n"))
    ends = counted.groupBy(key).agg(F.sequence(F.min("m"), F.max("m"), F.expr("INTERVAL 1 MONTH")).alias("all"))
    grid = ends.select(key, F.explode("all").alias("m"))
    return grid.join(counted, [key, "m"], "left").select(key, F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))
