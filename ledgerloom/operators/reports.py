"""Income statement, trial balance and cash book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import day_bounds

TOTAL = "decimal(25,2)"
#: side on which a kind of account grows in the income statement: fixed values
NATURE = {"receita": "C", "custo": "D", "despesa": "D"}


def total(amount: Column, when: Column | None = None) -> Column:
    """A sum that is 0 where nothing is added."""
    value = amount if when is None else F.when(when, amount)
    return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)


def by_side(postings: DataFrame, *keys: str) -> DataFrame:
    """Debits and credits of each key in one pass."""
    return postings.groupBy(*keys).agg(
        total(F.col("amount"), F.col("dc") == "D").alias("debits"), total(F.col("amount"), F.col("dc") == "C").alias("credits")
    )


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("deleted"))


def income_statement(postings: DataFrame, accounts: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Signed balance of each account of result.  Accounts count even if deleted, postings don't."""
    rows = live(postings).filter(day_bounds(F.col("moment"), first, last))
    nature = F.create_map(*[F.lit(x) for p in NATURE.items() for x in p])
    named = accounts.filter(F.col("kind").isin(*NATURE)).select("code", "label", "kind")
    balance = F.when(nature[F.col("kind")] == "C", F.col("credits") - F.col("debits")).otherwise(F.col("debits") - F.col("credits"))
    return (
        by_side(rows, "company_id", "code")
        .join(named, "code")
        .select("company_id", "kind", "code", "label", balance.cast(TOTAL).alias("balance"))
    )


def income_totals(lines: DataFrame) -> DataFrame:
    """Revenue, cost and expense of each company and what is left."""
    sums = [total(F.col("balance"), F.col("kind") == k).alias(k) for k in NATURE]
    return (
        lines.groupBy("company_id")
        .agg(*sums)
        .select("company_id", *NATURE, (F.col("receita") - F.col("custo") - F.col("despesa")).cast(TOTAL).alias("resultado"))
    )


def trial_balance(postings: DataFrame, charts: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Every live account of a company's chart, and deleted ones that moved; the balance is on one side only."""
    moved = by_side(live(postings).filter(day_bounds(F.col("moment"), first, last)), "company_id", "code")
    rows = charts.join(moved, ["company_id", "code"], "left").filter(~F.col("deleted") | F.col("debits").isNotNull())
    zero = F.lit(0).cast(TOTAL)
    debits, credits = F.coalesce("debits", zero), F.coalesce("credits", zero)
    return rows.select(
        "company_id",
        "code",
        "label",
        debits.alias("debits"),
        credits.alias("credits"),
        F.greatest(debits - credits, zero).cast(TOTAL).alias("debit_balance"),
        F.greatest(credits - debits, zero).cast(TOTAL).alias("credit_balance"),
    )


def trial_totals(balance: DataFrame) -> DataFrame:
    return balance.groupBy("company_id").agg(
        *[total(F.col(c)).alias(c) for c in ("debits", "credits", "debit_balance", "credit_balance")],
        F.count("*").alias("accounts"),
    )


def signed() -> Column:
    return F.when(F.col("dc") == "C", F.col("amount")).otherwise(-F.col("amount"))


def opening_balances(transactions: DataFrame, first: str) -> DataFrame:
    before = live(transactions).filter(F.col("moment") < F.lit(first).cast("timestamp"))
    return before.groupBy("bank_id").agg(total(signed()).alias("opening"))


def cash_book(transactions: DataFrame, first: str, last: str) -> DataFrame:
    """Running balance of each bank account by (time, id), from its opening balance on."""
    rows = live(transactions).filter(day_bounds(F.col("moment"), first, last)).withColumn("_day", F.to_date("moment"))
    # sums of the days before, and a window within the day: no task orders more than an account's day
    earlier = W.partitionBy("bank_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = rows.groupBy("bank_id", "_day").agg(total(signed()).alias("_sum"))
    days = days.select("bank_id", "_day", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast(TOTAL).alias("_before"))
    running = W.partitionBy("bank_id", "_day").orderBy("moment", "tx_id").rowsBetween(W.unboundedPreceding, 0)
    opening = F.coalesce("opening", F.lit(0).cast(TOTAL))
    found = rows.join(days, ["bank_id", "_day"]).join(opening_balances(transactions, first), "bank_id", "left")
    balance = opening + F.col("_before") + F.sum(signed()).over(running)
    return found.select("bank_id", "tx_id", "moment", "dc", "amount", balance.cast(TOTAL).alias("balance"))


def cash_totals(transactions: DataFrame, first: str, last: str) -> DataFrame:
    """Opening, credits, debits and closing of each bank account with rows up to the period's end."""
    start = F.lit(first).cast("timestamp")
    inside = F.col("moment") >= start
    rows = live(transactions).filter(day_bounds(F.col("moment"), None, last))
    sums = rows.groupBy("bank_id").agg(
        total(signed(), F.col("moment") < start).alias("opening"),
        total(F.col("amount"), inside & (F.col("dc") == "C")).alias("credits"),
        total(F.col("amount"), inside & (F.col("dc") == "D")).alias("debits"),
        F.count_if(inside).alias("entries"),
    )
    return sums.withColumn("closing", (F.col("opening") + F.col("credits") - F.col("debits")).cast(TOTAL))
