"""Corporate cards: totals of invoices and cards, and payment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import TOTAL, total


def invoice_totals(invoices: DataFrame, entries: DataFrame) -> DataFrame:
    """Live entries of each invoice; invoices without any have 0."""
    live = entries.filter(~F.col("deleted")).select("card_id", "month", "entry_id", "amount")
    joined = invoices.join(live, ["card_id", "month"], "left")
    return joined.groupBy("card_id", "month", "status").agg(F.count("entry_id").alias("entries"), total(F.col("amount")).alias("total"))


def totals(cards: DataFrame, invoices: DataFrame, entries: DataFrame) -> DataFrame:
    """Totals of each card, and of its latest open invoice."""
    zero = F.lit(0).cast(TOTAL)
    sums = invoice_totals(invoices, entries).groupBy("card_id").agg(
        F.count("*").alias("invoices"),
        F.sum("entries").alias("entries"),
        total(F.col("total")).alias("total"),
        F.max_by("total", F.when(F.col("status") == "aberta", F.col("month"))).alias("open_total"),
    )
    return cards.join(sums, "card_id", "left").select(
        "card_id",
        "label",
        F.coalesce("invoices", F.lit(0)).alias("invoices"),
        F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce("total", zero).alias("total"),
        F.coalesce("open_total", zero).alias("open_total"),
    )


def with_card(invoices: DataFrame, cards: DataFrame) -> DataFrame:
    """Live invoices with their card."""
    return invoices.filter("NOT deleted").drop("deleted").join(cards, "card_id")


def settled(requests: DataFrame, invoices: DataFrame, transactions: DataFrame) -> DataFrame:
    """What each request to pay an invoice with a transaction comes to: `paga`, or why it is refused.

    `requests` has card_id, month, company_id and wanted (a transaction); `invoices` card_id, month, company_id, tx_id
    (what paid it) and total.  Each request is judged by the state that is stored.
    """
    keys = ["card_id", "month", "company_id"]
    state = invoices.select(*keys, F.col("tx_id").alias("_paid"), "total", F.lit(True).alias("_there"))
    tx = transactions.select(F.col("tx_id").alias("wanted"), "company_id", "dc", F.col("amount").cast(TOTAL).alias("_amount"))
    used = invoices.filter("tx_id IS NOT NULL").select(F.col("tx_id").alias("wanted")).distinct().withColumn("_used", F.lit(True))
    rows = requests.join(state, keys, "left").join(tx, ["wanted", "company_id"], "left").join(used, "wanted", "left")
    outcome = (
        F.when(F.col("_there").isNull(), "unknown invoice")
        .when(F.col("_paid").isNotNull(), "paid already")
        .when(F.col("_amount").isNull(), "unknown transaction")
        .when(F.col("_used"), "pays another")
        .when(F.col("dc") != "D", "no debit")
        .when(F.col("_amount") != F.col("total"), "other amount")
        .otherwise("paga")
    )
    return rows.select(*requests.columns, outcome.alias("outcome"))
