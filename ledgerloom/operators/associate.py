"""Receipts and invoices associated with transactions by amount and time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import digits_only
from ..scratch import stored

DAY = 86_400_000_000
#: widths of the ranges of cents and of microseconds within which one task orders distinct values
WIDTHS = {"cents": 1 << 16, "at": 400 * DAY}


def cents(c: Column) -> Column:
    return (c * 100).cast("long")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


#: documents of one cell that one task meets
LANE = 1000


def apart(a: str, b: str, days: int) -> Column:
    """Whether two moments are within some days of 24 hours, to the microsecond."""
    return F.abs(micros(F.col(a)) - micros(F.col(b))) <= days * DAY


def gridded(rows: DataFrame, moment: str, days: int, around: bool) -> DataFrame:
    """Rows in cells of cents and spans of `days`: their own cell, or also those next to it in both directions."""
    rows = rows.withColumn("cell", F.floor(micros(F.col(moment)) / (days * DAY)))
    if not around:
        return rows
    near = lambda c: F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)]))
    return rows.withColumn("cents", near("cents")).withColumn("cell", near("cell"))


def met(transactions: DataFrame, documents: DataFrame, keys: list[str], at: str, days: int) -> DataFrame:
    """Transactions with each document within a cent and some days; both sides have `cents`.

    Only documents in a transaction's own cell are met, so rows are few more than pairs however common an
    amount is.  Cells with many documents are split into lanes, to each of which their transactions go.
    """
    cell = [*keys, "cents", "cell"]
    asked, there = gridded(transactions, "moment", days, False), gridded(documents, at, days, True)
    lanes = there.groupBy(*cell).agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes")).filter("lanes > 1")
    many = F.coalesce("lanes", F.lit(1))
    asked = asked.join(lanes, cell, "left").withColumn("lane", F.explode(F.sequence(F.lit(1), many))).drop("lanes")
    there = there.join(lanes, cell, "left").withColumn("lane", F.pmod(F.xxhash64(*documents.columns), many).cast("int") + 1).drop("lanes")
    return asked.join(there, [*cell, "lane"]).filter(apart("moment", at, days)).drop("cell", "lane")


def only_ones(transactions: DataFrame, documents: DataFrame, keys: list[str], at: str, key: str, days: int) -> DataFrame:
    """tx_id and the document of each transaction that has exactly one within a cent and some days.

    No pairs are made: along the times of a cell, documents so far are counted and their numbers summed.  The
    difference between the end and the beginning of a transaction's span is how many it has, and which one.
    """
    reach = days * DAY
    cell = [*keys, "cents", "cell"]
    asked = gridded(transactions.filter("moment IS NOT NULL"), "moment", days, False)
    ends = F.array(F.struct((micros(F.col("moment")) - reach).alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")), F.struct((micros(F.col("moment")) + reach).alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("sign")))
    asked = asked.select(*cell, "tx_id", F.inline(ends), F.lit(0).alias("n"), F.lit(0).cast("decimal(38,0)").alias("sum"))
    # equal documents of one moment are one row
    there = documents.groupBy(*keys, "cents", at).agg(F.count("*").alias("n"), F.sum(F.col(key).cast("decimal(38,0)")).alias("sum"))
    there = gridded(there, at, days, True).select(*cell, micros(F.col(at)).alias("at"), F.lit(1).alias("turn"), "n", "sum")
    upto = W.partitionBy(*cell).orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    rows = asked.unionByName(there, allowMissingColumns=True).withColumns({"n": F.sum("n").over(upto), "sum": F.sum("sum").over(upto)})
    found = rows.filter("tx_id IS NOT NULL").groupBy("tx_id").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum(F.col("sum") * F.col("sign")).alias(key))
    return found.filter("n = 1").select("tx_id", F.col(key).cast(dict(documents.dtypes)[key]))


def free_receipts(receipts: DataFrame) -> DataFrame:
    return receipts.filter("tx_id IS NULL AND NOT deleted").drop("tx_id", "deleted")


def receipt_sides(transactions: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Debits and free receipts of a company, of whatever bank account, with their cents."""
    free = free_receipts(receipts).drop("bank_id").withColumn("cents", cents(F.col("paid")))
    return transactions.filter("dc = 'D'").withColumn("cents", cents(F.col("amount"))), free


def receipt_candidates(transactions: DataFrame, receipts: DataFrame, days: int = 3) -> DataFrame:
    """Free receipts of the company within a cent and some days of a debit."""
    return met(*receipt_sides(transactions, receipts), ["company_id"], "paid_at", days)


def only_receipts(transactions: DataFrame, receipts: DataFrame, days: int = 3) -> DataFrame:
    """The receipt of each debit that has just one candidate."""
    return only_ones(*receipt_sides(transactions, receipts), ["company_id"], "paid_at", "receipt_id", days)


def directed(invoices: DataFrame, companies: DataFrame) -> DataFrame:
    """Free pending invoices with the side of the money that pays them: credit where the company alone is the
    issuer, debit where it alone is the recipient; others have no side and are left out."""
    own = companies.select("company_id", digits_only(F.col("tax_id")).alias("own")).filter("own <> ''")
    issues = digits_only(F.coalesce("issuer", F.lit(""))) == F.col("own")
    receives = digits_only(F.coalesce("recipient", F.lit(""))) == F.col("own")
    side = F.when(issues & ~receives, "C").when(receives & ~issues, "D")
    free = invoices.filter("status = 'pendente' AND tx_id IS NULL AND NOT deleted").drop("tx_id", "deleted", "status")
    return free.join(own, "company_id").withColumn("dc", side).drop("own").filter("dc IS NOT NULL")


def invoice_candidates(transactions: DataFrame, invoices: DataFrame, companies: DataFrame, days: int = 7) -> DataFrame:
    """Free invoices within a cent and some days of a transaction on their side."""
    sides = directed(invoices, companies).withColumnRenamed("amount", "billed").withColumn("cents", cents(F.col("billed")))
    rows = transactions.drop("status").withColumn("cents", cents(F.col("amount")))
    return met(rows, sides, ["company_id", "dc"], "issued", days)


def islands(rows: DataFrame, group: list[str], along: str, gap: int, name: str, width: int) -> DataFrame:
    """Rows with the least value of their island: values of a group more than `gap` apart begin a new one.

    Distinct values are ordered in ranges of `width`; what ranges need of those before them is one row each.
    """
    values = rows.select(*group, along).distinct().withColumn("_range", F.floor(F.col(along) / width))
    ranges = W.partitionBy(*group).orderBy("_range")
    ends = values.groupBy(*group, "_range").agg(F.max(along).alias("_max")).withColumn("_past", F.lag("_max").over(ranges)).drop("_max")
    inside = W.partitionBy(*group, "_range").orderBy(along)
    past = F.coalesce(F.lag(along).over(inside), F.col("_past"))
    cut = values.join(ends, [*group, "_range"]).withColumn("_start", F.when(~F.coalesce(F.col(along) - past <= gap, F.lit(False)), F.col(along)))
    cut = cut.withColumn("_own", F.last("_start", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    # a range that begins inside an island takes the last beginning of the ranges before
    starts = cut.groupBy(*group, "_range").agg(F.max("_start").alias("_last"))
    starts = starts.withColumn("_carried", F.last("_last", ignorenulls=True).over(ranges.rowsBetween(W.unboundedPreceding, -1)))
    begun = cut.join(starts.drop("_last"), [*group, "_range"]).select(*group, along, F.coalesce("_own", "_carried").alias(name))
    return rows.join(begun, [*group, along])


def consumed(transactions: DataFrame, documents: DataFrame, keys: list[str], days: int) -> DataFrame:
    """(tx_id, doc_id): transactions in order of (moment, tx_id) take the only free document near them.

    Documents and transactions have columns `cents` and `moment`.  Sorted by amount within the keys, a gap
    of more than a cent separates islands that can't affect one another; within an island, so does a gap
    of more than `days` in its sorted times.  What is left is played in order as it streams by: a task
    holds the free documents of the days around one transaction, however large the island is.
    """
    reach = days * DAY
    sides = transactions.select(*keys, "cents", "moment", F.col("tx_id").alias("id"), F.lit(1).alias("is_tx")).unionByName(
        documents.select(*keys, "cents", "moment", F.col("doc_id").alias("id"), F.lit(0).alias("is_tx"))
    )
    rows = stored(sides.filter("moment IS NOT NULL AND cents IS NOT NULL").withColumn("at", micros(F.col("moment"))).drop("moment"))
    group = list(keys)
    for along, gap, name in (("cents", 1, "island"), ("at", reach, "stretch")):
        rows = islands(rows, group, along, gap, name, WIDTHS[along])
        group.append(name)
        # groups without both sides can't give a match
        held = rows.groupBy(*group).agg(F.min("is_tx").alias("low"), F.max("is_tx").alias("high")).filter("low < high")
        rows = stored(rows.join(held.select(*group), group, "left_semi"))
    # a document comes before the first transactions that can take it
    enter = F.col("at") - F.when(F.col("is_tx") == 0, reach).otherwise(0)
    ordered = rows.withColumn("enter", enter).repartition(*group).sortWithinPartitions(*group, "enter", "is_tx", "at", "id")

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free, waiting = None, {}, deque()
        for frame in frames:
            out = []
            for *key, cents, at, i, is_tx in frame.itertuples(index=False, name=None):
                if key != now:
                    now, free, waiting = key, {}, deque()
                if not is_tx:
                    free.setdefault(cents, set()).add(i)
                    waiting.append((at + reach, cents, i))
                    continue
                while waiting and waiting[0][0] < at:
                    _, c, d = waiting.popleft()
                    free[c].discard(d)
                # what is free now is near in time; it is near in amount within a cent
                near = [free[c] for c in (cents - 1, cents, cents + 1) if free.get(c)]
                if len(near) == 1 and len(near[0]) == 1:
                    out.append((i, near[0].pop()))
            yield pd.DataFrame(out, columns=["tx_id", "doc_id"]).astype("int64")

    return ordered.select(*group, "cents", "at", "id", "is_tx").mapInPandas(play, "tx_id long, doc_id long")


def receipts(matched: DataFrame, found: DataFrame, days: int = 3) -> DataFrame:
    """Receipts that pending debits with a rule take; `matched` are the transactions with one."""
    free = free_receipts(found).select("company_id", cents(F.col("paid")).alias("cents"), F.col("paid_at").alias("moment"), F.col("receipt_id").alias("doc_id"))
    debits = matched.filter("dc = 'D'").withColumn("cents", cents(F.col("amount")))
    return consumed(debits, free, ["company_id"], days).withColumnRenamed("doc_id", "receipt_id")


def invoices(matched: DataFrame, found: DataFrame, companies: DataFrame, days: int = 7) -> DataFrame:
    """Invoices that pending transactions with a rule take; `matched` are the transactions with one."""
    rows = directed(found, companies).select(
        "company_id", "dc", cents(F.col("amount")).alias("cents"), F.col("issued").alias("moment"), F.col("invoice_id").alias("doc_id")
    )
    with_cents = matched.withColumn("cents", cents(F.col("amount")))
    return consumed(with_cents, rows, ["company_id", "dc"], days).withColumnRenamed("doc_id", "invoice_id")


def requested(documents: DataFrame, transactions: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """What requests to associate, dissociate or cancel invoices or receipts come to: outcome, status and tx_id.

    `requests` has the document's key, `event`, `wanted` (a transaction) and `company_id`; documents without
    a status, as receipts, can't be cancelled.  Each request is judged by the state that is stored.
    """
    has_status = "status" in documents.columns
    state = documents.filter("NOT deleted").select(key, "company_id", (F.col("status") if has_status else F.lit("")).alias("status"), "tx_id", F.lit(True).alias("known"))
    own = transactions.select(F.col("tx_id").alias("wanted"), "company_id", F.lit(True).alias("there"))
    rows = requests.join(state, [key, "company_id"], "left").join(own, ["wanted", "company_id"], "left")
    taken = F.col("tx_id").isNotNull()
    associate = F.col("event") == "associate"
    dissociate = F.col("event") == "dissociate"
    bound = (F.col("status") == "associada") if has_status else taken
    outcome = (
        F.when(F.col("known").isNull(), "unknown document")
        .when(associate & (F.col("status") == "cancelada"), "cancelled")
        .when(associate & taken, "conflict")
        .when(associate & F.col("there").isNull(), "unknown transaction")
        .when(dissociate & ~bound, "not associated")
        .when(associate, "associated")
        .when(dissociate, "free")
        .when(F.lit(has_status) & (F.col("event") == "cancel"), "cancelada")
        .otherwise("unknown event")
    )
    rows = rows.withColumn("outcome", outcome)
    out = F.col("outcome")
    after = F.when(out == "associated", "associada").when(out == "free", "pendente").when(out == "cancelada", "cancelada").otherwise(F.col("status"))
    tx = F.when(out == "associated", F.col("wanted")).when(~out.isin("free", "cancelada"), F.col("tx_id"))
    columns = [key, "event", "outcome", *([after.alias("status")] if has_status else []), tx.alias("tx_id")]
    return rows.select(*columns)
