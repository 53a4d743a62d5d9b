"""Payments allocated to purchases first in, first out, in closed form, and positions that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reports import TOTAL, total

#: order of a supplier's entries; its end makes it unique
ORDER = ["moment", "invoice", "line", "part", "quantity", "amount"]

#: rows of a supplier in one range of its total, about
SLICED = 1_000


def running(entries: DataFrame, side: str) -> DataFrame:
    """Positive entries of a side with the running totals before and after each."""
    rows = entries.withColumn("amount", F.col(side)).filter(F.col("amount") > 0)
    rows = rows.withColumn("day", F.to_date("moment"))
    # totals of the days before, and within the day: no task orders more than a supplier's day
    earlier = W.partitionBy("of").orderBy("on").rowsBetween(W.unboundedPreceding, -1)
    days = rows.groupBy(F.col("supplier_id").alias("of"), F.col("day").alias("on")).agg(total(F.col("amount")).alias("sum"), F.count("*").alias("count"))
    days = days.select("of", "on", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("carried"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("count"))
    # what a day carries over stands before its rows, so that these are dealt once and joined with nothing
    carried = days.select(F.col("of").alias("supplier_id"), F.col("on").alias("day"), "carried", "count")
    order = W.partitionBy("supplier_id", "day").orderBy(F.col("count").isNull(), *ORDER)
    dealt = rows.select("supplier_id", "day", *ORDER).unionByName(carried, allowMissingColumns=True)
    after = F.sum(F.coalesce("carried", "amount")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast(TOTAL)
    number = (F.sum("count").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.row_number().over(order) - 1).cast("int")
    dealt = dealt.select("supplier_id", *ORDER, "count", number.alias("n"), after.alias("after")).filter("count IS NULL").drop("count")
    return dealt.withColumn("before", (F.col("after") - F.col("amount")).cast(TOTAL))


def paid_state(purchases: DataFrame, payments: DataFrame) -> DataFrame:
    """What is paid of each purchase: its share of the line of all purchases that payments cover."""
    sums = payments.groupBy("supplier_id").agg(total(F.col("amount")).alias("payments"))
    zero = F.lit(0).cast(TOTAL)
    covered = F.coalesce("payments", zero) - F.col("before")
    paid = F.least(F.greatest(covered, zero), F.col("amount").cast(TOTAL)).cast(TOTAL)
    rows = purchases.join(sums, "supplier_id", "left").withColumn("paid", paid)
    status = F.when(F.col("paid") == 0, "PENDENTE").when(F.col("paid") == F.col("amount"), "PAGO").otherwise("PARCIAL")
    return rows.select(
        "supplier_id", "n", "invoice", "amount", "paid", (F.col("amount") - F.col("paid")).cast(TOTAL).alias("open"), status.alias("status")
    )


def slices_of(purchases: DataFrame, payments: DataFrame, least: int, top: Column | None = None) -> DataFrame:
    """Total of each supplier's purchases (their last running total, if `top` doesn't say otherwise), and the ranges that it is cut into."""
    paid = payments.groupBy("supplier_id").agg(F.count("*").alias("payments"))
    ends = purchases.groupBy("supplier_id").agg((F.max("after") if top is None else top).alias("top"), F.count("*").alias("purchases"))
    rows = F.col("purchases") + F.coalesce("payments", F.lit(0))
    slices = F.greatest(F.lit(least), F.ceil(rows / SLICED)).alias("slices")
    return ends.join(paid, "supplier_id", "left").select("supplier_id", "top", slices)


def pairs(purchases: DataFrame, payments: DataFrame, slices: int = 64) -> DataFrame:
    """Which payment pays how much of which purchase: overlaps of their intervals of running totals.

    Intervals of a supplier are cut into equal ranges of its total, `slices` or one for every SLICED of its rows; both sides are dealt to the
    ranges that they touch and meet there only, so a large supplier is spread and nothing is compared with all.
    """
    # the last running total is the sum, for which nothing has to be put in order
    ends = slices_of(purchases, payments, slices, total(F.col("amount")))
    width = F.greatest(F.ceil(F.col("top") / F.col("slices")), F.lit(1)).cast(TOTAL)

    def dealt(rows: DataFrame, n: str) -> DataFrame:
        cut = rows.join(ends, "supplier_id").withColumn("width", width).filter(F.col("before") < F.col("top"))
        low, high = F.floor(F.col("before") / F.col("width")).cast("int"), F.ceil(F.least("after", "top") / F.col("width")) - 1
        cut = cut.select(
            "supplier_id", F.col("n").alias(n), F.col("before").alias(f"{n}_from"), F.col("amount").alias(f"{n}_amount"),
            low.alias(f"{n}_low"), F.explode(F.sequence(low, high.cast("int"))).alias("slice"),
        )
        return cut.withColumn(f"{n}_begins", F.col(f"{n}_low") == F.col("slice")).drop(f"{n}_low")

    a, b = dealt(purchases, "purchase"), dealt(payments, "payment")
    ending = lambda n: F.col(f"{n}_from") + F.col(f"{n}_amount")
    both = F.least(ending("purchase"), ending("payment")) - F.greatest("purchase_from", "payment_from")
    first = F.col("purchase_begins") | F.col("payment_begins")  # an overlap is told in the range where it begins
    return a.join(b, ["supplier_id", "slice"]).filter((both > 0) & first).select("supplier_id", "purchase", "payment", both.cast(TOTAL).alias("paid"))


def advances(purchases: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments beyond all purchases of each supplier."""
    bought = purchases.groupBy("supplier_id").agg(total(F.col("amount")).alias("purchases"))
    sums = payments.groupBy("supplier_id").agg(total(F.col("amount")).alias("payments"))
    zero = F.lit(0).cast(TOTAL)
    return bought.join(sums, "supplier_id", "left").select(
        "supplier_id", F.greatest(F.coalesce("payments", zero) - F.col("purchases"), zero).cast(TOTAL).alias("advance")
    )


def signed_opening(opening: Column, side: Column) -> Column:
    return F.when(F.upper(F.trim(F.coalesce(side, F.lit("")))) == "D", -F.abs(opening)).otherwise(F.abs(opening))


def positions(suppliers: DataFrame, entries: DataFrame) -> DataFrame:
    """Opening plus credits minus debits, its side and the supplier's status."""
    sums = entries.groupBy("supplier_id").agg(
        total(F.col("debit")).alias("debits"), total(F.col("credit")).alias("credits"), F.count("*").alias("entries")
    )
    zero = F.lit(0).cast(TOTAL)
    opening = signed_opening(F.coalesce("opening", zero), F.col("opening_side"))
    rows = suppliers.join(sums, "supplier_id", "left").select(
        "supplier_id",
        "name",
        opening.cast(TOTAL).alias("opening"),
        F.coalesce("debits", zero).alias("debits"),
        F.coalesce("credits", zero).alias("credits"),
        F.coalesce("entries", F.lit(0)).alias("entries"),
    )
    rows = rows.withColumn("payable", (F.col("opening") + F.col("credits") - F.col("debits")).cast(TOTAL))
    still = (F.col("entries") == 0) & (F.col("opening") == 0) & (F.col("debits") == 0) & (F.col("credits") == 0)
    status = F.when(still, "SEM_MOVIMENTO").when(F.col("payable") == 0, "QUITADO").when(F.col("payable") < 0, "ADIANTADO").otherwise("EM_ABERTO")
    side = F.when(F.col("payable") > 0, "C").when(F.col("payable") < 0, "D").otherwise("")
    return rows.withColumns({"side": side, "status": status})


def summary(found: DataFrame) -> DataFrame:
    names = ["QUITADO", "EM_ABERTO", "ADIANTADO", "SEM_MOVIMENTO"]
    return found.agg(
        F.count("*").alias("suppliers"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in names],
        total(F.col("payable")).alias("payable"),
    )


def divergences(declared: DataFrame, entries: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Suppliers whose declared totals, where given, aren't those of their entries, and why."""
    sums = entries.groupBy("supplier_id").agg(total(F.col("debit")).alias("debits"), total(F.col("credit")).alias("credits"))
    zero = F.lit(0).cast(TOTAL)

    def off(name: str) -> Column:
        apart = F.abs(F.coalesce(name, zero) - F.col(f"declared_{name}")) > F.lit(tolerance).cast("decimal(5,2)")
        return F.when((F.col(f"declared_{name}") > 0) & apart, F.concat_ws(" ", F.lit(name), F.coalesce(name, zero).cast("string"), F.lit("<>"), F.col(f"declared_{name}").cast("string")))

    rows = declared.join(sums, "supplier_id", "left")
    return rows.select("supplier_id", F.concat_ws("; ", off("debits"), off("credits")).alias("message")).filter("message <> ''")


def consolidated(entries: DataFrame) -> DataFrame:
    """Purchases with one invoice number, series and day as one row; those without a number stay apart."""
    day = F.to_date("moment")
    alone = F.when(F.coalesce(F.col("invoice"), F.lit("")) == "", F.concat_ws("/", "line", "part", "amount"))
    rows = entries.withColumn("amount", F.col("credit")).filter("amount > 0")
    first = F.min(F.struct("line", "part", "quantity", "amount"))
    return rows.groupBy("supplier_id", "invoice", "series", day.alias("day"), alone.alias("alone")).agg(
        total(F.col("amount")).alias("credit"), F.count("*").alias("originals"), first["line"].alias("first_line")
    ).drop("alone")


def totals(declared: DataFrame, entries: DataFrame) -> DataFrame:
    """Debits and credits of each supplier: the sums of its entries, or what the file declares where they are 0."""
    sums = entries.groupBy("supplier_id").agg(total(F.col("debit")).alias("d"), total(F.col("credit")).alias("c"))
    pick = lambda c, n: F.when(F.col(c) > 0, F.col(c)).otherwise(F.coalesce(n, F.lit(0))).cast(TOTAL)
    return declared.join(sums, "supplier_id", "left").select(
        "supplier_id", pick("d", "declared_debits").alias("debits"), pick("c", "declared_credits").alias("credits")
    )


def open_divergences(found: DataFrame, suppliers: DataFrame, file_id: int) -> DataFrame:
    """Unresolved divergences of the suppliers of one file."""
    own = suppliers.filter(F.col("file_id") == file_id).select("supplier_id")
    return found.filter("NOT resolved").join(own, "supplier_id")


def pending(state: DataFrame) -> DataFrame:
    """Purchases of `paid_state` that are still open."""
    return state.filter("open > 0")


def detail(found: DataFrame, entries: DataFrame, state: DataFrame, supplier_id: int) -> DataFrame:
    """One supplier's position, its entries in order of time, and its pending purchases, as rows that tell what they are."""
    own = F.col("supplier_id") == supplier_id
    head = found.filter(own).select(F.lit("position").alias("what"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("invoice"), F.col("payable").alias("amount"), "status")
    order = W.orderBy("moment", "invoice", "line", "part", "quantity", "credit", "debit")
    amount = (F.col("credit") - F.col("debit")).cast(TOTAL)
    rows = entries.filter(own).select(
        F.lit("entry").alias("what"), F.row_number().over(order).alias("place"), "invoice", amount.alias("amount"), F.when(F.col("debit") > 0, "PAGAMENTO").otherwise("COMPRA").alias("status")
    )
    left = pending(state.filter(own)).select(F.lit("pending").alias("what"), F.col("n").alias("place"), "invoice", F.col("open").alias("amount"), "status")
    return head.unionByName(rows).unionByName(left)
