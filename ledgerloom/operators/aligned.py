"""Supplier ledgers as aligned text: values belong to the column whose header ends where they end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import taxid
from ..functions.numbers import ledger_text
from ..functions.text import invoice_number, stripped

# Shapes of header labels, amounts and entry lines.
LABEL = r"Débito|Crédito|Saldo-Exercício|Saldo"
AMOUNT = r"(\d{1,3}(?:\.\d{3})*,\d{2})([CD])?"
DATED = r"^\s*\d{2}/\d{2}/\d{4}"
ENTRY = r"^\s*(\d{2}/\d{2}/\d{4})\s+(\S+)"
TOTALS = r"Total da conta:\s*(\d{1,3}(?:\.\d{3})*,\d{2})\s+(\d{1,3}(?:\.\d{3})*,\d{2})"
OPENING = r"(?i)SALDO ANTERIOR.*?(\d{1,3}(?:\.\d{3})*,\d{2})([CD])?"
LEAST_REACH, MOST_REACH = 2, 8
BLOCK = ["file", "block"]


def cents(text: str) -> int:
    """Value of an amount in cents; 0 beyond DECIMAL(15,2)."""
    whole, _, part = re.sub(r"[^0-9.]", "", text.replace(".", "").replace(",", ".")).partition(".")
    value = int(f"{whole or 0}{part:0<2}")
    return value if value < 10**15 else 0


def header(text: str) -> dict | None:
    """Columns of a header line, the reach of their edges, and where its texts begin; None for other lines.

    The reach is half the least gap between edges.  A label that is repeated counts where it stands last, but for
    balances, which are columns of their own.
    """
    if "Débito" not in text or "Crédito" not in text:
        return None
    edges = [(m.group(), m.end()) for m in re.finditer(LABEL, text)]
    gap = min(b - a for (_, a), (_, b) in zip(edges, edges[1:], strict=False))
    sides = {{"Débito": "debit", "Crédito": "credit"}[x]: e for x, e in edges if x in ("Débito", "Crédito")}
    cols = [{"edge": e, "name": n} for n, e in sides.items()] + [{"edge": e, "name": "balance"} for x, e in edges if x.startswith("Saldo")]
    debit = text.find("Débito")
    history, cta = (k if 0 <= (k := text.find(x)) < debit else None for x in ("Histórico", "Cta.C.Part."))
    return {"cols": cols, "reach": max(LEAST_REACH, min(MOST_REACH, gap // 2)), "debit_at": debit, "history_at": history, "cta_at": cta}


HEAD = pa.struct([("cols", pa.list_(pa.struct([("edge", pa.int32()), ("name", pa.string())]))), *[(x, pa.int32()) for x in ("reach", "debit_at", "history_at", "cta_at")]])
AMOUNTS = pa.list_(pa.struct([("cents", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("side", pa.string())]))


def marks(lines: DataFrame) -> DataFrame:
    """file, block, n and text of each line with what it says by itself: its amounts and where they stand, and its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        amount = re.compile(AMOUNT)
        for b in batches:
            texts = [x or "" for x in b.column(3).to_pylist()]
            found = [[(cents(m.group(1)), m.start(), m.end(1), m.group(2) or "") for m in amount.finditer(x)] if "," in x else [] for x in texts]
            more = [pa.array(found, AMOUNTS), pa.array([header(x) for x in texts], HEAD)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=["file", "block", "n", "text", "_amounts", "_head"])

    kinds = dict(lines.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*BLOCK, "n", "text"))
    schema += ", _amounts array<struct<cents: long, start: int, stop: int, side: string>>"
    schema += ", _head struct<cols: array<struct<edge: int, name: string>>, reach: int, debit_at: int, history_at: int, cta_at: int>"
    return lines.select(*BLOCK, "n", "text").mapInArrow(run, schema)


def entries(lines: DataFrame) -> DataFrame:
    """Entries of all blocks with a header: dated lines with a debit or credit, and the lines that continue their texts.

    Lines are dealt by block once; header, amounts and continuations then meet in windows over that order.
    """
    order = W.partitionBy(*BLOCK).orderBy("n")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = marks(lines).withColumn("_head", F.first("_head", ignorenulls=True).over(whole)).filter("_head IS NOT NULL")
    after = F.when(F.col("text").rlike(ENTRY), F.length(F.regexp_extract("text", ENTRY, 0)))

    def column_of(a: Column) -> Column:
        """The column whose right edge is nearest to an amount's, within its reach."""
        apart = lambda c: F.abs(a["stop"] - c["edge"])
        near = F.filter("_head.cols", lambda c: apart(c) <= F.col("_head.reach"))
        return F.array_min(F.transform(near, lambda c: F.struct(apart(c).alias("apart"), c["edge"].alias("edge"), c["name"].alias("name"))))["name"]

    placed = F.transform("_amounts", lambda a: F.struct(a["cents"].alias("cents"), a["start"].alias("start"), a["side"].alias("side"), column_of(a).alias("name")))
    placed = F.when(F.size("_amounts") > 0, F.filter(placed, lambda a: a["name"].isNotNull()))
    # the two are written down in the plan before they are used several times
    rows = rows.withColumns({"_after": after, "_placed": placed})
    rows = rows.withColumn("_inside", F.filter("_placed", lambda a: a["start"] >= F.col("_after")))
    total = lambda n: F.aggregate(F.filter("_inside", lambda a: a["name"] == n), F.lit(0).cast("long"), lambda x, a: x + a["cents"])
    money = lambda c: F.coalesce((c.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(15,2)"), F.lit(0).cast("decimal(15,2)"))
    signs = F.filter("_inside", lambda a: (a["name"] == "balance") & (a["side"] != ""))
    last_sign = F.coalesce(F.get(signs, F.size(signs) - 1)["side"], F.lit(""))
    rows = rows.withColumns({**{n: money(total(n)) for n in ("debit", "credit", "balance")}, "side": last_sign, "_valued": F.coalesce(F.size("_placed") > 0, F.lit(False))})
    own = (F.col("debit") != 0) | (F.col("credit") != 0)
    rows = rows.drop("_amounts", "_placed", "_inside").withColumn("_own", own)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("entry", F.last(F.when(F.col("_own"), F.col("n")), ignorenulls=True).over(so_far)).filter("entry IS NOT NULL")
    plain = stripped(F.col("text"))
    loose = (plain != "") & ~F.col("text").rlike(DATED) & ~F.col("text").contains("Total da conta") & ~plain.startswith("Conta:") & ~F.col("_valued")
    debit_at, cta_at = F.col("_head.debit_at"), F.col("_head.cta_at")
    begins, ends = F.coalesce("_head.history_at", "_after"), F.coalesce(cta_at, debit_at)
    history = stripped(F.substring("text", begins + 1, F.greatest(ends - begins, F.lit(0))))
    counterpart = F.regexp_extract(F.substring("text", cta_at + 1, debit_at - cta_at), r"\d+", 0)
    piece = F.when(F.col("_own"), history).when(loose & ~plain.rlike(r"^\d+$"), plain)
    pieces = rows.withColumn("piece", piece).filter("piece IS NOT NULL")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda p: p["piece"]), " ")
    of_own = lambda c: F.max(F.when(F.col("_own"), c))
    joined = pieces.groupBy(*BLOCK, F.col("entry").alias("n")).agg(
        of_own(F.try_to_timestamp(F.regexp_extract("text", ENTRY, 1), F.lit("dd/MM/yyyy"))).cast("date").alias("day"),
        of_own(F.regexp_extract("text", ENTRY, 2)).alias("lot"),
        stripped(F.regexp_replace(text, r"\s{2,}", " ")).alias("history"),
        of_own(F.nullif(counterpart, F.lit(""))).alias("counterpart"),
        *[of_own(F.col(c)).alias(c) for c in ("debit", "credit", "balance", "side")],
    )
    kind = F.when(F.col("debit") > 0, "PAGAMENTO").otherwise("COMPRA")
    h = F.col("history")
    return joined.filter("day IS NOT NULL").withColumns({"kind": kind, "invoice": invoice_number(h), "tax_id": taxid.in_text(h)})


def checked(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Each block with a header and declared totals: opening balance, totals, and whether it is proved by its own totals.

    A block without entries is accepted if it declares nothing and has no dated line.
    """
    def first(pattern: str, group: int):
        return F.min_by(F.regexp_extract("text", pattern, group), F.when(F.col("text").rlike(pattern), F.col("n")))

    head = F.max((F.col("text").contains("Débito") & F.col("text").contains("Crédito")).cast("int"))
    # texts are declared on few lines, so only those are put in order
    told = lines.filter(F.col("text").rlike("(?i)SALDO ANTERIOR") | F.col("text").contains("Total da conta:")).groupBy(*BLOCK).agg(
        first(TOTALS, 1).alias("d"), first(TOTALS, 2).alias("c"), first(OPENING, 1).alias("o"), first(OPENING, 2).alias("opening_side")
    )
    rows = lines.groupBy(*BLOCK).agg(F.max(F.col("text").rlike(DATED).cast("int")).alias("dated"), head.alias("head")).join(told, BLOCK)
    sums = found.groupBy(*BLOCK).agg(F.sum("debit").alias("sd"), F.sum("credit").alias("sc"), F.count("*").alias("entries"))
    zero = F.lit(0).cast("decimal(25,2)")
    both = rows.filter("head = 1 AND d IS NOT NULL").join(sums, BLOCK, "left")
    both = both.withColumns({"d": ledger_text(F.col("d")).cast("decimal(25,2)"), "c": ledger_text(F.col("c")).cast("decimal(25,2)"), "entries": F.coalesce("entries", F.lit(0))})
    none = (F.col("d") == 0) & (F.col("c") == 0) & (F.col("dated") == 0)
    close = (F.abs(F.col("sd") - F.col("d")) <= 0.01) & (F.abs(F.col("sc") - F.col("c")) <= 0.01)
    return both.select(
        *BLOCK, F.coalesce(ledger_text(F.col("o")), F.lit(0)).cast("decimal(25,2)").alias("opening"), F.coalesce("opening_side", F.lit("")).alias("opening_side"),
        F.col("d").alias("debits"), F.col("c").alias("credits"), "entries",
        F.when(F.col("entries") == 0, none).otherwise(close).alias("proved"),
    )


def by_position(read: DataFrame, lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Entries that a model has read, with debit and credit as their line's columns say.

    An entry takes the line of its day and lot; where several have both, entries in order of n take the line whose
    amount is nearest to theirs, each line once.  `read` has file, block, n, day, lot, debit, credit and kind;
    `found` are the lines' entries, where a caller has them.
    """
    line = F.struct(F.col("n").alias("line"), F.col("debit").alias("d"), F.col("credit").alias("c"))
    keys = [*BLOCK, "day", "lot"]
    true = (entries(lines) if found is None else found).groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    plain = read.withColumn("_lot", F.trim(F.coalesce("lot", F.lit(""))))
    plain = plain.withColumn("_asked", F.count("*").over(W.partitionBy(*BLOCK, "day", "_lot")))
    rows = plain.join(true.withColumnRenamed("lot", "_lot"), [*BLOCK, "day", "_lot"], "left")
    alone = F.coalesce((F.size("_lines") == 1) & (F.col("_asked") == 1), F.lit(False))
    nothing = F.col("_lines").isNull()
    picked = "struct<line: {0}, d: decimal(15,2), c: decimal(15,2)>".format(dict(read.dtypes)["n"])
    simple = rows.filter(alone | nothing).withColumn("_line", F.get("_lines", 0).cast(picked)).drop("_lines", "_asked", "_lot")

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        """Lines for the entries of one day and lot."""
        left, taken = list(frame["_lines"].iloc[0]), []
        frame = frame.sort_values("n")
        for amount in frame[["debit", "credit"]].max(axis=1):
            best = min(left, key=lambda x: min(abs(x["d"] - amount), abs(x["c"] - amount)), default=None)
            taken.append(best)
            if best is not None:
                left.remove(best)
        return frame.drop(columns=["_lines", "_asked", "_lot"]).assign(_line=taken)

    several = rows.filter(~alone & ~nothing)
    chosen = several.groupBy(*BLOCK, "day", "_lot").applyInPandas(take, simple.schema)
    out = simple.unionByName(chosen)
    d, c = F.coalesce("_line.d", "debit"), F.coalesce("_line.c", "credit")
    changed = (d != F.coalesce("debit", F.lit(0))) | (c != F.coalesce("credit", F.lit(0)))
    kind = (
        F.when(changed & (F.col("kind") == "COMPRA") & (d > 0), "PAGAMENTO")
        .when(changed & (F.col("kind") == "PAGAMENTO") & (c > 0), "COMPRA")
        .otherwise(F.col("kind"))
    )
    return out.withColumns({"debit": d, "credit": c, "kind": kind}).select(*read.columns)
