"""Supplier ledgers in workbooks: columns found by their labels, a block for each account, totals checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import taxid
from ..functions.numbers import sheet_cell
from ..functions.text import invoice_number, let, stripped
from ..scratch import stored
from .tables import lines_of

# Labels of the columns, in the order in which they count.
LABELS = {
    "day": ["data"],
    "lot": ["lote", "número", "numero", "nº", "no"],
    "history": ["histórico", "historico", "descrição", "descricao"],
    "counterpart": ["cta.c.part.", "cta c part", "cta.c.part", "contrapartida", "c.part."],
    "debit": ["débito", "debito"],
    "credit": ["crédito", "credito"],
    "balance": ["saldo-exercício", "saldo-exercicio", "saldo exercício", "saldo"],
}
HEADER_WITHIN = 60
# Words and shapes of a sheet's first lines.
HEAD_WITHIN = 15
COMPANY, TAX_ID, PERIOD = "Empresa:", "C.N.P.J.", "Período:"
TAX_ID_SHAPE, PERIOD_SHAPE = r"[\d.]{2,}[\d./-]+", r"(\d{2}/\d{2}/\d{4})\s*-\s*(\d{2}/\d{2}/\d{4})"
TOLERANCE = 0.01
ZERO = "CAST(0 AS DECIMAL(15,2))"


#: words without which a row is neither a header nor an opening balance nor a total
TELLING = "(?iu)" + "|".join([*LABELS["debit"], "anterior", "conta"])


def texts_of(cells: Column) -> Column:
    """Texts of a row in one; empty where none of the words that tell what a row is stands in it, as in most."""
    return F.when(F.array_join(cells["text"], " ").rlike(TELLING), _texts(cells)).otherwise("")


def _texts(cells: Column) -> Column:
    return F.array_join(F.reverse(F.transform(F.filter(cells, lambda c: c["kind"] == "s"), lambda c: c["text"])), " ")


def header(cells: Column, texts: Column) -> Column:
    """Columns by name that a row with labels of a debit and a credit column names; null for other rows.

    An earlier label goes before a later one, and of equal labels the one furthest right.
    """
    places = F.create_map(*[F.lit(x) for n, own in LABELS.items() for i, label in enumerate(own) for x in (f"{n}/{label}", i)])
    labels = F.transform(F.filter(cells, lambda c: c["kind"] == "s"), lambda c: F.struct(F.lower(stripped(c["text"])).alias("label"), c["col"].alias("col")))

    def col(labels: Column, name: str) -> Column:
        found = F.transform(labels, lambda c: F.struct(places[F.concat(F.lit(f"{name}/"), c["label"])].alias("place"), (-c["col"]).alias("col")))
        return -F.array_min(F.filter(found, lambda c: c["place"].isNotNull()))["col"]

    # most rows are told by a look at their texts
    may = lambda n: texts.rlike("(?iu)" + "|".join(LABELS[n]))
    named = F.when(may("debit") & may("credit"), let(labels, lambda x: F.struct(*[col(x, n).alias(n) for n in LABELS])))
    return F.when(texts != "", let(named, lambda h: F.when(h["debit"].isNotNull() & h["credit"].isNotNull(), h)))


def number(text: Column, kind: Column) -> Column:
    """Amount of a cell, 0 where there is none."""
    plain = F.bround(text.try_cast("decimal(30,10)"), 2).cast("decimal(15,2)")
    return F.coalesce(F.when(kind == "n", plain).when(text.isNotNull(), sheet_cell(text)), F.expr(ZERO))


def whole(text: Column, kind: Column) -> Column:
    """A number without decimals, such as 11190.0, as its digits; other texts as they are."""
    return F.when(kind == "n", F.regexp_replace(text, r"\.0+$", "")).otherwise(stripped(text))


def side(balance: Column) -> Column:
    return F.when(balance < 0, "C").when(balance > 0, "D").otherwise("")


def rows_of(cells: DataFrame) -> DataFrame:
    """One row for each row of each sheet with its named cells, what it is, and the number and code of its block (0 before the first).

    `cells` are those of `tables.cells`, or rows of `tables.lines`; `top` has the cells of a sheet's first rows.
    """
    found = lines_of(cells).filter("error IS NULL").select("file", "row", "cells")
    sheet = W.partitionBy("file").orderBy("row")
    up_to, whole_sheet = sheet.rowsBetween(W.unboundedPreceding, 0), sheet.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cell = lambda c: F.get("cells", F.array_position("cells.col", c) - 1)
    starts = F.coalesce(stripped(cell(F.lit(1))["text"]).startswith("Conta:"), F.lit(False))
    found = found.withColumns({"starts": starts, "texts": texts_of(F.col("cells"))})
    head = F.when(F.col("row") <= HEADER_WITHIN, header(F.col("cells"), F.col("texts")))
    own_code = F.when(F.col("starts"), F.struct(let(cell(F.lit(2)), lambda c: whole(c["text"], c["kind"])).alias("code")))
    found = found.withColumns({"head": head, "own_code": own_code})
    found = found.withColumns({
        "head": F.first("head", ignorenulls=True).over(whole_sheet),
        "block": F.sum(F.col("starts").cast("int")).over(up_to),
        "code": F.last("own_code", ignorenulls=True).over(up_to)["code"],
    })
    opening = ~F.col("starts") & F.upper("texts").contains("SALDO ANTERIOR")
    totals = ~F.col("starts") & ~F.col("opening") & F.col("texts").contains("Total da conta")
    # the name is the last text of the row that isn't a code
    is_name = lambda c: (c["col"] > 2) & (c["kind"] == "s") & (stripped(c["text"]) != "") & ~stripped(c["text"]).rlike(r"^[\d.]+$")
    title = stripped(F.get(F.filter("cells", is_name), F.lit(0))["text"])
    account = stripped(cell(F.lit(3))["text"])
    found = found.withColumn("opening", opening).withColumn("totals", totals).select(
        "file", "row", "starts", "block", "code", "opening", "totals",
        F.when(F.col("starts"), title).alias("title"), F.when(F.col("starts"), account).alias("account"),
        *[cell(F.col(f"head.{n}")).alias(n) for n in LABELS],
        F.when(F.col("row") <= HEAD_WITHIN, F.col("cells")).alias("top"),
    )
    text, kind = (lambda n: F.col(f"{n}.text")), (lambda n: F.col(f"{n}.kind"))
    values = {n: whole(text(n), kind(n)) for n in ("lot", "counterpart")} | {n: number(text(n), kind(n)) for n in ("debit", "credit", "balance")}
    # values are worked out once; written down, the long expressions aren't repeated in all that builds on them
    return stored(found.withColumns({"day": F.when(kind("day") == "d", text("day")), "history": stripped(text("history")), **values}))


def entries(rows: DataFrame) -> DataFrame:
    """Entries of the blocks: rows with a date and an amount."""
    kept = rows.filter((F.col("block") > 0) & ~F.col("starts") & ~F.col("opening") & ~F.col("totals") & F.col("day").isNotNull())
    kept = kept.filter("debit <> 0 OR credit <> 0").withColumn("history", F.coalesce("history", F.lit("")))
    return kept.select(
        "file", "block", "code", "row",
        F.to_date(F.left("day", F.lit(10))).alias("day"),
        F.coalesce("lot", F.lit("")).alias("lot"),
        "history",
        F.nullif("counterpart", F.lit("")).alias("counterpart"),
        "debit", "credit",
        F.abs("balance").alias("balance"), side(F.col("balance")).alias("side"),
        let(F.col("history"), invoice_number).alias("invoice"), taxid.in_text(F.col("history")).alias("tax_id"),
        F.when(F.col("debit") > 0, "PAGAMENTO").otherwise("COMPRA").alias("kind"),
    )


def suppliers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each block: account, name, opening balance, totals, and whether declared totals are those of the entries."""
    last = lambda c, when: F.max_by(c, F.when(F.col(when), F.col("row")))  # noqa: E731  a later row of the kind wins
    blocks = rows.filter("block > 0").groupBy("file", "block").agg(
        F.first("code").alias("code"),
        last("account", "starts").alias("account"),
        last("title", "starts").alias("name"),
        last("balance", "opening").alias("opening"),
        last("debit", "totals").alias("declared_debits"),
        last("credit", "totals").alias("declared_credits"),
    )
    sums = found.groupBy("file", "block").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count("*").alias("entries"))
    zero = F.lit(0).cast("decimal(25,2)")
    both = blocks.join(sums, ["file", "block"], "left").withColumns({"d": F.coalesce("d", zero), "c": F.coalesce("c", zero), "opening": F.coalesce("opening", F.expr(ZERO))})
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= TOLERANCE
    return both.select(
        "file", "block", "code", "account", F.coalesce("name", F.lit("")).alias("name"),
        F.abs("opening").alias("opening"), side(F.col("opening")).alias("opening_side"),
        F.coalesce("declared_debits", "d").cast("decimal(25,2)").alias("debits"), F.coalesce("declared_credits", "c").cast("decimal(25,2)").alias("credits"),
        F.coalesce("entries", F.lit(0)).alias("entries"),
        (F.col("declared_debits").isNull() | (close("d", "declared_debits") & close("c", "declared_credits"))).alias("closes"),
    )


def heads(cells: DataFrame) -> DataFrame:
    """file, company, tax_id, first and last day of each workbook, from its first lines; what isn't there is empty or null.

    The company is the first text beside its label that is no page mark; of several periods the last counts.
    `cells` are those of `tables.cells`, rows of `tables.lines`, or what `rows_of` gives.
    """
    if "top" in cells.columns:
        top = cells.select("file", "row", F.col("top").alias("cells"))
    else:
        top = lines_of(cells).filter("error IS NULL").select("file", "row", F.when(F.col("row") <= HEAD_WITHIN, F.col("cells")).alias("cells"))
    texts = F.transform("cells", lambda c: F.struct(c["col"].alias("col"), stripped(c["text"]).alias("text")))
    found = top.withColumn("texts", F.reverse(F.filter(texts, lambda c: c["text"] != "")))
    beside = F.filter("texts", lambda c: (c["col"] > 1) & ~c["text"].startswith("Folha"))
    lines = found.select("file", "row", F.when(F.size("texts") > 0, F.array_join("texts.text", " ")).alias("line"), F.get(beside, F.lit(0))["text"].alias("beside"))
    line = F.col("line")
    after = F.when(F.instr(line, ":") > 0, F.expr("substring(line, instr(line, ':') + 1)")).otherwise(line)
    tax_id = F.when(line.contains(TAX_ID), F.nullif(stripped(F.regexp_extract(after, TAX_ID_SHAPE, 0)), F.lit("")))
    company = F.when(line.startswith(COMPANY), F.col("beside"))
    period = line.startswith(PERIOD) & line.rlike(PERIOD_SHAPE)
    day = lambda i: F.when(period, F.try_to_timestamp(F.regexp_extract(line, PERIOD_SHAPE, i), F.lit("dd/MM/yyyy")).cast("date"))
    told = lines.select("file", "row", company.alias("company"), tax_id.alias("tax_id"), period.alias("period"), day(1).alias("first"), day(2).alias("last"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row")))
    last = lambda c: F.max_by(c, F.when(F.col("period"), F.col("row")))
    empty = lambda c: F.coalesce(first(c), F.lit("")).alias(c)
    return told.groupBy("file").agg(empty("company"), empty("tax_id"), last("first").alias("first"), last("last").alias("last"))


def without_header(cells: DataFrame) -> DataFrame:
    """Files in which no row names both a debit and a credit column, or that are no workbooks, and why."""
    lines = lines_of(cells).withColumn("texts", texts_of(F.col("cells")))
    head = F.when(F.col("row") <= HEADER_WITHIN, header(F.col("cells"), F.col("texts")))
    found = lines.select("file", "error", head.isNotNull().alias("has")).groupBy("file", "error").agg(F.max("has").alias("has"))
    return found.filter("error IS NOT NULL OR NOT has").select("file", F.coalesce("error", F.lit("no header")).alias("error"))
