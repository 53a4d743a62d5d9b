"""Ledgers in workbooks and aligned text, model output, uploads, and repairs of rows stored before."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..domain import Ledger
from ..functions import dates, hashing, numbers, text
from ..operators import aligned, ledger, uploads
from ..scratch import folder, stored
from ..sources import ledger_sheet, model_items, packed, tables
from .registry import query

#: entries of a supplier that stand in one made file
FILED = 40
NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY moment, invoice, line, part, quantity, credit, debit) - 1 AS k FROM entries)"""


def numbered(t: Ledger) -> DataFrame:
    """Entries of each supplier with their place and the made file that they stand in."""
    order = W.partitionBy("supplier_id").orderBy("moment", "invoice", "line", "part", "quantity", "credit", "debit")
    return t.entries.withColumn("k", F.row_number().over(order) - 1)


def sheets(t: Ledger) -> DataFrame:
    """A workbook of two suppliers' blocks for each range of their entries; balances and totals are declared."""
    rows = numbered(t).select(
        (F.floor((F.col("supplier_id") - 1) / 2) * 1_000_000 + F.floor(F.col("k") / FILED)).alias("file"),
        "supplier_id", "k", F.to_date("moment").alias("day"), F.concat(F.lit("NF "), F.lpad("invoice", 6, "0")).alias("history"), "debit", "credit",
    )

    def book(name: int, entries: list[tuple]) -> bytes:
        out: list[list] = [["Empresa:", None, f"Made {name}", "Folha: 1"], [f"C.N.P.J.: {abs(name):014d}"], ["Período: 01/01/2024 - 31/12/2024"], ["Data", "Número", "Histórico", "Cta.C.Part.", "Débito", "Crédito", "Saldo-Exercício"]]
        for supplier, block in groupby(entries, key=itemgetter(1)):
            out.append(["Conta:", supplier, "2.1.3", None, "A NAME", "1.2"])
            out.append([None, None, "SALDO ANTERIOR", None, None, None, -10.5])
            debits = credits = 0
            for _, _, k, day, history, debit, credit in block:
                out.append([day, float(k), history, 5, str(debit) if debit else None, credit or None, 1])
                debits, credits = debits + debit, credits + credit
            # the totals of every third supplier are off
            off = 1 if supplier % 3 == 0 else 0
            out.append(["Total da conta:", None, None, None, debits + off, credits])
        return tables.sheet_bytes(out)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        books = ((name, book(name, list(own))) for name, own in groupby(entries, key=itemgetter(0)))
        return packed.batches(books, pa.schema([("file", pa.int64()), ("content", pa.binary())]))

    # a file's rows are dealt to one task and stand together there
    return rows.repartition("file").sortWithinPartitions("file", "supplier_id", "k").mapInArrow(build, "file long, content binary")


@query("src08_workbook_entries", f"""WITH {NUMBERED} SELECT CAST(supplier_id AS VARCHAR) AS code, CAST(moment AS DATE) AS day, CAST(k AS VARCHAR) AS lot, 'NF ' || lpad(invoice, 6, '0') AS history, '5' AS counterpart,
    debit, credit, CAST(1 AS DECIMAL(15,2)) AS balance, 'D' AS side, lpad(invoice, 6, '0') AS invoice, CASE WHEN debit > 0 THEN 'PAGAMENTO' ELSE 'COMPRA' END AS kind FROM numbered WHERE debit + credit > 0""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    found = ledger_sheet.entries(ledger_sheet.rows_of(tables.lines(sheets(t))))
    return found.select("code", "day", "lot", "history", "counterpart", "debit", "credit", "balance", "side", "invoice", "kind")


@query("src08_workbook_suppliers", f"""WITH {NUMBERED}, s AS (SELECT supplier_id, k // {FILED} AS part, sum(debit) AS d, sum(credit) AS c, count(*) FILTER (debit + credit > 0) AS n FROM numbered GROUP BY ALL)
    SELECT CAST(supplier_id AS VARCHAR) AS code, '2.1.3' AS account, 'A NAME' AS name, CAST(10.5 AS DECIMAL(15,2)) AS opening, 'C' AS opening_side,
    CAST(d + CASE WHEN supplier_id % 3 = 0 THEN 1 ELSE 0 END AS DECIMAL(25,2)) AS debits, CAST(c AS DECIMAL(25,2)) AS credits, n AS entries, supplier_id % 3 <> 0 AS closes FROM s""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    rows = ledger_sheet.rows_of(tables.lines(sheets(t)))
    return ledger_sheet.suppliers(rows, ledger_sheet.entries(rows)).drop("file", "block")


def on_disk(t: Ledger, files: DataFrame, ending: str) -> str:
    """The folder that the files of (file, content) have been written to."""
    packed.register(t.spark)
    path = folder(t.spark)
    named = files.select(F.concat(F.col("file").cast("string"), F.lit(ending)).alias("file"), "content")
    named.write.format("files").mode("append").option("path", path).save()
    return path


def workbooks_on_disk(t: Ledger) -> DataFrame:
    return t.spark.read.format("workbook_lines").option("path", on_disk(t, sheets(t), ".xlsx")).load()


@query("src08_workbooks_on_disk", f"""WITH {NUMBERED}, s AS (SELECT supplier_id, CAST(floor((supplier_id - 1) / 2.0) AS BIGINT) * 1000000 + k // {FILED} AS f, count(*) FILTER (debit + credit > 0) AS n FROM numbered GROUP BY ALL)
    SELECT CAST(f AS VARCHAR) || '.xlsx' AS file, CAST(supplier_id AS VARCHAR) AS code, n AS entries, 'Made ' || CAST(f AS VARCHAR) AS company, lpad(CAST(abs(f) AS VARCHAR), 14, '0') AS tax_id,
    DATE '2024-01-01' AS first, DATE '2024-12-31' AS last, supplier_id % 3 <> 0 AS closes FROM s""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    """Workbooks as files: heads and blocks of what a folder holds."""
    rows = ledger_sheet.rows_of(workbooks_on_disk(t))
    found = ledger_sheet.suppliers(rows, ledger_sheet.entries(rows)).select("file", "code", "entries", "closes")
    return found.join(ledger_sheet.heads(rows), "file")


def chart_workbooks(t: Ledger) -> DataFrame:
    """Each company's chart as a workbook, with one of the headers that are known."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        company = int(frame["company_id"].iloc[0])
        head = [["Codigo", "Descrição", "Tipo", "S/A"], ["CLASSIFICAÇÃO", "nome", "type", "sa"]][company % 2]
        rows = [[r.code, f" {r.label} ", r.kind, None] for r in frame.sort_values("code").itertuples()]
        return pd.DataFrame({"file": [company], "content": [tables.sheet_bytes([head, [], *rows])]})

    return t.charts.groupBy("company_id").applyInPandas(build, "file long, content binary")


@query("src09_chart_workbooks", """SELECT CAST(company_id AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY company_id ORDER BY code) + 2 AS INTEGER) AS line, code, label, kind, CAST(NULL AS VARCHAR) AS kind_sa FROM charts""")
def _(t: Ledger) -> DataFrame:
    return tables.chart_sheets(tables.cells(chart_workbooks(t)))[0]


HEADER = "Data       Lote   Histórico                Cta.C.Part.        Débito       Crédito    Saldo-Exercício"


def printed(t: Ledger) -> DataFrame:
    """Aligned text of supplier ledgers, a file for each range of a supplier's entries; long texts go on in the next line."""
    rows = numbered(t).withColumns({"file": F.concat_ws("/", "supplier_id", F.floor(F.col("k") / FILED).cast("string")), "block": F.lit(1)})
    shown = lambda c: F.lpad(F.when(F.col(c) > 0, numbers.brazilian(F.col(c))).otherwise(""), 13, " ")
    head = F.rpad(F.concat(F.date_format("moment", "dd/MM/yyyy"), F.lit(" "), F.rpad(F.col("k").cast("string"), 6, " "), F.lit(" "), F.rpad(F.concat(F.lit("REF NF "), F.lpad("invoice", 6, "0")), 24, " "), F.lit(" 77")), 55, " ")
    line = F.concat(head, shown("debit"), F.lit(" "), shown("credit"), F.lpad(F.lit("1,00C"), 20, " "))
    n = F.col("k") * 2 + 10
    lines = rows.select("file", "block", F.inline(F.array(F.struct(n.alias("n"), line.alias("text")), F.struct((n + 1).alias("n"), F.lit("     goes on").alias("text")))))
    sums = rows.groupBy("file", "block").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.max("k").alias("k"), F.max("supplier_id").alias("s"))
    off = F.when(F.col("s") % 3 == 0, 1).otherwise(0)
    total = F.concat(F.lit("Total da conta:   "), numbers.brazilian((F.col("d") + off).cast("decimal(25,2)")), F.lit("   "), numbers.brazilian(F.col("c")))
    more = F.array(
        F.struct(F.lit(1).cast("long").alias("n"), F.lit("Conta: 7 - NAME").alias("text")), F.struct(F.lit(2).cast("long").alias("n"), F.lit(HEADER).alias("text")),
        F.struct(F.lit(3).cast("long").alias("n"), F.lit("           SALDO ANTERIOR      12,50D").alias("text")),
        F.struct((F.col("k") * 2 + 12).cast("long").alias("n"), total.alias("text")),
    )
    return lines.select("file", "block", F.col("n").cast("long").alias("n"), "text").unionByName(sums.select("file", "block", F.inline(more)))


@query("f01_aligned_entries", f"""WITH {NUMBERED} SELECT CAST(supplier_id AS VARCHAR) || '/' || CAST(k // {FILED} AS VARCHAR) AS file, CAST(moment AS DATE) AS day, CAST(k AS VARCHAR) AS lot,
    'REF NF ' || lpad(invoice, 6, '0') || ' goes on' AS history, '77' AS counterpart, debit, credit, CAST(1 AS DECIMAL(15,2)) AS balance, 'C' AS side, lpad(invoice, 6, '0') AS invoice,
    CASE WHEN debit > 0 THEN 'PAGAMENTO' ELSE 'COMPRA' END AS kind FROM numbered WHERE debit + credit > 0""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    found = aligned.entries(printed(t))
    return found.select("file", "day", "lot", "history", "counterpart", "debit", "credit", "balance", "side", "invoice", "kind")


@query("f01_proved_blocks", f"""WITH {NUMBERED} SELECT CAST(supplier_id AS VARCHAR) || '/' || CAST(k // {FILED} AS VARCHAR) AS file, CAST(12.5 AS DECIMAL(25,2)) AS opening, 'D' AS opening_side,
    CAST(sum(debit) + CASE WHEN supplier_id % 3 = 0 THEN 1 ELSE 0 END AS DECIMAL(25,2)) AS debits, CAST(sum(credit) AS DECIMAL(25,2)) AS credits, count(*) FILTER (debit + credit > 0) AS entries, supplier_id % 3 <> 0 AS proved
    FROM numbered GROUP BY supplier_id, k // {FILED}""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    lines = stored(printed(t))  # read for its entries and for what it declares
    return aligned.checked(lines, aligned.entries(lines)).drop("block")


@query("f10_sides_by_position", f"""WITH {NUMBERED} SELECT CAST(supplier_id AS VARCHAR) || '/' || CAST(k // {FILED} AS VARCHAR) AS file, CAST(k AS VARCHAR) AS lot, debit, credit, CASE WHEN debit > 0 THEN 'PAGAMENTO' ELSE 'COMPRA' END AS kind
    FROM numbered WHERE debit + credit > 0""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    """A model has taken every debit for a credit."""
    lines = printed(t)
    found = stored(aligned.entries(lines).select("file", "block", "n", "day", "lot", "debit", "credit"))
    zero = F.lit(0).cast("decimal(15,2)")
    read = found.select("file", "block", "n", "day", "lot", zero.alias("debit"), (F.col("debit") + F.col("credit")).cast("decimal(15,2)").alias("credit"), F.lit("COMPRA").alias("kind"))
    return aligned.by_position(read, lines, found).select("file", "lot", "debit", "credit", "kind")


@query("fn32_repeated_phrases", """SELECT tx_id, h || ' ' || CAST(tx_id AS VARCHAR) || repeat(' ', length(h) + 2) || '9' || CASE WHEN tx_id % 2 = 0 THEN repeat(' ', length(h) + 2) || '1,00C' ELSE '' END AS text
    FROM (SELECT tx_id, 'VLR REF PGTO ' || history AS h FROM transactions)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    h = F.concat(F.lit("VLR REF PGTO "), "history")
    line = F.concat(h, F.lit(" "), F.col("tx_id").cast("string"), F.lit(" "), h, F.lit(" 9 "), h, F.when(F.col("tx_id") % 2 == 0, " 1,00C").otherwise(""))
    return ledger.clean_lines(t.transactions.select("tx_id", line.alias("text")))


@query("fn17_iso_moments", """SELECT tx_id, CASE WHEN tx_id % 3 = 2 THEN date_trunc('day', moment) ELSE moment END AS moment, CAST(moment AS DATE) AS day FROM transactions""")
def _(t: Ledger) -> DataFrame:
    k = F.col("tx_id") % 3
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    xml = (
        F.when(k == 0, F.concat(F.date_format(F.col("moment") - F.expr("INTERVAL 3 HOUR"), iso), F.lit("-03:00")))
        .when(k == 1, F.date_format("moment", iso))
        .otherwise(F.date_format("moment", "yyyy-MM-dd"))
    )
    model = F.when(k == 0, F.date_format("moment", "dd/MM/yyyy")).when(k == 1, F.date_format("moment", "yyyy-MM-dd")).otherwise(F.date_format("moment", "dd-MM-yyyy"))
    return t.transactions.select("tx_id", dates.xml_timestamp(xml).alias("moment"), dates.model_date(model).cast("date").alias("day"))


@query("fn25_statement_fitids", r"""SELECT tx_id, 'PDF' || upper(left(md5(strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+00:00' || history || regexp_replace(CAST(amount AS VARCHAR), '0$', '') || CAST(tx_id % 100 AS VARCHAR)), 12)) AS fitid FROM transactions""")
def _(t: Ledger) -> DataFrame:
    c = F.col
    return t.transactions.select("tx_id", hashing.statement_fitid(c("moment"), c("history"), c("amount"), c("tx_id") % 100).alias("fitid"))


@query("fn30_account_parts", """SELECT bank_id, CASE WHEN bank_id % 5 = 0 THEN NULL ELSE acronym || ' DIGITAL' END AS bank, CASE WHEN bank_id % 5 = 0 THEN NULL ELSE branch END AS branch,
    CASE WHEN bank_id % 5 = 0 THEN NULL ELSE number END AS number, CASE WHEN bank_id % 5 = 0 THEN NULL ELSE left(digit || 'abcdef', 5) END AS digit FROM banks""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    whole = F.concat_ws("  ", F.concat("acronym", F.lit(" DIGITAL")), "branch", "number", F.concat("digit", F.lit("abcdef")))
    raw = F.when(F.col("bank_id") % 5 == 0, F.concat("acronym", F.lit(" x"))).otherwise(whole)
    parts = text.account_parts(raw)
    return t.banks.select("bank_id", *[parts[n].alias(n) for n in ("bank", "branch", "number", "digit")])


@query("f16_model_items", """SELECT CAST(bank_id AS VARCHAR) AS file, tx_id AS n, CAST(moment AS DATE) AS date, CAST(CASE WHEN dc = 'D' THEN -amount ELSE amount END AS DECIMAL(15,2)) AS amount,
    CASE WHEN tx_id % 4 = 0 THEN 'SEM DESCRIÇÃO' ELSE history END AS history, CASE WHEN dc = 'D' THEN 'DEBIT' ELSE 'CREDIT' END AS kind FROM transactions WHERE tx_id % 7 <> 6""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    """Items under several names, with amounts in two dialects and sides as words; those without an amount go."""
    c, k = F.col, F.col("tx_id")
    day = F.when(k % 2 == 0, F.date_format("moment", "yyyy-MM-dd")).otherwise(F.date_format("moment", "dd/MM/yyyy"))
    amount = F.when(k % 7 == 6, "").when(k % 3 == 0, F.concat(F.lit("R$ "), numbers.brazilian(c("amount")))).otherwise(c("amount").cast("string"))
    history = F.when(k % 4 == 0, " ").otherwise(c("history"))
    side = F.when(c("dc") == "D", F.when(k % 2 == 0, "saida").otherwise("D")).otherwise("credit")
    one = F.to_json(F.struct(day.alias("date"), history.alias("memo"), amount.alias("valor"), side.alias("tipo")))
    other = F.to_json(F.struct(day.alias("dt"), history.alias("details"), amount.alias("amount"), side.alias("type")))
    items = t.transactions.select(c("bank_id").cast("string").alias("file"), k.alias("n"), F.when(k % 5 < 2, one).otherwise(other).alias("item"))
    return model_items.transactions(items, 2000).drop("fitid")


@query("f12_upload_outcomes", """SELECT company_id, sha256(CAST(tx_id AS VARCHAR)) AS hash, CASE WHEN tx_id % 5 > 0 THEN tx_id END AS file_id,
    CASE tx_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'running' WHEN 3 THEN 'refused' ELSE 'again' END AS outcome FROM transactions""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("tx_id")
    content = k.cast("string").cast("binary")
    state = F.when(k % 5 < 3, "PROCESSANDO").when(k % 5 == 3, "CONCLUIDO").otherwise("ERRO")
    there = t.transactions.filter("tx_id % 5 > 0").select("company_id", F.sha2(content, 256).alias("hash"), k.alias("file_id"), state.alias("state"), F.when(k % 5 != 2, k % 5).alias("suppliers"))
    return uploads.upload_outcomes(t.transactions.select("company_id", content.alias("content")), there)


FILES = """files AS (SELECT company_id AS file_id, CASE WHEN company_id % 7 = 0 THEN '' ELSE left(tax_id, 2) || '.' || right(tax_id, 12) END AS tax_id FROM companies),
    known AS (SELECT company_id, tax_id FROM companies UNION ALL SELECT company_id + 100, tax_id FROM companies WHERE company_id % 8 = 1),
    owned AS (SELECT company_id AS file_id, company_id FROM companies WHERE company_id % 7 <> 0 AND company_id % 8 <> 1)"""


def files(t: Ledger) -> tuple[DataFrame, DataFrame]:
    k = F.col("company_id")
    masked = F.concat(F.left("tax_id", F.lit(2)), F.lit("."), F.right("tax_id", F.lit(12)))
    known = t.companies.select("company_id", "tax_id")
    twins = known.filter(k % 8 == 1).select((k + 100).alias("company_id"), "tax_id")
    return t.companies.select(k.alias("file_id"), F.when(k % 7 == 0, "").otherwise(masked).alias("tax_id")), known.unionByName(twins)


@query("jn17_file_owners", f"WITH {FILES} SELECT file_id, company_id, NULL AS problem FROM owned UNION ALL SELECT file_id, NULL, 'no owner' FROM files WHERE file_id NOT IN (SELECT file_id FROM owned)")
def _(t: Ledger) -> DataFrame:
    found = uploads.owners(*files(t)).withColumn("problem", F.lit(None).cast("string"))
    none = uploads.without_owner(*files(t)).select("file_id", F.lit(None).cast("int").alias("company_id"), F.lit("no owner").alias("problem"))
    return found.unionByName(none)


@query("jn17_owners_of_entries", f"""WITH {FILES} SELECT company_id, count(*) AS entries FROM entries JOIN (SELECT supplier_id, CAST(supplier_id % 25 AS INTEGER) AS file_id FROM suppliers) USING (supplier_id) JOIN owned USING (file_id) GROUP BY 1""")
def _(t: Ledger) -> DataFrame:
    own = uploads.carried_down(t.suppliers.select("supplier_id", (F.col("supplier_id") % 25).alias("file_id")), uploads.owners(*files(t)), "file_id")
    return uploads.carried_down(t.entries, own, "supplier_id").groupBy("company_id").agg(F.count("*").alias("entries"))


@query("jn18_by_either_key", """WITH k AS (SELECT code AS number, 'c' || left(code, 1) AS class, label, CAST(row_number() OVER (ORDER BY code) AS INTEGER) AS place FROM accounts WHERE NOT deleted),
    r AS (SELECT code FROM accounts UNION ALL SELECT 'c' || CAST(d AS VARCHAR) FROM range(0, 9) v(d)), f AS (SELECT class, arg_min(label, place) AS label FROM k GROUP BY 1)
    SELECT r.code, coalesce(k.label, f.label) AS label, CASE WHEN k.label IS NOT NULL THEN 'number' WHEN f.label IS NOT NULL THEN 'class' END AS by FROM r LEFT JOIN k ON r.code = k.number LEFT JOIN f ON r.code = f.class""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    place = F.row_number().over(W.orderBy("code"))
    known = t.accounts.filter("NOT deleted").select(F.col("code").alias("number"), F.concat(F.lit("c"), F.left("code", F.lit(1))).alias("class"), "label", place.alias("place"))
    rows = t.accounts.select("code").unionByName(t.spark.range(9).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("code")))
    return uploads.by_either_key(rows, known, "code", "number", "class")


@query("ag19_new_by_hash", """SELECT company_id, CAST(count(*) * 2 AS BIGINT) AS total, count(*) FILTER (status = 'pendente') AS imported, CAST(count(*) * 2 - count(*) FILTER (status = 'pendente') AS BIGINT) AS duplicates
    FROM transactions GROUP BY 1""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    hashed = t.transactions.select("company_id", "status", hashing.statement_hash(F.col("company_id"), F.col("bank_id"), F.col("tx_id").cast("string")).alias("hash"))
    return uploads.new_by_hash(hashed.unionByName(hashed), hashed.filter("status = 'processada'"), ["hash"])


@query("mg02_invoice_identities", r"""WITH i AS (SELECT invoice_id + copy * 1000000000 AS invoice_id, copy, company_id, kind, issuer, number, series, amount, issued, CASE WHEN invoice_id % 5 = 0 THEN left(access_key, 40) ELSE access_key END AS given,
        CASE WHEN invoice_id % 5 = 0 THEN NULL ELSE access_key END AS key FROM invoices, (VALUES (0), (1)) v(copy)),
    h AS (SELECT *, sha256(CASE WHEN kind = 'nfe' AND key IS NOT NULL THEN 'nfe|' || key ELSE CASE kind WHEN 'nfe' THEN 'nfe-sem-chave' ELSE 'nfse' END || '|' || regexp_replace(issuer, '\D', '', 'g') || '|' || number || '|'
        || series || '|' || CAST(amount AS VARCHAR) || '|' || strftime(issued, '%Y-%m-%dT%H:%M:%S') || '+00:00' END) AS h FROM i)
    SELECT invoice_id, company_id, CASE WHEN copy = 0 THEN h ELSE sha256('duplicata-legada|' || CAST(invoice_id AS VARCHAR) || '|' || h) END AS dedup_key, CASE WHEN copy = 0 THEN key END AS access_key FROM h""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("invoice_id")
    rows = t.invoices.withColumn("access_key", F.when(k % 5 == 0, F.left("access_key", F.lit(40))).otherwise(F.col("access_key")))
    return uploads.backfilled(rows.unionByName(rows.withColumn("invoice_id", k + 1_000_000_000)))
