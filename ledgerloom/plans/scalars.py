"""Scalar rules over text made from the tables; what is formatted must parse back to the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import Ledger
from ..functions import dates, hashing, numbers, taxid, text
from .registry import query

AMOUNT = "SELECT tx_id, amount AS value FROM transactions"


def parsed(t: Ledger, shown: Column, parse) -> DataFrame:
    return t.transactions.withColumn("shown", shown).select("tx_id", parse(F.col("shown")).alias("value"))


def english(c: Column) -> Column:
    return F.format_number(c, 2)


@query("fn01_month_key", "SELECT tx_id, strftime(moment, '%Y-%m') AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    return t.transactions.select("tx_id", dates.month_key(F.col("moment")).alias("value"))


@query("fn02_digits_only", "SELECT tx_id, regexp_replace(history || CAST(tx_id AS VARCHAR), '[^0-9]', '', 'g') AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    return t.transactions.select("tx_id", text.digits_only(F.concat("history", F.col("tx_id").cast("string"))).alias("value"))


@query("fn03_tax_id_mask", """SELECT company_id, left(tax_id, 2) || '.' || substr(tax_id, 3, 3) || '.' || substr(tax_id, 6, 3) || '/' || substr(tax_id, 9, 4)
    || '-' || right(tax_id, 2) AS masked FROM companies""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return t.companies.select("company_id", taxid.masked(F.col("tax_id")).alias("masked"))


@query("fn04_tax_id_valid", "SELECT company_id, company_id % 4 <> 3 AS valid FROM companies")
def _(t: Ledger) -> DataFrame:
    return t.companies.select("company_id", taxid.is_valid(F.col("tax_id")).alias("valid"))


@query("fn05_normal_history", "SELECT tx_id, lower(history) AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.col("history"), F.lit(" \r\n"))
    return t.transactions.select("tx_id", text.normal_history(padded).alias("value"))


@query("fn06_plain_name", "SELECT bank_id, 'ACAO ' || acronym AS value FROM banks")
def _(t: Ledger) -> DataFrame:
    return t.banks.select("bank_id", text.plain_name(F.concat(F.lit(" ação \t "), F.lower("acronym"), F.lit(" "))).alias("value"))


@query("fn07_alnum_name", "SELECT bank_id, acronym || ' LTDA ' || number AS value FROM banks")
def _(t: Ledger) -> DataFrame:
    shown = F.concat(F.lower("acronym"), F.lit(" & (ltda.)  "), "number", F.lit("/"))
    return t.banks.select("bank_id", text.alnum_name(shown).alias("value"))


@query("fn08_jaccard", """WITH s AS (SELECT tx_id, list_distinct(string_split(history, ' ')) AS a, ['5-LOW', 'MACHINERY', 'X'] AS b FROM transactions)
    SELECT tx_id, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS value FROM s""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    other = F.array(F.lit("5-LOW"), F.lit("MACHINERY"), F.lit("X"))
    return t.transactions.select("tx_id", text.jaccard(text.word_set(F.col("history")), other).alias("value"))


@query("fn09_number_ledger_text", AMOUNT)
def _(t: Ledger) -> DataFrame:
    return parsed(t, F.concat(F.lit(" "), numbers.brazilian(F.col("amount")), F.lit(" ")), numbers.ledger_text)


@query("fn10_number_sheet_cell", "SELECT tx_id, CASE WHEN tx_id % 3 = 2 THEN -amount ELSE amount END AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    a, k = F.col("amount"), F.col("tx_id") % 3
    shown = F.when(k == 0, numbers.brazilian(a)).when(k == 1, english(a)).otherwise(F.concat(F.lit("("), numbers.brazilian(a), F.lit(")")))
    return parsed(t, shown, numbers.sheet_cell)


@query("fn11_number_card", AMOUNT)
def _(t: Ledger) -> DataFrame:
    a = F.col("amount")
    shown = F.when(F.col("tx_id") % 2 == 0, F.concat(F.lit("R$ "), numbers.brazilian(a))).otherwise(english(a))
    return parsed(t, shown, numbers.card_amount)


@query("fn12_number_statement", "SELECT tx_id, CASE WHEN tx_id % 2 = 0 THEN -amount ELSE amount END AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    a, k = F.col("amount"), F.col("tx_id") % 4
    shown = (
        F.when(k == 0, F.concat(F.lit("-"), english(a)))
        .when(k == 1, numbers.brazilian(a))
        .when(k == 2, F.concat(F.lit("(R$ "), numbers.brazilian(a), F.lit(")")))
        .otherwise(a.cast("string"))
    )
    return parsed(t, shown, numbers.statement_amount)


@query("fn13_number_ofx", AMOUNT)
def _(t: Ledger) -> DataFrame:
    a = F.col("amount")
    shown = F.when(F.col("tx_id") % 2 == 0, numbers.brazilian(a)).otherwise(a.cast("string"))
    return parsed(t, shown, numbers.ofx_amount)


@query("fn14_ofx_timestamp", "SELECT tx_id, moment AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    at, k = F.col("moment"), F.col("tx_id") % 4
    west = F.concat(F.date_format(at - F.expr("INTERVAL 3 HOUR"), "yyyyMMddHHmmss"), F.lit("[-3:BRT]"))
    shown = (
        F.when(k == 0, F.date_format(at, "yyyyMMdd"))
        .when(k == 1, F.date_format(at, "yyyyMMddHHmm"))
        .when(k == 2, F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit(".000")))
        .otherwise(west)
    )
    return parsed(t, shown, dates.ofx_timestamp)


@query("fn15_card_date", "SELECT tx_id, moment AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    at, k = F.col("moment"), F.col("tx_id") % 5
    formats = ["dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yy", "yyyy/MM/dd"]
    # two digits of a year are of this century
    shown = F.coalesce(*[F.when((k == i) & ((F.year(at) >= 2000) | F.lit(f != "dd/MM/yy")), F.date_format(at, f)) for i, f in enumerate(formats)], F.date_format(at, formats[0]))
    return t.transactions.withColumn("shown", shown).select("tx_id", dates.card_date(F.col("shown")).alias("value"))


@query("fn16_statement_date", "SELECT tx_id, DATE '2000-01-01' + CAST(tx_id % 366 AS INTEGER) AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    at, k = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("tx_id") % 366).cast("int")), F.col("tx_id") % 3
    shown = F.when(k == 0, F.date_format(at, "dd/MM/yyyy")).when(k == 1, F.date_format(at, "dd-MM-yy")).otherwise(F.date_format(at, "dd/MM"))
    rows = t.transactions.withColumn("shown", F.concat(shown, F.lit(" TED")))
    return rows.select("tx_id", dates.statement_date(F.col("shown"), 2000).alias("value"))


@query("fn18_invoice_number", "SELECT tx_id, CASE WHEN tx_id + 1000 >= 1000 THEN CAST(tx_id + 1000 AS VARCHAR) END AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    n, k = (F.col("tx_id") + 1000).cast("string"), F.col("tx_id") % 5
    shown = (
        F.when(k == 0, F.concat(F.lit("compra conf. NF N. "), n).cast("string"))
        .when(k == 1, F.concat(F.lit("VLR REF REF "), n))
        .when(k == 2, F.concat(F.lit("CT-e "), n, F.lit(" frete")))
        .when(k == 3, F.concat(F.lit("nota fiscal "), n))
        .otherwise(F.concat(F.lit("CONF. NFS "), n))
    )
    shown = F.when(k == 0, F.concat(F.lit("compra NF "), n)).otherwise(shown)
    return t.transactions.withColumn("shown", shown).select("tx_id", text.invoice_number(F.col("shown")).alias("value"))


@query("fn19_tax_id_in_text", """SELECT company_id, left(tax_id, 2) || '.' || substr(tax_id, 3, 3) || '.' || substr(tax_id, 6, 3) || '/' || substr(tax_id, 9, 4)
    || '-' || right(tax_id, 2) AS found FROM companies""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    shown = F.concat(F.lit("PGTO "), taxid.masked(F.col("tax_id")), F.lit(" ref"))
    return t.companies.select("company_id", taxid.in_text(shown).alias("found"))


@query("fn20_operation_kind", """SELECT tx_id, CASE tx_id % 7 WHEN 0 THEN 'PAGAMENTO' WHEN 1 THEN 'DEVOLUCAO' WHEN 2 THEN 'DEBITO' WHEN 3 THEN 'COMPRA'
    WHEN 4 THEN 'ADIANTAMENTO' WHEN 5 THEN 'CREDITO' ELSE 'OUTRO' END AS value FROM transactions""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("tx_id") % 7
    h = F.element_at(F.array(*map(F.lit, ["pgto boleto", "estorno", "tarifa", "serviço", "adto", "juros", "saldo"])), (k + 1).cast("int"))
    debit, credit = F.when(k <= 2, F.col("amount")).otherwise(0), F.when((k > 2) & (k < 6), F.col("amount")).otherwise(0)
    return t.transactions.select("tx_id", text.operation_kind(h, debit, credit).alias("value"))


@query("fn21_invoice_series", "SELECT tx_id, CASE WHEN tx_id % 3 = 2 THEN '' ELSE 'A' || CAST(tx_id % 9 AS VARCHAR) END AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    s, k = F.concat(F.lit("a"), (F.col("tx_id") % 9).cast("string")), F.col("tx_id") % 3
    shown = F.when(k == 0, F.concat(F.lit("NF 1 SERIE "), s)).when(k == 1, F.concat(F.lit("nf 2 ser. nº: "), s)).otherwise("NF 3")
    return t.transactions.select("tx_id", text.invoice_series(shown).alias("value"))


@query("fn22_statement_hash", """SELECT tx_id, sha256('{"agencia_id": "' || CAST(bank_id AS VARCHAR) || '", "empresa_id": "' || CAST(company_id AS VARCHAR)
    || '", "fitid": "F' || CAST(tx_id AS VARCHAR) || '"}') AS hash FROM transactions""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    fitid = F.concat(F.lit("F"), F.col("tx_id").cast("string"))
    return t.transactions.select("tx_id", hashing.statement_hash(F.col("company_id"), F.col("bank_id"), fitid).alias("hash"))


@query("fn23_feed_hash", "SELECT tx_id, sha256(CAST(bank_id AS VARCHAR) || CAST(tx_id AS VARCHAR)) AS hash FROM transactions")
def _(t: Ledger) -> DataFrame:
    return t.transactions.select("tx_id", hashing.feed_hash(F.col("bank_id"), F.col("tx_id")).alias("hash"))


IDENTITY = """SELECT invoice_id, sha256(CASE WHEN kind = 'nfe' AND invoice_id % 5 <> 0 THEN 'nfe|' || lpad(CAST(invoice_id AS VARCHAR), 44, '0')
    ELSE CASE WHEN kind = 'nfe' THEN 'nfe-sem-chave' ELSE 'nfse' END || '|' || regexp_replace(issuer, '[^0-9]', '', 'g') || '|' || number || '|' || series || '|'
    || CAST(amount AS VARCHAR) || '|' || strftime(issued, '%Y-%m-%dT%H:%M:%S') || '+00:00' END) AS identity FROM invoices"""


@query("fn24_invoice_identity", IDENTITY)
def _(t: Ledger) -> DataFrame:
    key = F.when(F.col("invoice_id") % 5 != 0, F.lpad(F.col("invoice_id").cast("string"), 44, "0"))
    c = F.col
    return t.invoices.select(
        "invoice_id", hashing.invoice_identity(c("kind"), key, c("issuer"), c("number"), c("series"), c("amount"), c("issued")).alias("identity")
    )


@query("fn27_uuid_of_md5", """SELECT bank_id, left(m, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || right(m, 12) AS id
    FROM (SELECT bank_id, md5(CAST(bank_id AS VARCHAR)) AS m FROM banks)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return t.banks.select("bank_id", hashing.uuid_of(F.col("bank_id").cast("string")).alias("id"))


@query("fn28_bank_ledger_code", "SELECT bank_id, '1.1.B.' || left(md5(CAST(bank_id AS VARCHAR)), 16) AS code FROM banks")
def _(t: Ledger) -> DataFrame:
    return t.banks.select("bank_id", hashing.ledger_code(hashing.uuid_of(F.col("bank_id").cast("string"))).alias("code"))


@query("fn29_kind_by_code", "SELECT code, kind FROM accounts")
def _(t: Ledger) -> DataFrame:
    return t.accounts.select("code", text.kind_by_code(F.col("code")).alias("kind"))


@query("fn31_bank_acronym", "SELECT company_id, CASE company_id % 4 WHEN 0 THEN 'BB' WHEN 1 THEN 'ITAU' WHEN 2 THEN 'NU' ELSE 'XYZ' END AS acronym FROM companies")
def _(t: Ledger) -> DataFrame:
    k = F.col("company_id") % 4
    code = F.when(k == 0, "001").when(k == 1, "341").when(k == 2, "260").otherwise(" xyz ")
    return t.companies.select("company_id", text.bank_acronym(code).alias("acronym"))


@query("fn34_truncation", "SELECT tx_id, left(history, 7) AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    return t.transactions.select("tx_id", F.left("history", F.lit(7)).alias("value"))


@query("fn35_first_alias", "SELECT tx_id, CASE WHEN tx_id % 2 = 0 THEN history ELSE dc END AS value FROM transactions")
def _(t: Ledger) -> DataFrame:
    first = F.when(F.col("tx_id") % 2 == 0, F.col("history")).otherwise("  ")
    return t.transactions.select("tx_id", F.coalesce(F.nullif(F.trim(first), F.lit("")), "dc").alias("value"))
