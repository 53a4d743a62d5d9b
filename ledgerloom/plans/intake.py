"""File formats round trip: rows are written as text in a format, parsed back and compared with themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import Ledger
from ..functions import numbers
from ..operators import ledger, repair
from ..scratch import folder, stored
from ..sources import invoice_xml, ofx, statement, tables
from ..streaming import feeds
from .imports import on_disk
from .registry import query


#: transactions in one statement, about
STATEMENT = 5_000


def account(file: str) -> Column:
    """The bank account that a statement's name begins with."""
    return F.substring_index(file, "/", 1)


def ofx_files(t: Ledger, xml: bool) -> DataFrame:
    """Statements of bounded length for each bank account, half of the blocks with Brazilian numbers and time zones."""
    even = F.col("tx_id") % 2 == 0
    raw = F.when(F.col("dc") == "D", -F.col("amount")).otherwise(F.col("amount"))
    posted = F.when(even, F.concat(F.date_format(F.col("moment") - F.expr("INTERVAL 3 HOUR"), "yyyyMMddHHmmss"), F.lit("[-3:BRT]"))).otherwise(
        F.date_format("moment", "yyyyMMdd")
    )
    amount = F.when(even, numbers.brazilian(raw)).otherwise(raw.cast("string"))
    end = (lambda n: f"</{n}>\n") if xml else (lambda n: "\n")
    fields = {"TRNTYPE": F.lit("OTHER"), "DTPOSTED": posted, "TRNAMT": amount, "FITID": F.concat(F.lit("F"), F.col("tx_id").cast("string")), "MEMO": F.col("history")}
    body = F.concat(*[x for n, c in fields.items() for x in (F.lit(f"<{n}>"), c, F.lit(end(n)))])
    block = F.concat(F.lit("<STMTTRN>\n"), body, F.lit("</STMTTRN>\n" if xml else ""))
    head = '<?xml version="1.0"?>\n<OFX><BANKTRANLIST>\n' if xml else "﻿OFXHEADER:100\n<OFX><BANKTRANLIST>\n"
    text = F.array_join(F.sort_array(F.collect_list(block)), "")
    rows = ledger.dealt(t.transactions, "bank_id", ["tx_id"], STATEMENT)
    grouped = rows.groupBy("bank_id", "_part").agg(F.concat(F.lit(head), text, F.lit("</BANKTRANLIST></OFX>")).alias("content"))
    return grouped.select(F.concat_ws("/", "bank_id", "_part").alias("file"), "content")


OFX = """SELECT CAST(bank_id AS VARCHAR) AS file, 'F' || CAST(tx_id AS VARCHAR) AS fitid, moment,
    CAST(CASE WHEN dc = 'D' THEN -amount ELSE amount END AS DECIMAL(15,2)) AS amount, dc, history FROM transactions"""


@query("src03_ofx_sgml", OFX)
def _(t: Ledger) -> DataFrame:
    return ofx.transactions(ofx_files(t, False)).filter("error IS NULL").select(account("file").alias("file"), "fitid", "moment", "amount", "dc", "history")


@query("src04_ofx_xml", OFX)
def _(t: Ledger) -> DataFrame:
    return ofx.transactions(ofx_files(t, True)).filter("error IS NULL AND xml").select(account("file").alias("file"), "fitid", "moment", "amount", "dc", "history")


@query("src05_ofx_version", "SELECT CAST(bank_id AS VARCHAR) AS file, bank_id % 2 = 0 AS xml FROM (SELECT DISTINCT bank_id FROM transactions)")
def _(t: Ledger) -> DataFrame:
    even = account("file").cast("long") % 2 == 0
    files = ofx_files(t, True).filter(even).union(ofx_files(t, False).filter(~even))
    return files.select(account("file").alias("file"), ofx.is_xml(F.col("content")).alias("xml")).distinct()


def statement_lines(t: Ledger) -> DataFrame:
    """Statements of a bank account and day: one movement on a line, its description on the line before for some."""
    amount = F.when(F.col("dc") == "D", F.concat(F.lit("-"), numbers.brazilian(F.col("amount")))).otherwise(numbers.brazilian(F.col("amount")))
    k = F.col("tx_id") % 2 == 0
    date = F.date_format("moment", "dd/MM/yyyy")
    before = F.when(k, F.col("history"))
    line = F.concat_ws(" ", date, F.when(k, F.lit("4803")).otherwise(F.concat(F.lit("TED "), F.lower("history"))), amount, F.lit("1.000,00"))
    rows = t.transactions.select(
        F.concat_ws("/", "bank_id", F.date_format("moment", "yyyyMMdd")).alias("file"),
        "tx_id",
        F.posexplode(F.array(F.lit("Extrato de conta"), before, line)).alias("k", "text"),
    )
    return rows.select("file", (F.col("tx_id") * 3 + F.col("k")).alias("n"), F.coalesce("text", F.lit(" ")).alias("text"))


@query("f15_statement_lines", """SELECT CAST(bank_id AS VARCHAR) || '/' || strftime(moment, '%Y%m%d') AS file, tx_id * 3 + 2 AS n, CAST(moment AS DATE) AS date,
    CAST(CASE WHEN dc = 'D' THEN -amount ELSE amount END AS DECIMAL(15,2)) AS amount,
    CASE WHEN tx_id % 2 = 0 THEN history ELSE 'TED ' || lower(history) END AS history FROM transactions""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return statement.transactions(statement_lines(t), 2000)


@query("f14_statement_complete", """SELECT CAST(bank_id AS VARCHAR) || '/' || strftime(moment, '%Y%m%d') AS file, min(tx_id) % 4 IN (0, 3) AS complete FROM transactions GROUP BY 1""")
def _(t: Ledger) -> DataFrame:
    """A day's statement declares its balances, balances that are off, nothing, or its totals."""
    signed = F.when(F.col("dc") == "D", -F.col("amount")).otherwise(F.col("amount"))
    file = F.concat_ws("/", "bank_id", F.date_format("moment", "yyyyMMdd")).alias("file")
    positive = lambda side: F.sum(F.when(F.col("dc") == side, F.col("amount")).otherwise(0)).cast("decimal(25,2)")
    sums = t.transactions.groupBy(file).agg(F.sum(signed).cast("decimal(25,2)").alias("net"), positive("C").alias("c"), positive("D").alias("d"), F.min("tx_id").alias("k"), F.max("tx_id").alias("last"))
    k = F.col("k") % 4
    closing = F.lit(100).cast("decimal(25,2)") + F.col("net") + F.when(k == 1, 1).otherwise(0)
    shown = F.when(closing < 0, F.concat(numbers.brazilian(-closing), F.lit(" D"))).otherwise(F.concat(numbers.brazilian(closing), F.lit(" C")))
    first = F.when(k < 2, F.lit("Saldo anterior 100,00")).when(k == 3, F.concat(F.lit("Total de débitos "), numbers.brazilian(F.col("d")))).otherwise("nothing")
    last = F.when(k < 2, F.concat(F.lit("Saldo final "), shown)).when(k == 3, F.concat(F.lit("Total de créditos "), numbers.brazilian(F.col("c")))).otherwise("here")
    ends = sums.select("file", F.inline(F.array(F.struct((F.col("k") * 3 - 1).alias("n"), first.alias("text")), F.struct((F.col("last") * 3 + 3).alias("n"), last.alias("text")))))
    lines = statement_lines(t)
    return statement.complete(statement.transactions(lines, 2000), statement.declared(lines.unionByName(ends)))


def card_rows(t: Ledger) -> DataFrame:
    """Lines of card bills: two dialects, own ids for some, no description for others; all lines twice, and a line of another month."""
    k = F.col("tx_id")
    even = k % 2 == 0
    rows = t.transactions.select(
        F.concat_ws("/", "bank_id", F.date_format("moment", "yyyy-MM")).alias("bill"),
        "tx_id",
        F.when(even, F.date_format("moment", "dd/MM/yyyy")).otherwise(F.date_format("moment", "yyyy-MM-dd")).alias("date"),
        F.when(k % 10 != 3, F.concat_ws("  ", "history", k.cast("string"))).alias("description"),
        F.when(even, F.concat(F.lit("R$ "), numbers.brazilian(F.col("amount")))).otherwise(F.format_number("amount", 2)).alias("amount"),
        F.when(k % 4 == 1, F.concat(F.lit("T"), k.cast("string"))).alias("id"),
    )
    return rows.select("bill", F.explode(F.array(k * 2, k * 2 + 1)).alias("line"), "date", "description", "amount", "id")


CARD_ROWS = """card_rows AS (SELECT CAST(bank_id AS VARCHAR) || '/' || strftime(moment, '%Y-%m') AS bill, tx_id * 2 + again AS line, tx_id, CAST(moment AS DATE) AS day, status,
    CASE WHEN tx_id % 10 <> 3 THEN history || '  ' || CAST(tx_id AS VARCHAR) END AS description, amount AS value, CASE WHEN tx_id % 10 = 3 THEN 'description' END AS error,
    CASE WHEN tx_id % 10 <> 3 THEN sha256(CASE WHEN tx_id % 4 = 1 THEN 'externo:T' || CAST(tx_id AS VARCHAR)
        ELSE strftime(moment, '%Y-%m-%d') || 'T00:00:00+00:00|' || lower(history) || ' ' || CAST(tx_id AS VARCHAR) || '|' || CAST(amount AS VARCHAR) END) END AS identity
    FROM transactions, (VALUES (0), (1)) v(again))"""


@query("src10_card_csv_rows", f"WITH {CARD_ROWS} SELECT bill, line, day, description, value, identity, error FROM card_rows")
def _(t: Ledger) -> DataFrame:
    return tables.card_entries(card_rows(t))


@query("cc02_card_csv_import", f"""WITH {CARD_ROWS}, bills AS (SELECT CAST(card_id AS VARCHAR) || '/' || month AS bill, status FROM card_invoices)
    SELECT r.bill, r.line, r.identity, CASE WHEN b.status = 'paga' THEN 'paid bill' WHEN error IS NOT NULL THEN error WHEN r.line % 2 = 1 OR r.status = 'processada' THEN 'duplicate' ELSE 'new' END AS outcome
    FROM card_rows r JOIN bills b ON r.bill = b.bill""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    bills = t.card_invoices.select(F.concat_ws("/", "card_id", "month").alias("bill"), "status")
    rows = stored(tables.card_entries(card_rows(t)))  # parsed once for both sides
    known = t.transactions.filter("status = 'processada'").select((F.col("tx_id") * 2).alias("line"))
    return tables.card_import(rows, bills, rows.join(known, "line")).select("bill", "line", "identity", "outcome")


@query("cc02_purchase_ids", f"""WITH {CARD_ROWS}, bills AS (SELECT CAST(card_id AS VARCHAR) || '/' || month AS bill, status FROM card_invoices),
    h AS (SELECT r.bill, r.identity, sha1(unhex(md5(r.bill)) || encode(r.identity)) AS h FROM card_rows r JOIN bills b ON r.bill = b.bill
        WHERE b.status <> 'paga' AND error IS NULL AND r.line % 2 = 0)
    SELECT bill, identity, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST((instr('0123456789abcdef', h[17]) - 1) % 4 AS INTEGER) + 1, 1) || h[18:20] || '-' || h[21:32] AS purchase_id FROM h""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    bills = t.card_invoices.select(F.concat_ws("/", "card_id", "month").alias("bill"), "status")
    rows = stored(tables.card_entries(card_rows(t)))
    uuids = bills.select("bill", F.regexp_replace(F.md5("bill"), r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-").alias("uuid"))
    return tables.purchases(tables.card_import(rows, bills, rows.limit(0)), uuids).select("bill", "identity", "purchase_id")


def xml_files(t: Ledger) -> DataFrame:
    """A document for each live invoice, some of them unsafe, not authorised or without a field."""
    c = F.col
    at = F.concat(F.date_format("issued", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:00"))
    key = F.lpad(c("invoice_id").cast("string"), 44, "0")
    code = F.when(c("status") == "cancelada", "101").otherwise("150")
    proved = F.when(c("invoice_id") % 17 == 0, F.reverse(key)).otherwise(key)
    goods = F.format_string(
        '<n:nfeProc xmlns:n="urn:x"><n:NFe><n:infNFe Id="NFe%s"><n:ide><n:serie>%s</n:serie><n:nNF>%s</n:nNF><n:dhEmi>%s</n:dhEmi></n:ide><n:emit><n:CNPJ>%s</n:CNPJ><n:xNome>%s</n:xNome></n:emit>'
        "<n:dest><n:CNPJ>%s</n:CNPJ><n:xNome>buyer</n:xNome></n:dest><n:total><n:ICMSTot><n:vNF>%s</n:vNF></n:ICMSTot></n:total></n:infNFe></n:NFe>"
        "<n:protNFe><n:infProt><n:cStat>%s</n:cStat><n:nProt>123456789012345</n:nProt><n:dhRecbto>2024-01-02</n:dhRecbto><n:chNFe>%s</n:chNFe></n:infProt></n:protNFe></n:nfeProc>",
        key, c("series"), c("number"), at, c("issuer"), c("issuer_name"), c("recipient"), c("amount").cast("string"), code, proved,
    )
    number = F.when(c("invoice_id") % 5 == 4, "").otherwise(c("number"))
    service = F.format_string(
        "<CompNfse><Nfse><InfNfse><Numero>%s</Numero><CodigoVerificacao>AB</CodigoVerificacao><DataEmissao>%s</DataEmissao><Servico><Valores><ValorServicos>%s</ValorServicos><ValorIss>1.50</ValorIss></Valores></Servico>"
        "<PrestadorServico><IdentificacaoPrestador><Cnpj>%s</Cnpj></IdentificacaoPrestador><RazaoSocial>%s</RazaoSocial></PrestadorServico>"
        "<TomadorServico><IdentificacaoTomador><CpfCnpj><Cnpj>%s</Cnpj></CpfCnpj></IdentificacaoTomador></TomadorServico></InfNfse></Nfse></CompNfse>",
        number, at, c("amount").cast("string"), c("issuer"), c("issuer_name"), c("recipient"),
    )
    text = F.when(c("kind") == "nfe", goods).otherwise(service)
    bad = F.concat(F.lit("<!DOCTYPE x []>"), text)
    rows = t.invoices.filter("NOT deleted")
    return rows.select(c("invoice_id").cast("string").alias("file"), F.when(c("invoice_id") % 11 == 0, bad).otherwise(text).alias("content"))


XML = r"""xml AS (SELECT CAST(invoice_id AS VARCHAR) AS file, company_id, kind, access_key AS key, CASE WHEN kind = 'nfse' AND invoice_id % 5 = 4 THEN NULL ELSE number END AS number,
    CASE WHEN kind = 'nfe' THEN series END AS series, regexp_replace(regexp_replace(issuer, '\D', '', 'g'), '^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$', '\1.\2.\3/\4-\5') AS issuer, issuer_name,
    regexp_replace(recipient, '^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$', '\1.\2.\3/\4-\5') AS recipient, amount, issued + INTERVAL 3 HOUR AS issued,
    CASE WHEN kind = 'nfe' THEN 'Destinatário: buyer' ELSE 'ISS: 1.50' END AS note, CASE WHEN invoice_id % 11 = 0 THEN 'document type' WHEN kind = 'nfe' AND status = 'cancelada' THEN 'not authorised'
    WHEN kind = 'nfe' AND invoice_id % 17 = 0 AND access_key <> reverse(access_key) THEN 'key of protocol' WHEN kind = 'nfse' AND invoice_id % 5 = 4 THEN 'number' END AS error FROM invoices WHERE NOT deleted)""".replace("\\\\", "\\")
XML_FIELDS = "kind key number series issuer issuer_name recipient amount issued note".split()


@query("src11_invoice_xml", f"""WITH {XML} SELECT file, {", ".join(f"CASE WHEN coalesce(error, '') <> 'document type' THEN {f} END AS {f}" for f in XML_FIELDS)}, error FROM xml""")
def _(t: Ledger) -> DataFrame:
    return invoice_xml.invoices(xml_files(t))


@query("nf01_importable_invoices", rf"""WITH {XML} SELECT x.company_id, number FROM xml x JOIN companies c ON x.company_id = c.company_id
    WHERE error IS NULL AND regexp_replace(c.tax_id, '\D', '', 'g') IN (regexp_replace(issuer, '\D', '', 'g'), regexp_replace(recipient, '\D', '', 'g'))""".replace("\\\\", "\\"))  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return invoice_xml.importable(invoice_xml.invoices(xml_files(t)), t.companies).select("company_id", "number")


@query("fn38_unsafe_xml", "SELECT CAST(invoice_id AS VARCHAR) AS file, invoice_id % 11 = 0 AS unsafe FROM invoices WHERE NOT deleted")
def _(t: Ledger) -> DataFrame:
    return xml_files(t).select("file", invoice_xml.unsafe(F.col("content")).alias("unsafe"))


@query("src12_archive_members", "SELECT CAST(invoice_id AS VARCHAR) || '.zip' AS file, CAST(invoice_id AS VARCHAR) || '.xml' AS name, invoice_id % 11 = 0 AS unsafe FROM invoices WHERE NOT deleted")
def _(t: Ledger) -> DataFrame:
    found = tables.members(tables.archived(xml_files(t)))
    return found.filter("error IS NULL").select("file", "name", invoice_xml.unsafe(F.col("content").cast("string")).alias("unsafe"))


READ = """e AS (SELECT DISTINCT * FROM entries), k AS (SELECT *, CAST(CAST(moment AS DATE) - DATE '1970-01-01' AS BIGINT) * 100000
    + row_number() OVER (PARTITION BY supplier_id, CAST(moment AS DATE) ORDER BY moment, debit, credit, part, invoice, line, quantity) AS key FROM e)"""


@query("src12_archives_on_disk", "SELECT CAST(invoice_id // 100 AS VARCHAR) || '.zip' AS file, CAST(invoice_id AS VARCHAR) || '.xml' AS name, invoice_id % 11 = 0 AS unsafe FROM invoices WHERE NOT deleted")
def _(t: Ledger) -> DataFrame:
    """Archives of up to a hundred documents as files, opened by their members."""
    documents = xml_files(t).withColumn("archive", F.floor(F.col("file").cast("long") / 100))
    path = on_disk(t, tables.archives(documents, "archive"), ".zip")
    found = t.spark.read.format("archive").option("path", path).load()
    return found.filter("error IS NULL").select("file", "name", invoice_xml.unsafe(F.col("content").cast("string")).alias("unsafe"))


def keyed_entries(t: Ledger, *dealt: str) -> DataFrame:
    """Distinct entries with their day and a key of day and number in it; all steps find them dealt by supplier_id, or it and day."""
    e = t.entries.withColumn("day", F.to_date("moment")).repartition(*dealt).distinct()
    number = F.row_number().over(ledger.W.partitionBy("supplier_id", "day").orderBy("moment", "debit", "credit", "part", "invoice", "line", "quantity"))
    return e.withColumn("key", F.unix_date("day").cast("long") * 100_000 + number)


@query("f08_entries_read_twice", f"""WITH {READ} SELECT supplier_id, key * 4 + i AS n, CASE WHEN i = 0 THEN '77' END AS invoice,
    CASE WHEN i = 0 AND line % 2 = 0 THEN 'A' ELSE 'B' END || CAST(key AS VARCHAR) AS lot FROM k, (VALUES (0), (2)) v(i)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    """Each entry is read four times: again on its day with an invoice and another lot, and on another day with that lot.

    The second goes and gives its invoice and, to an entry without, its lot.  The third stays, since the second's lot
    went with it; a fourth on the third's day, with an own lot, goes.
    """
    base = keyed_entries(t, "supplier_id", "day")
    day, next_day = F.col("day"), F.date_add("day", 1)
    own = F.concat(F.lit("A"), F.col("key").cast("string"))
    other = F.concat(F.lit("B"), F.col("key").cast("string"))
    none = F.lit(None).cast("string")

    def read(i: int, at, lot, invoice):
        return F.struct((F.col("key") * 4 + i).alias("n"), at.alias("day"), lot.alias("lot"), invoice.alias("invoice"))

    reads = F.array(
        read(0, day, F.when(F.col("line") % 2 == 0, own), none), read(1, day, other, F.lit("77")), read(2, next_day, other, none),
        read(3, next_day, F.concat(own, F.lit("x")), none),
    )
    rows = base.select("supplier_id", "debit", "credit", F.col("key").cast("decimal(20,0)").alias("balance"), F.inline(reads))
    return ledger.without_rereads(stored(rows)).select("supplier_id", "n", "invoice", "lot")


@query("f08_chains", f"""WITH {READ} SELECT supplier_id, key AS n, CASE WHEN row_number() OVER w < count(*) OVER (PARTITION BY supplier_id) THEN 'NF' || CAST(lead(key) OVER w AS VARCHAR) END AS invoice
    FROM k WINDOW w AS (PARTITION BY supplier_id ORDER BY key) QUALIFY row_number() OVER w % 2 = 1""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    """All entries of a supplier form one chain: each shares its lot with the one before and its day with the one after, or the other way round."""
    base = keyed_entries(t, "supplier_id").select("supplier_id", F.col("key").alias("n"))
    place = F.row_number().over(ledger.W.partitionBy("supplier_id").orderBy("n"))
    rows = base.withColumn("k", place).select(
        "supplier_id", "n", F.date_add(F.lit("2000-01-01").cast("date"), F.floor(F.col("k") / 2).cast("int")).alias("day"),
        F.concat(F.lit("L"), F.floor((F.col("k") + 1) / 2).cast("string")).alias("lot"), F.lit(5).cast("decimal(15,2)").alias("debit"),
        F.lit(0).cast("decimal(15,2)").alias("credit"), F.lit(1).cast("decimal(15,2)").alias("balance"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("NF"), F.col("n").cast("string"))).alias("invoice"),
    )
    return ledger.without_rereads(stored(rows)).select("supplier_id", "n", "invoice")


@query("wn09_supplier_blocks", """SELECT file, n, CAST(sum(start) OVER (PARTITION BY file ORDER BY n) AS BIGINT) AS block FROM (
    SELECT company_id AS file, tx_id AS n, CASE WHEN dc = coalesce(lag(dc) OVER (PARTITION BY company_id ORDER BY tx_id), '') THEN 0 ELSE 1 END AS start FROM transactions)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    lines = t.transactions.select(F.col("company_id").alias("file"), F.col("tx_id").alias("n"), F.concat(F.lit("Conta: "), F.col("dc")).alias("text"))
    return ledger.blocks(lines, r"^Conta:\s*(\S+)").select("file", "n", "block")


@query("wn10_continuations", """SELECT bank_id AS file, string_agg(history, ' ' ORDER BY tx_id) AS text FROM transactions GROUP BY 1""")
def _(t: Ledger) -> DataFrame:
    first = F.row_number().over(ledger.W.partitionBy("bank_id").orderBy("tx_id")) == 1
    lines = t.transactions.select(F.col("bank_id").alias("file"), F.col("tx_id").alias("n"), "history", first.alias("first"))
    marked = lines.select("file", "n", F.when(F.col("first"), F.concat(F.lit("# "), F.col("history"))).otherwise(F.concat(F.lit("  "), F.col("history"))).alias("text"))
    out = ledger.joined_continuations(marked, "^# ")
    return out.select("file", F.substring("text", 3, 1 << 30).alias("text"))


@query("f04_best_extraction", """SELECT document, arg_min(strategy, (-entries, corrupt, strategy)) AS strategy FROM (
    SELECT bank_id AS document, tx_id AS strategy, CAST(floor(amount) AS BIGINT) % 5 AS entries, tx_id % 3 AS corrupt FROM transactions) GROUP BY 1""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    rows = t.transactions.select(
        F.col("bank_id").alias("document"), F.col("tx_id").alias("strategy"), (F.floor("amount").cast("long") % 5).alias("entries"), (F.col("tx_id") % 3).alias("corrupt")
    )
    return ledger.best_extraction(rows)


FUZZY = """n AS (SELECT company_id, name || ' COMERCIO LTDA ' || CAST(company_id AS VARCHAR) AS name, tax_id, company_id % 4 = 3 AS wrong FROM companies),
    a AS (SELECT company_id AS id, name, CASE WHEN company_id % 3 = 0 THEN tax_id END AS tax_id, wrong FROM n),
    b AS (SELECT company_id AS other_id, CASE company_id % 3 WHEN 0 THEN 'X' ELSE name || CASE company_id % 3 WHEN 1 THEN ' ME' ELSE '' END END AS name, CASE WHEN company_id % 3 = 0 THEN tax_id END AS tax_id FROM n)"""


@query("jn16_company_matches", f"""WITH {FUZZY}, p AS (SELECT id, other_id, a.tax_id AS given, wrong, a.tax_id = b.tax_id AS same, a.name = b.name AS equal,
        CAST(len(list_intersect(wa, wb)) AS DOUBLE) / len(list_distinct(list_concat(wa, wb))) AS score
        FROM (SELECT *, list_distinct(string_split(name, ' ')) AS wa FROM a) a, (SELECT *, list_distinct(string_split(name, ' ')) AS wb FROM b) b),
    r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second, bool_or(equal) OVER (PARTITION BY id) AS named FROM p WHERE given IS NULL WINDOW w AS (PARTITION BY id ORDER BY score DESC, other_id))
    SELECT id, other_id, 'tax id' AS how FROM p WHERE same AND NOT wrong UNION ALL SELECT id, other_id, 'name' FROM r WHERE equal
    UNION ALL SELECT id, other_id, 'similar name' FROM r WHERE NOT named AND k = 1 AND score >= 0.75 AND score - coalesce(second, 0) >= 0.10""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("company_id")
    name = F.concat_ws(" ", "name", F.lit("Comercio ltda"), k.cast("string"))
    a = t.companies.select(k.alias("id"), name.alias("name"), F.when(k % 3 == 0, F.col("tax_id")).alias("tax_id"))
    other = F.when(k % 3 == 0, "X").when(k % 3 == 1, F.concat(name, F.lit(" ME"))).otherwise(name)
    b = t.companies.select(k.alias("other_id"), other.alias("name"), F.when(k % 3 == 0, F.col("tax_id")).alias("tax_id"))
    return repair.company_matches(a, b)


@query("st_hourly_events", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS value FROM events GROUP BY 1, 2""")
def _(t: Ledger) -> DataFrame:
    return feeds.drained(feeds.hourly(feeds.stream(t.spark, f"{t.sf_dir}/events.parquet")), "complete")


@query("st_sessions", """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a)
    SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM b GROUP BY user_id, k""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return feeds.drained(feeds.sessions(feeds.stream(t.spark, f"{t.sf_dir}/events.parquet")), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("st_events_once", "SELECT count(DISTINCT event_id) AS n FROM events")
def _(t: Ledger) -> DataFrame:
    found = feeds.drained(feeds.once(feeds.stream(t.spark, f"{t.sf_dir}/events.parquet")).select("event_id", "ts"), "append")
    return found.agg(F.count("*").alias("n"))


@query("st_events_appended", "SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id FROM events) GROUP BY 1")
def _(t: Ledger) -> DataFrame:
    """Events appended to a table twice, by two streams that know nothing of one another."""
    target = folder(t.spark)
    for _ in range(2):
        feeds.appended(feeds.stream(t.spark, f"{t.sf_dir}/events.parquet"), target, "event_id")
    return t.spark.read.parquet(target).groupBy("event_id").agg(F.count("*").alias("n"))
