"""File formats on small files."""

import datetime
import hashlib
import io
import time
import uuid
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import hashing
from ledgerloom.operators import exports
from ledgerloom.sources import invoice_xml, ledger_sheet, ofx, statement, tables
from ledgerloom.streaming import feeds

HEAD = "OFXHEADER:100\nDATA:OFXSGML\n<OFX><BANKTRANLIST>\n"


def block(**tags):
    return "<STMTTRN>\n" + "".join(f"<{k}>{v}\n" for k, v in tags.items())


def test_ofx(spark):
    good = block(TRNTYPE="debit", DTPOSTED="20240131", TRNAMT="-1.500,00", FITID="A1", NAME=" fallback ")
    bad = block(TRNTYPE="x", DTPOSTED="20240131", TRNAMT="oops", FITID="A2", MEMO="m") + block(DTPOSTED="20240131", TRNAMT="1")
    closed = "<?xml version='1.0'?><OFX><STMTTRN><DTPOSTED>20240131120000.123[-3:BRT]</DTPOSTED><TRNAMT>10</TRNAMT><FITID>B</FITID></STMTTRN></OFX>"
    files = spark.createDataFrame([("a", "﻿" + HEAD + good + bad + "</BANKTRANLIST>"), ("b", closed), ("c", HEAD), ("d", (HEAD + good).replace("\n", "\r\n"))], "file string, content string")
    rows = {(r.file, r.n): r for r in ofx.transactions(files).collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("d", 0)}
    a = rows["a", 0]
    assert (a.fitid, float(a.amount), a.dc, a.history, a.kind, a.error) == ("A1", -1500, "D", "fallback", "DEBIT", None)
    assert rows["a", 1].error == "TRNAMT" and rows["a", 2].error == "missing FITID"
    assert rows["b", 0].moment == datetime.datetime(2024, 1, 31, 15, 0, 0, 123000) and rows["b", 0].xml
    assert rows["d", 0].amount == a.amount


def test_ofx_encodings(spark, tmp_path):
    for name, code in (("u.ofx", "utf-8"), ("l.ofx", "latin-1")):
        (tmp_path / name).write_bytes((HEAD + block(DTPOSTED="20240131", TRNAMT="1", FITID="x", MEMO="ação")).encode(code))
    assert {r.history for r in ofx.transactions(ofx.read(spark, str(tmp_path))).collect()} == {"ação"}
    assert {(r.content, r.error) for r in ofx.read(spark, str(tmp_path), longest=10).collect()} == {(None, "too large")}


def test_statement(spark):
    lines = ["Extrato de conta", "TED ORPHAN 5,00 10,00", "PIX MARIA", "01/02/2024 4803 -1.234,56 10.000,00", "PGTO FERIAS 4803 20,00 1,00", "SALDO ANTERIOR 232,94", "02/02 skip", "123456789012345678 BOLETO 12,00 9,00"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, n int, text string")
    got = statement.transactions(rows, 2024).orderBy("n").collect()
    assert [(str(r.date), float(r.amount), r.history) for r in got] == [("2024-02-01", -1234.56, "PIX MARIA"), ("2024-02-01", 20.0, "PGTO FERIAS"), ("2024-02-01", 12.0, "02/02 skip")]
    kinds = "file string, opening decimal(25,2), closing decimal(25,2), declared_credits decimal(25,2), declared_debits decimal(25,2)"
    net = [("f", Decimal("2000.00"), Decimal("797.44"), None, None), ("g", None, None, None, None)]
    done = statement.complete(statement.transactions(rows, 2024), spark.createDataFrame(net, kinds))
    assert {(r.file, r.complete) for r in done.collect()} == {("f", True), ("g", False)}


def test_card_csv(spark, tmp_path):
    (tmp_path / "br.csv").write_text('data_compra;descricao;valor\n31/01/2024;Loja;"R$ 1.234,56"\n31/01/2024;Loja;"1.234,56"\nx;Loja;1\n31/01/2024;;1\n31/01/2024;Loja;-1\n')
    (tmp_path / "en.csv").write_text("Date,Description,Amount,id\n2024-01-31,Shop,10.00,7\n2024-01-31,Other,11.00,7\n")
    br = tables.card_entries(tables.read_csv(spark, str(tmp_path / "br.csv"), tables.CARD_COLUMNS))
    assert sorted(str(r.error) for r in br.collect()) == ["None", "None", "amount", "date", "description"]
    plain = hashlib.sha256("2024-01-31T00:00:00+00:00|loja|1234.56".encode()).hexdigest()
    assert {r.identity for r in br.filter("error IS NULL").collect()} == {plain}
    en = tables.card_entries(tables.read_csv(spark, str(tmp_path / "en.csv"), tables.CARD_COLUMNS))
    assert {r.identity for r in en.collect()} == {hashlib.sha256(b"externo:7").hexdigest()}
    lines = en.unionByName(br).selectExpr("'b' AS bill", "monotonically_increasing_id() AS line", "*")
    bills = spark.createDataFrame([("b", "aberta")], "bill string, status string")
    none = lines.limit(0)
    got = sorted(r.outcome for r in tables.card_import(lines, bills, none).collect())
    assert got == ["amount", "date", "description", "duplicate", "duplicate", "new", "new"]
    assert {r.outcome for r in tables.card_import(lines.filter("error IS NULL"), bills, lines.filter("error IS NULL")).collect()} == {"duplicate"}
    assert {r.outcome for r in tables.card_import(lines, bills.withColumn("status", F.lit("paga")), none).collect()} == {"paid bill"}
    assert {r.outcome for r in tables.card_import(lines, bills.limit(0), none).collect()} == {"unknown bill"}


def test_uuid_of_a_name(spark):
    space = uuid.UUID("12345678-1234-5678-1234-567812345678")
    names = ["a", "ç", "x" * 100, *map(str, range(50))]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.id for r in rows.select("name", hashing.name_uuid(F.lit(str(space)), F.col("name")).alias("id")).collect()}
    assert got == {n: str(uuid.uuid5(space, n)) for n in names}
    assert rows.limit(1).select(hashing.number_text(F.lit(Decimal("1.50"))).alias("a"), hashing.number_text(F.lit(Decimal("2.00"))).alias("b"), hashing.number_text(F.lit(Decimal("-3.25"))).alias("c")).first() == ("1.5", "2.0", "-3.25")


def workbook(rows):
    cells = "".join(
        f'<row r="{r}">' + "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in row) + "</row>" for r, row in rows
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="urn:s"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_and_archives(spark):
    book = workbook([(1, [(1, "Conta:"), (3, "2.1")]), (4, [(2, "217,75")])])
    files = spark.createDataFrame([("a", bytearray(book))], "file string, content binary")
    assert {(r.row, r.col, r.text) for r in tables.cells(files).collect()} == {(1, 1, "Conta:"), (1, 3, "2.1"), (4, 2, "217,75")}
    good, bomb = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x/a.XML", "<a/>")
        z.writestr("b.txt", "no")
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "0" * 1_000_000)
    rows = spark.createDataFrame([("g", bytearray(good.getvalue())), ("b", bytearray(bomb.getvalue())), ("n", bytearray(b"x"))], "file string, content binary")
    got = {(r.file, r.name, r.error) for r in tables.members(rows).collect()}
    assert got == {("g", "x/a.XML", None), ("b", None, "compressed too far"), ("n", None, "no archive")}
    kinds = rows.unionByName(spark.createDataFrame([("x", bytearray(tables.sheet_bytes([["a"]]))), ("p", bytearray(b"%PDF-1")), ("t", bytearray(b"PK"))], "file string, content binary"))
    assert {(r.file, r.kind) for r in tables.file_kind(kinds).collect()} == {("g", "zip"), ("b", "zip"), ("n", "other"), ("x", "xlsx"), ("p", "pdf"), ("t", "other")}
    assert {(r.file, r.error) for r in tables.cells(rows).filter("error IS NOT NULL").collect()} == {("g", "no workbook"), ("b", "compressed too far"), ("n", "no workbook")}


def test_ledger_workbook(spark):
    day = datetime.date(2024, 1, 5)
    rows = [["Empresa:", "X"], ["Data", "Número", "Histórico", "Débito", "Crédito", "Saldo"], ["Conta:", 1667.0, "2.1.3", None, "A NAME", "1.2"], [None, None, "SALDO ANTERIOR", None, None, -1088.77],
            [day, 12.0, "NF 116722", None, "350,26", -1439.03], [day, 13, "x", 217.75, None, 5], [day, 14, "nothing"], ["Total da conta:", None, None, 217.75, 350.26],
            ["Conta:", "8", "2.1.4", "OTHER"], ["Total da conta:", None, None, 1, 0], ["Conta:", 9, "2.1.5", "BARE"]]
    files = spark.createDataFrame([("a", bytearray(tables.sheet_bytes(rows))), ("b", bytearray(tables.sheet_bytes([["no", "header"]])))], "file string, content binary")
    cells = tables.cells(files)
    table = ledger_sheet.rows_of(cells)
    found = ledger_sheet.entries(table)
    assert {(r.block, str(r.day), r.lot, r.history, float(r.debit), float(r.credit), float(r.balance), r.side, r.kind, r.invoice) for r in found.collect()} == {
        (1, "2024-01-05", "12", "NF 116722", 0.0, 350.26, 1439.03, "C", "COMPRA", "116722"), (1, "2024-01-05", "13", "x", 217.75, 0.0, 5.0, "D", "PAGAMENTO", None),
    }
    assert {(r.code, r.account, r.name, float(r.opening), r.opening_side, float(r.debits), float(r.credits), r.entries, r.closes) for r in ledger_sheet.suppliers(table, found).collect()} == {
        ("1667", "2.1.3", "A NAME", 1088.77, "C", 217.75, 350.26, 2, True), ("8", "2.1.4", "OTHER", 0.0, "", 1.0, 0.0, 0, False), ("9", "2.1.5", "BARE", 0.0, "", 0.0, 0.0, 0, True),
    }
    assert [tuple(r) for r in ledger_sheet.without_header(cells).collect()] == [("b", "no header")]


def test_chart_workbooks(spark):
    wide = tables.sheet_bytes([["Codigo", *["x"] * 100], ["1"]])
    files = spark.createDataFrame([("a", bytearray(tables.sheet_bytes([["CLASSIFICAÇÃO", "Nome", "sa"], [1.1, " two ", "S"], [], [None, None, "A"]]))), ("w", bytearray(wide)), ("n", bytearray(b"x"))], "file string, content binary")
    good, refused = tables.chart_sheets(tables.cells(files))
    assert [tuple(r) for r in good.collect()] == [("a", 2, "1.1", "two", None, "S")]
    assert {tuple(r) for r in refused.collect()} == {("w", "too many columns"), ("n", "no workbook")}


def test_folders_and_dumps(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "final.csv").write_text(f"a,b\n{name},1\n")
    assert {(r.company, r.a) for r in tables.folders(spark, str(tmp_path)).collect()} == {("one", "one"), ("two", "two")}
    (tmp_path / "dump.json").write_text('[{"razao": "x", "contas": [{"conta": 1}, {"conta": 2}]}, {"razao": "y", "contas": []}]')
    assert {(r.razao, r.conta) for r in tables.chart_json(spark, str(tmp_path / "dump.json")).collect()} == {("x", 1), ("x", 2)}
    exports.write_csv(spark.createDataFrame([("=é", 1)], "text string, n int").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_bytes() == "\ufefftext,n\n=é,1\n".encode()


def test_invoice_xml(spark):
    prot = "<protNFe><infProt><cStat>100</cStat><nProt>" + "1" * 15 + "</nProt><dhRecbto>2024-01-31T10:00:01-03:00</dhRecbto><chNFe>" + "1" * 44 + "</chNFe></infProt></protNFe>"
    good = '<p xmlns="urn:n"><infNFe Id="NFe' + "1" * 44 + '"><ide><nNF>7</nNF><serie>1</serie><dhEmi>2024-01-31T10:00:00-03:00</dhEmi></ide><emit><CNPJ>11222333000181</CNPJ><xNome>S</xNome></emit><dest><CPF>2</CPF><xNome>B</xNome></dest><total><ICMSTot><vNF>10.50</vNF></ICMSTot></total></infNFe>' + prot + "</p>"
    service = "<x><InfNfse><Numero>8</Numero><CodigoVerificacao>V</CodigoVerificacao><DataEmissao>2024-02-01</DataEmissao></InfNfse><Servico><Valores><ValorServicos>3</ValorServicos></Valores></Servico><PrestadorServico><IdentificacaoPrestador><Cnpj>11222333000181</Cnpj></IdentificacaoPrestador></PrestadorServico></x>"
    rows = {"a": good, "b": good.replace(">100<", ">101<"), "c": "<!DOCTYPE x>" + good, "d": "<other/>", "e": "no xml", "f": None, "g": good.replace("<nProt>1", "<nProt>"), "h": good.replace("<chNFe>1", "<chNFe>2"),
            "i": good.replace("NFe1", "NFe"), "j": good.replace("2024-01-31T10:00:01-03:00", "x"), "k": good.replace("10.50", "z"), "l": service, "m": service.replace("<CodigoVerificacao>V", "<CodigoVerificacao>")}
    got = {r.file: r for r in invoice_xml.invoices(spark.createDataFrame(list(rows.items()), "file string, content string")).collect()}
    a = got["a"]
    assert (a.kind, a.number, float(a.amount), a.key, a.issuer, a.issuer_name, a.recipient, a.note, a.error) == ("nfe", "7", 10.5, "1" * 44, "11.222.333/0001-81", "S", "2", "Destinatário: B", None)
    assert a.issued == datetime.datetime(2024, 1, 31, 13) and (got["l"].kind, got["l"].number, got["l"].error) == ("nfse", "8", None)
    assert [got[k].error for k in "bcdefghijkm"] == ["not authorised", "document type", *["unknown document"] * 3, "not authorised", "key of protocol", "access key", "time of authorisation", "amount", "verification"]


def test_streams(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i % 40, start + datetime.timedelta(minutes=7 * i), i % 3, "a" if i % 2 else "b", float(i)) for i in range(50)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    events = feeds.stream(spark, f"{tmp_path}/events.parquet")
    assert feeds.drained(feeds.hourly(events), "complete").groupBy().sum("n").first()[0] == 50
    assert feeds.drained(feeds.once(events), "append").count() == 40
    assert feeds.sessions(spark.read.parquet(f"{tmp_path}/events.parquet")).groupBy().sum("n").first()[0] == 50


def test_ofx_blocks_without_ends_are_found_in_one_look(spark):
    """Each of 20,000 blocks without an end once looked for one through the rest of its file."""
    block = "<STMTTRN>\n<FITID>{0}\n<TRNAMT>{0}.5\n<DTPOSTED>20240105\n<MEMO>m\n"
    open_ = "<OFX>" + "".join(block.format(k) for k in range(20_000)) + "</BANKTRANLIST>"
    mixed = "<ofx>" + block.format(1) + "</stmttrn>" + block.format(2) + "</STMTTRN>\n" + block.format(3)
    files = spark.createDataFrame([("open", open_), ("mixed", mixed), ("none", "x"), ("null", None)], "file string, content string")
    start = time.perf_counter()
    found = ofx.transactions(files)
    assert [(r.file, r["count"]) for r in found.filter("error IS NULL").groupBy("file").count().orderBy("file").collect()] == [("mixed", 2), ("open", 20_000)]
    assert time.perf_counter() - start < 12
    assert sorted(r.fitid for r in found.filter("file = 'mixed'").collect()) == ["1", "2"]
