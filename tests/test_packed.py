"""Workbooks and archives as data sources: parts, order, limits, failures, heads of ledgers."""

import datetime
import io
import os
import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import scratch
from ledgerloom.operators import exports
from ledgerloom.sources import ledger_sheet, packed, tables


@pytest.fixture
def sources(spark):
    packed.register(spark)
    return spark


def read(spark, kind, path):
    return spark.read.format(kind).option("path", str(path)).load()


def archive(members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)
    return held.getvalue()


def test_workbooks_keep_order_over_parts(sources, tmp_path, monkeypatch):
    rows = sources.range(500).select((500 - F.col("id")).alias("n"), F.concat(F.lit("ç<&> "), F.col("id").cast("string")).alias("text"), F.lit(Decimal("1.50")).alias("amount"), F.lit(None).cast("string").alias("none"), F.lit(datetime.date(2024, 2, 29)).alias("day"))
    exports.write_workbook(rows.repartitionByRange(3, "n").sortWithinPartitions("n"), str(tmp_path), {"n": "Número"})
    parts = sorted(os.listdir(tmp_path))
    assert len(parts) == 3 and all(p.endswith(".xlsx") for p in parts)
    cells = read(sources, "workbook", tmp_path)
    got = [r.text for r in cells.filter("col = 1 AND row > 1").orderBy("file", "row").collect()]
    assert got == [str(n) for n in range(1, 501)]
    assert {r.text for r in cells.filter("row = 1").collect()} == {"Número", "text", "amount", "none", "day"}
    line = {r.col: (r.text, r.kind) for r in cells.filter(F.col("file").startswith("part-00000") & (F.col("row") == 2)).collect()}
    assert line == {1: ("1", "n"), 2: ("ç<&> 499", "s"), 3: ("1.50", "n"), 5: ("2024-02-29T00:00:00", "d")}
    exports.write_workbook(rows.coalesce(1), str(tmp_path))
    assert len(os.listdir(tmp_path)) == 1  # what was there is replaced


def test_sheets_have_a_most_of_rows():
    writer, files = packed.WorkbookWriter("x", False, ["a"]), {}

    def put(name):
        files[name] = tables._Kept()
        return files[name]

    most, packed.SHEET_ROWS = packed.SHEET_ROWS, 4
    try:
        writer.task(iter([(i,) for i in range(10)]), put, 7)
    finally:
        packed.SHEET_ROWS = most
    assert list(files) == ["part-00007-000.xlsx", "part-00007-001.xlsx", "part-00007-002.xlsx"]
    assert [len(list(tables.sheet_cells(f.content))) for f in files.values()] == [5, 5, 3]


def test_a_failed_job_leaves_nothing(sources, tmp_path):
    exports.write_workbook(sources.range(3), str(tmp_path))
    before = sorted(os.listdir(tmp_path))
    bad = sources.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="no"):
        exports.write_workbook(bad, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == before
    two = sources.createDataFrame([("a", bytearray(b"1")), ("a", bytearray(b"2"))], packed.FILES)
    with pytest.raises(Exception, match="one file"):
        two.write.format("files").mode("append").option("path", str(tmp_path)).save()
    assert sorted(os.listdir(tmp_path)) == before


def test_archives_by_members_and_limits(sources, tmp_path, monkeypatch):
    many = [(f"{i}.xml", f"<a>{i}</a>") for i in range(50)]
    files = {
        "few.zip": archive([("x/a.XML", "<a/>"), ("b.txt", "no"), ("d/", "")]),
        "many.zip": archive(many),
        "bomb.zip": archive([("a.xml", "0" * 1_000_000)]),
        "none.zip": b"x",
        "empty.zip": archive([]),
        "crowd.zip": archive([(f"{i}.txt", "") for i in range(tables.MOST_FILES + 1)]),
        "other.txt": b"no",
    }
    rows = sources.createDataFrame([(k, bytearray(v)) for k, v in files.items()], packed.FILES)
    rows.write.format("files").mode("append").option("path", str(tmp_path / "in")).save()
    os.makedirs(tmp_path / "in" / "_staging-1")
    (tmp_path / "in" / "_staging-1" / "hidden.zip").write_bytes(b"x")

    def found():
        return sorted((r.file, r.name or "", r.error or "") for r in read(sources, "archive", tmp_path / "in").collect())

    want = sorted([("few.zip", "x/a.XML", ""), *[("many.zip", n, "") for n, _ in many], ("bomb.zip", "", "compressed too far"), ("none.zip", "", "no archive"), ("crowd.zip", "", "too many files")])
    assert found() == want
    monkeypatch.setattr(packed, "TASK_BYTES", 100)  # every archive is dealt by members
    reader = packed.Members(str(tmp_path / "in"))
    shares = reader.partitions()
    assert sum(s.files[0][0].endswith("many.zip") for s in shares) > 3
    rows = [r for s in shares for b in reader.read(s) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted((f, n or "", e or "") for f, n, _, e in rows) == want
    assert {n: c for f, n, c, _ in rows if f == "many.zip"} == {n: t.encode() for n, t in many}


def test_workbooks_that_are_none(sources, tmp_path):
    files = [("a.xlsx", tables.sheet_bytes([["x"]])), ("b.xlsx", b"no"), ("c.xlsx", archive([("a.xml", "0" * 1_000_000)]))]
    sources.createDataFrame([(k, bytearray(v)) for k, v in files], packed.FILES).write.format("files").mode("append").option("path", str(tmp_path)).save()
    assert {(r.file, r.text, r.error) for r in read(sources, "workbook", tmp_path).collect()} == {("a.xlsx", "x", None), ("b.xlsx", None, "no workbook"), ("c.xlsx", None, "compressed too far")}
    assert read(sources, "workbook", tmp_path).select("file").distinct().count() == 3
    os.makedirs(tmp_path / "none")
    assert read(sources, "workbook", tmp_path / "none").count() == 0


def test_heads_of_ledgers(sources):
    books = {
        "a": [["Empresa:", None, "Folha: 1", "ACME SA"], [None, "C.N.P.J.: 11.222.333/0001-81"], ["Período:", "01/02/2024 - 29/02/2024"], ["Empresa:", "OTHER"]],
        "b": [["Empresa:"], ["Empresa:", "LATER"], ["Período: 01/01/2023 - 31/01/2023"], ["Período: 01/01/2024 - 31/01/2024"]],
        "c": [[]] * 15 + [["Empresa:", "TOO LATE"]],
    }
    files = sources.createDataFrame([(k, bytearray(tables.sheet_bytes(v))) for k, v in books.items()], packed.FILES)
    got = {r.file: (r.company, r.tax_id, str(r["first"]), str(r["last"])) for r in ledger_sheet.heads(tables.cells(files)).collect()}
    assert got == {"a": ("ACME SA", "11.222.333/0001-81", "2024-02-01", "2024-02-29"), "b": ("LATER", "", "2024-01-01", "2024-01-31"), "c": ("", "", "None", "None")}


def test_statement_filters_and_order(sources):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, b, 1, at - datetime.timedelta(days=i % 3), Decimal(i), "h", "D", s, d) for i, b, s, d in [(5, 1, "pendente", False), (4, 1, "pendente", False), (3, 2, "pendente", False), (2, 1, "processada", False), (1, 1, "pendente", True), (9, 7, "pendente", False)]]
    tx = sources.createDataFrame(rows, "tx_id long, bank_id long, company_id int, moment timestamp, amount decimal(15,2), history string, dc string, status string, deleted boolean")
    banks = sources.createDataFrame([(1, "B", "1", "2", None), (2, "C", "1", "2", "3")], "bank_id long, acronym string, branch string, number string, digit string")
    shown = lambda **k: [(r.date, r.account, int(r.amount)) for r in exports.statement(tx, banks, **k).collect()]
    assert shown() == [("30/12/2023", "B 1 2", 2), ("30/12/2023", "B 1 2", 5), ("31/12/2023", "B 1 2", 4), ("01/01/2024", "C 1 2 3", 3), ("01/01/2024", "", 9)]
    assert [a for *_, a in shown(bank=1, status="pendente")] == [5, 4] and [a for *_, a in shown(first="2024-01-01")] == [3, 9]


def test_scratch_tables_can_be_deleted(sources):
    kept = scratch.stored(sources.range(3))
    assert kept.count() == 3 and scratch._WRITTEN
    scratch.forget(sources)
    assert not scratch._WRITTEN
    with pytest.raises(Exception):  # noqa: B017  the files are gone
        kept.collect()


def test_written_sheets_stay_within_the_limits_of_reading():
    """Rows of more bytes than a workbook may have go to several, each of which can be read."""
    rng = random.Random(3)
    kept, texts = [], [rng.randbytes(500_000).hex() for _ in range(110)]

    def put(name):
        kept.append(tables._Kept())
        return kept[-1]

    packed.WorkbookWriter("unused", False, ["text"]).task(iter([(x,) for x in texts]), put, 0)
    read = [[c[2] for c in tables.sheet_cells(f.content)] for f in kept]
    assert [x for own in read for x in own[1:]] == texts and {own[0] for own in read} == {"text"}
