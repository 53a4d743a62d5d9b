"""Rows of workbooks: sheets in the usual form are read in one look, others as XML, with the same cells; one row a line."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.domain import Ledger
from ledgerloom.plans import imports
from ledgerloom.sources import ledger_sheet, packed, tables

TABLES = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 2, 29)
S = 'xmlns="urn:s"'
USUAL = [
    '<row r="1"><c r="A1"><v>1.5</v></c><c r="B1" s="1"/><c r="C1" t="str"><f>A1&amp;"x"</f><v>a&#65;&lt;</v></c></row>',
    '<row r="2" spans="1:2" x14ac:dyDescent="0.2"><c r="AB2" s="2" t="inlineStr"><is><t xml:space="preserve"> ç </t></is></c></row><row r="9"/>',
    '<row r="3"><c r="A3" t="b"><v>1</v></c><c r="A3"><f t="shared"/><v></v></c></row>',
]
ODD = [
    '<row r="1"><c t="str" r="A1"><v>order</v></c></row>',
    '<row r="1"><c r="A1" t="inlineStr"><is><r><t>rich</t></r><r><t> text</t></r></is></c></row>',
    '<row r="1"> <c r="A1"><v>1</v></c></row>',
    '<row r="1"><!-- <c r="A1"><v>1</v></c> --><c r="B1"><v>2</v></c></row>',
    '<row r="1"><c r="A1" t="str"><v><![CDATA[<x>]]></v></c></row>',
    '<row r="1"><c xmlns="urn:other" r="A1"><v>no cell</v></c><x:c r="B1"><x:v>3</x:v></x:c></row>',
    '<row r="1"><c r="A1" t="str"><v>a\r\nb</v></c></row>',
    '<row r="1" xmlns="urn:other"><c r="A1"><v>1</v></c></row>',
]


def sheet(body: str, root: str = f'{S} xmlns:x="urn:s" xmlns:x14ac="urn:d"', rest: str = "<pageMargins/>") -> bytes:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<worksheet {root}><cols><col min="1"/></cols><sheetData>{body}</sheetData>{rest}</worksheet>'.encode()


def same(data: bytes) -> bool:
    """Whether the quick way takes a sheet; if so, its cells are those of the XML."""
    quick = tables._plain_cells(data)
    if quick is not None:
        assert [(a, b, c or None, d or None, e) for a, b, c, d, e in quick] == list(tables._parsed_cells(data))
    return quick is not None


def test_usual_sheets_are_read_in_one_look():
    assert all(same(sheet(x)) for x in [*USUAL, "", "".join(USUAL)])
    made = tables.sheet_bytes([["a & <b>", 1, None, 2.5], [], ["\x01ç", True]])
    assert [(*c,) for c in tables.sheet_cells(made)] == [(1, 1, "a & <b>", "s"), (1, 2, "1", "n"), (1, 4, "2.5", "n"), (3, 1, "ç", "s"), (3, 2, "1", "n")]


def test_odd_sheets_are_read_as_xml():
    assert not any(same(sheet(x)) for x in ODD)
    assert not same(sheet(USUAL[0], rest='<c r="A9"><v>1</v></c>')) and not same(sheet(USUAL[0], root='xmlns:x="urn:s" xmlns:x14ac="urn:d"', rest="<x:c r='A9'/>"))
    assert not same(sheet(USUAL[0]).replace(b"UTF-8", b"ISO-8859-1")) and not same(sheet("<row r='1'>")) and not same(sheet("&none;"))
    assert not same(sheet("<row>\x01</row>")) and not same(b'<x:worksheet xmlns:x="urn:s"><sheetData><c r="A1"/></sheetData></x:worksheet>')


def test_mixed_sheets_have_the_same_cells():
    rng = random.Random(5)
    pieces = ["<row r='1'>", '<row r="2">', "</row>", '<c r="A1">', '<c r="B2" t="str">', "</c>", "<v>", "</v>", "<is>", "</is>", "<t>", "</t>", "x", "&amp;", "&#10;", " ", "<f/>", "<row/>", *USUAL, *ODD]
    for _ in range(20_000):
        same(sheet("".join(rng.choices(pieces, k=rng.randint(1, 5)))))


@pytest.fixture
def files(spark):
    head = ["Data", "Lote", "Histórico", "Débito", "Crédito", "Saldo", "DEBITO "]
    books = {
        "a": [["Empresa:", "X"], ["total", "Débito"], head, ["Conta:", 7, "2.1", "A NAME", "1"], [None, "SALDO", "ANTERIOR", None, None, -2], *[[DAY, k, f"NF {k:06d}", None, "1,5", 2] for k in range(99)], ["Total", "da conta", None, None, 148.5]],
        "b": [["no", "header"]],
        "c": [],
    }
    rows = [(k, bytearray(tables.sheet_bytes(v))) for k, v in books.items()] + [("d", bytearray(b"no"))]
    return spark.createDataFrame(rows, packed.FILES)


def test_lines_are_cells_by_row(files, monkeypatch):
    cells, lines = tables.cells(files), tables.lines(files)
    flat = lines.select("file", "row", F.explode_outer("cells").alias("c"), "error").select("file", "row", "c.*", "error")
    assert sorted(map(str, flat.collect())) == sorted(map(str, cells.select("file", "row", "col", "text", "kind", "error").collect()))
    order = lambda df: sorted(map(str, df.select("file", "row", "cells", "error").collect()))
    assert order(lines) == order(tables.lines_of(cells))
    rows = [(r.file, bytes(r.content)) for r in files.collect()]
    monkeypatch.setattr(tables, "LINES_BYTES", 1)  # a batch for each workbook
    assert [b.num_rows for b in tables.line_batches(rows)] == [105, 1, 1]
    assert sum(len(x or []) for b in tables.line_batches(rows) for x in b["cells"].to_pylist()) == cells.filter("error IS NULL").count()


def test_ledgers_of_lines_are_those_of_cells(files):
    by_cells, by_lines = (ledger_sheet.rows_of(f(files)) for f in (tables.cells, tables.lines))
    got = [[sorted(map(str, df.collect())) for df in (rows, ledger_sheet.entries(rows), ledger_sheet.suppliers(rows, ledger_sheet.entries(rows)), ledger_sheet.heads(rows))] for rows in (by_cells, by_lines)]
    assert got[0] == got[1] and len(got[0][1]) == 99
    assert [tuple(r)[2:] for r in ledger_sheet.suppliers(by_lines, ledger_sheet.entries(by_lines)).select("file", "block", "code", "name", "entries", "closes").collect()] == [("7", "A NAME", 99, True)]
    assert sorted(tuple(r) for r in ledger_sheet.without_header(tables.lines(files)).collect()) == [("b", "no header"), ("d", "no workbook")]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_entries_of_workbooks_are_dealt_once_as_rows(spark):
    """A sheet's rows are shuffled, not its cells, and no join brings the accounts of blocks."""
    t = Ledger(spark, TABLES)
    rows = tables.lines(imports.sheets(t))
    assert rows.count() < 2 * t.entries.count()
    plan = catalog.queries()["src08_workbook_entries"](spark, t.sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
