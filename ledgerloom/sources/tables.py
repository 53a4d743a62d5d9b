"""Card bills and charts of accounts as CSV, supplier ledgers as XLSX, and archives of invoices."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import lru_cache
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.dates import card_date
from ..functions.numbers import card_amount
from ..functions.text import plain_case, stripped
from ..scratch import stored

# Names that a column may have, in the order in which they count.
CARD_COLUMNS = {
    "date": ["data_compra", "data", "date"],
    "description": ["descricao", "description", "historico"],
    "amount": ["valor", "value", "amount"],
    "id": ["id", "identificador", "transaction_id", "transactionid", "purchase_id", "reference", "referencia"],
}
CHART_COLUMNS = {
    "code": ["codigo", "classificacao", "classificação", "code", "cod"],
    "label": ["descricao", "description", "descrição", "nome"],
    "kind": ["tipo", "type"],
    "kind_sa": ["tipo_sa", "sa", "s/a"],
}
# Limits of an archive, of a workbook's archive, and of a workbook.
MOST_FILES, MOST_BYTES, MOST_RATIO, MOST_FILE = 1000, 100 << 20, 100, 10 << 20
MOST_SHEET_RATIO = 200
MOST_ROWS, MOST_COLUMNS, MOST_CELLS = 50_000, 100, 500_000
#: bytes of files that are opened for one frame of rows
FRAME = 4 << 20
# Number formats of dates in a workbook that need no definition of their own.
DATE_FORMATS = [*range(14, 23), *range(45, 48)]


def aliased(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names: the first alias that isn't empty."""
    have = {c.strip().lstrip("﻿").lower(): c for c in rows.columns}
    out = []
    for name, aliases in names.items():
        found = [F.nullif(stripped(F.col(f"`{have[a]}`").cast("string")), F.lit("")) for a in aliases if a in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return rows.select(*out)


def read_csv(spark: SparkSession, path: str, names: dict[str, list[str]], sep: str | None = None) -> DataFrame:
    """A CSV file with a header; the delimiter is taken from the header where none is given."""
    if sep is None:
        first = spark.read.text(path).first()
        sep = max(",;\t", key=(first[0] if first else "").count)
    return aliased(spark.read.csv(path, header=True, sep=sep, escape='"'), names)


def card_entries(rows: DataFrame) -> DataFrame:
    """Purchases of bills: parsed fields, the error that a row has, and its identity.

    `rows` has the texts date, description, amount and id; other columns stay.
    """
    day, amount = card_date(stripped(F.col("date"))), card_amount(F.col("amount"))
    text = F.nullif(stripped(F.col("description")), F.lit(""))
    error = F.when(day.isNull(), "date").when(text.isNull(), "description").when(amount.isNull() | (amount <= 0), "amount")
    identity = hashing.purchase_identity(stripped(F.col("id")), day, plain_case(text), amount)
    rest = [c for c in rows.columns if c not in ("date", "description", "amount", "id")]
    return rows.select(
        *rest, day.cast("date").alias("day"), text.alias("description"), amount.alias("value"),
        F.when(error.isNull(), identity).alias("identity"), error.alias("error"),
    )


def card_import(rows: DataFrame, bills: DataFrame, there: DataFrame) -> DataFrame:
    """What becomes of each line of the bills' CSV files: `new`, `duplicate`, its error, or that the bill takes none.

    `rows` are `card_entries` with bill and line, `bills` has bill and status, `there` bill and identity.
    Of lines with one identity the first of a bill is new, unless an earlier import has it.
    """
    first = rows.filter("error IS NULL").groupBy("bill", "identity").agg(F.min("line").alias("_first"))
    known = there.select("bill", "identity").distinct().withColumn("_known", F.lit(True))
    state = bills.select("bill", F.col("status").alias("_status"))
    joined = rows.join(state, "bill", "left").join(first, ["bill", "identity"], "left").join(known, ["bill", "identity"], "left")
    outcome = (
        F.when(F.col("_status").isNull(), "unknown bill")
        .when(F.col("_status") == "paga", "paid bill")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_known") | (F.col("line") > F.col("_first")), "duplicate")
        .otherwise("new")
    )
    return joined.withColumn("outcome", outcome).drop("_status", "_first", "_known")


def purchases(imported: DataFrame, bills: DataFrame) -> DataFrame:
    """New lines of a card import with the purchase's id: a UUID of its identity in the space of its bill's UUID.

    `imported` is what `card_import` gives, `bills` has bill and uuid.
    """
    new = imported.filter("outcome = 'new'").join(bills.select("bill", "uuid"), "bill")
    return new.withColumn("purchase_id", hashing.name_uuid(F.col("uuid"), F.col("identity"))).drop("uuid")


def _is_date(code: str) -> bool:
    return bool(re.search(r"[dmyh]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())))


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter() if _tag(f) == "numFmt" and _is_date(f.get("formatCode", ""))}
    cells = next((e for e in root if _tag(e) == "cellXfs"), ())
    return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in own.union(DATE_FORMATS)}


def sheet_cells(content: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(row, column, text, kind) of the first sheet; kind is s for text, n for a number, d for a date as ISO text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if len(infos) > MOST_FILES or sum(i.file_size for i in infos) > MOST_BYTES:
            raise ValueError("too large")
        if any(i.file_size and (not i.compress_size or i.file_size / i.compress_size > MOST_SHEET_RATIO) for i in infos):
            raise ValueError("compressed too far")
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _tag(t) == "t"))
        dates = _date_styles(z)
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        numbers: dict[str, int] = {}
        for letters, row, style, kind, text in _cells(z.read(sheet)):
            if not text:
                continue
            if letters not in numbers:
                numbers[letters] = column_number(letters)
            if kind == "s":
                text = shared[int(text)]
            elif kind not in ("str", "inlineStr"):
                if int(style or 0) in dates:
                    yield int(row), numbers[letters], _moment(text), "d"
                    continue
                kind = None
            if text:
                yield int(row), numbers[letters], text, "s" if kind else "n"


@lru_cache(maxsize=10_000)
def _moment(days: str) -> str:
    return (datetime(1899, 12, 30) + timedelta(days=float(days))).isoformat(timespec="seconds")


#: what stands before a sheet's elements, a cell of one value or text, and the other tags of rows, as programs write them
_OPENING = re.compile(r'(?:<\?xml version="1\.0"(?: encoding="(?:UTF|utf)-8")?(?: standalone="(?:yes|no)")?\?>\s*)?<worksheet(?:\s[^<>]*)?>')
_TOKEN = re.compile(
    r'(<c r="([A-Z]+)([0-9]+)"(?: s="([0-9]+)")?(?: t="(\w+)")?'
    r'(?:/>|>(?:<f[^<>]*(?:/>|>[^<]*</f>))?(?:<v>([^<]*)</v>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)?</c>)|<row[^<>]*>|</row>)'
)
_CELL_TAG = re.compile(r"<(?:[^<>\s/]*:)?c[\s/>]")
_REFERENCE = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|(\w+));")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _resolved(text: str) -> str:
    return _REFERENCE.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else _NAMED[m[3]], text)


def _cells(data: bytes) -> Iterable[tuple[str, str, str | None, str | None, str]]:
    """(letters, row, style, kind, text) of each cell of a sheet's XML."""
    found = _plain_cells(data)
    return _parsed_cells(data) if found is None else found


def _plain_cells(data: bytes) -> list[tuple[str, str, str, str, str]] | None:
    """The same for well-formed sheets whose rows are nothing but tags and cells of the usual form; None for others."""
    try:
        expat.ParserCreate(None, "}").Parse(data, True)
        text = data.decode()
    except (expat.ExpatError, ValueError):
        return None
    opening, start, stop = _OPENING.match(text), text.find("<sheetData>"), text.rfind("</sheetData>")
    if not opening or stop < 0 or start < opening.end() or "\r" in text or "<!" in text:
        return None
    body, head, rest = text[start + len("<sheetData>") : stop], text[opening.end() : start], text[stop:]
    if "xmlns" in body or "xmlns=" in head or _CELL_TAG.search(head) or _CELL_TAG.search(rest):
        return None
    found = _TOKEN.findall(body)
    if sum([len(x[0]) for x in found]) < len(body):
        return None
    if "&" in body:
        return [(x[1], x[2], x[3], x[4], _resolved(x[5] or x[6])) for x in found if x[1]]
    return [(x[1], x[2], x[3], x[4], x[5] or x[6]) for x in found if x[1]]


def _parsed_cells(data: bytes) -> Iterator[tuple[str, str, str | None, str | None, str]]:
    """The same for any sheet."""
    root = ElementTree.fromstring(data)
    space = root.tag[: -len(_tag(root))]
    value_tag, text_tag = f"{space}v", f"{space}t"
    for cell in root.iter(f"{space}c"):
        place = cell.get("r")
        letters = place.rstrip("0123456789")
        value, texts = None, []
        for part in cell:
            if part.tag != value_tag:
                texts += [t.text or "" for t in part.iter(text_tag)]
            elif value is None:
                value = part.text or ""
        yield letters, place[len(letters) :], cell.get("s"), cell.get("t"), (value or "") + "".join(texts)


def column_number(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out


_SPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: parts of a workbook of one sheet beside the sheet itself; style 1 shows dates
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="xml" ContentType="application/xml"/>'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/>'
    f'<Override PartName="/xl/styles.xml" ContentType="{_TYPES}.styles+xml"/>'
    f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_SPACE}" xmlns:r="{_OFFICE}"><sheets><sheet name="1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/>'
    f'<Relationship Id="r2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_SPACE}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
}


def column_letters(n: int) -> str:
    return column_letters((n - 1) // 26) + chr(65 + (n - 1) % 26) if n else ""


class SheetWriter:
    """A workbook of one sheet, written row by row; cells are texts, numbers, booleans, dates or empty (None)."""

    def __init__(self, target):
        self.target, self.archive, self.n, self.size = target, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED), 0, 0
        for name, text in _PARTS.items():
            self.archive.writestr(name, text)
        self.sheet = self.archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'<worksheet xmlns="{_SPACE}"><sheetData>'.encode())
        self.letters: list[str] = []
        self.lines: list[bytes] = []

    def cell(self, value, place: str) -> str:
        if type(value) in _NUMBERS:
            return f'<c r="{place}"><v>{value}</v></c>'
        if isinstance(value, datetime):
            value = value.isoformat(sep=" ")
        if isinstance(value, str):
            if _SPECIAL.search(value):
                value = escape(_UNWRITABLE.sub("", value))
            return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{value}</t></is></c>'
        if isinstance(value, date):
            return f'<c r="{place}" s="1"><v>{value.toordinal() - _DAY_0}</v></c>'
        return f'<c r="{place}"><v>{int(value) if isinstance(value, bool) else value}</v></c>'

    def row(self, values: list) -> None:
        self.n += 1
        while len(self.letters) < len(values):
            self.letters.append(column_letters(len(self.letters) + 1))
        body = "".join([self.cell(v, f"{x}{self.n}") for v, x in zip(values, self.letters, strict=False) if v is not None])
        line = f'<row r="{self.n}">{body}</row>'.encode()
        self.size += len(line)
        self.lines.append(line)
        if len(self.lines) >= 100:
            self.write()

    def write(self) -> None:
        self.sheet.write(b"".join(self.lines))
        self.lines = []

    def close(self) -> None:
        self.write()
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.archive.close()
        self.target.close()


_NUMBERS = {int, float, Decimal}
#: day 0 of a workbook
_DAY_0 = date(1899, 12, 30).toordinal()
#: characters that XML can't hold
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
#: these, and characters that it has names for
_SPECIAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff&<>]")


class _Kept(io.BytesIO):
    """Bytes that outlive the closing of their file."""

    def close(self) -> None:
        self.content = self.getvalue()
        super().close()


def sheet_bytes(rows: list[list]) -> bytes:
    """A small workbook as bytes."""
    out = _Kept()
    sheet = SheetWriter(out)
    for r in rows:
        sheet.row(r)
    sheet.close()
    return out.content


def _cells_or_error(content: bytes) -> tuple[list[tuple[int, int, str, str]], str | None]:
    try:
        return list(sheet_cells(content)), None
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError) as e:
        plain = type(e) is ValueError and str(e).startswith(("too", "compressed"))
        return [], str(e) if plain else "no workbook"


def cells_or_error(content: bytes) -> Iterator[tuple]:
    """(row, col, text, kind, None) of each cell of a workbook, or one row with an error."""
    found, error = _cells_or_error(content)
    yield from [(*c, None) for c in found] if error is None else [(None, None, None, None, error)]


#: rows of workbooks; cells stand from the last column to the first
LINES = "file string, row int, cells array<struct<col int, text string, kind string>>, error string"
#: bytes of texts in one batch of lines
LINES_BYTES = 4 << 20


def line_batches(files: Iterable[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of LINES: the rows of each workbook (file, content), or one row with an error."""
    names, rows, starts, errors, cols, texts, kinds = ([] for _ in range(7))
    size = 0

    def held() -> pa.RecordBatch:
        cells = pa.StructArray.from_arrays([pa.array(cols, pa.int32()), pa.array(texts, pa.string()), pa.array(kinds, pa.string())], ["col", "text", "kind"])
        values = [pa.array(names, pa.string()), pa.array(rows, pa.int32()), pa.ListArray.from_arrays(pa.array([*starts, len(cols)], pa.int32()), cells), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(values, ["file", "row", "cells", "error"])

    for file, content in files:
        found, error = _cells_or_error(content)
        # from the last row to the first
        found.sort(reverse=True)
        first = [i for i, c in enumerate(found) if not i or c[0] != found[i - 1][0]]
        own = [found[i][0] for i in first] if error is None else [None]
        starts += [len(cols) + i for i in first] if error is None else [len(cols)]
        rows += own
        names += [file] * len(own)
        errors += [error] * len(own)
        for c in found:
            cols.append(c[1])
            texts.append(c[2])
            kinds.append(c[3])
            size += len(c[2])
        size += 64 * len(own)
        if size >= LINES_BYTES:
            yield held()
            for x in (names, rows, starts, errors, cols, texts, kinds):
                x.clear()
            size = 0
    if names:
        yield held()


def lines(files: DataFrame) -> DataFrame:
    """file, row and cells of each row of each workbook, or its error; `files` has file and content (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return line_batches((file, content) for b in batches for file, content in zip(b["file"].to_pylist(), b["content"].to_pylist(), strict=True))

    return files.select(F.col("file").cast("string"), "content").mapInArrow(run, LINES)


def lines_of(found: DataFrame) -> DataFrame:
    """The same of what `cells` gives."""
    if "cells" in found.columns:
        return found
    cell = F.when(F.col("error").isNull(), F.struct("col", "text", "kind"))
    return found.groupBy("file", "row", "error").agg(F.sort_array(F.collect_list(cell), asc=False).alias("cells")).select("file", "row", "cells", "error")


def opened(files: DataFrame, rows_of, names: list[str], schema: str) -> DataFrame:
    """The rows that `rows_of(content)` gives for each file, `names` beside the file; frames hold about FRAME bytes of content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for file, content in zip(frame["file"], frame["content"], strict=True):
                held += [(file, *r) for r in rows_of(bytes(content))]
                size += len(content)
                if size > FRAME:
                    yield pd.DataFrame(held, columns=["file", *names], dtype=object)
                    held, size = [], 0
            yield pd.DataFrame(held, columns=["file", *names], dtype=object)

    return files.select(F.col("file").cast("string"), "content").mapInPandas(run, schema)


def cells(files: DataFrame) -> DataFrame:
    """file, row, col, text and kind of each cell of each workbook, or its error; `files` has file and content (binary)."""
    return opened(files, cells_or_error, ["row", "col", "text", "kind", "error"], "file string, row int, col int, text string, kind string, error string")


def chart_sheets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, line, code, label, kind, kind_sa) of workbooks with a chart of accounts, and (file, error) of those refused.

    The first row names the columns; rows without code and label are left out.
    """
    found = stored(found)
    good = found.filter("error IS NULL")
    head = good.filter("row = 1").select("file", "col", F.lower(stripped(F.col("text"))).alias("_name"))
    width = head.groupBy("file").agg(F.max("col").alias("_width"))
    size = good.groupBy("file").agg((F.max("row") - 1).alias("_rows"))
    error = (
        F.when(F.col("_width") > MOST_COLUMNS, "too many columns")
        .when(F.col("_rows") > MOST_ROWS, "too many rows")
        .when(F.col("_rows") * F.col("_width") > MOST_CELLS, "too many cells")
    )
    refused = size.join(width, "file").select("file", error.alias("error")).filter("error IS NOT NULL")
    refused = refused.unionByName(found.filter("error IS NOT NULL").select("file", "error"))
    names = F.create_map(*[F.lit(x) for n, aliases in CHART_COLUMNS.items() for a in aliases for x in (a, n)])
    named = head.select("file", "col", names[F.col("_name")].alias("_name")).filter("_name IS NOT NULL")
    rows = good.filter("row > 1").join(named, ["file", "col"]).join(refused, "file", "left_anti")
    # of several columns with one meaning the one furthest right counts
    fields = [F.max_by(stripped(F.col("text")), F.when(F.col("_name") == n, F.col("col"))).alias(n) for n in CHART_COLUMNS]
    table = rows.groupBy("file", F.col("row").alias("line")).agg(*fields)
    return table.filter("coalesce(code, '') <> '' OR coalesce(label, '') <> ''"), refused


def archived(files: DataFrame) -> DataFrame:
    """An archive, `file`.zip, for each document, which it holds as `file`.xml."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, content in zip(frame["file"], frame["content"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{file}.xml", content)
                out.append((f"{file}.zip", held.getvalue()))
            yield pd.DataFrame(out, columns=["file", "content"])

    return files.select("file", "content").mapInPandas(run, "file string, content binary")


def archives(documents: DataFrame, key: str) -> DataFrame:
    """file and content of an archive for each value of a key, which holds its documents (file, content) as XML."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for file, content in zip(frame["file"], frame["content"], strict=True):
                z.writestr(f"{file}.xml", content)
        return pd.DataFrame({"file": [str(frame[key].iloc[0])], "content": [held.getvalue()]})

    return documents.groupBy(key).applyInPandas(pack, "file string, content binary")


def members_or_error(source, first: int | None = None, last: int | None = None) -> Iterator[tuple]:
    """(name, content, None) of the XMLs of an archive, of members first to last, or one row with an error.

    Limits hold for the whole archive, by what it declares.
    """
    try:
        with zipfile.ZipFile(source) as z:
            everything = z.infolist()
            infos = [i for i in everything if not i.is_dir()]
            if len(infos) > MOST_FILES:
                error = "too many files"
            elif sum(i.file_size for i in infos) > MOST_BYTES or any(i.file_size > MOST_FILE for i in infos):
                error = "too large"
            elif any(i.file_size > MOST_RATIO * max(1, i.compress_size) for i in infos):
                error = "compressed too far"
            else:
                yield from [(i.filename, z.read(i), None) for i in everything[first:last] if i.filename.lower().endswith(".xml")]
                return
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
        error = "no archive"
    if not first:  # one row an archive, however many tasks read it
        yield None, None, error


def members(files: DataFrame) -> DataFrame:
    """file, name, content and error of each XML in each archive; archives beyond a limit give only an error."""
    return opened(files, lambda content: members_or_error(io.BytesIO(content)), ["name", "content", "error"], "file string, name string, content binary, error string")


def file_kind(files: DataFrame) -> DataFrame:
    """What a file is by its first bytes; an archive with a workbook's parts is one."""

    def workbook(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = []
            for content in frame["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        kinds.append("xlsx" if {"xl/workbook.xml", "[Content_Types].xml"} & set(z.namelist()) else "zip")
                except zipfile.BadZipFile:
                    kinds.append("other")
            yield pd.DataFrame({"file": frame["file"], "kind": kinds})

    head = F.hex(F.substring(F.col("content"), 1, 4))
    kind = F.when(head == "25504446", "pdf").when(F.substring(F.col("content"), 1, 5).cast("string") == "<?xml", "xml").otherwise("other")
    packed = F.coalesce(F.left(head, F.lit(4)) == "504B", F.lit(False))
    rest = files.filter(~packed).select("file", kind.alias("kind"))
    return rest.unionByName(files.filter(packed).select("file", "content").mapInPandas(workbook, "file string, kind string"))


def folders(spark: SparkSession, path: str, name: str = "final.csv") -> DataFrame:
    """Rows of a CSV file that each company's folder has, with the folder's name as `company`."""
    rows = spark.read.csv(f"{path}/*/{name}", header=True, escape='"')
    return rows.withColumn("company", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{re.escape(name)}$", 1))


def chart_json(spark: SparkSession, path: str) -> DataFrame:
    """Accounts of a JSON dump: a list of companies, each with its list of accounts, one row an account."""
    found = spark.read.json(path, multiLine=True)
    return found.select(*[c for c in found.columns if c != "contas"], F.explode("contas").alias("_c")).select("*", "_c.*").drop("_c")
