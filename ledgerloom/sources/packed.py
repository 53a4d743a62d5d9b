"""Spark data sources for files that hold tables inside: workbooks and archives, read in parts and written in parts.

`register(spark)` makes four formats known:

* `workbook` reads the cells of all workbooks under a path (file, row, col, text, kind, error), and writes rows of
  any columns as workbooks, one for each partition, in the order of the rows;
* `workbook_lines` reads their rows (file, row, cells, error), from the last cell of a row to the first;
* `archive` reads the XML members of all archives under a path (file, name, content, error);
* `files` writes rows of (file, content).

Reading is dealt to tasks by size; an archive larger than a task's share is dealt by members.  Limits are checked
by what an archive's directory declares, before anything is inflated, and what is beyond them or broken is a row
with an error.  Writing goes to a staging folder; the driver moves finished parts in place once all are there, and
a job that fails leaves nothing.  Paths are those that pyarrow opens; for others, Spark's `binaryFile` with
`tables.cells` and `tables.members` give the same rows.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import tables

#: bytes of files that one task reads at most and at least, and tasks that a small folder is dealt to
TASK_BYTES, LEAST_BYTES, TASKS = 32 << 20, 64 << 10, 64
#: bytes of values in one batch of rows
BATCH_BYTES = 4 << 20
#: rows and bytes of a written sheet, far within the limits of reading and small enough to be read in one go;
#: further rows go to another file
SHEET_ROWS, SHEET_BYTES = 1_000_000, 16 << 20
CELLS = "file string, row int, col int, text string, kind string, error string"
MEMBERS = "file string, name string, content binary, error string"
FILES = "file string, content binary"


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def found(path: str, ending: str) -> list[tuple[str, int]]:
    """Files under a path whose name has the ending, with their sizes, by name."""
    store, base = at(path)
    infos = store.get_file_info(fs.FileSelector(base, recursive=True))
    named = [(i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(ending)]
    return sorted((p, n) for p, n in named if not any(x.startswith(("_", ".")) for x in posixpath.relpath(p, base).split("/")))


class Share(InputPartition):
    """Files of one task: (path, first member, last member), members None for all."""

    def __init__(self, files: list[tuple[str, int | None, int | None]]):
        self.files = files


def dealt(files: list[tuple[str, int]], parts=None) -> list[Share]:
    """Tasks of equal size, TASK_BYTES at most; `parts` gives the pieces of a file that is larger than that."""
    share = min(TASK_BYTES, max(LEAST_BYTES, sum(n for _, n in files) // TASKS))
    out: list[Share] = []
    held: list[tuple[str, int | None, int | None]] = []
    size = 0
    for path, n in files:
        if parts and n > TASK_BYTES:
            out += [Share([(path, a, b)]) for a, b in parts(path)]
            continue
        held.append((path, None, None))
        size += n
        if size >= share:
            out.append(Share(held))
            held, size = [], 0
    return [*out, Share(held)] if held else out


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(v) for v in r if isinstance(v, (str, bytes)))
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class Folder(DataSource):
    """Shared by the formats: options and paths."""

    @property
    def path(self) -> str:
        return self.options["path"]


# ---- reading


class Cells(DataSourceReader):
    schema = pa.schema([("file", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("error", pa.string())])

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Share]:
        return dealt(found(self.path, ".xlsx")) or [Share([])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, base = at(self.path)

        def rows() -> Iterator[tuple]:
            for path, _, _ in share.files:
                with store.open_input_file(path) as f:
                    content = f.read()
                for r in tables.cells_or_error(content):
                    yield (posixpath.relpath(path, base), *r)

        return batches(rows(), self.schema)


class Lines(Cells):
    """Rows of workbooks instead of cells."""

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, base = at(self.path)

        def files() -> Iterator[tuple[str, bytes]]:
            for path, _, _ in share.files:
                with store.open_input_file(path) as f:
                    yield posixpath.relpath(path, base), f.read()

        return tables.line_batches(files())


class Members(DataSourceReader):
    schema = pa.schema([("file", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def __init__(self, path: str):
        self.path = path

    def pieces(self, path: str) -> list[tuple[int, int]]:
        """Ranges of members that are about TASK_BYTES together."""
        store, _ = at(self.path)
        with store.open_input_file(path) as f:
            try:
                sizes = [i.compress_size for i in zipfile.ZipFile(f).infolist()]
            except zipfile.BadZipFile:
                return [(0, 0)]
        out, first, size = [], 0, 0
        for k, n in enumerate(sizes):
            size += n
            if size >= TASK_BYTES:
                out.append((first, k + 1))
                first, size = k + 1, 0
        return [*out, (first, len(sizes))] if first < len(sizes) or not out else out

    def partitions(self) -> list[Share]:
        return dealt(found(self.path, ".zip"), self.pieces) or [Share([])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, base = at(self.path)

        def rows() -> Iterator[tuple]:
            for path, first, last in share.files:
                with store.open_input_file(path) as f:
                    # a small archive is read in one go, of a large one only the members of this task
                    source = f if first is not None else io.BytesIO(f.read())
                    for r in tables.members_or_error(source, first, last):
                        yield (posixpath.relpath(path, base), *r)

        return batches(rows(), self.schema)


# ---- writing


@dataclass
class Part(WriterCommitMessage):
    """Staged files of one task, and their final names."""

    files: list[tuple[str, str]]


class Staged(DataSourceWriter):
    """Tasks write to a staging folder; the job moves all in place, or deletes all."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def task(self, rows: Iterator, put, number: int) -> None:
        """Writes the rows of a task; `put(name)` opens a file."""
        raise NotImplementedError

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = at(self.path)
        # attempts of one task don't meet
        folder = f"{base}/{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []

        def put(name: str):
            files.append((f"{folder}/{len(files)}", name))
            return store.open_output_stream(files[-1][0])

        self.task(rows, put, context.partitionId())
        return Part(files)

    def commit(self, messages: list[Part | None]) -> None:
        store, base = at(self.path)
        parts = [f for m in messages if m for f in m.files]
        names = [name for _, name in parts]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows name one file")
        if self.overwrite:
            for i in store.get_file_info(fs.FileSelector(base)):
                if posixpath.basename(i.path) != self.staging:
                    (store.delete_dir if i.type == fs.FileType.Directory else store.delete_file)(i.path)
        for folder in {posixpath.dirname(f"{base}/{name}") for name in names} - {base}:
            store.create_dir(folder, recursive=True)
        for staged, name in parts:
            store.move(staged, f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        store, base = at(self.path)
        if store.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.staging}")


class FileWriter(Staged):
    def task(self, rows: Iterator, put, number: int) -> None:
        for file, content in rows:
            with put(file) as f:
                f.write(bytes(content))


class WorkbookWriter(Staged):
    """One workbook for each partition that has rows, and another after every SHEET_ROWS or SHEET_BYTES of them."""

    def __init__(self, path: str, overwrite: bool, names: list[str]):
        super().__init__(path, overwrite)
        self.names = names

    def task(self, rows: Iterator, put, number: int) -> None:
        sheet, files = None, 0
        for r in rows:
            if sheet and (sheet.n > SHEET_ROWS or sheet.size >= SHEET_BYTES):
                sheet.close()
                sheet = None
            if not sheet:
                sheet = tables.SheetWriter(put(f"part-{number:05d}-{files:03d}.xlsx"))
                sheet.row(self.names)
                files += 1
            sheet.row(list(r))
        if sheet:
            sheet.close()


class Workbook(Folder):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return Cells(self.path)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.path, overwrite, schema.names)


class WorkbookLines(Folder):
    @classmethod
    def name(cls) -> str:
        return "workbook_lines"

    def schema(self) -> str:
        return tables.LINES

    def reader(self, schema) -> DataSourceReader:
        return Lines(self.path)


class Archive(Folder):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return Members(self.path)


class Files(Folder):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.path, overwrite)


def register(spark: SparkSession) -> None:
    for kind in (Workbook, WorkbookLines, Archive, Files):
        spark.dataSource.register(kind)
