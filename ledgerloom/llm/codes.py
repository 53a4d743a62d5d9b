"""Product-quantised vector codes in exact integer arithmetic.

Components become integers floor(SCALE * x) and vectors are cut into equal parts, each with a
codebook of its own that a few rounds of assignment and averaging refine.  The nearest entry is
screened by float32 matrix products: |c|^2 - 2 x.c with an interval that bounds all rounding from
both sides.  Entries whose interval overlaps the best one's upper end are computed again in int64,
and of equal distances the lowest index wins.

A round is one pass over the table: tasks add up their vectors by part and entry before the
shuffle, so the driver gets one codebook's worth of sums whatever the number of rows.

Defined results: rows whose vector is null or holds null or non-finite components are dropped;
shorter vectors count as filled up with zeros to the longest one's length, rounded up to a multiple
of the parts; integers stop at +-2^23, so that sums of squares fit a long for up to 2^15 components;
equal vec_ids start codebooks in order of their vectors, null ids come last; with fewer rows than
entries a codebook has that many; repeated rows are coded each; label errors stop at the largest
long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: largest integer of a component
LIMIT = 1 << 23
#: unit roundoff of float32
UNIT = 2.0**-24
#: vectors that are screened at a time
BLOCK = 4096
#: rows that share the sum of a label before the shuffle that brings it back
SALTS = 16


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, vec and label of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", F.col("embedding").alias("vec"), "label")


def integers(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a list column as an int64 matrix of `size` columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]]
    flat = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def screened(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries (columns) can be nearest to each row of x, by intervals that hold the exact |c|^2 - 2 x.c.

    With u the unit roundoff and d components, conversion to float32 and a product of vectors summed in
    any order err by at most ((1 + u)^(d + 2) - 1) |x||c|; the square, its conversion and the subtraction add two
    more factors.  (d + 8) u with 1 % on top bounds all of them, and norms are taken in float64 with a
    margin of their own.
    """
    wide_x, wide_c = x.astype(np.float64), book.astype(np.float64)
    norm_x = np.sqrt((wide_x * wide_x).sum(axis=1)) * (1 + 1e-12)
    norm_c = np.sqrt((wide_c * wide_c).sum(axis=1)) * (1 + 1e-12)
    square = (book * book).sum(axis=1).astype(np.float32)
    value = square - np.float32(2) * (x.astype(np.float32) @ book.astype(np.float32).T)
    error = 1.01 * (x.shape[1] + 8) * UNIT * (2 * norm_x[:, None] * norm_c + norm_c * norm_c)
    value = value.astype(np.float64)
    return value - error <= (value + error).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lowest of equal ones, and its exact squared distance."""
    row, entry = np.nonzero(screened(x, book))
    gap = x[row] - book[entry]
    distance = (gap * gap).sum(axis=1)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(distance, first)
    at_least = np.flatnonzero(distance == least[row])
    _, place = np.unique(row[at_least], return_index=True)
    return entry[at_least[place]], least


def parted(x: np.ndarray) -> np.ndarray:
    """Rows cut into equal parts: (part, row, component)."""
    return x.reshape(len(x), PARTS, -1).transpose(1, 0, 2)


def blocks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, batch.num_rows, BLOCK):
        yield start, integers(batch.column(column).slice(start, BLOCK), size)


def round_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """cell, total and n: of each part, entry and component the sum of the integers that the entry got, and of how many.

    Every task yields as many rows as the codebooks have numbers.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for _, x in blocks(b, 0, parts * width):
                for p, own in enumerate(parted(x)):
                    code, _ = nearest(own, books[p])
                    np.add.at(total[p], code, own)
                    n[p] += np.bincount(code, minlength=entries)
        there = np.flatnonzero(np.repeat(n.ravel(), width))
        yield pa.RecordBatch.from_arrays(
            [pa.array(there), pa.array(total.ravel()[there]), pa.array(np.repeat(n.ravel(), width)[there])], ["cell", "total", "n"]
        )

    found = rows.select("vec").mapInArrow(run, "cell long, total long, n long")
    return found.groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of rows of `kept`."""
    longest = rows.agg(F.max(F.size("vec")).alias("size")).first().size or 0
    width = -(-longest // PARTS)
    first = rows.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()
    books = parted(integers(pa.array([r.vec for r in first], pa.list_(pa.float64())), PARTS * width)).copy() if first else np.zeros((PARTS, 0, 0), np.int64)
    for _ in range(rounds if books.size else 0):
        flat = books.reshape(-1)
        for r in round_sums(rows, books).collect():
            flat[r.cell] = r.total // r.n
        books = flat.reshape(books.shape)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every row of `kept`."""
    parts, entries, width = books.shape
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, x in blocks(b, 2, parts * width):
                codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, own in enumerate(parted(x)):
                    codes[:, p], distance = nearest(own, books[p])
                    error += distance
                code = pa.array([c.tobytes().hex() for c in codes], pa.string())
                own = [b.column(k).slice(start, len(x)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, code, pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that takes part.

    Label sums are partial before their shuffle.  They come back over `SALTS` copies of each, so
    that rows of one label are met in as many places.
    """
    rows = kept(vectors)
    books = fit(rows)
    found = stored(coded(rows, books))
    most = F.lit((1 << 63) - 1)
    sums = found.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most.cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("lane"))
    lane = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    met = found.withColumn("salt", lane).join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("lane")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
