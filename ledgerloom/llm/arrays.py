"""Words of many texts as numpy arrays, and small helpers that the operators share.

Words are runs of bytes outside space and 0x09-0x0D, with A-Z lower-cased.  A word's 64-bit
hash is a polynomial over random byte weights, so one cumulative sum gives every word of a
chunk without a Python loop over words.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of texts whose words stand in memory at a time
CHUNK = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BYTE_WEIGHTS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
    up, down = np.full(n, _PRIME), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def power_size(n: int) -> int:
    """Size of the table of powers for n bytes; the same for all usual chunks, so that one is kept."""
    return 1 << max(CHUNK.bit_length(), int(n).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that any bits of a hash can serve as bin or order."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of a chunk of texts: hash, number of their text, and byte range in `data`."""

    def __init__(self, texts: list[bytes]):
        self.n_texts = len(texts)
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        blank = SPACE[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate(([0], edge))
        self.data, self.start, self.end = data, edge[0::2], edge[1::2]
        self.text = np.searchsorted(np.cumsum(lengths), self.start, side="right")
        up, down = _powers(power_size(len(data)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_WEIGHTS[data] * up[: len(data)])))
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + np.uint64(1))
        #: words of text t are those from first[t] up to first[t + 1]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on (also past a text's end; mask those with `whole`)."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * _PRIME + h[k : len(h) - n + 1 + k]
        return mix(out)

    def whole(self, n: int) -> np.ndarray:
        """Which n-grams lie within one text."""
        if len(self.hash) < n:
            return np.zeros(0, bool)
        return self.text[: len(self.text) - n + 1] == self.text[n - 1 :]


def sequence_hash(words: np.ndarray) -> int:
    """One hash of a whole short sequence of word hashes, apart from those of n-grams."""
    h = np.array([len(words)], np.uint64)
    for w in words:
        h = h * _PRIME + w
    return int(mix(h ^ np.uint64(0xA5A5A5A5))[0])


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about `size` bytes, with the number of their first text."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def int64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of flat values and the number of values of each row."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only on one machine, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


#: paths of the tables that `stored` has written in this process
_WRITTEN: dict[str, None] = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, name: str) -> None:
    _WRITTEN.pop(name, None)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Deletes a table of `stored` that nothing will read again."""
    if table in _PATHS:
        _delete(table.sparkSession, _PATHS.pop(table))


def forget(spark: SparkSession) -> None:
    """Deletes all tables that `stored` has written; for callers who have read their results to the end."""
    for name in list(_WRITTEN):
        _delete(spark, name)


def tuned(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches for texts: a worker holds a batch several times over, as Arrow, as strings and as words."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it back.

    Any executor can read it again after another is lost, its columns can be pruned, and Spark
    knows its size, so that joins with it are broadcast only below Spark's threshold.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = None
    _PATHS[table] = path
    return table


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
