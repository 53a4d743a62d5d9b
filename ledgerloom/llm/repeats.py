"""Suffix-array dedup: passages of `least` words or more that occur more than once.

1. Suffixes are kept where a content-selected minimiser starts: the least hash of GRAM-word
   sequences in every run of SPAN of them.  Equal passages select equal positions, so of any two
   equal passages of `least` words the first position selected is the same, lies at most SPAN - 1
   words in, and at least `least - SPAN + 1` words follow it in both.
2. The sparse suffix array: suffixes are sorted over all partitions by the hash of their next
   `least - SPAN + 1` words, then by text and place.  Each is compared with its neighbours, and
   those stay that another text's suffix with the same beginning stands beside.  Runs that reach
   the edge of a partition are settled by one row for each edge.
3. Extension: each suffix that stayed is extended left word by word, and right by as much, to all
   passages of `least` words around it; these are sorted and compared with their neighbours too.
   Those that two texts hold are joined to maximal spans.

Words are compared by 64-bit hashes of sequences; n different passages collide with probability
n^2 / 2^65.

Copies of a whole text count as one text and are one span from end to end.

Defined results: null texts and texts of fewer words have no spans; repeats within one text alone
do not count; a null doc_id is a document
like others; repeated rows count as repeats of each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Words, byte_texts, chunks, int64, lists_of, stored

LEAST = 50
GRAM = 8
SPAN = 24


def minimisers(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the least value (leftmost of equals) of every run of `span` values."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(np.arange(len(runs)) + runs.argmin(axis=1))


def window_hashes(words: Words, t: int, n: int) -> np.ndarray:
    """Hash of the n words from each word of text t on."""
    a, b = words.first[t], words.first[t + 1]
    if b - a < n:
        return np.zeros(0, np.uint64)
    h = words.hash[a:b]
    out = h.copy()
    width = 1
    # doubling: out covers `width` words; join halves up to the largest power of two, then overlap
    prime = np.uint64(0xD6E8FEB86659FD93)
    while width * 2 <= n:
        out = (out[:-width] * prime) ^ (out[width:] + np.uint64(width))
        out = out ^ (out >> np.uint64(29))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        width *= 2
    if width < n:
        rest = n - width
        out = (out[: len(h) - n + 1] * prime) ^ out[rest : rest + len(h) - n + 1]
        out = out ^ (out >> np.uint64(31))
    return out


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def suffixes(texts: DataFrame, least: int) -> DataFrame:
    """text_key, number of words, and keys and positions of the suffixes kept, of every row."""
    follow = least - SPAN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in chunks(byte_texts(b.column(1))):
                words = Words(part)
                keys, places, counts = [], [], []
                for t in range(len(part)):
                    at = minimisers(window_hashes(words, t, GRAM), SPAN)
                    after = window_hashes(words, t, follow)
                    at = at[at < len(after)]
                    keys.append(after[at]), places.append(at), counts.append(len(at))
                counts = np.array(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(start, len(part)),
                        pa.array(np.diff(words.first), pa.int64()),
                        lists_of(int64(np.concatenate(keys)), counts, pa.int64()),
                        lists_of(np.concatenate(places).astype(np.int32), counts, pa.int32()),
                    ],
                    ["text_key", "n_words", "keys", "places"],
                )

    schema = "text_key binary, n_words long, keys array<long>, places array<int>"
    return texts.select("text_key", "text").mapInArrow(run, schema)


def passages(texts: DataFrame, least: int) -> DataFrame:
    """text_key, and hashes and starts of the passages of `least` words around the suffixes in `places`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(2).to_pylist()
            for start, part in chunks(byte_texts(b.column(1))):
                words = Words(part)
                hashes, starts, counts = [], [], []
                for t in range(len(part)):
                    full = window_hashes(words, t, least)
                    at = np.array(wanted[start + t] or [], np.int64)
                    near = np.unique((at[:, None] - np.arange(SPAN)).ravel())
                    near = near[(near >= 0) & (near < len(full))]
                    hashes.append(full[near]), starts.append(near), counts.append(len(near))
                counts = np.array(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(start, len(part)),
                        lists_of(int64(np.concatenate(hashes)), counts, pa.int64()),
                        lists_of(np.concatenate(starts).astype(np.int32), counts, pa.int32()),
                    ],
                    ["text_key", "hashes", "starts"],
                )

    return texts.mapInArrow(run, "text_key binary, hashes array<long>, starts array<int>")


def joined_spans(starts: Column, least: int) -> Column:
    """Sorted starts of passages as maximal spans of words (end exclusive)."""
    begins = F.filter(starts, lambda s, i: F.coalesce(s - F.get(starts, i - 1) > least, F.lit(True)))
    ends = F.filter(starts, lambda s, i: F.coalesce(F.get(starts, i + 1) - s > least, F.lit(True)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + least).alias("end")))


def unpacked(packed: DataFrame, values: str, places: str) -> DataFrame:
    """key, text_key and place of each value of each text."""
    pairs = F.arrays_zip(F.col(values).alias("key"), F.col(places).alias("place"))
    return packed.select("text_key", F.inline(pairs)).select("key", "text_key", "place")


#: what is known of a sorted row: two texts hold its key; this partition can't tell; only a mark that two texts do
SHARED, EDGE, MARK = 0, 1, 2


class Run:
    """Rows of one key at the end of what has been read of a sorted partition."""

    def __init__(self, key: int, text: np.ndarray, first: bool):
        self.key, self.text, self.first, self.shared, self.held = key, text, first, False, []

    def told(self, last: bool) -> Iterator[tuple[pa.RecordBatch, int]]:
        """What is left to tell once the run has ended: a run at either edge may go on in the next partition."""
        if (self.first or last) and self.shared:
            yield self.mark, MARK
        elif self.first or last:
            yield from ((rows, EDGE) for rows in self.held)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by (key, text_key, place) the rows whose key stands beside itself in another text.

    Rows of one key follow one another, so a key is shared if a text in its run differs from the run's first.
    """
    run: Run | None = None

    def flagged(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        kinds = pa.array(np.full(rows.num_rows, kind, np.int32))
        return pa.RecordBatch.from_arrays([*rows.columns, kinds], ["key", "text_key", "place", "kind"])

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        texts = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, 2)
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.append(start, len(keys)))
        goes_on = run is not None and run.key == keys[0]
        if run is not None and not goes_on:
            yield from (flagged(*x) for x in run.told(False))
        lead = texts[start]
        if goes_on:
            lead[0] = run.text
        shared = np.logical_or.reduceat((texts != np.repeat(lead, count, axis=0)).any(axis=1), start)
        if goes_on and run.shared:
            shared[0] = True
        if goes_on and shared[0] and not run.shared:  # what was held back is told now
            yield from (flagged(rows, SHARED) for rows in run.held)
            run.held, run.shared, run.mark = [], True, b.slice(0, 1)
        known = np.flatnonzero(np.repeat(shared, count))
        if len(known):
            yield flagged(b.take(pa.array(known)), SHARED)
        for i in sorted({0, len(start) - 1}):  # the first run may end one and the last begin one
            rows = b.slice(int(start[i]), int(count[i]))
            if i or not goes_on:
                began = Run(int(keys[start[i]]), lead[i].copy(), run is None and i == 0)
                if shared[i]:
                    began.shared, began.mark = True, rows.slice(0, 1)
                else:
                    began.held.append(rows)
                if i:  # the first run of this batch has ended
                    yield from (flagged(*x) for x in run.told(False))
                run = began
            elif not shared[0]:
                run.held.append(rows)
    if run is not None:
        yield from (flagged(*x) for x in run.told(True))


def in_two_texts(rows: DataFrame) -> DataFrame:
    """The rows (key, text_key, place) whose key two different texts hold.

    Rows are sorted over all partitions, ties by text and place, so that a key of very many rows is cut like any
    other; each partition compares neighbours, and runs at its edges, one row or a text's own, are settled by key.
    """
    ordered = rows.repartitionByRange("key", "text_key", "place").sortWithinPartitions("key", "text_key", "place")
    told = stored(ordered.mapInArrow(neighbours, "key long, text_key binary, place int, kind int"))
    edges = told.filter(F.col("kind") != SHARED)
    ends = edges.groupBy("key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.max("kind").alias("kind"))
    more = ends.filter((F.col("low") != F.col("high")) | (F.col("kind") == MARK)).select("key")
    settled = told.filter(F.col("kind") == EDGE).join(more, "key", "left_semi")
    return told.filter(F.col("kind") == SHARED).unionByName(settled).drop("kind")


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """text_key and spans array<struct<start, end>> of the texts with passages that other documents hold.

    `docs` needs a column text; positions count words.
    """
    if least < SPAN + GRAM:
        raise ValueError(f"passages must have {SPAN + GRAM} words or more")
    rows = docs.select(text_key().alias("text_key"), "text")
    packed = stored(suffixes(rows, least))
    kept = in_two_texts(unpacked(packed, "keys", "places"))
    places = stored(kept.groupBy("text_key").agg(F.collect_set("place").alias("places")))
    # one plan at every size: texts are dealt by key once, never broadcast against
    marked = rows.hint("merge").join(places, "text_key").select("text_key", "text", "places")
    again = in_two_texts(unpacked(stored(passages(marked, least)), "hashes", "starts"))
    starts = again.groupBy("text_key").agg(F.sort_array(F.collect_set("place")).alias("starts"))
    spans = starts.select("text_key", joined_spans(F.col("starts"), least).alias("spans"))
    # a text that whole documents share is one span from end to end
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    copied = packed.groupBy("text_key").agg(F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
    copies = stored(copied.filter((F.col("copies") > 1) & (F.col("n_words") >= least)).select("text_key", whole.alias("spans")))
    return stored(spans.join(copies, "text_key", "left_anti")).union(copies)


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document with repeated passages: doc_id, n_spans, n_words repeated and the spans.

    Spans are `start:end` in words, joined by commas.
    """
    spans = repeated(docs, least)
    rows = docs.select("doc_id", text_key().alias("text_key"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.join(spans, "text_key").select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"), total.alias("n_words"), text.alias("spans")
    )
