"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are the words of a text and their beginnings of 4, 5 and 6 bytes (insults inflect),
hashed, each once a text.  The features that tell the labels apart best in a bounded sample of
labelled rows are kept.  A labelled text that names a group also gives counterfactuals: the same
text with the group's name swapped for others of its kind.  The loss adds the square of the
change in the logit, so that what group a text names doesn't move its score.

Defined results: null and empty texts get the score of a text without features; a null id counts
as held out; labels that are null, and ids with several labels, the higher one, are settled before
learning; without any labelled rows, or with labels of one kind only, the score is the base rate
(0 without labels); repeated rows are scored each; texts are scored whole; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _BYTE_WEIGHTS, _powers, chunks, mix, power_size, stored
from .linear import Presence, bounded_sample, distinct_sample, held_out, logistic

#: labelled rows to learn from, at most (about)
SAMPLE = 15_000
#: features kept
KEPT = 1000
BITS = 20
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: kinds of groups whose names are swapped for one another: fixed values
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "queer"],
    ["old", "young", "elderly", "disabled"],
    ["frauen", "männer"],
    ["femmes", "hommes"],
    ["mujeres", "hombres"],
]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def features(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashed features of each text."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    inside = np.concatenate(([False], _LETTER[data]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(power_size(len(data)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_WEIGHTS[data] * up[: len(data)])))
    owner = np.searchsorted(stops, start, side="right")
    found, owners = [], []
    for kind in (0, *PREFIXES):
        some = slice(None) if not kind else end - start > kind
        s, e = start[some], end[some] if not kind else start[some] + kind
        h = mix((total[e] - total[s]) * down[s] + np.uint64(kind + 1))
        found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[some])
    both = np.unique((np.concatenate(owners).astype(np.int64) << BITS) | np.concatenate(found))
    cut = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
    both &= (1 << BITS) - 1
    return [both[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], list[np.ndarray]]]:
    """Labels (0 or 1), texts and their features of rows (text, label), some texts at a time."""
    for b in batches:
        texts, labels = b.column(0).to_pylist(), np.array(b.column(1).to_pylist()) > 0
        for start, part in chunks(texts):
            yield labels[start : start + len(part)].astype(np.int8), part, features(part)


def counterfactuals(text: str, groups: list[list[str]]) -> list[str]:
    """The text with each group name it holds swapped for the other names of its kind."""
    words = text.lower().split()
    bare = [w.strip(".,;:!?\"'()") for w in words]
    out = []
    for names in groups:
        if not any(b in names for b in bare):
            continue
        for other in names:
            swapped = [w.replace(b, other) if b in names else w for w, b in zip(words, bare, strict=True)]
            if swapped != words:
                out.append(" ".join(swapped))
    return out


def labelled(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, sample: int = SAMPLE) -> DataFrame:
    """A bounded sample of distinct (doc_id, text, label) whose ids aren't held out; an id may stand for any number of rows."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id", modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # ids are sampled before texts are met, so that few enough are left for Spark to broadcast them
    chosen = bounded_sample(known, sample, F.col("doc_id"))
    return distinct_sample(stored(docs.select("doc_id", "text").join(chosen, "doc_id")), sample)


def presence(rows: DataFrame) -> DataFrame:
    """feature, and in how many texts of label 1 and of label 0 it stands; summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for labels, _, found in described(batches):
            for y, f in zip(labels, found, strict=True):
                counts[y, f] += 1
        there = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(there), 50_000):
            some = there[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (some, counts[1, some], counts[0, some])], ["feature", "bad", "good"]
            )

    found = rows.mapInArrow(count, "feature long, bad long, good long")
    return found.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def telling(counts: DataFrame, bad: int, good: int, kept: int) -> DataFrame:
    """The `kept` features whose presence tells the labels apart best: signed root of chi square over 3,
    among those met often enough."""
    total = bad + good
    there = F.col("bad") + F.col("good")
    expected = there * (bad / total)
    spread = F.sqrt(expected * (good / total) * (1 - there / total) + 1e-9)
    gap = F.abs(F.col("bad") - expected) / spread
    often = counts.filter(there >= max(5, total / 20_000)).select("feature", gap.alias("gap")).filter("gap > 3")
    return often.orderBy(F.desc("gap"), "feature").limit(kept)


def changes_of(own: np.ndarray, other: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names' features a text has, less those that its counterfactual has."""
    return np.isin(names, own).astype(np.int64) - np.isin(names, other)


def swapped(rows: DataFrame, groups: list[list[str]], names: np.ndarray) -> tuple[np.ndarray, int]:
    """Products of changes, summed over all counterfactuals, and the number of these.

    A swap only moves features of the groups' names, so the sums are one small square matrix
    however many counterfactuals the rows have.
    """
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size), np.int64), 0
        for _, texts, found in described(batches):
            for text, own in zip(texts, found, strict=True):
                for _, others in chunks(counterfactuals(text, groups)):
                    d = np.stack([changes_of(own, f, names) for f in features(others)])
                    total += d.T @ d
                    n += len(d)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total.ravel()[at], n))], ["cell", "amount"]
        )

    out = np.zeros(size * size)
    n = 0
    for r in rows.mapInArrow(run, "cell long, amount long").groupBy("cell").agg(F.sum("amount").alias("amount")).collect():
        if r.cell < 0:
            n = r.amount
        else:
            out[r.cell] = r.amount
    return out.reshape(size, size), n


def fit(rows: DataFrame, groups: list[list[str]] = IDENTITY_TERMS, weight: float = 1.0, kept: int = KEPT) -> dict:
    """A model from labelled rows, whose number must be bounded.

    Spark counts features and adds up the counterfactuals; the driver gets the `kept` features, the
    places of those in each row, and a matrix of the size of the groups' names.
    """
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    rows = rows.filter("label is not null").coalesce(8)
    n = {r.bad: r.n for r in rows.groupBy((F.col("label") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not (bad and good):
        rate = bad / max(1, bad + good)
        return {"features": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))}
    names = np.unique(np.concatenate([f for t in groups for f in features(t)])) if groups else np.zeros(0, np.int64)
    best = [r.feature for r in telling(presence(rows), bad, good, kept).collect()]
    chosen = np.unique(np.concatenate((np.array(best, np.int64), names)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, _, found in described(batches):
            cells = [np.flatnonzero(np.isin(chosen, f, assume_unique=True)).astype(np.int16).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(cells, pa.binary())], ["label", "cells"])

    y, places, counts = [], [], []
    for r in rows.mapInArrow(project, "label byte, cells binary").collect():
        cells = np.frombuffer(r.cells, np.int16)
        y.append(r.label), places.append(cells), counts.append(len(cells))
    penalty = np.zeros((len(chosen), len(chosen)))
    if weight and len(names):
        gram, n_changes = swapped(rows, groups, names)
        at = np.searchsorted(chosen, names)
        penalty[np.ix_(at, at)] = weight * gram / max(1, n_changes)
    x = Presence(np.concatenate(places), np.array(counts), len(chosen))
    w, bias = logistic(x, np.array(y, np.float64), ridge=2e-4, penalty=penalty)
    return {"features": chosen, "weights": w, "bias": bias}


def scores(model: dict, column: pa.Array) -> np.ndarray:
    texts = [t or "" for t in column.to_pylist()]
    out = [predict(model, part) for _, part in chunks(texts)]
    return np.concatenate(out) if out else np.zeros(0)


def predict(model: dict, texts: list[str]) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[model["features"]] = model["weights"]
    logit = np.array([table[f].sum() for f in features(texts)]) + model["bias"] if texts else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row; the model is at most some thousand weights."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(scores(model, b.column(1)), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), score], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def without_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(model, b.column(at)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(labelled(docs, labels))
    return scored(docs, model).select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
