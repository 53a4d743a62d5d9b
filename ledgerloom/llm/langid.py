"""Hierarchical language identification: the family first, then languages within it.

A text is the relative frequencies of its letters' byte pairs and triples, hashed, each scaled
by a square root.  One-versus-one linear support vector machines vote among families, then
another set votes among the languages of the family that won.  They learn from a bounded sample
of each language's documents.

Defined results: a null text, or one without letters, is `und` with score 0; a null id counts as
held out and rows without a language are not learnt from; without any rows to learn from all is
`und`; with one language it is always that one; repeated rows are judged each; texts are read
whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks
from .linear import bounded_sample, distinct_sample, held_out, svm

#: rows of each language to learn from, at most (about), of all languages together, and of each however many there are
SAMPLE, TOTAL, LEAST = 1500, 24_000, 30
BITS = 11
#: languages by family; a language not listed is a family of its own: fixed values
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "cy", "gd", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"],
    "indo-aryan": ["hi", "bn", "ur", "pa", "mr", "gu", "ne", "si"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "semitic": ["ar", "he", "am", "mt"],
    "sino-tibetan": ["zh", "yue", "my", "bo"],
}
_FAMILY_OF = {lang: f for f, langs in FAMILIES.items() for lang in langs}

_KEEP = np.zeros(256, np.uint8)
_KEEP[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def vectors(texts: list[str]) -> np.ndarray:
    """One row of hashed, scaled frequencies for each text."""
    size = 1 << BITS
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(b" " + t.lower().encode() + b"  ", np.uint8)
        data = np.where(_KEEP[data], data, np.uint8(32)).astype(np.uint32)
        pair = data[:-1] * np.uint32(256) + data[1:]
        triple = pair[:-1] * np.uint32(256) + data[2:]
        pair = pair[pair != 0x2020]
        triple = triple[(triple & 0xFFFF) != 0x2020]
        for grams, seed in ((pair, 0x9E3779B1), (triple, 0x85EBCA6B)):
            slot = (grams * np.uint32(seed)) >> np.uint32(32 - BITS)
            out[i] += np.bincount(slot, minlength=size)
        out[i] = np.sqrt(out[i] / max(1.0, out[i].sum()))
    return out


def one_versus_one(x: np.ndarray, y: list[str]) -> tuple[list[str], list]:
    """Classes and a machine for each pair of them."""
    y = np.array(y)
    classes = sorted(set(y.tolist()))
    machines = []
    for a, b in itertools.combinations(range(len(classes)), 2):
        some = (y == classes[a]) | (y == classes[b])
        sign = np.where(y[some] == classes[a], 1.0, -1.0).astype(np.float32)
        w, bias = svm(x[some], sign)
        machines.append((a, b, w.astype(np.float32), bias))
    return classes, machines


def vote(model: tuple[list[str], list], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the class that wins for each row, and how sure its closest pair is."""
    classes, machines = model
    n = len(classes)
    margin = np.full((len(x), n, n), np.inf, np.float32)
    for a, b, w, bias in machines:
        m = x @ w + bias
        margin[:, a, b], margin[:, b, a] = m, -m
    for c in range(n):
        margin[:, c, c] = np.inf
    wins = (margin > 0).sum(axis=2) + np.tanh(np.where(np.isinf(margin), 0, margin).sum(axis=2)) / (2 * n + 2)
    best = wins.argmax(axis=1)
    worst = margin[np.arange(len(x)), best].min(axis=1) if n > 1 else np.full(len(x), np.inf)
    return best, 1 / (1 + np.exp(-np.clip(4 * worst, -40, 40)))


def fit(docs: DataFrame, modulus: int = 3, remainder: int = 1, sample: int = SAMPLE) -> dict:
    """Machines among families and among the languages of each family."""
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", modulus, remainder)
    )
    langs = docs.filter("lang IS NOT NULL").agg(F.count_distinct("lang").alias("n")).first().n
    sample = min(sample, max(LEAST, TOTAL // max(1, langs)))
    rows = distinct_sample(bounded_sample(rows, sample, F.col("doc_id"), F.col("lang")), sample, F.col("lang")).coalesce(8)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in chunks(b.column(1).to_pylist()):
                cells = [v.astype(np.float16).tobytes() for v in vectors(texts)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(2).slice(start, len(texts)), pa.array(cells, pa.binary())], ["lang", "cells"]
                )

    langs, x = [], []
    for r in rows.mapInArrow(project, "lang string, cells binary").toLocalIterator():
        langs.append(r.lang), x.append(np.frombuffer(r.cells, np.float16))
    if not langs:
        return {}
    x = np.stack(x).astype(np.float32)
    families = [family(lang) for lang in langs]
    inner = {}
    for f in set(families):
        own = [i for i, g in enumerate(families) if g == f]
        inner[f] = one_versus_one(x[own], [langs[i] for i in own])
    return {"families": one_versus_one(x, families), "languages": inner}


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not rows or not model:
        return out, score
    x = vectors([texts[i] for i in rows])
    won, sure = vote(model["families"], x)
    for k, f in enumerate(model["families"][0]):
        some = np.flatnonzero(won == k)
        if len(some):
            best, inner = vote(model["languages"][f], x[some])
            for j, lang, s in zip(some, best, inner, strict=True):
                out[rows[j]] = model["languages"][f][0][lang]
                score[rows[j]] = s * sure[j]
    return out, score


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                lang, score = predict(model, texts[i : i + 256])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 256), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
