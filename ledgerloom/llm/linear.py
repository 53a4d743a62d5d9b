"""Small linear models on bounded samples, and the bounded samples themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import stored


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of an id's text leaves the remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def bounded_sample(rows: DataFrame, n: int, by: Column, strata: Column | None = None) -> DataFrame:
    """About `n` rows (of each stratum) at most, the same ones on every run.

    Rows are kept whose hash falls under n / count, so nothing is sorted or sent to one task.
    """
    key = strata if strata is not None else F.lit(0)
    rows = rows.withColumn("stratum", key)
    share = rows.groupBy("stratum").agg(F.least(F.lit(1.0), F.lit(float(n)) / F.count("*")).alias("share"))
    cut = F.pmod(F.xxhash64(by, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return stored(rows.join(stored(share), "stratum").filter(cut < F.col("share")).drop("share", "stratum"))


def distinct_sample(rows: DataFrame, n: int, strata: Column | None = None) -> DataFrame:
    """About `n` (of each stratum) of the distinct rows of a sample by doc_id, with doc_id and text.

    The sample is bounded by its ids; where ids or rows repeat, it is bounded again by what is left once equal rows are one.
    """
    return bounded_sample(rows.distinct(), n, F.xxhash64("doc_id", "text"), strata)


def descend(gradient, size: int, step: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent from zero."""
    w = v = np.zeros(size)
    for k in range(rounds):
        new = v - step * gradient(v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def _largest(x: np.ndarray) -> float:
    """Largest eigenvalue of x'x, from above, by a few power steps."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-30
    return 1.1 * float(np.linalg.norm(x.T @ (x @ v))) + 1e-12


class Presence:
    """A matrix of zeros and ones, held as the places of the ones in each row; a column of ones follows them."""

    def __init__(self, places: np.ndarray, counts: np.ndarray, width: int):
        self.places, self.width, self.shape = places, width, (len(counts), width + 1)
        self.row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.places], minlength=self.shape[0]) + w[-1]

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.places, weights=v[self.row], minlength=self.width), v.sum())


def logistic(x: Presence, y: np.ndarray, ridge: float, penalty: np.ndarray, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression.

    w' `penalty` w is added to the loss: with the mean product of the differences between feature
    rows and their counterfactuals it is the mean square of what the model's logit makes of them.
    """
    n = x.shape[0]
    v, u = np.ones(x.shape[1]), np.ones(x.width)
    for _ in range(12):  # power steps towards the largest eigenvalues
        v = x.transposed(x @ v)
        v /= np.linalg.norm(v)
        u = penalty @ u
        u /= np.linalg.norm(u) + 1e-30
    curve = 1.1 * (np.linalg.norm(x.transposed(x @ v)) / 4 / n + 2 * np.linalg.norm(penalty @ u)) + ridge
    keep = np.append(np.full(x.width, ridge), 0.0)

    def gradient(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.transposed(p - y) / n + keep * w
        g[:-1] += 2 * penalty @ w[:-1]
        return g

    w = descend(gradient, x.shape[1], 1 / curve, rounds)
    return w[:-1], float(w[-1])


def svm(x, y, ridge: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss; y is -1 or 1.

    Both classes weigh the same, however many rows they have.
    """
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x1.dtype)
    curve = 2 * _largest(x1 * np.sqrt(share)[:, None]) + ridge

    def gradient(w):
        slack = np.maximum(0, 1 - y * (x1 @ w.astype(x1.dtype)))
        return -2 * x1.T @ (share * y * slack) + ridge * w

    w = descend(gradient, x1.shape[1], 1 / curve, rounds)
    return w[:-1], float(w[-1])
