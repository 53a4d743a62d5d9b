"""Documents and transactions associated as they arrive, with the state that this needs.

The rule is that of `operators.associate.consumed`: transactions in order of (moment, tx_id) take the only free
document within a cent and some days.  A transaction is decided once the watermark has passed all that could still
come before it or near it, so documents may arrive after it, in any order, as late as the watermark lets them.
State of a key holds what isn't decided yet and the free documents near it in time; both go as the watermark moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.associate import DAY

EVENT = "cents long, at long, id long, is_tx int"
TAKEN = "tx_id long, doc_id long"
Event = tuple[int, int, int, int]


#: events handed to the state at a time
SENT = 10_000


def settled(events: np.ndarray, reach: int, until: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the transactions that can be decided when all before `until` is there, and the events still needed.

    Events are rows of cents, at, id and is_tx; they stay in arrays, 32 bytes each, however many a key has.
    Transactions are taken in order; `until` None decides all.
    """
    is_tx = events[:, 3] != 0
    txs, docs = events[is_tx], events[~is_tx]
    ready = np.ones(len(txs), bool) if until is None else txs[:, 1] + reach < until
    due = txs[ready]
    due = due[np.lexsort((due[:, 0], due[:, 2], due[:, 1]))]
    # of a document that is there twice the last counts
    docs = docs[np.lexsort((docs[:, 2], docs[:, 0]))]
    docs = docs[np.append((docs[1:, [0, 2]] != docs[:-1, [0, 2]]).any(axis=1), np.ones(min(1, len(docs)), bool))]
    docs = docs[np.lexsort((docs[:, 1], docs[:, 0]))]
    at, free = docs[:, 1], np.ones(len(docs), bool)
    # documents of one cent less, of the same and of one more stand between these
    bounds = np.stack([np.searchsorted(docs[:, 0], due[:, 0] + k) for k in (-1, 0, 1, 2)], axis=1)
    some = np.flatnonzero(bounds[:, 3] > bounds[:, 0])
    pairs = []
    for when, tx, cut in zip(due[some, 1], due[some, 2], bounds[some], strict=True):
        near = []
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            if low < high:
                first, last = low + np.searchsorted(at[low:high], when - reach), low + np.searchsorted(at[low:high], when + reach, "right")
                near += (first + np.flatnonzero(free[first:last])[:2]).tolist()
        if len(near) == 1:
            free[near[0]] = False
            pairs.append((tx, docs[near[0], 2]))
    pairs = np.array(pairs, np.int64).reshape(-1, 2)
    if until is None:
        return pairs, events[:0]
    # transactions to come are at `until` or later, those that wait are less than the reach before it
    return pairs, np.concatenate((txs[~ready], docs[free & (at + 2 * reach >= until)]))


def decide(events: list[Event], reach: int, until: int | None) -> tuple[list[tuple[int, int]], list[Event]]:
    """`settled` for lists of events."""
    pairs, left = settled(np.array(events, np.int64).reshape(-1, 4), reach, until)
    return list(map(tuple, pairs.tolist())), list(map(tuple, left.tolist()))


class Association(StatefulProcessor):
    def __init__(self, days: int):
        self.reach = days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)

    def settle(self, events: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        """Writes down what still waits, with a timer for the first transaction of it."""
        pairs, left = settled(events, self.reach, watermark * 1000)
        self.waiting.clear()
        for k in range(0, len(left), SENT):
            self.waiting.appendList(list(map(tuple, left[k : k + SENT].tolist())))
        waits = left[left[:, 3] != 0, 1]
        if len(waits):
            self.handle.registerTimer(max((int(waits.min()) + self.reach) // 1000 + 1, watermark + 1))
        yield pd.DataFrame(pairs, columns=["tx_id", "doc_id"])

    def held(self) -> np.ndarray:
        return np.fromiter((int(x) for r in self.waiting.get() for x in r), np.int64).reshape(-1, 4)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [frame[["cents", "at", "id", "is_tx"]].to_numpy(np.int64) for frame in rows]
        yield from self.settle(np.concatenate((self.held(), *new)), max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(self.held(), max(0, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def associated(events: DataFrame, keys: list[str], days: int, late: str) -> DataFrame:
    """(tx_id, doc_id) of a stream of documents and transactions: keys, `moment`, cents, at (microseconds), id and is_tx.

    The session's state store must be RocksDB's, which Spark asks for where state has timers.
    """
    return (
        events.withWatermark("moment", late)
        .groupBy(*keys)
        .transformWithStateInPandas(Association(days), outputStructType=TAKEN, outputMode="append", timeMode="eventTime")
    )


def both_sides(transactions: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """The events of transactions (tx_id) and documents (doc_id), both with keys, moment and cents."""
    side = lambda df, key, n: df.select(*keys, F.col("moment").cast("timestamp").alias("moment"), "cents", F.unix_micros(F.col("moment").cast("timestamp")).alias("at"), F.col(key).alias("id"), F.lit(n).alias("is_tx"))
    return side(transactions, "tx_id", 1).unionByName(side(documents, "doc_id", 0)).filter("moment IS NOT NULL AND cents IS NOT NULL")
