"""Streams with state against the batch rule, tables that a repeated batch doesn't change, and plans that must hold."""

import datetime
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import accounts, associate, exports, repair
from ledgerloom.streaming import association, feeds

START = datetime.datetime(2024, 1, 1)
EVENTS = "company_id int, moment timestamp, cents long, id long, is_tx int"


def in_order(events, reach):
    """Transactions one after another take the only free document."""
    taken, pairs = set(), set()
    for company, at, cents, i, is_tx in sorted(events, key=lambda e: (e[1], e[3])):
        if is_tx:
            near = [d for c, t, a, d, x in events if not x and c == company and d not in taken and abs(a - cents) <= 1 and abs(t - at) <= reach]
            if len(near) == 1:
                taken.add(near[0])
                pairs.add((i, near[0]))
    return pairs


def made(seed, n=150, days=60):
    rng = random.Random(seed)
    return [(rng.randrange(2), START + datetime.timedelta(hours=rng.randrange(24 * days)), rng.randrange(100, 108), i, int(rng.random() < 0.5)) for i in range(n)]


def test_decisions_in_parts_equal_all_at_once():
    for seed in range(5):
        events = [(c, int(t.timestamp() * 1e6), a, i, x) for c, t, a, i, x in made(seed) if c == 0]
        reach, pairs, held = 3 * associate.DAY, [], []
        by_time = sorted(events, key=lambda e: e[1] + random.Random(seed + e[3]).randrange(5 * associate.DAY))  # out of order by up to five days
        for k in range(0, len(by_time), 7):
            held += [(a, t, i, x) for _, t, a, i, x in by_time[k : k + 7]]
            rest = [t for _, t, *_ in by_time[k + 7 :]]
            found, held = association.decide(held, reach, min(rest) if rest else None)
            pairs += found
        assert set(pairs) == in_order(events, reach) and len(pairs) == len(set(pairs))


def test_events_of_a_key_take_little_memory():
    """A year of one company: what deciding holds beyond the events themselves is a few numbers for each."""
    n = 100_000
    rng = random.Random(4)
    events = np.array([(rng.randrange(10**7), rng.randrange(365) * associate.DAY, i, i % 2) for i in range(n)], np.int64)
    tracemalloc.start()
    pairs, left = association.settled(events, 3 * associate.DAY, 0)
    waiting = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    pairs, none = association.settled(events, 3 * associate.DAY, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(left) == n and len(none) == 0 and 0 < len(pairs) < n // 100
    assert waiting < 160 * n and peak < 240 * n
    # a document that is there twice is one, and the last of it counts
    twice = np.array([(5, 0, 1, 1), (5, 9 * associate.DAY, 7, 0), (5, 0, 7, 0), (6, 9 * associate.DAY, 8, 0)], np.int64)
    assert association.settled(twice, associate.DAY, None)[0].tolist() == [[1, 7]]


def test_documents_that_arrive_late(spark, tmp_path):
    """Batch and stream give the same pairs when documents come days after their transactions."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = made(9, 240)
    arrives = sorted(events, key=lambda e: e[1] + datetime.timedelta(days=0 if e[4] else 6))
    rows = [*arrives, (0, datetime.datetime(2200, 1, 1), -9, -1, 0)]
    for k in range(0, len(rows), 60):
        part = spark.createDataFrame(rows[k : k + 60], EVENTS).withColumn("at", F.unix_micros("moment"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = feeds.drained(association.associated(stream, ["company_id"], 3, "7 days"), "append").collect()
    tx = spark.createDataFrame([e for e in events if e[4]], EVENTS).withColumnRenamed("id", "tx_id")
    docs = spark.createDataFrame([e for e in events if not e[4]], EVENTS).withColumnRenamed("id", "doc_id")
    batch = {tuple(r) for r in associate.consumed(tx, docs, ["company_id"], 3).collect()}
    assert len(got) == len(batch) > 10 and {tuple(r) for r in got} == batch == in_order(events, datetime.timedelta(days=3))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    target, source = str(tmp_path / "table"), str(tmp_path / "in")

    def state():
        return sorted((r.event_id, r.n) for r in spark.read.parquet(target).groupBy("event_id").agg(F.count("*").alias("n")).collect())

    def rows(*ids):
        spark.createDataFrame([(i, START + datetime.timedelta(days=i)) for i in ids], "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)

    rows(1, 2, 2)
    feeds.appended(feeds.stream(spark, source), target, "event_id")
    assert state() == [(1, 1), (2, 1)]
    feeds.appended(feeds.stream(spark, source), target, "event_id")
    assert state() == [(1, 1), (2, 1)]
    rows(2, 400)  # a key returns long after any watermark
    feeds.appended(feeds.stream(spark, source), target, "event_id")
    assert state() == [(1, 1), (2, 1), (400, 1)]


def test_sessions_are_a_stream(spark, tmp_path):
    rows = [(1, START + datetime.timedelta(minutes=m)) for m in (0, 10, 29, 80, 200)] + [(2, START)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "events"))
    found = feeds.sessions(feeds.stream(spark, str(tmp_path / "events")))
    assert found.isStreaming
    assert sorted((r.user_id, r.n) for r in feeds.drained(found, "complete").collect()) == [(1, 1), (1, 1), (1, 3), (2, 1)]


def test_trees_of_any_depth_and_cycles(spark):
    deep = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(130)]
    rows = spark.createDataFrame([*deep, ("x", "y"), ("y", "x"), ("z", "z"), ("w", "nobody"), ("v", "a0"), ("v", "x")], "code string, parent string")
    got = {(r.code, r.depth, r.error): r.path for r in accounts.tree(rows).collect()}
    assert got["a129", 130, None] == ">".join(f"a{i}" for i in range(130)) and got["v", 2, None] == "a0>v"
    assert {k[0] for k in got if k[2]} == {"x", "y", "z", "w"} and len(got) == 131 + 4


def test_imports_are_counted_as_they_are_written(spark, tmp_path):
    batch = spark.createDataFrame([(1, None), (1, None), (2, "bad"), (3, None), (4, None)], "key long, error string")
    there = spark.createDataFrame([(3,)], "key long")
    reads = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    passed = batch.mapInPandas(count, batch.schema)
    got = repair.imported(passed, there, str(tmp_path / "t")).first()
    assert tuple(got) == (5, 2, 2, 1) and tuple(repair.import_summary(batch, there).first()) == (5, 2, 2, 1)
    assert {r.key for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1, 4} and reads.value == 5


def test_permits_prune_folders(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 20).cast("int").alias("company_id"), F.col("id").alias("tx_id"))
    laid = exports.laid_out(rows, str(tmp_path / "t"))
    spark.createDataFrame([(1, 3, "extrato"), (1, 4, "*"), (1, 5, "notas"), (2, 6, "*")], "user_id int, company_id int, modules string").write.parquet(str(tmp_path / "p"))
    permits = spark.read.parquet(str(tmp_path / "p"))  # of a known size

    def scanned(user):
        found = exports.allowed(laid, permits, user, "extrato")
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
        n = len(found.collect())
        todo, files = [found._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
            elif "QueryStage" in name:
                todo.append(node.plan())
            else:
                if name.startswith("Scan parquet") and "tx_id" in node.output().toString():
                    files += node.metrics().apply("numFiles").value()
                todo += [node.children().apply(i) for i in range(node.children().size())]
        return n, files

    assert scanned(1) == (40, 2) and scanned(2)[0] == 20
    assert laid.select("company_id").distinct().count() == 20


@pytest.mark.parametrize("value, want", [("1.234,56", "1234.56"), ("(1.234,5)", "-1234.50"), ("1,234", "1234.00"), ("12.5", "12.50"), ("1.234", "1234.00"), ("-7", "-7.00"), ("x", "0.00"), (None, "0.00"), ("(-3,1)", "-3.10")])
def test_sheet_cells(spark, value, want):
    from ledgerloom.functions.numbers import sheet_cell

    assert str(spark.createDataFrame([(value,)], "v string").select(sheet_cell(F.col("v")).alias("v")).first().v) == want


def test_a_tree_of_many_levels_takes_few_steps(spark):
    """Branches at all depths, levels around the ranges of 32, and accounts that no root leads to."""
    parents = {f"a{i}": f"a{i - 1}" if i else None for i in range(200)}
    parents |= {f"b{i}": f"a{i}" for i in range(200)} | {f"c{i}": f"b{i}" for i in range(0, 200, 7)} | {"r": None, "s": "r", "x": "y", "y": "x", "z": "z", "w": "nobody", "u": "w"}

    def path(code):
        return [code] if parents[code] is None else [*path(parents[code]), code]

    lost = {"x", "y", "z", "w", "u"}
    rows = spark.createDataFrame(list(parents.items()), "code string, parent string")
    found = accounts.tree(rows)
    assert "UnionLoop" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.code: (r.path, r.depth, r.error) for r in found.collect()}
    assert got == {c: (None, None, "no root") if c in lost else (">".join(path(c)), len(path(c)), None) for c in parents}
