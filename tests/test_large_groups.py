"""What grows badly when done plainly: chains of rereads, one amount on all days, one long file."""

import datetime
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import scratch
from ledgerloom.domain import Ledger
from ledgerloom.operators import aligned, associate, exports, ledger, scans
from ledgerloom.sources import statement

READ = "supplier_id long, n long, day date, lot string, debit decimal(15,2), credit decimal(15,2), balance decimal(15,2), invoice string"


def day(k):
    return datetime.date(2000, 1, 1) + datetime.timedelta(days=k)


def test_a_chain_of_ten_thousand(spark):
    """Each entry shares its lot with the one before and its day with the one after; every other one stays."""
    five, none = Decimal(5), Decimal(0)
    rows = [(1, k, day(k // 2), f"L{(k + 1) // 2}", five, none, five, None) for k in range(10_000)]
    got = sorted(r.n for r in ledger.without_rereads(spark.createDataFrame(rows, READ)).collect())
    assert got == list(range(0, 10_000, 2))


def test_a_hot_set_of_values_is_small_before_it_is_put_in_order(spark):
    """Entries with lots of their own, or none, are settled by their day's first one."""
    five, none = Decimal(5), Decimal(0)
    rows = [(1, k, day(k % 7), None if k % 2 else f"L{k}", five, none, five, None) for k in range(5000)]
    frame = spark.createDataFrame(rows, READ)
    assert sorted(r.n for r in ledger.without_rereads(frame).collect()) == list(range(7))
    lot = F.nullif(F.trim("lot"), F.lit(""))
    named = frame.withColumns({"_in": lot, "_lot": F.coalesce(F.concat(F.lit("="), lot), F.col("day").cast("string"))})
    assert ledger.kept_pairs(named).count() == 7


def test_rereads_with_null_values(spark):
    rows = [(None, 1, None, None, Decimal(5), None, None, None), (None, 2, None, "7", Decimal(5), None, None, "nf"), (None, 3, day(1), "7", Decimal(5), None, None, None), (None, 4, None, None, None, None, None, None)]
    got = ledger.without_rereads(spark.createDataFrame(rows, READ)).collect()
    assert sorted((r.n, r.invoice, r.lot) for r in got) == [(1, "nf", "7"), (3, None, "7"), (4, None, None)]
    assert ledger.without_rereads(spark.createDataFrame([], READ)).count() == 0


MOMENT = datetime.datetime(2024, 1, 1)


def sides(spark, transactions, receipts):
    tx = spark.createDataFrame(transactions, "tx_id long, company_id int, moment timestamp, amount decimal(15,2), dc string")
    docs = spark.createDataFrame(receipts, "receipt_id long, company_id int, bank_id long, paid_at timestamp, paid decimal(15,2), tx_id long, deleted boolean")
    return tx, docs


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(5)

    def at():
        return MOMENT + datetime.timedelta(days=rng.randrange(12), microseconds=rng.choice([0, 0, 1, 86_399_999_999]))

    tx = [(i, rng.randrange(2), at(), Decimal(rng.randrange(95, 105)) / 100, rng.choice("DDC")) for i in range(120)]
    docs = [(i, rng.randrange(2), 1, at(), Decimal(rng.randrange(95, 105)) / 100, None if rng.random() < 0.8 else 1, rng.random() < 0.1) for i in range(60)]
    span = datetime.timedelta(days=3)
    want = {(t[0], d[0]) for t in tx for d in docs if t[4] == "D" and t[1] == d[1] and d[5] is None and not d[6] and abs(t[3] - d[4]) <= Decimal("0.01") and abs(t[2] - d[3]) <= span}
    frames = sides(spark, tx, docs)
    got = [(r.tx_id, r.receipt_id) for r in associate.receipt_candidates(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    alone = {t for t, _ in want if sum(a == t for a, _ in want) == 1}
    assert {(r.tx_id, r.receipt_id) for r in associate.only_receipts(*frames).collect()} == {(t, d) for t, d in want if t in alone}


def rows_after_joins(frame):
    """The most rows that a join of the executed plan gave, by Spark's own metrics."""
    frame.collect()
    most, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_one_fee_on_all_days(spark, monkeypatch):
    """One amount on 400 days: rows met are a small multiple of the pairs, not days times days; hot cells are split."""
    monkeypatch.setattr(associate, "LANE", 20)
    when = [MOMENT + datetime.timedelta(days=k) for k in range(400)]
    fee = Decimal("9.90")
    tx = [(k, 1, when[k % 400], fee, "D") for k in range(2000)]
    docs = [(k, 1, 1, when[k % 400], fee, None, False) for k in range(1200)]
    pairs = associate.receipt_candidates(*sides(spark, tx, docs))
    n = pairs.count()
    assert n == sum(5 * 3 for a in range(400) for b in range(400) if abs(a - b) <= 3)
    assert rows_after_joins(pairs.select("tx_id", "receipt_id")) <= 2 * n


@pytest.mark.parametrize("span", [3, 1 << 16])
def test_long_files_over_many_ranges(spark, monkeypatch, span):
    monkeypatch.setattr(scans, "SPAN", span)
    rng = random.Random(6)
    files = {f: [rng.choice(["Conta: 1 x", "Conta: 2 y", "# entry", " more", "Conta: 1 again"]) for _ in range(200)] for f in "ab"}
    files[None] = ["# lone", "Conta: 9"]
    lines = spark.createDataFrame([(f, n, t) for f, own in files.items() for n, t in enumerate(own)], "file string, n long, text string")
    got = {(r.file, r.n): r.block for r in ledger.blocks(lines, r"^Conta:\s*(\S+)").collect()}
    for f, own in files.items():
        code, block = None, 0
        for n, t in enumerate(own):
            if t.startswith("Conta:") and t.split()[1] != code:
                code, block = t.split()[1], block + 1
            assert got[f, n] == block
    entries = {(r.file, r.n): r.text for r in ledger.joined_continuations(lines, "^# ").collect()}
    want, last = {}, None
    for f, own in files.items():
        last = None
        for n, t in enumerate(own):
            if t.startswith("# "):
                last = (f, n)
                want[last] = t
            elif last:
                want[last] += " " + t.strip()
    assert entries == want


def test_statement_lines_over_many_ranges(spark, monkeypatch):
    rng = random.Random(8)
    shapes = ["05/01 TED 10,00 100,00", "06/01/2024 12345 7,50 107,50", "PIX RECEBIDO", "3.000,00 4.000,00 x", "  1.234,56 9,00", "SALDO 1,00", "99", ""]
    lines = spark.createDataFrame([("f", n, rng.choice(shapes)) for n in range(300)], "file string, n long, text string")
    want = sorted(map(tuple, statement.transactions(lines, 2024).collect()))
    monkeypatch.setattr(scans, "SPAN", 4)
    assert len(want) > 50 and sorted(map(tuple, statement.transactions(lines, 2024).collect())) == want


def test_one_long_file_is_many_tasks(spark):
    lines = spark.range(0, 400_000).select(F.lit("f").alias("file"), F.col("id").alias("n"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("Conta: "), F.col("id").cast("string"))).otherwise("x").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ledger.blocks(lines, r"^Conta:\s*(\S+)")
        assert found.agg(F.max("block")).first()[0] == 400
        spread = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 400_000


def exchanges(frame):
    return len(set(re.findall(r"\((\d+)\) Exchange", frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted"))))


def test_lines_of_ledgers_are_dealt_once(spark):
    """Header, amounts and continuations meet in one order of the lines, and nothing is written between."""
    head = "Data       Lote   Histórico                Cta.C.Part.        Débito       Crédito    Saldo-Exercício"
    entry = "05/01/2024 12     NF 7                      55" + "1.234,50".rjust(head.index("Débito") + 6 - 46)
    texts = [(f"f{f}", 1, n, x) for f in range(3) for n, x in enumerate([head, entry, "   goes on", "x 9,99"])]
    lines = spark.createDataFrame(texts, "file string, block int, n int, text string")
    before = len(scratch._WRITTEN)
    found = aligned.entries(lines)
    assert len(scratch._WRITTEN) == before and exchanges(found) == 1
    assert {(r.file, r.n, float(r.debit), float(r.credit), r.history) for r in found.collect()} == {(f"f{f}", 1, 1234.5, 0.0, "NF 7 goes on x 9,99") for f in range(3)}


def test_invoices_without_a_transaction_are_dealt_to_all_tasks(spark):
    kept = spark.range(4000).select(F.col("id").alias("invoice_id"), F.when(F.col("id") % 100 == 0, F.col("id")).alias("tx_id"))
    tx = spark.range(0, 4000, 200).select(F.col("id").alias("tx_id"), F.lit("x").alias("tx_day"))
    found = exports.with_transactions(kept, tx.hint("merge"))
    assert sorted((r.invoice_id, r.tx_day) for r in found.collect()) == [(i, "x" if i % 200 == 0 else None) for i in range(4000)]
    assert re.search(r"Join LeftOuter, .*_spread", found._jdf.queryExecution().optimizedPlan().toString())


def test_tax_ids_are_checked_once_for_each_company(spark):
    """Their check isn't inferred for the customers and orders that join companies."""
    t = Ledger(spark, "/root/testdata/sf0.001")
    plan = exports.invoices(t.invoices, t.companies, t.transactions, "nfse_tomado")._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x and "c_nationkey" in x]
    assert filters and not any("aggregate(" in x for x in filters)


def shuffles(frame):
    return len(re.findall(r"\bExchange (?:hash|range|round|single)", frame._jdf.queryExecution().executedPlan().toString()))


def test_rereads_are_dealt_once_unless_sets_are_large(spark, monkeypatch):
    """Sets of values of a bounded size take one shuffle; both ways give the rows that a plain loop gives."""
    rng = random.Random(3)
    values = [(s, Decimal(d), Decimal(c), b) for s in (1, 2, None) for d, c in ((5, 0), (0, 5), (0, 0)) for b in (Decimal(1), None)]
    lots, invoices = (None, "", " ", "A", "B", "C", " A"), (None, "", " ", "7", "8")
    rows = [(v[0], n, rng.choice([None, day(0), day(1), day(2)]), rng.choice(lots), *v[1:], rng.choice(invoices)) for n in range(600) for v in [rng.choice(values)]]
    want, kept = [], {}
    for s, n, at, lot, d, c, b, invoice in rows:
        if not d and not c:
            want.append([s, n, at, lot, d, c, b, invoice])
            continue
        of = kept.setdefault((s, d, c, b), [])
        name = (lot or "").strip(" ")
        into = next((k for k in of if k[0] == at), None) or next((k for k in of if name and k[1] == name), None)
        if into is None:
            of.append((at, name, row := [s, n, at, lot or None, d, c, b, invoice or None]))
            want.append(row)
        else:
            for place, x in ((3, lot), (7, invoice)):
                if into[2][place] is None and (x or "").strip(" "):
                    into[2][place] = x
    frame = spark.createDataFrame(rows, READ)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    expected = sorted(key([*r[:4], *[None if x is None else x.quantize(Decimal("0.01")) for x in r[4:7]], r[7]]) for r in want)
    small = ledger.without_rereads(frame)
    assert shuffles(small) == 1
    assert sorted(map(key, small.collect())) == expected
    monkeypatch.setattr(ledger, "LARGE", 40)
    monkeypatch.setattr(ledger, "BUCKETS", 7)
    assert sorted(map(key, ledger.without_rereads(frame).collect())) == expected
    monkeypatch.setattr(ledger, "LARGE", 0)
    assert sorted(map(key, ledger.without_rereads(frame).collect())) == expected


def test_statement_files_are_dealt_once_unless_they_are_long(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["Extrato", " ", "05/01/2024 TED joão 10,00 1,00", "7/1 x 1,00", "SALDO 3,00 4,00", "pix recebido", "123456", "12/02 4803 -2,50 9,99", "boleto 00 1.234,56 0,00", "0,00 0,00 0,00", None, "12345678901234567 x", "31/02/2024 y 5,00 1,00"]
    lines = spark.createDataFrame([(f"f{k % 9}", k, rng.choice(texts)) for k in range(3000)], "file string, n long, text string")
    frame = statement.transactions(lines, 2024)
    assert shuffles(frame) == 1
    short = sorted(map(tuple, frame.collect()))
    assert len(short) > 500
    monkeypatch.setattr(statement, "LARGE", 350)
    monkeypatch.setattr(statement, "BUCKETS", 5)
    monkeypatch.setattr(scans, "SPAN", 64)
    assert sorted(map(tuple, statement.transactions(lines, 2024).collect())) == short
