"""Reports, rules, association and allocation on hand-made ledgers and against sequential models."""

import datetime
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import accounts, aligned, associate, classify, fifo, ledger, repair, reports

DAY = datetime.datetime(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


@pytest.fixture
def books(spark):
    charts = spark.createDataFrame(
        [(1, "3.1", "sales", "receita", False), (1, "4.1", "rent", "despesa", False), (1, "6.1", "goods", "custo", False), (1, "2.1", "loan", "passivo", False), (1, "1.1", "cash", "ativo", False)],
        "company_id int, code string, label string, kind string, deleted boolean",
    )
    rows = [("3.1", "C", 10000), ("4.1", "D", 3000), ("6.1", "D", 2000), ("2.1", "C", 9999)]
    postings = spark.createDataFrame([(1, c, d, Decimal(a), day(40), False) for c, d, a in rows], "company_id int, code string, dc string, amount decimal(15,2), moment timestamp, deleted boolean")
    return charts, postings


def test_income_statement(books):
    charts, postings = books
    total = reports.income_totals(reports.income_statement(postings, charts)).first()
    assert (total.receita, total.custo, total.despesa, total.resultado) == (10000, 2000, 3000, 5000)
    assert reports.income_statement(postings, charts, "2024-01-01", "2024-01-31").count() == 0
    gone = charts.withColumn("deleted", F.col("code") == "3.1")
    assert reports.income_totals(reports.income_statement(postings, gone)).first().receita == 10000


def test_trial_balance(books):
    charts, postings = books
    rows = {r.code: r for r in reports.trial_balance(postings, charts).collect()}
    assert rows["1.1"].debits == rows["1.1"].credit_balance == 0 and len(rows) == 5
    assert rows["4.1"].debit_balance == 3000 and rows["3.1"].credit_balance == 10000
    gone = charts.withColumn("deleted", F.col("code").isin("1.1", "3.1"))
    assert {r.code for r in reports.trial_balance(postings, gone).collect()} == {"3.1", "4.1", "6.1", "2.1"}


def transactions(spark, rows):
    return spark.createDataFrame([(i, 1, 1, m, Decimal(str(a)), d, h, s, False) for i, m, a, d, h, s in rows], "tx_id long, bank_id long, company_id int, moment timestamp, amount decimal(15,2), dc string, history string, status string, deleted boolean")


def test_cash_book(spark):
    rows = transactions(spark, [(1, day(60), 1000, "C", "", "p"), (2, day(61), 400, "D", "", "p"), (3, day(62), 250, "C", "", "p"), (9, day(40), 5000, "C", "", "p")])
    got = reports.cash_book(rows, "2024-03-01", "2024-03-31").orderBy("tx_id").collect()
    assert [r.balance for r in got] == [6000, 5600, 5850]
    total = reports.cash_totals(rows, "2024-03-01", "2024-03-31").first()
    assert (total.opening, total.credits, total.debits, total.closing, total.entries) == (5000, 1250, 400, 5850, 3)


def test_rules(spark):
    rules = spark.createDataFrame(
        [(1, 1, "boleto", "D", "short", "5.1", False, True, "automatica"), (2, 1, "boleto energia", "D", "long", "5.2", True, True, "automatica"), (3, 1, "x", "C", "other", "4.1", False, True, "automatica"), (4, 1, "boleto energia eletrica", "D", "off", "5.3", False, False, "automatica"), (5, 1, "boleto energia eletrica", "D", "by hand", "5.4", False, True, "manual")],
        "rule_id long, bank_id long, text string, dc string, description string, code string, keep_history boolean, active boolean, kind string",
    )
    rows = transactions(spark, [(1, DAY, 10, "D", " BOLETO ENERGIA ELETRICA\t", "pendente"), (2, DAY, 5, "D", "boleto", "pendente"), (3, DAY, 5, "D", "none", "pendente"), (4, DAY, 5, "D", "boleto", "processada")])
    found = classify.matches(rows, rules)
    assert {(r.tx_id, r.rule_id, r.strategy) for r in found.collect()} == {(1, 2, "substring"), (2, 1, "exato")}
    entries = classify.double_entries(found).collect()
    assert len(entries) == 4 and {e.dc for e in entries if e.tx_id == 1} == {"C", "D"} and len({e.entry_id for e in entries}) == 2
    assert {e.text for e in entries if e.tx_id == 2} == {"short"}
    made = classify.decisions(rows, found)
    assert classify.new_decisions(made, made).filter("result = 'sem_regra'").count() == 0


def sequential(txs, docs, days):
    free, out = dict(docs), []
    for i, (m, c) in sorted(txs.items(), key=lambda x: (x[1][0], x[0])):
        near = [k for k, (n, e) in free.items() if abs(e - c) <= 1 and abs((n - m).total_seconds()) <= days * 86_400]
        if len(near) == 1:
            out.append((i, near[0]))
            del free[near[0]]
    return sorted(out)


def test_association_consumes_in_order(spark):
    rng = random.Random(1)
    txs, docs = {}, {}
    for i in range(300):
        txs[i] = (day(rng.randrange(20)), 10_000 + rng.randrange(120))
        if i % 2:
            docs[i] = (day(rng.randrange(20)), 10_000 + rng.randrange(120))
    a = spark.createDataFrame([(1, i, m, c) for i, (m, c) in txs.items()], "bank_id long, tx_id long, moment timestamp, cents long")
    b = spark.createDataFrame([(1, i, m, c) for i, (m, c) in docs.items()], "bank_id long, doc_id long, moment timestamp, cents long")
    assert sorted(map(tuple, associate.consumed(a, b, ["bank_id"], 3).collect())) == sequential(txs, docs, 3)


def test_association_of_one_amount_and_of_stretches(spark):
    """An amount shared by all rows is no group of one task, and what dates part is played apart."""
    rng = random.Random(2)
    txs = {i: (day(3 * rng.randrange(200)), 10_000 + rng.randrange(2)) for i in range(250)}
    docs = {i: (day(3 * rng.randrange(200)), 10_000 + rng.randrange(2)) for i in range(150)}
    a = spark.createDataFrame([(1, i, m, c) for i, (m, c) in txs.items()], "bank_id long, tx_id long, moment timestamp, cents long")
    b = spark.createDataFrame([(1, i, m, c) for i, (m, c) in docs.items()], "bank_id long, doc_id long, moment timestamp, cents long")
    for days in (2, 3):
        found = associate.consumed(a, b, ["bank_id"], days)
        assert sorted(map(tuple, found.collect())) == sequential(txs, docs, days)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_large_suppliers_are_spread(spark):
    rows = spark.range(100_000).selectExpr("if(id < 99990, 1, id) AS supplier_id", "id AS n")
    parts = ledger.dealt(rows, "supplier_id", ["n"], 1_000).groupBy("supplier_id", "_part").count().filter("count > 1")
    assert parts.count() == 100 and parts.agg(F.max("count")).first()[0] < 1_300
    side = spark.range(1, 100_001).selectExpr("1 AS supplier_id", "cast(id AS decimal(25,2)) AS after")
    assert fifo.slices_of(side, side, 64).first().slices == 200
    entries = spark.range(10).selectExpr("1 AS supplier_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, id) AS moment", "'' AS invoice", "1 AS line", "1 AS part", "1 AS quantity", "cast(1 AS decimal(15,2)) AS credit")
    got = fifo.running(entries, "credit")
    assert [(r.n, int(r.before), int(r.after)) for r in got.orderBy("n").collect()] == [(i + 1, i, i + 1) for i in range(10)]


def entries_of(spark, rows):
    return spark.createDataFrame(
        [(s, day(d), str(i), i, 0, 0, Decimal(c).scaleb(-2), Decimal(p).scaleb(-2)) for i, (s, d, c, p) in enumerate(rows)],
        "supplier_id long, moment timestamp, invoice string, line int, part long, quantity int, credit decimal(15,2), debit decimal(15,2)",
    )


def test_fifo_by_hand(spark):
    rows = entries_of(spark, [(1, 1, 10000, 0), (1, 3, 5000, 0), (1, 1, 0, 3000), (1, 2, 0, 9000), (1, 4, 0, 1000)])
    a, b = fifo.running(rows, "credit"), fifo.running(rows, "debit")
    assert [(r.n, float(r.paid), float(r.open), r.status) for r in fifo.paid_state(a, b).orderBy("n").collect()] == [(1, 100, 0, "PAGO"), (2, 30, 20, "PARCIAL")]
    assert sorted((r.purchase, r.payment, float(r.paid)) for r in fifo.pairs(a, b).collect()) == [(1, 1, 30), (1, 2, 70), (2, 2, 20), (2, 3, 10)]
    assert fifo.advances(a, b).first().advance == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 9), st.integers(0, 900), st.booleans()), min_size=1, max_size=60))
def test_fifo_equals_a_queue(spark, rows):
    rows = [(s, d, a if c else 0, 0 if c else a) for s, d, a, c in rows]
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((d, str(i), i, c, p) for i, (x, d, c, p) in enumerate(rows) if x == s)
        queue = [[n, c] for n, c in enumerate([c for *_, c, _ in own if c > 0], 1)]
        for n, p in enumerate([p for *_, p in own if p > 0], 1):
            while p and queue:
                take = min(p, queue[0][1])
                want[s, queue[0][0], n] = take
                queue[0][1] -= take
                p -= take
                if not queue[0][1]:
                    queue.pop(0)
    frame = entries_of(spark, rows)
    got = fifo.pairs(fifo.running(frame, "credit"), fifo.running(frame, "debit"), slices=4).collect()
    assert {(r.supplier_id, r.purchase, r.payment): int(r.paid * 100) for r in got} == want


def test_fifo_deals_rows_once(spark):
    """Running totals join rows with nothing, and what a supplier's ranges need is summed without an order."""
    rows = entries_of(spark, [(1, 1, 100, 0), (None, 1, 300, 0), (1, 1, 50, 0), (None, 2, 400, 0), (1, 3, 25, 0), (1, 2, 0, 120)])
    a, b = fifo.running(rows, "credit"), fifo.running(rows, "debit")
    got = {(r.supplier_id, r.n, int(r.before * 100), int(r.after * 100)) for r in a.collect()}
    assert got == {(1, 1, 0, 100), (1, 2, 100, 150), (1, 3, 150, 175), (None, 1, 0, 300), (None, 2, 300, 700)}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(a)
    assert sum("Window [" in line and "moment" in line for line in plan(fifo.pairs(a, b)).splitlines()) == 2
    assert [(r.purchase, r.payment, int(r.paid * 100)) for r in fifo.pairs(a, b).orderBy("purchase").collect()] == [(1, 1, 100), (2, 1, 20)]


def test_positions(spark):
    suppliers = spark.createDataFrame([(1, "a", Decimal(100), "C"), (2, "b", Decimal(10000), "C"), (3, "c", Decimal(10000), "D"), (4, "d", Decimal(0), "C")], "supplier_id long, name string, opening decimal(15,2), opening_side string")
    rows = entries_of(spark, [(1, 1, 0, 4000), (1, 2, 2000, 0)])
    got = {r.supplier_id: (float(r.payable), r.side, r.status) for r in fifo.positions(suppliers, rows).collect()}
    assert got == {1: (80, "C", "EM_ABERTO"), 2: (10000, "C", "EM_ABERTO"), 3: (-10000, "D", "ADIANTADO"), 4: (0, "", "SEM_MOVIMENTO")}


def test_rereads_and_lines(spark):
    cols = "supplier_id long, n long, day string, lot string, debit double, credit double, balance double, invoice string"
    rows = [(1, 1, "a", None, 5.0, 0.0, 9.0, None), (1, 2, "a", "7", 5.0, 0.0, 9.0, "nf"), (1, 3, "b", "8", 5.0, 0.0, 9.0, None), (1, 4, "c", "8", 5.0, 0.0, 9.0, None), (1, 5, "a", None, 0.0, 0.0, 9.0, None)]
    got = ledger.without_rereads(spark.createDataFrame(rows, cols)).orderBy("n").collect()
    assert [(r.n, r.invoice, r.lot) for r in got] == [(1, "nf", "7"), (3, None, "8"), (5, None, None)]
    line = "20/05/2024 VLR REF PGTO X 1167 VLR REF PGTO X VLR REF PGTO X 9 1.118,34 VLR REF PGTO X 4.095,27C"
    gone = ledger.without_repeats(line)
    assert gone.count("VLR REF PGTO X") == 1 and gone.index("1.118,34") == line.index("1.118,34") and len(gone) == len(line)
    assert ledger.without_repeats("a b c a b c z") == "a b c a b c z"  # fewer than nine words
    assert ledger.without_repeats("a b c d e a b c d e x y") == "a b c d e a b c d e x y"  # twice only
    assert ledger.without_repeats("p q r s p q r s p q r s 1 2 3 1 2 3 1 2 3") == "p q r s                 1 2 3 1 2 3 1 2 3"  # one phrase only, the longest


def test_rereads_equal_the_rule_in_order(spark):
    """Against entries taken one after another: any kept entry before with the day or the lot."""
    rng = random.Random(3)
    for _ in range(3):
        rows = [(1, n, rng.choice("abc"), rng.choice([None, "", "7", "8", "9"]), 5.0, 0.0, float(rng.randrange(3)), rng.choice([None, "nf"])) for n in range(60)]
        kept = []
        for r in rows:
            lot = (r[3] or "").strip()
            day = [k for k in kept if k["day"] == r[2] and k["v"] == r[4:7]]
            same = day or [k for k in kept if lot and k["own"] == lot and k["v"] == r[4:7]]
            if same:
                same[0]["invoice"] = same[0]["invoice"] or r[7]
                same[0]["lot"] = same[0]["lot"] or r[3]
            else:
                kept.append({"n": r[1], "day": r[2], "own": lot, "v": r[4:7], "invoice": r[7], "lot": r[3]})
        cols = "supplier_id long, n long, day string, lot string, debit double, credit double, balance double, invoice string"
        got = ledger.without_rereads(spark.createDataFrame(rows, cols)).collect()
        assert {(r.n, r.invoice, r.lot or None) for r in got} == {(k["n"], k["invoice"], k["lot"] or None) for k in kept}


def aligned_lines(spark, *texts):
    return spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(texts)], "file string, block int, n int, text string")


def test_aligned_blocks(spark):
    head = "Data       Lote   Histórico            Débito Crédito        Saldo"
    at = {"Débito": head.index("Débito") + 6, "Crédito": head.index("Crédito") + 7, "Saldo": len(head)}

    def entry(text, column, amount, balance):
        out = f"{text:<30}"
        out = f"{out[: at[column] - len(amount)]:<{at[column] - len(amount)}}{amount}"
        return f"{out:<{at['Saldo'] - len(balance)}}{balance}C"

    first = entry("05/01/2024 12     PGTO NF 123456", "Débito", "217,75", "1.000,00")
    rows = aligned_lines(spark, "Conta: 7", head, "SALDO ANTERIOR      88,77C", first, "  more text", "123", entry("06/01/2024 13     COMPRA", "Crédito", "350,26", "1.350,26"), "Total da conta:   217,75   350,26")
    got = aligned.entries(rows).orderBy("n").collect()
    assert [(r.lot, r.history, float(r.debit), float(r.credit), float(r.balance), r.side, r.kind) for r in got] == [
        ("12", "PGTO NF 123456 more text", 217.75, 0.0, 1000.0, "C", "PAGAMENTO"), ("13", "COMPRA", 0.0, 350.26, 1350.26, "C", "COMPRA"),
    ]
    assert got[0].invoice == "123456"
    proof = aligned.checked(rows, aligned.entries(rows)).first()
    assert (float(proof.opening), proof.opening_side, proof.entries, proof.proved) == (88.77, "C", 2, True)
    empty = aligned_lines(spark, head, "Total da conta:   0,00   0,00")
    assert aligned.checked(empty, aligned.entries(empty)).first().proved
    unread = aligned_lines(spark, head, "05/01/2024 12   nothing here", "Total da conta:   0,00   0,00")
    assert not aligned.checked(unread, aligned.entries(unread)).first().proved
    assert aligned.checked(aligned_lines(spark, "no header", "Total da conta:   0,00   0,00"), aligned.entries(empty)).count() == 0
    both = f"{entry('07/01/2024 14     X', 'Débito', '5,00', '1,00')}"
    both = both[: at["Crédito"] - 4] + "4,00" + both[at["Crédito"] :]
    sides = spark.createDataFrame([("f", 1, 0, datetime.date(2024, 1, 7), "14", Decimal(0), Decimal(4), k) for k in ("PAGAMENTO",)], "file string, block int, n int, day date, lot string, debit decimal(15,2), credit decimal(15,2), kind string")
    line = aligned.by_position(sides, aligned_lines(spark, "Conta: 7", head, both)).first()
    assert (float(line.debit), float(line.credit), line.kind) == (5.0, 4.0, "COMPRA")
    read = spark.createDataFrame([("f", 1, 0, datetime.date(2024, 1, 5), "12", Decimal(0), Decimal("217.75"), "COMPRA"), ("f", 1, 1, datetime.date(2024, 1, 9), "9", Decimal(1), Decimal(0), "X")], "file string, block int, n int, day date, lot string, debit decimal(15,2), credit decimal(15,2), kind string")
    assert {(r.n, float(r.debit), float(r.credit), r.kind) for r in aligned.by_position(read, rows).collect()} == {(0, 217.75, 0.0, "PAGAMENTO"), (1, 1.0, 0.0, "X")}


def test_accounts_and_names(spark):
    wanted = spark.createDataFrame([("1.1.2",), ("2",), ("3.1.1",), ("x",), ("1.1.1.1.1.1",), ("1",)], "code string")
    there = spark.createDataFrame([("1",), ("1.1",), ("3",)], "code string")
    lines = [(1, i, r.code, "ab", "Ativo ", None) for i, r in enumerate(wanted.collect())] + [(1, 90, "2", "again", "", "s"), (1, 91, "4", " ", "custo", "A"), (1, 92, "2.7", "a child", "", "a"), (1, 93, "5", "xx", "bank", "A")]
    rows = spark.createDataFrame(lines, "company_id int, line int, code string, label string, kind string, kind_sa string")
    own = there.selectExpr("1 AS company_id", "code", "cast(null AS string) AS parent", "'A' AS kind_sa")
    found = accounts.imported(rows, own)
    assert {(r.line, r.outcome, r.parent) for r in found.collect()} == {
        (0, "imported", "1.1"), (1, "imported", None), (2, "parent 3.1", None), (3, "code", None), (4, "level", None), (5, "duplicate", None),
        (90, "duplicate", None), (91, "no label", None), (92, "imported", "2"), (93, "kind", None),
    }
    after = {r.code: r.kind_sa for r in accounts.after_import(found, own).collect()}
    assert after == {"1": "A", "1.1": "S", "3": "A", "1.1.2": "A", "2": "S", "2.7": "A"}
    a = spark.createDataFrame([(1, "Padaria São"), (2, "Dup"), (3, "dup")], "other_id int, name string")
    b = spark.createDataFrame([("PADARIA SAO", "9"), ("DUP", "8")], "name string, tax_id string")
    assert [tuple(r) for r in repair.by_unique_name(a, b).select("other_id", "tax_id").collect()] == [(1, "9")]
