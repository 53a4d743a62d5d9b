"""Rule matching, association, supplier ledgers, cards, accounts and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..domain import Ledger
from ..operators import accounts, associate, cards, classify, exports, fifo, repair
from ..scratch import folder, stored
from ..streaming import association, feeds
from .registry import query, read_back

D25 = "DECIMAL(25,2)"
MATCHED = """hit AS (SELECT t.*, r.rule_id, r.description, r.code, r.keep_history, r.text AS rule_text,
    row_number() OVER (PARTITION BY tx_id ORDER BY (lower(history) = r.text) DESC, length(r.text) DESC, r.rule_id) AS place
    FROM transactions t JOIN rules r ON t.bank_id = r.bank_id AND t.dc = r.dc AND r.active AND contains(lower(t.history), r.text)
    AND r.kind = 'automatica' WHERE t.status = 'pendente'),
matched AS (SELECT *, CASE WHEN lower(history) = rule_text THEN 'exato' ELSE 'substring' END AS strategy FROM hit WHERE place = 1)"""
DECIDED = f"""{MATCHED}, decided AS (SELECT t.tx_id, t.company_id, CASE WHEN m.rule_id IS NULL THEN 'sem_regra' ELSE 'processada' END AS result,
    m.rule_id, m.strategy FROM transactions t LEFT JOIN matched m ON t.tx_id = m.tx_id WHERE t.status = 'pendente')"""


def matched(t: Ledger) -> DataFrame:
    return classify.matches(t.transactions, t.rules)


def decided(t: Ledger) -> DataFrame:
    return classify.decisions(t.transactions, matched(t))


@query("jn10_rule_matches", f"WITH {MATCHED} SELECT tx_id, rule_id, strategy FROM matched")
def _(t: Ledger) -> DataFrame:
    return matched(t).select("tx_id", "rule_id", "strategy")


@query("cl01_rule_decisions", f"WITH {DECIDED} SELECT * FROM decided")
def _(t: Ledger) -> DataFrame:
    return decided(t)


@query("cl02_double_entry", f"""WITH {MATCHED}, two AS (SELECT *, unnest(['main', 'counter']) AS role FROM matched), m AS (SELECT *, md5(CAST(tx_id AS VARCHAR) || ':entry') AS h FROM two)
    SELECT left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || right(h, 12) AS entry_id, tx_id,
    CASE WHEN keep_history THEN history ELSE description END AS text, amount,
    CASE WHEN role = 'main' THEN code ELSE '1.1.B.' || left(md5(CAST(bank_id AS VARCHAR)), 16) END AS code,
    CASE WHEN role = 'main' THEN dc WHEN dc = 'D' THEN 'C' ELSE 'D' END AS dc, role FROM m""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return classify.double_entries(matched(t))


@query("cl03_bank_accounts_to_open", "SELECT bank_id, company_id, '1.1.B.' || left(md5(CAST(bank_id AS VARCHAR)), 16) AS code FROM banks WHERE bank_id % 2 = 1")
def _(t: Ledger) -> DataFrame:
    there = classify.bank_accounts(t.banks.filter("bank_id % 2 = 0"), t.accounts)
    return classify.bank_accounts(t.banks, there)


@query("cl04_new_decisions", f"WITH {DECIDED} SELECT tx_id, result FROM decided WHERE NOT (result = 'sem_regra' AND tx_id % 2 = 0)")
def _(t: Ledger) -> DataFrame:
    found = decided(t)
    return classify.new_decisions(found, found.filter("tx_id % 2 = 0")).select("tx_id", "result")


@query("mg01_missing_counterparts", f"""WITH p AS (SELECT * FROM postings WHERE NOT deleted), o AS (SELECT DISTINCT tx_id, CASE WHEN dc = 'D' THEN 'C' ELSE 'D' END AS dc FROM p)
    SELECT tx_id, CASE WHEN dc = 'D' THEN 'C' ELSE 'D' END AS dc, CAST(sum(amount) AS {D25}) AS amount, count(*) AS postings
    FROM p WHERE (tx_id, dc) NOT IN (SELECT (tx_id, dc) FROM o) GROUP BY 1, 2""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return classify.missing_counterparts(t.postings.filter("NOT deleted"))


RECEIPT_PAIRS = """SELECT t.tx_id, r.receipt_id FROM transactions t JOIN receipts r ON t.company_id = r.company_id AND abs(t.amount - r.paid) <= 0.01
    AND r.paid_at BETWEEN t.moment - INTERVAL 3 DAY AND t.moment + INTERVAL 3 DAY WHERE t.dc = 'D' AND r.tx_id IS NULL AND NOT r.deleted"""
DIRECTED = r"""directed AS (SELECT v.*, CASE WHEN a AND NOT b THEN 'C' WHEN b AND NOT a THEN 'D' END AS side FROM (
    SELECT v.*, regexp_replace(issuer, '\D', '', 'g') = regexp_replace(c.tax_id, '\D', '', 'g') AS a, regexp_replace(recipient, '\D', '', 'g') = regexp_replace(c.tax_id, '\D', '', 'g') AS b
    FROM invoices v JOIN companies c ON v.company_id = c.company_id WHERE v.status = 'pendente' AND v.tx_id IS NULL AND NOT v.deleted) v)"""
INVOICE_PAIRS = """SELECT t.tx_id, i.invoice_id FROM transactions t JOIN directed i ON t.company_id = i.company_id AND t.dc = i.side AND abs(t.amount - i.amount) <= 0.01
    AND i.issued BETWEEN t.moment - INTERVAL 7 DAY AND t.moment + INTERVAL 7 DAY"""


def played(pairs: str, doc: str, more: str = "") -> str:
    """SQL in which the matched transactions of a company, one after another, take the only candidate that is free."""
    return f"""WITH RECURSIVE {MATCHED}{more}, pairs AS ({pairs}),
    turns AS (SELECT m.tx_id, m.company_id, list({doc}) AS docs, row_number() OVER (PARTITION BY m.company_id ORDER BY any_value(m.moment), m.tx_id) AS k
        FROM matched m JOIN pairs p ON m.tx_id = p.tx_id GROUP BY 1, 2),
    play AS (SELECT company_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS tx_id, CAST(NULL AS BIGINT) AS {doc} FROM companies
        UNION ALL SELECT company_id, k, CASE WHEN len(free) = 1 THEN list_append(used, free[1]) ELSE used END, tx_id, CASE WHEN len(free) = 1 THEN free[1] END
        FROM (SELECT n.company_id, n.k, p.used, n.tx_id, list_filter(n.docs, lambda d: NOT list_contains(p.used, d)) AS free
            FROM play p JOIN turns n ON n.company_id = p.company_id AND n.k = p.k + 1)),
    taken AS (SELECT tx_id, {doc} FROM play WHERE {doc} IS NOT NULL)"""


RECEIPTS_TAKEN, INVOICES_TAKEN = played(RECEIPT_PAIRS, "receipt_id"), played(INVOICE_PAIRS, "invoice_id", f", {DIRECTED}")


@query("jn11_receipt_candidates", RECEIPT_PAIRS)
def _(t: Ledger) -> DataFrame:
    return associate.receipt_candidates(t.transactions, t.receipts).select("tx_id", "receipt_id")


@query("jn12_invoice_candidates", f"WITH {DIRECTED} {INVOICE_PAIRS}")
def _(t: Ledger) -> DataFrame:
    return associate.invoice_candidates(t.transactions, t.invoices, t.companies).select("tx_id", "invoice_id")


@query("as01_receipts_once", f"WITH c AS ({RECEIPT_PAIRS}) SELECT tx_id, min(receipt_id) AS receipt_id FROM c GROUP BY tx_id HAVING count(*) = 1")
def _(t: Ledger) -> DataFrame:
    return associate.only_receipts(t.transactions, t.receipts)


@query("as01_receipts_consumed", f"{RECEIPTS_TAKEN} SELECT * FROM taken")
def _(t: Ledger) -> DataFrame:
    return associate.receipts(matched(t), t.receipts)


@query("as02_invoices_consumed", f"{INVOICES_TAKEN} SELECT * FROM taken")
def _(t: Ledger) -> DataFrame:
    return associate.invoices(matched(t), t.invoices, t.companies)


def as_they_arrive(t: Ledger, transactions: DataFrame, documents: DataFrame, keys: list[str], days: int) -> DataFrame:
    """The pairs that a stream of both sides gives, year after year and out of order within each; a last event far ahead decides what is left."""
    events = stored(association.both_sides(transactions, documents, keys).withColumn("year", F.year("moment")))
    path = folder(t.spark)
    years = sorted(r.year for r in events.select("year").distinct().collect())  # one for each year of the data
    end = events.limit(1).select(*keys, F.lit("2200-01-01").cast("timestamp").alias("moment"), F.lit(-9).cast("long").alias("cents"), F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("id"), F.lit(0).alias("is_tx"))
    for year in years:
        events.filter(F.col("year") == year).drop("year").write.mode("append").parquet(path)
    end.write.mode("append").parquet(path)
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = t.spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 64).parquet(path)
    return feeds.drained(association.associated(stream, keys, days, "10 days"), "append")


@query("as01_receipts_streamed", f"{RECEIPTS_TAKEN} SELECT * FROM taken")
def _(t: Ledger) -> DataFrame:
    debits, free = associate.receipt_sides(matched(t), t.receipts)
    rows = free.select("company_id", "cents", F.col("paid_at").alias("moment"), F.col("receipt_id").alias("doc_id"))
    return as_they_arrive(t, debits, rows, ["company_id"], 3).withColumnRenamed("doc_id", "receipt_id")


@query("cl06_run_summary", f"""{RECEIPTS_TAKEN.replace("play AS", "play_r AS").replace("FROM play ", "FROM play_r ").replace("turns", "turns_r").replace("taken AS", "taken_r AS").replace("pairs AS", "pairs_r AS").replace("JOIN pairs ", "JOIN pairs_r ")},
    {INVOICES_TAKEN.split("AS strategy FROM hit WHERE place = 1), ", 1)[1]}, {DECIDED.split("AS strategy FROM hit WHERE place = 1), ", 1)[1]}
    SELECT company_id, count(*) AS total, count(*) FILTER (result = 'processada') AS processed, count(*) FILTER (result = 'sem_regra') AS without_rule,
    count(*) FILTER (result = 'erro') AS errors, count(*) FILTER (tx_id IN (SELECT tx_id FROM taken_r)) AS receipts, count(*) FILTER (tx_id IN (SELECT tx_id FROM taken)) AS invoices
    FROM decided GROUP BY 1""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    found = stored(matched(t))  # three branches build on it
    return classify.summary(decided(t), associate.receipts(found, t.receipts), associate.invoices(found, t.invoices, t.companies))


REQUESTS = """q AS (SELECT tx_id AS doc_id, company_id, CASE tx_id % 3 WHEN 0 THEN 'associate' WHEN 1 THEN 'dissociate' ELSE 'cancel' END AS event,
    CASE WHEN tx_id % 4 = 0 THEN -tx_id ELSE tx_id END AS wanted FROM transactions)"""


def requests(t: Ledger, key: str) -> DataFrame:
    k = F.col("tx_id")
    event = F.when(k % 3 == 0, "associate").when(k % 3 == 1, "dissociate").otherwise("cancel")
    return t.transactions.select(k.alias(key), "company_id", event.alias("event"), F.when(k % 4 == 0, -k).otherwise(k).alias("wanted"))


@query("as03_invoice_requests", f"""WITH {REQUESTS}, o AS (SELECT doc_id AS invoice_id, event, wanted, i.status, i.tx_id, CASE
    WHEN i.invoice_id IS NULL THEN 'unknown document' WHEN event = 'associate' AND status = 'cancelada' THEN 'cancelled' WHEN event = 'associate' AND i.tx_id IS NOT NULL THEN 'conflict'
    WHEN event = 'associate' AND wanted NOT IN (SELECT tx_id FROM transactions) THEN 'unknown transaction' WHEN event = 'dissociate' AND status <> 'associada' THEN 'not associated'
    WHEN event = 'associate' THEN 'associated' WHEN event = 'dissociate' THEN 'free' ELSE 'cancelada' END AS outcome
    FROM q LEFT JOIN (SELECT * FROM invoices WHERE NOT deleted) i ON i.invoice_id = q.doc_id)
    SELECT invoice_id, event, outcome, CASE outcome WHEN 'associated' THEN 'associada' WHEN 'free' THEN 'pendente' WHEN 'cancelada' THEN 'cancelada' ELSE status END AS status,
    CASE WHEN outcome = 'associated' THEN wanted WHEN outcome NOT IN ('free', 'cancelada') THEN tx_id END AS tx_id FROM o""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return associate.requested(t.invoices, t.transactions, requests(t, "invoice_id"), "invoice_id")


@query("as03_receipt_requests", f"""WITH {REQUESTS}, o AS (SELECT doc_id AS receipt_id, event, wanted, r.tx_id, CASE
    WHEN r.receipt_id IS NULL THEN 'unknown document' WHEN event = 'associate' AND r.tx_id IS NOT NULL THEN 'conflict'
    WHEN event = 'associate' AND wanted NOT IN (SELECT tx_id FROM transactions) THEN 'unknown transaction' WHEN event = 'dissociate' AND r.tx_id IS NULL THEN 'not associated'
    WHEN event = 'associate' THEN 'associated' WHEN event = 'dissociate' THEN 'free' ELSE 'unknown event' END AS outcome
    FROM q LEFT JOIN (SELECT * FROM receipts WHERE NOT deleted) r ON r.receipt_id = q.doc_id)
    SELECT receipt_id, event, outcome, CASE WHEN outcome = 'associated' THEN wanted WHEN outcome <> 'free' THEN tx_id END AS tx_id FROM o""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return associate.requested(t.receipts, t.transactions, requests(t, "receipt_id"), "receipt_id")


MANUAL = f"""{DECIDED}, q AS (SELECT tx_id, CASE WHEN tx_id % 5 = 0 THEN company_id + 1 ELSE company_id END AS company_id,
    CASE WHEN tx_id % 4 = 0 THEN '9.99' ELSE '4.11' END AS code, 'by hand ' || CAST(tx_id AS VARCHAR) AS description FROM transactions),
    m AS (SELECT q.tx_id, q.company_id, q.code, q.description, t.history, t.amount, t.dc, t.bank_id, CASE WHEN d.tx_id IS NULL THEN 'unknown decision' WHEN d.result <> 'sem_regra' THEN 'decided already'
    WHEN t.status <> 'pendente' THEN 'posted already' WHEN (q.company_id, q.code) NOT IN (SELECT (company_id, code) FROM charts WHERE NOT deleted) THEN 'unknown account' ELSE 'associada' END AS outcome
    FROM q LEFT JOIN decided d ON q.tx_id = d.tx_id AND q.company_id = d.company_id LEFT JOIN transactions t ON q.tx_id = t.tx_id AND q.company_id = t.company_id)"""


def by_hand(t: Ledger) -> DataFrame:
    k = F.col("tx_id")
    wanted = t.transactions.select(
        "tx_id",
        F.when(k % 5 == 0, F.col("company_id") + 1).otherwise(F.col("company_id")).alias("company_id"),
        F.when(k % 4 == 0, "9.99").otherwise("4.11").alias("code"),
        F.concat(F.lit("by hand "), k.cast("string")).alias("description"),
    )
    return classify.manual(wanted, decided(t), t.transactions, t.charts)


@query("cl05_manual_requests", f"WITH {MANUAL} SELECT tx_id, outcome FROM m")
def _(t: Ledger) -> DataFrame:
    return by_hand(t).select("tx_id", "outcome")


@query("cl05_manual_entries", f"""WITH {MANUAL} SELECT tx_id, history, amount, CASE WHEN main THEN code ELSE '1.1.B.' || left(md5(CAST(bank_id AS VARCHAR)), 16) END AS account,
    CASE WHEN main THEN description ELSE 'Contrapartida bancária: ' || description END AS text, CASE WHEN main THEN dc WHEN dc = 'D' THEN 'C' ELSE 'D' END AS side
    FROM m, (VALUES (true), (false)) v(main) WHERE outcome = 'associada'""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return classify.manual_entries(by_hand(t))


@query("prj08_decision_log", f"""WITH {DECIDED} SELECT d.tx_id, d.rule_id, d.company_id, d.result, d.strategy, bank_id, history, amount, dc, r.description AS rule
    FROM decided d LEFT JOIN (SELECT tx_id, bank_id, history, amount, dc FROM transactions) USING (tx_id) LEFT JOIN (SELECT rule_id, description FROM rules) r ON d.rule_id = r.rule_id""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return classify.decision_list(decided(t), t.transactions, t.rules)


@query("wn04_first_unmatched_decision", f"""WITH {DECIDED}, log AS (SELECT tx_id, run, tx_id * 10 + (7 - run) AS id FROM decided, (VALUES (1), (2), (3)) r(run) WHERE result = 'sem_regra')
    SELECT tx_id, id FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY run, id) AS n FROM log) WHERE n = 1""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    runs = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run")
    log = decided(t).filter("result = 'sem_regra'").select("tx_id", runs).withColumn("id", F.col("tx_id") * 10 + 7 - F.col("run"))
    return repair.first_of(log, ["tx_id"], ["run", "id"]).select("tx_id", "id")


RUNNING = """p AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS n, CAST(sum(amount) OVER (w ROWS UNBOUNDED PRECEDING) AS DECIMAL(25,2)) AS after
    FROM (SELECT *, {side} AS amount FROM entries WHERE {side} > 0)
    WINDOW w AS (PARTITION BY supplier_id ORDER BY moment, invoice, line, part, quantity, amount))"""
BOUGHT, PAID = RUNNING.format(side="credit").replace("p AS", "bought AS", 1), RUNNING.format(side="debit").replace("p AS", "paid AS", 1)


def sides(t: Ledger) -> tuple[DataFrame, DataFrame]:
    return fifo.running(t.entries, "credit"), fifo.running(t.entries, "debit")


@query("f05_fifo_state", f"""WITH {BOUGHT}, s AS (SELECT supplier_id, sum(debit) AS total FROM entries WHERE debit > 0 GROUP BY 1),
    x AS (SELECT supplier_id, n, invoice, amount, CAST(least(greatest(coalesce(total, 0) - (after - amount), 0), amount) AS {D25}) AS paid
    FROM bought LEFT JOIN s USING (supplier_id))
    SELECT *, CAST(amount - paid AS {D25}) AS open, CASE WHEN paid = 0 THEN 'PENDENTE' WHEN paid = amount THEN 'PAGO' ELSE 'PARCIAL' END AS status FROM x""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return fifo.paid_state(*sides(t))


@query("f05_fifo_pairs", f"""WITH {BOUGHT}, {PAID} SELECT b.supplier_id, b.n AS purchase, d.n AS payment,
    CAST(least(b.after, d.after) - greatest(b.after - b.amount, d.after - d.amount) AS {D25}) AS paid
    FROM bought b JOIN paid d ON b.supplier_id = d.supplier_id AND b.after - b.amount < d.after AND d.after - d.amount < b.after""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return fifo.pairs(*sides(t))


@query("f05_advances", f"""WITH b AS (SELECT supplier_id, sum(credit) AS c, sum(debit) AS d FROM entries GROUP BY 1 HAVING sum(credit) > 0)
    SELECT supplier_id, CAST(greatest(d - c, 0) AS {D25}) AS advance FROM b""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return fifo.advances(*sides(t))


POSITIONS = f"""WITH s AS (SELECT supplier_id, CAST(sum(debit) AS {D25}) AS debits, CAST(sum(credit) AS {D25}) AS credits, count(*) AS entries_n
    FROM entries GROUP BY 1),
x AS (SELECT supplier_id, name, CAST(CASE WHEN opening_side = 'D' THEN -abs(opening) ELSE abs(opening) END AS {D25}) AS opening,
    coalesce(debits, 0) AS debits, coalesce(credits, 0) AS credits, coalesce(entries_n, 0) AS entries FROM suppliers LEFT JOIN s USING (supplier_id)),
y AS (SELECT supplier_id, name, opening, CAST(debits AS {D25}) AS debits, CAST(credits AS {D25}) AS credits, entries,
    CAST(opening + credits - debits AS {D25}) AS payable FROM x),
positions AS (SELECT *, CASE WHEN payable > 0 THEN 'C' WHEN payable < 0 THEN 'D' ELSE '' END AS side,
    CASE WHEN entries = 0 AND opening = 0 THEN 'SEM_MOVIMENTO' WHEN payable = 0 THEN 'QUITADO' WHEN payable < 0 THEN 'ADIANTADO' ELSE 'EM_ABERTO' END AS status FROM y)
"""


def positions(t: Ledger) -> DataFrame:
    return fifo.positions(t.suppliers, t.entries)


@query("f06_supplier_position", POSITIONS + "SELECT * FROM positions")
def _(t: Ledger) -> DataFrame:
    return positions(t)


@query("ag14_ledger_summary", POSITIONS + f"""SELECT count(*) AS suppliers, count(*) FILTER (status = 'QUITADO') AS quitado, count(*) FILTER (status = 'EM_ABERTO') AS em_aberto,
    count(*) FILTER (status = 'ADIANTADO') AS adiantado, count(*) FILTER (status = 'SEM_MOVIMENTO') AS sem_movimento, CAST(sum(payable) AS {D25}) AS payable FROM positions""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return fifo.summary(positions(t))


@query("st02_top_suppliers", POSITIONS + "SELECT supplier_id, payable FROM positions WHERE status = 'EM_ABERTO' ORDER BY payable DESC, supplier_id LIMIT 10 OFFSET 5")
def _(t: Ledger) -> DataFrame:
    ranked = positions(t).filter("status = 'EM_ABERTO'").orderBy(F.desc("payable"), "supplier_id")
    return ranked.offset(5).limit(10).select("supplier_id", "payable")


DECLARED = f"""s AS (SELECT supplier_id, CAST(sum(debit) AS {D25}) AS debits, CAST(sum(credit) AS {D25}) AS credits FROM entries GROUP BY 1),
    d AS (SELECT *, CASE WHEN supplier_id % 4 = 0 THEN debits + 1 WHEN supplier_id % 4 = 1 THEN 0 ELSE debits END AS dd, CASE WHEN supplier_id % 6 = 0 THEN credits - 1 ELSE credits END AS dc FROM s),
    off AS (SELECT supplier_id, concat_ws('; ', CASE WHEN dd > 0 AND abs(debits - dd) > 0.01 THEN 'debits ' || CAST(debits AS VARCHAR) || ' <> ' || CAST(CAST(dd AS {D25}) AS VARCHAR) END,
    CASE WHEN dc > 0 AND abs(credits - dc) > 0.01 THEN 'credits ' || CAST(credits AS VARCHAR) || ' <> ' || CAST(CAST(dc AS {D25}) AS VARCHAR) END) AS message
    FROM d WHERE (dd > 0 AND abs(debits - dd) > 0.01) OR (dc > 0 AND abs(credits - dc) > 0.01))"""


def divergent(t: Ledger) -> DataFrame:
    k = F.col("supplier_id")
    sums = t.entries.groupBy("supplier_id").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"))
    declared = sums.select(
        "supplier_id",
        F.when(k % 4 == 0, F.col("d") + 1).when(k % 4 == 1, 0).otherwise(F.col("d")).cast("decimal(25,2)").alias("declared_debits"),
        F.when(k % 6 == 0, F.col("c") - 1).otherwise(F.col("c")).cast("decimal(25,2)").alias("declared_credits"),
    )
    return fifo.divergences(declared, t.entries)


WORKBOOK = POSITIONS.replace("positions AS", "found AS") + f""", {DECLARED.replace("s AS", "sums AS", 1).replace("FROM s)", "FROM sums)")}, {BOUGHT}, paid AS (SELECT supplier_id, sum(debit) AS total FROM entries WHERE debit > 0 GROUP BY 1),
    pending AS (SELECT supplier_id, count(*) AS pending FROM bought LEFT JOIN paid USING (supplier_id) WHERE after > coalesce(total, 0) GROUP BY 1)
    SELECT CAST(supplier_id AS VARCHAR) AS code, s.account, name, s.tax_id, credits, debits, payable, status, coalesce(pending, 0) AS pending, CASE WHEN message IS NULL THEN 'Não' ELSE 'Sim' END AS divergent
    FROM found LEFT JOIN (SELECT supplier_id, account, tax_id FROM suppliers) s USING (supplier_id) LEFT JOIN off USING (supplier_id) LEFT JOIN pending USING (supplier_id)"""


def _workbook(which: str, where: str) -> None:
    @query(f"snk05_positions_{which}", WORKBOOK + where)
    def _(t: Ledger) -> DataFrame:
        return exports.positions(positions(t), t.suppliers, divergent(t), fifo.pending(fifo.paid_state(*sides(t))), which)


for _which, _where in {"completo": "", "em_aberto": " WHERE status = 'EM_ABERTO'", "divergencias": " WHERE message IS NOT NULL"}.items():
    _workbook(_which, _where)


@query("f07_divergences", f"WITH {DECLARED} SELECT * FROM off")
def _(t: Ledger) -> DataFrame:
    return divergent(t)


@query("jn03_open_divergences", f"WITH {DECLARED} SELECT supplier_id, message, false AS resolved FROM off WHERE supplier_id % 4 = 0 AND supplier_id % 5 <> 0")
def _(t: Ledger) -> DataFrame:
    k = F.col("supplier_id")
    files = t.suppliers.select("supplier_id", (k % 4).alias("file_id"))
    return fifo.open_divergences(divergent(t).withColumn("resolved", k % 5 == 0), files, 0)


@query("ag15_totals_or_declared", f"""WITH s AS (SELECT supplier_id, sum(debit) AS d, sum(credit) AS c FROM entries GROUP BY 1)
    SELECT n.supplier_id, CAST(CASE WHEN d > 0 THEN d ELSE 7 END AS {D25}) AS debits, CAST(CASE WHEN c > 0 THEN c ELSE 5 END AS {D25}) AS credits
    FROM (SELECT supplier_id FROM suppliers UNION ALL SELECT -supplier_id FROM suppliers) n LEFT JOIN s ON n.supplier_id = s.supplier_id""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("supplier_id")
    declared = t.suppliers.select(F.explode(F.array(k, -k)).alias("supplier_id"), F.lit(7).alias("declared_debits"), F.lit(5).alias("declared_credits"))
    return fifo.totals(declared, t.entries)


@query("prj17_pending_purchases", f"""WITH {BOUGHT}, s AS (SELECT supplier_id, sum(debit) AS total FROM entries WHERE debit > 0 GROUP BY 1)
    SELECT supplier_id, n, invoice, amount, CAST(amount - greatest(coalesce(total, 0) - (after - amount), 0) AS {D25}) AS open FROM bought LEFT JOIN s USING (supplier_id) WHERE after > coalesce(total, 0)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return fifo.pending(fifo.paid_state(*sides(t))).select("supplier_id", "n", "invoice", "amount", "open")


@query("f13_supplier_detail", POSITIONS + f""", {BOUGHT}, spent AS (SELECT sum(debit) AS total FROM entries WHERE supplier_id = 3),
    e AS (SELECT *, row_number() OVER (ORDER BY moment, invoice, line, part, quantity, credit, debit) AS place FROM entries WHERE supplier_id = 3)
    SELECT 'position' AS what, 0 AS place, NULL AS invoice, payable AS amount, status FROM positions WHERE supplier_id = 3
    UNION ALL SELECT 'entry', CAST(place AS INTEGER), invoice, CAST(credit - debit AS {D25}), CASE WHEN debit > 0 THEN 'PAGAMENTO' ELSE 'COMPRA' END FROM e
    UNION ALL SELECT 'pending', n, invoice, CAST(amount - greatest(coalesce(total, 0) - (after - amount), 0) AS {D25}), CASE WHEN after - amount >= coalesce(total, 0) THEN 'PENDENTE' ELSE 'PARCIAL' END
    FROM bought, spent WHERE supplier_id = 3 AND after > coalesce(total, 0)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return fifo.detail(positions(t), t.entries, fifo.paid_state(*sides(t)), 3)


SERIES = "CASE WHEN line % 2 = 0 THEN '2' ELSE '1' END"


@query("ag16_consolidated_purchases", f"""WITH e AS (SELECT *, CASE WHEN line % 5 = 0 THEN NULL ELSE invoice END AS nf, {SERIES} AS series, credit AS amount FROM entries WHERE credit > 0)
    SELECT supplier_id, nf AS invoice, series, CAST(moment AS DATE) AS day, CAST(sum(amount) AS {D25}) AS credit, count(*) AS originals, min(line) AS first_line
    FROM e GROUP BY supplier_id, nf, series, CAST(moment AS DATE), CASE WHEN nf IS NULL THEN CAST(line AS VARCHAR) || '/' || CAST(part AS VARCHAR) || '/' || CAST(amount AS VARCHAR) END""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    line = F.col("line")
    rows = t.entries.withColumns({"invoice": F.when(line % 5 != 0, F.col("invoice")), "series": F.when(line % 2 == 0, "2").otherwise("1")})
    return fifo.consolidated(rows)


@query("f09_merged_fragments", """WITH f AS (SELECT supplier_id % 20 AS code, supplier_id AS n, opening, opening_side FROM suppliers)
    SELECT code, count(*) AS fragments, arg_min(opening, n) AS opening, arg_max(opening, n) AS declared FROM f GROUP BY 1""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    rows = t.suppliers.select((F.col("supplier_id") % 20).alias("code"), F.col("supplier_id").alias("n"), "opening", F.col("opening").alias("declared"))
    return repair.merged_fragments(rows)


@query("cc01_card_totals", f"""WITH i AS (SELECT v.card_id, v.month, v.status, count(e.entry_id) AS n, CAST(coalesce(sum(e.amount), 0) AS {D25}) AS total
    FROM card_invoices v LEFT JOIN card_entries e ON v.card_id = e.card_id AND v.month = e.month AND NOT e.deleted GROUP BY ALL),
    o AS (SELECT card_id, arg_max(total, month) AS open_total FROM i WHERE status = 'aberta' GROUP BY 1)
    SELECT c.card_id, label, count(i.month) AS invoices, CAST(coalesce(sum(n), 0) AS BIGINT) AS entries, CAST(coalesce(sum(total), 0) AS {D25}) AS total,
    CAST(coalesce(any_value(open_total), 0) AS {D25}) AS open_total
    FROM cards c LEFT JOIN i ON c.card_id = i.card_id LEFT JOIN o ON c.card_id = o.card_id GROUP BY 1, 2""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return cards.totals(t.cards, t.card_invoices, t.card_entries)


@query("jn04_card_invoice_totals", f"""SELECT v.card_id, v.month, v.status, count(e.entry_id) AS entries, CAST(coalesce(sum(e.amount), 0) AS {D25}) AS total
    FROM card_invoices v LEFT JOIN card_entries e ON v.card_id = e.card_id AND v.month = e.month AND NOT e.deleted GROUP BY ALL""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return cards.invoice_totals(t.card_invoices, t.card_entries)


@query("jn02_invoices_with_card", "SELECT v.card_id, v.month, v.status, c.company_id, c.label FROM card_invoices v JOIN cards c ON v.card_id = c.card_id WHERE v.month <> '1997-05'")
def _(t: Ledger) -> DataFrame:
    rows = t.card_invoices.withColumn("deleted", F.col("month") == "1997-05")
    return cards.with_card(rows, t.cards)


@query("as04_card_payments", f"""WITH i AS (SELECT v.card_id, v.month, c.company_id, v.status, CAST(coalesce(sum(e.amount) FILTER (NOT e.deleted), 0) AS {D25}) AS total, min(e.entry_id) AS entry
        FROM card_invoices v JOIN cards c ON v.card_id = c.card_id JOIN card_entries e ON v.card_id = e.card_id AND v.month = e.month GROUP BY ALL),
    p AS (SELECT *, CASE WHEN status = 'paga' AND entry % 2 = 0 THEN entry END AS tx_id, CASE WHEN entry % 5 = 0 THEN -entry ELSE entry END AS wanted FROM i)
    SELECT p.card_id, p.month, p.company_id, p.wanted, CASE WHEN p.tx_id IS NOT NULL THEN 'paid already' WHEN t.tx_id IS NULL THEN 'unknown transaction'
        WHEN wanted IN (SELECT tx_id FROM p WHERE tx_id IS NOT NULL) THEN 'pays another' WHEN t.dc <> 'D' THEN 'no debit' WHEN t.amount <> p.total THEN 'other amount' ELSE 'paga' END AS outcome
    FROM p LEFT JOIN transactions t ON t.tx_id = p.wanted AND t.company_id = p.company_id""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    firsts = t.card_entries.groupBy("card_id", "month").agg(F.min("entry_id").alias("entry"))
    rows = cards.invoice_totals(t.card_invoices, t.card_entries).join(t.cards.select("card_id", "company_id"), "card_id").join(firsts, ["card_id", "month"])
    entry = F.col("entry")
    rows = rows.withColumn("tx_id", F.when((F.col("status") == "paga") & (entry % 2 == 0), entry))
    wanted = rows.select("card_id", "month", "company_id", F.when(entry % 5 == 0, -entry).otherwise(entry).alias("wanted"))
    return cards.settled(wanted, rows, t.transactions)


TREE = """SELECT DISTINCT left(code, 1) AS code, CAST(NULL AS VARCHAR) AS parent FROM accounts UNION ALL SELECT code, left(code, 1) FROM accounts"""
#: chains of the bank accounts of a company, and one account that is its own ancestor
CHAINS = """SELECT CAST(bank_id AS VARCHAR) AS code, CAST(lag(bank_id) OVER (PARTITION BY company_id, bank_id % 31 ORDER BY bank_id) AS VARCHAR) AS parent FROM banks
    UNION ALL SELECT 'x' || CAST(company_id AS VARCHAR), 'x' || CAST(company_id AS VARCHAR) FROM companies"""


@query("pc01_account_tree", f"""WITH RECURSIVE tree AS ({TREE}), paths AS (SELECT code, code AS path, 1 AS depth FROM tree WHERE parent IS NULL
    UNION ALL SELECT t.code, p.path || '>' || t.code, p.depth + 1 FROM tree t JOIN paths p ON t.parent = p.code)
    SELECT code, path, CAST(depth AS INTEGER) AS depth FROM paths""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    leaves = t.accounts.select("code", F.left("code", F.lit(1)).alias("parent"))
    roots = leaves.select(F.col("parent").alias("code"), F.lit(None).cast("string").alias("parent")).distinct()
    return accounts.tree(roots.unionByName(leaves)).select("code", "path", "depth")


@query("pc01_deep_tree", f"""WITH RECURSIVE tree AS ({CHAINS}), paths AS (SELECT code, code AS path, 1 AS depth FROM tree WHERE parent IS NULL
    UNION ALL SELECT t.code, p.path || '>' || t.code, p.depth + 1 FROM tree t JOIN paths p ON t.parent = p.code)
    SELECT code, path, CAST(depth AS INTEGER) AS depth, CAST(NULL AS VARCHAR) AS error FROM paths UNION ALL SELECT code, NULL, NULL, 'no root' FROM tree WHERE code = parent""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    before = F.lag("bank_id").over(W.partitionBy("company_id", F.col("bank_id") % 31).orderBy("bank_id"))
    chains = t.banks.select(F.col("bank_id").cast("string").alias("code"), before.cast("string").alias("parent"))
    own = F.concat(F.lit("x"), F.col("company_id").cast("string"))
    return accounts.tree(chains.unionByName(t.companies.select(own.alias("code"), own.alias("parent"))))


@query("pc02_import_missing_parents", """WITH w AS (SELECT code || '.' || '9' || '.1' AS code FROM accounts WHERE NOT deleted),
    a AS (SELECT code, array_to_string(string_split(code, '.')[1:k], '.') AS above, k FROM w, range(1, 6) r(k) WHERE k < len(string_split(code, '.')))
    SELECT code, arg_min(above, k) AS missing FROM a WHERE above NOT IN (SELECT code FROM accounts) GROUP BY 1""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    wanted = t.accounts.filter("NOT deleted").select(F.concat("code", F.lit(".9.1")).alias("code"))
    return accounts.missing_ancestors(wanted, t.accounts)


def chart_rows(t: Ledger) -> DataFrame:
    """Two lines for each account of a company's chart: a child two levels below, and the level between, later for some."""
    c, k = F.col, F.col("company_id")
    child = F.struct(F.concat("code", F.lit(".9.1")).alias("code"), F.lit("child").alias("label"), F.lit(" Despesa ").alias("kind"), F.lit("a").alias("kind_sa"))
    between = F.struct(F.concat("code", F.when(k % 3 == 0, ".8").otherwise(".9")).alias("code"), F.lit("between").alias("label"), F.lit(None).cast("string").alias("kind"), F.lit("").alias("kind_sa"))
    deep = F.struct(F.concat("code", F.lit(".9.1.1.1.1")).alias("code"), F.when(k % 2 == 0, "deep").otherwise("").alias("label"), F.lit("custo").alias("kind"), F.lit("A").alias("kind_sa"))
    again = F.struct(c("code"), F.lit("again").alias("label"), F.when(k % 5 == 0, "banco").otherwise("custo").alias("kind"), F.lit("X").alias("kind_sa"))
    own = F.struct(c("code"), F.lit("own").alias("label"), F.lit("custo").alias("kind"), F.lit("A").alias("kind_sa"))
    number = F.dense_rank().over(repair.W.partitionBy("company_id").orderBy("code")) * 5
    rows = t.charts.withColumn("n", number)
    return rows.select("company_id", "n", F.posexplode(F.array(child, between, deep, again, own)).alias("i", "x")).select("company_id", (F.col("n") + F.col("i")).alias("line"), "x.*")


CHART = """chart_rows AS (SELECT company_id, CAST(dense_rank() OVER (PARTITION BY company_id ORDER BY code) AS INTEGER) * 5 + i AS line, deleted,
        CASE i WHEN 0 THEN code || '.9.1' WHEN 1 THEN code || CASE WHEN company_id % 3 = 0 THEN '.8' ELSE '.9' END WHEN 2 THEN code || '.9.1.1.1.1' ELSE code END AS code, i
    FROM charts, (VALUES (0), (1), (2), (3), (4)) v(i)),
    live AS (SELECT company_id, code FROM charts WHERE NOT deleted),
    done AS (SELECT company_id, line, code, CASE WHEN i = 2 AND company_id % 2 = 1 THEN 'no label' WHEN i = 3 AND company_id % 5 = 0 THEN 'kind' WHEN i = 3 THEN 'kind_sa'
        WHEN i = 4 AND NOT deleted THEN 'duplicate' WHEN i = 2 THEN 'level' WHEN i = 0 AND company_id % 3 = 0 THEN 'parent ' || left(code, length(code) - 2) WHEN i = 4 THEN 'parent ' || left(code, 1)
        WHEN i < 2 THEN 'parent ' || left(code, 1) ELSE 'imported' END AS outcome, i FROM chart_rows)"""


@query("pc02_chart_import", f"""WITH {CHART}, roots AS (SELECT DISTINCT company_id, left(code, 1) AS code FROM charts)
    SELECT company_id, line, code, CASE WHEN outcome LIKE 'parent _' THEN 'imported' ELSE outcome END AS outcome,
    CASE WHEN outcome LIKE 'parent _' THEN regexp_replace(code, '[.][^.]*$', '') END AS parent FROM done""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return accounts.imported(chart_rows(t), live_chart(t)).select("company_id", "line", "code", "outcome", "parent")


def live_chart(t: Ledger) -> DataFrame:
    """Live accounts and the roots above them, with parents; none is S before an import."""
    own = t.charts.filter("NOT deleted").select("company_id", "code", F.left("code", F.lit(1)).alias("parent"))
    roots = t.charts.select("company_id", F.left("code", F.lit(1)).alias("code"), F.lit(None).cast("string").alias("parent")).distinct()
    return own.unionByName(roots).withColumn("kind_sa", F.lit("A"))


@query("pc02_chart_after_import", f"""WITH {CHART}, rows_after AS (SELECT company_id, code, left(code, 1) AS parent FROM live UNION ALL SELECT DISTINCT company_id, left(code, 1), NULL FROM charts
        UNION ALL SELECT company_id, code, regexp_replace(code, '[.][^.]*$', '') FROM done WHERE outcome LIKE 'parent _'),
    has AS (SELECT DISTINCT company_id, regexp_replace(code, '[.][^.]*$', '') AS code FROM done WHERE outcome LIKE 'parent _')
    SELECT company_id, code, parent, CASE WHEN (company_id, code) IN (SELECT (company_id, code) FROM has) THEN 'S' ELSE 'A' END AS kind_sa FROM rows_after""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    there = live_chart(t)
    return accounts.after_import(accounts.imported(chart_rows(t), there), there)


@query("pc02_account_numbers", f"""WITH {CHART} SELECT company_id, code, CASE WHEN line % 3 = 0 THEN line WHEN line % 3 = 1 THEN -line END AS number FROM done WHERE outcome = 'imported' OR outcome LIKE 'parent _'""")
def _(t: Ledger) -> DataFrame:
    """Numbers with a sign and blanks, and texts that are none."""
    rows = chart_rows(t)
    line = F.col("line").cast("string")
    given = F.when(F.col("line") % 3 == 0, F.concat(F.lit(" +"), line, F.lit(" "))).when(F.col("line") % 3 == 1, F.concat(F.lit("-"), line)).otherwise(F.concat(line, F.lit(".5")))
    return accounts.numbered(accounts.imported(rows, live_chart(t)), rows.withColumn("number", given))


@query("pc03_delete_guards", """WITH tree AS (SELECT company_id, code, left(code, 1) AS parent FROM charts WHERE NOT deleted UNION ALL SELECT DISTINCT company_id, left(code, 1), NULL FROM charts)
    SELECT company_id, code, (company_id, code) IN (SELECT (company_id, parent) FROM tree WHERE parent IS NOT NULL) AS children, (company_id, code) IN (SELECT (company_id, code) FROM rules WHERE active) AS ruled,
    (company_id, code) IN (SELECT (company_id, code) FROM postings) OR (company_id, code) IN (SELECT (c.company_id, '6.' || right(e.month, 2)) FROM card_entries e JOIN cards c ON e.card_id = c.card_id) AS moved FROM tree""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    tree = live_chart(t).withColumn("deleted", F.lit(False))
    spent = t.card_entries.join(t.cards, "card_id").select("company_id", F.concat(F.lit("6."), F.right("month", F.lit(2))).alias("code"))
    return accounts.guards(tree, t.postings, t.rules, spent)


@query("pc04_code_collisions", """WITH d AS (SELECT label, left(code, 1) AS class, row_number() OVER (PARTITION BY left(code, 1) ORDER BY code) AS n, count(*) OVER (PARTITION BY left(code, 1)) AS c, code FROM accounts)
    SELECT label, CASE WHEN c > 1 THEN code ELSE class END AS code FROM d""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    rows = t.accounts.select("label", F.left("code", F.lit(1)).alias("class"), F.col("code").alias("number"))
    return accounts.without_collisions(rows)


@query("ag17_predominant_side", "SELECT code, CASE WHEN count(*) FILTER (dc = 'C') > count(*) FILTER (dc = 'D') THEN 'C' ELSE 'D' END AS side FROM postings GROUP BY 1")
def _(t: Ledger) -> DataFrame:
    return accounts.predominant_side(t.postings)


@query("ag18_repeated_lines", "SELECT tx_id, line, count(*) AS n FROM postings GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Ledger) -> DataFrame:
    return t.postings.groupBy("tx_id", "line").agg(F.count("*").alias("n")).filter("n > 1")


@query("wn03_first_posting_by_side", f"""SELECT tx_id, dc, amount FROM (SELECT tx_id, dc, amount, row_number() OVER (PARTITION BY tx_id, dc ORDER BY moment, line, code, amount) AS n FROM postings) WHERE n = 1""")
def _(t: Ledger) -> DataFrame:
    return repair.first_of(t.postings, ["tx_id", "dc"], ["moment", "line", "code", "amount"]).select("tx_id", "dc", "amount")


@query("wn02_latest_rule", """SELECT bank_id, dc, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY bank_id, dc ORDER BY active DESC, rule_id DESC) AS n FROM rules) WHERE n = 1""")
def _(t: Ledger) -> DataFrame:
    return repair.first_of(t.rules, ["bank_id", "dc"], [F.desc("active"), F.desc("rule_id")]).select("bank_id", "dc", "rule_id")


@query("so01_event_stream", "SELECT supplier_id, moment, 'C' AS side, credit AS amount FROM entries WHERE credit > 0 UNION ALL SELECT supplier_id, moment, 'D', debit FROM entries WHERE debit > 0")
def _(t: Ledger) -> DataFrame:
    return repair.events(t.entries)


@query("so03_missing_codes", "SELECT company_id, code FROM charts EXCEPT SELECT company_id, code FROM postings WHERE moment >= TIMESTAMP '1995-03-01' AND moment < TIMESTAMP '1995-04-01'")
def _(t: Ledger) -> DataFrame:
    """Accounts of a company's chart that nothing was posted to in a month."""
    month = t.postings.filter("moment >= '1995-03-01' AND moment < '1995-04-01'")
    return t.charts.select("company_id", "code").subtract(month.select("company_id", "code"))


@query("so05_unknown_modules", "SELECT company_id, list_sort(list_filter(['neo', CASE WHEN company_id % 2 = 0 THEN 'x' ELSE 'notas' END, 'y'], lambda m: m NOT IN ('neo', 'notas', 'extrato'))) AS unknown FROM companies")
def _(t: Ledger) -> DataFrame:
    mine = F.array(F.lit("neo"), F.when(F.col("company_id") % 2 == 0, "x").otherwise("notas"), F.lit("y"))
    known = F.array(*map(F.lit, ["neo", "notas", "extrato"]))
    return t.companies.select("company_id", F.sort_array(F.array_except(mine, known)).alias("unknown"))


@query("jn15_names_to_tax_ids", """WITH a AS (SELECT name, tax_id FROM companies UNION ALL SELECT name, tax_id FROM companies WHERE NOT active),
    one AS (SELECT name, any_value(tax_id) AS tax_id FROM a GROUP BY 1 HAVING count(*) = 1) SELECT company_id AS other_id, one.tax_id FROM companies c JOIN one ON c.name = one.name""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    known = t.companies.select("name", "tax_id").unionByName(t.companies.filter("NOT active").select("name", "tax_id"))
    open_rows = t.companies.select(F.col("company_id").alias("other_id"), F.concat(F.lower("name"), F.lit(" ")).alias("name"))
    return repair.by_unique_name(open_rows, known).select("other_id", "tax_id")


@query("er02_tax_id_proposals", r"""WITH v AS (SELECT name, tax_id, company_id FROM companies WHERE company_id % 4 <> 3),
    seen AS (SELECT c.name, v.tax_id FROM companies c JOIN v ON v.company_id = c.company_id - 1 WHERE c.company_id % 4 = 3
        UNION ALL SELECT c.name, '11.222.333/0001-81' FROM companies c WHERE c.company_id % 8 = 3),
    o AS (SELECT name, count(DISTINCT regexp_replace(tax_id, '\D', '', 'g')) AS n, min(regexp_replace(tax_id, '\D', '', 'g')) AS t FROM seen GROUP BY 1)
    SELECT company_id, CASE WHEN n = 1 AND t NOT IN (SELECT tax_id FROM v) THEN regexp_replace(t, '^(..)(...)(...)(....)(..)$', '\1.\2.\3/\4-\5') END AS proposed,
    CASE WHEN n > 1 THEN 'several tax ids' WHEN t IN (SELECT tax_id FROM v) THEN 'in use' END AS reason FROM companies JOIN o USING (name) WHERE company_id % 4 = 3""".replace("\\\\", "\\"))  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("company_id")
    before = t.companies.select((k + 1).alias("company_id"), "tax_id")
    named = t.companies.filter(k % 4 == 3).select("company_id", F.concat(F.lower("name"), F.lit("  ")).alias("name"))
    seen = named.join(before, "company_id").select("name", "tax_id").unionByName(named.filter(k % 8 == 3).select("name", F.lit("11.222.333/0001-81").alias("tax_id")))
    return repair.tax_id_proposals(t.companies, seen)


@query("er01_invalid_tax_ids", "SELECT company_id, tax_id FROM companies WHERE company_id % 4 = 3")
def _(t: Ledger) -> DataFrame:
    return repair.invalid_tax_ids(t.companies)


@query("er03_rows_out_of_scope", "SELECT rule_id FROM rules WHERE (company_id, code) NOT IN (SELECT (company_id, code) FROM charts)")
def _(t: Ledger) -> DataFrame:
    """Rules that post to an account which their company's chart doesn't have."""
    return t.rules.join(t.charts.select("company_id", "code"), ["company_id", "code"], "left_anti").select("rule_id")


@query("er04_payable_changes", POSITIONS + """, n AS (SELECT supplier_id, CASE WHEN supplier_id % 3 = 0 THEN payable + 1 ELSE payable END AS payable FROM positions WHERE supplier_id % 7 <> 0)
    SELECT coalesce(p.supplier_id, n.supplier_id) AS supplier_id, p.payable AS before, CAST(n.payable AS DECIMAL(25,2)) AS after FROM positions p FULL JOIN n ON p.supplier_id = n.supplier_id
    WHERE abs(coalesce(p.payable, 0) - coalesce(n.payable, 0)) > 0.01""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    before = positions(t).select("supplier_id", "payable")
    changed = F.when(F.col("supplier_id") % 3 == 0, F.col("payable") + 1).otherwise(F.col("payable")).cast("decimal(25,2)")
    return repair.changes(before, before.filter("supplier_id % 7 <> 0").select("supplier_id", changed.alias("payable")))


FEED = """feed AS (SELECT user_id % 25 AS company_id, 'item' || CAST(user_id AS VARCHAR) AS item_id, CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS day, CAST(abs(value - 50) AS DECIMAL(15,2)) AS amount,
    CASE WHEN event_type = 'click' OR value - 50 > 0 THEN 'C' ELSE 'D' END AS dc, CASE WHEN event_id % 3 = 0 THEN 'raw ' || event_type WHEN event_id % 3 = 1 THEN event_type ELSE 'Sem descrição' END AS text, ts FROM events)"""
SYNC = f"""{FEED}, late AS (SELECT * FROM feed WHERE day BETWEEN CAST(DATE '2024-01-25' - INTERVAL 10 DAY AS DATE) AND DATE '2024-01-25'),
    fresh AS (SELECT * FROM late WHERE ts >= TIMESTAMP '2024-01-18 12:00:00')"""


def feed(t: Ledger) -> DataFrame:
    k = F.col("event_id")
    return repair.mapped_feed(t.raw("events").select(
        (F.col("user_id") % 25).alias("company_id"), F.concat(F.lit("item"), F.col("user_id").cast("string")).alias("item_id"), k.cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), (F.col("value") - 50).alias("amount"), F.when(F.col("event_type") == "click", "CREDIT").alias("type"),
        F.when(k % 3 == 1, F.col("event_type")).otherwise("").alias("description"), F.when(k % 3 == 0, F.concat(F.lit("raw "), F.col("event_type"))).alias("description_raw"), "ts",
    ))


def synced(t: Ledger) -> DataFrame:
    rows = feed(t)
    return repair.synced(rows.unionByName(rows).drop("ts"), rows.filter("ts < TIMESTAMP '2024-01-18 12:00:00'"), "2024-01-25", 10)


@query("ob02_feed_mapping", f"WITH {FEED} SELECT id, day, amount, dc, text FROM feed")
def _(t: Ledger) -> DataFrame:
    return feed(t).select("id", "day", "amount", "dc", "text")


@query("ob01_feed_sync", f"WITH {SYNC} SELECT company_id, sha256(CAST(company_id AS VARCHAR) || item_id || id) AS hash, item_id, id, day, amount, dc, text FROM fresh")
def _(t: Ledger) -> DataFrame:
    return synced(t)


@query("ob01_connection_states", f"""WITH {SYNC}, c AS (SELECT DISTINCT user_id % 25 AS company_id, 'item' || CAST(user_id AS VARCHAR) AS item_id FROM events),
    l AS (SELECT company_id, item_id, count(*) * 2 AS seen FROM late GROUP BY ALL), f AS (SELECT company_id, item_id, count(*) AS imported FROM fresh GROUP BY ALL)
    SELECT company_id, item_id, coalesce(imported, 0) AS imported, coalesce(seen, 0) - coalesce(imported, 0) AS duplicates, 100 + coalesce(imported, 0) AS total_synced, TIMESTAMP '2024-01-25 09:00:00' AS last_sync,
    TIMESTAMP '2024-01-25 15:00:00' AS next_sync, 'ativa' AS status FROM c LEFT JOIN l USING (company_id, item_id) LEFT JOIN f USING (company_id, item_id)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    rows = feed(t)
    both = rows.unionByName(rows)
    connections = rows.select("company_id", "item_id").distinct().withColumn("total_synced", F.lit(100).cast("long"))
    return repair.sync_states(connections, both, synced(t), "2024-01-25 09:00:00", "2024-01-25", 10)


DRAWN = "CAST(('0x' || left(md5({0}), 8)) AS BIGINT)"


@query("ob01_failed_syncs", """WITH c AS (SELECT DISTINCT user_id % 25 AS company_id, 'item' || CAST(user_id AS VARCHAR) AS item_id, user_id FROM events)
    SELECT company_id, item_id, 'erro' AS status, left('provider ' || repeat('x', CAST(user_id % 700 AS INTEGER)), 500) AS error, TIMESTAMP '2024-01-20 08:00:00' AS last_sync FROM c WHERE user_id % 3 = 0""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    users = t.raw("events").select("user_id").distinct()
    own = users.select((F.col("user_id") % 25).alias("company_id"), F.concat(F.lit("item"), F.col("user_id").cast("string")).alias("item_id"), "user_id")
    connections = own.select("company_id", "item_id", F.lit("ativa").alias("status"), F.lit("2024-01-20 08:00:00").cast("timestamp_ntz").alias("last_sync"))
    failures = own.filter("user_id % 3 = 0").select("company_id", "item_id", F.concat(F.lit("provider "), F.repeat(F.lit("x"), (F.col("user_id") % 700).cast("int"))).alias("message"))
    return repair.failed_syncs(connections, failures)


@query("src14_mock_feed", f"""WITH d AS (SELECT 'acc' || CAST(bank_id AS VARCHAR) AS account, CAST(unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-11', INTERVAL 1 DAY)) AS DATE) AS day FROM banks),
    n AS (SELECT account, day, {DRAWN.format("account || '|' || CAST(day AS VARCHAR)")} % CASE WHEN isodow(day) < 6 THEN 4 ELSE 2 END AS n FROM d),
    r AS (SELECT account, day, CAST(unnest(range(0, n)) AS VARCHAR) AS i FROM n), k AS (SELECT *, account || '|' || CAST(day AS VARCHAR) || '|' || i AS k FROM r)
    SELECT account, day, md5(account || CAST(day AS VARCHAR) || i) AS id, CASE WHEN {DRAWN.format("k || '|side'")} % 100 < 65 THEN 'D' ELSE 'C' END AS dc,
    CAST(CAST(5000 + {DRAWN.format("k || '|amount'")} % 1495001 AS DECIMAL(15,2)) / 100 AS DECIMAL(15,2)) AS amount FROM k""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return repair.mock_feed(t.banks.select(F.concat(F.lit("acc"), F.col("bank_id").cast("string")).alias("account")), "2024-01-01", "2024-01-10")


@query("ag20_observed_import", """SELECT count(*) AS total, count(DISTINCT tx_id) FILTER (dc = 'C' AND tx_id NOT IN (SELECT tx_id FROM transactions WHERE status = 'processada')) AS imported,
    count(*) FILTER (dc = 'C') - count(DISTINCT tx_id) FILTER (dc = 'C' AND tx_id NOT IN (SELECT tx_id FROM transactions WHERE status = 'processada')) AS duplicates, count(*) FILTER (dc <> 'C') AS errors FROM postings""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    """The same figures, counted while the new rows are written."""
    batch = t.postings.select(F.col("tx_id").alias("key"), F.when(F.col("dc") != "C", "side").alias("error"))
    return repair.imported(batch, t.transactions.filter("status = 'processada'").select(F.col("tx_id").alias("key")), folder(t.spark))


@query("ag20_import_summary", """SELECT count(*) AS total, count(DISTINCT tx_id) FILTER (dc = 'C' AND tx_id NOT IN (SELECT tx_id FROM transactions WHERE status = 'processada')) AS imported,
    count(*) FILTER (dc = 'C') - count(DISTINCT tx_id) FILTER (dc = 'C' AND tx_id NOT IN (SELECT tx_id FROM transactions WHERE status = 'processada')) AS duplicates, count(*) FILTER (dc <> 'C') AS errors FROM postings""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    batch = t.postings.select(F.col("tx_id").alias("key"), F.when(F.col("dc") != "C", "side").alias("error"))
    return repair.import_summary(batch, t.transactions.filter("status = 'processada'").select(F.col("tx_id").alias("key")))


@query("snk05_workbook_round_trip", WORKBOOK)
def _(t: Ledger) -> DataFrame:
    """The supplier workbook written, read cell by cell, and put together again under its headers."""
    rows = exports.positions(positions(t), t.suppliers, divergent(t), fifo.pending(fifo.paid_state(*sides(t))))
    back = read_back(t, rows, exports.POSITION_HEADERS)
    return back.select("code", "account", "name", "tax_id", *[F.col(c).cast("decimal(25,2)").alias(c) for c in ("credits", "debits", "payable")], "status", F.col("pending").cast("long").alias("pending"), "divergent")
