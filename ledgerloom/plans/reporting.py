"""Reports, statistics, lists, pages and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..domain import Ledger
from ..functions import text
from ..functions.dates import day_bounds
from ..operators import exports, reports, stats, validation
from ..scratch import folder
from .registry import query, read_back

FIRST, LAST = "1997-01-01", "1998-12-31"
INSIDE = f"moment >= TIMESTAMP '{FIRST}' AND moment < TIMESTAMP '{LAST}' + INTERVAL 1 DAY"
D25 = "DECIMAL(25,2)"
SIDES = f"""CAST(coalesce(sum(CASE WHEN dc = 'D' THEN amount END), 0) AS {D25}) AS debits,
    CAST(coalesce(sum(CASE WHEN dc = 'C' THEN amount END), 0) AS {D25}) AS credits"""
LINES = f"""moved AS (SELECT company_id, code, {SIDES} FROM postings WHERE NOT deleted AND {INSIDE} GROUP BY ALL),
lines AS (SELECT company_id, kind, code, label,
    CAST(CASE WHEN kind = 'receita' THEN credits - debits ELSE debits - credits END AS {D25}) AS balance
    FROM moved JOIN accounts USING (code) WHERE kind IN ('receita', 'custo', 'despesa'))"""


def lines(t: Ledger) -> DataFrame:
    return reports.income_statement(t.postings, t.accounts, FIRST, LAST)


@query("src01_tenant_scan", "SELECT * FROM transactions WHERE company_id = 7 AND NOT deleted")
def _(t: Ledger) -> DataFrame:
    return reports.live(t.transactions.filter("company_id = 7"))


@query("ag01_sums_by_account_and_side", f"SELECT code, dc, CAST(sum(amount) AS {D25}) AS amount FROM postings WHERE NOT deleted AND {INSIDE} GROUP BY ALL")
def _(t: Ledger) -> DataFrame:
    rows = reports.live(t.postings).filter(day_bounds(F.col("moment"), FIRST, LAST))
    return rows.groupBy("code", "dc").agg(reports.total(F.col("amount")).alias("amount"))


@query("ag02_debits_and_credits", f"SELECT company_id, {SIDES} FROM postings GROUP BY ALL")
def _(t: Ledger) -> DataFrame:
    return reports.by_side(t.postings, "company_id")


@query("ag03_income_statement_lines", f"WITH {LINES} SELECT * FROM lines")
def _(t: Ledger) -> DataFrame:
    return lines(t)


_KIND_SUMS = ", ".join(f"CAST(coalesce(sum(CASE WHEN kind = '{k}' THEN balance END), 0) AS {D25}) AS {k}" for k in ("receita", "custo", "despesa"))


@query(
    "ag03_income_statement_totals",
    f"WITH {LINES}, sums AS (SELECT company_id, {_KIND_SUMS} FROM lines GROUP BY ALL) "
    f"SELECT *, CAST(receita - custo - despesa AS {D25}) AS resultado FROM sums",
)
def _(t: Ledger) -> DataFrame:
    return reports.income_totals(lines(t))


BALANCE = f"""moved AS (SELECT company_id, code, {SIDES} FROM postings WHERE NOT deleted AND {INSIDE} GROUP BY ALL),
balance AS (SELECT company_id, code, label, CAST(coalesce(debits, 0) AS {D25}) AS debits, CAST(coalesce(credits, 0) AS {D25}) AS credits,
    CAST(greatest(coalesce(debits, 0) - coalesce(credits, 0), 0) AS {D25}) AS debit_balance,
    CAST(greatest(coalesce(credits, 0) - coalesce(debits, 0), 0) AS {D25}) AS credit_balance
    FROM charts LEFT JOIN moved USING (company_id, code) WHERE NOT deleted OR debits IS NOT NULL)"""


@query("ag04_trial_balance", f"WITH {BALANCE} SELECT * FROM balance")
def _(t: Ledger) -> DataFrame:
    return reports.trial_balance(t.postings, t.charts, FIRST, LAST)


@query(
    "ag04_trial_balance_totals",
    f"WITH {BALANCE} SELECT company_id, "
    + ", ".join(f"CAST(sum({c}) AS {D25}) AS {c}" for c in ("debits", "credits", "debit_balance", "credit_balance"))
    + ", count(*) AS accounts FROM balance GROUP BY company_id",
)
def _(t: Ledger) -> DataFrame:
    return reports.trial_totals(reports.trial_balance(t.postings, t.charts, FIRST, LAST))


SIGNED = "CASE WHEN dc = 'C' THEN amount ELSE -amount END"


@query("ag05_opening_balances", f"SELECT bank_id, CAST(sum({SIGNED}) AS {D25}) AS opening FROM transactions WHERE NOT deleted AND moment < TIMESTAMP '{FIRST}' GROUP BY ALL")
def _(t: Ledger) -> DataFrame:
    return reports.opening_balances(t.transactions, FIRST)


@query(
    "wn01_cash_book",
    f"""SELECT bank_id, tx_id, moment, dc, amount, CAST(balance AS {D25}) AS balance FROM (
    SELECT *, sum({SIGNED}) OVER (PARTITION BY bank_id ORDER BY moment, tx_id) AS balance FROM transactions
    WHERE NOT deleted AND moment < TIMESTAMP '{LAST}' + INTERVAL 1 DAY) WHERE moment >= TIMESTAMP '{FIRST}'""",
)
def _(t: Ledger) -> DataFrame:
    return reports.cash_book(t.transactions, FIRST, LAST)


@query(
    "wn01_cash_book_totals",
    f"""WITH sums AS (SELECT bank_id,
    CAST(coalesce(sum(CASE WHEN moment < TIMESTAMP '{FIRST}' THEN {SIGNED} END), 0) AS {D25}) AS opening,
    CAST(coalesce(sum(CASE WHEN moment >= TIMESTAMP '{FIRST}' AND dc = 'C' THEN amount END), 0) AS {D25}) AS credits,
    CAST(coalesce(sum(CASE WHEN moment >= TIMESTAMP '{FIRST}' AND dc = 'D' THEN amount END), 0) AS {D25}) AS debits,
    count(*) FILTER (moment >= TIMESTAMP '{FIRST}') AS entries
    FROM transactions WHERE NOT deleted AND moment < TIMESTAMP '{LAST}' + INTERVAL 1 DAY GROUP BY bank_id)
    SELECT *, CAST(opening + credits - debits AS {D25}) AS closing FROM sums""",
)
def _(t: Ledger) -> DataFrame:
    return reports.cash_totals(t.transactions, FIRST, LAST)


@query(
    "ag06_dashboard_summary",
    """WITH a AS (SELECT company_id, count(*) AS transactions,
        count(*) FILTER (tx_id IN (SELECT tx_id FROM postings)) AS reconciled FROM transactions GROUP BY 1),
    b AS (SELECT company_id, count(*) AS postings FROM postings WHERE NOT deleted GROUP BY 1),
    c AS (SELECT company_id, count(*) AS invoices FROM invoices WHERE NOT deleted GROUP BY 1),
    d AS (SELECT company_id, count(*) AS receipts FROM receipts WHERE NOT deleted GROUP BY 1)
    SELECT company_id, transactions, reconciled, coalesce(postings, 0) AS postings, coalesce(invoices, 0) AS invoices,
        coalesce(receipts, 0) AS receipts,
        CAST(round_even(CAST(reconciled * 100 AS DOUBLE) / transactions, 1) AS DECIMAL(5,1)) AS percent
    FROM a LEFT JOIN b USING (company_id) LEFT JOIN c USING (company_id) LEFT JOIN d USING (company_id)""",
)
def _(t: Ledger) -> DataFrame:
    return stats.summary(t.transactions, t.postings, reports.live(t.invoices), reports.live(t.receipts))


@query(
    "ag09_monthly_counts",
    """WITH months AS (SELECT company_id, strftime(unnest(range(TIMESTAMP '2001-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 MONTH)), '%Y-%m') AS month FROM companies),
    f AS (SELECT company_id, moment, 't' AS k FROM transactions UNION ALL SELECT company_id, moment, 'p' FROM postings WHERE NOT deleted
          UNION ALL SELECT company_id, paid_at, 'r' FROM receipts WHERE NOT deleted UNION ALL SELECT company_id, issued, 'i' FROM invoices WHERE NOT deleted)
    SELECT m.company_id, m.month, count(*) FILTER (k = 't') AS transactions, count(*) FILTER (k = 'p') AS postings, count(*) FILTER (k = 'r') AS receipts, count(*) FILTER (k = 'i') AS invoices
    FROM months m LEFT JOIN f ON f.company_id = m.company_id AND strftime(f.moment, '%Y-%m') = m.month GROUP BY 1, 2""",
)
def _(t: Ledger) -> DataFrame:
    facts = {
        "transactions": (t.transactions, "moment"),
        "postings": (reports.live(t.postings), "moment"),
        "receipts": (reports.live(t.receipts), "paid_at"),
        "invoices": (reports.live(t.invoices), "issued"),
    }
    return stats.monthly(facts, t.companies, "2001-01-01", 12)


@query("ag10_month_series", """WITH s AS (SELECT bank_id, date_trunc('month', min(moment)) AS a, date_trunc('month', max(moment)) AS b FROM transactions GROUP BY 1),
    m AS (SELECT bank_id, unnest(range(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m FROM s),
    n AS (SELECT bank_id, date_trunc('month', moment) AS m, count(*) AS n FROM transactions GROUP BY 1, 2)
    SELECT m.bank_id, strftime(m.m, '%Y-%m') AS month, coalesce(n, 0) AS n FROM m LEFT JOIN n ON m.bank_id = n.bank_id AND m.m = n.m""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return stats.month_series(t.transactions, "bank_id", "moment")


@query(
    "ag11_reconciled_by_account",
    """SELECT bank_id, acronym || ' - Ag. ' || branch || ' / ' || number AS label,
    count(*) FILTER (tx_id IN (SELECT tx_id FROM postings)) AS reconciled,
    count(*) FILTER (tx_id NOT IN (SELECT tx_id FROM postings)) AS open
    FROM banks b LEFT JOIN (SELECT tx_id, bank_id FROM transactions) USING (bank_id) WHERE active GROUP BY 1, 2""",
)
def _(t: Ledger) -> DataFrame:
    return stats.by_account(t.transactions, t.postings, t.banks)


@query(
    "jn07_transactions_with_postings",
    "SELECT tx_id, company_id FROM transactions WHERE tx_id IN (SELECT tx_id FROM postings WHERE dc = 'C')",
)
def _(t: Ledger) -> DataFrame:
    return t.transactions.join(t.postings.filter("dc = 'C'").select("tx_id"), "tx_id", "left_semi").select("tx_id", "company_id")


@query("ag08_distinct_reconciled", "SELECT count(DISTINCT tx_id) AS n FROM postings")
def _(t: Ledger) -> DataFrame:
    return t.postings.select("tx_id").distinct().agg(F.count("*").alias("n"))


@query(
    "prj01_ledger_list",
    f"SELECT tx_id, line, code, dc, amount, moment FROM postings WHERE code = '4.07' AND dc = 'C' AND {INSIDE} AND NOT deleted",
)
def _(t: Ledger) -> DataFrame:
    kept = t.postings.filter((F.col("code") == "4.07") & (F.col("dc") == F.upper(F.lit("c")))).filter(day_bounds(F.col("moment"), FIRST, LAST))
    return reports.live(kept).select("tx_id", "line", "code", "dc", "amount", "moment")


@query("prj02_date_bounds", f"SELECT count(*) AS n FROM transactions WHERE moment >= TIMESTAMP '{FIRST}' AND moment <= TIMESTAMP '1998-06-30 12:00:00'")
def _(t: Ledger) -> DataFrame:
    return t.transactions.filter(day_bounds(F.col("moment"), FIRST, "1998-06-30 12:00:00")).agg(F.count("*").alias("n"))


@query("prj03_statement_list", f"SELECT tx_id, moment, amount, history FROM transactions WHERE status = 'pendente' AND NOT deleted AND {INSIDE}")
def _(t: Ledger) -> DataFrame:
    kept = t.transactions.filter("status = 'pendente'").filter(day_bounds(F.col("moment"), FIRST, LAST))
    return reports.live(kept).select("tx_id", "moment", "amount", "history")


@query("prj04_invoice_list", "SELECT invoice_id, kind, amount FROM invoices WHERE kind = 'nfe' AND status = 'pendente' AND NOT deleted")
def _(t: Ledger) -> DataFrame:
    return t.invoices.filter("kind = 'nfe' AND status = 'pendente' AND NOT deleted").select("invoice_id", "kind", "amount")


@query("prj05_receipts_by_association", "SELECT company_id, count(*) FILTER (tx_id IS NULL) AS free, count(tx_id) AS taken FROM receipts WHERE NOT deleted GROUP BY 1")
def _(t: Ledger) -> DataFrame:
    return reports.live(t.receipts).groupBy("company_id").agg(F.count_if(F.col("tx_id").isNull()).alias("free"), F.count("tx_id").alias("taken"))


@query(
    "prj06_rule_list",
    "SELECT rule_id, text, description, acronym, branch FROM rules LEFT JOIN (SELECT bank_id, acronym, branch FROM banks) USING (bank_id) WHERE active",
)
def _(t: Ledger) -> DataFrame:
    labels = t.banks.select("bank_id", "acronym", "branch")
    return t.rules.filter("active").join(labels, "bank_id", "left").select("rule_id", "text", "description", "acronym", "branch")


@query("prj07_bank_account_counts", "SELECT company_id, count(*) AS total, count(*) FILTER (active) AS active FROM banks GROUP BY 1")
def _(t: Ledger) -> DataFrame:
    return t.banks.groupBy("company_id").agg(F.count("*").alias("total"), F.count_if("active").alias("active"))


@query("prj09_membership", "SELECT count(*) AS n FROM postings WHERE code IN (SELECT code FROM accounts WHERE kind = 'receita') AND dc IN ('C')")
def _(t: Ledger) -> DataFrame:
    revenue = t.accounts.filter("kind = 'receita'").select("code")
    return t.postings.filter(F.col("dc").isin("C")).join(revenue, "code", "left_semi").agg(F.count("*").alias("n"))


@query("prj10_live_or_moved", "SELECT code FROM accounts WHERE NOT deleted OR code IN (SELECT code FROM postings WHERE moment >= TIMESTAMP '2001-10-01')")
def _(t: Ledger) -> DataFrame:
    moved = t.postings.filter("moment >= TIMESTAMP '2001-10-01'").select("code").distinct().withColumn("moved", F.lit(True))
    return t.accounts.join(moved, "code", "left").filter(~F.col("deleted") | F.col("moved")).select("code")


@query("prj11_row_level_access", "SELECT tx_id FROM transactions WHERE company_id IN (SELECT company_id FROM permits WHERE user_id = 1 AND (list_contains(string_split(modules, ','), 'extrato') OR modules = '*'))")
def _(t: Ledger) -> DataFrame:
    return exports.allowed(t.transactions, t.permits, 1, "extrato").select("tx_id")


@query("prj11_pruned_access", "SELECT tx_id, company_id FROM transactions WHERE company_id IN (SELECT company_id FROM permits WHERE user_id = 1 AND (list_contains(string_split(modules, ','), 'extrato') OR modules = '*'))")
def _(t: Ledger) -> DataFrame:
    """The same access over a layout by company."""
    laid = exports.laid_out(t.transactions, folder(t.spark))
    return exports.allowed(laid, t.permits, 1, "extrato").select("tx_id", "company_id")


@query("jn01_company_permits", """SELECT p.company_id, p.user_id, p.modules, user_name FROM permits p JOIN companies c ON p.company_id = c.company_id
    JOIN users u ON u.user_id = p.user_id AND u.tenant_id = c.tenant_id WHERE c.active""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return exports.permits_of(t.permits, t.users, t.companies)


@query("prj12_bank_label", "SELECT bank_id, concat_ws(' ', acronym, branch, number, digit) AS label FROM banks")
def _(t: Ledger) -> DataFrame:
    return t.banks.select("bank_id", F.concat_ws(" ", "acronym", "branch", "number", "digit").alias("label"))


@query("prj13_account_level", "SELECT code, CAST(len(string_split(code, '.')) AS INTEGER) AS level FROM accounts")
def _(t: Ledger) -> DataFrame:
    return t.accounts.select("code", text.level(F.col("code")).alias("level"))


def sql_errors(rules: dict[str, str]) -> str:
    """The names of the rules that don't hold, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in rules.items()) + ")"


INVOICE_RULES = {
    "kind": "lower(trim(kind)) IN ('nfe', 'nfse')", "number": "length(number) BETWEEN 1 AND 50", "series": "series IS NULL OR length(series) <= 10",
    "issuer": r"length(regexp_replace(issuer, '\D', '', 'g')) = 14", "issuer_name": "issuer_name IS NULL OR length(issuer_name) <= 300",
    "recipient": r"recipient IS NULL OR length(regexp_replace(recipient, '\D', '', 'g')) = 14", "amount": "amount > 0", "issued": "issued IS NOT NULL",
    "access_key": r"access_key IS NULL OR length(regexp_replace(access_key, '\D', '', 'g')) = 44",
}


@query("prj16_invoice_rules", f"""SELECT invoice_id, {sql_errors(INVOICE_RULES)} AS errors FROM (SELECT invoice_id, CASE WHEN invoice_id % 5 = 0 THEN ' NFE ' WHEN invoice_id % 5 = 1 THEN 'nf' ELSE kind END AS kind,
    CASE WHEN invoice_id % 7 = 0 THEN '' ELSE number END AS number, series, CASE WHEN invoice_id % 3 = 1 THEN left(issuer, 9) ELSE issuer END AS issuer, issuer_name,
    CASE WHEN invoice_id % 4 = 0 THEN NULL ELSE recipient END AS recipient, amount - 1000 AS amount, issued, CASE WHEN invoice_id % 6 = 0 THEN '12' ELSE access_key END AS access_key FROM invoices)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("invoice_id")
    rows = t.invoices.withColumns({
        "kind": F.when(k % 5 == 0, " NFE ").when(k % 5 == 1, "nf").otherwise(F.col("kind")),
        "number": F.when(k % 7 == 0, "").otherwise(F.col("number")),
        "issuer": F.when(k % 3 == 1, F.left("issuer", F.lit(9))).otherwise(F.col("issuer")),
        "recipient": F.when(k % 4 != 0, F.col("recipient")),
        "amount": F.col("amount") - 1000,
        "access_key": F.when(k % 6 == 0, "12").otherwise(F.col("access_key")),
    })
    return rows.select("invoice_id", F.array_join(validation.invoice(), ",").alias("errors"))


CARD_RULES = {
    "label": "length(label) BETWEEN 2 AND 200", "brand": "lower(trim(brand)) IN ('visa', 'mastercard', 'elo', 'amex', 'hipercard', 'outros')",
    "last_digits": "last_digits IS NULL OR regexp_matches(trim(last_digits), '^[0-9]{4}$')", "closing_day": "closing_day BETWEEN 1 AND 28",
    "due_day": "due_day BETWEEN 1 AND 28", "limit": '"limit" IS NULL OR "limit" >= 0',
}


@query("prj16_card_rules", f"""SELECT card_id, {sql_errors(CARD_RULES)} AS errors FROM (SELECT card_id, label, CASE card_id % 3 WHEN 0 THEN 'Visa' WHEN 1 THEN ' elo ' ELSE 'other' END AS brand,
    CASE WHEN card_id % 4 <> 0 THEN CAST(card_id AS VARCHAR) END AS last_digits, card_id % 31 AS closing_day, card_id % 29 AS due_day, CASE WHEN card_id % 5 <> 0 THEN card_id % 7 - 1 END AS "limit" FROM cards)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("card_id")
    rows = t.cards.withColumns({
        "brand": F.when(k % 3 == 0, "Visa").when(k % 3 == 1, " elo ").otherwise("other"),
        "last_digits": F.when(k % 4 != 0, k.cast("string")), "closing_day": k % 31, "due_day": k % 29, "limit": F.when(k % 5 != 0, k % 7 - 1),
    })
    return rows.select("card_id", F.array_join(validation.card(), ",").alias("errors"))


@query("prj16_account_rules", f"""SELECT company_id, code, {sql_errors({"code": "length(trim(code)) BETWEEN 1 AND 30 AND regexp_matches(trim(code), '^[0-9]+([.][0-9]+)*$')",
    "label": "length(trim(label)) BETWEEN 2 AND 300", "kind": "lower(trim(kind)) IN ('ativo', 'passivo', 'patrimonio_liquido', 'receita', 'despesa', 'custo', 'resultado')",
    "kind_sa": "upper(trim(kind_sa)) IN ('S', 'A')"})} AS errors
    FROM (SELECT company_id, CASE WHEN company_id % 2 = 0 THEN code || '.' ELSE code END AS code, CASE WHEN company_id % 3 = 0 THEN ' x ' ELSE label END AS label,
    CASE WHEN company_id % 5 = 0 THEN 'banco' ELSE kind END AS kind, CASE WHEN company_id % 7 = 0 THEN NULL ELSE 's' END AS kind_sa FROM charts)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("company_id")
    rows = t.charts.withColumns({
        "code": F.when(k % 2 == 0, F.concat("code", F.lit("."))).otherwise(F.col("code")), "label": F.when(k % 3 == 0, " x ").otherwise(F.col("label")),
        "kind": F.when(k % 5 == 0, "banco").otherwise(F.col("kind")), "kind_sa": F.when(k % 7 != 0, "s"),
    })
    return rows.select("company_id", "code", F.array_join(validation.account(), ",").alias("errors"))


@query("prj16_bank_and_rule_rules", f"""SELECT 'bank' AS what, bank_id AS id, {sql_errors({"acronym": "length(trim(acronym)) BETWEEN 2 AND 20", "branch": "regexp_matches(trim(branch), '^[0-9]{1,10}$')",
    "number": "regexp_matches(trim(number), '^[0-9A-Za-z_-]{1,20}$')", "digit": "digit IS NULL OR length(trim(digit)) <= 5"})} AS errors
    FROM (SELECT bank_id, acronym, CASE WHEN bank_id % 2 = 0 THEN branch || 'x' ELSE branch END AS branch, CASE WHEN bank_id % 3 = 0 THEN number || ' 1' ELSE number END AS number, digit FROM banks)
    UNION ALL SELECT 'rule', rule_id, {sql_errors({"description": "length(trim(description)) BETWEEN 2 AND 500", "text": "length(trim(text)) BETWEEN 2 AND 500", "dc": "upper(trim(dc)) IN ('D', 'C')",
    "kind": "lower(trim(kind)) IN ('automatica', 'manual')"})} FROM (SELECT rule_id, description, CASE WHEN rule_id % 2 = 0 THEN 'x' ELSE text END AS text, CASE WHEN rule_id % 3 = 0 THEN 'E' ELSE lower(dc) END AS dc, kind FROM rules)""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k, r = F.col("bank_id"), F.col("rule_id")
    accounts = t.banks.withColumns({
        "branch": F.when(k % 2 == 0, F.concat("branch", F.lit("x"))).otherwise(F.col("branch")), "number": F.when(k % 3 == 0, F.concat("number", F.lit(" 1"))).otherwise(F.col("number"))
    })
    rules = t.rules.withColumns({"text": F.when(r % 2 == 0, "x").otherwise(F.col("text")), "dc": F.when(r % 3 == 0, "E").otherwise(F.lower("dc"))})
    return accounts.select(F.lit("bank").alias("what"), k.alias("id"), F.array_join(validation.bank_account(), ",").alias("errors")).unionByName(
        rules.select(F.lit("rule").alias("what"), r.alias("id"), F.array_join(validation.rule(), ",").alias("errors"))
    )


@query("prj15_has_attachment", "SELECT receipt_id, receipt_id % 3 <> 0 AND receipt_id % 3 <> 1 AS attached FROM receipts")
def _(t: Ledger) -> DataFrame:
    k = F.col("receipt_id")
    rows = t.receipts.select("receipt_id", F.when(k % 3 == 1, "").when(k % 3 == 2, "YQ==").alias("content"))
    return rows.select("receipt_id", exports.has_attachment(F.col("content")).alias("attached"))


@query("st01_page", "SELECT tx_id, moment FROM (SELECT tx_id, moment FROM transactions ORDER BY moment DESC, tx_id LIMIT 50 OFFSET 100)")
def _(t: Ledger) -> DataFrame:
    return exports.page(t.transactions.select("tx_id", "moment"), [F.desc("moment"), F.col("tx_id")], 3, 50)


@query("st03_composite_order", "SELECT tx_id, CAST(row_number() OVER (PARTITION BY bank_id ORDER BY moment, tx_id) AS INTEGER) AS n FROM transactions")
def _(t: Ledger) -> DataFrame:
    return t.transactions.select("tx_id", F.row_number().over(W.partitionBy("bank_id").orderBy("moment", "tx_id")).alias("n"))


@query("st04_rule_order", "SELECT rule_id, CAST(row_number() OVER (PARTITION BY bank_id ORDER BY length(text) DESC, rule_id) AS INTEGER) AS n FROM rules")
def _(t: Ledger) -> DataFrame:
    return t.rules.select("rule_id", F.row_number().over(W.partitionBy("bank_id").orderBy(F.desc(F.length("text")), "rule_id")).alias("n"))


@query("st05_hierarchy_order", "SELECT company_id, code, CAST(row_number() OVER (PARTITION BY company_id ORDER BY len(string_split(code, '.')), code) AS INTEGER) AS n FROM charts")
def _(t: Ledger) -> DataFrame:
    order = W.partitionBy("company_id").orderBy(text.level(F.col("code")), "code")
    return t.charts.select("company_id", "code", F.row_number().over(order).alias("n"))


@query("snk01_ledger_export", f"""SELECT posting_id, strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS moment, text, history, dc, amount, rule_kind, code, bank_id, CAST(tx_id AS VARCHAR) AS tx_id
    FROM postings WHERE moment >= TIMESTAMP '{FIRST}' AND moment <= TIMESTAMP '{LAST}'""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return exports.ledger(t.postings, FIRST, LAST)


@query("snk02_statement_export", f"""SELECT strftime(moment, '%d/%m/%Y') AS date, concat_ws(' ', acronym, branch, number, digit) AS account,
    history, dc, amount, status FROM transactions JOIN banks USING (bank_id) WHERE NOT deleted AND {INSIDE}""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return exports.statement(t.transactions, t.banks, FIRST, LAST)


@query("snk02_statement_filtered", f"""SELECT strftime(moment, '%d/%m/%Y') AS date, concat_ws(' ', acronym, branch, number, digit) AS account,
    history, dc, amount, status FROM transactions JOIN banks USING (bank_id) WHERE NOT deleted AND status = 'pendente' AND {INSIDE}""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return exports.statement(t.transactions, t.banks, FIRST, LAST, status="pendente")


@query("snk01_workbook_round_trip", f"""SELECT posting_id, strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS moment, text, history, dc, amount, rule_kind, code, bank_id, CAST(tx_id AS VARCHAR) AS tx_id
    FROM postings WHERE moment >= TIMESTAMP '{FIRST}' AND moment <= TIMESTAMP '{LAST}'""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    """The ledger export as workbooks, read cell by cell and put together again."""
    back = read_back(t, exports.ledger(t.postings, FIRST, LAST))
    return back.withColumns({"amount": F.col("amount").cast("decimal(15,2)"), "bank_id": F.col("bank_id").cast("long")})


VALID = "company_id % 4 <> 3"  # tax ids of the others are made wrong


def invoice_export(kind: str, party: str) -> str:
    return rf"""SELECT i.company_id, strftime(issued, '%Y-%m-%d') AS day, number, series, issuer, issuer_name, recipient, i.amount, coalesce(access_key, '') AS access_key, i.status,
    coalesce(strftime(t.moment, '%Y-%m-%d'), '') AS tx_day, t.amount AS tx_amount FROM invoices i JOIN (SELECT company_id, tax_id FROM companies WHERE {VALID}) c ON i.company_id = c.company_id
    LEFT JOIN transactions t ON i.tx_id = t.tx_id WHERE i.kind = '{kind}' AND NOT i.deleted AND regexp_replace({party}, '\D', '', 'g') = regexp_replace(c.tax_id, '\D', '', 'g')"""


def _invoice_export(name: str) -> None:
    @query(f"snk03_{name}", invoice_export(*exports.INVOICE_EXPORTS[name]))
    def _(t: Ledger) -> DataFrame:
        return exports.invoices(t.invoices, t.companies, t.transactions, name)


for _name in exports.INVOICE_EXPORTS:
    _invoice_export(_name)


@query("snk03_refused_companies", f"SELECT company_id, tax_id FROM companies WHERE NOT ({VALID})")
def _(t: Ledger) -> DataFrame:
    return exports.refused_companies(t.companies)


@query("snk09_insert_statements", """SELECT 'INSERT INTO accounts (company_id, code, label, kind, deleted) VALUES (' || CAST(company_id AS VARCHAR) || ', ''' || code || ''', ''' || label || ''', ''' || kind || ''', '
    || upper(CAST(deleted AS VARCHAR)) || ') ON CONFLICT (company_id, code) DO NOTHING;' AS statement FROM charts""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return exports.inserts(t.charts.select("company_id", "code", "label", "kind", "deleted"), "accounts", "company_id, code")


@query("snk10_supplier_state", """SELECT supplier_id, 0 AS place, to_json({'supplier_id': CAST(supplier_id AS VARCHAR), 'name': name, 'opening': CAST(opening AS VARCHAR), 'opening_side': opening_side}) AS state FROM suppliers
    UNION ALL SELECT supplier_id, CAST(row_number() OVER (PARTITION BY supplier_id ORDER BY moment, invoice, line, part, quantity, credit, debit) AS INTEGER), to_json({'supplier_id': CAST(supplier_id AS VARCHAR),
    'moment': strftime(moment, '%Y-%m-%d %H:%M:%S'), 'invoice': invoice, 'line': CAST(line AS VARCHAR), 'part': CAST(part AS VARCHAR), 'quantity': CAST(quantity AS VARCHAR), 'credit': CAST(credit AS VARCHAR), 'debit': CAST(debit AS VARCHAR)})
    FROM entries""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    return exports.state(t.suppliers.drop("account", "tax_id"), t.entries, ["moment", "invoice", "line", "part", "quantity", "credit", "debit"])


CONFERENCE = """i AS (SELECT invoice_id - invoice_id % 12 AS tx_id, number, kind, amount, row_number() OVER (PARTITION BY invoice_id - invoice_id % 12 ORDER BY invoice_id) AS k
    FROM invoices WHERE NOT deleted AND status <> 'cancelada'),
r AS (SELECT receipt_id - receipt_id % 12 AS tx_id, payee, paid, row_number() OVER (PARTITION BY receipt_id - receipt_id % 12 ORDER BY receipt_id) AS k FROM receipts WHERE NOT deleted AND tx_id IS NULL),
z AS (SELECT coalesce(i.tx_id, r.tx_id) AS tx_id, coalesce(i.k, r.k) AS k, number, kind, amount, payee, paid, i.k IS NOT NULL AS has_i, r.k IS NOT NULL AS has_r FROM i FULL JOIN r ON i.tx_id = r.tx_id AND i.k = r.k)"""


@query(
    "jn09_conference",
    f"""WITH {CONFERENCE} SELECT t.tx_id, CAST(coalesce(k, 1) AS INTEGER) AS row_no, {", ".join(f"CASE WHEN coalesce(k, 1) = 1 THEN {c} END AS {n}" for n, c in
        {"day": "strftime(moment, '%Y-%m-%d')", "history": "history", "dc": "dc", "amount": "t.amount", "status": "t.status",
         "state": "CASE WHEN has_i AND has_r THEN 'Conciliado' WHEN has_i OR has_r THEN 'Parcial' ELSE 'Pendente' END"}.items())},
    z.number AS invoice, z.kind AS invoice_kind, z.amount AS invoice_amount, payee, paid FROM transactions t LEFT JOIN z ON t.tx_id = z.tx_id""",
)
def _(t: Ledger) -> DataFrame:
    """Twelve neighbours' documents belong to one transaction, so that some have many and most none."""

    def at(c: str) -> DataFrame:
        return F.col(c) - F.col(c) % 12

    left = t.invoices.filter("status <> 'cancelada'").withColumn("tx_id", at("invoice_id"))
    right = t.receipts.filter("tx_id IS NULL").withColumn("tx_id", at("receipt_id"))
    return exports.conference(t.transactions, left, right)


@query("snk06_safe_cells", """WITH x AS (SELECT tx_id, CASE tx_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || history AS v FROM transactions)
    SELECT tx_id, CASE WHEN regexp_matches(v, '^\\s*[=+\\-@]') THEN '''' || v ELSE v END AS cell FROM x""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("tx_id") % 5
    lead = F.when(k == 0, "=").when(k == 1, "  +").when(k == 2, "-").when(k == 3, "@").otherwise("")
    return t.transactions.select("tx_id", text.safe_cell(F.concat(lead, F.col("history"))).alias("cell"))


@query("snk08_append_unseen", "SELECT tx_id FROM transactions WHERE status = 'pendente'")
def _(t: Ledger) -> DataFrame:
    batch, there = t.transactions.unionByName(t.transactions), t.transactions.filter("status = 'processada'")
    return exports.unseen(batch, there, "tx_id").select("tx_id")


@query("snk11_attachment_type", """SELECT receipt_id, CASE receipt_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END AS type,
    CAST(length(CAST(receipt_id AS VARCHAR)) AS INTEGER) AS bytes FROM receipts""")  # fmt: skip
def _(t: Ledger) -> DataFrame:
    k = F.col("receipt_id")
    rows = t.receipts.select(
        "receipt_id",
        F.when(k % 3 == 0, "a.PDF").when(k % 3 == 1, "b.png").otherwise("c.bin").alias("name"),
        F.base64(k.cast("string").cast("binary")).alias("content"),
    )
    return exports.attachments(rows).select("receipt_id", "type", F.octet_length("bytes").alias("bytes"))
