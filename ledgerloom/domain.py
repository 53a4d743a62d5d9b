"""Ledger tables projected from the driver's star schema, in Spark and as SQL common table expressions.

Amounts are DECIMAL(15,2) end to end.  Both forms must stay in step; `cte()` gives the SQL of the
tables a query names, with all that they build on.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import taxid

#: account kind by part type: fixed values
KINDS = {
    "STANDARD": ("1", "ativo"), "SMALL": ("2", "passivo"), "MEDIUM": ("3", "patrimonio_liquido"),
    "LARGE": ("4", "receita"), "ECONOMY": ("5", "despesa"), "PROMO": ("6", "custo"),
}


def money(c):
    return c.cast("decimal(15,2)")


class Ledger:
    """The tables of one folder, each built once and lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        base = F.lpad((F.col("n_nationkey") * 9301 + 49297).cast("string"), 12, "0")
        right = taxid.with_check_digits(base)
        wrong = F.concat(F.left(right, F.lit(13)), ((F.right(right, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        return self.raw("nation").select(
            F.col("n_nationkey").alias("company_id"),
            F.col("n_regionkey").alias("tenant_id"),
            F.col("n_name").alias("name"),
            F.when(F.col("n_nationkey") % 4 == 3, wrong).otherwise(right).alias("tax_id"),
            (F.col("n_nationkey") % 6 != 5).alias("active"),
        ).distinct()  # keeps the long expression of check digits from being repeated in all that builds on it

    @cached_property
    def users(self) -> DataFrame:
        rows = self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.select(F.col("s_suppkey").alias("user_id"), F.col("n_regionkey").alias("tenant_id"), F.col("s_name").alias("user_name"))

    @cached_property
    def permits(self) -> DataFrame:
        """Three companies for each user, with the modules that it may see there."""
        k = F.col("s_suppkey") + F.col("i")
        modules = F.when(k % 3 == 0, "*").when(k % 3 == 1, "extrato,neo").otherwise("notas")
        three = self.raw("supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
        return three.select(F.col("s_suppkey").alias("user_id"), ((F.col("s_suppkey") + 7 * F.col("i")) % 25).cast("int").alias("company_id"), modules.alias("modules"))

    @cached_property
    def banks(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("bank_id"),
            F.col("c_nationkey").alias("company_id"),
            F.col("c_mktsegment").alias("acronym"),
            F.lpad((key % 10000).cast("string"), 4, "0").alias("branch"),
            key.cast("string").alias("number"),
            F.when(key % 3 != 0, (key % 10).cast("string")).alias("digit"),
            (key % 10 != 0).alias("active"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        table = F.create_map(*[F.lit(x) for t, (d, _) in KINDS.items() for x in (t, d)])
        kinds = F.create_map(*[F.lit(x) for t, (_, k) in KINDS.items() for x in (t, k)])
        brand = F.substring_index("p_brand", "#", -1)
        return (
            self.raw("part")
            .select("p_type", "p_brand")
            .distinct()
            .select(
                F.concat(table[F.col("p_type")], F.lit("."), F.lpad(brand, 2, "0")).alias("code"),
                F.concat_ws(" ", "p_type", "p_brand").alias("label"),
                kinds[F.col("p_type")].alias("kind"),
                (brand.cast("int") % 9 == 0).alias("deleted"),
            )
        )

    @cached_property
    def charts(self) -> DataFrame:
        """Which accounts each company has."""
        table = F.create_map(*[F.lit(x) for t, (d, _) in KINDS.items() for x in (t, d)])
        brand = F.substring_index("p_brand", "#", -1)
        parts, customers = self.raw("part"), self.raw("customer")
        code = F.concat(table[F.col("p_type")], F.lit("."), F.lpad(brand, 2, "0")).alias("code")
        own = customers.join(parts, customers.c_custkey == parts.p_partkey).select(F.col("c_nationkey").alias("company_id"), code)
        return own.distinct().join(self.accounts, "code")

    @cached_property
    def transactions(self) -> DataFrame:
        orders, customers = self.raw("orders"), self.raw("customer")
        return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
            F.col("o_orderkey").alias("tx_id"),
            F.col("o_custkey").alias("bank_id"),
            F.col("c_nationkey").alias("company_id"),
            F.col("o_orderdate").alias("moment"),
            money(F.col("o_totalprice")).alias("amount"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("history"),
            F.when(F.col("o_orderstatus") == "F", "D").otherwise("C").alias("dc"),
            F.when(F.col("o_orderstatus") == "O", "processada").otherwise("pendente").alias("status"),
            (F.col("o_orderkey") % 50 == 0).alias("deleted"),
        )

    @cached_property
    def postings(self) -> DataFrame:
        parts = self.raw("part").select("p_partkey", "p_type", "p_brand")
        table = F.create_map(*[F.lit(x) for t, (d, _) in KINDS.items() for x in (t, d)])
        brand = F.substring_index("p_brand", "#", -1)
        tx = self.transactions.select("tx_id", "bank_id", "company_id", "history")
        lines = self.raw("lineitem")
        return (
            lines.join(parts, lines.l_partkey == parts.p_partkey)
            .join(tx, lines.l_orderkey == tx.tx_id)
            .select(
                "tx_id",
                "bank_id",
                "company_id",
                F.col("l_linenumber").alias("line"),
                F.concat(table[F.col("p_type")], F.lit("."), F.lpad(brand, 2, "0")).alias("code"),
                F.when(F.col("l_linestatus") == "O", "C").otherwise("D").alias("dc"),
                money(F.col("l_extendedprice")).alias("amount"),
                F.col("l_shipdate").alias("moment"),
                (F.col("l_returnflag") == "R").alias("deleted"),
                F.concat_ws("-", "tx_id", "l_linenumber").alias("posting_id"),
                F.concat_ws(" ", "p_type", "p_brand").alias("text"),
                "history",
                F.when(F.col("l_linenumber") % 3 == 0, "manual").otherwise("automatica").alias("rule_kind"),
            )
        )

    @cached_property
    def rules(self) -> DataFrame:
        """Several rules for each bank account: an exact text, a fragment of it and a shorter one."""
        b = self.banks
        kinds = F.array(
            F.struct(F.lit(1).alias("n"), F.concat(F.lit("1-urgent "), F.lower("acronym")).alias("text"), F.lit("D").alias("dc")),
            F.struct(F.lit(2).alias("n"), F.lower(F.left("acronym", F.lit(5))).alias("text"), F.lit("D").alias("dc")),
            F.struct(F.lit(3).alias("n"), F.lit("high").alias("text"), F.lit("D").alias("dc")),
            F.struct(F.lit(4).alias("n"), F.lower("acronym").alias("text"), F.lit("C").alias("dc")),
            F.struct(F.lit(5).alias("n"), F.lit("low").alias("text"), F.lit("C").alias("dc")),
        )
        return b.select("bank_id", "company_id", F.inline(kinds)).select(
            (F.col("bank_id") * 10 + F.col("n")).alias("rule_id"),
            "bank_id",
            "company_id",
            "text",
            "dc",
            F.concat(F.lit("rule "), F.col("n").cast("string")).alias("description"),
            F.concat(F.when(F.col("dc") == "D", "5.").otherwise("4."), F.lpad(F.col("n").cast("string"), 2, "0")).alias("code"),
            (F.col("n") % 2 == 0).alias("keep_history"),
            ((F.col("bank_id") + F.col("n")) % 4 != 0).alias("active"),
            F.when((F.col("bank_id") + F.col("n")) % 9 == 0, "manual").otherwise("automatica").alias("kind"),
        )

    @cached_property
    def entries(self) -> DataFrame:
        """Supplier ledger entries: credits are purchases, debits payments."""
        purchase = F.col("l_linestatus") == "O"
        amount = money(F.col("l_extendedprice"))
        zero = money(F.lit(0))
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_shipdate").alias("moment"),
            F.col("l_orderkey").cast("string").alias("invoice"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(purchase, amount).otherwise(zero).alias("credit"),
            F.when(purchase, zero).otherwise(amount).alias("debit"),
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("name"),
            money(F.col("s_acctbal")).alias("opening"),
            F.when(F.col("s_suppkey") % 3 == 0, "D").otherwise("C").alias("opening_side"),
            F.concat(F.lit("2.1.3."), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("account"),
            F.lpad((F.col("s_suppkey") * 97).cast("string"), 14, "0").alias("tax_id"),
        )

    @cached_property
    def invoices(self) -> DataFrame:
        """An invoice near each transaction; on some the company is both parties or neither."""
        k, own, other = F.col("tx_id"), F.col("tax_id"), F.lit("99999999000191")
        issuer = F.when(k % 13 == 0, own).when(k % 13 == 1, other).when(k % 2 == 0, own).otherwise(other)
        recipient = F.when(k % 13 == 0, own).when(k % 13 == 1, other).when(k % 2 == 0, other).otherwise(own)
        taken = k % 7 == 1
        return self.transactions.join(self.companies.select("company_id", "tax_id"), "company_id").select(
            k.alias("invoice_id"),
            "company_id",
            F.when(k % 4 < 2, "nfe").otherwise("nfse").alias("kind"),
            k.cast("string").alias("number"),
            F.when(k % 5 == 0, "2").otherwise("1").alias("series"),
            F.when(k % 3 == 0, taxid.masked(issuer)).otherwise(issuer).alias("issuer"),
            F.concat(F.lit("issuer "), (k % 100).cast("string")).alias("issuer_name"),
            recipient.alias("recipient"),
            (F.col("amount") + ((k % 5 - 2) * F.lit(0.01).cast("decimal(3,2)"))).cast("decimal(15,2)").alias("amount"),
            (F.col("moment") + F.make_dt_interval((k % 9 - 4).cast("int"))).alias("issued"),
            F.when(k % 7 == 0, "cancelada").when(taken, "associada").otherwise("pendente").alias("status"),
            F.when(taken, k).alias("tx_id"),
            F.when(k % 4 < 2, F.lpad(k.cast("string"), 44, "0")).alias("access_key"),
            "deleted",
        )

    @cached_property
    def receipts(self) -> DataFrame:
        """A receipt near each transaction, some of them of another bank account of the company."""
        k = F.col("tx_id")
        return self.transactions.select(
            k.alias("receipt_id"),
            "company_id",
            "bank_id",
            F.concat(F.lit("payee "), (k % 100).cast("string")).alias("payee"),
            (F.col("amount") + ((k % 5 - 2) * F.lit(0.01).cast("decimal(3,2)"))).cast("decimal(15,2)").alias("paid"),
            (F.col("moment") + F.make_dt_interval((k % 9 - 4).cast("int"))).alias("paid_at"),
            F.when(k % 6 == 1, k).alias("tx_id"),
            "deleted",
        )

    @cached_property
    def cards(self) -> DataFrame:
        return self.banks.select(F.col("bank_id").alias("card_id"), "company_id", F.concat(F.lit("card "), F.col("number")).alias("label"))

    @cached_property
    def card_entries(self) -> DataFrame:
        """Purchases of cards, by the month of their invoice."""
        return self.transactions.select(
            F.col("bank_id").alias("card_id"),
            F.date_format("moment", "yyyy-MM").alias("month"),
            F.col("tx_id").alias("entry_id"),
            "amount",
            "deleted",
        )

    @cached_property
    def card_invoices(self) -> DataFrame:
        """One for each card and month; some months have no live entries."""
        n = F.substring(F.col("month"), 6, 2).cast("int")
        return (
            self.card_entries.select("card_id", "month")
            .distinct()
            .withColumn("status", F.when((F.col("card_id") + n) % 3 == 0, "paga").otherwise("aberta"))
        )


def _case(column: str, which: int) -> str:
    whens = " ".join(f"WHEN '{t}' THEN '{v[which]}'" for t, v in KINDS.items())
    return f"CASE {column} {whens} END"


def _check(base: str, weights: list[int]) -> str:
    total = " + ".join(f"CAST(substr({base}, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights))
    return f"CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END"


_CODE = f"{_case('p_type', 0)} || '.' || lpad(split_part(p_brand, '#', 2), 2, '0')"

SQL = {
    "tax_base": "SELECT n_nationkey, lpad(CAST(n_nationkey * 9301 + 49297 AS VARCHAR), 12, '0') AS b FROM nation",
    "tax_13": f"SELECT n_nationkey, b || CAST({_check('b', taxid.FIRST)} AS VARCHAR) AS b FROM tax_base",
    "tax_14": f"SELECT n_nationkey, b || CAST({_check('b', taxid.SECOND)} AS VARCHAR) AS t FROM tax_13",
    "companies": """SELECT n_nationkey AS company_id, n_regionkey AS tenant_id, n_name AS name,
        CASE WHEN n_nationkey % 4 = 3 THEN left(t, 13) || CAST((CAST(right(t, 1) AS INTEGER) + 1) % 10 AS VARCHAR) ELSE t END AS tax_id,
        n_nationkey % 6 <> 5 AS active FROM nation JOIN tax_14 USING (n_nationkey)""",
    "banks": """SELECT c_custkey AS bank_id, c_nationkey AS company_id, c_mktsegment AS acronym,
        lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS branch, CAST(c_custkey AS VARCHAR) AS number,
        CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 10 AS VARCHAR) END AS digit, c_custkey % 10 <> 0 AS active FROM customer""",
    "accounts": f"""SELECT DISTINCT {_CODE} AS code, p_type || ' ' || p_brand AS label, {_case('p_type', 1)} AS kind,
        CAST(split_part(p_brand, '#', 2) AS INTEGER) % 9 = 0 AS deleted FROM part""",
    "charts": f"""SELECT DISTINCT c_nationkey AS company_id, code, label, kind, deleted
        FROM customer JOIN (SELECT p_partkey, {_CODE} AS code FROM part) ON c_custkey = p_partkey JOIN accounts USING (code)""",
    "transactions": """SELECT o_orderkey AS tx_id, o_custkey AS bank_id, c_nationkey AS company_id, o_orderdate AS moment,
        CAST(o_totalprice AS DECIMAL(15,2)) AS amount, o_orderpriority || ' ' || c_mktsegment AS history,
        CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'C' END AS dc,
        CASE WHEN o_orderstatus = 'O' THEN 'processada' ELSE 'pendente' END AS status, o_orderkey % 50 = 0 AS deleted
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "postings": f"""SELECT tx_id, bank_id, company_id, l_linenumber AS line, {_CODE} AS code,
        CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'D' END AS dc, CAST(l_extendedprice AS DECIMAL(15,2)) AS amount,
        l_shipdate AS moment, l_returnflag = 'R' AS deleted, concat_ws('-', tx_id, l_linenumber) AS posting_id,
        p_type || ' ' || p_brand AS text, history, CASE WHEN l_linenumber % 3 = 0 THEN 'manual' ELSE 'automatica' END AS rule_kind
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN transactions ON l_orderkey = tx_id""",
    "rules": """SELECT bank_id * 10 + n AS rule_id, bank_id, company_id,
        CASE n WHEN 1 THEN '1-urgent ' || lower(acronym) WHEN 2 THEN lower(left(acronym, 5)) WHEN 3 THEN 'high'
               WHEN 4 THEN lower(acronym) ELSE 'low' END AS text,
        CASE WHEN n <= 3 THEN 'D' ELSE 'C' END AS dc, 'rule ' || CAST(n AS VARCHAR) AS description,
        (CASE WHEN n <= 3 THEN '5.' ELSE '4.' END) || lpad(CAST(n AS VARCHAR), 2, '0') AS code,
        n % 2 = 0 AS keep_history, (bank_id + n) % 4 <> 0 AS active, CASE WHEN (bank_id + n) % 9 = 0 THEN 'manual' ELSE 'automatica' END AS kind
        FROM banks, (VALUES (1), (2), (3), (4), (5)) k(n)""",
    "entries": """SELECT l_suppkey AS supplier_id, l_shipdate AS moment, CAST(l_orderkey AS VARCHAR) AS invoice, l_linenumber AS line,
        l_partkey AS part, CAST(l_quantity AS INTEGER) AS quantity,
        CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(15,2)) ELSE CAST(0 AS DECIMAL(15,2)) END AS credit,
        CASE WHEN l_linestatus = 'O' THEN CAST(0 AS DECIMAL(15,2)) ELSE CAST(l_extendedprice AS DECIMAL(15,2)) END AS debit
        FROM lineitem""",
    "suppliers": """SELECT s_suppkey AS supplier_id, s_name AS name, CAST(s_acctbal AS DECIMAL(15,2)) AS opening,
        CASE WHEN s_suppkey % 3 = 0 THEN 'D' ELSE 'C' END AS opening_side, '2.1.3.' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS account, lpad(CAST(s_suppkey * 97 AS VARCHAR), 14, '0') AS tax_id
        FROM supplier""",
    "users": """SELECT s_suppkey AS user_id, n_regionkey AS tenant_id, s_name AS user_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "permits": """SELECT s_suppkey AS user_id, CAST((s_suppkey + 7 * i) % 25 AS INTEGER) AS company_id,
        CASE (s_suppkey + i) % 3 WHEN 0 THEN '*' WHEN 1 THEN 'extrato,neo' ELSE 'notas' END AS modules FROM supplier, (VALUES (0), (1), (2)) v(i)""",
    "invoice_sides": """SELECT *, CASE WHEN tx_id % 13 = 0 THEN tax_id WHEN tx_id % 13 = 1 THEN '99999999000191' WHEN tx_id % 2 = 0 THEN tax_id ELSE '99999999000191' END AS one,
        CASE WHEN tx_id % 13 = 0 THEN tax_id WHEN tx_id % 13 = 1 THEN '99999999000191' WHEN tx_id % 2 = 0 THEN '99999999000191' ELSE tax_id END AS two
        FROM transactions JOIN (SELECT company_id, tax_id FROM companies) USING (company_id)""",
    "invoices": r"""SELECT tx_id AS invoice_id, company_id, CASE WHEN tx_id % 4 < 2 THEN 'nfe' ELSE 'nfse' END AS kind,
        CAST(tx_id AS VARCHAR) AS number, CASE WHEN tx_id % 5 = 0 THEN '2' ELSE '1' END AS series,
        CASE WHEN tx_id % 3 = 0 THEN regexp_replace(one, '^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$', '\1.\2.\3/\4-\5') ELSE one END AS issuer,
        'issuer ' || CAST(tx_id % 100 AS VARCHAR) AS issuer_name, two AS recipient,
        CAST(amount + CAST(tx_id % 5 - 2 AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS amount,
        moment + to_days(CAST(tx_id % 9 - 4 AS INTEGER)) AS issued,
        CASE WHEN tx_id % 7 = 0 THEN 'cancelada' WHEN tx_id % 7 = 1 THEN 'associada' ELSE 'pendente' END AS status,
        CASE WHEN tx_id % 7 = 1 THEN tx_id END AS tx_id, CASE WHEN tx_id % 4 < 2 THEN lpad(CAST(tx_id AS VARCHAR), 44, '0') END AS access_key, deleted
        FROM invoice_sides""",
    "receipts": """SELECT tx_id AS receipt_id, company_id, bank_id, 'payee ' || CAST(tx_id % 100 AS VARCHAR) AS payee,
        CAST(amount + CAST(tx_id % 5 - 2 AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS paid,
        moment + to_days(CAST(tx_id % 9 - 4 AS INTEGER)) AS paid_at, CASE WHEN tx_id % 6 = 1 THEN tx_id END AS tx_id, deleted
        FROM transactions""",
    "cards": "SELECT bank_id AS card_id, company_id, 'card ' || number AS label FROM banks",
    "card_entries": """SELECT bank_id AS card_id, strftime(moment, '%Y-%m') AS month, tx_id AS entry_id, amount, deleted FROM transactions""",
    "card_invoices": """SELECT DISTINCT card_id, month,
        CASE WHEN (card_id + CAST(substr(month, 6, 2) AS INTEGER)) % 3 = 0 THEN 'paga' ELSE 'aberta' END AS status FROM card_entries""",
}


def cte(body: str) -> str:
    """The query with the tables that it names, and all that they build on, before it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(SQL[name])
                needed.append(name)

    add(body)
    own = body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    if not ctes:
        return own
    if own[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{own[14:].strip()}"
    return f"WITH {ctes},\n{own[4:].strip()}" if own[:5].upper() == "WITH " else f"WITH {ctes}\n{own}"
