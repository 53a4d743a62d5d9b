"""Rule matching, double-entry expansion and the decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.text import normal_history


def matches(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """The active automatic rule of each pending transaction: exact text before contained text, longer before shorter, then by id.

    Rules meet transactions of their bank account and side only; what is compared beyond that is a residual.
    """
    pending = transactions.filter("status = 'pendente'").withColumn("norm", normal_history(F.col("history")))
    active = rules.filter("active AND kind = 'automatica'").select(
        "bank_id", "dc", "rule_id", "description", "code", "keep_history", F.col("text").alias("rule_text")
    )
    hit = pending.join(active, ["bank_id", "dc"]).filter(F.col("norm").contains(F.col("rule_text")))
    exact = F.col("norm") == F.col("rule_text")
    order = W.partitionBy("tx_id").orderBy(F.desc(exact), F.desc(F.length("rule_text")), "rule_id")
    return (
        hit.withColumn("place", F.row_number().over(order))
        .filter("place = 1")
        .withColumn("strategy", F.when(exact, "exato").otherwise("substring"))
        .drop("place", "norm")
    )


def decisions(transactions: DataFrame, matched: DataFrame) -> DataFrame:
    """One row for each pending transaction: its rule, or `sem_regra`."""
    found = matched.select("tx_id", "rule_id", "strategy")
    return transactions.filter("status = 'pendente'").select("tx_id", "company_id").join(found, "tx_id", "left").select(
        "tx_id", "company_id", F.when(F.col("rule_id").isNull(), "sem_regra").otherwise("processada").alias("result"), "rule_id", "strategy"
    )


def new_decisions(found: DataFrame, log: DataFrame) -> DataFrame:
    """What a rerun adds: a transaction without a rule is logged once."""
    return found.join(log.filter("result = 'sem_regra'").select("tx_id", "result"), ["tx_id", "result"], "left_anti")


def double_entries(matched: DataFrame) -> DataFrame:
    """Two rows of each match, with one entry id, opposite sides and equal amounts."""
    text = F.when(F.col("keep_history"), F.col("history")).otherwise(F.col("description"))
    bank_code = hashing.ledger_code(hashing.uuid_of(F.col("bank_id").cast("string")))
    other = F.when(F.col("dc") == "D", "C").otherwise("D")
    sides = F.array(
        F.struct(F.col("code").alias("code"), F.col("dc").alias("dc"), F.lit("main").alias("role")),
        F.struct(bank_code.alias("code"), other.alias("dc"), F.lit("counter").alias("role")),
    )
    return matched.select(
        hashing.uuid_of(F.concat(F.col("tx_id").cast("string"), F.lit(":entry"))).alias("entry_id"),
        "tx_id", text.alias("text"), "amount", F.inline(sides),
    )


def bank_accounts(banks: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ledger accounts that bank accounts still lack."""
    code = hashing.ledger_code(hashing.uuid_of(F.col("bank_id").cast("string")))
    wanted = banks.select("bank_id", "company_id", code.alias("code"))
    return wanted.join(accounts.select("code"), "code", "left_anti").select("bank_id", "company_id", "code")


def missing_counterparts(postings: DataFrame) -> DataFrame:
    """Postings whose transaction has none on the other side, with the side that is missing."""
    other = postings.select(F.col("tx_id"), F.when(F.col("dc") == "D", "C").otherwise("D").alias("dc")).distinct()
    return postings.join(other, ["tx_id", "dc"], "left_anti").groupBy("tx_id", F.when(F.col("dc") == "D", "C").otherwise("D").alias("dc")).agg(
        F.sum("amount").cast("decimal(25,2)").alias("amount"), F.count("*").alias("postings")
    )


def summary(found: DataFrame, receipts: DataFrame, invoices: DataFrame) -> DataFrame:
    """Counts of a run by company: decisions, and the receipts and invoices that its transactions took."""
    taken = [d.groupBy("tx_id").agg(F.count("*").alias(n)) for d, n in ((receipts, "r"), (invoices, "i"))]
    rows = found.join(taken[0], "tx_id", "left").join(taken[1], "tx_id", "left")
    return rows.groupBy("company_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("result") == "processada").alias("processed"),
        F.count_if(F.col("result") == "sem_regra").alias("without_rule"),
        F.count_if(F.col("result") == "erro").alias("errors"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("receipts"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("invoices"),
    )


def decision_list(log: DataFrame, transactions: DataFrame, rules: DataFrame, result: str | None = None) -> DataFrame:
    """Decisions, of one result if it is given, with what their transactions and rules say."""
    rows = log.filter(F.col("result") == result) if result else log
    tx = transactions.select("tx_id", "bank_id", "history", "amount", "dc")
    named = rules.select("rule_id", F.col("description").alias("rule"))
    return rows.join(tx, "tx_id", "left").join(named, "rule_id", "left")


def manual(requests: DataFrame, log: DataFrame, transactions: DataFrame, charts: DataFrame) -> DataFrame:
    """What each request to post a transaction by hand comes to: `associada`, or why it is refused.

    `requests` has tx_id, company_id, code and description; the log has one decision of a transaction.
    """
    decided = log.select("tx_id", "company_id", "result")
    tx = transactions.select("tx_id", "company_id", "bank_id", "history", "amount", "dc", "status")
    chart = charts.filter("NOT deleted").select("company_id", "code", F.lit(True).alias("there"))
    rows = requests.join(decided, ["tx_id", "company_id"], "left").join(tx, ["tx_id", "company_id"], "left").join(chart, ["company_id", "code"], "left")
    outcome = (
        F.when(F.col("result").isNull(), "unknown decision")
        .when(F.col("result") != "sem_regra", "decided already")
        .when(F.col("status").isNull(), "unknown transaction")
        .when(F.col("status") != "pendente", "posted already")
        .when(F.col("there").isNull(), "unknown account")
        .otherwise("associada")
    )
    return rows.withColumn("outcome", outcome).drop("result", "status", "there")


def manual_entries(found: DataFrame) -> DataFrame:
    """The two postings of each request that `manual` allows."""
    bank_code = hashing.ledger_code(hashing.uuid_of(F.col("bank_id").cast("string")))
    other = F.when(F.col("dc") == "D", "C").otherwise("D")
    sides = F.array(
        F.struct(F.col("code").alias("account"), F.col("description").alias("text"), F.col("dc").alias("side")),
        F.struct(bank_code.alias("account"), F.concat(F.lit("Contrapartida bancária: "), F.col("description")).alias("text"), other.alias("side")),
    )
    return found.filter("outcome = 'associada'").select("tx_id", "history", "amount", F.inline(sides))
