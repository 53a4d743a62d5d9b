"""Statement lines that a text model has read: one JSON object each, under whatever field names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.dates import statement_date
from ..functions.numbers import statement_amount
from ..functions.text import stripped

# Names that a field may have, in the order in which they count, and words for a side.
DATE_NAMES = ["data", "date", "data_lancamento", "dt", "data_transacao", "transaction_date"]
TEXT_NAMES = ["historico", "description", "descricao", "memo", "historic", "historico_extrato", "desc", "narrative", "details"]
AMOUNT_NAMES = ["valor", "value", "amount", "montante", "quantia", "vlr"]
SIDE_NAMES = ["tipo", "dc", "type"]
DEBIT_WORDS = ["D", "DB", "DEBITO", "DEBIT", "SAIDA"]
CREDIT_WORDS = ["C", "CR", "CREDITO", "CREDIT", "ENTRADA"]
NO_TEXT = "SEM DESCRIÇÃO"


def first_of(item: Column, names: list[str]) -> Column:
    """The first of these fields that isn't empty."""
    return F.coalesce(*[F.nullif(stripped(item[n]), F.lit("")) for n in names])


def transactions(items: DataFrame, year: int) -> DataFrame:
    """file, n, date, amount, history, fitid and kind of each item; those without a date or an amount are left out.

    `items` has file, n and item (JSON).  A word for the side decides the sign.
    """
    rows = items.withColumn("_i", F.from_json("item", "map<string,string>"))
    item = F.col("_i")
    day = first_of(item, DATE_NAMES)
    iso = F.try_to_timestamp(F.left(F.replace(day, F.lit("/"), F.lit("-")), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")
    raw = first_of(item, AMOUNT_NAMES)
    plain = F.bround(F.regexp_replace(F.replace(raw, F.lit("R$"), F.lit("")), "[  ]", "").try_cast("decimal(25,6)"), 2).cast("decimal(15,2)")
    rows = rows.select("file", "n", "_i", F.coalesce(iso, statement_date(day, year)).alias("date"), F.coalesce(plain, statement_amount(raw)).alias("amount"))
    # the first of these names that an item has counts, even where it holds nothing
    side = F.upper(reduce(lambda rest, n: F.when(F.map_contains_key(item, n), item[n]).otherwise(rest), reversed(SIDE_NAMES), F.lit(None).cast("string")))
    amount = F.col("amount")
    signed = F.when(side.isin(*DEBIT_WORDS) & (amount > 0), -amount).when(side.isin(*CREDIT_WORDS) & (amount < 0), -amount).otherwise(amount)
    history = F.coalesce(first_of(item, TEXT_NAMES), F.lit(NO_TEXT))
    rows = rows.withColumns({"amount": signed.cast("decimal(15,2)"), "history": history}).filter("date IS NOT NULL AND amount IS NOT NULL")
    fitid = hashing.statement_fitid(F.col("date"), F.col("history"), F.col("amount"), F.col("n"))
    kind = F.when(F.col("amount") >= 0, "CREDIT").otherwise("DEBIT")
    return rows.select("file", "n", "date", "amount", F.left("history", F.lit(200)).alias("history"), fitid.alias("fitid"), kind.alias("kind"))
