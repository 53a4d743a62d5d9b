"""Text lines of a printed statement: dates carry on, descriptions may stand on the line before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import statement_date
from ..functions.numbers import statement_amount
from ..functions.text import any_word, stripped
from ..operators.scans import divided, with_last
from ..scratch import stored

# Shapes of lines.
LINE = r"^(.+?)\s+(-?\d{1,3}(?:\.\d{3})*(?:,\d{2})?)\s+(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)\s*$"
DATE = r"^(\d{2}[/\-]\d{2}[/\-](?:\d{4}|\d{2}))\s*"
SKIPPED = r"(?i)^(Data\s|Ag[eê]ncia|Extrato|Total\s|Os dados|Pr[oó]ximo|^\s*Cr[eé]dito|^\s*D[eé]bito|Saldo \(|REM:\s)"
BARCODE = r"^\d{17,20}"
BALANCE = r"(?i)\bSALDO\b|\bBALANCE\b|\bTOTAL\b"
NUMBER_BEFORE, NUMBER_AFTER = r"^\d{3,8}\s*", r"\s+\d{4,8}\s*$"
DECLARED = r"(?i)(-?\(?\d[\d.]*,\d{2}\)?)(?:\s*([DC]))?\s*$"
# What a declared value is, by words in its line.
OPENING_WORDS, CLOSING_WORDS = ["SALDO ANTERIOR", "SALDO INICIAL"], ["SALDO FINAL", "SALDO ATUAL"]
DEBIT_WORDS, CREDIT_WORDS = ["DÉBIT", "DEBIT"], ["CRÉDIT", "CREDIT"]


#: lines beyond which files whose hashes share one of BUCKETS are scanned in ranges
LARGE, BUCKETS = 200_000, 1 << 16


def read(lines: DataFrame, year: int) -> DataFrame:
    """What each line says by itself: file, n, is_data, and its day, amount and text if it is a movement, else its text."""
    told = lambda x: (x != "") & ~x.rlike(SKIPPED) & ~(x.rlike(BALANCE) & ~x.rlike(r"-\d"))
    # filters of a column would be pushed below it and strip the text again for each pattern; those of an array aren't
    rows = lines.select("file", "n", F.explode(F.filter(F.array(stripped(F.col("text"))), told)).alias("line"))
    rows = rows.withColumns({"prefix": F.regexp_extract("line", LINE, 1), "plain": stripped(F.regexp_replace("line", BARCODE, ""))})
    is_data = F.col("prefix") != ""
    rest = stripped(F.regexp_replace(stripped(F.regexp_replace("prefix", DATE, "")), BARCODE, ""))
    # each step's columns are used several times by the next one's
    rows = rows.select(
        "file", "n", is_data.alias("is_data"), F.when(~is_data & (F.col("plain") != "") & ~F.col("plain").rlike(r"^\d+$"), F.col("plain")).alias("plain"),
        F.when(is_data, F.regexp_extract("prefix", DATE, 1)).alias("day"), F.when(is_data, F.regexp_extract("line", LINE, 2)).alias("raw"),
        F.when(is_data, rest).alias("rest"),
    )
    bare = stripped(F.regexp_replace(stripped(F.regexp_replace("rest", NUMBER_BEFORE, "")), NUMBER_AFTER, ""))
    own = F.when(F.col("day") != "", statement_date(F.col("day"), year))
    text = F.coalesce("plain", F.nullif(bare, F.lit("")), F.nullif(F.col("rest"), F.lit("")))
    return rows.select("file", "n", "is_data", own.alias("own"), statement_amount(F.col("raw")).alias("amount"), text.alias("said"))


def movements(rows: DataFrame, short: bool) -> DataFrame:
    """Movements of the lines that `read` gives, of files that are all short, or of any length."""
    rows = with_last(rows, "file", "n", F.col("own"), "date", short=short)
    uses = F.col("is_data") & F.col("date").isNotNull()
    # a movement takes the text that came last, unless another movement stands between
    plain = F.when(~F.col("is_data"), F.col("said"))
    rows = with_last(rows, "file", "n", F.when(uses, "").otherwise(plain), "pending", own=False, short=short).filter(uses)
    history = F.coalesce(F.nullif(F.col("pending"), F.lit("")), F.col("said"), F.lit("SEM DESCRIÇÃO"))
    return rows.select("file", "n", "date", "amount", F.left(history, F.lit(200)).alias("history")).filter("amount <> 0")


def transactions(lines: DataFrame, year: int) -> DataFrame:
    """file, n, date, amount and history of each movement; `lines` has file, n and text.

    Lines are read once; files are then dealt whole, but for those that are long, whose ranges are.
    """
    rows = stored(read(lines, year).filter("is_data OR said IS NOT NULL"))
    short, long = divided(rows, ["file"], LARGE, BUCKETS)
    found = movements(short, True)
    return found if long is None else found.unionByName(movements(long, False))


def declared(lines: DataFrame) -> DataFrame:
    """What each file declares: its first opening and last closing balance, and its last totals; null where nothing."""
    upper = F.upper("text")
    raw, dc = statement_amount(F.col("raw")).cast("decimal(25,2)"), F.col("dc")
    value = F.when(dc == "D", -F.abs(raw)).when(dc == "C", F.abs(raw)).otherwise(raw)
    total = upper.contains("TOTAL")
    kind = (
        F.when(any_word(upper, OPENING_WORDS), "opening")
        .when(any_word(upper, CLOSING_WORDS), "closing")
        .when(total & any_word(upper, DEBIT_WORDS), "debits")
        .when(total & any_word(upper, CREDIT_WORDS), "credits")
    )
    # only lines of a kind are looked at for a value
    rows = lines.select("file", "n", F.when(kind.isNotNull(), F.col("text")).alias("text"), kind.alias("kind"))
    rows = rows.withColumns({"raw": F.regexp_extract("text", DECLARED, 1), "dc": F.upper(F.regexp_extract("text", DECLARED, 2))})
    rows = rows.select("file", "n", "kind", F.when(F.col("raw") != "", value).alias("value"))
    last = lambda k: F.max_by("value", F.when((F.col("kind") == k) & F.col("value").isNotNull(), F.col("n")))
    return rows.groupBy("file").agg(
        F.min_by("value", F.when((F.col("kind") == "opening") & F.col("value").isNotNull(), F.col("n"))).alias("opening"),
        last("closing").alias("closing"),
        F.abs(last("credits")).alias("declared_credits"),
        F.abs(last("debits")).alias("declared_debits"),
    )


def complete(found: DataFrame, declared: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Whether a statement's movements make up its declared balances; one that declares nothing fails."""
    sums = found.groupBy("file").agg(
        F.sum("amount").alias("net"),
        F.sum(F.greatest("amount", F.lit(0))).alias("credits"),
        F.sum(F.greatest(-F.col("amount"), F.lit(0))).alias("debits"),
    )
    zero = F.lit(0).cast("decimal(25,2)")

    def close(a: Column, b: Column) -> Column:
        return F.abs(F.coalesce(a, zero) - b) <= tolerance

    by_balance = close(F.col("net"), F.col("closing") - F.col("opening"))
    by_total = close(F.col("credits"), F.col("declared_credits")) & close(F.col("debits"), F.col("declared_debits"))
    has_balance = F.col("closing").isNotNull() & F.col("opening").isNotNull()
    has_total = F.col("declared_credits").isNotNull() & F.col("declared_debits").isNotNull()
    ok = (has_balance | has_total) & (~has_balance | by_balance) & (~has_total | by_total)
    return declared.join(sums, "file", "left").select("file", F.coalesce(ok, F.lit(False)).alias("complete"))
