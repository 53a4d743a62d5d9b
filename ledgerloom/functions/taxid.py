"""Company tax ids: 14 digits of which the last two check the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_only

# Weights of the first and the second check digit.
FIRST = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
SECOND = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]


def check_digit(digits: Column, weights: list[int]) -> Column:
    ds = F.transform(F.split(F.left(digits, F.lit(len(weights))), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.zip_with(ds, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0), lambda a, b: a + b)
    rest = total % 11
    return F.when(rest < 2, F.lit(0)).otherwise(11 - rest)


def with_check_digits(base: Column) -> Column:
    """Twelve digits and their two check digits."""
    thirteen = F.concat(base, check_digit(base, FIRST).cast("string"))
    return F.concat(thirteen, check_digit(thirteen, SECOND).cast("string"))


def is_valid(value: Column) -> Column:
    d = digits_only(F.coalesce(value, F.lit("")))
    right = F.right(d, F.lit(2)) == F.concat(check_digit(d, FIRST).cast("string"), check_digit(d, SECOND).cast("string"))
    return F.when((F.length(d) == 14) & ~d.rlike(r"^(\d)\1{13}$"), F.coalesce(right, F.lit(False))).otherwise(False)


def masked(value: Column) -> Column:
    """00.000.000/0000-00, or the input if it hasn't 14 digits."""
    d = digits_only(value)
    shown = F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", r"$1.$2.$3/$4-$5")
    return F.when(F.length(d) == 14, shown).otherwise(value)


def in_text(history: Column) -> Column:
    found = F.regexp_extract(history, r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})", 1)
    return F.when(found != "", found)
