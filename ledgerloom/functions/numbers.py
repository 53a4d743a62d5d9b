"""Five number dialects, kept apart because they disagree on inputs such as 1.234."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, stripped

MONEY = "decimal(15,2)"


def _swap(c: Column) -> Column:
    """Points out, comma to point."""
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def _money(c: Column) -> Column:
    return F.bround(c.try_cast("decimal(25,6)"), 2).cast(MONEY)


def ledger_text(c: Column) -> Column:
    """Points group, a comma is decimal; what isn't a number is 0."""
    clean = F.regexp_replace(_swap(stripped(c)), r"[^\d.-]", "")
    return F.coalesce(_money(clean), F.lit(0).cast(MONEY))


def sheet_cell(c: Column) -> Column:
    """The separator more to the right is decimal; a lone one groups unless one or two digits follow;
    brackets are negative; what isn't a number is 0."""

    def with_point(bare: Column) -> Column:
        comma, point = F.length(F.substring_index(bare, ",", -1)), F.length(F.substring_index(bare, ".", -1))
        return (
            F.when(bare.contains(",") & bare.contains("."), F.when(comma < point, _swap(bare)).otherwise(F.replace(bare, F.lit(","), F.lit(""))))
            .when(bare.rlike(r"^[^,]*,[^,]{1,2}$"), F.replace(bare, F.lit(","), F.lit(".")))
            .when(bare.contains(","), F.replace(bare, F.lit(","), F.lit("")))
            .when(bare.contains(".") & ~bare.rlike(r"^[^.]*\.[^.]{1,2}$"), F.replace(bare, F.lit("."), F.lit("")))
            .otherwise(bare)
        )

    def signed(clean: Column) -> Column:
        negative = clean.startswith("(") & clean.endswith(")")
        one = let(F.regexp_replace(clean, r"^[()]+|[()]+$", ""), with_point)
        return let(one, lambda x: F.when(negative & ~x.startswith("-"), F.concat(F.lit("-"), x)).otherwise(x))

    return F.coalesce(_money(let(F.regexp_replace(stripped(c), r"[^\d,().+-]", ""), signed)), F.lit(0).cast(MONEY))


def card_amount(c: Column) -> Column:
    """R$ and spaces out; Brazilian if a comma comes last, else commas group; null if no number."""
    clean = stripped(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("R$"), F.lit("")))
    comma = F.length(F.substring_index(clean, ",", -1)) < F.length(F.substring_index(clean, ".", -1))
    return _money(F.when(clean.contains(",") & (comma | ~clean.contains(".")), _swap(clean)).otherwise(F.replace(clean, F.lit(","), F.lit(""))))


def statement_amount(c: Column) -> Column:
    """Leading minus or bracket is negative; 1,234.56 is read as such, else a comma is decimal; null if no number."""
    def with_point(bare: Column) -> Column:
        return (
            F.when(bare.rlike(r"^\d{1,3}(,\d{3})*\.\d{2}$"), F.replace(bare, F.lit(","), F.lit("")))
            .when(bare.contains(",") & bare.contains("."), _swap(bare))
            .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
        )

    def signed(clean: Column) -> Column:
        value = _money(let(F.regexp_replace(F.regexp_replace(clean, r"^[-(]+", ""), r"\)+$", ""), with_point))
        return F.when(clean.rlike(r"^[-(]"), -value).otherwise(value).cast(MONEY)

    return let(F.regexp_replace(F.replace(stripped(c), F.lit("R$"), F.lit("")), "[  ]", ""), signed)


def ofx_amount(c: Column) -> Column:
    """Points group only beside a comma; null if no finite number."""
    return _money(F.when(c.contains(",") & c.contains("."), _swap(c)).otherwise(F.replace(c, F.lit(","), F.lit("."))))


def brazilian(c: Column) -> Column:
    """A decimal as 1.234,56."""
    return F.translate(F.format_number(c, 2), ",.", ".,")
