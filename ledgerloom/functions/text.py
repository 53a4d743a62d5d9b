"""Text rules.  ASCII semantics: \\s and \\d are those of Java's regular expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and what they become in upper case without them.
ACCENTED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn"

# Patterns that find an invoice number in a ledger text, tried in this order.
INVOICE_PATTERNS = [
    r"NF\.?\s*N[oºº°]?\s*(\d+)",
    r"NF\s+(\d+)",
    r"REF\s+(?:REF\s+)?NF\s+(\d+)",
    r"REF\s+(?:REF\s+)?(\d+)",
    r"CT-E\s*(\d+)",
    r"NOTA\s*FISCAL\s*(\d+)",
    r"CONFORME\s+NF[.\s]*(\d+)",
    r"^(\d{5,6})\s*-",
    r"CONFORME\s+NF\s+N[ÚU]MERO\s+(\d+)",
    r"CONF\.\s*NFS\s*(\d+)",
]

# Key words of a ledger entry's kind.
PAYMENT_WORDS = ["PGTO", "PAGAMENTO", "BAIXA", "VLR REF", "VALOR REF"]
RETURN_WORDS = ["DEVOLUCAO", "ESTORNO"]
PURCHASE_WORDS = [
    "COMPRA", "NF", "NOTA FISCAL", "SERVICO", "SERVIÇO", "CT-E", "ADQUIRIDO", "AQUISICAO", "AQUISIÇÃO", "CONFORME",
]
ADVANCE_WORDS = ["ADTO", "ADIANTAMENTO"]

# Fixed value: an invoice's series.
SERIES = r"(?i)\bS[ÉE]R(?:IE|\.)?\s*(?:N[ºO]\s*)?[:#-]?\s*([A-Z0-9][A-Z0-9./-]*)"

# Bank codes and acronyms.
BANKS = {
    "001": "BB", "033": "SANTANDER", "077": "INTER", "104": "CEF", "237": "BRADESCO", "341": "ITAU", "356": "BMG",
    "389": "MERCANTIL", "422": "SAFRA", "745": "CITIBANK", "756": "SICOOB", "084": "UNIPRIME", "748": "SICREDI", "336": "C6",
    "260": "NU", "290": "PAGSEGURO",
}

# Account kind by the first digit of a legacy code.
KIND_BY_DIGIT = {
    "1": "ativo", "2": "passivo", "3": "patrimonio_liquido", "4": "receita", "5": "despesa", "6": "custo",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, outside generated code, which nested columns outgrow: Java doesn't compile long methods."""
    return F.get(F.transform(F.array(value), use), 0)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def stripped(c: Column) -> Column:
    """Without white space at either end; Spark's trim takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_history(c: Column) -> Column:
    return F.lower(stripped(c))


def plain_name(c: Column) -> Column:
    """Upper case, no accents, single spaces."""
    return stripped(F.regexp_replace(F.upper(F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN)), r"\s+", " "))


def alnum_name(c: Column) -> Column:
    """Upper case; all but A-Z, 0-9 and space become spaces; single spaces."""
    return stripped(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9 ]", " "), r"\s+", " "))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets, 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def invoice_number(history: Column) -> Column:
    """First pattern's number with four digits or more."""
    found = [F.regexp_extract(history, "(?i)" + p, 1) for p in INVOICE_PATTERNS]
    return F.coalesce(*[F.when(F.length(x) >= 4, x) for x in found])


def invoice_series(history: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(history, F.lit("")), SERIES, 1))


def any_word(upper: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | upper.contains(w)
    return out


def operation_kind(history: Column, debit: Column, credit: Column) -> Column:
    h = F.upper(history)
    return (
        F.when(
            debit > 0,
            F.when(any_word(h, PAYMENT_WORDS), "PAGAMENTO").when(any_word(h, RETURN_WORDS), "DEVOLUCAO").otherwise("DEBITO"),
        )
        .when(
            credit > 0,
            F.when(any_word(h, PURCHASE_WORDS), "COMPRA").when(any_word(h, ADVANCE_WORDS), "ADIANTAMENTO").otherwise("CREDITO"),
        )
        .otherwise("OUTRO")
    )


def bank_acronym(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BANKS.items() for x in pair])
    return F.coalesce(table[code], F.upper(stripped(code)))


def kind_by_code(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KIND_BY_DIGIT.items() for x in pair])
    first = F.left(F.try_to_number(F.split(code, r"\.")[0], F.lit("999999999999")).cast("string"), F.lit(1))
    return F.coalesce(table[first], F.lit("despesa"))


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(F.regexp_replace(c, r"^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def level(code: Column) -> Column:
    return F.size(F.split(code, r"\."))


def account_parts(c: Column) -> Column:
    """Bank, branch, number and digit of a text such as `BBC DIGITAL 0001 1858612 5`; null if it has no two numbers.

    The bank's name ends before the first number; where there is none, the last three words are numbers.
    """
    words = F.filter(F.split(stripped(c), r"\s+"), lambda w: w != "")
    first = F.array_position(F.transform(words, lambda w: w.rlike(r"^\d+$")), True)
    at = F.when(first > 1, first - 1).when(F.size(words) >= 4, F.size(words) - 3).cast("int")
    rest = F.slice(words, at + 1, F.size(words))
    return F.when(
        F.size(rest) >= 2,
        F.struct(
            F.array_join(F.slice(words, F.lit(1), at), " ").alias("bank"),
            F.get(rest, 0).alias("branch"),
            F.get(rest, 1).alias("number"),
            F.left(F.get(rest, 2), F.lit(5)).alias("digit"),
        ),
    )


def plain_case(c: Column) -> Column:
    """Lower case with single spaces, as texts are compared without case."""
    return F.lower(stripped(F.regexp_replace(F.replace(c, F.lit("ß"), F.lit("ss")), r"\s+", " ")))
