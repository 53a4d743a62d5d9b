"""Rules that rows must meet before they are stored, as lists of the fields that break them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import digits_only, stripped

# Domains of fields.
ACCOUNT_KINDS = ["ativo", "passivo", "patrimonio_liquido", "receita", "despesa", "custo", "resultado"]
CARD_BRANDS = ["visa", "mastercard", "elo", "amex", "hipercard", "outros"]
INVOICE_KINDS = ["nfe", "nfse"]
RULE_KINDS = ["automatica", "manual"]
CODE = r"^\d+(\.\d+)*$"


def broken(rules: dict[str, Column]) -> Column:
    """Names of the fields whose rule doesn't hold, in order; null breaks a rule."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def sized(c: Column, least: int, most: int) -> Column:
    return F.length(c).between(least, most)


def optional(c: Column, ok: Column) -> Column:
    return c.isNull() | ok


def one_of(c: Column, names: list[str]) -> Column:
    return F.lower(stripped(c)).isin(*names)


def invoice() -> Column:
    c = F.col
    fourteen = lambda x: F.length(digits_only(x)) == 14
    return broken({
        "kind": one_of(c("kind"), INVOICE_KINDS),
        "number": sized(c("number"), 1, 50),
        "series": optional(c("series"), F.length("series") <= 10),
        "issuer": fourteen(c("issuer")),
        "issuer_name": optional(c("issuer_name"), F.length("issuer_name") <= 300),
        "recipient": optional(c("recipient"), fourteen(c("recipient"))),
        "amount": c("amount") > 0,
        "issued": c("issued").isNotNull(),
        "access_key": optional(c("access_key"), F.length(digits_only(c("access_key"))) == 44),
    })


def card() -> Column:
    c = F.col
    return broken({
        "label": sized(c("label"), 2, 200),
        "brand": one_of(c("brand"), CARD_BRANDS),
        "last_digits": optional(c("last_digits"), stripped(c("last_digits")).rlike(r"^\d{4}$")),
        "closing_day": c("closing_day").between(1, 28),
        "due_day": c("due_day").between(1, 28),
        "limit": optional(c("limit"), c("limit") >= 0),
    })


def account() -> Column:
    c = F.col
    return broken({
        "code": sized(stripped(c("code")), 1, 30) & stripped(c("code")).rlike(CODE),
        "label": sized(stripped(c("label")), 2, 300),
        "kind": one_of(c("kind"), ACCOUNT_KINDS),
        "kind_sa": F.upper(stripped(c("kind_sa"))).isin("S", "A"),
    })


def bank_account() -> Column:
    c = F.col
    return broken({
        "acronym": sized(stripped(c("acronym")), 2, 20),
        "branch": stripped(c("branch")).rlike(r"^\d{1,10}$"),
        "number": stripped(c("number")).rlike(r"^[\w-]{1,20}$"),
        "digit": optional(c("digit"), F.length(stripped(c("digit"))) <= 5),
    })


def rule() -> Column:
    c = F.col
    return broken({
        "description": sized(stripped(c("description")), 2, 500),
        "text": sized(stripped(c("text")), 2, 500),
        "dc": F.upper(stripped(c("dc"))).isin("D", "C"),
        "kind": one_of(c("kind"), RULE_KINDS),
    })
