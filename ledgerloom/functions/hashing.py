"""Identities by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_only, stripped


def statement_hash(company: Column, bank: Column, fitid: Column) -> Column:
    """SHA-256 of the sorted-key JSON of a statement line's identity; fields must be ASCII without quotes."""
    text = F.concat(
        F.lit('{"agencia_id": "'), bank.cast("string"),
        F.lit('", "empresa_id": "'), company.cast("string"),
        F.lit('", "fitid": "'), fitid, F.lit('"}'),
    )
    return F.sha2(text, 256)


def feed_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("string") for p in parts]), 256)


def invoice_identity(kind: Column, key: Column, issuer: Column, number: Column, series: Column, amount: Column, issued: Column) -> Column:
    """By access key for a goods invoice that has one, else by issuer, number, series, amount and time."""
    at = F.concat(F.date_format(issued, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    tail = [digits_only(issuer), stripped(number), stripped(F.coalesce(series, F.lit(""))), amount.cast("decimal(15,2)").cast("string"), at]
    text = (
        F.when((kind == "nfe") & F.coalesce(key != "", F.lit(False)), F.concat(F.lit("nfe|"), digits_only(key)))
        .when(kind == "nfe", F.concat_ws("|", F.lit("nfe-sem-chave"), *tail))
        .otherwise(F.concat_ws("|", F.lit("nfse"), *tail))
    )
    return F.sha2(text, 256)


def uuid_of(text: Column) -> Column:
    """An md5 written as a UUID."""
    return F.regexp_replace(F.md5(text), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def ledger_code(bank_id: Column) -> Column:
    return F.concat(F.lit("1.1.B."), F.left(F.replace(bank_id, F.lit("-"), F.lit("")), F.lit(16)))


def number_text(amount: Column) -> Column:
    """A decimal as a float is written: without zeros at its end, but one digit after the point at least."""
    text = amount.cast("decimal(15,2)").cast("string")
    return F.regexp_replace(text, r"0$", "")


def statement_fitid(date: Column, history: Column, amount: Column, index: Column) -> Column:
    """PDF and twelve hex digits of an md5 over time, text, amount and line number."""
    raw = F.concat(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"), history, number_text(amount), index.cast("string"))
    return F.concat(F.lit("PDF"), F.upper(F.left(F.md5(raw), F.lit(12))))


def purchase_identity(given: Column, day: Column, plain: Column, amount: Column) -> Column:
    """A purchase's own id if its row has one, else a hash of its time in UTC, its text without case, and its amount."""
    at = F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    own = F.concat(F.lit("externo:"), F.nullif(given, F.lit("")))
    return F.sha2(F.coalesce(own, F.concat_ws("|", at, plain, amount.cast("decimal(15,2)").cast("string"))), 256)


def name_uuid(space: Column, name: Column) -> Column:
    """UUID of version 5 of a name in the space of another UUID."""
    hashed = F.sha1(F.concat(F.unhex(F.replace(space, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(hashed, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(hashed, 1, 8), F.lit("-"), F.substring(hashed, 9, 4), F.lit("-5"), F.substring(hashed, 14, 3), F.lit("-"),
        variant, F.substring(hashed, 18, 3), F.lit("-"), F.substring(hashed, 21, 12),
    )
