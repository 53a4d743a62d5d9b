"""Goods and service invoices in XML, whatever their namespace."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxid
from ..functions.dates import xml_timestamp
from ..functions.text import digits_only, stripped

# Codes of an authorised goods invoice.
AUTHORISED = ["100", "150"]

RAW = ["kind", "key", "number", "series", "issuer", "issuer_name", "recipient", "recipient_name", "amount", "issued",
       "code", "protocol", "received", "protocol_key", "withheld", "verification"]


def unsafe(content: Column) -> Column:
    """Document types and entities are refused before anything is parsed."""
    return content.rlike(r"(?i)<!DOCTYPE|<!ENTITY")


def _below(element, *names: str):
    """The first element with these local names below one another, at any depth."""
    for name in names:
        element = next((e for e in element.iter() if e.tag.rpartition("}")[2] == name), None) if element is not None else None
    return element


def _text(element, *names: str) -> str | None:
    found = _below(element, *names)
    return (found.text or "").strip() or None if found is not None else None


def _fields(content: str) -> dict:
    """Text of the fields of one document, as they stand; empty if it is none."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return {}
    goods = _below(root, "infNFe")
    if goods is not None:
        at = goods.get("Id", "")
        buyer = _below(goods, "dest")
        return {
            "kind": "nfe", "key": at[3:] if at.startswith("NFe") else None,
            "number": _text(goods, "ide", "nNF"), "series": _text(goods, "ide", "serie"), "issued": _text(goods, "ide", "dhEmi"),
            "issuer": _text(goods, "emit", "CNPJ"), "issuer_name": _text(goods, "emit", "xNome"),
            "recipient": _text(buyer, "CNPJ") or _text(buyer, "CPF"), "recipient_name": _text(buyer, "xNome"),
            "amount": _text(goods, "total", "ICMSTot", "vNF"),
            "code": _text(root, "infProt", "cStat"), "protocol": _text(root, "infProt", "nProt"),
            "received": _text(root, "infProt", "dhRecbto"), "protocol_key": _text(root, "infProt", "chNFe"),
        }
    service = _below(root, "InfNfse")
    if service is None:
        return {}
    values, seller, buyer = _below(root, "Servico", "Valores"), _below(root, "PrestadorServico"), _below(root, "TomadorServico", "IdentificacaoTomador", "CpfCnpj")
    return {
        "kind": "nfse", "number": _text(service, "Numero"), "issued": _text(service, "DataEmissao"),
        "verification": _text(service, "CodigoVerificacao"), "amount": _text(values, "ValorServicos"), "withheld": _text(values, "ValorIss"),
        "issuer": _text(seller, "IdentificacaoPrestador", "Cnpj"), "issuer_name": _text(seller, "RazaoSocial"),
        "recipient": _text(buyer, "Cnpj") or _text(buyer, "Cpf"),
    }


def parsed(files: DataFrame) -> DataFrame:
    """file and the texts of RAW; each document is parsed once, which `xpath` would do once a field."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_fields(x or "") for x in frame["content"]]
            yield pd.DataFrame({"file": frame["file"], **{n: [r.get(n) for r in rows] for n in RAW}})

    return files.select("file", "content").mapInPandas(run, "file string, " + ", ".join(f"{n} string" for n in RAW))


def invoices(files: DataFrame) -> DataFrame:
    """file, fields and error of each document; `files` has file and content."""
    refused = unsafe(F.col("content"))
    safe = files.select("file", F.when(~refused, F.col("content")).alias("content"), refused.alias("refused"))
    rows = parsed(safe.filter("content IS NOT NULL"))
    goods = F.col("kind") == "nfe"
    amount = F.col("amount").try_cast("decimal(15,2)")
    authorised = F.col("code").isin(*AUTHORISED) & F.col("protocol").rlike(r"^\d{15}$")
    no = F.lit(False)
    error = (
        F.when(F.col("kind").isNull(), "unknown document")
        .when(amount.isNull(), "amount")
        .when(goods & ~F.coalesce(authorised, no), "not authorised")
        .when(goods & xml_timestamp(F.col("received")).isNull(), "time of authorisation")
        .when(goods & ~F.coalesce(F.col("key").rlike(r"^\d{44}$"), no), "access key")
        .when(goods & ~F.coalesce(F.col("key") == F.col("protocol_key"), no), "key of protocol")
        .when(F.col("number").isNull(), "number")
        .when(F.col("issuer").isNull(), "issuer")
        .when(xml_timestamp(F.col("issued")).isNull(), "issued")
        .when(~goods & F.col("verification").isNull(), "verification")
    )
    note = F.when(goods, F.concat(F.lit("Destinatário: "), F.col("recipient_name"))).otherwise(F.concat(F.lit("ISS: "), F.col("withheld")))
    found = rows.select(
        "file", "kind", "key", "number", "series", taxid.masked(F.col("issuer")).alias("issuer"), "issuer_name",
        taxid.masked(F.col("recipient")).alias("recipient"), amount.alias("amount"), xml_timestamp(F.col("issued")).alias("issued"),
        note.alias("note"), error.alias("error"),
    )
    nothing = [F.lit(None).cast(t).alias(n) for n, t in found.dtypes if n not in ("file", "error")]
    unread = safe.filter("content IS NULL").select("file", *nothing, F.when(F.col("refused"), "document type").otherwise("unknown document").alias("error"))
    return found.unionByName(unread)


def importable(found: DataFrame, companies: DataFrame) -> DataFrame:
    """Invoices without error that a company issued or received, by company and once for each identity."""
    good = found.filter("error IS NULL")
    parties = F.array_distinct(F.array(digits_only(F.col("issuer")), digits_only(F.col("recipient"))))
    sides = good.select("*", F.explode(parties).alias("_party"))
    own = companies.select("company_id", digits_only(F.col("tax_id")).alias("_party"))
    key = F.when((F.col("kind") == "nfe") & F.col("key").isNotNull(), F.col("key")).otherwise(
        F.concat_ws("|", digits_only(F.col("issuer")), stripped(F.col("number")), stripped(F.coalesce("series", F.lit(""))), F.col("amount").cast("string"), F.col("issued").cast("string"))
    )
    return sides.join(own, "_party").drop("_party").withColumn("_key", key).dropDuplicates(["company_id", "kind", "_key"]).drop("_key")
