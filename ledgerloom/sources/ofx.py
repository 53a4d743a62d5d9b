"""OFX statements, in SGML with unclosed tags or in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ofx_timestamp
from ..functions.numbers import ofx_amount
from ..functions.text import let, stripped

CLOSED = r"(?is)<STMTTRN>(.*?)</STMTTRN>"
LAST_END = r"(?is)^.*</STMTTRN>"
UNCLOSED = r"(?is)<STMTTRN>(.*?)(?=<STMTTRN>|</BANKTRANLIST>|$)"


def read(spark: SparkSession, path: str, longest: int = 25 << 20) -> DataFrame:
    """file, content and error of each file; UTF-8, or else Latin-1; one over a size has only an error."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= longest
    content = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(F.col("path").alias("file"), F.when(fits, content).alias("content"), F.when(~fits, "too large").alias("error"))


def tag(name: str) -> Column:
    """A tag's value up to the next tag or line end; null if empty."""
    value = stripped(F.regexp_extract("block", rf"(?i)<{name}>([^<\r\n]*)", 1))
    return let(value, lambda x: F.when(x != "", x))


def is_xml(content: Column) -> Column:
    return F.left(content, F.lit(200)).contains("<?xml")


def transactions(files: DataFrame) -> DataFrame:
    """One row for each transaction block: fields, or the error that it has."""
    text = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), r"\r\n?", "\n")

    def found(text: Column) -> Column:
        # only up to the last end, since each block beyond it would look for one through the rest of the file
        closed = F.regexp_extract_all(F.regexp_extract(text, LAST_END, 0), F.lit(CLOSED), F.lit(1))
        return let(closed, lambda x: F.when(F.size(x) > 0, x).otherwise(F.regexp_extract_all(text, F.lit(UNCLOSED), F.lit(1))))

    blocks = let(text, found)
    rows = files.select("file", is_xml(F.col("content")).alias("xml"), F.posexplode(blocks).alias("n", "block"))
    fields = rows.select(
        "file",
        "xml",
        "n",
        tag("FITID").alias("fitid"),
        tag("DTPOSTED").alias("posted"),
        tag("TRNAMT").alias("raw"),
        F.coalesce(tag("MEMO"), tag("NAME"), F.lit("")).alias("history"),
        F.upper(F.coalesce(tag("TRNTYPE"), F.lit("OTHER"))).alias("kind"),
    )
    parsed = fields.withColumns({"moment": ofx_timestamp(F.col("posted")), "amount": ofx_amount(F.col("raw"))})
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("fitid", "FITID"), ("posted", "DTPOSTED"), ("raw", "TRNAMT"))])
    error = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(F.col("amount").isNull(), "TRNAMT").when(F.col("moment").isNull(), "DTPOSTED")
    dc = F.when(F.col("amount") >= 0, "C").otherwise("D")
    return parsed.select("file", "xml", "n", "fitid", "moment", "amount", dc.alias("dc"), "history", "kind", error.alias("error"))
