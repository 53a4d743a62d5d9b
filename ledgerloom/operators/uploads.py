"""Files that are uploaded, whom they belong to, and identities of rows that were stored before they had one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.text import digits_only


def upload_outcomes(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """What becomes of each upload, by the state of the company's file of the same content.

    `uploads` has company_id and content (binary); `files` company_id, hash, file_id, state and suppliers.  A file
    that is being read with rows already is left alone; one that is done with rows is refused; one that failed, or
    has no rows, is read again.
    """
    rows = uploads.withColumn("hash", F.sha2("content", 256)).drop("content")
    same = files.select("company_id", "hash", "file_id", "state", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))
    has_rows = F.col("suppliers") > 0
    outcome = (
        F.when(F.col("state").isNull(), "new")
        .when((F.col("state") == "PROCESSANDO") & has_rows, "running")
        .when((F.col("state") == "CONCLUIDO") & has_rows, "refused")
        .otherwise("again")
    )
    return rows.join(same, ["company_id", "hash"], "left").withColumn("outcome", outcome).drop("suppliers", "state")


def stuck(files: DataFrame) -> DataFrame:
    """Files after a restart: those that were being read have failed."""
    return files.withColumn("state", F.when(F.col("state") == "PROCESSANDO", "ERRO").otherwise(F.col("state")))


def owners(files: DataFrame, companies: DataFrame) -> DataFrame:
    """file_id and company_id of files whose tax id is that of one company only."""
    known = companies.select("company_id", digits_only(F.col("tax_id")).alias("digits"))
    alone = known.groupBy("digits").agg(F.count("*").alias("n"), F.min("company_id").alias("company_id")).filter("n = 1 AND digits <> ''")
    return files.select("file_id", digits_only(F.coalesce("tax_id", F.lit(""))).alias("digits")).join(alone, "digits").select("file_id", "company_id")


def without_owner(files: DataFrame, companies: DataFrame) -> DataFrame:
    """Files that no company can be found for; while there are any, ownership can't be carried down."""
    return files.select("file_id").join(owners(files, companies), "file_id", "left_anti")


def carried_down(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows with the company of the row that they belong to."""
    return children.join(parents.select(key, "company_id"), key)


def by_either_key(rows: DataFrame, known: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Rows with what is known under their key: by the column `first`, else by `second` (the least `place` of equals).

    A row without either keeps nulls.
    """
    values = [c for c in known.columns if c not in (first, second, "place")]
    packed = F.struct(*values)
    a = known.groupBy(F.col(first).cast("string").alias(key)).agg(F.max_by(packed, "place").alias("_a"))
    b = known.groupBy(F.col(second).cast("string").alias(key)).agg(F.min_by(packed, "place").alias("_b"))
    found = F.coalesce("_a", "_b")
    by = F.when(F.col("_a").isNotNull(), first).when(F.col("_b").isNotNull(), second)
    return rows.join(a, key, "left").join(b, key, "left").select(*rows.columns, *[found[c].alias(c) for c in values], by.alias("by"))


def new_by_hash(batch: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Total, imported and duplicates of a batch by company: of rows with one hash one is imported, unless it is stored."""
    counted = batch.groupBy("company_id", *keys).agg(F.count("*").alias("n"))
    known = there.select("company_id", *keys).distinct().withColumn("known", F.lit(True))
    rows = counted.join(known, ["company_id", *keys], "left")
    fresh = F.count_if(F.col("known").isNull())
    return rows.groupBy("company_id").agg(F.sum("n").alias("total"), fresh.alias("imported"), (F.sum("n") - fresh).alias("duplicates"))


def backfilled(invoices: DataFrame) -> DataFrame:
    """Invoices with the identity that they lack: of a company's equal ones all but the first (by id) are hashed anew,
    and an access key stays with the first that has it."""

    def later(name: str) -> Column:
        return F.col("invoice_id") > F.col(name)

    digits = digits_only(F.coalesce("access_key", F.lit("")))
    rows = invoices.withColumn("key", F.when(F.length(digits) == 44, digits))
    identity = hashing.invoice_identity(
        F.col("kind"), F.coalesce("key", F.lit("")), F.coalesce("issuer", F.lit("")), F.col("number"), F.col("series"), F.col("amount"), F.col("issued")
    )
    rows = rows.withColumn("identity", identity)
    same = rows.groupBy("company_id", "identity").agg(F.min("invoice_id").alias("_first"))
    first_key = rows.filter("key IS NOT NULL").groupBy("company_id", "key").agg(F.min("invoice_id").alias("_first_key"))
    rows = rows.join(same, ["company_id", "identity"]).join(first_key, ["company_id", "key"], "left")
    again = F.sha2(F.concat_ws("|", F.lit("duplicata-legada"), F.col("invoice_id").cast("string"), "identity"), 256)
    return rows.select(
        "invoice_id",
        "company_id",
        F.when(later("_first"), again).otherwise(F.col("identity")).alias("dedup_key"),
        F.when(~later("_first_key"), F.col("key")).alias("access_key"),
    )
