"""Lists, pages, access and export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import taxid
from ..functions.dates import day_bounds
from ..functions.text import digits_only, safe_cell
from ..sources.packed import register
from .reports import live


def allowed(rows: DataFrame, permits: DataFrame, user: int, module: str) -> DataFrame:
    """Rows of companies whose module the user may see; `*` is every module."""
    list_of = F.split("modules", ",")
    mine = permits.filter((F.col("user_id") == user) & (F.array_contains(list_of, module) | F.array_contains(list_of, "*")))
    return rows.join(mine.select("company_id"), "company_id", "left_semi")


def laid_out(rows: DataFrame, path: str) -> DataFrame:
    """The rows written in a folder for each company, and read back.

    A join with few companies, as `allowed` makes it, then opens only their folders: Spark prunes by the permits
    that it finds at run time.  Files of a company are split by size, so a large one has many.
    """
    rows.hint("rebalance", "company_id").write.partitionBy("company_id").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def permits_of(permits: DataFrame, users: DataFrame, companies: DataFrame) -> DataFrame:
    """Who may see an active company: permits of users of the company's own tenant."""
    own = companies.filter("active").select("company_id", "tenant_id")
    return permits.join(own, "company_id").join(users, ["user_id", "tenant_id"]).select("company_id", "user_id", "modules", "user_name")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of an order that ends in a unique key."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def shown_date(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def ledger(postings: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The ten columns of the ledger export by moment, deleted postings too; both bounds are moments that count themselves."""
    rows = postings
    if first:
        rows = rows.filter(F.col("moment") >= F.lit(first).cast("timestamp"))
    if last:
        rows = rows.filter(F.col("moment") <= F.lit(last).cast("timestamp"))
    moment = F.concat(F.date_format("moment", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return rows.orderBy(F.col("moment"), "posting_id").select(
        "posting_id", moment.alias("moment"), "text", "history", "dc", "amount", "rule_kind", "code", "bank_id", F.coalesce(F.col("tx_id").cast("string"), F.lit("")).alias("tx_id")
    )


def statement(transactions: DataFrame, banks: DataFrame, first: str | None = None, last: str | None = None, bank: int | None = None, status: str | None = None) -> DataFrame:
    """Live transactions by moment and id, as the list on screen with the same filters: bank account, status, days."""
    label = F.concat_ws(" ", "acronym", "branch", "number", "digit")
    rows = live(transactions)
    if first or last:
        rows = rows.filter(day_bounds(F.col("moment"), first, last))
    if bank is not None:
        rows = rows.filter(F.col("bank_id") == bank)
    if status:
        rows = rows.filter(F.col("status") == status)
    named = rows.join(banks.select("bank_id", label.alias("account")), "bank_id", "left")
    return named.orderBy("moment", "tx_id").select(
        shown_date(F.col("moment")).alias("date"), F.coalesce("account", F.lit("")).alias("account"), "history", "dc", "amount", "status"
    )


#: kind of invoice and the company's part in it, of each export: fixed values
INVOICE_EXPORTS = {"nfe_entrada": ("nfe", "recipient"), "nfe_saida": ("nfe", "issuer"), "nfse_tomado": ("nfse", "recipient"), "nfse_prestado": ("nfse", "issuer")}


def refused_companies(companies: DataFrame) -> DataFrame:
    """Companies whose invoices can't be exported: without a valid tax id none would be found to be theirs."""
    return companies.filter(~taxid.is_valid(F.col("tax_id"))).select("company_id", "tax_id")


def with_transactions(kept: DataFrame, tx: DataFrame) -> DataFrame:
    """Invoices beside the transaction that each is associated with, if any.

    Most have none; by a second key, 0 for the others, those are not all dealt to one task.
    """
    spread = F.when(F.col("tx_id").isNull(), F.xxhash64("invoice_id")).otherwise(0)
    return kept.withColumn("_spread", spread).join(tx.withColumn("_spread", F.lit(0).cast("long")), ["tx_id", "_spread"], "left").drop("_spread")


def invoices(rows: DataFrame, companies: DataFrame, transactions: DataFrame, name: str) -> DataFrame:
    """An invoice export of all companies with a valid tax id: live invoices of a kind that the company issued or
    received, by day of issue, with the transaction that each is associated with."""
    kind, party = INVOICE_EXPORTS[name]
    # grouped, since Spark would infer the check of digits, written out over the company's key, for every row that joins it
    own = companies.groupBy("company_id").agg(F.any_value("tax_id").alias("_tax_id")).filter(taxid.is_valid(F.col("_tax_id")))
    own = own.select("company_id", digits_only(F.col("_tax_id")).alias("_own"))
    kept = live(rows).filter(F.col("kind") == kind).join(own, "company_id")
    kept = kept.filter(digits_only(F.coalesce(party, F.lit(""))) == F.col("_own"))
    tx = transactions.select("tx_id", iso_day(F.col("moment")).alias("tx_day"), F.col("amount").alias("tx_amount"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return with_transactions(kept, tx).orderBy("company_id", "issued", "invoice_id").select(
        "company_id", F.coalesce(iso_day(F.col("issued")), F.lit("")).alias("day"), blank("number"), blank("series"), blank("issuer"),
        blank("issuer_name"), blank("recipient"), "amount", blank("access_key"), blank("status"), blank("tx_day"), "tx_amount",
    )


#: headers of the supplier workbook's ten columns: fixed values
POSITION_HEADERS = {
    "code": "Código", "account": "Conta Contábil", "name": "Fornecedor", "tax_id": "CNPJ", "credits": "Total Compras", "debits": "Total Pagamentos",
    "payable": "Saldo a Pagar", "status": "Status", "pending": "NFs Pendentes", "divergent": "Divergência",
}


def positions(found: DataFrame, suppliers: DataFrame, divergent: DataFrame, pending: DataFrame, which: str = "completo") -> DataFrame:
    """Rows of the supplier workbook, what is payable most first: all, those that are open, or those that diverge.

    `found` are positions, `suppliers` has account and tax_id, `divergent` supplier_id, `pending` supplier_id and
    open purchases, as `fifo` gives them.
    """
    off = divergent.select("supplier_id").distinct().withColumn("_off", F.lit(True))
    left = pending.groupBy("supplier_id").agg(F.count("*").alias("pending"))
    own = suppliers.select("supplier_id", "account", "tax_id")
    rows = found.join(own, "supplier_id", "left").join(off, "supplier_id", "left").join(left, "supplier_id", "left")
    if which == "em_aberto":
        rows = rows.filter("status = 'EM_ABERTO'")
    elif which == "divergencias":
        rows = rows.filter("_off")
    text = lambda c: safe_cell(F.col(c).cast("string"))
    return rows.orderBy(F.desc("payable"), "supplier_id").select(
        text("supplier_id").alias("code"), text("account").alias("account"), text("name").alias("name"), text("tax_id").alias("tax_id"),
        "credits", "debits", "payable", text("status").alias("status"),
        F.coalesce("pending", F.lit(0)).alias("pending"), F.when(F.col("_off"), "Sim").otherwise("Não").alias("divergent"),
    )


def write_workbook(rows: DataFrame, path: str, headers: dict[str, str] | None = None, overwrite: bool = True) -> None:
    """Workbooks of the rows in their order, a file for each partition, committed once; decimals become numbers.

    An export that is one file is `rows.coalesce(1)`.
    """
    register(rows.sparkSession)
    named = rows.withColumnsRenamed({k: v for k, v in (headers or {}).items() if k in rows.columns})
    named.write.format("workbook").mode("overwrite" if overwrite else "append").option("path", path).save()


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header, each beginning with the mark of UTF-8; the mark is part of the first column's name."""
    first, *rest = rows.columns
    rows.withColumnRenamed(first, "\ufeff" + first).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def literal(c: Column, kind: str) -> Column:
    """A value as SQL writes it."""
    if kind == "string":
        text = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind in ("date", "timestamp"):
        text = F.concat(F.lit("'"), c.cast("string"), F.lit("'"))
    elif kind == "boolean":
        text = F.upper(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def inserts(rows: DataFrame, table: str, key: str) -> DataFrame:
    """One INSERT for each row that does nothing where its key is there."""
    names = ", ".join(rows.columns)
    values = F.concat_ws(", ", *[literal(F.col(c), t.partition("(")[0]) for c, t in rows.dtypes])
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(f") ON CONFLICT ({key}) DO NOTHING;")).alias("statement"))


def state(suppliers: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """The stored state of each supplier as JSON texts of its fields: its own row, and each of its entries.

    One row for each supplier and each entry, in an order that can be compared and restored; amounts are texts.
    """
    as_text = lambda df: F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]), {"ignoreNullFields": "false"})
    place = F.row_number().over(W.partitionBy("supplier_id").orderBy(*order))
    heads = suppliers.select("supplier_id", F.lit(0).alias("place"), as_text(suppliers).alias("state"))
    return heads.unionByName(entries.select("supplier_id", place.alias("place"), as_text(entries).alias("state")))


def conference(transactions: DataFrame, invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """The k-th live invoice beside the k-th live receipt of each transaction, one row at least.

    The transaction's own columns, and whether it has both kinds, one or none, stand on its first row only.
    """

    def numbered(df: DataFrame, key: str, *columns) -> DataFrame:
        place = F.row_number().over(W.partitionBy("tx_id").orderBy(key))
        return live(df).filter("tx_id IS NOT NULL").select("tx_id", place.alias("k"), *columns)

    a = numbered(invoices, "invoice_id", F.col("number").alias("invoice"), F.col("kind").alias("invoice_kind"), F.col("amount").alias("invoice_amount"), F.lit(True).alias("_i"))
    b = numbered(receipts, "receipt_id", "payee", F.col("paid").alias("paid"), F.lit(True).alias("_r"))
    zipped = a.join(b, ["tx_id", "k"], "full")
    rows = transactions.select("tx_id", "moment", "history", "dc", "amount", "status").join(zipped, "tx_id", "left")
    rows = rows.withColumn("row_no", F.coalesce("k", F.lit(1)))
    first = F.col("row_no") == 1  # both kinds begin there, so it tells what the transaction has
    both = F.col("_i").cast("int"), F.col("_r").cast("int")
    n = sum(F.coalesce(x, F.lit(0)) for x in both)
    state = F.when(n == 2, "Conciliado").when(n == 1, "Parcial").otherwise("Pendente")
    on_first = {"day": iso_day(F.col("moment")), "history": F.col("history"), "dc": F.col("dc"), "amount": F.col("amount"), "status": F.col("status"), "state": state}
    own = [F.when(first, c).alias(name) for name, c in on_first.items()]
    return rows.orderBy(F.col("moment"), "tx_id", "row_no").select("tx_id", "row_no", *own, "invoice", "invoice_kind", "invoice_amount", "payee", "paid")


def unseen(batch: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key isn't stored yet, one for each key; appending them can be repeated."""
    return batch.dropDuplicates([key]).join(there.select(key), key, "left_anti")


def attachments(rows: DataFrame) -> DataFrame:
    """Bytes and content type of base64 attachments."""
    name = F.lower("name")
    kind = (
        F.when(name.endswith(".pdf"), "application/pdf")
        .when(name.endswith(".png"), "image/png")
        .when(name.rlike(r"\.jpe?g$"), "image/jpeg")
        .otherwise("application/octet-stream")
    )
    return rows.withColumns({"type": kind, "bytes": F.unbase64("content")}).drop("content")


def has_attachment(content: Column) -> Column:
    return F.coalesce(F.length(content) > 0, F.lit(False))
