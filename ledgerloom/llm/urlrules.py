"""URL filters as a sort-merge range join, in DataFrame functions only.

A host is written with its labels reversed and a dot after each, `com.example.www.`, so a rule
on a host and its subdomains is the interval of keys that begin with the rule's key: from the
key itself to the key with its last dot replaced by the next character, `/`.  Intervals of
rules are nested or disjoint.  URLs and interval ends are sorted together by key; a running
last value carries the stack of rules that are active at each URL, and the longest of them
whose path begins the URL's path decides.

Rows are dealt to lanes evenly, whatever their host, and every lane sorts its URLs with its own
copy of the interval ends.  So a host that holds a third of all rows is spread over all lanes,
and what is copied is rules times lanes, independent of the number of URLs.

Defined results: a null URL or one without `://` has empty host and path and no rule; ties in
length go to the rule with the longer host; repeated rows are judged each; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import shuffle_width

#: verdict, host, path: fixed values
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT_VERDICT = "allow"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds `host` and `path`; both empty where the URL is null or has no `://`."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", ascii_lower(host)).withColumn("path", path)


def boundaries(rules: DataFrame) -> DataFrame:
    """For each end of an interval the stack of rules that are active from there on.

    Rules meet their ancestors by equality of host suffixes, so no rule is compared with all.
    """
    rules = rules.select(ascii_lower("host").alias("host"), "path", "verdict").distinct()
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        "path",
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    own = rules.groupBy("host").agg(F.collect_list(entry).alias("entries"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    chain = rules.select("host").distinct().select("host", F.explode(suffixes).alias("above"))
    parents = own.withColumnRenamed("host", "above")
    stacks = (
        chain.join(parents, "above")
        .groupBy("host")
        .agg(
            F.flatten(F.collect_list("entries")).alias("from_start"),
            F.flatten(F.collect_list(F.when(F.col("above") != F.col("host"), F.col("entries")))).alias("from_end"),
        )
        .withColumn("key", host_key(F.col("host")))
    )
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    ends = F.array(
        F.struct(F.col("key").alias("key"), F.col("from_start").alias("stack")),
        F.struct(end.alias("key"), F.col("from_end").alias("stack")),
    )
    return stacks.select(F.inline(ends))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, lanes: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`."""
    lanes = lanes or shuffle_width(pages.sparkSession)
    ends = boundaries(rules)
    none = F.lit(None)
    urls = (
        with_parts(pages.select("page_id", "url"))
        .withColumn("key", host_key(F.col("host")))
        .select(
            F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).alias("lane"),
            "key",
            F.lit(1).alias("is_url"),
            "page_id",
            "host",
            "path",
            none.cast(dict(ends.dtypes)["stack"]).alias("stack"),
        )
    )
    marks = ends.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"),
        "key",
        F.lit(0).alias("is_url"),
        none.cast(dict(urls.dtypes)["page_id"]).alias("page_id"),
        none.cast("string").alias("host"),
        none.cast("string").alias("path"),
        "stack",
    )
    sweep = W.partitionBy("lane").orderBy("key", "is_url").rowsBetween(W.unboundedPreceding, 0)
    swept = urls.unionByName(marks).withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)
    return swept.filter("is_url = 1").select(
        "page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")
    )
