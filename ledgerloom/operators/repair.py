"""Repairs, entity resolution, feeds and import summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, taxid, text
from ..scratch import stored
from .exports import unseen


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that ends in a unique column."""
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("place = 1").drop("place")


def merged_fragments(rows: DataFrame) -> DataFrame:
    """Fragments of a supplier as one: opening of the first, declared totals of the last."""
    return rows.groupBy("code").agg(
        F.count("*").alias("fragments"), F.min_by("opening", "n").alias("opening"), F.max_by("declared", "n").alias("declared")
    )


def events(entries: DataFrame) -> DataFrame:
    """Purchases and payments as one stream of events."""

    def side(name: str, letter: str) -> DataFrame:
        return entries.filter(F.col(name) > 0).select("supplier_id", "moment", F.lit(letter).alias("side"), F.col(name).alias("amount"))

    return side("credit", "C").unionByName(side("debit", "D"))


def by_unique_name(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Tax ids by plain name, where the name stands for one row on either side only."""

    def once(df: DataFrame) -> DataFrame:
        named = df.withColumn("plain", text.plain_name(F.col("name"))).drop("name")
        alone = named.groupBy("plain").agg(F.count("*").alias("n")).filter("n = 1").select("plain")
        return named.join(alone, "plain")

    return once(rows).join(once(known), "plain").drop("plain")


def tax_id_proposals(companies: DataFrame, seen: DataFrame) -> DataFrame:
    """A tax id for each company with an invalid one whose name files give with valid ones, or why there is none.

    `companies` has company_id, name and tax_id, `seen` name and tax_id.
    """
    good = taxid.is_valid(F.col("tax_id"))
    plain = text.plain_name(F.col("name"))
    found = seen.filter(good & F.col("name").isNotNull()).select(plain.alias("plain"), taxid.masked(F.col("tax_id")).alias("found")).distinct()
    options = found.groupBy("plain").agg(F.count("*").alias("options"), F.min("found").alias("found"))
    named = companies.withColumn("plain", plain)
    namesakes = named.groupBy("plain").agg(F.count("*").alias("namesakes"))
    used = companies.filter(good).select(taxid.masked(F.col("tax_id")).alias("found")).distinct().withColumn("used", F.lit(True))
    rows = named.filter(~good).join(options, "plain").join(namesakes, "plain").join(used, "found", "left")
    reason = (
        F.when(F.col("options") > 1, "several tax ids")
        .when(F.col("namesakes") > 1, "several companies")
        .when(F.col("used"), "in use")
    )
    return rows.select("company_id", F.when(reason.isNull(), F.col("found")).alias("proposed"), reason.alias("reason"))


def fuzzy_matches(rows: DataFrame, known: DataFrame, least: float = 0.75, margin: float = 0.10) -> DataFrame:
    """(id, other_id, score): the best name by Jaccard similarity of words, if it is clearly the best.

    A pair that matters has `least - margin` or more, so it shares one of the rarest words of its smaller set: of n
    words, one of the floor((1 - t) n) + 1 rarest.  Names meet through those only, not through words that most have.
    """
    a = rows.select("id", text.word_set(text.alnum_name(F.col("name"))).alias("a"))
    b = known.select("other_id", text.word_set(text.alnum_name(F.col("name"))).alias("b"))
    words = a.select(F.explode("a").alias("word")).union(b.select(F.explode("b").alias("word"))).groupBy("word").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, key: str, names: str) -> DataFrame:
        each = df.select(key, F.size(names).alias("size"), F.explode(names).alias("word")).join(words, "word")
        place = F.row_number().over(W.partitionBy(key).orderBy("n", "word"))
        kept = F.floor((1 - (least - margin)) * F.col("size") + 1e-9) + 1
        return each.withColumn("place", place).filter(F.col("place") <= kept).select(key, "word")

    pairs = rarest(a, "id", "a").join(rarest(b, "other_id", "b"), "word").select("id", "other_id").distinct()
    scored = pairs.join(a, "id").join(b, "other_id").select("id", "other_id", text.jaccard(F.col("a"), F.col("b")).alias("score"))
    order = W.partitionBy("id").orderBy(F.desc("score"), "other_id")
    ranked = scored.withColumns({"place": F.row_number().over(order), "second": F.lead("score").over(order)})
    # a second best that isn't among the pairs is under least - margin
    clear = (F.col("score") >= least) & (F.coalesce(F.col("score") - F.col("second"), F.lit(1.0)) >= margin)
    return ranked.filter((F.col("place") == 1) & clear).select("id", "other_id", "score")


def company_matches(rows: DataFrame, known: DataFrame, least: float = 0.75, margin: float = 0.10) -> DataFrame:
    """The known company of each row and how it was found: by tax id, by exact name, or by a clearly best name.

    Both have name and tax_id, `rows` an id, `known` an other_id.  A tax id that is given but isn't valid, or that
    several known companies have, blocks the row; one that is found nowhere leaves the known companies without any.
    """
    digits = lambda c: F.when(taxid.is_valid(c), text.digits_only(c))
    given = lambda c: F.coalesce(text.stripped(c.cast("string")) != "", F.lit(False))
    a = rows.select("id", text.alnum_name(F.col("name")).alias("name"), digits(F.col("tax_id")).alias("tax"), given(F.col("tax_id")).alias("given"))
    b = known.select("other_id", text.alnum_name(F.col("name")).alias("name"), digits(F.col("tax_id")).alias("tax"), given(F.col("tax_id")).alias("other_given"))
    a, b = stored(a), stored(b)
    by_tax = b.filter("tax IS NOT NULL").groupBy("tax").agg(F.count("*").alias("n_tax"), F.min("other_id").alias("by_tax"))
    rows = a.join(by_tax, "tax", "left")
    blocked = F.col("given") & (F.col("tax").isNull() | (F.col("n_tax") > 1))
    found = rows.filter(F.col("given") & (F.col("n_tax") == 1)).select("id", F.col("by_tax").alias("other_id"), F.lit("tax id").alias("how"))
    rest = rows.filter(~F.coalesce(blocked, F.lit(False)) & F.col("n_tax").isNull()).select("id", "name", "given")
    # rows with a tax id may only match companies without one: both kinds of company are counted apart
    free = b.filter("NOT other_given")
    for open_rows, candidates in ((rest.filter("given"), free), (rest.filter("NOT given"), b)):
        same = candidates.groupBy("name").agg(F.count("*").alias("n"), F.min("other_id").alias("other_id"))
        named = open_rows.join(same, "name", "left")
        found = found.unionByName(named.filter("n = 1").select("id", "other_id", F.lit("name").alias("how")))
        left = named.filter("n IS NULL").select("id", "name")
        near = fuzzy_matches(left, candidates, least, margin)
        found = found.unionByName(near.select("id", "other_id", F.lit("similar name").alias("how")))
    return found


def invalid_tax_ids(companies: DataFrame) -> DataFrame:
    return companies.filter(~taxid.is_valid(F.col("tax_id"))).select("company_id", "tax_id")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Suppliers whose payable differs by more than a cent; one that is missing counts as 0."""
    both = before.withColumnRenamed("payable", "before").join(after.withColumnRenamed("payable", "after"), "supplier_id", "full")
    zero = F.lit(0).cast("decimal(25,2)")
    return both.filter(F.abs(F.coalesce("before", zero) - F.coalesce("after", zero)) > 0.01)


def mapped_feed(items: DataFrame) -> DataFrame:
    """Items of a bank feed in canonical form: a positive amount is a credit whatever type it has."""
    amount = F.coalesce(F.col("amount"), F.lit(0))
    kind = F.coalesce("type", F.lit("DEBIT"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    rest = [c for c in items.columns if c not in ("amount", "type", "date", "description", "description_raw")]
    return items.select(
        *rest,
        F.to_date(F.left("date", F.lit(10))).alias("day"),
        F.abs(amount).cast("decimal(15,2)").alias("amount"),
        F.when((kind == "CREDIT") | (amount > 0), "C").otherwise("D").alias("dc"),
        F.coalesce(blank("description"), blank("description_raw"), F.lit("Sem descrição")).alias("text"),
    )


def synced(mapped: DataFrame, there: DataFrame, today: str, days: int) -> DataFrame:
    """Transactions of a feed's last days that the company lacks: `mapped` and `there` have company_id, item_id and id.

    Their identity is a hash of company, connection and the feed's own id; of several with one the first by day stays.
    """
    end = F.lit(today).cast("date")
    inside = mapped.filter(F.col("day").between(F.date_sub(end, days), end))
    hashed = lambda df: df.withColumn("hash", hashing.feed_hash(F.col("company_id"), F.col("item_id"), F.col("id")))
    rows = hashed(inside)
    columns = [c for c in rows.columns if c not in ("company_id", "hash")]
    one = rows.groupBy("company_id", "hash").agg(F.min_by(F.struct(*columns), F.struct("day", "id")).alias("x")).select("company_id", "hash", "x.*")
    fresh = one.join(hashed(there).select("company_id", "hash").distinct(), ["company_id", "hash"], "left_anti")
    return fresh.withColumn("text", F.left("text", F.lit(500)))


def sync_states(connections: DataFrame, mapped: DataFrame, fresh: DataFrame, now: str, today: str, days: int) -> DataFrame:
    """Connections after a sync: counts of new and repeated transactions, and when the next one is due."""
    end = F.lit(today).cast("date")
    keys = ["company_id", "item_id"]
    seen = mapped.filter(F.col("day").between(F.date_sub(end, days), end)).groupBy(*keys).agg(F.count("*").alias("seen"))
    new = fresh.groupBy(*keys).agg(F.count("*").alias("imported"))
    at = F.lit(now).cast("timestamp")
    count = lambda c: F.coalesce(c, F.lit(0))
    return connections.join(seen, keys, "left").join(new, keys, "left").select(
        *keys, count("imported").alias("imported"), (count("seen") - count("imported")).alias("duplicates"),
        (count("total_synced") + count("imported")).alias("total_synced"), at.alias("last_sync"), (at + F.expr("INTERVAL 6 HOUR")).alias("next_sync"), F.lit("ativa").alias("status"),
    )


#: characters of a failure's message that are kept: a fixed value
MESSAGE = 500


def failed_syncs(connections: DataFrame, failures: DataFrame) -> DataFrame:
    """Connections whose provider failed, with the beginning of its message; what was synced before stays as it was.

    `failures` has company_id, item_id and message; of several the least counts.
    """
    keys = ["company_id", "item_id"]
    told = failures.groupBy(*keys).agg(F.left(F.min(F.coalesce("message", F.lit(""))), F.lit(MESSAGE)).alias("error"))
    return connections.drop("status", "error").join(told, keys).withColumn("status", F.lit("erro"))


def mock_feed(accounts: DataFrame, first: str, last: str) -> DataFrame:
    """Made transactions of each account: up to three on a weekday and one on others, the same ones on every run."""
    days = accounts.select("account", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))

    def drawn(*parts: Column) -> Column:
        return F.conv(F.left(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit(8)), 16, 10).cast("long")

    most = F.when(F.weekday("day") < 5, 4).otherwise(2)
    rows = days.withColumn("n", (drawn(F.col("account"), F.col("day")) % most).cast("int")).filter("n > 0")
    rows = rows.select("account", "day", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    key = (F.col("account"), F.col("day"), F.col("i"))
    return rows.select(
        "account", "day", F.md5(F.concat(*[c.cast("string") for c in key])).alias("id"),
        F.when(drawn(*key, F.lit("side")) % 100 < 65, "D").otherwise("C").alias("dc"),
        ((5_000 + drawn(*key, F.lit("amount")) % 1_495_001) / F.lit(100).cast("decimal(3,0)")).cast("decimal(15,2)").alias("amount"),
    )


def import_summary(batch: DataFrame, there: DataFrame) -> DataFrame:
    """How many rows a batch has, how many are new, repeat one another or what is stored, or have an error."""
    bad = F.col("error").isNotNull()
    fresh = unseen(batch.filter(~bad), there, "key").agg(F.count("*").alias("imported"))
    total = batch.agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"))
    return total.join(fresh).select("total", "imported", (F.col("total") - F.col("imported") - F.col("errors")).alias("duplicates"), "errors")


def imported(batch: DataFrame, there: DataFrame, path: str) -> DataFrame:
    """The figures of `import_summary`, of a batch whose new rows are appended to the table at `path`.

    They are observed as rows pass by on their way to the table, so the batch is read once.
    """
    bad = F.col("error").isNotNull()
    read, new = Observation(), Observation()
    rows = batch.observe(read, F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("errors"))
    fresh = unseen(rows.filter(~bad), there, "key").observe(new, F.count(F.lit(1)).alias("imported"))
    fresh.write.mode("append").parquet(path)
    total, errors, imported = read.get["total"], read.get["errors"], new.get["imported"]
    return batch.sparkSession.createDataFrame([(total, imported, total - imported - errors, errors)], "total long, imported long, duplicates long, errors long")
