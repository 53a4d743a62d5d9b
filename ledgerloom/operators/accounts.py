"""Chart of accounts: tree, import checks, guards and legacy codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import level, stripped
from ..scratch import stored
from . import validation

DEEPEST = 5


#: levels of a tree whose codes are put together before they meet the path above them
LEVELS = 32


def tree(rows: DataFrame) -> DataFrame:
    """code, path, depth and error of each account, from the roots (no parent) down, however deep they go.

    What no root leads to, as accounts that are their own ancestors or have an unknown parent, has an error instead.
    """
    rows = stored(rows.select("code", "parent"))
    plain = rows.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1 OR code IS NULL").isEmpty()
    found = forest(rows) if plain else all_paths(rows)
    none = F.lit(None)
    lost = rows.filter("parent IS NOT NULL").select("code").distinct().join(found.select("code"), "code", "left_anti")
    return found.unionByName(lost.select("code", none.cast("string").alias("path"), none.cast("int").alias("depth"), F.lit("no root").alias("error")))


def all_paths(rows: DataFrame) -> DataFrame:
    """Every path from a root, level by level, where a code may stand under several parents."""
    spark = rows.sparkSession
    for most in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(most, "-1")  # an account isn't met again on its own path, so recursion ends
    return spark.sql(
        """WITH RECURSIVE below(code, path, depth) AS (
            SELECT code, array(code), 1 FROM {rows} WHERE parent IS NULL
            UNION ALL
            SELECT r.code, array_append(b.path, r.code), b.depth + 1 FROM below b JOIN {rows} r ON r.parent = b.code WHERE NOT array_contains(b.path, r.code))
        SELECT code, array_join(path, '>') AS path, depth, CAST(NULL AS STRING) AS error FROM below""",
        rows=rows,
    )


def climbed(state: DataFrame, **columns: Column) -> DataFrame:
    """Accounts that still look up to another (`up`) take over what that one has: its `up`, and `columns` of both.

    So each step doubles how far an account has looked.  `columns` see the account above under the name `o`.
    """
    above = state.select([F.col(c).alias(f"_{c}") for c in state.columns])
    step = state.filter("up IS NOT NULL").join(above, F.col("up") == F.col("_code"))
    moved = step.select("code", F.col("_up").alias("up"), *[c.alias(n) for n, c in columns.items()])
    return stored(state.filter("up IS NULL").unionByName(moved))


def forest(rows: DataFrame) -> DataFrame:
    """Paths where each code has one parent, in as many steps as doubling needs.

    First depths alone climb to the roots.  Then the codes of LEVELS levels are put together, the path above each such
    range is put together from whole ranges, and both meet once.  So long paths are made where they are returned;
    what is written before is one path in LEVELS of them.
    """
    state = stored(rows.select("code", F.col("parent").alias("up"), F.lit(1).alias("depth")))
    before, done = -1, state.filter("up IS NULL").count()
    while done > before:  # no account ends at this distance, so none does beyond: what is left has no root
        state = climbed(state, depth=F.col("depth") + F.col("_depth"))
        before, done = done, state.filter("up IS NULL").count()
    depths = state.filter("up IS NULL").select("code", "depth")
    first = (F.col("depth") - 1) % LEVELS == 0
    joined = F.concat_ws(">", "_path", "path")
    parts = rows.join(depths, "code").select(
        "code", F.when(~first, F.col("parent")).alias("up"), F.col("code").alias("path"), "depth", F.when(first, F.col("parent")).alias("base")
    )
    parts = stored(parts)
    for _ in range((LEVELS - 1).bit_length()):
        parts = climbed(parts, path=joined, depth=F.col("depth"), base=F.col("_base"))
    ranges = stored(parts.filter(F.col("depth") % LEVELS == 0).select("code", F.col("base").alias("up"), "path"))
    while not ranges.filter("up IS NOT NULL").isEmpty():
        ranges = climbed(ranges, path=joined)
    above = ranges.select(F.col("code").alias("base"), F.col("path").alias("_path"))
    return parts.join(above, "base", "left").select("code", joined.alias("path"), "depth", F.lit(None).cast("string").alias("error"))


def ancestors(code: Column) -> Column:
    """All proper prefixes of a dotted code, shortest first."""
    parts = F.split(code, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def missing_ancestors(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """The shortest ancestor that neither the table nor the import holds, of each code that lacks one."""
    codes = there.select("code").union(wanted.select("code")).distinct().withColumnRenamed("code", "above")
    each = wanted.filter(F.col("code").contains(".")).select("code", F.posexplode(ancestors(F.col("code"))).alias("k", "above"))
    return each.join(codes, "above", "left_anti").groupBy("code").agg(F.min_by("above", "k").alias("missing"))


def imported(rows: DataFrame, there: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """What becomes of each line of companies' charts, and the parent of each account that is imported.

    `rows` has company_id, line, code, label, kind and kind_sa as texts, `there` company_id and code of live accounts.
    Of good lines with one code the first counts.  An ancestor may be in the table or anywhere in the same import,
    even in a line that is refused itself.
    """
    plain = rows.withColumns(
        {
            "code": stripped(F.coalesce("code", F.lit(""))),
            "label": stripped(F.coalesce("label", F.lit(""))),
            "kind": F.coalesce(F.nullif(F.lower(stripped(F.col("kind"))), F.lit("")), F.lit("despesa")),
            "kind_sa": F.coalesce(F.nullif(F.upper(stripped(F.col("kind_sa"))), F.lit("")), F.lit("A")),
        }
    )
    wrong = F.when(F.col("code") == "", "no code").when(F.col("label") == "", "no label").otherwise(F.get(validation.account(), 0))
    plain = plain.withColumn("wrong", wrong)
    good = plain.filter("wrong IS NULL")
    first = good.groupBy("company_id", "code").agg(F.min("line").alias("first"))
    known = there.select("company_id", "code").distinct()
    codes = known.union(first.select("company_id", "code")).distinct().withColumnRenamed("code", "above")
    each = first.filter(F.col("code").contains(".")).select("company_id", "code", F.posexplode(ancestors(F.col("code"))).alias("k", "above"))
    missing = each.join(codes, ["company_id", "above"], "left_anti").groupBy("company_id", "code").agg(F.min_by("above", "k").alias("missing"))
    keys = ["company_id", "code"]
    joined = plain.join(first, keys, "left").join(known.withColumn("known", F.lit(True)), keys, "left").join(missing, keys, "left")
    outcome = (
        F.when(F.col("wrong").isNotNull(), F.col("wrong"))
        .when((F.col("line") > F.col("first")) | F.col("known"), "duplicate")
        .when(level(F.col("code")) > deepest, "level")
        .when(F.col("missing").isNotNull(), F.concat(F.lit("parent "), "missing"))
        .otherwise("imported")
    )
    parent = F.when((outcome == "imported") & F.col("code").contains("."), F.regexp_replace("code", r"\.[^.]*$", ""))
    return joined.select("company_id", "line", "code", "label", "kind", "kind_sa", outcome.alias("outcome"), parent.alias("parent"))


def account_number(c: Column) -> Column:
    """An account's number as an import gives it: a whole number, or null where it is none."""
    text = F.regexp_replace(stripped(c.cast("string")), r"(?<=\d)_(?=\d)", "")
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))


def numbered(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Imported accounts with the number that their line has: company_id, code and number; `rows` has company_id, line and number."""
    own = rows.select("company_id", "line", account_number(F.col("number")).alias("number"))
    return found.filter("outcome = 'imported'").join(own, ["company_id", "line"]).select("company_id", "code", "number")


def after_import(found: DataFrame, there: DataFrame) -> DataFrame:
    """company_id, code, parent and kind_sa of a chart after an import; accounts that get children become `S`.

    `there` has these columns too.
    """
    new = found.filter("outcome = 'imported'").select("company_id", "code", "parent", "kind_sa")
    parents = new.filter("parent IS NOT NULL").select("company_id", F.col("parent").alias("code")).distinct().withColumn("_has", F.lit(True))
    rows = there.select(*new.columns).unionByName(new).join(parents, ["company_id", "code"], "left")
    return rows.withColumn("kind_sa", F.when(F.col("_has"), "S").otherwise(F.col("kind_sa"))).drop("_has")


def guards(accounts: DataFrame, postings: DataFrame, rules: DataFrame, card_entries: DataFrame) -> DataFrame:
    """What keeps an account of a company from being removed: live children, active rules, or movement, of cards too.

    All have company_id; `accounts` has parent, the others code.
    """
    keys = ["company_id", "code"]
    held = {
        "children": accounts.filter("NOT deleted AND parent IS NOT NULL").select("company_id", F.col("parent").alias("code")),
        "ruled": rules.filter("active").select(*keys),
        "moved": postings.select(*keys).union(card_entries.select(*keys)),
    }
    rows = accounts.filter("NOT deleted").select(*keys)
    for name, found in held.items():
        rows = rows.join(found.distinct().withColumn(name, F.lit(True)), keys, "left")
    return rows.select(*keys, *[F.coalesce(n, F.lit(False)).alias(n) for n in held])


def without_collisions(rows: DataFrame) -> DataFrame:
    """A class that stands for several accounts gives way to their numbers."""
    many = rows.groupBy("class").agg(F.count("*").alias("n"))
    return rows.join(many, "class").select("label", F.when(F.col("n") > 1, F.col("number")).otherwise(F.col("class")).alias("code"))


def predominant_side(postings: DataFrame) -> DataFrame:
    credit, debit = F.count_if(F.col("dc") == "C"), F.count_if(F.col("dc") == "D")
    return postings.groupBy("code").agg(F.when(credit > debit, "C").otherwise("D").alias("side"))


