"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

Words are runs of letters and digits (and any character beyond ASCII), A-Z lower-cased.  A
window is `size` consecutive words of an item, or the whole item if it has fewer.

1. Corpus frequency of every benchmark word: one pass that counts.
2. For each window the rarest words become its anchors; the postings of anchor words, (document,
   position), are stored for the whole corpus.
3. Postings are shifted by the anchor's offset in the window and the lists of one window's
   anchors are intersected on (document, start); the survivors are proved word by word against
   the document.

What is moved is postings of rare words, not the text, and no window meets a document that does
not hold its rarest word.  Benchmark tables are written first, so that Spark knows their size and
broadcasts them only below its threshold; above it the same joins shuffle.

Defined results: null texts and ids are kept (no words, nothing hit; a null id is a document of
its own text); repeated rows get equal results; items without words have no windows; empty tables
give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import stored
from .urlrules import ascii_lower

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
ANCHORS = 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window_id, item_ids and words of every distinct window."""
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return (
        items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words"))
        .filter(n > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
        .select(F.xxhash64("words").alias("window_id"), "item_ids", "words")
    )


def tokens(docs: DataFrame) -> DataFrame:
    """Every word of every document with its position."""
    return docs.select("doc_key", F.posexplode(words(F.col("text"))).alias("pos", "word"))


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Corpus count of each term."""
    return (
        docs.select(F.explode(words(F.col("text"))).alias("word"))
        .join(terms, "word")
        .groupBy("word")
        .count()
    )


def doc_key() -> Column:
    """A 128-bit key of id and text, so that null and repeated ids need no care."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", doc_key().alias("doc_key"))


def anchors_of(wins: DataFrame, counts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """The rarest words of each window, at most `anchors` of them, with their offsets.

    Words that the corpus lacks count 0, so their windows have postings nowhere.
    """
    terms = (
        wins.select("window_id", F.posexplode("words").alias("offset", "word"))
        .groupBy("window_id", "word")
        .agg(F.min("offset").alias("offset"))
        .join(counts, "word", "left")
    )
    order = W.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "offset")
    ranked = terms.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= anchors)
    return ranked.withColumn("needed", F.count("*").over(W.partitionBy("window_id"))).select(
        "word", "window_id", "offset", F.expr("shiftleft(1, place - 1)").alias("bit"), "needed"
    )


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """doc_key, start, len and item_ids of every place where a window occurs.  `docs` is keyed."""
    wins = stored(windows(items, size))
    terms = stored(wins.select(F.explode("words").alias("word")).distinct())
    counts = stored(frequencies(docs, terms))
    chosen = stored(anchors_of(wins, counts, anchors))
    heads = stored(chosen.groupBy("word").agg(F.collect_list(F.struct("window_id", "offset", "bit", "needed")).alias("uses")))
    postings = tokens(docs).join(heads, "word")
    shifted = postings.select("doc_key", "pos", F.inline("uses")).select(
        "doc_key", "window_id", (F.col("pos") - F.col("offset")).alias("start"), "needed", "bit"
    )
    met = (
        shifted.filter("start >= 0")
        .groupBy("doc_key", "window_id", "start", "needed")
        .agg(F.bit_or("bit").alias("met"))
        .filter("met = shiftleft(1, needed) - 1")
        .select("doc_key", "window_id", "start")
    )
    candidates = stored(met.join(wins, "window_id"))
    by_doc = candidates.groupBy("doc_key").agg(
        F.collect_list(F.struct("start", "words", "item_ids")).alias("candidates")
    )
    proved = (
        docs.join(by_doc, "doc_key")
        .select("doc_key", words(F.col("text")).alias("own"), "candidates")
        .select(
            "doc_key",
            F.filter(
                "candidates", lambda c: F.slice(F.col("own"), c["start"] + 1, F.size(c["words"])) == c["words"]
            ).alias("found"),
        )
        .filter(F.size("found") > 0)
    )
    return proved.select("doc_key", F.inline("found")).select(
        "doc_key", "start", F.size("words").alias("len"), "item_ids"
    ).distinct()


def covered(spans: Column) -> Column:
    """Number of positions in the union of sorted (start, len) spans."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], (s["start"] + s["len"]).cast("long")).alias("end"),
        ),
    )
    return step["n"]


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """For every document the number of words, of hit words and of items, and the items' digest."""
    rows = keyed(docs.select("doc_id", "text"))
    found = occurrences(rows, items, size)
    hits = found.groupBy("doc_key").agg(
        covered(F.sort_array(F.collect_set(F.struct("start", "len")))).alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"),
    )
    hits = stored(hits)
    items_text = F.array_join(F.sort_array(F.coalesce("items", F.array().cast("array<string>"))), ",")
    return (
        rows.select("doc_id", "doc_key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
        .join(hits, "doc_key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(items_text, 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs."""
    name = "__found"
    while name in map(str.lower, docs.columns):  # a name that the documents lack
        name += "_"
    found = stored(occurrences(keyed(docs), items, size).select(F.col("doc_key").alias(name)).distinct())
    return docs.join(found, doc_key() == F.col(name), "left_anti")


def proximity(docs: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """doc_id, pos and next_pos of all places where two words stand at most `within` words apart, from the index.

    Postings of a document are cut into stretches of `within` + 1 words, and those of the second word also stand in
    the stretches beside their own: so each pair meets once, and a list is never compared with all of another.
    """
    rows = keyed(docs)
    lists = tokens(rows).filter(F.col("word").isin(first, second))
    stretch = F.floor(F.col("pos") / (within + 1))
    a = lists.filter(F.col("word") == first).select("doc_key", "pos", stretch.alias("stretch"))
    b = lists.filter(F.col("word") == second).select("doc_key", F.col("pos").alias("other"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    near = a.join(b, ["doc_key", "stretch"]).filter(F.abs(F.col("pos") - F.col("other")) <= within)
    near = near.filter("pos < other") if first == second else near
    near = near.select("doc_key", F.least("pos", "other").alias("pos"), F.greatest("pos", "other").alias("next_pos"))
    return rows.select("doc_id", "doc_key").distinct().join(near, "doc_key").select("doc_id", "pos", "next_pos")
