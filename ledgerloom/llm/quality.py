"""Quality scores from a sparse ensemble of rules over statistics of a text.

Statistics are Spark columns over the whole text.  A random forest of shallow trees is grown on a
bounded sample of labelled rows; the path to each of its nodes is a rule, a conjunction of bounds
on statistics.  A logistic regression with an L1 penalty over the rules leaves weights on few of
them, and those are compiled into one column expression, so that scoring is one projection inside
the JVM, without a shuffle or a Python worker.

Defined results: null and empty texts have all statistics 0 and the score of those; a null id
counts as held out; null labels and labels of null ids aren't learnt from, and of several labels
of an id the lower one holds; without labelled rows, or with labels of one kind only, the score
is the base rate (0 without labels); repeated rows are scored each, and in learning weigh as often
as they stand; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import stored
from .linear import bounded_sample, held_out

#: distinct labelled rows to learn from, at most (about)
SAMPLE = 10_000
TREES = 30
DEPTH = 3
#: weight of the L1 penalty
LASSO = 0.002
THRESHOLD = 0.3
MODULUS, REMAINDER = 5, 0


class Bound(NamedTuple):
    """One end of a rule: the statistic is over `value`, or else at most `value`."""

    name: str
    over: bool
    value: float


Rule = tuple[Bound, ...]


class Model(NamedTuple):
    bias: float
    weights: tuple[tuple[Rule, float], ...]


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)).cast("double")


def _count(kind: str) -> Column:
    """How many characters of a regular expression's class the text holds; all runs of others are cut out at once."""
    return F.length(F.regexp_replace("text", f"[^{kind}]+", "")).cast("long")


def with_statistics(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with a column for each statistic, and these columns' names; words and lines are split once."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns(
        {
            "words": F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "lines": F.filter(F.split("text", r"[\x20\x09]*[\x0A-\x0D][\x20\x09-\x0D]*"), lambda x: x != ""),
            "chars": F.length("text").cast("long"),
            "letters": _count(r"\p{L}"),
        }
    )
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_kinds": F.size(F.array_distinct("words")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
        }
    )
    n_words, n_kinds, n_lines, chars, letters = map(F.col, ("n_words", "n_kinds", "n_lines", "chars", "letters"))
    same_as_next = F.zip_with(
        F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))),
        F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))),
        lambda a, b: (a == b).cast("int"),
    )
    found = {
        "log_chars": F.log1p(chars.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": _share(letters, n_words),
        "longest_word": F.log1p(F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).cast("double")),
        "kinds": _share(n_kinds, n_words),
        "kinds_to_size": F.log1p(n_kinds.cast("double")) / F.greatest(F.log1p(n_words.cast("double")), F.lit(1e-9)),
        "repeats_next": _share(F.aggregate(same_as_next, F.lit(0), lambda a, b: a + b), n_words),
        "short_words": _share(F.size(F.filter("words", lambda w: F.length(w) <= 3)), n_words),
        "letters_share": _share(letters, chars),
        "capitals": _share(_count(r"\p{Lu}"), letters),
        "digits": _share(_count(r"\p{N}"), chars),
        "stops": _share(_count(".,;:"), n_words),
        "shouts": _share(_count("!?"), n_words),
        "marks": _share(F.length(F.regexp_replace("text", r"[\p{L}\p{N}\x20\x09-\x0D.,;:!?'\"()-]+", "")), n_words),
        "line_words": _share(n_words, n_lines),
        "line_kinds": _share(F.size(F.array_distinct("lines")), n_lines),
        "ended_lines": _share(F.size(F.filter("lines", lambda x: F.right(x, F.lit(1)).isin(".", "!", "?", '"', "”"))), n_lines),
    }
    return rows.withColumns(found).drop("words", "lines", "chars", "letters", "n_words", "n_kinds", "n_lines"), list(found)


def labelled(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, remainder: int = REMAINDER, sample: int = SAMPLE) -> DataFrame:
    """A bounded sample of distinct (statistics, label) with the number of their rows as `weight`, ids not held out.

    Ids are sampled before texts are met, so that few enough are left to be broadcast and texts
    aren't shuffled.  What these ids bring is added up, and sampled again, in case an id stands
    for many rows.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out("doc_id", modulus, remainder))
    known = known.groupBy("doc_id").agg(F.least(F.min("quality"), F.lit(1)).cast("double").alias("label"))
    chosen = bounded_sample(known, sample, F.col("doc_id"))
    rows, names = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = stored(rows.groupBy("label", *names).agg(F.count("*").cast("double").alias("weight")))
    return bounded_sample(rows, sample, F.xxhash64(*names))


def paths(node, names: list[str], bounds: tuple[Bound, ...] = ()) -> list[Rule]:
    """The rules that lead to each node under `node` of a tree."""
    if node.subtreeDepth() == 0:
        return []
    name, value, out = names[node.split().featureIndex()], node.split().threshold(), []
    for over, child in ((False, node.leftChild()), (True, node.rightChild())):
        here = (*bounds, Bound(name, over, value))
        out += [tightened(here), *paths(child, names, here)]
    return out


def tightened(bounds: tuple[Bound, ...]) -> Rule:
    """Of bounds on one end of one statistic the tightest, in order of their names; equal rules become equal tuples."""
    best: dict[tuple[str, bool], float] = {}
    for b in bounds:
        end = b.name, b.over
        best[end] = b.value if end not in best else (max if b.over else min)(best[end], b.value)
    return tuple(Bound(*end, value) for end, value in sorted(best.items()))


def holds(rule: Rule) -> Column:
    """Whether the row fits the rule."""
    out = F.lit(True)
    for name, over, value in rule:
        out &= F.col(name) > value if over else F.col(name) <= value
    return out


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Model:
    """A model from rows of (statistics, label, weight), whose number must be bounded.

    They stand in one partition in order of their values, so that every run grows the same trees.
    """
    names = [c for c in sample.columns if c not in ("label", "weight")]
    sums = {r.label: r.weight for r in sample.groupBy("label").agg(F.sum("weight").alias("weight")).collect()}
    good, bad = sums.get(1.0, 0.0), sums.get(0.0, 0.0)
    if not (good and bad):
        rate = good / max(1.0, good + bad)
        return Model(math.log((rate + 1e-9) / (1 - rate + 1e-9)), ())
    rows = stored(sample.coalesce(1).sortWithinPartitions(*names, "label")).coalesce(1)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=11
    ).fit(rows.select("label", "weight", array_to_vector(F.array(*names)).alias("x")))
    rules = sorted({rule for tree in forest.trees for rule in paths(tree._call_java("rootNode"), names)})
    if not rules:
        return Model(math.log(good / bad), ())
    ruled = rows.select("label", "weight", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("x"))
    linear = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=lasso, maxIter=200, tol=1e-7
    ).fit(stored_vectors(ruled))
    kept = [(r, float(w)) for r, w in zip(rules, linear.coefficients.toArray(), strict=True) if w]
    return Model(float(linear.intercept), tuple(kept))


def stored_vectors(rows: DataFrame) -> DataFrame:
    """Rules are evaluated once, not in every round of the regression."""
    return stored(rows).coalesce(1)


def score(model: Model) -> Column:
    """The model as one column over the statistics."""
    logit = F.lit(model.bias)
    for rule, weight in model.weights:
        logit += F.when(holds(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    rows, _ = with_statistics(docs.select("doc_id", "text"))
    return rows.select("doc_id", score(model).alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = scored(docs, fit(labelled(docs, labels)))
    return found.select(
        "doc_id",
        held_out("doc_id", MODULUS, REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
