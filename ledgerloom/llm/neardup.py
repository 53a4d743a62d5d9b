"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped edges.

1. Each text becomes the set of its shingles' 64-bit hashes.  One permutation deals them to BINS
   bins, of which each keeps its least; empty bins borrow by optimal densification, where a bin
   probes others in an order of its own until it finds a full one.
2. Equal sets are one node from here on, so a group of copies costs one row.
3. Bins are banded; each band's hash is a bucket key.  In a bucket only pairs of a centre and a
   member are candidates, so pairs grow with members, not with their square.  The centre is the
   member that meets most others in all its buckets, such as the text that copies were made from.
4. Candidates are confirmed on full sets, and confirmed links give components.  Each node is first
   held against its most central centre; these links point upwards, so they are a forest, which
   pointer doubling resolves.  Other centres are asked only about nodes still apart from them.
5. A centre may miss links between other members.  Where a bucket still holds several components,
   the members outside its largest one meet all others: directly in buckets of a few members, and
   in larger ones where the two share a shingle among the rarest fifth of each, which every pair
   at the threshold does.  A pair meets at its first common key alone, and only if what follows
   there in both sets can still make the similarity.  So no link between two that share a bucket
   is lost, nothing is capped, and texts that only hold a common passage do not meet.

At 128 bins in 32 bands of 4 a pair at similarity 0.8 shares no bucket with probability 5e-8.

Defined results: null texts and texts without words have no shingles and are linked with nothing;
texts with fewer words than a shingle are one shingle; rows that repeat a doc_id are linked with
each other; a null doc_id is linked with nothing and kept; ties go to the smallest doc_id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, byte_texts, chunks, int64, lists_of, mix, sequence_hash, stored

SHINGLE = 4
THRESHOLD = 0.8
BINS = 128
BAND_ROWS = 4
#: members of a bucket up to which those outside its largest component meet all others
SMALL = 16
#: first keys of a node that its rows carry, so that a pair is known to meet at its first common one
HEAD = 32


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts)
    grams = words.grams(size)
    out = []
    for t in range(words.n_texts):
        a, b = words.first[t], words.first[t + 1]
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(np.array([sequence_hash(words.hash[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of bins for each non-empty set."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    edges = np.arange(bins, dtype=np.uint64) << shift
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        s = np.sort(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        at = np.searchsorted(s, edges)
        ok = at < len(s)
        found = s[np.minimum(at, len(s) - 1)]
        ok &= (found >> shift) == np.arange(bins, dtype=np.uint64)
        out[i], full[i] = found, ok
    source = np.broadcast_to(np.arange(bins), full.shape).copy()
    missing = ~full
    attempt = 0
    while missing.any():
        attempt += 1
        probe = (mix(np.arange(bins, dtype=np.uint64) + np.uint64(attempt * 1_000_003)) >> shift).astype(np.int64)
        hit = missing & full[:, probe]
        source = np.where(hit, probe, source)
        missing &= ~hit
    return np.take_along_axis(out, source, axis=1)


def band_keys(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    n, bins = signatures.shape
    bands = signatures.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), (n, bins // rows)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and band keys of every row."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in chunks(byte_texts(b.column(1))):
                sets = shingle_sets(texts, size)
                some = [s for s in sets if len(s)]
                bands = band_keys(signature(some))
                counts = np.array([bands.shape[1] if len(s) else 0 for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(start, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        lists_of(int64(bands).reshape(-1), counts, pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return rows.mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, set_key binary, bands array<long>"
    )


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set_key and shingle hashes of every row with words."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in chunks(byte_texts(b.column(1))):
                sets = shingle_sets(texts, size)
                some = pa.array([len(s) > 0 for s in sets], pa.bool_())
                sets_column = lists_of(int64(np.concatenate(sets)), np.array([len(s) for s in sets]), pa.int64())
                keys = pa.array([set_key(s) for s in sets], pa.binary())
                batch = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, len(texts)), keys, sets_column], ["node", "set_key", "shingles"]
                )
                yield batch.filter(some)

    return rows.mapInArrow(run, f"node {dict(rows.dtypes)['doc_id']}, set_key binary, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); the component is its least node.

    Each round every node takes the least label among its own and its neighbours', then the label of
    its label.  Labels are written between rounds, so joins with a node of many edges can be split.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("component").alias("near"))
        lower = stored(
            labels.join(near.withColumnRenamed("b", "node"), "node").select(
                "node", "component", F.least("component", "near").alias("label")
            )
        )
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = stored(lower.join(above, "label").select("node", F.col("top").alias("component"), (F.col("top") < F.col("component")).alias("moved")))
        labels = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return labels


def forest(pointers: DataFrame) -> DataFrame:
    """(node, component) from pointers (node, c) without cycles, one a node; the component is its least node."""
    up = stored(pointers.select("node", F.col("c").alias("root")))
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(
            up.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        up = new.select("node", "root")
        if new.filter("moved").isEmpty():
            break
    least = stored(up.groupBy("root").agg(F.min("node").alias("low")).select("root", F.least("root", "low").alias("component")))
    return stored(up.join(least, "root").select("node", "component").union(least.select("root", "component")))


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, x, y) of the pairs whose components x and y differ."""
    left = parts.select(F.col("node").alias("a"), F.col("component").alias("x"))
    right = parts.select(F.col("node").alias("b"), F.col("component").alias("y"))
    labelled = pairs.join(left, "a", "left").join(right, "b", "left")
    return labelled.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; each component so far counts as one node of theirs."""
    edges = stored(apart(links, parts).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if edges.isEmpty():
        return parts
    tops = components(edges)
    new = tops.join(parts.select("node").distinct(), "node", "left_anti")
    known = parts.select("node", "component").union(new.select("node", F.col("node").alias("component")))
    tops = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return stored(known.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def fetched(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, each distinct set once."""
    ids = stored(wanted.withColumnRenamed("node", "doc_id"))
    sets = full_sets(docs.join(ids, "doc_id", "left_semi"), size)
    return stored(sets.dropDuplicates(["node", "set_key"]).drop("set_key"))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows with pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    percent = round(threshold * 100)
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select(*pairs.columns, F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("both"))
        .filter(f"100 * both >= {percent} * (nx + ny - both)")
        .select(*pairs.columns)
        .distinct()
    )


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def with_missing(sets: DataFrame, wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """`sets` and those that are wanted beyond them."""
    missing = stored(wanted.join(sets.select("node").distinct(), "node", "left_anti"))
    return sets if missing.isEmpty() else sets.union(fetched(docs, missing, size))


def split_buckets(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are in several components, with `component` and the largest one as `main`."""
    state = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    state = stored(state)
    held = state.groupBy("bucket", "component").agg(F.count("*").alias("own"))
    main = held.groupBy("bucket").agg(F.max_by("component", "own").alias("main"), F.count("*").alias("parts"))
    return state.join(stored(main.filter("parts > 1").select("bucket", "main")), "bucket")


def rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, n, pos, head): the rarest shingles of each set, as many as similar sets must share one of.

    Two sets of at least the similarity share one of the first n - ceil(share n) + 1 shingles of each,
    in any one order of all shingles.  Rarest first, what many texts hold in common stays out of it.
    `pos` is a shingle's place in that order; those that no other set holds are left out.
    """
    n = F.size("shingles")
    each = sets.select("node", n.alias("n"), F.explode("shingles").alias("bucket"))
    count = stored(each.groupBy("bucket").agg(F.count("*").alias("count")))
    ranked = each.join(count, "bucket").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "bucket"))).alias("order"))
    first = F.slice("order", F.lit(1), F.expr(f"n - int(ceil({percent} * n / 100.0)) + 1"))
    placed = F.transform(first, lambda x, i: F.struct(x["bucket"].alias("bucket"), i.alias("pos"), x["count"].alias("count")))
    met = F.filter(placed, lambda x: x["count"] > 1)
    rows = ranked.select("node", "n", met.alias("met"))
    return rows.select("node", "n", F.slice("met.bucket", 1, HEAD).alias("head"), F.inline("met")).select("bucket", "node", "n", "pos", "head")


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that meet in a bucket, each at its first common key.

    `rows` has bucket, node, n, pos, head, component and main.  Keys stand in one order in all heads.
    Where heads share a key, the first one is the pair's first of all: what stands before it in
    either set is not in the other, so at most what is left from there on is common.
    """
    outside = rows.filter("component <> main").select(
        "bucket", *(F.col(c).alias(f"{c}_c") for c in ("node", "n", "pos", "head", "component"))
    )
    first = F.try_element_at(F.array_intersect("head", "head_c"), F.lit(1))
    most = F.when(first.isNull(), F.least("n", "n_c")).otherwise(F.least(F.col("n") - F.col("pos"), F.col("n_c") - F.col("pos_c")))
    met = rows.join(outside, "bucket").filter("component <> component_c")
    met = met.filter(F.coalesce(first, F.col("bucket")) == F.col("bucket"))
    met = met.filter(100 * most >= percent * (F.col("n") + F.col("n_c") - most))
    return met.select(F.least("node", "node_c").alias("a"), F.greatest("node", "node_c").alias("b")).distinct()


def linked(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their set's key; nodes by set key; and the component of each node that has links.

    A node is the least doc_id of those that share a set.
    """
    docs = docs.select("doc_id", "text")
    percent = round(threshold * 100)
    rows = stored(sketches(docs, size))
    nodes = stored(
        rows.filter("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.min("bands").alias("bands"))
    )
    in_bands = nodes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = stored(in_bands.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1"))
    members = stored(in_bands.join(shared, "bucket"))
    # a doc_id that stands for several sets ties their nodes together
    named = rows.filter("set_key is not null and doc_id is not null")
    repeated = stored(
        named.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low <> high").select("doc_id")
    )
    tied = named.join(repeated, "doc_id").join(nodes.select("set_key", "node"), "set_key").filter("doc_id <> node")
    links = [] if repeated.isEmpty() else [stored(tied.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct())]
    central = stored(members.groupBy("node").agg(F.sum("held").alias("weight")))
    order = F.shiftleft("weight", 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    ordered = members.join(central, "node").select("bucket", "node", "n", order.alias("order"))
    centres = stored(
        ordered.groupBy("bucket").agg(
            F.max_by("node", "order").alias("c"), F.max_by("n", "order").alias("n_centre"), F.max("order").alias("top")
        )
    )
    near = f"100 * least(n, n_centre) >= {percent} * greatest(n, n_centre)"
    stars = stored(
        ordered.join(centres, "bucket").filter("node <> c").filter(near).groupBy("node", "c").agg(F.max("order").alias("order"), F.max("top").alias("top"))
    )
    pair = [F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")]
    # upwards only: a centre of the same order is above if its id is smaller
    upwards = stars.filter("top > `order` or (top = `order` and c < node)")
    highest = stored(upwards.groupBy("node").agg(F.max_by("c", "top").alias("c")))
    first = stored(stars.select(*pair).distinct())
    sets = fetched(docs, ends(first), size)
    held = confirmed(highest.select(*pair, "node", "c"), sets, threshold)
    parts = forest(held)
    rest = apart(first, parts).select("a", "b").join(highest.select(*pair).distinct(), ["a", "b"], "left_anti")
    links.append(stored(confirmed(stored(rest), sets, threshold)))
    parts = merged(parts, reduce(DataFrame.union, (x.select("a", "b") for x in links)))
    mixed = stored(split_buckets(members, parts).select("bucket", "held", "node", "n"))
    small = mixed.filter(F.col("held") <= SMALL).join(nodes.select("node", F.col("bands").alias("head")), "node")
    small = small.select("bucket", "node", "n", F.lit(0).alias("pos"), "head")
    large = stored(mixed.filter(F.col("held") > SMALL).select("node").distinct())
    sets = with_missing(sets, large, docs, size)
    keys = stored(small.unionByName(rare_keys(sets.join(large, "node"), percent)))
    second = stored(meetings(stored(split_buckets(keys, parts)), percent).join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        sets = with_missing(sets, ends(second), docs, size)
        parts = merged(parts, stored(confirmed(second, sets, threshold)))
    return rows, nodes.select("set_key", "node"), parts


def classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, nodes, parts = linked(docs, size, threshold)
    table = stored(
        nodes.join(parts, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    )
    joined = rows.select("doc_id", "n_shingles", "set_key").join(table, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that links tie to a smaller doc_id.

    Of rows that repeat a doc_id the one with the least text stays.
    """
    found = stored(classes(docs, size, threshold))
    dropped = stored(found.filter("not kept").select("doc_id").distinct())
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = stored(again.join(dropped, "doc_id", "left_anti"))
    kept = docs.join(dropped, "doc_id", "left_anti")
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")
    )
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))
