"""Near-dedup, repeated passages and decontamination against brute force."""

import hashlib
import random
import re

import pytest

from ledgerloom.llm import decontam, neardup, repeats


def tokens(text):
    return (text or "").encode().lower().split()


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
    return text


def shingles(text, size=4):
    w = tokens(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


def brute_classes(rows, size=4):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t, size)) for i, t in rows]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((i, len(x), root(i), root(i) == i) for i, x in sets)


def test_near_duplicates(docs):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "two  words\n", "a b c", "a b c d e f g h", "a b c d e f g h i"]
    base = words(rng, 60)
    texts += [" ".join(base)] * 20  # copies
    texts += [" ".join(edited(rng, base, 1)) for _ in range(20)]
    chain = words(rng, 80)
    for _ in range(15):  # each is near the one before, the first and last are far apart
        chain = edited(rng, chain, 1)
        texts.append(" ".join(chain))
    common = words(rng, 50)
    texts += [" ".join(common + words(rng, 40, 5000)) for _ in range(15)]  # a passage that many share
    texts += [" ".join(words(rng, rng.randint(1, 12), 6)) for _ in range(60)]
    texts += ["long " + " ".join(words(rng, 30_000, 9000))] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(map(tuple, neardup.classes(docs(rows)).collect()))
    assert got == brute_classes(rows)


def test_near_duplicate_edge_cases(docs):
    assert neardup.classes(docs([])).count() == 0
    text = "one two three four five six"
    rows = [(1, text), (1, text), (1, "quite another text of some words"), (None, text), (5, text), (7, "quite another text of some words")]
    got = sorted(map(str, map(tuple, neardup.classes(docs(rows)).collect())))
    assert got == sorted(map(str, [(1, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (None, 3, None, True), (5, 3, 1, False), (7, 3, 1, False)]))
    kept = neardup.deduplicate(docs(rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (None, text)], key=str)
    assert kept.columns == docs(rows).columns


def test_star_rounds_find_links_that_a_centre_misses(docs):
    """Members of one bucket that are near each other but not near its centre."""
    rng = random.Random(6)
    base = words(rng, 100, 10**6)
    far = edited(rng, base, 4)
    rows = list(enumerate(" ".join(x) for x in [base, far, *(edited(rng, far, 1) for _ in range(30))]))
    assert sorted(map(tuple, neardup.classes(docs(rows)).collect())) == brute_classes(rows)


def brute_repeats(rows, least=50):
    seen = {}
    for n, (_, t) in enumerate(rows):
        w = tokens(t)
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(n)
    out = []
    for d, t in rows:
        w, spans = tokens(t), []
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        if spans:
            out.append((d, len(spans), sum(e - s for s, e in spans), ",".join(f"{s}:{e}" for s, e in spans)))
    return sorted(out, key=str)


def test_repeated_passages(docs):
    rng = random.Random(7)
    passages = [words(rng, n, 10**6) for n in (49, 50, 51, 75, 120)]
    texts = [None, "", "short text", " ".join(words(rng, 20_000, 10**6))]
    for p in passages:
        for _ in range(rng.randint(2, 5)):
            texts.append(" ".join(words(rng, rng.randint(0, 80), 10**6) + p + words(rng, rng.randint(0, 80), 10**6)))
    texts += [" ".join(passages[3] + passages[4])] * 3 + [" ".join(words(rng, 60, 10**6))] * 2
    alone = words(rng, 55, 10**6)
    texts.append(" ".join(alone + ["x"] + alone))  # repeats within one text alone don't count
    rows = list(enumerate(texts)) + [(None, " ".join(passages[2]))]
    got = sorted(map(tuple, repeats.report(docs(rows)).collect()), key=str)
    assert got == brute_repeats(rows)
    assert repeats.report(docs([])).count() == 0


def parts(text):
    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute_hits(rows, items, size=10):
    out = []
    for d, t in rows:
        w, hit, found = parts(t), set(), set()
        for i, x in items:
            x = parts(x)
            for a in range(max(1, len(x) - size + 1)) if x else ():
                win = x[a : a + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(i))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, docs):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, n, 50))) for i, n in enumerate((0, 1, 3, 9, 10, 11, 30, 30))]
    items += [(9, None), (10, "the the the the the the the the the the the"), (11, items[6][1]), (12, "É Ünï-côdé x")]
    texts = [None, "", "...", "THE, the; the the the the the the the the the the the the", "é ünï côdé X", "a É ünï-CôDé. x b"]
    for i in range(40):
        cut = rng.choice(items[3:8])[1].split()
        a = rng.randrange(max(1, len(cut) - 9))
        texts.append(" ".join(words(rng, 15, 5000) + cut[a : a + rng.randint(5, 20)] + words(rng, 15, 5000)))
    rows = [*enumerate(texts), (None, items[7][1]), (3, items[7][1]), (8, texts[8])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, word int")
    for some in (items, items[4:]):
        frame = bench.filter(f"item_id >= {some[0][0]}")
        got = sorted(map(tuple, decontam.report(docs(rows), frame).collect()), key=str)
        assert got == brute_hits(rows, some)
        kept = decontam.clean(docs(rows), frame)
        assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted(
            ((d, t) for d, t in rows if not brute_hits([(d, t)], some)[0][5]), key=str
        )
    assert not any(r.contaminated for r in decontam.report(docs(rows), bench.limit(0)).collect())
    assert decontam.report(docs([]), bench).count() == 0


def test_proximity(docs):
    rows = [(1, "a x b"), (2, "a x x x b"), (3, None), (4, "b a"), (5, "a a")]
    assert sorted(map(tuple, decontam.proximity(docs(rows), "a", "b", 2).collect())) == [(1, 0, 2), (4, 0, 1)]
    assert sorted(map(tuple, decontam.proximity(docs(rows), "a", "a", 2).collect())) == [(5, 0, 1)]
    rng = random.Random(8)
    many = [(i, " ".join(rng.choices("abc", k=rng.randrange(40)))) for i in range(30)] + [(99, "a a b"), (98, "a b b")]
    for first, second, within in (("a", "b", 2), ("a", "b", 5), ("a", "a", 3)):
        want = []
        for i, t in many:
            w = t.split()
            want += [(i, p, q) for p in range(len(w)) for q in range(p + 1, len(w)) if q - p <= within and sorted((w[p], w[q])) == sorted((first, second))]
        assert sorted(map(tuple, decontam.proximity(docs(many), first, second, within).collect())) == sorted(want)


def test_sorted_neighbours(spark):
    """Keys that two texts hold, over many partitions and small batches, with a key that most rows have."""
    rng = random.Random(14)
    texts = [hashlib.md5(str(i).encode()).digest() for i in range(30)]
    rows = [(rng.choice([7, 7, rng.randrange(60)]), bytearray(rng.choice(texts[:5])), i) for i in range(400)]
    rows += [(1000 + i, bytearray(texts[i % 3]), j) for i in range(40) for j in range(12)]  # one text's own
    held = {}
    for k, t, _ in rows:
        held.setdefault(k, set()).add(bytes(t))
    want = sorted((k, bytes(t), p) for k, t, p in rows if len(held[k]) > 1)
    frame = spark.createDataFrame(rows, "key long, text_key binary, place int")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for partitions, batch in ((1, 10_000), (13, 10_000), (13, 7), (40, 1)):
            for c, v in zip(before, (partitions, batch, "false"), strict=True):
                spark.conf.set(c, str(v))
            got = sorted((r.key, bytes(r.text_key), r.place) for r in repeats.in_two_texts(frame).collect())
            assert got == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert repeats.in_two_texts(frame.limit(0)).count() == 0


@pytest.mark.parametrize("small, head", [(1, 32), (3, 1), (16, 32), (1000, 2)])
def test_no_link_depends_on_how_full_a_bucket_is(docs, monkeypatch, small, head):
    """Chains and hubs in buckets on both sides of the sizes at which the way of meeting changes."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "HEAD", head)
    rng, rows = random.Random(17), []
    for size in (2, 15, 16, 17, 40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for k in range(size):
            if k % 3:  # a chain, whose far ends are unlike
                words = list(words)
                words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
        hub = list(words)
        for _ in range(size):  # spokes about the threshold from their hub
            spoke = list(hub)
            for i in rng.sample(range(80), 2):
                spoke[i] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(spoke)))
    assert sorted(map(tuple, neardup.classes(docs(rows)).collect())) == brute_classes(rows)
