"""Quality rules, vector codes and conversation repair against plain versions, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import codes, dialogue, quality

# ---- quality


def written(rng, good):
    words = [f"w{i}ab" for i in range(400)]
    if good:
        return " ".join(rng.choices(words, k=rng.randint(8, 60))).capitalize() + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + "$$$" for w in rng.choices(words, k=30))
    if kind == 1:
        return " ".join([rng.choice(words)] * 40)
    return " ".join(w.upper() + "!!" for w in rng.choices(words, k=20))


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(21)
    rows, labels = [(None, "a b"), (-1, None), (-2, ""), (-3, "word$$$ " * 30_000)], [(-1, None), (None, 1), (5, 0)]
    for i in range(900):
        good = i == 5 or rng.random() < 0.7
        rows.append((i, written(rng, good)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([(i, t, 0.5, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, words double, label string")
    return docs, spark.createDataFrame([(i, y, "z") for i, y in labels], "doc_id long, quality int, text string"), rows, labels


def test_quality(graded):
    docs, labels, rows, known = graded
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == len(rows) and got[None].held_out
    truth = {i: y for i, y in known if i is not None and i >= 0 and i != 5}
    right = [got[i].predicted == y for i, y in truth.items() if got[i].held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    for i in truth:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3)
    assert got[-1].score == got[-2].score and got[-3].predicted == 0
    assert quality.report(docs.limit(0), labels).count() == 0
    assert max(r.score for r in quality.report(docs, labels.limit(0)).collect()) < 1e-6
    one_kind = {round(r.score, 6) for r in quality.report(docs, labels.filter("quality = 1")).collect()}
    assert one_kind == {1.0}


def test_rules_are_paths_and_weights_are_optimal(graded):
    """The compiled column equals the rules replayed in Python; the lasso's conditions hold for its weights."""
    docs, labels, _, _ = graded
    sample = quality.labelled(docs, labels)
    model = quality.fit(sample, trees=6)
    names = [c for c in sample.columns if c not in ("label", "weight")]
    rows = sample.withColumn("score", quality.score(model)).collect()
    assert 0 < len(model.weights) < 80

    def fits(rule, r):
        return all((r[n] > v) if over else (r[n] <= v) for n, over, v in rule)

    for r in rows:
        logit = model.bias + sum(w for rule, w in model.weights if fits(rule, r))
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-12)
    for rule, _ in model.weights:
        ends = [(n, over) for n, over, _ in rule]
        assert 1 <= len(ends) <= 2 * quality.DEPTH and ends == sorted(set(ends)) and {n for n, _ in ends} <= set(names)
    weight = np.array([r.weight for r in rows])
    slack = np.array([(r.label - r.score) * r.weight for r in rows]) / weight.sum()
    assert abs(slack.sum()) < 1e-4
    for rule, w in model.weights:
        x = np.array([float(fits(rule, r)) for r in rows])
        mean = (x * weight).sum() / weight.sum()
        spread = math.sqrt(((x - mean) ** 2 * weight).sum() / (weight.sum() - 1))
        assert (x * slack).sum() / spread == pytest.approx(math.copysign(quality.LASSO, w), rel=0.05, abs=1e-4)


def test_repeated_ids_stay_within_the_sample(spark):
    """One id with many texts brings no more rows than the sample's bound; equal rows are weighed."""
    docs = spark.createDataFrame([(1, f"{'x' * (i % 50 + 1)} {i}.") for i in range(2000)] + [(2, "same row")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    ids = [i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5]
    assert ids == [1, 2]
    rows = quality.labelled(docs, labels, sample=60).collect()
    assert len(rows) < 120 and all(r.weight == 500 for r in rows if r.label == 0)


def test_statistics(spark):
    frame, names = quality.with_statistics(spark.createDataFrame([("Ab c, c c!\n x1 \r\n\n Ab c, c c!",), (None,)], "text string"))
    first, none = frame.select(*names).collect()
    words = "Ab c, c c! x1 Ab c, c c!".split()
    assert first.kinds == len(set(words)) / 9 and first.repeats_next == 0 and first.line_kinds == 2 / 3
    assert first.digits == 1 / len("Ab c, c c!\n x1 \r\n\n Ab c, c c!") and first.capitals == 2 / 11 and first.marks == 0
    assert first.ended_lines == 2 / 3 and first.short_words == 1 and first.shouts == 2 / 9
    assert set(none) == {0.0}


# ---- vector codes


def plain_codes(rows):
    """Nearest entries by an int64 table of all distances."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    width = -(-max((len(r[1]) for r in rows), default=0) // 8)
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[max(-codes.LIMIT, min(codes.LIMIT, math.floor(4096 * v))) for v in r[1]] + [0] * (8 * width - len(r[1])) for r in rows], np.int64)
    x = x.reshape(len(rows), 8, width)
    book = x[:16].copy()

    def assigned():
        d = ((x[:, None] - book[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(6):
        near, _ = assigned()
        for p, k in itertools.product(range(8), range(len(book))):
            own = x[near[:, p] == k, p]
            if len(own):
                book[k, p] = own.sum(axis=0) // len(own)
    near, gap = assigned()
    sha = hashlib.sha256(",".join(map(str, book.transpose(1, 0, 2).ravel().tolist())).encode()).hexdigest()
    total = collections.Counter()
    for r, g in zip(rows, gap, strict=True):
        total[r[2]] += int(g.sum())
    return sorted((str(r[0]), bytes(n.astype(np.uint8)).hex(), int(g.sum()), total[r[2]], sha) for r, n, g in zip(rows, near, gap, strict=True))


def vectors(spark, rows):
    full = [(*r, 1, "c", 0) for r in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, error long, code string, lane int")


def got_codes(frame):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.report(frame).collect())


def float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


def test_vector_codes(spark):
    rng = random.Random(31)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([None, 1, 1, 1, 2])) for i in range(300)]
    rows += [(i, rows[i - 300][1], 1) for i in range(300, 340)] + [rows[7]] * 30  # ties and repeated rows
    rows += [(400, None, 1), (401, [None] * 16, 1), (402, [math.nan] + [0.0] * 15, 1), (403, [math.inf] * 16, 2), (404, [-math.inf] * 16, 2)]
    rows += [(405, [1.0] * 5, 1), (406, [], 2), (None, [0.5] * 16, None), (-5, [3e38] * 16, 1), (-4, [-3e38] * 16, 1)]
    rows = float32(rows)
    assert got_codes(vectors(spark, rows)) == plain_codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], 1)], [(3, [1.0, 2.0], 1)] * 3, [(i, [float(i)] * 8, i) for i in range(5)]])
def test_few_vectors(spark, rows):
    assert got_codes(vectors(spark, rows)) == plain_codes(rows)


def test_intervals_hold_the_exact_value_and_screen(spark):
    """The nearest entry always stays; far ones mostly go; entries that float32 can't tell apart are told apart."""
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 14), 1 << 14, (4000, 8))
    book = rng.integers(-(1 << 14), 1 << 14, (16, 8))
    exact = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    stays = codes.screened(x, book)
    assert stays[np.arange(len(x)), exact.argmin(axis=1)].all() and stays.sum() < 1.05 * len(x)
    near = np.array([[1 << 22] * 8, [(1 << 22) + 1] + [1 << 22] * 7, [1 << 22] * 8])
    code, gap = codes.nearest(near, near)
    assert code.tolist() == [0, 1, 0] and gap.tolist() == [0, 0, 0]
    assert codes.screened(near, near).sum() > 3


# ---- conversations


def plain_repair(rows):
    """All states with whole audit strings and texts, row by row."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = by[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, said = [], set()
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in said else "truncated" if end[-1] not in ".!?" else "")
            said.add((role, text))
        paths = {"": (0, "", ())}  # role initials so far, of which the first and last count
        for (_, role, text), fault in zip(own, faults, strict=True):
            new = {}
            for state, (cost, audit, turns) in paths.items():
                for n in range(4):
                    ways = [(state, cost, audit, turns)]
                    for _ in range(n):
                        ways = [(*grown(s, r), c + 3, a + "I", (*t, f"{r}:")) for s, c, a, t in ways for r in ("user", "assistant") if grown(s, r)]
                    for s, c, a, t in ways:
                        options = [(s, c + 4, a + "D", t)]
                        if fault not in ("blank", "duplicate"):
                            more = 3 * (fault == "truncated")
                            options += [(*grown(s, r), c + 3 + more, a + "R", (*t, f"{r}:{text}")) for r in ("user", "assistant") if grown(s, r)]
                            options += [(*grown(s, role), c + more, a + "K", (*t, f"{role}:{text}"))] if grown(s, role) else []
                        for key, *found in options:
                            new[key] = min(new.get(key, tuple(found)), tuple(found))
            paths = new
        ends = []
        for state, (cost, audit, turns) in paths.items():
            if state in ("", "a"):
                ends.append((cost, audit, turns))
            if state == "u":
                ends.append((cost + 3, audit + "I", (*turns, "assistant:")))
            if state == "s":
                ends.append((cost + 6, audit + "II", (*turns, "user:", "assistant:")))
        cost, audit, turns = min(ends)
        dated = [t for t, _, _ in own if t is not None]
        out[conv] = (
            max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own[:-1], own[1:], strict=True)),
            cost,
            audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest(),
        )
    return out


def grown(state, role):
    """The state after a turn of a role, in a tuple; none if it may not follow."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, role[:1]))
    return (after,) if after else ()


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, cost long, audit string, segment int")


def got_repair(frame):
    rows = dialogue.report(frame).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    out = {r.conv_id: tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


def talk(rng, conv, n):
    out = []
    for t in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
        text = rng.choice(["Yes.", "No?", "so", "Well, then!", "", " \n", f"Turn {t}.", f"turn {t} \t"])
        out.append((conv, t, role, text))
    return out


@pytest.mark.parametrize("span", [256, 3])
def test_conversation_repair(spark, monkeypatch, span):
    monkeypatch.setattr(dialogue, "SPAN", span)
    monkeypatch.setattr(dialogue, "CHUNK", 40)
    rng = random.Random(41)
    rows = [r for c in range(150) for r in talk(rng, c, rng.randint(1, 14))]
    rows += [(None, t, r, x) for t, r, x in ((None, "user", "a."), (None, None, None), (3, "system", "b"), (3, "user", "a."), (-7, "assistant", "é" * 50_000))]
    rows += [(200, 5, "user", "Same.")] * 40 + [(201, None, "user", "Same.")] * 3 + [(202, 1 << 62, "user", "x."), (202, -(1 << 62), "assistant", "y.")]
    rows += talk(rng, 300, 700)
    assert got_repair(conversations(spark, rows)) == plain_repair(rows)


def test_conversations_that_lose_all_rows(spark):
    gone = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}
    assert len(gone) > 5 and got_repair(conversations(spark, gone)) == want
    assert got_repair(conversations(spark, gone).limit(0)) == {}


def test_codes_of_macro_edits_are_free_of_prefixes():
    found = {m[3] for kind in itertools.product("sua t", (False, True), (False, True)) for m in dialogue.macros(*kind)}
    assert not [(a, b) for a, b in itertools.permutations(found, 2) if b.startswith(a)]


def test_long_conversations_are_cut_into_segments(spark):
    rows = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(3000)], "conv_id long, turn long, role string, text string")
    found = dialogue.segments(dialogue.faults(dialogue.damaged(rows)))
    assert found.agg(F.max("turns")).first()[0] <= dialogue.SPAN and found.count() == -(-3000 // dialogue.SPAN)


# ---- rounds of earlier operators: bounded samples, and what is dropped before a shuffle


def test_samples_are_bounded_by_rows_however_ids_repeat(spark):
    """One id on thousands of rows, with one text or with many, brings no more rows than the sample has."""
    from ledgerloom.llm import langid, linear, toxicity

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], "same text here", "en")] * 3000 + [(ids[1], f"text {i}", "en") for i in range(3000)] + [(i, f"plain {i}", "de") for i in ids[2:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(k % 2)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(docs, labels, sample=40).count() <= 90
    known = docs.filter("lang IS NOT NULL")
    held = linear.distinct_sample(linear.bounded_sample(known, 40, F.col("doc_id"), F.col("lang")), 40, F.col("lang"))
    assert held.groupBy("lang").count().agg(F.max("count")).first()[0] <= 90
    assert langid.fit(docs, sample=40)


def test_fit_equals_a_dense_solver():
    """Weights of the toxicity model are those of a plain Newton iteration on the same loss, to 1e-6."""
    from ledgerloom.llm.linear import Presence, logistic

    rng = np.random.default_rng(5)
    dense = (rng.random((200, 8)) < 0.3).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(dense @ rng.normal(0, 2, 8) - 0.5)))).astype(float)
    half = rng.normal(0, 0.3, (8, 8))
    penalty, ridge = half @ half.T, 1e-2
    x = Presence(np.nonzero(dense)[1], dense.sum(axis=1).astype(int), 8)
    w, bias = logistic(x, y, ridge, penalty, rounds=20_000)
    full, v = np.hstack([dense, np.ones((200, 1))]), np.zeros(9)
    curve = np.zeros((9, 9))
    curve[:8, :8] = 2 * penalty + ridge * np.eye(8)
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ v))
        v -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) / 200 + curve, full.T @ (p - y) / 200 + curve @ v)
    assert np.abs(np.append(w, bias) - v).max() < 1e-6


def test_votes_equal_a_plain_loop():
    """Winners by pairs, ties by the sum of margins, and the score of the closest pair."""
    from ledgerloom.llm import langid

    rng = np.random.default_rng(6)
    classes = ["a", "b", "c", "d"]
    machines = [(a, b, rng.normal(size=5).astype(np.float32), float(rng.normal())) for a, b in itertools.combinations(range(4), 2)]
    x = rng.normal(size=(50, 5)).astype(np.float32)
    best, sure = langid.vote((classes, machines), x)
    for row, got, score in zip(x, best, sure, strict=True):
        wins, total, margin = [0] * 4, [0.0] * 4, {}
        for a, b, w, bias in machines:
            m = float(row @ w + bias)
            wins[a if m > 0 else b] += 1
            total[a] += m
            total[b] -= m
            margin[a, b], margin[b, a] = m, -m
        want = max(range(4), key=lambda c: (wins[c], total[c]))
        assert got == want
        closest = min(margin[want, o] for o in range(4) if o != want)
        assert score == pytest.approx(1 / (1 + math.exp(-4 * closest)), rel=1e-4)


def test_balls_are_left_behind_before_vectors_move(spark):
    """On clustered vectors most rows never meet a block of queries; the results are those of brute force."""
    from ledgerloom.llm import topk

    rng = np.random.default_rng(7)
    centres = rng.normal(0, 100, (40, 6))
    v = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(0, 1, (2000, 6)))
    # queries lie in a few clusters
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    met = []
    plain = topk.candidates

    def counted(left, chosen):
        out = plain(left, chosen)
        met.append((left.count(), chosen.select("query_block").distinct().count(), out.count()))
        return out

    topk.candidates = counted
    try:
        got = {}
        for r in topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5, block=8).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    finally:
        topk.candidates = plain
    ((n, blocks, out),) = met
    assert n == 2000 and blocks > 2 and out < 0.5 * n * blocks
    for q in range(0, 2000, 50):
        score = (v @ v[q]).astype(np.int64)
        order = [i for i in sorted(range(2000), key=lambda i: (-score[i], i)) if i != q][:5]
        assert sorted(got[q]) == [(k, i, score[i]) for k, i in enumerate(order, 1)]
