"""Classifiers by held-out accuracy, language-model scores by brute force and normalisation, the pipeline."""

import collections
import math
import random
import zlib

import numpy as np

import corpus_pipeline
from ledgerloom.llm import langid, lm, neardup, secrets, toxicity


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_toxicity(spark, docs):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [(None, "idiot"), (-1, None), (-2, ""), (-3, "idiot " * 30_000)], [(-1, None), (None, 1)]
    for i in range(800):
        text = rng.choices(plain, k=30)
        bad = rng.random() < 0.2
        for _ in range(2 if bad else 0):
            text[rng.randrange(30)] = rng.choice(["idiot", "scumbag", "morons"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame([(i, 1, t, "x") for i, t in labels], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.report(docs(rows), frame).collect()}
    assert len(got) == len(rows) and got[None].held_out
    right = [got[i].predicted == y for i, y in labels if y is not None and i is not None and got[i].held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert all(got[i].held_out == (crc(i, 4) == 2) and 0 <= got[i].score <= 1 for i in got if i is not None)
    assert got[-1].score == got[-2].score < 0.3 <= got[-3].score
    assert toxicity.report(docs([]), frame.limit(0)).count() == 0
    assert {r.predicted for r in toxicity.report(docs(rows), frame.limit(0)).collect()} == {0}


def test_counterfactuals_calm_group_names(spark):
    """A group that is named in toxic texts only still doesn't make neutral mentions toxic."""
    rng = random.Random(10)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(1200):
        text, bad = rng.choices(plain, k=12), rng.random() < 0.4
        if bad:
            text[0] = rng.choice(["idiot", "scum"]) if rng.random() < 0.7 else text[0]
            text[1] = "muslims"
        elif rng.random() < 0.3:
            text[1] = "christians"
        rows.append((" ".join(text), int(bad)))
    frame = spark.createDataFrame(rows, "text string, label int")
    neutral = ["muslims w1 w2", "christians w1 w2"]
    loose = toxicity.predict(toxicity.fit(frame, weight=0.0), neutral)
    held = toxicity.predict(toxicity.fit(frame, weight=3.0), neutral)
    assert abs(held[0] - held[1]) < 0.5 * abs(loose[0] - loose[1]) and held[0] < loose[0]
    assert toxicity.counterfactuals("Women, w1 men.", [["women", "men"]]) == ["women, w1 women.", "men, w1 men."]


def test_language_id(docs, spark):
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "wh"], "de": ["sch", "ung", "ei"], "fr": ["eau", "ou", "que"], "es": ["ción", "ll", "os"], "xx": ["zq", "kx", "vj"]}
    rows = [(None, "the", "en"), (-1, None, "en"), (-2, "123 ½ ² ...", "fr"), (-4, "1 é", None), (-3, "eau que " * 40_000, None)]
    for i in range(500):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(3, 30))), lang))
    frame = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.report(frame).collect()}
    assert len(got) == len(rows) and got[-1].lang_pred == got[-2].lang_pred == "und" and got[-3].lang_pred == "fr"
    right = [got[i].lang_pred == lang for i, _, lang in rows[5:] if got[i].held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert all(got[i].held_out == (crc(i, 3) == 1) and 0 <= got[i].score <= 1 for i in got if i is not None)
    assert langid.report(frame.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.report(frame.filter("doc_id < 0")).collect()} <= {"und", "en", "fr"}


def brute_base(rows):
    count, own = collections.Counter(), {}
    for i, t in rows:
        own[i] = [*(t or "").encode().lower().split(), None]
        if i is not None and crc(i, 7) != 2:
            count.update(own[i])
    n, v = sum(count.values()), len(count)
    return {i: (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for i, w in own.items()}


def test_language_model(docs):
    rng = random.Random(12)
    rows = [(-1, None), (-2, ""), (-3, "Word wORD"), (-4, "long " * 100_000), (None, "word")]
    for i in range(200):
        w, text = rng.randrange(50), []
        for _ in range(rng.randint(1, 60)):
            w = (w * 3 + rng.randrange(4)) % 50  # the next word depends on the one before
            text.append(f"x{chr(97 + w // 2)}{chr(97 + w % 26)}")
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r for r in lm.report(docs(rows)).collect()}
    want = brute_base(rows)
    assert len(got) == len(rows)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.held_out == (i is None or crc(i, 7) == 2) and r.score < 0
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert {r.held_out for r in lm.perplexity(lm.report(docs(rows))).collect()} == {True, False}
    assert lm.report(docs([])).count() == 0
    none = [i for i in range(100) if crc(i, 7) == 2][:2]
    assert all(r.n_known == r.train_tokens == 0 for r in lm.report(docs([(i, "a b") for i in none])).collect())


def test_language_model_tells_previous_words_of_one_ending_apart(docs):
    """Words that end alike are contexts of their own, in Latin script and others."""
    rng, rows = random.Random(15), []
    pairs = {"xany": "red", "bony": "blue", "дом": "red", "том": "blue"}
    for i in range(300):
        w = rng.choice(list(pairs))
        rows.append((i, f"{w} {pairs[w]}"))
    held = [i for i in range(300, 400) if crc(i, 7) == 2]
    asked = [f"{w} {c}" for w in pairs for c in ("red", "blue")]
    rows += list(zip(held, asked, strict=False))
    got = {r.doc_id: r.score for r in lm.report(docs(rows)).collect()}
    score = dict(zip(asked, (got[i] for i in held), strict=False))
    for w, c in pairs.items():
        other = {"red": "blue", "blue": "red"}[c]
        assert score[f"{w} {c}"] > score[f"{w} {other}"] + 1


def test_word_restaurants_add_up(docs, spark):
    """What the tables of a context leave and what it passes on to its class is all of its customers."""
    rng = random.Random(16)
    rows = docs([(i, " ".join(rng.choices(["aa", "ba", "bb", "c"], k=20))) for i in range(40)])
    first = lm.counted(rows, 3)
    model, history, _ = lm.trained(first)
    discount, tokens = lm.word_discount(first)
    told = lm.context_tables(first, 3)
    cells = lm.reseated(first, told.filter("part >= 0"), model, history, lm.BURN_IN, discount)
    n, t = collections.Counter(), collections.Counter()
    for r in cells.collect():
        fans = np.frombuffer(r.fans, np.int32)
        of_cell = np.zeros(len(fans), np.int64)
        cell = np.repeat(np.arange(len(of_cell)), fans)
        contexts = lm.uncut(r.contexts, np.frombuffer(r.cells, np.uint64), fans)
        for i, c, k, s in zip(cell, contexts, *(np.frombuffer(x, d) for x, d in ((r.tokens, np.int64), (r.tables, np.int32))), strict=True):
            assert 1 <= s <= k
            n[int(c)] += int(k)
            t[int(c)] += int(s)
            of_cell[i] += s
        assert of_cell.tolist() == np.frombuffer(r.counts, np.int64).tolist()
    assert sum(n.values()) == tokens == 40 * 21 and len(n) == 5
    now = {}
    for r in lm.tables_now(told, cells, 3).collect():
        now |= dict(zip(np.frombuffer(r.contexts, np.uint64).tolist(), np.frombuffer(r.tables, np.int64).tolist(), strict=True))
    assert now == t and sum(t.values()) > first.count()


def test_predictive_probabilities_sum_to_one(docs, spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(["aa", "ab", "ba", "bb", "c"], k=20))) for i in range(30)]
    cells = lm.counted(docs(rows), 1)
    model, history, _ = lm.trained(cells)
    only = cells.first()
    r = lm.Range(only.part, only.cells, only.counts)
    for k, totals in enumerate(history[:-1]):
        r.sweep(model, k, totals)
    for context in (0, 17, int(r.u2[0])):
        wanted = (r.key0 << np.uint64(lm.PAIR_BITS)) | np.uint64(context)
        unknown = np.array([((1 << 53) << lm.PAIR_BITS) | context], np.uint64)
        total = r.predictive(model, history[-1], wanted).sum() + r.predictive(model, history[-1], unknown).sum()
        assert abs(total - 1) < 1e-9


def test_seats_follow_the_restaurant_process():
    rng = np.random.default_rng(1)
    customers = np.full(20_000, 200)
    tables = lm.seated(customers, np.full(20_000, 2.0), 0.5, rng)
    slow = []
    for _ in range(400):
        t = 1
        for i in range(1, 200):
            t += rng.random() * (2.0 + i - 0.5 * t) < 2.0
        slow.append(t)
    assert abs(tables.mean() - np.mean(slow)) < 0.35 and tables.min() >= 1
    assert lm.seated(np.array([0, 1]), np.ones(2), 0.5, rng).tolist() == [0, 1]


def exact_tables(tokens, parent, discounts, base, sweeps, rng):
    """Mean number of tables of each level by Gibbs' sampler with one customer taken out and seated at a time; tokens are (context, word)."""
    sizes, customers, tables = collections.defaultdict(list), collections.Counter(), collections.Counter()

    def prob(level, context, word):
        if level < 0:
            return base
        own = sizes[level, context, word]
        d, above = discounts[level], prob(level - 1, parent(level, context), word)
        return (sum(own) - d * len(own) + (1 + d * tables[level, context]) * above) / (1 + customers[level, context])

    def add(level, context, word):
        own, d = sizes[level, context, word], discounts[level]
        new = (1 + d * tables[level, context]) * prob(level - 1, parent(level, context), word)
        at = rng.choices(range(len(own) + 1), [n - d for n in own] + [new])[0]
        customers[level, context] += 1
        if at < len(own):
            own[at] += 1
            return
        own.append(1)
        tables[level, context] += 1
        if level:
            add(level - 1, parent(level, context), word)

    def remove(level, context, word):
        own = sizes[level, context, word]
        at = rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        customers[level, context] -= 1
        if not own[at]:
            del own[at]
            tables[level, context] -= 1
            if level:
                remove(level - 1, parent(level, context), word)

    for context, word in tokens:
        add(3, context, word)
    total = np.zeros(4)
    for k in range(sweeps):
        for context, word in tokens:
            remove(3, context, word)
            add(3, context, word)
        if k >= sweeps // 5:
            for (level, _), n in tables.items():
                total[level] += n
    return total / (sweeps - sweeps // 5)


def test_sweeps_agree_with_a_sampler_of_single_customers():
    rng = random.Random(17)
    words = ["red", "bed", "blue", "true", "a", "of"]
    texts = [" ".join(rng.choices(words, [6, 1, 3, 1, 2, 4], k=12)).encode() for _ in range(40)]
    found = lm.Tokens(texts)
    fans, before, n = found.bigrams()
    contexts = found.context[before]
    cell = np.repeat(np.arange(len(fans)), fans)
    discounts = (0.3, 0.5, 0.6, 0.7)  # from the root on
    model = lm.Model(discounts[2::-1], len(found.words))
    again = n > 1
    singles = np.bincount(cell[~again], minlength=len(fans))
    r = lm.Range(0, found.cells.tobytes(), fans.astype(np.int64).tobytes())
    every, of_context = np.unique(contexts, return_inverse=True)
    tables, got, sweeps = np.ones(int(again.sum()), np.int64), np.zeros(4), 1200
    for k in range(sweeps):
        now = np.bincount(of_context, minlength=len(every)) + np.bincount(of_context[again], weights=tables - 1, minlength=len(every))
        held = lm.Repeated(n[again], tables, cell[again], singles, now[of_context[again]], lm.WORD_STRENGTH, discounts[3])
        r.sweep(model, k, r.totals(), held)
        tables = held.tables
        assert (tables >= 1).all() and (tables <= n[again]).all() and (r.t2 <= r.c2).all() and (r.t1 <= r.c1).all() and (r.t0 <= r.c0).all()
        if k >= 300:
            got += [r.t0.sum(), r.t1.sum(), r.t2.sum(), tables.sum() + (~again).sum()]
    kinds = {int(x): int(x) & lm.PAIRS - 1 for x in contexts}
    tokens = [(int(x), int(w) >> lm.PAIR_BITS) for x, w, c in zip(contexts, found.cells[cell], n, strict=True) for _ in range(c)]
    parent = lambda level, x: kinds[x] if level == 3 else x >> lm.BYTE_BITS if level == 2 else 0
    want = exact_tables(tokens, parent, discounts, model.base, 300, rng)
    assert np.abs(got / (sweeps - 300) / want - 1).max() < 0.08, (got / (sweeps - 300), want)


def test_tables_are_drawn_by_stirling_numbers():
    """Exact frequencies of small cells, and ratios of large ones against the recursion in logarithms."""
    d, n, pull, left, t, size = 0.7, 7, 2.5, 3, 4, 9.0
    logs = np.full((4001, 4002), -np.inf)
    logs[1, 1] = 0
    for m in range(1, 4000):
        logs[m + 1, 1 : m + 2] = logs[m, : m + 1]
        logs[m + 1, 1 : m + 1] = np.logaddexp(logs[m + 1, 1 : m + 1], np.log(m - d * np.arange(1, m + 1)) + logs[m, 1 : m + 1])
    j = np.arange(1, n)
    weight = np.exp(logs[n, 1 : n + 1] + np.concatenate(([0], np.cumsum(np.log((pull + d * j) / (size + j - 1))))))
    weight *= np.exp(logs[left + np.arange(n), t])  # its parent has at least four customers, as it has tables
    x = lm.drawn(np.full(200_000, n), np.full(200_000, pull), d, lm.Above(*(np.full(200_000, x) for x in (left, t, size)), d), np.random.default_rng(3))
    assert np.abs(np.bincount(x, minlength=n + 1)[1:] / 200_000 - weight / weight.sum()).max() < 0.005
    t = np.array([1, 2, 5, 20, 100, 400, 1000, 3000])
    assert np.abs(lm.stirling_ratio(np.full(8, 4000), t, d) / np.exp(logs[4000, t + 1] - logs[4000, t]) - 1).max() < 0.02
    assert lm.drawn(np.array([0, 1]), np.ones(2), d, lm.Uniform(0.5), np.random.default_rng(3)).tolist() == [0, 1]


def test_pipeline(spark, tmp_path):
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(300):
        text = [f"v{rng.randrange(3000)}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            text[3] = text[9] = "idiot"
        rows.append([i, " ".join(text), "en", "s", 0])
        labels.append((i, 1, int(bad)))
    item = " ".join(f"q{k}" for k in range(12))
    rows[1][1] += " " + item
    rows[2][1] = rows[3][1].replace("v", "v", 1)
    rows[4][1] += " token = abcdef123456"
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["toxicity"]) == {i for i in range(300) if i % 5}
    assert set(seen["minhash_neardup"]) == set(seen["toxicity"]) - {3}
    assert set(seen["decontamination"]) == set(seen["minhash_neardup"]) - {1}
    assert seen["secret_scans"][4].text.endswith(" token = [secret]") and len(seen["secret_scans"]) == len(seen["decontamination"])
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {i: r.ids_sha256 for i, r in seen["byte_bpe"].items()}
    assert neardup and secrets


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, and empty tables."""
    plain = " ".join(f"v{i}" for i in range(30))
    rows = [(1, None), (None, plain + " x"), (2, ""), (3, plain), (3, plain), (4, plain), (5, "w " * 60_000), (6, "api_key=abcdefgh12")]
    extra = {"score": 1.0, "spans": "s", "__found": 1, "component_id": 2, "kept": None, "ids": "i", "label": 3, "held_out": None}
    names = ["doc_id", "text", "lang", "source", "n_chars", *extra]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, __found int, component_id long, kept boolean, ids string, label int, held_out boolean"
    full = [(i, t, None, None, None, *extra.values()) for i, t in rows]
    empty = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for k, kept in enumerate((full, [])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(kept, kinds).write.parquet(f"{folder}/documents.parquet")
        for name, schema in empty.items():
            spark.createDataFrame([(None, None, None)[: len(schema.split(","))]] if k == 0 else [], schema).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if name != "byte_bpe":
                assert out.columns == names
            out.write.parquet(f"{folder}/{j}")
            docs = spark.read.parquet(f"{folder}/{j}")
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
        # a repeated row is one document, and of equal texts the smallest id stays
        assert {i for none, i in ids if not none} == ({1, 2, 3, 5, 6} if k == 0 else set())


def test_repeated_rows_are_judged_alike(spark):
    rows = [(i, f"word{i % 7} the sch ung w{i % 3}", "de" if i % 2 else "en") for i in range(60)]
    frame = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    for got in (langid.report(frame).collect(), lm.report(frame).collect(), toxicity.report(frame, labels).collect()):
        assert len(got) == 80 and len({tuple(r) for r in got}) == 60


def test_tied_votes_go_to_the_better_margins():
    """Three machines that each beat another: the class with the larger sum of margins wins, always the same one."""
    one = np.ones(1, np.float32)
    machines = [(0, 1, 2 * one, 0.0), (1, 2, one, 0.0), (0, 2, -one, 0.0)]
    best, sure = langid.vote((["a", "b", "c"], machines), np.ones((2, 1), np.float32))
    assert best.tolist() == [0, 0] and (sure >= 0).all()
