"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, no rows, columns that clash."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import impact_topk, mil_quality, mixing, pii_feistel, quality_forest, sentencepiece_ac, simhash_pivot, suffix_dedup, toxicity_cnn, url_tree

WORDS = "alpha beta gamma delta river stone cloud metal paper light wonder simple".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90)))
        rows.append((i, text, "en", rng.choice(["a", "b", "a", None]), len(text)))
    rows += [rows[5], (n, rows[5][1], "en", "b", 0), (n + 1, None, None, None, None), (n + 2, "", "en", "a", 0), (None, "orphan text with no id at all", "en", "a", 3), (None, None, None, None, None)]
    rows.append((n + 3, " ".join(rng.choice(WORDS) for _ in range(40_000)), "en", "c", 0))
    rows.append((n + 4, "x" * 300_000, "en", "c", 0))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 ---------------------------------------------------------------------------------------------------------


def brute_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_rule_statistics():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é ", "\n", "\t", "#", "a b a b c ", " ", "\x1c"]) for _ in range(rng.randint(0, 60)))
        assert quality_forest.statistics(text)[0] == brute_counts(text)


def test_quality_rules(spark, docs, none):
    labels = docs.where("doc_id < 40").select("doc_id", F.lit(1).alias("good")).union(spark.createDataFrame([(10_000, 0), (None, 1), (3, None)], "doc_id long, good int"))
    got = quality_forest.judge(docs.withColumn("kept", F.lit("clash")), labels).collect()
    assert len(got) == docs.count()
    for r in got:
        n, chars, symbols, dup, rep = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    assert quality_forest.judge(none, labels).count() == 0


def test_forest_isolates_what_stands_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 4)), rng.normal(8, 1, (10, 4))])
    forest = quality_forest.grow(x, 100, 256, 1)
    s = quality_forest.isolation(x, forest, 256)
    assert s[500:].min() > np.quantile(s[:500], 0.95)
    cut = quality_forest.calibrate(s, np.arange(510) < 500, 0.95)
    assert (s[:500] <= cut).mean() >= 0.95 and (s[500:] > cut).all()


# -- 2 ---------------------------------------------------------------------------------------------------------


def test_url_rules_and_tree(spark):
    urls = [
        ("http://A.b.NET/x", "block"), ("https://example.net/en/1", "allow"), ("https://m.example.net/fr/1", "block"), ("http://example.com/de/9", "block"),
        ("http://notexample.com/de/9", "allow"), ("http://q.org/fr/z?x", "allow"), ("nothing", "allow"), (None, "allow"), ("http://net", "allow"), ("ftp://net/#/", "block"), ("http://example.net#/en/", "allow"),
    ]
    rows = [(i, u) for i, (u, _) in enumerate(urls)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string")
    u = df.select("page_id", url_tree.host_of(F.col("url")).alias("host"), url_tree.path_of(F.col("url")).alias("path"))
    rule, verdict = url_tree.rule_of(F.col("host"), F.col("path"))
    got = {r.page_id: r for r in u.select("*", rule.alias("rule"), verdict.alias("v")).collect()}
    for i, (_, v) in enumerate(urls):
        assert (got[i].v or "allow") == v, urls[i]
    assert (got[0].host, got[0].path, got[6].host, got[7].path) == ("a.b.net", "/x", "", "")
    assert (got[8].host, got[8].path) == ("net", "")


def test_tree_generalises_and_rejects(spark, data):
    rows = [("h", f"/shop/{i}/item", 1) for i in range(40)] + [("h", f"/blog/{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)}", 0) for i in range(40)] + [("h", "/shop/999/item", None), ("h", "/blog/new", None), ("g", "/shop/1/item", None), ("", "", None)]
    df = spark.createDataFrame(rows, "host string, path string, bad int")
    got = {(r.host, r.path): r for r in url_tree.judge(df).collect()}
    assert got["h", "/shop/999/item"].template == "/shop/{n}/item" and got["h", "/shop/999/item"].rejected
    assert got["h", "/blog/new"].template == "/blog/*" and not got["h", "/blog/new"].rejected
    assert not got["g", "/shop/1/item"].rejected
    assert url_tree.judge(df.limit(0)).count() == 0
    assert url_tree.op2_url_filters(spark, data).count() == spark.read.parquet(f"{data}/pages.parquet").count()


def test_unlabelled_branches_are_not_merged(spark):
    rows = [("h", f"/de/{i}", 1) for i in range(40)] + [("h", f"/fr/{i}", None) for i in range(20)] + [("g", f"/x/{i}", 0) for i in range(40)]
    rows += [("m", f"/{a}/{i}", 1) for a in ("a", "b") for i in range(3)]
    got = {(r.host, r.template): r for r in url_tree.judge(spark.createDataFrame(rows, "host string, path string, bad int")).collect()}
    clash = spark.createDataFrame(rows, "host string, path string, bad int").withColumns({c: F.lit("own") for c in ("template", "parent", "purity", "rejected", "more")})
    kept = url_tree.judge(clash)
    assert kept.columns.count("rejected") == 1 and kept.where("rejected and more = 'own'").count() == kept.where("rejected").count() == sum(r[2] == 1 for r in rows)
    assert got["h", "/de/{n}"].rejected and not got["h", "/fr/{n}"].rejected
    assert got["h", "/fr/{n}"].purity == 46 / 86
    assert got["m", "/a/{n}"].purity == got["m", "/b/{n}"].purity == (6 + 4 * 46 / 86) / 10


# -- 3 ---------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, total, cap):
    target, full = {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        new = {s for s in sizes if s not in full and target[s] >= cap * sizes[s]}
        if not new:
            return target
        full |= new


def sainte_lague(votes, seats):
    got = {k: 0 for k in votes}
    for _ in range(seats):
        k = max(votes, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[k] += 1
    return got


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        votes = {k: rng.choice([0, 1, 3, 10, 500, 7919]) * rng.randint(1, 9) for k in range(rng.randint(1, 9))}
        seats = rng.randint(0, 60)
        if sum(votes.values()):
            rows += [(g, k, v, seats) for k, v in votes.items()]
            want |= {(g, k): q for k, q in sainte_lague(votes, seats).items()}
    got = mixing.apportion(spark.createDataFrame(rows, "g int, k int, v long, s long"), ["g"], "v", "s", ["k"])
    assert {(r.g, r.k): r.quota for r in got.collect()} == want


def check_mix(docs, got, slack):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len((t or "").encode().split())
    key = lambda d, s, n: (d is None, d or 0, s or "", n)
    assert sorted(key(r.doc_id, r.source, r.size) for r in got) == sorted(key(r.doc_id, r.source, size(r.text)) for r in rows)
    sizes = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(want[s], 1) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= slack


def test_mix(spark, docs, none):
    got = mixing.mix(docs, block=4, shard_docs=16).collect()
    check_mix(docs, got, 4)
    again = mixing.mix(docs.repartition(7), block=4, shard_docs=16).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(none).count() == 0


def test_mix_of_small_sources(spark):
    rng = random.Random(9)
    rows = [(s * 100 + i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40))), f"s{s:02}") for s in range(40) for i in range(rng.choice([1, 1, 2, 30]))]
    rows += [(5000 + i, "w", "tiny") for i in range(3)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(many).collect()
    check_mix(many, got, 32)
    one = spark.createDataFrame([(1, "one two three", "a"), (2, "four", "b"), (3, None, "c")], "doc_id long, text string, source string")
    check_mix(one, mixing.mix(one).collect(), 1)


def test_readings_hold_the_taken_words(spark, docs):
    clash = docs.withColumns({c: F.lit(7) for c in ("size", "taken", "target", "source_size", "reading")})
    for given in (docs, clash):
        for run in (4, 32):
            mixed = mixing.mix(given, run=run, shard_docs=16)
            read = mixing.readings(given, mixed, run=run)
            assert read.columns == given.columns
            want, got, times = Counter(), Counter(), Counter()
            for r in mixed.collect():
                want[r.doc_id, r.source] += r.taken
                times[r.doc_id, r.source] += 2
            whole = {(r.doc_id, r.source): r.text for r in given.collect()}
            for r in read.collect():
                got[r.doc_id, r.source] += len(r.text.encode().split())
                times[r.doc_id, r.source] -= 1
                words = iter(whole[r.doc_id, r.source].split())
                assert all(w in words for w in r.text.split())
            assert got == Counter({k: v for k, v in want.items() if v}) and min(times.values()) >= 0


# -- 4, 6 --------------------------------------------------------------------------------------------------------


def labelled(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "idiots", "scumbag"]))
        if i % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "!!" for w in rng.choices(WORDS, k=70)]
        rows.append((i, " ".join(words), int(i % 5 != 0), int(toxic)))
    return rows


def test_classifiers_learn(spark, docs, none):
    df = spark.createDataFrame(labelled(), "doc_id long, text string, quality int, toxic int").cache()
    for module, label in ((mil_quality, "quality"), (toxicity_cnn, "toxic")):
        known = df.where("doc_id % 3 <> 0").select("doc_id", F.col(label).alias("label"))
        got = module.classify(df.select("doc_id", "text", F.lit(9).alias("score")), known).join(df.select("doc_id", F.col(label).alias("y")), "doc_id").where("doc_id % 3 = 0").collect()
        assert len(got) == 100
        assert sum(r.predicted == r.y for r in got) >= 85
        assert all(0 <= r.score <= 1 for r in got)
        rest = module.classify(docs, known).collect()
        assert len(rest) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rest)
        assert module.classify(none, known).count() == 0
        assert module.classify(docs, known.limit(0)).count() == docs.count()


def test_thresholds_come_from_all_labelled_rows(spark):
    rows = [(d, " ".join(["el los las con"] * 3) + " " + t if d % 4 == 1 or d % 8 == 0 else t, y) for d, t, _, y in labelled(n=400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").cache()
    model = toxicity_cnn.learn(df.where("doc_id % 5 = 0"))
    toxicity_cnn.calibrate(model, df.select("doc_id", "text"), df.select("doc_id", "label"))
    rest = [r for r in rows if r[0] not in set(model.learnt)]
    ids, off, lang = toxicity_cnn.word_ids(np.frombuffer("".join(t for _, t, _ in rest).encode(), np.uint8), np.cumsum([0] + [len(t) for _, t, _ in rest]))
    z, y = model.logits(ids, off).astype(float), np.array([r[2] for r in rest])
    assert len(model.learnt) == 64 and (y[lang == 3] > 0).sum() >= 20
    f1 = lambda p, y: 2 * (p & (y > 0)).sum() / (p.sum() + (y > 0).sum())
    for k in (0, 3):
        cut = np.log(toxicity_cnn.CUT / (1 - toxicity_cnn.CUT)) - model.shift[k]
        assert f1(z[lang == k] >= cut, y[lang == k]) >= f1(z[lang == k] >= toxicity_cnn.f1_cut(z[lang == k], y[lang == k]), y[lang == k]) - 0.02


def test_gradient_of_mil():
    rng = np.random.default_rng(0)
    x, off, y, w = rng.normal(size=(9, mil_quality.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([0.0, 1, 1]), np.ones(3)
    model = mil_quality.Mil(5, 4)
    loss = lambda: float((np.log1p(np.exp(-(2 * y - 1) * model.forward(x, off)[-1])) * w).sum() / w.sum())
    grad = model.gradient(x, off, y, w)
    for k, p in model.p.items():
        i = tuple(rng.integers(0, s) for s in p.shape)
        old, eps = p[i], 1e-6
        p[i] = old + eps
        up = loss()
        p[i] = old - eps
        down = loss()
        p[i] = old
        assert abs((up - down) / (2 * eps) - grad[k][i]) < 1e-6


# -- 5 -------------------------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.3, 6)]) for i in range(260)]
    rows += [(300 + i, rows[20][1]) for i in range(60)] + [(999, None), (1000, [0.1, None]), (1020, [float("nan")] * 6), (1040, [float("inf")] * 6), (1060, [0.5, 0.5]), (1080, []), (None, [0.1] * 6), rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = impact_topk.integers(df)
    got = {}
    for r in impact_topk.top_k(v, v.where("vec_id % 20 = 0"), 20, shard=50, block=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in e]) for i, e in rows if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for q in {i for i, _ in ok if i % 20 == 0}:
        mine = next(e for i, e in ok if i == q)
        best = sorted(((-dot(mine, e), i) for i, e in ok if i != q))[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert impact_topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    for size in (4e7, 3e9, 1e16):
        rows = [(i, [size * (i % 7 - 3), 1.0, float(i)]) for i in range(40)]
        v = impact_topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        x = {r.vec_id: r.v for r in v.collect()}
        clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
        for own in (0, 20):
            score = {i: sum(a * b for a, b in zip(x[i], x[own], strict=True)) for i in x if i != own}
            want = [(i, clip(score[i])) for i in sorted(score, key=lambda i: (-score[i], i))[:5]]
            got = impact_topk.top_k(v, v.where(F.col("vec_id") == own), 5).orderBy("rank").collect()
            assert sorted((r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_with_tied_segments():
    rng = np.random.default_rng(7)
    for trial in range(60):
        n, dim = int(rng.integers(120, 600)), int(rng.integers(2, 65))
        x = rng.integers(-2, 3, (n, dim)) if trial % 2 else rng.integers(-90, 90, (n, dim))
        x[: n // 3] = x[0]
        ids = rng.permutation(n).astype(np.int64)
        index = impact_topk.Index(ids, x.astype(np.int64))
        for i in rng.integers(0, n, 40):
            got, score = index.search(x[i].astype(np.int64), int(ids[i]), 20)
            want = sorted((-int(s), int(d)) for s, d in zip(x @ x[i], ids, strict=True) if d != ids[i])[:20]
            assert list(zip((-score).tolist(), got.tolist(), strict=True)) == want, (trial, i)


# -- 7 -------------------------------------------------------------------------------------------------------------


def test_simhash(spark, docs, none):
    import xxhash

    rng = random.Random(8)
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(400))
    near = [(1000 + i, base.replace(" ", "  ", 1) + f" tail{i}", "en", "a", 0) for i in range(30)]
    df = docs.union(spark.createDataFrame(near, DOCS))
    prints = simhash_pivot.fingerprints(df)
    got = simhash_pivot.near_duplicates(prints, per_cell=2, most=8).collect()
    assert len(got) == df.count()
    known = [(r.doc_id, r.fp & (1 << 64) - 1) for r in got if r.doc_id is not None]
    want = simhash_pivot.brute_force(known)
    assert all(want[r.doc_id] == r.component_id for r in got if r.doc_id is not None)
    for text in ("", None, "one", "One TWO", "a b c d a b c"):
        w = (text or "").lower().split()
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert simhash_pivot.fingerprint(text, xxhash.xxh64_intdigest) == bits
    assert simhash_pivot.near_duplicates(simhash_pivot.fingerprints(none)).count() == 0


def test_cells_hold_every_linked_pair():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    other = fp ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    who, cell = simhash_pivot.enter_cells(np.concatenate([fp, other]), simhash_pivot.pivots(9), 2)
    cells = [set() for _ in range(600)]
    for w, c in zip(who.tolist(), cell.tolist(), strict=True):
        cells[w].add(c)
    assert all(cells[i] & cells[i + 300] for i in range(300))


# -- 8 -------------------------------------------------------------------------------------------------------------


def test_columnwise_sorts_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        strs = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 25))]
        data, at = np.frombuffer(b"".join(strs), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in strs])])
        who, length, lcp = suffix_dedup.columnwise(data, at[:-1], at[1:])
        suffixes = [strs[w][len(strs[w]) - n :] for w, n in zip(who, length, strict=True)]
        assert [(s, int(w)) for s, w in zip(suffixes, who, strict=True)] == sorted((strs[w][i:], w) for w in range(len(strs)) for i in range(len(strs[w]) + 1))
        for i in range(1, len(suffixes)):
            same = [a == b for a, b in zip(suffixes[i], suffixes[i - 1], strict=False)]
            assert lcp[i] == (same.index(False) if False in same else len(same))


def test_suffix_dedup(spark, docs, none):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdef ") for _ in range(200))
    rows = [(r[0], r[1]) for r in make_docs()[:-1]]
    rows += [(500 + i, "é" * i + shared[i : i + 60 + 2 * i] + "#" * 70 + shared[: 20 + i] + "\x00ß") for i in range(40)]
    rows += [(700, "ab" * 200), (701, "ba" * 200), (702, "ab" * 24), (703, "ab" * 25), (None, shared), (499, shared[:50])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    got = suffix_dedup.repeats(df, part=64).select("doc_id", "n_bytes", gone, F.size("spans"), F.sha2("kept", 256)).collect()
    key = lambda r: (r[0] is None, *((v if v is not None else -1) for v in r))
    assert sorted(map(tuple, got), key=key) == sorted(suffix_dedup.brute_force(rows), key=key)
    assert suffix_dedup.repeats(none.select("doc_id", "text")).count() == 0


def test_suffix_dedup_of_repeats_inside_a_document(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(12):
        held, left, right = word(rng.randint(50, 90)), word(90), word(90)
        loop = left + held + right
        rows += [(10 * i + 1, word(40) + held + word(40)), (10 * i + 2, loop * 4 + word(30) + loop), (10 * i + 3, loop + word(10)), (10 * i + 3, word(10) + loop * 2)]
        rows += [(None, word(7) + "-" * 30 + held + "=" * 30), (None, "-" * 30 + held + "=" * 30 + word(9)), rows[-3]]
    rows += [(900, "a" + "#" * 55 + "b"), (901, "c" + "#" * 300 + "\n" + "#" * 70), (902, "é" + "ab" * 60), (903, "ß" + "ba" * 200 + "\n" + "ab" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    got = suffix_dedup.repeats(df, part=64).select("doc_id", "n_bytes", gone, F.size("spans"), F.sha2("kept", 256)).collect()
    key = lambda r: (r[0] is None, *((v if v is not None else -1) for v in r))
    assert sorted(map(tuple, got), key=key) == sorted(suffix_dedup.brute_force(rows), key=key)


def test_suffix_dedup_deals_anchors_in_one_pass():
    """What a batch costs grows with its anchors, not with anchors times partitions."""
    import time

    import pyarrow as pa

    from tessel.llm.util import labels_of

    class Batches:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(97, 123, 9000))) for _ in range(100)]
    one = lambda v, k: pa.array(v, k)
    batch = pa.RecordBatch.from_arrays([one(range(100), pa.int64()), one(range(100), pa.int64()), one([3] * 100, pa.int32()), one(texts, pa.string())], names=["doc_id", "th", "bucket", "text"])
    took, found = {}, {}
    for parts in (8, 8, 6000):
        run = suffix_dedup.find_anchors(Batches(), 50, labels_of(parts))
        began = time.process_time()
        packed = [x for b in run([batch]) for x in b.column(2).to_pylist()]
        took[parts] = time.process_time() - began
        d, t, b, n, h, _, s, e = suffix_dedup.gather([pa.RecordBatch.from_arrays([pa.array(packed)] * 3, names=list("abc"))], (*suffix_dedup.DOCS, np.uint64, np.uint64, np.int32, np.uint8))
        found[parts] = sorted(zip(np.repeat(d, n).tolist(), s.tolist(), e.tolist(), h.tolist(), strict=True))
    assert found[8] == found[6000]
    assert took[6000] < 10 * took[8] + 0.3, took


def test_fragments_that_share_less_than_a_string_are_not_sorted():
    rng = np.random.default_rng(9)
    random_bytes = lambda n: rng.integers(97, 123, n).astype(np.uint8)
    middle = random_bytes(200)
    for shared, expected in ((36, False), (50, True), (57, True)):
        kept = []
        for at in range(0, 140, 3):
            texts = [np.concatenate([random_bytes(40), middle[at : at + shared], random_bytes(40)]) for _ in range(2)]
            x = np.concatenate(texts)
            parts = [suffix_dedup.anchors(t, 50) for t in texts]
            h = np.concatenate([p[0] for p in parts])
            start = np.concatenate([p[2] + k * len(texts[0]) for k, p in enumerate(parts)])
            size = np.concatenate([p[3] - p[2] for p in parts])
            which, low, high = suffix_dedup.may_repeat(h, x, start, size, 50)
            kept.append(len(which) > 0)
            for k in range(2 * (shared >= 50)):  # each shared string lies in what is left of a fragment
                first = 40 + k * len(texts[0])
                assert all(any(a <= first + i and first + i + 50 <= z for a, z in zip(low, high, strict=True)) for i in range(shared - 49))
        assert all(kept) if expected else not any(kept)


# -- 9 -------------------------------------------------------------------------------------------------------------


def private(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in pii_feistel.pseudonymise(df).orderBy("doc_id").collect()]


def luhn(d):
    return sum(int(c) if (len(d) - i) % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d)) % 10 == 0


def test_pii(spark):
    import datetime
    import re

    got = private(spark, ["pay 4111111111111111 or 4111-1111-1111-1111, id 123-45-6789", "4111111111111111", "on 2024-02-29 or 31.12.1999", "never 2023-02-30, 000-12-3456, 999.1.1.1 or 12345678", "a.b@c.example.org 10.0.0.255 +1 (212) 555-0100", None, "", "9" * 50, 'key "' + "0a" * 20 + '"'])
    a = got[0].text
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", a)
    assert cards[0] == cards[1].replace("-", "") == got[1].text != "4111111111111111" and luhn(cards[0])
    assert re.fullmatch(r"pay \d{16} or \d{4}-\d{4}-\d{4}-\d{4}, id \d{3}-\d{2}-\d{4}", a) and "123-45-6789" not in a
    d = re.fullmatch(r"on (\d{4}-\d{2}-\d{2}) or (\d{2}\.\d{2}\.\d{4})", got[2].text)
    datetime.date.fromisoformat(d[1])
    datetime.datetime.strptime(d[2], "%d.%m.%Y")
    assert got[2].n_private == 2 and got[3].n_private == 0 and got[3].text.startswith("never 2023-02-30, 000-12-3456, 999.1.1.1")
    m = re.fullmatch(r"(\S+@\S+\.org) (\d+\.\d+\.\d+\.\d+) \+1 \(\d{3}\) \d{3}-\d{4}", got[4].text)
    assert m and all(int(x) <= 255 for x in m[2].split(".")) and "a.b@" not in got[4].text
    assert got[5].text is None and got[6].text == "" and got[5].n_private == got[6].n_private == 0
    assert re.fullmatch(r"\d{50}", got[7].text) and re.fullmatch(r'key "[0-9a-f]{40}"', got[8].text) and "0a0a" not in got[8].text


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(F.expr(pii_feistel.digits("d", "k")).alias("p")).distinct().count() == 1000
    days = spark.range(2000).select(F.date_format(F.date_add(F.lit("1999-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii_feistel.pseudonymise(days).select("text").distinct().count() == 2000


def plain_feistel(x, y, a, b, key, tag):
    import hashlib

    for i in range(8):
        f = lambda v: int(hashlib.sha256(f"{key}|{tag}|{i}|{v}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        x, y = (x, (y + f(x)) % b) if i % 2 == 0 else ((x + f(y)) % a, y)
    return x, y


def luhn(d):
    return sum(int("0246813579"[int(c)]) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def check_digit(body):
    return next(c for c in "0123456789" if luhn(body + c))


def plain_number(d, key):
    """What a run of digits becomes, step by step."""

    def digits(d, tag):
        h = len(d) // 2
        x, y = plain_feistel(int(d[:h] or 0), int(d[h:]), 10**h, 10 ** (len(d) - h), key, f"{tag}{len(d)}")
        return (str(x).zfill(h) if h else "") + str(y).zfill(len(d) - h)

    if not 13 <= len(d) <= 19:
        return digits(d, "n")
    if luhn(d):
        body = digits(d[:-1], "card")
        return body + check_digit(body)
    h = len(d) // 2
    above = (int(d[-1]) - int(check_digit(d[:-1]))) % 10
    x, y = plain_feistel(int(d[:h]), int(d[h:-1]) * 9 + above - 1, 10**h, 9 * 10 ** (len(d) - 1 - h), key, f"other{len(d)}")
    body = str(x).zfill(h) + str(y // 9).zfill(len(d) - 1 - h)
    return body + str((int(check_digit(body)) + y % 9 + 1) % 10)


def test_numbers_by_a_plain_feistel(spark):
    rng = random.Random(8)
    numbers = ["".join(rng.choice("0123456789") for _ in range(n)) for n in range(9, 37) for _ in range(12)]
    numbers += [b + check_digit(b) for b in ("".join(rng.choice("0123456789") for _ in range(n)) for n in range(12, 19) for _ in range(12))]
    got = pii_feistel.pseudonymise(spark.createDataFrame([(n,) for n in numbers], "text string").withColumn("t", F.col("text")), key="k").collect()
    assert {r.t: r.text for r in got} == {n: plain_number(n, "k") for n in numbers}
    assert all(luhn(r.t) == luhn(r.text) for r in got if 13 <= len(r.t) <= 19)


def test_numbers_stay_different(spark):
    near = spark.range(20_000).select(F.concat(F.lit("40000000"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    out = pii_feistel.pseudonymise(near, key="another key")
    assert out.select("text").distinct().count() == 20_000 and out.where("length(text) <> 13").isEmpty()


def test_pii_tables(spark, docs, none):
    clash = docs.withColumns({"n_private": F.lit("x"), "_pi": F.lit(1)})
    out = pii_feistel.pseudonymise(clash)
    assert out.count() == docs.count() and set(out.columns) == set(clash.columns) and out.where("n_private <> 0").isEmpty()
    assert pii_feistel.pseudonymise(none).count() == 0
    pair = spark.createDataFrame([(1, "4111111111111111"), (1, "4111111111111111"), (2, "card 4111-1111-1111-1111")], "doc_id long, text string")
    one, two, three = (r.text for r in pii_feistel.pseudonymise(pair).orderBy("doc_id").collect())
    assert one == two == three[5:].replace("-", "") and pii_feistel.pseudonymise(pair, key="other").first().text != one


# -- 10 ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    import os

    path = sentencepiece_ac.default_model()
    if not os.path.exists(path):
        pytest.skip("no model file")
    with open(path, "rb") as f:
        return sentencepiece_ac.Codec(f.read())


def best_score(codec, s):
    """Highest total score by trying every piece at every place."""
    pieces = {}
    for p in codec.automaton.keys():
        pieces[p] = codec.automaton.get(p)[1]
    best = [0.0] + [float("-inf")] * len(s)
    for i in range(len(s)):
        if s[i] not in codec.single:
            best[i + 1] = max(best[i + 1], best[i] + codec.unknown)
        for j in range(i + 1, min(len(s), i + 48) + 1):
            if s[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[s[i:j]])
    return best[-1]


def test_encoding_is_the_best_path(codec):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_ac.default_model())
    for text in ["the quick  brown fox", "été déjà-vu, naïve", "a\nb\tc", "日本語 text", "1234567890 ####", "x" * 40]:
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        s = "▁" + text.replace(" ", "▁")
        score = sum(sp.get_score(i) for i in ids if not sp.is_byte(i)) + codec.unknown * sum(c not in codec.single for c in s if not any(c in p for p in codec.single))
        assert codec.viterbi(s) == ids
        assert score == pytest.approx(best_score(codec, s))


def test_encode_table(spark, docs, none, codec):
    got = sentencepiece_ac.encode(docs.withColumn("ids", F.lit("clash")), decoded=True).collect()
    assert len(got) == docs.count()
    assert all(r.round_trip and r.decoded == (r.text or "") and len(r.ids) == r.n_pieces for r in got)
    assert sentencepiece_ac.encode(none).count() == 0


def test_quality_forest_threshold_counts_all_labelled_rows(spark):
    """No 4,096 labelled rows stand for the others: every row that the base rules pass is measured, and bins hold what scores say."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('one two three four five six seven eight nine ten word', id) as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 7 > 0) as good")
    assert quality_forest.measured(docs, labels.union(labels)).groupBy("good").count().count() == 2
    assert quality_forest.measured(docs, labels.union(labels)).count() == 6000
    score = np.array([0.0, 0.25, 0.25 + 1e-9, 1.0])
    at = quality_forest.bin_of(score)
    assert ((at + 1) / quality_forest.BINS >= score).all() and (at / quality_forest.BINS < score)[1:].all()
    n = quality_forest.BINS
    good, bad = np.bincount([n // 4] * 98 + [n // 2] * 2, minlength=n), np.bincount([n // 4] + [n - 1] * 9, minlength=n)
    assert quality_forest.cut_off(good, bad, 0.975) == (n // 2 + 1) / n
    assert quality_forest.cut_off(good, bad * 0, 0.975) == 1.0
