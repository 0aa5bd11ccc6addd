"""Near copies, repeated passages, vectors, languages and the pipeline against brute force."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, same

from millrace.llm import queries as L
from millrace.llm.components import components
from millrace.llm.fm_index import FMIndex, repeated
from millrace.llm.language import UNKNOWN, forward_backward, identify
from millrace.llm.near_copies import near_copies
from millrace.llm.repeated_passages import remove_repeated
from millrace.llm.vectors import nearest, top_products

WORDS = [f"w{i}" for i in range(400)]
COLUMNS = "doc_id long, text string, class_id int, node string, kept string, n int"


def copies_of(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    fresh = lambda n: [rng.choice(WORDS) for _ in range(n)]
    shared = fresh(60)
    out = [None, "", "  ", "one", "one", "one two three", "one two three", " one two  three"]
    out += [" ".join(fresh(rng.randint(5, 120))) for _ in range(40)]
    for size in (2, 5, 40):
        out += copies_of(rng, fresh(150), size, 6)
    out += [" ".join([*fresh(rng.randint(0, 30)), *shared, *fresh(rng.randint(0, 30))]) for _ in range(25)]
    out += ["the " * 300, "the " * 90, "a b " * 60, " ".join(fresh(5000))]
    return out


def frame(spark, texts):
    rows = [(i, t, 1, "x", "y", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[20], 1, "x", "y", 2), (21, texts[21], 1, "x", "y", 2)], COLUMNS).repartition(3)


def shingles(text, n=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies(spark, texts, block):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (21, texts[21])]
    classes = defaultdict(list)
    for i, t in rows:
        classes[shingles(t)].append(i)
    sets = [s for s in classes if s]
    root = {s: s for s in sets}
    links, kinds = Counter(), Counter()

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                links[a] += len(classes[b])
                links[b] += len(classes[a])
                kinds[a] += 1
                kinds[b] += 1
                if find(a) is not find(b):
                    root[find(a)] = find(b)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    members = defaultdict(list)
    for s in sets:
        members[find(s)] += classes[s]
    want = []
    for i, t in rows:
        s = shingles(t)
        want.append((i, least(members[find(s)]), least(classes[s]), len(classes[s]) - 1 + links[s], kinds[s]) if s else (i, i, i, 0, 0))
    got = [tuple(r) for r in near_copies(frame(spark, texts), block=block).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(links.values()) > 100


def test_near_copies_at_the_threshold_in_buckets_that_split(spark):
    # groups of four texts, 40 of 50 5-grams common to any two of them: they meet only in buckets above the block size
    texts = [" ".join([*(f"g{g}w{i}" for i in range(44)), *(f"g{g}t{k}w{i}" for i in range(5))]) for g in range(600) for k in range(4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = near_copies(rows, block=3).collect()
    assert len(got) == 2400 and [r.doc_id for r in got if (r.class_id, r.n_texts) != (r.doc_id // 4 * 4, 3)] == []


def test_near_copies_of_nothing(spark):
    assert near_copies(spark.createDataFrame([], COLUMNS)).collect() == []


def plain_removal(rows, least):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - least + 1):
            if seen[tuple(w[k : k + least])] > 1:
                gone[k : k + least] = [True] * least
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("options", [{}, {"shard": 5}, {"hot": 3}, {"least": 13}, {"least": 5}, {"least": 2}])
def test_repeated_passages(spark, texts, options):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (21, texts[21])]
    want = plain_removal(rows, options.get("least", 35))
    got = [tuple(r) for r in remove_repeated(frame(spark, texts), **options).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)
    assert remove_repeated(spark.createDataFrame([], COLUMNS), **options).collect() == []


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = FMIndex(text, len(text))
    for n in (1, 2, 3, 5):
        pattern = text[40 : 40 + n]
        low, high = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert (high - low)[0] == sum((text[i : i + n] == pattern).all() for i in range(len(text) - n))
    assert repeated([np.arange(10), np.arange(5, 15), np.arange(20, 30)], 4) == [[(5, 10)], [(0, 5)], []]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 10), (11, 20), (2, 1)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 7, 8: 7, 7: 7, 20: 10, 10: 10, 11: 10, **{i: 100 for i in range(100, 141)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)], 0.5, 1) for i in range(600)]
    rows += [(700, None, 0.5, 1), (800, [0.0] * 8, 0.5, 1), (900, [1.0, float("nan")] * 4, 0.5, 1), (1000, [1.0, None] * 4, 0.5, 1), (1100, [float("inf")] * 8, 0.5, 1), (None, [1.0] * 8, 0.5, 1), (1200, [], 0.5, 1)]
    rows += [(1300, [1.0, 2.0], 0.5, 1), (1301, [1.0, 3.0], 0.5, 1), (100, rows[100][1], 0.5, 1), (7, rows[7][1], 0.5, 1), (1400, [3.0] * 3, 0.5, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int").repartition(3)


def plain_search(rows, ok, modulo, k, score, sign):
    usable = {i: np.array(v) for i, v, *_ in rows if i is not None and v and ok(v)}
    out = []
    for q, a in usable.items():
        if q % modulo == 0:
            best = sorted((sign * score(a, b), i) for i, b in usable.items() if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, sign * s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def finite(v):
    return all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_nearest(spark, vectors, monkeypatch, broadcast):
    monkeypatch.setattr("millrace.llm.vectors.BROADCAST_BYTES", broadcast)
    rows, df = vectors
    want = plain_search(rows, lambda v: finite(v) and any(v), 100, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), 1)
    got = sorted(tuple(r) for r in nearest(df).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)
    assert nearest(df.limit(0)).collect() == []


def test_nearest_of_very_large_and_small_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e190]), (2, [-1e200, 3.0]), (3, [1e-200, 1e-200]), (100, [2e-200, 1e-200]), (200, [1.0, 2.0]), (5, [1.0, 2.5])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    v = dict(rows)
    for q in (0, 100, 200):
        want = sorted((math.dist(v[q], v[i]), i) for i in v if i != q)
        mine = [r for r in got if r.query_id == q]
        assert [r.vec_id for r in mine] == [i for _, i in want] and np.allclose([r.score for r in mine], [d for d, _ in want], rtol=1e-12)


@pytest.mark.parametrize("broadcast,pivots", [(1 << 24, 64), (0, 7), (1 << 24, 0)])
def test_top_products(vectors, monkeypatch, broadcast, pivots):
    monkeypatch.setattr("millrace.llm.vectors.BROADCAST_BYTES", broadcast)
    rows, df = vectors
    whole = lambda a: np.floor(256 * a).astype(int)
    want = plain_search(rows, finite, 50, 5, lambda a, b: int(whole(a) @ whole(b)), -1)
    assert sorted(tuple(r) for r in top_products(df, n_pivots=pivots).collect()) == want
    assert top_products(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op5_nearest", "op7_repeated_passages", "op8_top_products"])
def test_queries_agree_with_sql(spark, sf, name):
    same(L.QUERIES[name](spark, sf), connect(sf).sql(L.ORACLE[name]))


def test_near_copy_query_agrees_with_sql(spark, sf):
    same(L.op1_near_copies(spark, sf), connect(sf).sql(L.ORACLE["op1_near_copies"]))


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in L.table(spark, sf, "documents").collect()}
    got = [r for r in L.op9_language(spark, sf).collect() if r.held_out]
    assert len(got) > 250 and sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(4)
    k, steps = 3, 5
    emit, move, first = rng.normal(size=(steps, 2, k)), np.exp(rng.normal(size=(k, k))), np.exp(rng.normal(size=k))
    active = np.array([2, 2, 2, 1, 1])  # the second window has three words
    counts = np.zeros((k, k))
    got = forward_backward(emit, active, move, first, counts)
    want, moves = np.zeros((steps, 2, k)), np.zeros((k, k))
    for w, n in ((0, 5), (1, 3)):
        total, held, pairs = 0.0, np.zeros((steps, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            p = first[path[0]] * np.prod([np.exp(emit[t, w, y]) for t, y in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            total += p
            for t, y in enumerate(path):
                held[t, y] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        want[:, w] = held / total
        moves += pairs / total
    assert np.allclose(got[:, 0], want[:, 0]) and np.allclose(got[:3, 1], want[:3, 1]) and np.allclose(counts, moves)


def test_gradient_of_the_likelihood():
    # expected counts are the derivative of the log of the sum over paths
    rng = np.random.default_rng(5)
    k, steps = 3, 4
    emit, move, first = rng.normal(size=(steps, 1, k)), rng.normal(size=(k, k)), rng.normal(size=k)

    def log_sum(emit, move, first):
        a = first + emit[0, 0]
        for t in range(1, steps):
            a = np.log(np.exp(a[:, None] + move).sum(axis=0)) + emit[t, 0]
        return np.log(np.exp(a).sum())

    counts = np.zeros((k, k))
    labels = forward_backward(emit, np.full(steps, 1), np.exp(move), np.exp(first), counts)
    step = 1e-6
    for i, j in itertools.product(range(k), repeat=2):
        moved = move.copy()
        moved[i, j] += step
        assert (log_sum(emit, moved, first) - log_sum(emit, move, first)) / step == pytest.approx(counts[i, j], abs=1e-4)
    for t, j in itertools.product(range(steps), range(k)):
        moved = emit.copy()
        moved[t, 0, j] += step
        assert (log_sum(moved, move, first) - log_sum(emit, move, first)) / step == pytest.approx(labels[t, 0, j], abs=1e-4)


def test_language_cases(spark):
    en, fr = "the cat and the dog of the house ", "le chat et le chien de la maison "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr", 0.5) for i in range(60)]
    odd = [(100, None, "en", 0.5), (101, "", None, 0.5), (102, "12 34 !!", "fr", 0.5), (None, en, "en", 0.5), (103, en * 5000, None, 0.5), (3, rows[3][1], "en", 0.5), (104, en * 20 + fr * 3, None, 0.5)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    got = identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == UNKNOWN and by_id[i].score == 0 for i in (100, 101, 102))
    assert by_id[103].lang_pred == by_id[104].lang_pred == by_id[None].lang_pred == "en" and not by_id[None].held_out
    assert all(by_id[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert {r.lang_pred for r in identify(df.withColumn("lang", df.lang.substr(9, 1)).filter("lang IS NULL")).collect()} == {UNKNOWN}
    assert identify(df.limit(0)).collect() == []


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = L.table(spark, sf, "documents")
    kept = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        kept[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
    before = {r.doc_id: r for r in L.table(spark, sf, "documents").collect()}
    assert kept["language"].columns == P.COLUMNS and kept["language"].count() >= 0.99 * len(before)
    unique = kept["near_copies"].collect()
    sets = {r.doc_id: shingles(r.text) for r in unique}
    assert len(sets) == len(unique)
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j)
    want = {i: (n, g, k) for i, n, g, k in plain_removal([(r.doc_id, r.text) for r in unique], 35)}
    left = {r.doc_id: r for r in kept["passages"].collect()}
    assert set(left) == {i for i, (n, g, _) in want.items() if n > g}
    assert all(left[i].text == (want[i][2] if want[i][1] else sets and next(r.text for r in unique if r.doc_id == i)) for i in left)
    assert kept["secrets"].count() == len(left) and all(r.n_chars == len(r.text) for r in kept["secrets"].collect())
    assert {r.doc_id for r in kept["packing"].collect()} == set(left)


def test_pipeline_on_nothing(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, None, None, None, None), (None, "text", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame_of in (docs, docs.limit(0)):
        out = frame_of
        for _, stage in P.STAGES:
            out = stage(spark, out, "")
        assert out.collect() == []


def test_languages_whose_rows_repeat(spark):
    """A language is sampled by itself and an id counts once, so that one id with thousands of rows takes no other's place."""
    rng = random.Random(8)
    kinds = {"en": "the house with this water and thing", "fr": "une maison avec cette eau et chose", "de": "ein Haus mit diesem Wasser und Ding"}
    text = lambda lang: " ".join(rng.choice(kinds[lang].split()) for _ in range(30))
    rows = [(i, text("en"), "en") for i in range(100)] + [(1000 + i, text("fr"), "fr") for i in range(100)]
    learned = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows += [(learned, text("de"), "de")] * 4000
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert len(got) == 4200 and all(r.lang_pred == want[r.doc_id] for r in got)


def test_languages_learned_are_bounded(spark, monkeypatch):
    from millrace.llm import language

    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, "the water and this house", "en") for i in range(30)] + [(100 + i, "une maison avec cette eau", "fr") for i in range(20)] + [(200 + i, "x y", f"dirt {i}") for i in range(40)]
    assert {r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"en", "fr"}
