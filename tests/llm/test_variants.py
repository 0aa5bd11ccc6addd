"""Hard negatives, SimHash groups and spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import connect, same

from millrace.llm import hard_negatives as H
from millrace.llm import queries as L
from millrace.llm import simhash as S
from millrace.llm import spelling as W


@pytest.mark.parametrize("size", [10, 300, 2**20, 2**31, 2**52, 1e300])
@pytest.mark.parametrize("dim", [1, 3, 64, 1500])
def test_scores_are_exact_at_any_size(size, dim):
    rng = np.random.default_rng(dim)
    a, b = (np.floor(rng.normal(size=(n, dim)) * size) for n in (4, 5))
    ends = lambda x: max(1 - 2**63, min(2**63 - 1, x))
    assert H.scores(a, b).tolist() == [[ends(sum(int(x) * int(y) for x, y in zip(r, s))) for s in b] for r in a]


VECTORS = "vec_id long, embedding array<float>, label int, score int, v string, is_anchor string"


def mined(rows, anchors=50):
    """Negatives by a loop over (vec_id, vector, label)."""
    kept = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(256 * np.float32(x).astype(float))) for x in v]
            kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in kept.items():
        if a % anchors == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, u)), i, lab) for i, (lab, u) in kept.items() if i != a and len(u) == len(v))
            for p, i, _ in [s for s in scored if s[2] == label][:5]:
                fits = [(j, -n) for n, j, lab in scored if lab != label and 50 * -p <= 100 * -n <= 95 * -p]
                out += [(a, i, r, j, -p, n) for r, (j, n) in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("sent", [H.BROADCAST_BYTES, 0])
def test_hard_negatives(spark, monkeypatch, sent):
    monkeypatch.setattr(H, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(H, "BLOCK", 37)
    monkeypatch.setattr(H, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [round(float(x), 2) for x in rng.normal(size=4)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(300, [1.0, 1.0, 1.0, 1.0], 0), (301, [1.0, 1.0, 1.0, 1.0], 1), (302, [1.0, 1.0, 1.0, 1.0], 0)]  # ties
    rows += [(50, rows[50][1], 2), (50, rows[50][1], 2), (7, [9.0, 9.0, 9.0, 9.0], 1)]  # repeated ids
    rows += [(None, rows[1][1], 0), (400, None, 1), (450, [], 1), (500, rows[2][1], None), (550, [1.0, None, 2.0, 3.0], 1), (600, [float("nan"), 1.0, 1.0, 1.0], 0)]
    rows += [(650, [1.0, 2.0], 5), (651, [2.0, 2.0], 5), (652, [1.5, 1.0], 6), (700, [0.0] * 4, 0), (750, [-1.0] * 4, 9)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS).repartition(3)
    assert sorted(tuple(r) for r in H.hard_negatives(df).collect()) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    assert H.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert H.hard_negatives(spark.createDataFrame([(50, [1.0], 1, 1, "x", "y")], VECTORS)).collect() == []


def test_hard_negatives_agree_with_sql(spark, sf):
    same(L.op11_hard_negatives(spark, sf), connect(sf).sql(L.ORACLE["op11_hard_negatives"]))


def simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(rows, most=4):
    """(doc_id, hex, component) of (doc_id, fingerprint) by all pairs."""
    kinds = np.array(sorted({f for _, f in rows}), np.uint64)
    root = list(range(len(kinds)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kinds)):
        for j in np.flatnonzero(np.bitwise_count(kinds[i] ^ kinds[:i]) <= most).tolist():
            root[max(find(i), find(j))] = min(find(i), find(j))
    place = {f: find(i) for i, f in enumerate(kinds.tolist())}
    least = {}
    for d, f in rows:
        if d is not None:
            least[place[f]] = min(d, least.get(place[f], d))
    return sorted(((d, f"{f:016x}", least.get(place[f])) for d, f in rows), key=str)


def test_simhash_groups_of_texts(spark, sf):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(500)]
    base = rng.choice(vocabulary, 300).tolist()
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE  TWO\x0bthree Four", "ÄÖ äö É", "x " * 20000, " ".join(rng.choice(vocabulary, 30000))]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, 300)] = str(rng.choice(vocabulary))
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice(vocabulary, 40)) for _ in range(60)]
    rows = [*enumerate(texts), (None, texts[12]), (None, "by itself without id"), (12, texts[12]), (12, texts[80])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, fp string, n int, least int").repartition(3)
    want = grouped([(d, simhash(t)) for d, t in rows])
    assert sorted((tuple(r) for r in S.simhash_groups(df).collect()), key=str) == want
    assert len({r[2] for r in want}) < len(texts) - 15
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in L.op12_simhash(spark, sf).collect()), key=str) == grouped([(r[0], simhash(r[1])) for r in docs])
    assert S.simhash_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [S.BLOCK, 64])
@pytest.mark.parametrize("most", [0, 1, 4, 7])
def test_links_of_crowded_fingerprints(spark, monkeypatch, block, most):
    """Crowds around centres: values that many share, buckets cut into blocks, thresholds that differ."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "CHUNK", 1 << 12 if block == 64 else S.CHUNK)
    rng = np.random.default_rng(most)
    found = set()
    for centre in rng.integers(0, 2**64, 30, dtype=np.uint64).tolist():
        for _ in range(int(rng.integers(1, 100))):
            found.add(centre ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))}))
    fps = np.array(sorted(found), np.uint64)
    df = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long").repartition(3)
    groups, counts, n = S.statistics(df)
    assert n == len(fps) and sorted(groups.ravel().tolist()) == list(range(64)) and counts.sum() == S.PARTS * n
    edges = S.links(df, groups, counts, most).collect()
    root = {x: x for x in fps.view(np.int64).tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        assert (r.a ^ r.b) != 0
        root[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
    ours, wanted = defaultdict(set), defaultdict(set)
    for x in root:
        ours[find(x)].add(x)
    for x, _, c in grouped([(i, f) for i, f in zip(fps.view(np.int64).tolist(), fps.tolist())], most):
        wanted[c].add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, wanted.values()))


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(0)
    costs = rng.integers(0, 50, (200, 4, 3)).astype(float)
    for most in (0, 2, 4, 11):
        t = S.allocation(costs, most)
        assert ((t + 1).sum(axis=1) == most + 1).all()
        price = lambda row, c: sum(c[g, x] for g, x in enumerate(row) if x >= 0)
        every = [r for r in np.ndindex(4, 4, 4, 4) if sum(r) == most + 1]
        for row, c in zip(t.tolist(), costs):
            assert price(row, c) == min(price([x - 1 for x in r], c) for r in every)


def variants(rows, shed=97):
    """(word, form, root, n, n_near, form_n) of (doc_id, text) by deletions."""
    lower = str.maketrans(W.UPPER, W.LOWER)
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % shed == 0 else run] += 1
    n = {w: x for w, x in counts.items() if len(w) >= 5 and x >= 3}
    rest, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest[w[:i] + w[i + 1 :]].add((i, w))
    for less, longer in rest.items():
        for i, w in longer:
            if less in n:
                near[less].add(w)
                near[w].add(less)
            near[w].update(u for j, u in longer if i == j and u != w)
    form = {w: min(near[w], key=lambda u: (-n[u], u)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("block, classes, tile", [(W.BLOCK, 2, W.TILE), (5, 4, 2)])
def test_spelling_variants(spark, monkeypatch, block, classes, tile):
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "TILE", tile)
    monkeypatch.setattr(W, "VERIFIED", 3 if block == 5 else W.VERIFIED)
    monkeypatch.setattr(W, "classes_for", lambda n: classes)
    rng = np.random.default_rng(1)
    letters = list("abcdeéÿÀz")
    words = ["".join(rng.choice(letters, rng.integers(4, 8))) for _ in range(24)]
    for w in list(words):
        for _ in range(3):
            at = int(rng.integers(0, len(w)))
            words.append([w[:at] + w[at + 1 :], w[:at] + str(rng.choice(letters)) + w[at:], w[:at] + str(rng.choice(letters)) + w[at + 1 :]][rng.integers(0, 3)])
    chain = ["colour"] * 40 + ["colours"] * 20 + ["colourss"] * 10 + ["colourzss"] * 5 + ["tied1 tied2"] + ["abcde", "bacde"] * 3
    texts = [" ".join(rng.choice(words, 200)) for _ in range(30)] + [" ".join(chain), None, "", "123 __", "STRASSE Strasse straße Ünter ünter x×y÷z " * 4, "q" * 30000, ("q" * 30000 + " ") * 3]
    rows = [*enumerate(texts), (None, texts[0]), (1, texts[1]), (1, texts[1])]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n int, cell string").repartition(3)
    want = variants(rows)
    assert sorted(tuple(r) for r in W.spelling_variants(df).collect()) == want
    assert sum(r[1] is not None and r[1] != r[2] for r in want) >= 2
    assert W.spelling_variants(df.limit(0)).collect() == []


def test_spelling_agrees_with_sql(spark, sf):
    same(L.op13_spelling(spark, sf), connect(sf).sql(L.ORACLE["op13_spelling"]))
