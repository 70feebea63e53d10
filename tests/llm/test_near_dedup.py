import hashlib
import itertools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
from conftest_llm import prose

from orrery.llm import _components, near_dedup as nd


def near(text, seed, share):
    r = random.Random(seed)
    w = text.split(" ")
    for i in r.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"new{r.randrange(999)}"
    return " ".join(w)


def brute(rows, threshold):
    """Groups by comparing all pairs."""
    texts = [t or "" for _, t in rows]
    doc, h, tf = nd.shingles(texts)
    counts = np.zeros(1 << nd.BITS, np.int64)
    for i in range(len(texts)):
        counts[np.unique(h[doc == i] >> np.uint32(32 - nd.BITS))] += 1
    idf = nd.idf_of(counts, len(rows))
    packs = [nd.packed(h[doc == i], tf[doc == i]) for i in range(len(texts))]
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(r[0], p) for r, p in zip(rows, packs, strict=True) if r[0] is not None], 2):
        if i != j and nd.similarity(a, b, idf) >= threshold:
            x, y = find(i), find(j)
            top[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in top if find(i) != i}


def test_groups_are_those_of_all_pairs(spark, make):
    rows = [(i, prose(i, 150)) for i in range(40)]
    rows += [(100 + i, near(rows[i % 8][1], i, 0.04)) for i in range(30)] + [(200 + i, rows[20][1]) for i in range(5)]
    got = {tuple(r) for r in nd.groups(make(rows)).collect()}
    assert got == brute(rows, nd.THRESHOLD)
    assert len(got) == 35


def test_odd_rows(spark, make, odd):
    rows = [*odd, (10, odd[0][1])]
    df = make(rows, clashing=True)
    assert {tuple(r) for r in nd.groups(df).collect()} == {(10, 1)}
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r[0] is None, r[0] or 0) for r in kept.select("doc_id").collect())
    # 7 stands on two different texts, both of which stay
    assert ids == sorted([(False, i) for i in (1, 2, 3, 4, 5, 6, 7, 7, 8, 9)] + [(True, 0)] * 2)


def plain(rows):
    """Class of every row (doc_id, text), by sets and counters of words alone: no hashes, no packing."""
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    bags = []
    for _, t in rows:
        w = words(t)
        n = min(3, len(w))
        bags.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter())
    held = Counter(g for (i, _), b in zip(rows, bags, strict=True) if i is not None for g in b)
    n = sum(i is not None for i, _ in rows)
    weight = {g: math.log((n + 1) / (c + 1)) + 0.05 for g, c in held.items()}
    names = sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: (x[0], hashlib.md5((x[1] or "").encode()).digest()))
    bag = {r: b for r, b in zip(rows, bags, strict=True)}
    top = {x: x for x in names}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, y in itertools.combinations(names, 2):
        a, b = bag[x], bag[y]
        both = sum(min(a[g], b[g]) * weight[g] for g in a.keys() & b.keys())
        either = sum(max(a[g], b[g]) * weight[g] for g in a.keys() | b.keys())
        if either and both / either >= nd.THRESHOLD:
            p, q = sorted((find(x), find(y)), key=names.index)
            top[q] = p
    return {x: find(x) for x in names}


def test_against_plain_counters(spark, make):
    line = " lorem ipsum dolor sit amet"
    rows = [(i, prose(i, 150)) for i in range(25)]
    rows += [(100 + i, near(rows[i][1], i, 0.03)) for i in range(8)]
    rows += [(2, prose(40, 120)), (30, near(prose(40, 120), 1, 0.02)), (31, near(rows[2][1], 9, 0.02)), (3, rows[3][1]), (3, rows[4][1])]  # ids on two texts
    rows += [(40, prose(41, 60) + line * 300), (41, prose(42, 60) + line * 3000), (42, prose(43, 60) + line * 290), (43, line * 300), (44, line * 640)]  # frequencies beyond a byte
    rows += [(50, "A b c d."), (51, "a B  c, d"), (52, ""), (53, None), (54, "?!"), (55, "a b"), (None, rows[0][1])]
    want = plain(rows)
    got = {(r.doc_id, r.kept_doc_id) for r in nd.groups(make(rows)).collect()}
    assert got == {(x[0], y[0]) for x, y in want.items() if x[0] != y[0]}
    assert {(42, 40), (51, 50), (30, 2), (31, 2), (3, 3)} & got == {(42, 40), (51, 50), (30, 2), (31, 2)} and not {41, 44} & {i for i, _ in got}
    kept = sorted((str(r.doc_id), r.text) for r in nd.keep_one(make(rows, clashing=True)).filter("doc_id is not null and text is not null").select("doc_id", "text").collect())
    assert kept == sorted((str(x[0]), x[1]) for x, y in want.items() if x == y and x[1] is not None)


def test_repeated_rows_differ_in_other_columns(spark):
    rows = [(1, "a b c d", "en", "z", 7), (1, "a b c d", "en", "b", 7), (1, "a b c d", None, "c", 7), (2, None, "en", "y", None), (2, None, "en", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first = [tuple(r) for r in nd.keep_one(docs).orderBy("doc_id").collect()]
    assert first == [(1, "a b c d", "en", "b", 7), (2, None, "en", "x", None)]
    assert first == [tuple(r) for r in nd.keep_one(docs.repartition(5)).orderBy("doc_id").collect()]


def test_frequencies_are_kept_whole():
    tf = np.array([1, 254, 255, 256, 70_000], np.int64)
    h = np.arange(5, dtype=np.uint32)
    a, b = nd.unpacked(nd.packed(h, tf))
    assert (a == h).all() and (b == tf).all()
    assert len(nd.unpacked(nd.packed(h[:0], tf[:0]))[0]) == 0


def test_empty(make):
    assert nd.groups(make([])).count() == 0
    assert nd.keep_one(make([])).count() == 0


def test_samples_agree_as_often_as_documents_are_alike():
    r = np.random.default_rng(3)
    h = np.sort(r.choice(2**32, 300, replace=False).astype(np.uint32))
    wa, wb = r.uniform(0.5, 3, 300), r.uniform(0.5, 3, 300)
    wa[:60], wb[60:120] = 1e-6, 1e-6
    a = nd.samples(np.zeros(300, np.int64), h, wa, 1, 4096)
    b = nd.samples(np.zeros(300, np.int64), h, wb, 1, 4096)
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.035


def test_samples_are_those_of_the_formula_in_bounded_memory():
    rng = np.random.default_rng(3)
    sizes = [1, 0, 700, 5, 0, 20_000, 3]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    h, weight, k = rng.integers(0, 2**32, len(doc), np.uint64).astype(np.uint32), rng.uniform(0.05, 5000, len(doc)), 160
    gamma, log_gamma = nd.variates()
    odd = np.random.default_rng(nd.SEED).integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    x = nd._words.mixed(h.astype(np.uint64))[:, None] * odd
    r, c = gamma[(x >> np.uint64(48)).astype(int)], log_gamma[(x >> np.uint64(32)).astype(int) % nd.TABLE]
    b = ((x >> np.uint64(8)).astype(int) % 2**24).astype(np.float32) * np.float32(2.0**-24)
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
    a = c - r * (t - b + np.float32(1))
    want = np.array([a[doc == i].min(0).view(np.uint32) if n else np.zeros(k, np.uint32) for i, n in enumerate(sizes)])
    tracemalloc.start()
    got = nd.samples(doc, h, weight, len(sizes), k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want)
    assert peak < 3.5e6  # it was 8.3 MB when each run had arrays of its own


def test_shingles_across_batches():
    texts = [prose(i, 5 + i) for i in range(20)] + ["", "a", "a b"]
    doc, h, tf = nd.shingles(texts)
    for i, t in enumerate(texts):
        _, one, n = nd.shingles([t])
        assert (h[doc == i] == one).all() and (tf[doc == i] == n).all()


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in pairs if a != b for x in (a, b)}
    got = {tuple(x) for x in _components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
