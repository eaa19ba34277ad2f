from __future__ import annotations

import random
from collections import Counter as Bag

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ngram_join, url_rules, vector_topk
from gridloom.llm.components import components
from gridloom.llm.queries import URL_RULES

from .test_text import words


def shingles(t, n=5):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_join(rows, similar=0.8):
    """class and links by position."""
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]) - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = Bag()
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[key, min(ids) if ids else None, links[i]] += 1
    return out


def near_group(seed, n, size):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(size)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(size)] = "".join(rng.choices("xyz", k=5))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_ngram_join(spark, docs, corpus, no_docs, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(i, t) for i, t, *_ in corpus] + [(1000 + i, t) for i, t in enumerate(near_group(1, 30, 120) + near_group(2, 5, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = Bag(tuple(r) for r in ngram_join.ngram_join(df, recall=0.9999999).collect())
    assert got == brute_join(rows)


def test_ngram_join_of_nothing(spark, no_docs):
    assert ngram_join.ngram_join(no_docs).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_join(one).collect())) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_one_document_of_each_class_stays(spark, docs, corpus):
    kept = ngram_join.without_near_copies(docs.withColumn("_key", F.lit(3)))
    assert kept.columns == [*docs.columns, "_key"]
    got = Bag(r.doc_id for r in kept.collect())
    classes = {}
    for key, cls, _ in brute_join([(i, t) for i, t, *_ in corpus]):
        classes[key] = cls
    texts = {i: t for i, t, *_ in corpus}
    want = Bag({cls for key, cls in classes.items() if words(texts[key])} - {None})
    want.update(i for i, t, *_ in corpus if not words(t))
    assert got == want


def test_bands_reach_the_recall():
    n = ngram_join.bands_for(0.8, 5, 0.9995)
    assert 1 - (1 - 0.8**5) ** n >= 0.9995 > 1 - (1 - 0.8**5) ** (n - 1)


def test_minhash_estimates():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 400, np.uint64)
    a, b = np.sort(both[:360]), np.sort(np.concatenate([both[40:], rng.integers(0, 1 << 63, 0, np.uint64)]))
    jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (ngram_join.band_hashes(a, 2000, 1) == ngram_join.band_hashes(b, 2000, 1)).mean()
    assert abs(same - jaccard) < 0.05


@pytest.mark.parametrize("n", [3, 20])
def test_common_grams(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(n)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert ngram_join.common_grams(sets, sets).tolist() == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"{a:03d}", f"{b:03d}") for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(60))] + [(f"{i:03d}", f"{i + 1:03d}") for i in range(200, 260)] + [("500", "500"), (None, "1"), ("200", "201")]
    label = {x: x for e in edges for x in e if x and None not in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a and b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "u string, v string")).collect()} == label
    assert components(spark.createDataFrame([], "u string, v string")).collect() == []


PAGES = [
    (1, "http://a.com/en/1", '<link rel="canonical" href="http://b.org/x">'), (2, "http://b.org/x#f", "<p>"), (3, "http://c.org/y", '<META http-equiv=refresh content="0; URL=//b.org/x">'),
    (4, "http://d.org/z", "<link href=http://www.example.com/en/77 rel=canonical>"), (5, "http://e.com/en/2", '<link rel="canonical" href="http://d.org/z">'), (6, None, None), (7, "nope", "canonical"), (8, "http://B.org/x", None),
    (8, "http://B.org/x", None), (9, "http://f.de/a", '<link rel="canonical" href="/b">'), (None, "https://x.example.net/de/8?q#f", ""), (10, "ftp://com/en/", ""), (11, "://net/de/x", ""), (12, "http://xcom/en/", ""), (13, "http://f.de/b", ""),
]
JUDGED = {1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: ("com/en/", "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow"), None: ("example.net/de/8", "block"), 10: ("com/en/", "block"), 11: ("net/de/", "block"), 12: (None, "allow"), 13: (None, "allow")}


@pytest.mark.parametrize("inline", [64, 0])
def test_url_rules(spark, inline, monkeypatch):
    monkeypatch.setattr(url_rules, "INLINE", inline)
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, Verdict string")
    rows = url_rules.judge_urls(pages, URL_RULES).collect()
    assert len(rows) == len(PAGES)
    assert {r.page_id: (r.rule, r.verdict) for r in rows} == JUDGED
    assert {r.page_id: (r.host, r.path) for r in rows}[None] == ("x.example.net", "/de/8")
    redirects = spark.createDataFrame([("http://f.de/b", "http://b.org/x"), (None, "http://q.de/")], "src string, dst string")
    more = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, URL_RULES, redirects=redirects).collect()}
    assert more[13] == more[9] == "block"
    assert url_rules.judge_urls(pages.limit(0), URL_RULES).collect() == []


def brute_top(rows, k):
    out = []
    for i, (q, v) in enumerate(rows):
        if q is not None and q % 20 == 0 and sound(v):
            scores = sorted((-sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(v, w, strict=True)), c) for j, (c, w) in enumerate(rows) if j != i and c is not None and sound(w) and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return Bag(out)


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 16])
def test_vector_topk(spark, block, monkeypatch):
    monkeypatch.setattr(vector_topk, "BLOCK", block)
    monkeypatch.setattr(vector_topk, "QUERIES", max(2, block // 4))
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) / 3]) for i in range(130)]
    rows += [(20, rows[20][1]), (200, rows[3][1]), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (220, [float("inf")] + [0.0] * 5), (240, [1.0, 2.0]), (241, [3.0, -1.0]), (None, rows[0][1]), (260, [0.0] * 6), (261, [0.0] * 6), (280, [1e5] * 6)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    assert Bag(tuple(r) for r in vector_topk.top_k(df, k=7).collect()) == brute_top([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b]) for a, b in rows], 7)
    assert vector_topk.top_k(df.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_vector_cells_of_any_width_give_equal_results(spark, bits, monkeypatch):
    monkeypatch.setattr(vector_topk, "BLOCK", 64)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * 10.0 ** rng.integers(-1, 7)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert Bag(tuple(r) for r in vector_topk.top_k(df, k=7, bits=bits).collect()) == brute_top(rows, 7)


def test_bounds_hold():
    rng = np.random.default_rng(9)
    for scale in (3, 300, 10**7, 10**9):
        q, m = rng.integers(-scale, scale, (20, 7)), rng.integers(-scale, scale, (50, 7))
        for bits in (1, 4, 8):
            lower, upper = vector_topk.bounds(q, *vector_topk._cells(m, bits))
            exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in m] for x in q], dtype=object)
            assert (lower <= exact).all() and (exact <= upper).all()


def test_recall_of_the_default_bands(spark):
    """Pairs of Jaccard indices from 0.80 to 0.85: replaced words of long texts, each text with one partner."""
    rng, rows, pairs = random.Random(12), [], 0
    while pairs < 600:
        base = ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(rng.randint(150, 400))]
        other = base[:]
        for p in rng.sample(range(5, len(base) - 5), round(len(base) * rng.uniform(0.016, 0.023))):
            other[p] = "changed" + str(rng.random())[2:8]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.class_id == r.doc_id - 1 and r.n_links == 1 for r in got if r.doc_id % 2) >= 0.99 * pairs


def test_threshold_is_the_decimal(spark):
    a = [f"w{i}" for i in range(1000 + 4)]
    b = [*a[:902], *(f"x{i}" for i in range(102))]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    index = len(shingles(rows[0][1]) & shingles(rows[1][1])) / len(shingles(rows[0][1]) | shingles(rows[1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for similar, links in ((round(index - 0.0002, 5), 1), (round(index + 0.0002, 5), 0)):
        assert [r.n_links for r in ngram_join.ngram_join(df, similar=similar, recall=0.9999).collect()] == [links, links], (index, similar)


def test_long_grams_and_many_rows(spark):
    rows = [(1, " ".join(map(str, range(100)))), (2, " ".join(map(str, range(1, 101)))), (3, "other words")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=20, rows=17, recall=0.9).collect()
    assert len(got) == 3
    assert ngram_join.gram_set(rows[0][1], 20, ngram_join.WordHashes()).shape == (81,)
