"""The Jaccard join, ranked search and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalvec.llm import clustering, jaccard, lexical, queries
from zonalvec.llm.common import table

from . import helpers

DATA = "/root/testdata/sf0.001"


# -- Jaccard join ---------------------------------------------------------------------------------------------


def brute_classes(rows, shingle=3, like=(9, 10)):
    """rows (doc_id, text) -> sorted (doc_id, n, class)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and both * like[1] >= like[0] * (len(x) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found_classes(df, **how):
    return sorted((tuple(r) for r in jaccard.classes(df, **how).collect()), key=str)


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def family(seed=3):
    """Copies of a few templates with a word or more changed, and strangers that share most of their words with all."""
    rng = random.Random(seed)
    core = [f"c{i}" for i in range(150)]
    texts = []
    for f in range(3):
        base = core[: 60 * f] + [f"t{f}x{i}" for i in range(200 - 60 * f)]
        texts += [edited(base, rng.randrange(7), rng) for _ in range(40)]
    texts += [" ".join(core) + " " + " ".join(f"u{k}x{i}" for i in range(6)) for k in range(30)]
    return texts + [" ".join(f"s{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 120))) for _ in range(40)]


@pytest.mark.parametrize("leaf, pivots", [(256, 16), (8, 3)])
def test_join_is_exact(spark, monkeypatch, leaf, pivots):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "DEALT", 30)
    rows = list(enumerate(family()))
    expected = brute_classes(rows)
    assert 10 < sum(d != c for d, _, c in expected) < len(rows)
    df = helpers.documents(spark, [t for _, t in rows])
    assert found_classes(df) == expected
    assert found_classes(df.repartition(5)) == expected


def test_join_of_other_shingles(spark):
    rows = list(enumerate(family(8)))
    assert found_classes(helpers.documents(spark, [t for _, t in rows]), shingle=5, like=(4, 5)) == brute_classes(rows, 5, (4, 5))


def test_sizes_around_the_bound_of_whole_lists(spark):
    rng = random.Random(1)
    texts = []
    for n in range(58, 84):
        words = [f"n{n}x{i}" for i in range(n)]
        texts += [" ".join(words), edited(words, 1, rng), edited(words, 2, rng), " ".join(words[:-3])]
    rows = list(enumerate(texts))
    assert found_classes(helpers.documents(spark, texts)) == brute_classes(rows)


def test_join_defined_cases(spark):
    texts = helpers.tricky_texts()
    assert found_classes(helpers.documents(spark)) == brute_classes(list(enumerate(texts)))
    rows = [(r.doc_id, r.text) for r in helpers.repeated(spark).collect()]
    assert found_classes(helpers.repeated(spark)) == brute_classes(rows)
    nameless = helpers.documents(spark, ["a b c d", "A b c d", "x"], [None, None, None])
    assert found_classes(nameless) == [(None, 1, None), (None, 2, None), (None, 2, None)]
    assert found_classes(helpers.empty(spark)) == []


def test_join_query(spark):
    df = queries.QUERIES["op11_jaccard_join"](spark, DATA)
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute_classes(rows)


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    for some in (sets, sets[:2]):
        expected = np.array([[len(np.intersect1d(a, b)) for b in some] for a in some])
        assert (np.triu(jaccard.common(some), 1) == np.triu(expected, 1)).all()


# -- ranked search ----------------------------------------------------------------------------------------------


def brute_search(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n, length, df = len(own), sum(sum(c.values()) for _, c in own), Counter(t for _, c in own for t in c)
    out = []
    for item, text in sorted(items.items()):
        found = []
        for d, c in own:
            m = 25 + (75 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            found.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:top]) if s]
    return out


def searched(docs, items, **how):
    return sorted(tuple(r) for r in lexical.ranked(docs, items, **how).collect())


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, rank int, score long")


def test_search_is_exact(spark):
    rng = random.Random(2)
    vocabulary = [f"v{int(200 * rng.random() ** 3)}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(300)]
    items = {k: " ".join(rng.choices(vocabulary, k=k + 1)) for k in range(0, 100, 9)}
    rows, asked = helpers.documents(spark, [t for _, t in docs]), items_of(spark, [(k, t, 1, 2) for k, t in items.items()])
    expected = brute_search(docs, items)
    assert searched(rows, asked) == expected
    assert searched(rows.repartition(7), asked, block=16, block_terms=30) == expected


def test_search_defined_cases(spark):
    texts = [*helpers.tricky_texts(), "alpha beta", "ALPHA-beta", "gamma"]
    ids = [*range(len(texts) - 3), 3, 3, None]
    items = [(1, "alpha Beta alpha"), (2, None), (None, "alpha"), (3, "  "), (4, "unknown"), (5, "gamma naïve"), (1, "zzz")]
    asked = {1: "alpha Beta alpha", 5: "gamma naïve"}
    got = searched(helpers.documents(spark, texts, ids), items_of(spark, [(i, t, 0, 0) for i, t in items]))
    assert [(i, k, d if d is not None else -1, s) for i, k, d, s in got] == [(i, k, d if d is not None else -1, s) for i, k, d, s in brute_search(list(zip(ids, texts)), asked)]
    assert searched(helpers.empty(spark), items_of(spark, [(1, "alpha", 0, 0)])) == []
    assert searched(helpers.documents(spark), items_of(spark, [])) == []


def test_groups_below_the_best_are_not_scored(spark):
    """Of a block whose best documents hold all terms, only their group is evaluated."""
    sizes, terms = [3] * 500, [np.array([0, 1, 2] if i < 20 else [i % 3], np.int32).tobytes() for i in range(500)]
    counts = [np.ones(len(t) // 4, np.int32).tobytes() for t in terms]
    block = lexical.Block(list(range(500)), sizes, terms, counts, np.array([500, 400, 300]), 500, 1500)
    looked_at = []
    block.postings = {t: (_Watched(w, looked_at), p) for t, (w, p) in block.postings.items()}
    best = block.search([(0, 1), (1, 1), (2, 1)], [(-(10**12), False, k) for k in range(10)], 10)
    assert [b[2] for b in best] == list(range(10)) and not looked_at


class _Watched(np.ndarray):
    """Postings that note when documents are looked up in them."""

    def __new__(cls, values, seen):
        out = np.asarray(values).view(cls)
        out.seen = seen
        return out

    def __array_finalize__(self, obj):
        self.seen = getattr(obj, "seen", [])

    def searchsorted(self, *a, **k):
        self.seen.append(a)
        return np.asarray(self).searchsorted(*a, **k)


# -- clustering -------------------------------------------------------------------------------------------------


def brute_clusters(rows, clusters=40, rounds=5, salt="2"):
    v = {i: np.array([math.floor(256 * float(x)) for x in e], object) for i, e in rows}
    first = sorted(v, key=lambda i: hashlib.sha256(f"{salt}:{i}".encode()).hexdigest())[:clusters]
    centres = [v[i].copy() for i in first]
    near = lambda x: min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = {i: near(x)[1] for i, x in v.items()}
        for j in range(len(centres)):
            members = [v[i] for i in own if own[i] == j]
            if members:
                centres[j] = np.array([s // len(members) for s in sum(members)], object)
    found = {i: near(x) for i, x in v.items()}
    inertia = Counter()
    for d, j in found.values():
        inertia[j] += d
    digest = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centres]
    return sorted((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, (d, j) in found.items())


def clustered(df, **how):
    return sorted((tuple(r) for r in clustering.described(*clustering.fit(clustering.whole(df), **how)).collect()), key=str)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, cluster int, key double, was int")


def test_clusters_query(spark):
    df = queries.QUERIES["op13_centroid_clustering"](spark, DATA)
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").collect()]
    assert sorted(tuple(r) for r in df.collect()) == brute_clusters(rows)


def test_few_vectors_are_rescanned_when_clusters_are_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(64)[i % 8] * 20 + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(400)]
    watched: list = []
    found, centres = clustering.fit(clustering.whole(vectors_of(spark, rows)), 12, 4, "x", watched)
    assert sorted(tuple(r) for r in clustering.described(found, centres).collect()) == brute_clusters(rows, 12, 4, "x")
    assert watched[0] == 400 and sum(watched[2:]) < 400 * 2


def test_ties_and_repeats(spark):
    """Equal vectors make equal centroids and empty clusters; all gaps are ties."""
    rows = [(i, [float(i % 3)] * 64) for i in range(60)]
    assert clustered(vectors_of(spark, rows)) == sorted(brute_clusters(rows), key=str)
    assert clustered(vectors_of(spark, rows).repartition(6), clusters=3, rounds=2) == sorted(brute_clusters(rows, 3, 2), key=str)


def test_vectors_that_are_left_out(spark):
    good = [(i, [math.sin(i * 64 + k) for k in range(64)]) for i in range(5)]
    bad = [(90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 65), (94, [1.0] * 63 + [None]), (95, [1.0] * 63 + [math.nan]), (96, [1.0] * 63 + [math.inf]), (97, [-math.inf] + [1.0] * 63)]
    kept = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    assert clustered(vectors_of(spark, good + bad)) == sorted(brute_clusters(kept), key=str)
    assert clustered(vectors_of(spark, bad)) == []
    assert clustered(vectors_of(spark, [])) == []
    nameless = clustered(vectors_of(spark, [*good, (None, good[2][1]), (2, good[2][1])]))
    assert len(nameless) == 7 and [r[0] for r in nameless].count(None) == 1
    assert clustered(vectors_of(spark, [(None, good[0][1])])) == []
    with pytest.raises(Exception, match="too large"):
        clustering.whole(vectors_of(spark, [(1, [1e9] * 64)])).collect()


def test_distances_are_exact():
    v = np.array([[clustering.LARGEST - 1] * 64, [3] * 64])
    c = np.array([[-clustering.LARGEST] * 64, [1] * 64])
    assert clustering.distances(v, c).tolist() == [[64 * (2 * clustering.LARGEST - 1) ** 2, 64 * (clustering.LARGEST - 2) ** 2], [64 * (clustering.LARGEST + 3) ** 2, 256]]


def test_columns_of_runs(spark):
    rows = vectors_of(spark, [(i, [float(i)] * 64) for i in range(30)])
    run = clustering.scanned(clustering.whole(rows).withColumn("was", F.lit(-1)), np.array([[0] * 64, [2560] * 64]), np.array([5.0, 7.0]))
    assert run.filter("key < case cluster when 0 then 5 else 7 end").count() == 0
