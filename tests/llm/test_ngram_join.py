import re

import pytest

from tidewatch.llm import common, ngram_join, shingles
from tests.llm import tables


def brute(rows, width, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])

    sets = [(d, shingle(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(named):
        for b, t in named[:i]:
            both = len(s & t)
            if den * both >= num * (len(s) + len(t) - both) and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_components_equal_brute_force(spark, width, num, den):
    got = ngram_join.similarity_components(tables.documents(spark), ngram_join.Similarity(width, num, den)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(tables.texts(), width, num, den)


def test_chain_of_near_copies_and_hot_group(spark):
    rng = tables.random.Random(1)
    text = tables.prose(rng, 300)
    rows = []
    for k in range(60):
        rows.append((k, text))
        words = text.split(" ")
        words[rng.randrange(300)] = f"n{k}"
        text = " ".join(words)
    rows += [(1000 + k, rows[0][1]) for k in range(50)]
    got = ngram_join.similarity_components(tables.documents(spark, rows), ngram_join.Similarity(3, 90, 100)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 90, 100))


def test_empty_table(spark):
    assert ngram_join.similarity_components(tables.documents(spark, [])).count() == 0


def test_sketch_distance_never_exceeds_difference():
    rng = tables.random.Random(2)
    for _ in range(30):
        text = tables.prose(rng, 500)
        a, b = shingles.shingle_set(text, 3), shingles.shingle_set(tables.changed(rng, text, 0.05), 3)
        x, y = (ngram_join.parity(ngram_join.mix(h)) for h in (a, b))
        distance = sum(int(v).bit_count() for v in x ^ y)
        assert distance <= len(set(a.tolist()) ^ set(b.tolist()))


def test_connected_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 102), (102, 100), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.component for r in common.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 104), 100)}


def test_common_passage_opens_no_buckets_and_long_near_copies_link(spark):
    rng = tables.random.Random(3)
    passage = tables.prose(rng, 60)
    rows = [(k, tables.prose(rng, 90) + " " + passage + " " + tables.prose(rng, 90)) for k in range(150)]
    long = tables.prose(rng, 9000)
    rows += [(500 + k, tables.changed(rng, long, s)) for k, s in enumerate((0.0, 0.01, 0.02, 0.03, 0.04, 0.3))]
    for width, num, den in ((3, 90, 100), (5, 8, 10)):
        got = ngram_join.similarity_components(tables.documents(spark, rows), ngram_join.Similarity(width, num, den)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, width, num, den))


def test_join_groups_spreads_hot_groups(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    groups = rows.groupBy("k").agg(ngram_join.F.min("id").alias("first"), ngram_join.F.count("*").alias("size_"))
    got = {r.id: r.first for r in common.join_groups(rows, groups, ["k"]).collect()}
    assert got == {k: (0 if k % 3 == 0 else 7 if k == 7 else k) for k in range(5000)} | {7: 0}
