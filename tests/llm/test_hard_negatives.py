import numpy as np
import pytest

from tidewatch.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, band int, path string, block int, v string, n int"


def brute(rows):
    one = {}
    sizes = [len(e) for _, e, _ in rows if e]
    dim = max(set(sizes), key=sizes.count) if sizes else 0
    for d, e, y in rows:
        if d is None or y is None or not e or len(e) != dim or any(x is None or not np.isfinite(x) for x in e):
            continue
        y = (y + 1) % 10 if d % 7 == 0 else y
        own = (y, [int(np.floor(256 * x)) for x in e])
        one.setdefault(d, own)
    out = set()
    for a in (d for d in one if d % 50 == 0):
        score = {d: sum(x * y for x, y in zip(one[a][1], v, strict=True)) for d, (_, v) in one.items() if d != a}
        order = sorted(score, key=lambda d: (-score[d], d))
        for p in [d for d in order if one[d][0] == one[a][0]][:5]:
            inside = [d for d in order if one[d][0] != one[a][0] and 50 * score[p] <= 100 * score[d] <= 95 * score[p]]
            out |= {(a, p, k + 1, d, score[p], score[d]) for k, d in enumerate(inside[:3])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, e, y, 1, "p", 2, "v", 3) for d, e, y in rows], SCHEMA)


def shown(df):
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clustered(n=1500, dim=12, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim)) * 2
    x = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, dim)) * 0.2
    x[200:330] = x[200]
    y = np.where(rng.random(n) < 0.4, 3, rng.integers(0, labels, n))
    return [(int(k), [float(v) for v in x[k]], int(y[k])) for k in rng.permutation(n)]


def test_equal_brute_force_with_copies_and_odd_rows(spark):
    rows = clustered()
    nan, inf = float("nan"), float("inf")
    odd = [(5000, None, 1), (5050, [nan] * 12, 1), (5100, [None] + [1.0] * 11, 1), (5150, [inf] * 12, 2), (5200, [0.0] * 12, 2), (5250, [1.0] * 12, None), (None, [1.0] * 12, 1), (5300, [1.0] * 3, 1), (5350, [], 1), (5400, [-0.001] * 12, 0)]
    rows += [*odd, rows[3], rows[3]]
    assert shown(hn.hard_negatives(frame(spark, rows), leaf=60, group=4)) == brute(rows) != set()


def test_random_vectors_and_defaults(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=8)], int(rng.integers(0, 10))) for k in range(900)]
    assert shown(hn.hard_negatives(frame(spark, rows))) == brute(rows) != set()


def test_huge_components_and_few_rows(spark):
    big = [(0, [3e6, 1e6], 0), (1, [2.9e6, 1e6], 1), (2, [1.5e6, 1e6], 2), (3, [1.4e6, 0.5], 2), (50, [-1.0, 0.0], 1), (51, [0.0, 0.0], 3)]
    assert shown(hn.hard_negatives(frame(spark, big))) == brute(big) != set()
    assert hn.hard_negatives(frame(spark, [])).count() == 0
    assert hn.hard_negatives(frame(spark, [(50, [1.0], 1)])).count() == 0


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, c = rng.integers(-300, 300, (9, 6)).astype(float), rng.integers(-300, 300, (7, 6)).astype(float)
        least, most = hn.bounds(*(x[None] for x in (a.min(0), a.max(0), c.min(0), c.max(0))))
        s = hn.products(a, c)
        assert least[0] <= s.min() and s.max() <= most[0]
    assert hn.products(np.array([[2.0**60, 1.0]]), np.array([[8.0, 1.0], [-8.0, 0.0], [1.0, 1.0]])).tolist() == [[hn.MOST, hn.LEAST, 2**60 + 1]]
    # clusters far apart: a group of anchors meets few leaves
    rows = frame(spark, clustered(3000, 6, 2, 7)).selectExpr("vec_id", "CAST(label AS bigint) AS label", "embedding AS e")
    coded = rows.mapInArrow(hn._pack(6), "vec_id bigint, label bigint, v binary")
    planes = hn.Planes(hn.unpacked([bytes(r.v) for r in coded.select("v").collect()], 6), 6)
    coded = coded.mapInArrow(hn._route(planes, 6), "vec_id bigint, label bigint, v binary, full string")
    leaves = hn.leaf_boxes(hn.in_leaves(coded, 50), 6, "c")
    anchors = hn.in_leaves(coded.where("vec_id % 50 = 0"), 4)
    groups = hn.leaf_boxes(anchors, 6, "a")
    floor = hn.F.lit(256 * 256 * 22).cast("bigint").alias("floor")
    pairs = hn.leaf_pairs(groups.select("*", floor, hn.F.lit(hn.MOST).alias("ceiling")), leaves, same=True)
    everything = groups.alias("g").join(leaves.alias("c"), "label").count()
    assert 0 < pairs.count() < everything / 2


def test_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = set(map(tuple, duckdb.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hn.OP11_SQL})").fetchall()))
    assert shown(hn.op11_hard_negatives(spark, folder)) == want
