import numpy as np

from tidewatch.llm import vector_dedup, vector_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, v string, key bigint"


def rows(n=700, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.25).astype(np.float32)
    x[100:140] = x[100]
    out = [(k, x[k].tolist(), 0, 1, "v", 2) for k in range(n)]
    odd = [None, [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [float("inf")] * dim]
    out += [(n + 20 * (k + 1), v, 0, 1, "v", 2) for k, v in enumerate(odd)]
    return [*out, out[5], (None, out[6][1], 0, 1, "v", 2)], x.astype(np.float64)


def test_neighbours_equal_brute_force(spark):
    data, x = rows()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.nearest(spark.createDataFrame(data, SCHEMA)).collect())
    want = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        order = [k for k in sorted(range(len(x)), key=lambda k: (-s[k], k)) if k != q][:20]
        want += [(q, j + 1, k, s[k]) for j, k in enumerate(order)]
    assert len(got) == len(want) and [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) / len(want) > 0.99
    assert vector_search.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.vec_id for r in vector_search.nearest(spark.createDataFrame(data[:3], SCHEMA)).collect()} == {1, 2}


def test_windows_alone_find_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.normal(size=(60, 64)), 40, axis=0) + rng.normal(size=(2400, 64)) * 0.15).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    hits = {(r.query_id, r.vec_id) for r in vector_search.nearest(frame, complete=False).collect()}
    s = x.astype(np.float64) @ x[::20].astype(np.float64).T
    true = {(20 * q, int(k)) for q in range(120) for k in [k for k in np.argsort(-s[:, q], kind="stable") if k != 20 * q][:20]}
    assert len(hits) == len(true) == 2400 and len(hits & true) >= 0.9 * len(true)


def test_near_duplicates_recall(spark):
    data, x = rows()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T) >= 0.9
    np.fill_diagonal(near, False)
    got = vector_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    by_id = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < len(x)}
    links = np.array([by_id[k].n_links for k in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    assert all(by_id[k].component_id == 100 or by_id[k].component_id < 100 for k in range(100, 140))
    assert all(r.kept == (r.vec_id == r.component_id) for r in by_id.values())
    alone = [r for r in got if r.vec_id is not None and r.vec_id >= len(x)]
    assert len(alone) == 5 and all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in alone)
    assert len(got) == len(data) and [r for r in got if r.vec_id is None][0].component_id is None
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_recall_without_clusters(spark):
    rng = np.random.default_rng(8)
    n, dim = 1500, 64
    a, b = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = np.concatenate([np.full(n // 2, 0.9001), np.linspace(0.9001, 0.95, n - n // 2)])[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    links = np.zeros(2 * n, int)
    for r in vector_dedup.near_duplicates(frame).collect():
        links[r.vec_id] = r.n_links
    edge = np.arange(2 * n) % n < n // 2
    assert (links <= near.sum(1)).all() and near.sum() >= 2 * n
    assert links.sum() >= 0.97 * near.sum() and links[edge].sum() >= 0.96 * near[edge].sum(), (links.sum() / near.sum(), links[edge].sum() / near[edge].sum())
