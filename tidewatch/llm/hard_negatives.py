"""Hard-negative mining by dual-tree search over anchors and candidates.

Vectors are cut by a k-d tree whose planes are fitted on a bounded sample (``SAMPLE`` rows; every row is indexed). Each label has its own
leaves: the shallowest nodes that hold ``LEAF`` candidates at most, and for anchors ``GROUP``; what no plane can part, such as copies,
is dealt into blocks by a hash. So candidates and anchors have a tree each, and every node a box of least and greatest components, from
which follows the interval of inner products that a pair of nodes can reach.

Positives: an anchor's own candidate leaf gives it a fifth score to beat. From the roots down, pairs of nodes are kept whose interval
reaches the least such score of the anchors below, so one test drops a candidate node for a whole group of anchors. Pairs of leaves are scored exactly.
Negatives: each positive asks for scores in a band. Node pairs must reach between the lowest floor and the highest ceiling
of the group's bands; then the leaf with the highest bound of each group is scored first, and its third scores raise the floors of the others.

Scoring deals anchors to candidate leaves: a task holds one leaf and streams the anchors past it, and returns at most a few rows for each
anchor and leaf. Without clusters boxes overlap and nothing is pruned; the work is then that of the anchors against all rows in blocks.

Scores are exact: components are integers, sums below 2^53 are taken in double precision and larger ones with Python's integers; what
doesn't fit in 64 bits counts as the nearest number that does.

Defined results: rows with a null vec_id or label, or a vector that is null, empty, of another length than most, or holds null or non-finite components,
take no part; zero vectors do. Of several rows under one vec_id that with the smallest (label, vector) counts. Anchors without
positives, and positives with a negative score or without a negative in their band, give no row. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.vectors import dimension

SCALE, POSITIVES, NEGATIVES, ANCHOR_EVERY = 256, 5, 3, 50
LEAF, GROUP, SAMPLE, SAMPLE_LEAF, STRIDE = 512, 32, 20_000, 16, 3
#: Tables of leaves are broadcast up to so many rows (a key and a number each).
BROADCAST_LEAVES = 200_000
LEAST, MOST = -(2**63) + 1, 2**63 - 1
KEY = ["label", "path", "block"]


def _pack(dim: int):
    """Rows with a vector of ``dim`` finite components: scaled and floored, as 16-bit integers if they fit, else as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            starts, sizes = column.offsets.to_numpy()[:-1].astype(np.int64), np.diff(column.offsets.to_numpy())
            values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            fit = np.flatnonzero((sizes == dim) & column.is_valid().to_numpy(zero_copy_only=False))
            m = values[starts[fit][:, None] + np.arange(dim)[None, :]] if len(fit) else np.empty((0, dim))
            with np.errstate(over="ignore", invalid="ignore"):
                m = np.floor(m * SCALE) + 0.0
            # a finite component that overflows when scaled is as good as non-finite
            good = np.isfinite(m).all(axis=1)
            m, fit = m[good], fit[good]
            small = (np.abs(m) < 2**15).all(axis=1)
            packed = [(r.astype("<i2") if s else r.astype("<f8")).tobytes() for r, s in zip(m, small, strict=True)]
            kept = pa.array(fit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(packed, pa.binary())], names=["vec_id", "label", "v"])

    return run


def unpacked(values: list[bytes], dim: int) -> np.ndarray:
    if all(len(v) == 2 * dim for v in values):
        return np.frombuffer(b"".join(values), "<i2").reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<f8") for v in values], np.float64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; those beyond are cut to the ends of that range."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    exact = whole(a) @ whole(b).T
    return np.array([[min(max(x, LEAST), MOST) for x in r] for r in exact], np.int64)


class Planes:
    """k-d tree cut at medians of the widest axis of a sample; a row's path is a text of 0 and 1, one for each cut."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.cuts: dict[str, tuple[int, float]] = {}
        todo = [("", sample)]
        while todo:
            path, rows = todo.pop()
            if len(path) == depth or len(rows) < 2 * SAMPLE_LEAF:
                continue
            for axis in np.argsort(-rows.var(axis=0), kind="stable")[:4]:
                at = np.median(rows[:, axis])
                right = rows[:, axis] > at
                if 0 < right.sum() < len(rows):
                    self.cuts[path] = (int(axis), float(at))
                    todo += [(path + "0", rows[~right]), (path + "1", rows[right])]
                    break

    def paths(self, m: np.ndarray) -> list[str]:
        out: list[str] = [""] * len(m)
        todo = [("", np.arange(len(m)))]
        while todo:
            path, rows = todo.pop()
            if path in self.cuts and len(rows):
                axis, at = self.cuts[path]
                right = m[rows, axis] > at
                todo += [(path + "0", rows[~right]), (path + "1", rows[right])]
            else:
                for k in rows:
                    out[k] = path
        return out


def _route(planes: Planes, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = planes.paths(unpacked(batch.column(2).to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.string())], names=["vec_id", "label", "v", "full"])

    return run


def small_join(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Join with a written table of leaves, which is broadcast if it is small; else Spark may split its hot keys."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_LEAVES else table, on)


def in_leaves(coded: DataFrame, most: int) -> DataFrame:
    """Rows with the leaf (``KEY``) that holds them: the shallowest node of their label with ``most`` rows, else blocks of the deepest one."""
    counts = common.saved(coded.groupBy("label", "full").agg(F.count("*").alias("n")), "leaf-counts")
    above = counts.withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), F.length("full")), lambda k: F.left("full", k))))
    total = above.groupBy("label", "path").agg(F.sum("n").alias("total"))
    fits = above.join(total, ["label", "path"]).where((F.col("total") <= most) | (F.col("path") == F.col("full")))
    cut = fits.groupBy("label", "full").agg(F.min_by(F.struct("path", "total"), F.length("path")).alias("at"))
    cut = common.saved(cut.select("label", "full", "at.path", F.ceil(F.col("at.total") / most).alias("blocks")), "leaf-cuts")
    return small_join(coded, cut, ["label", "full"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).select("vec_id", "v", *KEY)


def _boxes(dim: int):
    def run(key, table):
        m = unpacked(table.column("v").to_pylist(), dim)
        return pa.table({"label": [key[0]], "path": [key[1]], "block": [key[2]], "lo": [m.min(axis=0).tobytes()], "hi": [m.max(axis=0).tobytes()]}, _schema("label bigint path string block int lo binary hi binary"))

    return run


def _schema(text: str) -> pa.Schema:
    words, kinds = text.split(), {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in zip(words[::2], words[1::2], strict=True)])


def leaf_boxes(rows: DataFrame, dim: int, name: str) -> DataFrame:
    """Box of each leaf; a leaf's rows are few, so they meet in a task."""
    return common.saved(rows.groupBy(*KEY).applyInArrow(_boxes(dim), "label bigint, path string, block int, lo binary, hi binary"), name)


def _merge(key, table):
    lo, hi = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<f8").reshape(table.num_rows, -1) for c in ("lo", "hi"))
    return pa.table(
        {"tag": [key[0]], "node": [key[1]], "lo": [lo.min(axis=0).tobytes()], "hi": [hi.max(axis=0).tobytes()], "floor": [min(table.column("floor").to_pylist())], "ceiling": [max(table.column("ceiling").to_pylist())]},
        _schema("tag bigint node string lo binary hi binary floor bigint ceiling bigint"),
    )


def _levels(leaves: DataFrame, lengths: list[int], tag: Column) -> dict[int, DataFrame]:
    """Nodes of each path length, from the deepest up; a node's box spans those of its children."""
    nodes = leaves.select(tag.cast("bigint").alias("tag"), F.col("path").alias("node"), "lo", "hi", "floor", "ceiling")
    out = {}
    for n in reversed(lengths):
        nodes = nodes.withColumn("node", F.left("node", F.lit(n))).groupBy("tag", "node").applyInArrow(_merge, "tag bigint, node string, lo binary, hi binary, floor bigint, ceiling bigint")
        out[n] = nodes = common.saved(nodes, f"nodes-{n}")
    return out


def bounds(a_lo: np.ndarray, a_hi: np.ndarray, c_lo: np.ndarray, c_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product between two boxes, row by row, widened by what rounding may take."""
    corners = np.stack([a_lo * c_lo, a_lo * c_hi, a_hi * c_lo, a_hi * c_hi])
    slack = np.abs(corners).max(axis=0).sum(axis=1) * 1e-12
    return corners.min(axis=0).sum(axis=1) - slack, corners.max(axis=0).sum(axis=1) + slack


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys.., floor, ceiling, a_lo, a_hi, c_lo, c_hi) to (keys.., reach) whose interval meets [floor, ceiling]; ``reach`` is its upper end."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            boxes = [np.frombuffer(b"".join(part.column(c).to_pylist()), "<f8").reshape(part.num_rows, -1) for c in ("a_lo", "a_hi", "c_lo", "c_hi")]
            least, most = bounds(*boxes)
            floor, ceiling = (part.column(c).to_numpy().astype(np.float64) for c in ("floor", "ceiling"))
            kept = pa.array(np.flatnonzero((most >= floor) & (least <= ceiling)))
            names = [n for n in part.schema.names if n not in ("floor", "ceiling", "a_lo", "a_hi", "c_lo", "c_hi")]
            yield pa.RecordBatch.from_arrays([*[part.column(n).take(kept) for n in names], pa.array(most).take(kept)], names=[*names, "reach"])


def leaf_pairs(groups: DataFrame, leaves: DataFrame, same: bool) -> DataFrame:
    """Pairs of anchor leaf (g_ columns) and candidate leaf (c_ columns) that may hold an answer, with the upper bound ``reach``.

    ``groups`` have floor and ceiling. ``same``: of one label; else of different ones. Both trees are descended at once, ``STRIDE`` cuts a step.
    """
    depth = max(leaves.agg(F.max(F.length("path"))).first()[0] or 0, groups.agg(F.max(F.length("path"))).first()[0] or 0)
    lengths = list(range(0, depth, STRIDE)) or [0]
    tag = F.col("label") if same else F.lit(0)
    candidates = leaves.withColumns({"floor": F.lit(0).cast("bigint"), "ceiling": F.lit(0).cast("bigint")})
    a, c = _levels(groups, lengths, tag), _levels(candidates, lengths, tag)
    pairs = None
    for k, n in enumerate(lengths):
        up = F.left("node", F.lit(lengths[k - 1] if k else 0))
        left = a[n].select("tag", up.alias("a_up"), F.col("node").alias("a"), "floor", "ceiling", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
        right = c[n].select("tag", up.alias("c_up"), F.col("node").alias("c"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
        if pairs is None:
            both = left.join(right, "tag")  # one root each
        else:
            both = pairs.join(left, ["tag", "a_up"]).join(right, ["tag", "c_up"])
        kept = both.select("tag", "a", "c", "floor", "ceiling", "a_lo", "a_hi", "c_lo", "c_hi").mapInArrow(_prune, "tag bigint, a string, c string, reach double")
        pairs = common.saved(kept.select("tag", F.col("a").alias("a_up"), F.col("c").alias("c_up")), f"node-pairs-{n}")
    up = F.left("path", F.lit(lengths[-1]))
    left = groups.select(tag.cast("bigint").alias("tag"), up.alias("a_up"), *[F.col(x).alias(f"g_{x}") for x in KEY], "floor", "ceiling", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    right = leaves.select(tag.cast("bigint").alias("tag"), up.alias("c_up"), *[F.col(x).alias(f"c_{x}") for x in KEY], F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    both = pairs.join(left, ["tag", "a_up"]).join(right, ["tag", "c_up"])
    if not same:
        both = both.where("g_label <> c_label")
    keys = [f"{s}_{x}" for s in "gc" for x in KEY]
    return common.saved(both.select(*keys, "floor", "ceiling", "a_lo", "a_hi", "c_lo", "c_hi").mapInArrow(_prune, "g_label bigint, g_path string, g_block int, c_label bigint, c_path string, c_block int, reach double"), "leaf-pairs")


def _score(dim: int, take: int):
    """Rows sorted by leaf, candidates before anchors; for each anchor's bands the first ``take`` candidates of the leaf."""
    names = ["anchor_id", "band", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, matrix = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            asks, own, v = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            k = 0
            while k < len(keys):
                if keys[k] != at:
                    at, ids, vectors, matrix = keys[k], [], [], None
                e = k
                while e < len(keys) and keys[e] == at and asks[e] == asks[k] and e - k < 256:
                    e += 1
                if not asks[k]:
                    ids += own[k:e]
                    vectors += v[k:e]
                elif ids:
                    if matrix is None:
                        matrix, id_array = unpacked(vectors, dim), np.array(ids, np.int64)  # ids ascend, so a stable order breaks ties by id
                    scores = products(unpacked(v[k:e], dim), matrix)
                    order = np.argsort(-scores, axis=1, kind="stable")
                    for j, bands in enumerate(batch.column(6).slice(k, e - k).to_pylist()):
                        line = scores[j][order[j]]
                        for b in bands:
                            p, left = int(np.searchsorted(-line, -b["ceiling"], "left")), take
                            while left and p < len(line) and line[p] >= b["floor"]:
                                found = int(id_array[order[j, p]])
                                if found != own[k + j]:
                                    out.append((own[k + j], b["band"], found, int(line[p])))
                                    left -= 1
                                p += 1
                k = e
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=names)

    return run


def scored(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, dim: int, take: int) -> DataFrame:
    """(anchor_id, band, vec_id, score) of the pairs; ``anchors`` have a list ``bands`` of (band, floor, ceiling)."""
    kind = "array<struct<band:int,floor:bigint,ceiling:bigint>>"
    asked = anchors.select("vec_id", "v", "bands", *[F.col(x).alias(f"g_{x}") for x in KEY]).join(pairs, [f"g_{x}" for x in KEY])
    asked = asked.select(*[f"c_{x}" for x in KEY], F.lit(True).alias("asks"), "vec_id", "v", F.col("bands").cast(kind).alias("bands"))
    held = candidates.select(*[F.col(x).alias(f"c_{x}") for x in KEY], F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast(kind).alias("bands"))
    held = held.join(pairs.select(*[f"c_{x}" for x in KEY]).distinct(), [f"c_{x}" for x in KEY], "left_semi")
    dealt = held.unionByName(asked).repartition(*[f"c_{x}" for x in KEY]).sortWithinPartitions(*[f"c_{x}" for x in KEY], "asks", "vec_id")
    return dealt.mapInArrow(_score(dim, take), "anchor_id bigint, band int, vec_id bigint, score bigint")


def _first(rows: DataFrame, take: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= take)


def _with_limits(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor leaves with the lowest floor and the highest ceiling of the bands that their anchors ask for."""
    limits = anchors.groupBy(*KEY).agg(F.min(F.array_min(F.transform("bands", lambda b: b["floor"]))).alias("floor"), F.max(F.array_max(F.transform("bands", lambda b: b["ceiling"]))).alias("ceiling"))
    return common.saved(boxes.join(limits, KEY), "anchor-leaves")


def _bands(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Anchors with their bands out of ``rows(anchor_id, band, floor, ceiling)``; those without any go."""
    lists = rows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("band").cast("int").alias("band"), "floor", "ceiling"))).alias("bands"))
    return anchors.join(lists, anchors.vec_id == lists.anchor_id).drop("anchor_id")


def raised(asked: DataFrame, found: DataFrame, take: int) -> DataFrame:
    """Bands whose floor is the ``take``-th score found so far, where there are as many: (anchor_id, band, floor, ceiling)."""
    kth = _first(found, take).groupBy("anchor_id", "band").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == take)
    return asked.join(kth, ["anchor_id", "band"], "left").select("anchor_id", "band", F.coalesce("kth", "floor").alias("floor"), "ceiling")


def hard_negatives(vectors: DataFrame, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and label is not null")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    dim = dimension(rows.where("size(e) > 0"), "e")
    one = rows.mapInArrow(_pack(max(dim, 1)), "vec_id bigint, label bigint, v binary").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    one = common.saved(one.select("vec_id", "r.label", "r.v"), "scaled-vectors")
    n = one.count()
    kept = one.where(F.abs(F.xxhash64("vec_id") % 1_000_003) < int(1_000_003 * min(1.0, 1.2 * SAMPLE / max(n, 1)))).limit(SAMPLE)
    sample = unpacked([bytes(r.v) for r in kept.select("v").collect()], max(dim, 1))
    planes = Planes(sample, max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))))
    coded = common.saved(one.mapInArrow(_route(planes, max(dim, 1)), "vec_id bigint, label bigint, v binary, full string"), "coded-vectors")
    candidates = common.saved(in_leaves(coded, leaf), "candidates")
    anchors = common.saved(in_leaves(coded.where(F.col("vec_id") % ANCHOR_EVERY == 0), group), "anchors")
    c_boxes, a_boxes = leaf_boxes(candidates, max(dim, 1), "candidate-boxes"), leaf_boxes(anchors, max(dim, 1), "anchor-boxes")

    # positives: the own leaf first
    ids = anchors.select(F.col("vec_id").alias("anchor_id"), F.lit(0).alias("band"), F.lit(LEAST).alias("floor"), F.lit(MOST).alias("ceiling"))
    asking = _bands(anchors, ids)
    home = asking.join(candidates.select("vec_id", *[F.col(x).alias(f"c_{x}") for x in KEY]), "vec_id").select(*[F.col(x).alias(f"g_{x}") for x in KEY], *[f"c_{x}" for x in KEY]).distinct()
    near = common.saved(scored(home, asking, candidates, dim, POSITIVES), "own-leaf-scores")
    asking = common.saved(_bands(anchors, raised(ids, near, POSITIVES)), "positive-floors")
    pairs = leaf_pairs(_with_limits(a_boxes, asking), c_boxes, same=True)
    positive = common.saved(_first(scored(pairs, asking, candidates, dim, POSITIVES), POSITIVES).select("anchor_id", F.col("rank").alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: 50 p <= 100 x <= 95 p, without products that could overflow
    p = "positive_score"
    wanted = positive.where(f"{p} >= 0").select("anchor_id", "band", F.expr(f"{p} div 2 + {p} % 2").alias("floor"), F.expr(f"({p} div 100) * 95 + ({p} % 100 * 95) div 100").alias("ceiling"))
    asking = common.saved(_bands(anchors, wanted), "negative-bands")
    pairs = leaf_pairs(_with_limits(a_boxes, asking), c_boxes, same=False)
    g, c = [f"g_{x}" for x in KEY], [f"c_{x}" for x in KEY]
    best = common.saved(pairs.groupBy(*g).agg(F.max_by(F.struct(*c), "reach").alias("best")).select(*g, "best.*"), "best-pairs")
    first = common.saved(scored(best, asking, candidates, dim, NEGATIVES), "best-pair-scores")
    asking = common.saved(_bands(anchors, raised(wanted, first, NEGATIVES)), "negative-floors")
    floors = asking.groupBy(*KEY).agg(F.min(F.array_min(F.transform("bands", lambda b: b["floor"]))).alias("floor")).select(*[F.col(x).alias(f"g_{x}") for x in KEY], "floor")
    rest = pairs.join(best, [*g, *c], "left_anti").join(floors, g).where(F.col("reach") >= F.col("floor")).select(*g, *c)
    found = _first(first.unionByName(scored(rest, asking, candidates, dim, NEGATIVES)), NEGATIVES)
    out = found.join(positive, ["anchor_id", "band"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(common.read_table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3"""
