"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a fixed list of text statistics. Every statistic is cut into quantile bins; shallow trees on one
statistic's bins are boosted in turns over all statistics, each adding to that statistic's lookup table. Then the pairs
that still explain most of the residual get small two-way tables, boosted the same way. A score is the sigmoid of the
sum of looked-up cells, so scoring is a handful of vectorised additions.

The model is fitted on the driver from at most ``max_rows`` labelled rows (those with the smallest hash of doc_id), which
bounds its memory at any corpus size; statistics of all rows are computed where they are scored, in one pass.

Defined results: a null text scores as the empty text; labels that are null are ignored, several labels of one doc_id
are averaged; without labels of both kinds every score is the share of label 1 (0.5 without labels); null doc_ids are
scored and not held out; repeated rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

MAX_ROWS, THRESHOLD = 40_000, 0.7

_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
_REPEAT = re.compile(r"(.)\1{3,}")

#: Names of the statistics, in order.
STATISTICS = (
    "words", "chars", "mean_word", "sd_word", "longest_word", "distinct_share", "top_share", "top2_share", "pair_repeat", "line_repeat", "lines_per_word",
    "upper_share", "digit_share", "space_share", "symbol_share", "bang_share", "pipe_share", "mark_end_share", "sentence_words", "capital_starts", "single_share", "run_share", "ascii_share", "entropy",
)


def statistics(text: str) -> list[float]:
    """Statistics of one whole text; all are finite, also for the empty text."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0, float(chars)] + [0.0] * (len(STATISTICS) - 2)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(2)] + [0]
    tally = np.fromiter(counts.values(), np.float64, len(counts)) / n
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    bytes_ = np.bincount(raw, minlength=256)
    total = len(raw)
    upper, digit, letters = bytes_[65:91].sum(), bytes_[48:58].sum(), bytes_[97:123].sum()
    space = bytes_[[9, 10, 13, 32]].sum()
    high = bytes_[128:].sum()
    symbol = total - upper - digit - letters - space - high
    ends = _SENTENCE.findall(text)
    mark_end = sum(1 for w in words if not w[-1].isalnum())
    return [
        float(n), float(chars), float(sizes.mean()), float(sizes.std()), float(sizes.max()), len(counts) / n, top[0] / n, (top[0] + top[1]) / n, 1 - pairs / max(1, n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)), len(lines) / n, upper / total, digit / total, space / total, symbol / total, bytes_[33] / total, bytes_[124] / total, mark_end / n, n / max(1, len(ends)),
        sum(1 for w in words if w[0].isupper()) / n, float((sizes == 1).mean()), sum(len(m) for m in _REPEAT.findall(text)) / n, 1 - high / total, float(-(tally * np.log(tally)).sum()) / max(1.0, np.log(n)),
    ]


_COLUMNS = [f"s{k}" for k in range(len(STATISTICS))]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for lo in range(0, batch.num_rows, 500):
            rows += [statistics(t or "") for t in batch.column(1).slice(lo, 500).to_pylist()]
        table = np.array(rows, dtype=np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(table[:, k]) for k in range(len(STATISTICS))]], names=["doc_id", *_COLUMNS])


def with_statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_statistics, "doc_id bigint, " + ", ".join(f"{c} double" for c in _COLUMNS))


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features; ``rounds`` boosting turns at ``rate``."""

    bins: int = 48
    pair_bins: int = 8
    pairs: int = 8
    rounds: int = 160
    pair_rounds: int = 60
    rate: float = 0.15
    ridge: float = 2.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def _edges(column: np.ndarray, bins: int) -> np.ndarray:
        """Upper bounds of all bins but the last, from quantiles of the distinct-weighted column."""
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(column) else np.empty(0)
        spread = np.unique(column)
        if 1 < len(spread) <= bins:
            return (spread[1:] + spread[:-1]) / 2
        return cuts

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, ridge: float, splits: int = 3) -> np.ndarray:
        """Leaf values by bin of a tree with at most ``splits`` cuts, each the best remaining one."""
        bounds, value = [0, len(g)], np.zeros(len(g))
        cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
        for _ in range(splits):
            best = (1e-9, -1)
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                c = np.arange(a + 1, b)
                gl, hl, gt, ht = cg[c] - cg[a], ch[c] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(c[k])))
            if best[1] < 0:
                break
            bounds = sorted([*bounds, best[1]])
        for a, b in zip(bounds, bounds[1:], strict=False):
            value[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
        return value

    @staticmethod
    def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """The best two-way cut of a grid into four leaves: its gain and leaf values by cell."""
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        r, c = g.shape
        if r < 2 or c < 2:
            return 0.0, np.zeros_like(g)
        quads = []
        for s in (cg, ch):
            ll, lr, rl = s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1]
            quads.append((ll, lr, rl, s[-1, -1] - ll - lr - rl))
        gain = sum(a**2 / (b + ridge) for a, b in zip(*quads, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        leaf = [a[i, j] / (b[i, j] + ridge) for a, b in zip(*quads, strict=True)]
        value = np.empty_like(g)
        value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = leaf
        return float(gain[i, j]), value

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, f = x.shape
        share = float(y.mean()) if n else 0.5
        both = 0 < share < 1
        self.base = float(np.log(share / (1 - share))) if both else (30.0 if share == 1 else -30.0 if share == 0 else 0.0)
        self.edges = [self._edges(x[:, k], self.bins) for k in range(f)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_edges = [self._edges(x[:, k], self.pair_bins) for k in range(f)]
        self.pair_tables = []
        if not both:
            return self
        at = [np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)]
        z = np.full(n, self.base)
        for _ in range(self.rounds):
            for k in range(f):
                p = 1 / (1 + np.exp(-z))
                size = len(self.tables[k])
                step = self.rate * self._tree(np.bincount(at[k], y - p, size), np.bincount(at[k], p * (1 - p), size), self.ridge)
                self.tables[k] += step
                z += step[at[k]]
        two = [np.searchsorted(e, x[:, k]) for k, e in enumerate(self.pair_edges)]
        widths = [len(e) + 1 for e in self.pair_edges]
        cells = {(a, b): two[a] * widths[b] + two[b] for a in range(f) for b in range(a + 1, f)}

        def grid(a: int, b: int, w: np.ndarray) -> np.ndarray:
            return np.bincount(cells[a, b], w, widths[a] * widths[b]).reshape(widths[a], widths[b])

        p = 1 / (1 + np.exp(-z))
        gains = sorted(((self._cross(grid(a, b, y - p), grid(a, b, p * (1 - p)), self.ridge)[0], a, b) for a, b in cells), reverse=True)[: self.pairs]
        chosen = [(a, b, np.zeros((widths[a], widths[b]))) for gain, a, b in gains if gain > 0]
        for _ in range(self.pair_rounds):
            for a, b, table in chosen:
                p = 1 / (1 + np.exp(-z))
                step = self.rate * self._cross(grid(a, b, y - p), grid(a, b, p * (1 - p)), self.ridge)[1]
                table += step
                z += step.ravel()[cells[a, b]]
        self.pair_tables = chosen
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, e in enumerate(self.edges):
            z += self.tables[k][np.searchsorted(e, x[:, k])]
        for a, b, table in self.pair_tables:
            z += table[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return 1 / (1 + np.exp(-z))


def held_out(doc_id):
    """Whether crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, y): at most ``max_rows`` labelled ids of ``docs`` that aren't held out, those with the smallest hash."""
    usable = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("quality").alias("q"))
    usable = usable.where(~held_out(F.col("doc_id"))).select("doc_id", (F.col("q") >= 0.5).cast("double").alias("y"), F.xxhash64("doc_id").alias("h"))
    known = common.saved(usable.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_semi"), "known-labels")
    # every task would offer max_rows of its own: only hashes up to a bit above the expected last one come that far
    share = (1.1 * max_rows + 1000) / max(1, known.count())
    cut = known.where(F.col("h") < int(share * 2.0**64) - (1 << 63)) if share < 1 else known
    return cut.orderBy("h", "doc_id").limit(max_rows).select("doc_id", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **settings) -> AdditiveModel:
    """Fit on the ``labelled`` ones of ``docs(doc_id, text)`` by ``labels(doc_id, quality)``.

    Of several texts under one doc_id each statistic's smallest value counts.
    """
    chosen = common.saved(labelled(docs, labels, max_rows), "chosen-labels")
    rows = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias("chosen_"))), F.col("doc_id").cast("bigint") == F.col("chosen_"), "left_semi")
    stats = with_statistics(rows).groupBy("doc_id").agg(*[F.min(c).alias(c) for c in _COLUMNS])
    table = stats.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("y", *_COLUMNS).toPandas()
    return AdditiveModel(**settings).fit(table[_COLUMNS].to_numpy(np.float64), table["y"].to_numpy(np.float64))


def _score(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS]) if batch.num_rows else np.empty((0, len(_COLUMNS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score_quality(stats: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``stats``."""
    scored = stats.mapInArrow(_score(model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(model: AdditiveModel, threshold: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [statistics(t or "") for t in part.column(names.index("text")).to_pylist()]
                yield part.filter(pa.array(model.score(np.array(rows, dtype=np.float64)) >= threshold))
        common.give_back()

    return run


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns as they were."""
    return docs.mapInArrow(_keep(model, threshold, docs.columns), docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return score_quality(with_statistics(docs), fit_quality(docs, common.read_table(spark, sf_dir, "labels")))
