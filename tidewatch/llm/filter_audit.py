"""Filter interaction audit: what five document filters remove, alone, together and in every order.

Four filters look at one text; the fifth fails a text that a smaller doc_id has too. Duplicates come from sorting: rows are dealt
by ranges of (fingerprint, doc_id) and sorted within a task by fingerprint, full text and doc_id, so that a row needs to be compared with its
predecessor only, and a group of copies of any size is cut over as many tasks as it needs. The cut points are drawn from fingerprints and
ids alone: sampled texts would pile up on the driver. Where a group spans a boundary, its tasks meet in the table of
boundary runs: each task names the smallest doc_id of the texts under its first and its last fingerprint, and the minimum over tasks holds.

A row is then a mask of five failures. Rows are counted by part, mask and the two labels, which combine before they
shuffle; everything else is derived from these counters, of which a part has 128 at most: what a filter removes depends only on the
set of filters before it, so 80 pairs (set, filter) serve all 120 orders, and the Shapley value weighs them.
Counters of several tables add up (``merged``), so long as no text is split between them.

Defined results: null texts are empty texts, and copies of each other; a null source is the part of the empty string; a row with a null doc_id is never a copy and
makes none (there is no smaller id); rows of one doc_id with one text aren't copies of each other; of several label rows of a doc_id any
that says 1 counts; an empty table has no parts and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
#: A table of boundary runs is broadcast up to so many rows; beyond, it is joined by key.
BROADCAST_RUNS = 100_000
COUNTS = ["n", "good", "toxic"]

_RUN = "doc_id bigint, part string, mask int, run bigint, first_id bigint, fp bigint, edge_text string"


def failures(text: Column) -> Column:
    """Bits of the filters that look at one text alone: A is 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bits = [n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, text, doc_id) to rows with the number of their run of one text and that run's smallest doc_id.

    A run's text goes along with its first row if its fingerprint is the first or the last of the task.
    """
    task = TaskContext.get().partitionId() << 32
    names = [c.split()[0] for c in _RUN.split(", ")]
    run, first, last_fp, last_text, opening = -1, None, None, None, None
    held: list[tuple[int, str, int | None]] = []  # runs under the last fingerprint so far: run, text, first id

    def edges(runs: list[tuple[int, str, int | None]], fp: int) -> pa.RecordBatch:
        cells = [(None, None, None, task + k, d, fp, t) for k, t, d in runs]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp, text, ids = batch.column(0), batch.column(1), batch.column(2)
        fresh = [True] * n
        if n > 1:
            same = pc.and_(pc.equal(fp.slice(1), fp.slice(0, n - 1)), pc.equal(text.slice(1), text.slice(0, n - 1)))
            fresh[1:] = pc.invert(same).to_pylist()
        fp_list, id_list = fp.to_pylist(), ids.to_pylist()
        fresh[0] = last_fp is None or fp_list[0] != last_fp or text[0].as_py() != last_text
        runs, firsts = [], []
        for k in range(n):
            if fresh[k]:
                run, first = run + 1, None
                if fp_list[k] != last_fp:
                    if last_fp is not None and opening is None:
                        opening = last_fp
                        yield edges(held, last_fp)
                    last_fp, held = fp_list[k], []
                held.append((run, text[k].as_py(), None))
            if first is None and id_list[k] is not None:
                first = id_list[k]
                held[-1] = (*held[-1][:2], first)
            runs.append(task + run)
            firsts.append(first)
        last_text = held[-1][1]
        yield pa.RecordBatch.from_arrays([ids, batch.column(3), batch.column(4), pa.array(runs, pa.int64()), pa.array(firsts, pa.int64()), fp, pa.nulls(n, pa.string())], names=names)
    if last_fp is not None:
        yield edges(held, last_fp)


def masked(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of ``documents(doc_id, text, source)``, duplicates (bit 16) included."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.xxhash64(text).alias("fp"), text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    dealt = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    # the cut points take a pass of their own over the rows, which the other filters needn't share
    dealt = dealt.withColumn("mask", failures(F.col("text")))
    runs = common.saved(dealt.mapInArrow(_scan, _RUN), "text-runs")
    edge = runs.where("edge_text is not null")
    least = edge.groupBy("fp", "edge_text").agg(F.min("first_id").alias("least_id"), F.collect_set("run").alias("own")).where(F.size("own") > 1)
    least = common.saved(least.select(F.explode("own").alias("run"), "least_id"), "boundary-runs")
    if least.count() <= BROADCAST_RUNS:
        least = F.broadcast(least)
    df = runs.where("edge_text is null").join(least, "run", "left")
    copy = F.col("doc_id") > F.least("first_id", "least_id")
    return df.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts of ``masked`` rows."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    known = known.where("label_id is not null and (q or t)").groupBy("label_id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    df = rows.join(known, F.col("doc_id") == F.col("label_id"), "left")
    return df.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("q").alias("good"), F.count_if("t").alias("toxic"))


def merged(*parts: DataFrame) -> DataFrame:
    """Counters of several tables as one."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _bits(names) -> int:
    return sum(1 << FILTERS.index(f) for f in names)


def audit(counts: DataFrame) -> DataFrame:
    """Every order and step of every part from its counters."""
    spark, k = counts.sparkSession, len(FILTERS)
    orders = [("".join(o), step + 1, _bits(o[:step]), _bits(o[step])) for o in permutations(FILTERS) for step in range(k)]
    steps = spark.createDataFrame(orders, "filter_order string, step int, before int, own int")
    pairs = sorted({(b, own, math.factorial(bin(b).count("1")) * math.factorial(k - 1 - bin(b).count("1"))) for _, _, b, own in orders})
    sets = spark.createDataFrame(pairs, "before int, own int, weight bigint")  # 80 rows at any size
    fails, clean = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda cond, c="n": F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    by_set = counts.join(F.broadcast(sets)).groupBy("part", "before", "own", "weight").agg(
        total(clean & ~fails).alias("kept"), total(clean & fails).alias("removed"), total(~clean & fails).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(clean & fails, "good").alias("good_lost"), total(clean & fails, "toxic").alias("toxic_lost"))
    value = by_set.groupBy("part", "own").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    df = by_set.join(F.broadcast(steps), ["before", "own"]).join(value, ["part", "own"])
    return df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(common.saved(counters(masked(documents), labels), "filter-counters"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
OP12_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
tests AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM (SELECT *, {_WORDS} AS w FROM docs)),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS f,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM tests LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(unnest(generate_series(1, 5)) AS INT) AS step FROM orders),
applied AS (SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic, f, contains(f, filter_order[step]) AS fails, translate(f, filter_order[1:step - 1], '') = f AS clean FROM failed, steps),
sums AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (clean AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (clean AND fails), 0) AS removed, coalesce(sum(n) FILTER (fails AND NOT clean), 0) AS redundant,
    coalesce(sum(n) FILTER (f = own), 0) AS unique_fails, coalesce(sum(good) FILTER (clean AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (clean AND fails), 0) AS toxic_lost FROM applied GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums"""
