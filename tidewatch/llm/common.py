"""Shared pieces of the corpus operators: cluster-visible tables, connected components, text hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing (local tests) a temporary folder is made, once a session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``saved`` and the path of the table, for those that are removed once what follows them is saved."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    return saved_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark itself uses for that path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: its cleaner only sees what has been collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """At the end of a task: let its Python worker, which lives on, return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Groups with more than this part of all rows are joined by broadcast; there can be no more than ``HOT_GROUPS`` of them.
HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "size_") -> DataFrame:
    """Inner join of rows with one row per group, whose column ``size`` counts the group's rows in ``rows``; the result lacks it.

    Groups above 1 / ``HOT_GROUPS`` of all rows are fewer than ``HOT_GROUPS``, so they are broadcast and their rows stay
    where they are; only the rows of the others are shuffled by key. Null keys match nothing, as in any join.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT_GROUPS > total)
    marked = F.broadcast(hot.select(*keys))
    few = rows.join(F.broadcast(hot), keys)
    rest = rows.join(marked, keys, "left_anti").join(groups.where(F.col(size) * HOT_GROUPS <= total), keys)
    return few.unionByName(rest).drop(size)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of each node that occurs in ``edges(a, b)``: (id, component).

    Hash-to-min with pointer jumping. Every round is two joins and two map-side combined minima, so a node
    with very many neighbours costs one partial row per map task. Only a change count reaches the driver.
    """
    spark = edges.sparkSession
    both, both_at = saved_at(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels, at = saved_at(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        # the root of a node also learns what the node has seen, so that whole trees hook on at once
        seen = labels.join(near, labels.id == near.a).select("id", "component", F.least("component", "m").alias("m"))
        told = seen.select(F.col("id").alias("k"), "m").union(seen.select(F.col("component").alias("k"), "m"))
        hooked = told.groupBy(F.col("k").alias("id")).agg(F.min("m").alias("p"))
        up = hooked.select(F.col("id").alias("r"), F.col("p").alias("pp"))
        jumped = hooked.join(up, hooked.p == up.r).select("id", F.least("p", "pp").alias("component"))
        fresh, fresh_at = saved_at(jumped, "cc-labels")
        changed = fresh.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        remove(spark, at)
        labels, at = fresh, fresh_at
        if not changed:
            remove(spark, both_at)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
