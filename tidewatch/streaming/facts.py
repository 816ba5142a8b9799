"""Five-minute facts of a running stream, published at every five-minute boundary and corrected when late reports reopen a bucket.

Each micro-batch adds its intervals' contributions, summed by vessel, to ``deltas/batch=N``, by hour of the bucket. When the newest
arrival passes a boundary, the facts of the buckets that were touched since the last publication are summed again out of the deltas of
their hours, and written to ``facts/batch=N``; of a bucket the newest publication counts, so a correction replaces all of its rows. The row in
``marks`` comes last and makes a publication visible. A batch that is run again after a failure replaces its own folders only.

An interval reaches back half an hour, so a publication reads one or two hours of deltas, however long the session lasts.
The run is PENDING while it goes on, COMPLETE once it has been finished, and PENDING again if more arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import rates
from tidewatch.operators import cube

HOUR_NS = 3600 * rates.NS
MARK = "batch bigint, through_ns bigint, boundary bigint, state string, published boolean"


def with_spans(intervals: DataFrame) -> DataFrame:
    """What the cube needs besides the columns of live intervals."""
    limit = F.floor(rates.STALE_FACTOR * F.col("expected_s") * rates.NS + 0.5).cast("bigint")
    return intervals.withColumn("delta_ns", F.col("ts_ns") - F.col("start_ns")).withColumn("stale_start_ns", F.col("start_ns") + limit)


class LiveFacts:
    """The tables of one session under ``path``; ``place`` is ("band",) or ("col", "row")."""

    def __init__(self, spark: SparkSession, path: str, place: tuple[str, ...] = ("band",)):
        self.spark, self.path, self.place = spark, path.rstrip("/"), list(place)
        self.keys = ["bucket", *self.place, "vessel_class", "mmsi"]
        kinds = {"bucket": "bigint", "band": "int", "col": "bigint", "row": "bigint", "vessel_class": "string", "mmsi": "int", "observed": "bigint", "missing": "bigint", "observed_s": "double", "stale_s": "double", "vessels": "bigint", "batch": "bigint", "hour": "bigint"}
        shape = lambda names: ", ".join(f"{n} {kinds[n]}" for n in names)
        self.delta_shape, self.fact_shape = shape([*self.keys, *cube.MEASURES, "batch", "hour"]), shape([*self.keys[:-1], *cube.MEASURES, "vessels", "batch"])

    def _read(self, table: str, shape: str) -> DataFrame:
        """The table, or no rows before its first batch."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(shape).option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}") if there else self.spark.createDataFrame([], shape)

    def marks(self) -> DataFrame:
        return self._read("marks", f"{MARK}, of bigint").drop("of")

    def state(self) -> str | None:
        last = self.marks().orderBy(F.desc("batch")).limit(1).collect()
        return last[0].state if last else None

    def _mark(self, row: tuple, of: int) -> None:
        self.spark.createDataFrame([row], MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/of={of}")

    def _publish(self, batch: int, since: int) -> None:
        """Facts of the buckets touched by batches over ``since`` up to ``batch``."""
        deltas = self._read("deltas", self.delta_shape).where(F.col("batch") <= batch)
        touched = deltas.where(F.col("batch") > since).select("bucket", "hour").distinct()
        hours = [r.hour for r in touched.select("hour").distinct().collect()]  # the hours of a few batches
        of_vessels = deltas.where(F.col("hour").isin(hours)).join(touched.select("bucket"), "bucket", "left_semi").groupBy(*self.keys).agg(*[F.sum(m).alias(m) for m in cube.MEASURES])
        facts = of_vessels.groupBy(*self.keys[:-1]).agg(*[F.sum(m).alias(m) for m in cube.MEASURES], F.count("*").alias("vessels"))
        facts.write.mode("overwrite").parquet(f"{self.path}/facts/batch={batch}")

    def add(self, intervals: DataFrame, batch: int) -> None:
        """A micro-batch of ``live_intervals``; for ``foreachBatch``."""
        own = intervals.persist()
        try:
            contributions = cube.cell_contributions if self.place == ["col", "row"] else cube.band_contributions
            sums = contributions(with_spans(own.where("reason IS NULL"))).groupBy(*self.keys).agg(*[F.sum(m).alias(m) for m in cube.MEASURES])
            sums.withColumn("hour", F.floor((F.col("bucket") - F.pmod("bucket", F.lit(HOUR_NS))) / HOUR_NS)).write.mode("overwrite").partitionBy("hour").parquet(f"{self.path}/deltas/batch={batch}")
            newest = own.agg(F.max("ts_ns").alias("m")).first().m
        finally:
            own.unpersist()
        before = self.marks().where(F.col("batch") < batch).agg(F.max("through_ns").alias("through_ns"), F.max("boundary").alias("boundary"), F.max(F.when(F.col("published"), F.col("batch"))).alias("since")).first()
        through = max(newest or 0, before.through_ns or 0)
        boundary = through // cube.BUCKET_NS
        due = before.boundary is None or boundary > before.boundary
        if due:
            self._publish(batch, before.since if before.since is not None else -1)
        self._mark((batch, through, boundary, "PENDING", due), batch)

    def finish(self) -> None:
        """Publish what is open and call the run COMPLETE; a batch that follows makes it PENDING again."""
        last = self.marks().agg(F.max("batch").alias("batch"), F.max("through_ns").alias("through_ns"), F.max("boundary").alias("boundary"), F.max(F.when(F.col("published"), F.col("batch"))).alias("since")).first()
        if last.batch is None:
            return
        if last.since is None or last.batch > last.since:
            self._publish(last.batch, last.since if last.since is not None else -1)
        self._mark((last.batch, last.through_ns, last.boundary, "COMPLETE", True), last.batch)

    def facts(self) -> DataFrame:
        """The published facts: of each bucket those of its newest publication."""
        done = self.marks().where("published").select("batch")
        every = self._read("facts", self.fact_shape).join(done, "batch", "left_semi")
        newest = every.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return every.join(newest, ["bucket", "batch"], "left_semi").drop("batch")


def write_facts(intervals: DataFrame, facts: LiveFacts, checkpoint: str, every: str | None = None):
    """Start the query that feeds ``facts`` out of streaming ``live_intervals``; ``every`` is a trigger interval such as "5 minutes"."""
    writer = intervals.writeStream.foreachBatch(facts.add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer).start()
