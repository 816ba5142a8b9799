"""Result tables by run, made visible by a run row that is written last, and report files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run_id string, day date, fingerprint string, receiver string, profile string, started_us bigint"
STORED_RUN = f"{RUN}, ended_us bigint"


def new_store_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which executors share; a temporary one only where a local session lacks it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='tidewatch-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class ResultStore:
    """Parquet tables under ``path``, partitioned by run; a run counts once its row stands in ``runs``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, table: str, run_id: str, rows: DataFrame) -> None:
        """Replace the rows of a run in a table; other runs stay."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/run_id={run_id}")

    def publish(self, run: tuple, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            self.write(name, run[0], rows)
        self.spark.createDataFrame([run], RUN).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/of={run[0]}")

    def publish_days(self, runs: DataFrame, tables: dict[str, DataFrame]) -> None:
        """Many runs in one job a table: ``tables`` carry ``run_id``; their rows of these runs are replaced, then the runs appear."""
        for name, rows in tables.items():
            # by run, but a run of many rows is cut into several files
            rows.hint("rebalance", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{self.path}/{name}")
        rows = runs.withColumn("of", F.col("run_id")) if "ended_us" in runs.columns else runs.withColumn("of", F.col("run_id")).withColumn("ended_us", F.lit(None).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of").parquet(f"{self.path}/runs")

    def every_run(self) -> DataFrame:
        """Published runs, superseded ones too."""
        return self.spark.read.schema(STORED_RUN).parquet(f"{self.path}/runs").select(*[c.split()[0] for c in STORED_RUN.split(", ")])

    def runs(self) -> DataFrame:
        """Active runs: of a day, receiver and profile the newest."""
        every = self.every_run()
        newest = every.groupBy("day", "receiver", "profile").agg(F.max_by("run_id", F.struct("started_us", "run_id")).alias("run_id"))
        return every.join(newest.select("run_id"), "run_id", "left_semi")

    def equivalent(self, fingerprint: str, receiver: str, profile: str) -> DataFrame:
        return self.runs().where((F.col("fingerprint") == fingerprint) & (F.col("receiver") == receiver) & (F.col("profile") == profile))

    def read(self, table: str, from_ns: int | None = None, to_ns: int | None = None, classes: tuple[str, ...] | None = None, time: str = "bucket") -> DataFrame:
        """Rows of active runs; of a stretch of time [from, to) and of some classes only, which the scan filters."""
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        if from_ns is not None:
            rows = rows.where(F.col(time) >= from_ns)
        if to_ns is not None:
            rows = rows.where(F.col(time) < to_ns)
        if classes is not None:
            rows = rows.where(F.col("vessel_class").isin(*classes))
        return rows.join(self.runs().select("run_id"), "run_id", "left_semi")


def write_report(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV parts with a header; rates and seconds as plain decimals of fixed length, nulls empty."""
    shown = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*[F.when(F.col(c).isNotNull(), s).alias(c) for c, s in zip(df.columns, shown, strict=True)]).write.mode("overwrite").option("header", True).csv(path)


def marked_report(df: DataFrame, about: dict[str, str], digits: int | dict[str, int] = 6, order: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a report as one column ``value``: a byte-order mark, comment lines of ``about``, the header, the rows in ``order``.

    Doubles have ``digits`` decimals, 6 if it names other columns only; nulls are empty, and texts with a comma, quote or line break are quoted.
    """
    def shown(c: str, t: str) -> Column:
        places = digits if isinstance(digits, int) else digits.get(c, 6)
        text = F.format_string(f"%.{places}f", F.col(f"`{c}`")) if t == "double" else F.col(f"`{c}`").cast("string")
        quoted = F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
        return F.when(F.col(f"`{c}`").isNotNull(), quoted).otherwise("")

    head = [*(f"# {k}: {v}" for k, v in about.items()), ",".join(df.columns)]
    top = df.sparkSession.createDataFrame([(0, k, ("\ufeff" if not k else "") + line) for k, line in enumerate(head)], "part int, k bigint, value string")
    rows = df.orderBy(*order) if order else df
    body = rows.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("k"), F.concat_ws(",", *[shown(c, t) for c, t in df.dtypes]).alias("value"))
    return top.union(body).orderBy("part", "k").select("value")
