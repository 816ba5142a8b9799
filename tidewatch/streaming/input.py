"""Input steps on streams: sentences of several parts and repeats, with keyed state and timers; equal to the batch steps of ``ingest``.

``live_outcomes`` is the streaming form of ``ingest.outcomes``. The same ``Assembler`` runs in both. Arrival is event time and nothing is
dropped as late, so there is no watermark: an open sentence is ended by the next part of its key, by a timer ``PATIENCE_S`` seconds of processing
time after the timeout, or by ``unfinished`` when the stream has been stopped. The time of such an end is the last part's time plus the timeout.
A stream that catches up on old records may take longer between two batches than these had lain apart; patience covers that.

State lives in RocksDB, which ``ready`` chooses for the session. A row for each part or repeat key, none for sentences of one part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import nmea
from tidewatch.operators import fragments, ingest

PATIENCE_S, SALTS = 600, 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PLAIN = "received_ns bigint, sequence string, source_id string, session bigint, tag string, channel string, payload string, fill_bits int, code string"


def ready(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store. Timers wait for the next batch with data: a stream at rest doesn't run empty batches for them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"received_ns": "int64", "session": "Int64", "fill_bits": "Int32"})


class Parts(StatefulProcessor):
    """One open sentence a key. What isn't a part of several passes as it is."""

    def __init__(self, timeout_ns: int = fragments.TIMEOUT_NS, patience_s: int = PATIENCE_S):
        self.timeout_ns, self.patience_s = timeout_ns, patience_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("text", T.StringType()), T.StructField("own", T.StringType())]))

    def _rows(self, found: list[tuple], own: list) -> list[tuple]:
        late = lambda at, code: (at + self.timeout_ns, "INCOMPLETE_FRAGMENT") if code == "EXPIRED" else (at, code)
        return [(late(at, code)[0], sequence, *own, payload, fill, late(at, code)[1]) for at, sequence, payload, fill, code in found]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        names, out = [c.split()[0] for c in _PLAIN.split(", ")], []
        every = pd.concat(list(rows)).sort_values(["received_ns", "sequence"], kind="stable")
        if key[-1] >= 0:
            yield every[names].astype({"fill_bits": "Int32"})
            return
        held = self.open.get() if self.open.exists() else None
        state = fragments.Assembler(int(every["total"].iloc[0]), held[0] if held else None, self.timeout_ns)
        own = None
        for ns, sequence, source, session, tag, channel, number, payload, fill in zip(*(every[c].tolist() for c in ("received_ns", "sequence", "source_id", "session", "tag", "channel", "number", "payload", "fill_bits")), strict=True):
            own = [source, int(session), tag, channel]
            out += self._rows(state.add(int(ns), sequence, int(number), payload, int(fill)), own)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        left = state.state()
        if left:
            self.open.update((left, json.dumps(own)))
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_ns // 1_000_000 + 1000 * self.patience_s)
        elif held:
            self.open.clear()
        yield _frame(out, names)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        rows = []
        if held:
            state = fragments.Assembler(0, held[0], self.timeout_ns)
            rows = self._rows([state.expired()], json.loads(held[1]))
            self.open.clear()
        yield _frame(rows, [c.split()[0] for c in _PLAIN.split(", ")])

    def close(self) -> None:
        pass


class Repeats(StatefulProcessor):
    """Whether a key was seen a second ago at most, be it a repeat itself. A clock that goes back repeats nothing."""

    def __init__(self, patience_s: int = PATIENCE_S):
        self.patience_s = patience_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ns", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PLAIN.split(", ")]
        every = pd.concat(list(rows)).sort_values(["received_ns", "sequence"], kind="stable")[names].astype({"fill_bits": "Int32"})
        if key[-1] >= 0:
            yield every.assign(repeated=False)
            return
        times = every["received_ns"].tolist()
        before = [self.last.get()[0] if self.last.exists() else None, *times[:-1]]
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.last.update((int(times[-1]),))
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1000 * self.patience_s)
        yield every.assign(repeated=[b is not None and 0 <= t - b <= ingest.REPEAT_NS for t, b in zip(times, before, strict=True)])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def _salt(passes: Column) -> Column:
    """Below zero for rows that meet by their key; what passes is dealt out evenly."""
    return F.when(passes, F.pmod(F.xxhash64("sequence", "received_ns"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("bigint").alias("salt")


def _text(c: str, passes: Column) -> Column:
    return F.when(~passes, F.coalesce(F.col(c).cast("string"), F.lit(""))).otherwise("").alias(f"k_{c}")


def live_outcomes(lines: DataFrame, patience_s: int = PATIENCE_S) -> DataFrame:
    """Streaming ``ingest.outcomes`` of ``lines(received_ns, sequence, sentence)``; ``source_id`` and ``session`` may be given, and ``code`` for rows that are known to be no sentence."""
    # as text of equal length, so that it sorts like the number
    df = lines.withColumn("sequence", F.col("sequence") if lines.schema["sequence"].dataType.simpleString() == "string" else F.lpad(F.col("sequence").cast("string"), 19, "0"))
    df = df if "session" in df.columns else df.withColumn("session", F.lit(0).cast("bigint"))
    df = df if "source_id" in df.columns else df.withColumn("source_id", F.lit("live"))
    df = df.withColumn("line_code", F.col("code") if "code" in df.columns else F.lit(None).cast("string")).drop("code")
    framed = nmea.with_envelope(df).withColumn("code", F.coalesce("line_code", "code"))
    passes = F.col("code").isNotNull() | (F.col("total") == 1)
    keyed = framed.select(*[c.split()[0] for c in _PLAIN.split(", ")], "number", "total", *[_text(c, passes) for c in fragments.KEY], _salt(passes))
    whole = keyed.groupBy(*[f"k_{c}" for c in fragments.KEY], "salt").transformWithStateInPandas(Parts(patience_s=patience_s), _PLAIN, "append", "ProcessingTime")
    failed = F.col("code").isNotNull()
    seen = whole.select("*", _text("source_id", failed), _text("payload", failed), _text("fill_bits", failed), _salt(failed))
    # the vessel and the type of a message are part of its payload
    seen = seen.groupBy("k_source_id", "k_payload", "k_fill_bits", "salt").transformWithStateInPandas(Repeats(patience_s), f"{_PLAIN}, repeated boolean", "append", "ProcessingTime")
    read = nmea.decoded(seen.withColumnRenamed("code", "before_decoding"))
    return read.withColumn("code", F.coalesce("before_decoding", "code", F.when(F.col("repeated"), "DUPLICATE"))).drop("before_decoding", "repeated")


def live_reports(outcomes: DataFrame) -> DataFrame:
    """Position reports out of ``live_outcomes``, as ``live_intervals`` takes them; numbers of records must be numbers here."""
    rows = outcomes.where("code IS NULL AND lat IS NOT NULL")
    return rows.select("mmsi", "vessel_class", "class_b_mode", F.col("received_ns").alias("ts_ns"), F.col("sequence").cast("bigint").alias("seq"), "session", "sog", "cog", "heading", "nav_status", "lat", "lon")


def unfinished(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped stream's checkpoint holds open: an INCOMPLETE_FRAGMENT each, at the last part's time plus the timeout."""
    known = spark.read.format("state-metadata").load(checkpoint).where(F.col("operatorProperties").contains('"open"')).select("operatorId").distinct().collect()
    held = spark.read.format("statestore").option("path", checkpoint).option("operatorId", known[0].operatorId).option("stateVarName", "open").load()
    parts = F.from_json("value.text", "array<string>")
    last, first = parts[2].cast("bigint"), parts[3]
    own = F.from_json("value.own", "array<string>")
    return held.select((last + fragments.TIMEOUT_NS).alias("received_ns"), first.alias("sequence"), own[0].alias("source_id"), own[1].cast("bigint").alias("session"), own[2].alias("tag"), own[3].alias("channel"), F.lit("INCOMPLETE_FRAGMENT").alias("code"))
