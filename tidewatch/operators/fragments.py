"""Sentences of several parts, assembled in slices of time.

A key (``KEY``) has a few hundred values, so a receiver's whole history would run through as many tasks. Here a task holds a key's
parts of one slice of time. What stays open at a slice's end is carried: a slice that follows such a one within
the timeout is run again with the open parts put before its own. Few slices end with an open part, and most of them end as before, so
after a round or two nothing changes; a key that still changes after ``ROUNDS`` is streamed from its first unsettled slice on, in order.

An open sentence ends INCOMPLETE_FRAGMENT at the first following part or sentence of *any* key that comes more than the timeout after its
last part. That time is looked up for the few that expire, on first times by minute and by day, so that the fragments themselves aren't sorted by time.

Rules: a repeated part of the same payload is ignored and doesn't count as an arrival; another payload for part 1 ends what is open as
INCOMPLETE_FRAGMENT and begins anew; for another part it ends it and is itself INVALID_FRAGMENT. The fill bits are those of the last part.
Failures bear the ``sequence`` of the first part to arrive of what they end. Equal times are in the order of ``sequence``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.work import saved

NS = 1_000_000_000
TIMEOUT_NS, SLICE_NS, ROUNDS = 30 * NS, 600 * NS, 3
MINUTE_NS, DAY_NS = 60 * NS, 86_400 * NS
KEY = ["source_id", "tag", "sequence_id", "channel", "total"]
OUTCOME = ["received_ns", "sequence", "source_id", "tag", "channel", "payload", "fill_bits", "code"]


class Assembler:
    """The open sentence of one key. ``add`` returns outcomes: (time, sequence, payload, fill bits, code).

    The code EXPIRED has the time of the last part: when that was noticed depends on other keys.
    """

    def __init__(self, total: int, state: str | None = None, timeout_ns: int = TIMEOUT_NS):
        self.total, self.timeout_ns = total, timeout_ns
        self.parts, self.fill, self.last, self.first = {}, 0, 0, None
        if state:
            parts, self.fill, self.last, self.first = json.loads(state)
            self.parts = {int(k): v for k, v in parts.items()}

    def state(self) -> str | None:
        return json.dumps((self.parts, self.fill, self.last, self.first)) if self.parts else None

    def expired(self) -> tuple:
        self.parts = {}
        return self.last, self.first, None, None, "EXPIRED"

    def add(self, at: int, sequence, number: int, payload: str, fill: int, total: int | None = None) -> list[tuple]:
        out = [self.expired()] if self.parts and at - self.last > self.timeout_ns else []
        held = self.parts.get(number)
        if held is not None and held == payload:
            return out
        if held is not None:
            first, self.parts = self.first, {}
            if number > 1:
                return [*out, (at, sequence, None, None, "INVALID_FRAGMENT")]
            out.append((at, first, None, None, "INCOMPLETE_FRAGMENT"))
        if not self.parts:
            self.first, self.fill = sequence, 0
        self.parts[number], self.last = payload, at
        if number == self.total:
            self.fill = fill
        if len(self.parts) == self.total:
            out.append((at, sequence, "".join(self.parts[k] for k in range(1, self.total + 1)), self.fill, None))
            self.parts = {}
        return out


class OldAssembler:
    """The older decoder's rule: no timeout, the first part says how many there are, a part that is there stays, and the fill bits are those of the part that came last.

    A part beyond that number drops what is open. Nothing is reported but whole payloads.
    """

    def __init__(self, total: int, state: str | None = None, timeout_ns: int = 0):
        self.total, self.parts, self.fill, self.last, self.first = 0, {}, 0, 0, None
        if state:
            self.total, parts, self.last, self.first = json.loads(state)
            self.parts = {int(k): v for k, v in parts.items()}

    def state(self) -> str | None:
        return json.dumps((self.total, self.parts, self.last, self.first)) if self.parts else None

    def add(self, at: int, sequence, number: int, payload: str, fill: int, total: int) -> list[tuple]:
        if not self.parts:
            self.total, self.first = total, sequence
        if not 1 <= number <= self.total:
            self.parts = {}
            return []
        self.parts.setdefault(number, payload)
        self.last = at
        if len(self.parts) < self.total:
            return []
        whole = "".join(self.parts[k] for k in range(1, self.total + 1))
        self.parts = {}
        return [(at, sequence, whole, fill, None)]


_READ = ["key_", "slice_", "received_ns", "sequence", "number", "payload", "fill_bits", "total", "source_id", "tag", "channel", "carry_"]
_SHAPE = "key_ string, slice_ bigint, open_ boolean, first_ns bigint, state_ string, received_ns bigint, sequence {kind}, source_id string, tag string, channel string, payload string, fill_bits int, code string"


def _slices(timeout_ns: int, kind: pa.DataType, machine: type):
    """Parts sorted by key, slice and arrival: outcomes, and for each slice a row with what it leaves open (``open_`` true, state null if nothing)."""
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), kind, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in _SHAPE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, first, held = None, None, None, None

        def shown(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * len(types), types, strict=True)], names=names)

        def left() -> tuple:
            state = held.state()
            return (*at, True, first, state, held.last if state else None, held.first if state else None, *own, None, None, None)

        for batch in batches:
            out: list[tuple] = []
            for key, number_of_slice, ns, sequence, number, payload, fill, total, source, tag, channel, carry in zip(*(batch.column(c).to_pylist() for c in _READ), strict=True):
                if (key, number_of_slice) != at:
                    if at is not None:
                        out.append(left())
                    at, own, first, held = (key, number_of_slice), (source, tag, channel), ns, machine(total, carry, timeout_ns)
                out += [(*at, False, None, None, e[0], e[1], *own, *e[2:]) for e in held.add(ns, sequence, number, payload, fill, total)]
            yield shown(out)
        if at is not None:
            yield shown([left()])

    return run


def _stretch(ns: Column, length: int) -> Column:
    """Number of the stretch of time; whole stretches divide exactly, times as doubles don't."""
    return F.floor((ns - F.pmod(ns, F.lit(length))) / length).cast("bigint")


def noticed(expired: DataFrame, clock: DataFrame, timeout_ns: int = TIMEOUT_NS) -> DataFrame:
    """``expired`` rows with ``received_ns`` moved to the first fragment that comes more than the timeout later, or to the end of the input.

    ``clock(received_ns, is_fragment)`` are all lines. First times by minute and by day lead to the right minute, in which only its own lines are looked at.
    """
    minute, day = (lambda c, n=n: _stretch(c, n) for n in (MINUTE_NS, DAY_NS))
    times = clock.where("is_fragment").select("received_ns")
    minutes = saved(times.groupBy(minute(F.col("received_ns")).alias("minute")).agg(F.min("received_ns").alias("first_ns")), "first-times")
    days = minutes.groupBy(day(F.col("first_ns")).alias("day_")).agg(F.array_sort(F.collect_list(F.struct("minute", "first_ns"))).alias("minutes_"), F.min("first_ns").alias("first_ns"))
    whole = days.agg(F.array_sort(F.collect_list(F.struct(F.col("day_").alias("day"), "first_ns"))).alias("days_")).join(clock.agg(F.max("received_ns").alias("end_")))  # one row each
    due = expired.withColumn("due_", F.col("received_ns") + timeout_ns).withColumns({"minute_": minute(F.col("due_")), "day_": day(F.col("due_"))})
    asked = due.select("due_", "minute_").distinct()
    inside = asked.join(times.select("received_ns", minute(F.col("received_ns")).alias("minute_")), "minute_").where("received_ns > due_").groupBy("due_").agg(F.min("received_ns").alias("inside_"))
    df = due.join(inside, "due_", "left").join(days.drop("first_ns"), "day_", "left").join(F.broadcast(whole))
    later = lambda a, k, v: F.get(F.filter(a, lambda x: x[k] > v), F.lit(0))["first_ns"]
    at = F.coalesce("inside_", later("minutes_", "minute", F.col("minute_")), later("days_", "day", F.col("day_")), "end_")
    return df.withColumn("received_ns", at).select(*expired.columns)


def assembled_parts(parts: DataFrame, clock: DataFrame | None = None, slice_ns: int = SLICE_NS, timeout_ns: int = TIMEOUT_NS, rounds: int = ROUNDS, machine: type = Assembler, keys: list[str] = KEY) -> DataFrame:
    """Outcomes (``OUTCOME``) of the parts of multi-part sentences: whole payloads, and failures with their code.

    ``clock(received_ns, is_fragment)`` holds all lines of the input; without it the parts themselves are the clock. ``machine`` holds what is open of a key of ``keys``.
    """
    kind = parts.schema["sequence"].dataType
    shape, arrow = _SHAPE.format(kind=kind.simpleString()), pa.string() if kind.simpleString() == "string" else pa.int64()
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    rows = saved(parts.select(key.alias("key_"), _stretch(F.col("received_ns"), slice_ns).alias("slice_"), *[c for c in _READ if c not in ("key_", "slice_", "carry_")]), "parts")

    def run(df: DataFrame, name: str) -> DataFrame:
        dealt = df.select(*_READ).repartition("key_", "slice_").sortWithinPartitions("key_", "slice_", "received_ns", "sequence")
        return saved(dealt.mapInArrow(_slices(timeout_ns, arrow, machine), shape), name)

    nothing = F.lit(None).cast("string")
    results = run(rows.withColumn("carry_", nothing), "slices").withColumn("carry_", nothing)
    order = Window.partitionBy("key_").orderBy("slice_")
    columns, group = results.columns, ["key_", "slice_"]

    def unsettled() -> DataFrame:
        """Slices that were run with something else than what the slice before leaves open."""
        ends = results.where("open_").select(*group, "first_ns", "carry_", F.lag(F.struct("state_", "received_ns")).over(order).alias("before"))
        due = F.when(F.col("first_ns") - F.col("before.received_ns") <= timeout_ns, F.col("before.state_"))
        return saved(ends.select(*group, due.alias("due_"), "carry_").where("NOT (due_ <=> carry_)").select(*group, F.col("due_").alias("carry_")), "unsettled")

    for turn in range(rounds + 1):
        todo = unsettled()
        if not todo.limit(1).count():
            break
        if turn < rounds:
            again = run(rows.join(todo, group), f"slices-{turn}").join(todo, group)
            results = results.join(todo.select(*group), group, "left_anti").unionByName(again.select(*columns))
        else:
            start = saved(todo.groupBy("key_").agg(F.min("slice_").alias("from_"), F.min_by("carry_", "slice_").alias("carry_")), "unsettled-keys")
            late = rows.join(start, "key_").where("slice_ >= from_").withColumn("slice_", F.col("from_"))
            again = run(late, "slices-rest").withColumn("carry_", nothing)
            results = results.join(start.select("key_", "from_"), "key_", "left").where("from_ IS NULL OR slice_ < from_").select(*columns).unionByName(again.select(*columns))

    if machine is OldAssembler:
        return results.where("NOT open_").select(*OUTCOME)
    ends = results.where("open_").withColumn("next_", F.lead("first_ns").over(order))
    left = ends.where((F.col("state_").isNotNull()) & (F.col("next_").isNull() | (F.col("next_") - F.col("received_ns") > timeout_ns)))
    done = results.where("NOT open_")
    expired = saved(done.where("code = 'EXPIRED'").select(*OUTCOME).unionByName(left.select(*OUTCOME)).withColumn("code", F.lit("INCOMPLETE_FRAGMENT")), "expired")
    clock = rows.select("received_ns", F.lit(True).alias("is_fragment")) if clock is None else clock
    if not expired.limit(1).count():
        return done.where("code IS NULL OR code <> 'EXPIRED'").select(*OUTCOME)
    return done.where("code IS NULL OR code <> 'EXPIRED'").select(*OUTCOME).unionByName(noticed(expired, clock, timeout_ns))
