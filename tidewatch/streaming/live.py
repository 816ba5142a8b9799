"""Intervals of live reports: one keyed state per vessel, with the same results as the batch windows.

Arrival time is event time and nothing is dropped as late: a report older than its predecessor ends its interval as
NEGATIVE_INTERVAL. A change of ``session`` (a pause, an overflow of the source) ends it as LIVE_PAUSE_BOUNDARY.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo, rates
from tidewatch.operators.intervals import COG_LEAST_KN, HISTORY_NS, RELEASE_NS, TURN_DEGREES

OUT = "mmsi int, vessel_class string, seq bigint, start_ns bigint, ts_ns bigint, start_lat double, start_lon double, lat double, lon double, start_km double, reason string, turning boolean, expected_s double, actual_s double, missing bigint, stale_s double"
_NAMES = [c.split()[0] for c in OUT.split(", ")]


def _km(lat: float, lon: float) -> float:
    y0, y1 = math.radians(geo.RECEIVER_LAT), math.radians(lat)
    a = math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin(math.radians(lon - geo.RECEIVER_LON) / 2) ** 2
    return 2 * geo.EARTH_KM * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def expected_seconds(vessel_class: str, sog: float | None, status: int | None, turning: bool, mode: str | None) -> float:
    if vessel_class == "B":
        if sog is None or sog <= 2:
            return 180.0
        if sog <= 14:
            return 30.0
        if mode == "CARRIER_SENSE":
            return float(rates.CARRIER_SENSE_FAST_S)
        return (5.0 if turning else 15.0) if sog <= 23 else 5.0
    if status in (1, 5):
        return 180.0 if sog is None or sog <= 3 else 10.0
    if sog is None:
        return 10.0
    if sog <= 14:
        return 10 / 3 if turning else 10.0
    return (2.0 if turning else 6.0) if sog <= 23 else 2.0


class Vessel:
    """State of one vessel: last report by class, half a minute of directions, the course automaton."""

    def __init__(self, text: str | None = None):
        self.last, self.past, self.high, self.low_since = json.loads(text) if text else ({}, [], False, None)

    def text(self) -> str:
        return json.dumps((self.last, self.past, self.high, self.low_since))

    def turning(self, ts: int, heading: float | None, cog: float | None, sog: float | None, silent: bool) -> bool:
        own = (heading, cog if sog is not None and sog > COG_LEAST_KN else None)
        self.past = [p for p in self.past if p[0] >= ts - HISTORY_NS]
        kind = 0 if own[0] is not None else 1
        seen = [math.radians(p[1][kind]) for p in self.past if p[1][kind] is not None]
        self.past.append((ts, own))
        if silent or own[kind] is None or not seen:
            self.high, self.low_since = False, None
            return False
        mean = math.degrees(math.atan2(sum(map(math.sin, seen)), sum(map(math.cos, seen))))
        if round(abs((own[kind] - mean + 540) % 360 - 180), 9) > TURN_DEGREES:
            self.high, self.low_since = True, None
        elif self.low_since is None:
            self.low_since = ts
        return self.high and (self.low_since is None or ts - self.low_since <= RELEASE_NS)

    def step(self, r) -> tuple:
        clean = lambda v: None if v is None or v != v else v
        sog, cog, heading, status = clean(r.sog), clean(r.cog), clean(r.heading), clean(r.nav_status)
        km, before = _km(r.lat, r.lon), self.last.get(r.vessel_class)
        reason, delta = "FIRST_REPORT", None
        if before is not None:
            s_ns, s_lat, s_lon, s_km, expected, session = before
            delta, reason = r.ts_ns - s_ns, None
            if session != r.session:
                reason = "LIVE_PAUSE_BOUNDARY"
            elif (r.lat == 0 and r.lon == 0) or (s_lat == 0 and s_lon == 0):
                reason = "INVALID_POSITION"
            elif delta < 0:
                reason = "NEGATIVE_INTERVAL"
            elif delta >= rates.GAP_S * rates.NS:
                reason = "GAP_30_MINUTES_OR_MORE"
            elif abs(km - s_km) > rates.JUMP_KM:
                reason = "DISTANCE_JUMP_OVER_30_KM"
        if reason not in (None, "FIRST_REPORT"):
            self.past, self.high, self.low_since = [], False, None
        turning = self.turning(r.ts_ns, heading, cog, sog, r.vessel_class == "B" and r.class_b_mode == "CARRIER_SENSE")
        self.last[r.vessel_class] = (int(r.ts_ns), r.lat, r.lon, km, expected_seconds(r.vessel_class, sog, status, turning, r.class_b_mode), int(r.session))
        head = (r.mmsi, r.vessel_class, r.seq)
        if before is None:
            return (*head, None, r.ts_ns, None, None, r.lat, r.lon, None, reason, turning, None, None, None, None)
        actual = delta / rates.NS
        lost = max(0, math.floor(actual / expected + 0.5) - 1) if reason is None else None
        stale = max(0.0, actual - rates.STALE_FACTOR * expected) if reason is None else None
        return (*head, s_ns, r.ts_ns, s_lat, s_lon, r.lat, r.lon, s_km, reason, turning, expected, actual, lost, stale)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    vessel = Vessel(state.get[0] if state.exists else None)
    rows = pd.concat(list(batches)).sort_values(["ts_ns", "seq"], kind="stable")
    out = [vessel.step(r) for r in rows.itertuples()]
    state.update((vessel.text(),))
    yield pd.DataFrame(out, columns=_NAMES).astype({"start_ns": "Int64", "missing": "Int64"})


def live_intervals(reports: DataFrame) -> DataFrame:
    """Streaming ``analyzed``: one row per report. ``session`` may be missing."""
    if "session" not in reports.columns:
        reports = reports.withColumn("session", F.lit(0).cast("bigint"))
    return reports.groupBy("mmsi").applyInPandasWithState(_advance, OUT, "vessel string", "append", "NoTimeout")


def write_intervals(intervals: DataFrame, path: str, checkpoint: str):
    """Start the query; each micro-batch replaces its own folder, so a replayed batch doesn't count twice."""
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return intervals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
