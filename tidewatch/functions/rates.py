"""Reporting-rate rules, losses, freshness, heat classes and length bands."""

from __future__ import annotations

NS = 1_000_000_000
GAP_S, JUMP_KM, STALE_FACTOR, CARRIER_SENSE_FAST_S = 1800, 30.0, 3.0, 30
LEAST_EXPECTED, LEAST_VESSELS = 30, 3


def expected_seconds(vessel_class: str = "vessel_class", sog: str = "sog", status: str = "nav_status", turning: str = "turning", mode: str = "class_b_mode") -> str:
    third = "1e1 / 3e0"
    a = f"""CASE WHEN {status} IN (1, 5) THEN CASE WHEN {sog} IS NULL OR {sog} <= 3 THEN 180e0 ELSE 10e0 END
      WHEN {sog} IS NULL THEN 10e0 WHEN {sog} <= 14 THEN CASE WHEN {turning} THEN {third} ELSE 10e0 END
      WHEN {sog} <= 23 THEN CASE WHEN {turning} THEN 2e0 ELSE 6e0 END ELSE 2e0 END"""
    b = f"""CASE WHEN {sog} IS NULL OR {sog} <= 2 THEN 180e0
      WHEN {mode} = 'CARRIER_SENSE' THEN CASE WHEN {sog} <= 14 THEN 30e0 ELSE {CARRIER_SENSE_FAST_S}e0 END
      WHEN {sog} <= 14 THEN 30e0 WHEN {sog} <= 23 THEN CASE WHEN {turning} THEN 5e0 ELSE 15e0 END ELSE 5e0 END"""
    return f"CASE WHEN {vessel_class} = 'B' THEN {b} ELSE {a} END"


def losses(actual: str, expected: str) -> str:
    return f"CAST(greatest(0e0, floor(({actual}) / ({expected}) + 0.5e0) - 1e0) AS BIGINT)"


def freshness_state(age_s: str, expected: str) -> str:
    return f"CASE WHEN ({expected}) IS NULL OR ({age_s}) < 0 THEN 'UNKNOWN' WHEN ({age_s}) <= ({expected}) THEN 'NORMAL' WHEN ({age_s}) <= {STALE_FACTOR}e0 * ({expected}) THEN 'CAUTION' ELSE 'VIOLATION' END"


def exclusion(delta_ns: str, start_km: str, end_km: str, lat: str, lon: str, start_lat: str, start_lon: str) -> str:
    """First reason for which an interval between two reports doesn't count; null if it does."""
    return f"""CASE WHEN {delta_ns} IS NULL THEN 'FIRST_REPORT'
      WHEN ({lat} = 0 AND {lon} = 0) OR ({start_lat} = 0 AND {start_lon} = 0) THEN 'INVALID_POSITION'
      WHEN {delta_ns} < 0 THEN 'NEGATIVE_INTERVAL' WHEN {delta_ns} >= {GAP_S} * CAST({NS} AS BIGINT) THEN 'GAP_30_MINUTES_OR_MORE'
      WHEN abs({end_km} - {start_km}) > {JUMP_KM}e0 THEN 'DISTANCE_JUMP_OVER_30_KM' END"""


def percent(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN ({part}) * 100e0 / ({whole}) END"


def sufficient(expected: str, vessels: str) -> str:
    return f"(({expected}) >= {LEAST_EXPECTED} AND ({vessels}) >= {LEAST_VESSELS})"


def reasons(expected: str, vessels: str) -> str:
    """Names of what is insufficient, comma-joined."""
    return f"concat(CASE WHEN ({expected}) < {LEAST_EXPECTED} THEN 'EXPECTED_COUNT' ELSE '' END, CASE WHEN ({expected}) < {LEAST_EXPECTED} AND ({vessels}) < {LEAST_VESSELS} THEN ',' ELSE '' END, CASE WHEN ({vessels}) < {LEAST_VESSELS} THEN 'DISTINCT_VESSELS' ELSE '' END)"


HEAT_LIMITS = (1, 5, 10, 20, 30, 50, 70, 90, 100)


def heat_class(percent_: str) -> str:
    return "CASE " + " ".join(f"WHEN ({percent_}) <= {limit} THEN {k}" for k, limit in enumerate(HEAT_LIMITS)) + f" WHEN ({percent_}) IS NOT NULL THEN {len(HEAT_LIMITS) - 1} END"


LENGTH_BANDS = ("<50 m", "50-99 m", "100-149 m", "150-199 m", "200-249 m", ">=250 m", "unknown")


def length_band(metres: str) -> str:
    """0..5 by 50 m, 6 for unknown, below 1 or above 500."""
    return f"CASE WHEN ({metres}) IS NULL OR ({metres}) < 1 OR ({metres}) > 500 THEN 6 WHEN ({metres}) < 50 THEN 0 WHEN ({metres}) < 100 THEN 1 WHEN ({metres}) < 150 THEN 2 WHEN ({metres}) < 200 THEN 3 WHEN ({metres}) < 250 THEN 4 ELSE 5 END"


def legacy_interval(category: str) -> str:
    return f"CASE {category} WHEN 5 THEN 360e0 END"


def legacy_gap_seconds(category: str, multiplier: int = 10) -> str:
    return f"(CASE {category} WHEN 5 THEN 360 ELSE 180 END * {multiplier})"
