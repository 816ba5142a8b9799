"""The registered queries as plain SQL for the correctness check.

Scalar rules are the same text as in ``functions``; joins, windows, cuts and aggregates are written out independently.
"""

from __future__ import annotations

from tidewatch.functions import geo, rates
from tidewatch.functions.steps import steps_sql
from tidewatch.operators import cube
from tidewatch.operators.reports import REPORT_STEPS

_REPORTS = "SELECT *, event_id AS seq FROM " + steps_sql("(SELECT event_id, user_id, epoch_us(ts) AS us FROM events)", REPORT_STEPS)

_PAIRED = f"""SELECT *, {rates.exclusion('delta_ns', 'b_km', 'km', 'lat', 'lon', 'b_lat', 'b_lon')} AS reason FROM (
  SELECT *, ts_ns - lag(ts_ns) OVER w AS delta_ns, lag(km) OVER w AS b_km, lag(lat) OVER w AS b_lat, lag(lon) OVER w AS b_lon, lag(ts_ns) OVER w AS start_ns
  FROM (SELECT *, {geo.receiver_km('lat', 'lon')} AS km FROM reports) WINDOW w AS (PARTITION BY mmsi, vessel_class ORDER BY ts_ns, seq))"""


def _course(scope: str = "mmsi") -> str:
    """Course automaton by self-join of each report with its half-minute history."""
    return f"""segmented AS (SELECT *, sum(CASE WHEN reason IS NOT NULL AND reason <> 'FIRST_REPORT' THEN 1 ELSE 0 END) OVER (PARTITION BY {scope} ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS segment FROM paired),
history AS (SELECT a.seq, {', '.join(f"sum({f}(radians(b.{d}))) {where} AS {k}_{n}" for k, d, where in (('h', 'heading', ''), ('c', 'cog', 'FILTER (b.sog > 2)')) for f, n in (('sin', 's'), ('cos', 'c')))},
  count(b.heading) AS h_n, count(b.cog) FILTER (b.sog > 2) AS c_n
  FROM segmented a JOIN segmented b ON {' AND '.join(f'a.{c} = b.{c}' for c in [*scope.split(', '), 'segment'])} AND b.ts_ns >= a.ts_ns - 30000000000 AND (b.ts_ns < a.ts_ns OR (b.ts_ns = a.ts_ns AND b.seq < a.seq)) GROUP BY a.seq),
kinds AS (SELECT s.*, CASE WHEN (vessel_class = 'B' AND class_b_mode = 'CARRIER_SENSE') OR direction IS NULL OR coalesce(n, 0) = 0 THEN 'R'
    WHEN round(abs((((direction - degrees(atan2(ss, cc)) + 540) % 360) + 360) % 360 - 180), 9) > 5 THEN 'H' ELSE 'L' END AS kind
  FROM (SELECT s.*, coalesce(heading, CASE WHEN sog > 2 THEN cog END) AS direction, CASE WHEN heading IS NOT NULL THEN h_n ELSE c_n END AS n, CASE WHEN heading IS NOT NULL THEN h_s ELSE c_s END AS ss, CASE WHEN heading IS NOT NULL THEN h_c ELSE c_c END AS cc
    FROM segmented s LEFT JOIN history h ON s.seq = h.seq) s),
runs AS (SELECT *, sum(CASE WHEN kind <> 'L' THEN 1 ELSE 0 END) OVER (PARTITION BY {scope}, segment ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM kinds),
course AS (SELECT *, coalesce(max(CASE WHEN kind <> 'L' THEN kind END) OVER r = 'H' AND (kind = 'H' OR ts_ns - min(CASE WHEN kind = 'L' THEN ts_ns END) OVER r <= 20000000000), false) AS turning FROM runs WINDOW r AS (PARTITION BY {scope}, segment, run)),
rated AS (SELECT *, {rates.expected_seconds()} AS expected_here FROM course),
analyzed AS (SELECT *, CASE WHEN reason IS NULL THEN {rates.losses('actual_s', 'expected_s')} END AS missing, CASE WHEN reason IS NULL THEN greatest(0e0, actual_s - 3e0 * expected_s) END AS stale_s, b_lat AS start_lat, b_lon AS start_lon, b_km AS start_km,
    CASE WHEN reason IS NULL THEN start_ns + CAST(floor(3e0 * expected_s * 1000000000 + 0.5e0) AS BIGINT) END AS stale_start_ns
  FROM (SELECT *, lag(expected_here) OVER (PARTITION BY mmsi, vessel_class ORDER BY ts_ns, seq) AS expected_s, delta_ns / 1e9 AS actual_s FROM rated)),
accepted AS (SELECT * FROM analyzed WHERE reason IS NULL)"""


def _base(scope: str = "mmsi") -> str:
    return f"WITH reports AS MATERIALIZED ({_REPORTS}), paired AS MATERIALIZED ({_PAIRED}), {_course(scope)}"


_FLAT = "flat AS MATERIALIZED (SELECT * FROM " + steps_sql("accepted", geo.to_utm("start_lat", "start_lon", "e0", "n0") + geo.to_utm("lat", "lon", "e1", "n1")) + ")"

_LOST = (
    "lost AS (SELECT * FROM "
    + steps_sql(
        "(SELECT *, start_ns + step AS at_ns, e0 + (e1 - e0) * (CAST(step AS DOUBLE) / delta_ns) AS pe, n0 + (n1 - n0) * (CAST(step AS DOUBLE) / delta_ns) AS pn FROM (SELECT *, CAST(floor(i * expected_s * 1000000000 + 0.5e0) AS BIGINT) AS step FROM (SELECT *, unnest(generate_series(1, missing)) AS i FROM flat WHERE missing > 0)))",
        geo.from_utm("pe", "pn", "p_lat", "p_lon"),
    )
    + ")"
)


def _pieces(name: str, cuts: str) -> str:
    """Pieces between neighbouring cut ratios of each interval; ``cuts`` selects (seq, r)."""
    return f"""{name}_cuts AS (SELECT DISTINCT seq, r FROM (SELECT seq, 0e0 AS r FROM flat UNION ALL SELECT seq, 1e0 FROM flat UNION ALL SELECT seq, r FROM ({cuts}) WHERE r > 1e-12 AND r < 1 - 1e-12)),
{name}_spans AS (SELECT seq, r AS r0, lead(r) OVER (PARTITION BY seq ORDER BY r) AS r1 FROM {name}_cuts),
{name} AS (SELECT * FROM (SELECT f.*, start_ns + CAST(floor(delta_ns * r0 + 0.5e0) AS BIGINT) AS piece_ns, start_ns + CAST(floor(delta_ns * r1 + 0.5e0) AS BIGINT) AS piece_end_ns, e0 + (e1 - e0) * ((r0 + r1) / 2) AS me, n0 + (n1 - n0) * ((r0 + r1) / 2) AS mn
  FROM {name}_spans s JOIN flat f ON s.seq = f.seq WHERE r1 IS NOT NULL) WHERE piece_ns < piece_end_ns)"""


def _lines(a: str, b: str) -> str:
    return f"SELECT seq, (k * 2000e0 - {a}) / ({b} - {a}) AS r FROM (SELECT seq, {a}, {b}, unnest(generate_series(CAST(floor(least({a}, {b}) / 2000e0) AS BIGINT) + 1, CAST(ceil(greatest({a}, {b}) / 2000e0) AS BIGINT) - 1)) AS k FROM flat WHERE abs({b} - {a}) >= 1e-9)"


_GRID = _pieces("grid", _lines("e0", "e1") + " UNION ALL " + _lines("n0", "n1"))
_CE, _CN = (geo.num(x) for x in cube.receiver_utm())
_RINGS = _pieces(
    "ring",
    f"""SELECT seq, (-qb + sg * sqrt(qb * qb - 4 * qa * (qc - rad * rad))) / (2 * qa) AS r FROM (SELECT seq, (e1 - e0) * (e1 - e0) + (n1 - n0) * (n1 - n0) AS qa, 2 * ((e0 - {_CE}) * (e1 - e0) + (n0 - {_CN}) * (n1 - n0)) AS qb, (e0 - {_CE}) * (e0 - {_CE}) + (n0 - {_CN}) * (n0 - {_CN}) AS qc FROM flat)
  CROSS JOIN (SELECT 5000e0 * unnest(generate_series(1, 14)) AS rad) CROSS JOIN (SELECT unnest([-1, 1]) AS sg) WHERE qa > 1e-18 AND qb * qb - 4 * qa * (qc - rad * rad) >= 0""",
)
_RING_BAND = f"ring_banded AS (SELECT *, {geo.band(geo.receiver_km('m_lat', 'm_lon'))} AS band FROM {steps_sql('ring', geo.from_utm('me', 'mn', 'm_lat', 'm_lon'))})"

_B = cube.BUCKET_NS


def _shares(source: str, a: str, b: str) -> str:
    return f"(SELECT *, greatest({a}, bucket) AS lo, least({b}, bucket + {_B}) AS hi FROM (SELECT *, unnest(generate_series({a} - {a} % {_B}, ({b} - 1) - ({b} - 1) % {_B}, {_B})) AS bucket FROM {source} WHERE {a} < {b}))"


def _durations(source: str, place: str) -> str:
    return f"SELECT bucket, {place}, vessel_class, mmsi, 0 AS observed, 0 AS missing, (hi - lo) / 1e9 AS observed_s, greatest(0, hi - greatest(lo, stale_start_ns)) / 1e9 AS stale_s FROM {_shares(source, 'piece_ns', 'piece_end_ns')}"


def _point(source: str, at: str, place: str, observed: int) -> str:
    return f"SELECT {at} - {at} % {_B} AS bucket, {place}, vessel_class, mmsi, {observed} AS observed, {1 - observed} AS missing, 0e0 AS observed_s, 0e0 AS stale_s FROM {source}"


_BAND_ROWS = f"""{_FLAT}, {_LOST}, {_RINGS}, {_RING_BAND}, parts AS MATERIALIZED (SELECT *, DATE '1970-01-01' + CAST((bucket + {cube.JST_NS}) // {cube.DAY_NS} AS INT) AS day, ((bucket + {cube.JST_NS}) % {cube.DAY_NS}) // 3600000000000 AS hour FROM (
  {_point('flat', 'start_ns', geo.band('start_km') + ' AS band', 1)} UNION ALL {_point('lost', 'at_ns', geo.band(geo.receiver_km('p_lat', 'p_lon')) + ' AS band', 0)} UNION ALL {_durations('ring_banded', 'band')}) WHERE band IS NOT NULL)"""
_CELL_ROWS = f"""{_FLAT}, {_LOST}, {_GRID}, parts AS MATERIALIZED ({_point('flat', 'start_ns', geo.cell('e0') + ' AS col, ' + geo.cell('n0') + ' AS row', 1)} UNION ALL {_point('lost', 'at_ns', geo.cell('pe') + ' AS col, ' + geo.cell('pn') + ' AS row', 0)}
  UNION ALL {_durations('grid', geo.cell('me') + ' AS col, ' + geo.cell('mn') + ' AS row')})"""

#: Added before rounding to four digits: times are whole microseconds, so halves are frequent and would go either way.
_OFF_TIES = "3e-7"

_SUMS = "CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(missing) AS BIGINT) AS missing, sum(observed_s) AS observed_s, sum(stale_s) AS stale_s"
_SHOWN = f"observed, missing, round(observed_s + {_OFF_TIES}, 4) AS observed_s, round(stale_s + {_OFF_TIES}, 4) AS stale_s"
_RATES = f"round({rates.percent('missing', 'observed + missing')} + {_OFF_TIES}, 4) AS loss_pct, round({rates.percent('stale_s', 'observed_s')} + {_OFF_TIES}, 4) AS stale_pct, {rates.reasons('(observed + missing)', 'vessels')} AS insufficient"

_PERIODS = {"day": "strftime(day, '%Y-%m-%d')", "day_of_week": "upper(dayname(day))", "month": "strftime(day, '%Y-%m')", "year": "strftime(day, '%Y')", "hour_of_day": "lpad(CAST(hour AS VARCHAR), 2, '0')"}


def _rolled(period: str) -> str:
    return f"(SELECT {period} AS period, band, vessel_class, {_SUMS}, count(DISTINCT mmsi) AS vessels, count(DISTINCT day) AS days FROM parts GROUP BY ALL)"


_DAYS = f"report_days AS MATERIALIZED (SELECT *, DATE '1970-01-01' + CAST((start_ns + {cube.JST_NS}) // {cube.DAY_NS} AS INT) AS day FROM (SELECT *, {geo.band('start_km')} AS band FROM accepted) WHERE band IS NOT NULL)"
_UPDATES = """updates AS (SELECT CAST(user_id % 25 + 431000000 AS INT) AS mmsi, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'UNKNOWN' WHEN (user_id % 25 + 431000000) % 5 = 0 THEN 'B' ELSE 'A' END AS vessel_class,
  CASE WHEN event_id % 3 = 0 THEN CAST(((user_id % 25 + 431000000) * 29 + (event_id // 400) * 60) % 520 AS INT) END AS ship_length_m, CASE WHEN event_id % 7 = 0 THEN 'V' || CAST(event_id % 14 AS VARCHAR) END AS vessel_name FROM events)"""
_HISTORY = f"""{_UPDATES}, states AS (SELECT mmsi, ts_ns, seq, coalesce(last_value(nullif(vessel_class, 'UNKNOWN') IGNORE NULLS) OVER w, 'UNKNOWN') AS vessel_class, last_value(vessel_name IGNORE NULLS) OVER w AS vessel_name, last_value(ship_length_m IGNORE NULLS) OVER w AS ship_length_m
  FROM updates WINDOW w AS (PARTITION BY mmsi ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)),
instants AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY mmsi, ts_ns ORDER BY seq DESC) = 1),
changed AS (SELECT * FROM instants WINDOW v AS (PARTITION BY mmsi ORDER BY ts_ns) QUALIFY row_number() OVER v = 1 OR (lag(vessel_class) OVER v, lag(vessel_name) OVER v, lag(ship_length_m) OVER v) IS DISTINCT FROM (vessel_class, vessel_name, ship_length_m)),
versions AS (SELECT mmsi, ts_ns AS valid_from, lead(ts_ns) OVER (PARTITION BY mmsi ORDER BY ts_ns) AS valid_to, vessel_class, vessel_name, ship_length_m FROM changed)"""
_LENGTHS = f"""{_UPDATES}, lengths AS (SELECT mmsi, ts_ns AS valid_from, max(ship_length_m) AS ship_length_m FROM updates WHERE ship_length_m IS NOT NULL GROUP BY ALL),
asked AS (SELECT DISTINCT mmsi, day FROM report_days), known AS (SELECT a.mmsi, a.day, arg_max(ship_length_m, valid_from) AS ship_length_m FROM asked a LEFT JOIN lengths l ON a.mmsi = l.mmsi AND l.valid_from < (date_diff('day', DATE '1970-01-01', a.day) + 1) * {cube.DAY_NS} - {cube.JST_NS} GROUP BY ALL),
sized AS (SELECT r.*, {rates.length_band('k.ship_length_m')} AS length_band FROM report_days r JOIN known k ON r.mmsi = k.mmsi AND r.day = k.day)"""
_CAL = "cal AS (SELECT day, band, vessel_class, mmsi, count(*) AS observed, sum(missing) AS missing FROM report_days GROUP BY ALL)"
_POOLED = "pooled AS (SELECT band, vessel_class, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(missing) AS BIGINT) AS missing, count(DISTINCT mmsi) AS vessels, count(DISTINCT day) AS days, CAST(sum(observed + missing) AS BIGINT) AS expected FROM cal GROUP BY ALL)"
_PARAMETERS = """grid0 AS (SELECT CAST(b AS INT) AS band, c AS vessel_class FROM (SELECT unnest(generate_series(0, 13)) AS b) CROSS JOIN (SELECT unnest(['A', 'B']) AS c)),
cells0 AS (SELECT g.band, g.vessel_class, (observed + 0.5e0) / (expected + 1e0) AS p, coalesce(expected >= 30 AND vessels >= 3 AND days >= 5, false) AS direct FROM grid0 g LEFT JOIN pooled p USING (band, vessel_class)),
model AS (SELECT c.band, c.vessel_class, CASE WHEN direct THEN 'DIRECT' WHEN lo.band IS NOT NULL AND hi.band IS NOT NULL THEN 'INTERPOLATED' ELSE 'OUT_OF_MODEL' END AS kind,
  CASE WHEN direct THEN c.p WHEN lo.band IS NOT NULL AND hi.band IS NOT NULL THEN lo.p + (hi.p - lo.p) * (c.band - lo.band) / (hi.band - lo.band) END AS p,
  CASE WHEN NOT direct AND hi.band IS NOT NULL THEN lo.band END AS from_band, CASE WHEN NOT direct AND lo.band IS NOT NULL THEN hi.band END AS to_band
  FROM cells0 c LEFT JOIN (SELECT c.band AS at, c.vessel_class, max(d.band) AS band, arg_max(d.p, d.band) AS p FROM cells0 c JOIN cells0 d ON d.direct AND d.vessel_class = c.vessel_class AND d.band < c.band GROUP BY ALL) lo ON lo.at = c.band AND lo.vessel_class = c.vessel_class
  LEFT JOIN (SELECT c.band AS at, c.vessel_class, min(d.band) AS band, arg_min(d.p, d.band) AS p FROM cells0 c JOIN cells0 d ON d.direct AND d.vessel_class = c.vessel_class AND d.band > c.band GROUP BY ALL) hi ON hi.at = c.band AND hi.vessel_class = c.vessel_class)"""
_LEGACY = f"""cats AS (SELECT *, CASE WHEN message_type IN (1, 2, 3) THEN 1 ELSE message_type END AS category FROM rated),
legacy_pairs AS (SELECT *, lag(km) OVER w AS s_km, lag(expected_here) OVER w AS own_s, lag(ts_ns) OVER w AS s_ns, (ts_ns - lag(ts_ns) OVER w) / 1e9 AS gap_s FROM cats WINDOW w AS (PARTITION BY mmsi, category ORDER BY ts_ns, seq)),
legacy AS MATERIALIZED (SELECT mmsi, category, gap_s, s_km, s_ns, {rates.losses('gap_s', 'own_s')} AS loss, DATE '1970-01-01' + CAST((s_ns + {cube.JST_NS}) // {cube.DAY_NS} AS INT) AS start_day FROM legacy_pairs WHERE s_ns IS NOT NULL AND gap_s >= 0 AND gap_s < 1800 AND abs(km - s_km) <= 30)"""
_TOTALS = "totals AS (SELECT mmsi, category, count(*) AS total, CAST(sum(loss) AS BIGINT) AS loss, CAST(max(floor(gap_s + 0.5e0)) AS BIGINT) AS max_s, avg(floor(gap_s + 0.5e0)) AS avg_s, max(s_km) FILTER (loss > 0) AS max_lossy_km, sum(loss) * 100e0 / (count(*) + sum(loss)) AS loss_pct FROM legacy GROUP BY ALL HAVING count(*) >= CASE category WHEN 5 THEN 10 ELSE 100 END)"
_DAILY = f"daily AS (SELECT CAST(start_day + CAST(mmsi % 25 * 9 AS INT) AS DATE) AS day, category, mmsi, count(*) AS observed, CAST(sum(loss) AS BIGINT) AS loss FROM legacy GROUP BY ALL), daily_rates AS (SELECT *, {rates.percent('loss', 'observed + loss')} AS loss_pct FROM (SELECT day, category, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(loss) AS BIGINT) AS loss, count(DISTINCT mmsi) AS vessels FROM daily GROUP BY ALL))"
_RESEARCH = {"year": "strftime(day, '%Y')", "month": "strftime(day, '%Y-%m')", "date": "strftime(day, '%Y-%m-%d')", "weekday": "dayname(day)", "iso_week": "strftime(day, '%G-W%V')"}


#: One part after the other of every key, by recursion; what is open is a part, since sentences have two.
_FRAGMENTS = """WITH RECURSIVE timed AS (SELECT event_id, user_id, event_type, ((epoch_us(ts) - 1704067200000000) // 50000) * 1000000 AS ns, event_id % 8 AS way FROM events),
places AS (SELECT * FROM (VALUES (0, 1, 2, 0, '', 0), (3, 1, 2, 0, '', 0), (4, 1, 2, 0, '', 0), (5, 1, 2, 0, '', 0), (7, 1, 2, 0, '', 0), (1, 2, 2, 0, '', 0), (2, 2, 2, 0, '', 0), (6, 1, 1, 0, '', 0), (2, 1, 2, 100, '', 1), (3, 1, 2, 50, '', 1), (4, 1, 2, 50, 'x', 1), (1, 2, 2, 50, 'x', 1),
  (3, 2, 2, 100, '', 2), (4, 2, 2, 100, '', 2), (5, 2, 2, 9000, '', 2), (7, 2, 2, 100, '', 2)) AS t(way, number, total, ms, mark, place)),
sent AS MATERIALIZED (SELECT ns + ms * CAST(1000000 AS BIGINT) AS ns, event_id * 4 + place AS seq, total, number, event_type || number || mark AS payload, CASE WHEN total = 2 AND number = 2 THEN 2 ELSE 0 END AS fill, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS channel, (event_id % 10) * 2 + user_id % 2 AS key FROM timed JOIN places USING (way)),
multi AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ns, seq) AS k FROM sent WHERE total = 2),
steps AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS held, CAST(NULL AS VARCHAR) AS body, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS ns, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS payload, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS BIGINT) AS gone, CAST(NULL AS BIGINT) AS gone_seq FROM (SELECT DISTINCT key FROM multi)
  UNION ALL SELECT key, k, CASE WHEN open IS NULL OR (open = number AND (body = payload OR number = 1)) THEN number END, CASE WHEN open = number AND body = payload THEN body ELSE payload END, CASE WHEN open = number AND body = payload THEN last ELSE ns END, CASE WHEN open = number AND body = payload THEN first ELSE seq END,
    ns, CASE WHEN open = number AND number = 1 THEN first ELSE seq END, CASE WHEN open <> number THEN CASE WHEN number = 2 THEN body || payload ELSE payload || body END END,
    CASE WHEN open = number AND body <> payload THEN CASE WHEN number = 1 THEN 'INCOMPLETE_FRAGMENT' ELSE 'INVALID_FRAGMENT' END WHEN open <> number THEN 'WHOLE' END, CASE WHEN late THEN last END, CASE WHEN late THEN first END
  FROM (SELECT m.*, s.body, s.last, s.first, s.held IS NOT NULL AND m.ns - s.last > 30000000000 AS late, CASE WHEN m.ns - s.last <= 30000000000 THEN s.held END AS open FROM steps s JOIN multi m ON m.key = s.key AND m.k = s.k + 1)),
expired AS (SELECT key, gone, gone_seq FROM steps WHERE gone IS NOT NULL UNION ALL SELECT key, last, first FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1) WHERE held IS NOT NULL),
named AS (SELECT DISTINCT key, channel FROM sent)
SELECT ns AS received_ns, seq AS sequence, channel, payload, fill AS fill_bits, CAST(NULL AS VARCHAR) AS code FROM sent WHERE total = 1
UNION ALL SELECT ns, seq, channel, payload, CASE WHEN code = 'WHOLE' THEN 2 END, nullif(code, 'WHOLE') FROM steps JOIN named USING (key) WHERE code IS NOT NULL
UNION ALL SELECT coalesce(f.ns, (SELECT max(ns) FROM sent)), gone_seq, channel, NULL, NULL, 'INCOMPLETE_FRAGMENT' FROM (SELECT *, gone + 30000000000 AS due FROM expired) e JOIN named USING (key) ASOF LEFT JOIN (SELECT DISTINCT ns FROM sent) f ON f.ns > e.due"""


def _snapshots(times: tuple[int, ...], mmsi: str = "mmsi", of: str = "true") -> str:
    """Latest report of each vessel at each time among those ``of`` the same day as the time."""
    rows = f"shown AS (SELECT t.at_ns, {mmsi} AS vessel, r.* FROM rated r JOIN (SELECT unnest([{', '.join(map(str, times))}]) AS at_ns) t ON r.ts_ns <= t.at_ns AND {of})"
    last = "SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY at_ns, vessel ORDER BY ts_ns DESC, seq DESC) = 1"
    points = "SELECT at_ns, vessel, count(*) AS n_points FROM shown WHERE ts_ns >= at_ns - 3600000000000 GROUP BY ALL"
    return f"""{rows} SELECT at_ns, CAST(vessel AS INT) AS mmsi, vessel_class, round(lat, 6) AS lat, round(lon, 6) AS lon, round(coalesce(heading, cog), 6) AS direction, round(age, 6) AS age_s, round(expected_here, 6) AS expected_s,
  CASE WHEN age <= expected_here THEN 'NORMAL' WHEN age <= 3 * expected_here THEN 'CAUTION' ELSE 'VIOLATION' END AS state, age < 600 AS visible, CAST(coalesce(n_points, 0) AS INT) AS trail_points
FROM (SELECT *, (at_ns - ts_ns) / 1e9 AS age FROM ({last})) LEFT JOIN ({points}) USING (at_ns, vessel)"""


_DAY_NO = f"((%s + {cube.JST_NS}) // {cube.DAY_NS})"
#: Vessels of each day apart: the engine's partitions take the day from the number.
_DAYS_APART = f"WITH reports AS MATERIALIZED (SELECT * REPLACE (CAST(mmsi AS BIGINT) * 100000 + {_DAY_NO % 'ts_ns'} AS mmsi) FROM ({_REPORTS})), paired AS MATERIALIZED ({_PAIRED}), {_course()}"

_GAPS = """gaps0 AS (SELECT mmsi, seq, sog, class_b_mode, CASE WHEN seq % 40 = 7 THEN ts_ns - 400000000000 ELSE ts_ns END AS at_ns, expected_here, CASE WHEN message_type IN (1, 2, 3) THEN 1 ELSE message_type END AS category FROM rated),
gaps1 AS (SELECT category, ((at_ns - lag(at_ns) OVER w) // 1000000) / 1e3 AS gap_s, lag(expected_here) OVER w AS own_s, lag(sog) OVER w AS sog, lag(class_b_mode) OVER w AS unit, lag(seq) OVER w IS NULL AS is_first FROM gaps0 WINDOW w AS (PARTITION BY mmsi, category ORDER BY seq)),
gaps AS MATERIALIZED (SELECT *, CASE WHEN is_first THEN 'FIRST' WHEN gap_s < 0 THEN 'NEGATIVE' WHEN gap_s >= 1800 THEN 'TRACK_GAP' ELSE 'VALID' END AS kind, greatest(0, floor(gap_s / own_s + 0.5) - 1) AS loss, greatest(0, floor(floor(gap_s + 0.5) / own_s + 0.5) - 1) AS whole_loss FROM gaps1)"""


def _round(columns: str, doubles: str, digits: int = 6) -> str:
    return ", ".join([*columns.split(), *(f"round({d}, {digits}) AS {d}" for d in doubles.split())])


def oracle_sql() -> dict[str, str]:
    base, both = _base(), _base("mmsi, vessel_class")
    cal = f"{base}, {_DAYS}, {_CAL}, {_POOLED}"
    gps = geo.destination("lat", "lon", "10e0", "45e0")
    mercator = geo.mercator("lat", "lon")
    sql = {
        "loss_by_distance_class": f"{base} SELECT band, vessel_class, count(*) AS observed, CAST(sum(missing) AS BIGINT) AS missing, count(DISTINCT mmsi) AS vessels, round(sum(missing) * 100e0 / (count(*) + sum(missing)), 6) AS loss_pct FROM (SELECT *, {geo.band('start_km')} AS band FROM accepted) WHERE band IS NOT NULL GROUP BY ALL",
        "course_state": f"{base} SELECT event_id, mmsi, kind, turning FROM course",
        "report_intervals": f"{base} SELECT {_round('event_id mmsi reason missing', 'expected_s actual_s stale_s')} FROM analyzed",
        "exclusion_counts": f"{base} SELECT reason, count(*) AS n FROM analyzed WHERE reason IS NOT NULL GROUP BY ALL",
        "run_summary": f"{base} SELECT count(*) FILTER (reason IS NULL) AS accepted, CAST(coalesce(sum(missing), 0) AS BIGINT) AS missing, count(*) AS reports FROM analyzed",
        "projection": f"SELECT event_id, round(e, 4) AS e, round(n, 4) AS n, {geo.cell('e')} AS col, {geo.cell('n')} AS row, round(abs(lat2 - lat) + abs(lon2 - lon), 7) AS error FROM {steps_sql(f'({_REPORTS})', geo.to_utm('lat', 'lon', 'e', 'n') + geo.from_utm('e', 'n', 'lat2', 'lon2'))}",
        "receiver_distance": f"SELECT event_id, round(km, 6) AS km, {geo.band('km')} AS band, round({gps[0]}, 6) AS lat_10km, round({gps[1]}, 6) AS lon_10km, round({mercator[0]}, 3) AS mercator_x, round({mercator[1]}, 3) AS mercator_y FROM (SELECT *, {geo.receiver_km('lat', 'lon')} AS km FROM ({_REPORTS}))",
        "bucket_split": f"{base} SELECT bucket, vessel_class, count(*) AS n, round(sum((hi - lo) / 1e9), 6) AS seconds FROM {_shares('accepted', 'start_ns', 'ts_ns')} GROUP BY ALL",
        "missing_positions": f"{base}, {_FLAT}, {_LOST} SELECT mmsi, count(*) AS n, CAST(sum(at_ns % 1000003) AS BIGINT) AS time_digest, round(avg(p_lat), 6) AS lat, round(avg(p_lon), 6) AS lon FROM lost GROUP BY ALL",
        "grid_allocation": f"{base}, {_FLAT}, {_GRID} SELECT mmsi, count(*) AS pieces, CAST(sum(piece_end_ns - piece_ns) AS BIGINT) AS ns, count(DISTINCT ({geo.cell('me')}, {geo.cell('mn')})) AS cells FROM grid GROUP BY ALL",
        "interval_nanoseconds": f"{base} SELECT mmsi, CAST(sum(delta_ns) AS BIGINT) AS ns, CAST(sum(delta_ns) AS BIGINT) AS whole, true AS same FROM accepted GROUP BY ALL HAVING sum(delta_ns) > 0",
        "cell_metric_5m": f"{base}, {_CELL_ROWS} SELECT bucket, col, row, vessel_class, {_SHOWN}, vessels FROM (SELECT bucket, col, row, vessel_class, {_SUMS}, count(DISTINCT mmsi) AS vessels FROM parts GROUP BY ALL)",
        "distance_metric_5m": f"{base}, {_BAND_ROWS} SELECT bucket, band, vessel_class, {_SHOWN}, vessels FROM (SELECT bucket, band, vessel_class, {_SUMS}, count(DISTINCT mmsi) AS vessels FROM parts GROUP BY ALL)",
        "vessel_day_metric": f"{base}, {_BAND_ROWS} SELECT day, band, vessel_class, mmsi, {_SHOWN} FROM (SELECT day, band, vessel_class, mmsi, {_SUMS} FROM parts GROUP BY ALL)",
        "heat_cells": f"{base}, {_CELL_ROWS} SELECT col, row, {_SHOWN}, vessels, {_RATES}, {rates.heat_class('round(' + rates.percent('missing', 'observed + missing') + ', 9)')} AS heat, round(lat + {_OFF_TIES}, 4) AS lat, round(lon + {_OFF_TIES}, 4) AS lon, round({geo.receiver_km('lat', 'lon')} + {_OFF_TIES}, 4) AS km FROM {steps_sql(f'(SELECT col, row, {_SUMS}, count(DISTINCT mmsi) AS vessels FROM parts GROUP BY ALL)', [('ce', '(col + 0.5e0) * 2000e0'), ('cn', '(row + 0.5e0) * 2000e0'), *geo.from_utm('ce', 'cn', 'lat', 'lon')])}",
        "distance_hour": f"{base}, {_BAND_ROWS} SELECT period, band, vessel_class, observed, missing, vessels, CASE WHEN {rates.sufficient('observed + missing', 'vessels')} THEN round({rates.percent('missing', 'observed + missing')} + {_OFF_TIES}, 4) END AS loss_pct FROM {_rolled(_PERIODS['hour_of_day'])}",
        "vessel_presence": f"{base}, {_BAND_ROWS} SELECT band, vessel_class, count(DISTINCT mmsi) AS vessels, count(DISTINCT (day, mmsi)) AS vessel_days, count(DISTINCT day) AS days FROM parts GROUP BY ALL",
        "daily_distance_summary": f"{base}, {_BAND_ROWS} SELECT band, vessel_class, round(sum(missing) * 100e0 / sum(observed + missing) + {_OFF_TIES}, 4) AS pooled_pct, round(quantile_cont(ok, 0.25) + {_OFF_TIES}, 4) AS q1, round(quantile_cont(ok, 0.75) + {_OFF_TIES}, 4) AS q3, count(ok) AS days FROM (SELECT *, CASE WHEN {rates.sufficient('observed + missing', 'vessels')} THEN {rates.percent('missing', 'observed + missing')} END AS ok FROM {_rolled(_PERIODS['day'])}) GROUP BY ALL HAVING count(ok) > 0",
        "outside_range": f"{base}, {_FLAT}, {_LOST} SELECT (SELECT count(*) FROM flat WHERE ({geo.band('start_km')}) IS NULL) + (SELECT count(*) FROM lost WHERE ({geo.band(geo.receiver_km('p_lat', 'p_lon'))}) IS NULL) AS outside",
        "decode_roundtrip": f"SELECT event_id, message_type, mmsi, CASE WHEN message_type = 18 THEN 'B' ELSE 'A' END AS vessel_class, round(sog, 6) AS sog, round(cog, 6) AS cog, heading, nav_status, round(round(lat * 600000) / 600000e0, 6) AS lat, round(round(lon * 600000) / 600000e0, 6) AS lon FROM ({_REPORTS})",
        "checksum": "SELECT event_id, upper(printf('%02x', list_reduce([ascii(c) FOR c IN string_split(body, '')], lambda a, x: xor(a, x)))) AS checksum, CASE event_id % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'MALFORMED' WHEN 2 THEN 'INVALID' ELSE 'VALID' END AS state FROM (SELECT event_id, 'AIVDM,' || event_type || props AS body FROM events)",
        "dedup_1s": "SELECT event_type, count(*) AS kept, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT *, ns - lag(ns) OVER (PARTITION BY event_type ORDER BY ns, event_id) AS gap FROM (SELECT event_type, event_id, (epoch_us(ts) - 1704067200000000) * 5 AS ns FROM events)) WHERE gap IS NULL OR gap > 1000000000 GROUP BY ALL",
        "fragment_outcomes": _FRAGMENTS,
        "old_decoder": f"""WITH {_UPDATES} SELECT event_id AS seq, message_type, mmsi, nav_status, round(sog, 6) AS sog, round(cog, 6) AS cog, heading, round(round(lat * 600000) / 600000e0, 6) AS lat, round(round(lon * 600000) / 600000e0, 6) AS lon,
  CAST(NULL AS INT) AS imo, CAST(NULL AS VARCHAR) AS call_sign, CAST(NULL AS VARCHAR) AS vessel_name, CAST(NULL AS INT) AS ship_type, CAST(NULL AS INT) AS ship_length_m, CAST(NULL AS VARCHAR) AS destination FROM ({_REPORTS})
UNION ALL SELECT seq, 5, mmsi, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN seq % 7 <= 5 THEN CAST(seq % 7 AS INT) END, CASE WHEN seq % 7 <= 4 THEN 'C' || chr(CAST(65 + seq % 26 AS INT)) END, CASE WHEN seq % 7 <= 3 THEN CASE WHEN vessel_name IS NULL THEN 'NO NAME4' || chr(CAST(65 + seq % 26 AS INT)) ELSE 'V' END END,
  CASE WHEN seq % 7 <= 2 THEN CAST(seq % 100 AS INT) END, CASE WHEN seq % 7 <= 1 THEN CAST(seq % 400 AS INT) END, CASE WHEN seq % 7 = 0 THEN 'PORT4' || chr(CAST(65 + seq % 26 AS INT)) END FROM updates""",
        "log_ingest": f"SELECT mmsi, count(*) AS n FROM ({_REPORTS}) WHERE event_id % 50 <> 0 GROUP BY ALL",
        "log_diagnostics": "SELECT CASE WHEN event_id % 50 = 0 THEN 'INVALID_LOG_LINE' ELSE 'CHECKSUM_MALFORMED' END AS code, count(*) AS n FROM events GROUP BY ALL",
        "log_replay_days": f"SELECT CAST(day AS DATE) AS day, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, CAST(sum(ordinal * (event_id % 1009)) AS BIGINT) AS order_digest FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts_ns, file, event_id) AS ordinal FROM (SELECT event_id, event_id % 3 AS file, ts_ns // 1000000 * 1000000 AS ts_ns, DATE '1970-01-01' + CAST((ts_ns + {cube.JST_NS}) // {cube.DAY_NS} AS INT) AS day FROM ({_REPORTS}))) GROUP BY ALL",
        "static_roundtrip": f"""WITH {_UPDATES}, st AS (SELECT *, CAST(floor(seq / 3e0) AS BIGINT) AS k, coalesce(vessel_name, 'NO NAME ' || seq % 100) AS name FROM updates)
SELECT seq, CASE WHEN seq % 3 = 0 THEN 5 ELSE 24 END AS message_type, mmsi, CASE WHEN seq % 3 = 0 THEN 'A' ELSE 'B' END AS vessel_class, CASE WHEN seq % 3 = 0 THEN nullif(CAST(seq % 100000 AS INT), 0) END AS imo, CASE WHEN seq % 3 <> 1 THEN 'C' || seq % 1000 END AS call_sign,
  CASE WHEN seq % 3 <> 2 THEN name END AS vessel_name, CASE WHEN seq % 3 <> 1 THEN CAST(seq % 100 AS INT) END AS ship_type, CASE WHEN seq % 3 <> 1 THEN CAST(nullif(seq % 400, 0) AS INT) END AS ship_length_m, CASE WHEN seq % 3 = 0 THEN 'PORT-' || seq % 50 END AS destination FROM st""",
        "metadata_versions": f"WITH {_HISTORY} SELECT * FROM versions",
        "metadata_as_of": f"WITH reports AS ({_REPORTS}), {_HISTORY} SELECT r.event_id, r.mmsi, v.ship_length_m, v.vessel_name FROM reports r LEFT JOIN versions v ON v.mmsi = r.mmsi AND v.valid_from <= r.ts_ns AND (v.valid_to IS NULL OR r.ts_ns < v.valid_to)",
        "ship_length_reach": f"""{base}, {_DAYS}, {_LENGTHS}, far AS (SELECT length_band, day, vessel_class, mmsi, max(band) AS band, max(band) * 5e0 AS km FROM sized GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY length_band ORDER BY band, day, vessel_class, mmsi) AS k, count(*) OVER (PARTITION BY length_band) AS n FROM far)
SELECT length_band, count(DISTINCT mmsi) AS vessels, count(*) AS vessel_days, round(avg(km), 6) AS mean_km, count(*) FILTER (km >= 30) AS beyond_30, count(*) FILTER (km >= 50) AS beyond_50, min(band) FILTER (k >= (n + 1) / 2e0) AS median_band, round(count(*) FILTER (km >= 30) * 100e0 / count(*), 6) AS pct_30, round(count(*) FILTER (km >= 50) * 100e0 / count(*), 6) AS pct_50, count(*) >= 30 AND count(DISTINCT mmsi) >= 3 AS sufficient FROM ranked GROUP BY length_band""",
        "ship_length_performance": f"{base}, {_DAYS}, {_LENGTHS} SELECT length_band, band, vessel_class, {_SHOWN}, vessels, days, round({rates.percent('missing', 'observed + missing')} + {_OFF_TIES}, 4) AS loss_pct, round({rates.percent('stale_s', 'observed_s')} + {_OFF_TIES}, 4) AS stale_pct FROM (SELECT length_band, band, vessel_class, count(*) AS observed, CAST(sum(missing) AS BIGINT) AS missing, sum(actual_s) AS observed_s, sum(stale_s) AS stale_s, count(DISTINCT mmsi) AS vessels, count(DISTINCT day) AS days FROM sized GROUP BY ALL)",
        "ship_length_coverage": f"{base}, {_DAYS}, {_LENGTHS} SELECT count(DISTINCT day) AS days, count(DISTINCT mmsi) AS vessels, count(DISTINCT mmsi) FILTER (length_band < 6) AS known_vessels, count(*) AS vessel_days, count(*) FILTER (length_band < 6) AS known_vessel_days FROM (SELECT DISTINCT day, vessel_class, mmsi, length_band FROM sized)",
        "daily_quality": f"""{base}, by_day AS (SELECT *, DATE '1970-01-01' + CAST((ts_ns + {cube.JST_NS}) // {cube.DAY_NS} AS INT) AS day FROM analyzed), spine AS (SELECT CAST(unnest(generate_series(DATE '2023-12-31', DATE '2024-01-09', INTERVAL 1 DAY)) AS DATE) AS day),
sums AS (SELECT day, count(DISTINCT ts_ns // {_B}) AS buckets, min(ts_ns - ts_ns % {_B}) AS first_bucket, max(ts_ns - ts_ns % {_B}) AS last_bucket, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS excluded, count(DISTINCT mmsi) AS vessels FROM by_day GROUP BY ALL)
SELECT s.day, buckets, first_bucket, last_bucket, coalesce(accepted, 0) AS accepted, CAST(0 AS BIGINT) AS failures, coalesce(excluded, 0) AS excluded, coalesce(vessels, 0) AS vessels, CASE WHEN buckets IS NULL THEN 'NOT_ANALYZED' WHEN accepted = 0 OR buckets <= 275 OR buckets > 288 THEN 'REVIEW_REQUIRED' WHEN buckets = 288 THEN 'ALL_BUCKETS_PRESENT' ELSE 'PARTIAL' END AS state FROM spine s LEFT JOIN sums USING (day)""",
        "pooled_jeffreys": f"{cal} SELECT band, vessel_class, observed, missing, vessels, days, expected, round(missing / expected, 6) AS raw_loss, round(observed / expected, 6) AS raw_reception, round((observed + 0.5e0) / (expected + 1e0), 6) AS p FROM pooled",
        "model_parameters": f"{cal}, {_PARAMETERS} SELECT band, vessel_class, kind, round(p, 6) AS p, from_band, to_band FROM model",
        "ideal_transmissions": f"{both}, {_FLAT}, {_LOST}, planned AS (SELECT mmsi, vessel_class, ts_ns AS planned_ns, 0 AS origin, seq FROM analyzed UNION ALL SELECT mmsi, vessel_class, at_ns, 1, seq FROM lost), ordered AS (SELECT *, row_number() OVER (PARTITION BY mmsi, vessel_class, planned_ns ORDER BY origin, seq) - 1 AS ordinal FROM planned) SELECT mmsi, vessel_class, origin, count(*) AS n, max(ordinal) AS last_ordinal, CAST(sum(planned_ns % 1000003) AS BIGINT) AS time_digest FROM ordered GROUP BY ALL",
        "deterministic_uniform": f"SELECT event_id, round(CAST(CAST('0x' || substr(sha256(unhex(printf('%016x%016x%016x%016x%08x%08x%016x%08x%016x', 7, 1, 2, ts_ns // 86400000000000, mmsi, CASE WHEN vessel_class = 'B' THEN 1 ELSE 0 END, ts_ns // 1000000000, ts_ns % 1000000000, 0))), 1, 14) AS UBIGINT) >> 3 AS DOUBLE) * {2.0**-53!r}, 12) AS u FROM ({_REPORTS})",
        "legacy_bins": f"{base}, {_LEGACY} SELECT mmsi, category, bin, observed, loss, round(avg_km, 6) AS avg_km, observed + loss AS expected, round(loss * 100e0 / (observed + loss), 6) AS loss_pct FROM (SELECT mmsi, category, CAST(floor(s_km / 10) AS INT) AS bin, count(*) AS observed, CAST(sum(loss) AS BIGINT) AS loss, avg(s_km) AS avg_km FROM legacy GROUP BY ALL)",
        "legacy_vessels": f"{base}, {_LEGACY}, {_TOTALS} SELECT {_round('mmsi category total loss max_s', 'avg_s max_lossy_km loss_pct')} FROM totals",
        "legacy_summary": f"{base}, {_LEGACY}, {_TOTALS} SELECT category, count(*) AS vessels, round(avg(loss_pct), 6) AS mean_pct, round(quantile_cont(loss_pct, 0.5), 6) AS median_pct, round(max(loss_pct), 6) AS max_pct, round(max(max_lossy_km), 6) AS max_km FROM totals GROUP BY ALL",
        "legacy_diagnostics": f"{base}, {_LEGACY} SELECT category, count(*) AS n, count(*) FILTER (gap_s = 0) AS zero, count(*) FILTER (gap_s < 0.5) AS below_half, CAST(sum(loss) AS BIGINT) AS loss, round(quantile_cont(gap_s, 0.5), 6) AS p50, round(quantile_cont(gap_s, 0.75), 6) AS p75, round(quantile_cont(gap_s, 0.9), 6) AS p90 FROM legacy GROUP BY ALL",
        "gap_histogram": f"{base}, {_LEGACY} SELECT category, gap_bucket, count(*) AS n, round(quantile_cont(gap_s, 0.5), 6) AS p50, round(quantile_cont(gap_s, 0.9), 6) AS p90 FROM (SELECT *, CASE WHEN gap_s <= 360 THEN 0 WHEN gap_s <= 539 THEN 1 WHEN gap_s <= 720 THEN 2 WHEN gap_s <= 1079 THEN 3 WHEN gap_s <= 1439 THEN 4 WHEN gap_s <= 1799 THEN 5 WHEN gap_s <= 2159 THEN 6 WHEN gap_s <= 3599 THEN 7 ELSE 8 END AS gap_bucket FROM legacy) GROUP BY ALL",
        "type5_asof_distance": f"WITH reports AS ({_REPORTS}), {_UPDATES}, static AS (SELECT seq, mmsi, CAST((ts_ns - 1704067200000000000) // 5 AS BIGINT) + 1704067200000000000 AS ts_ns FROM updates), dynamic AS (SELECT mmsi, ts_ns, seq, {geo.receiver_km('lat', 'lon')} AS km FROM reports) SELECT s.seq, s.mmsi, round(d.km, 6) AS km FROM static s ASOF LEFT JOIN dynamic d ON s.mmsi = d.mmsi AND d.ts_ns <= s.ts_ns",
        "rolling_7_30": f"{base}, {_LEGACY}, {_DAILY} SELECT day, category, round(loss_pct, 6) AS loss_pct, round(CASE WHEN count(loss_pct) OVER s >= 4 THEN avg(loss_pct) OVER s END, 6) AS rolling_7, round(CASE WHEN count(loss_pct) OVER l >= 15 THEN avg(loss_pct) OVER l END, 6) AS rolling_30 FROM daily_rates WINDOW s AS (PARTITION BY category ORDER BY day ROWS 6 PRECEDING), l AS (PARTITION BY category ORDER BY day ROWS 29 PRECEDING)",
        "monthly_of_daily": f"{base}, {_LEGACY}, {_DAILY} SELECT strftime(day, '%Y-%m') AS month, category, round(avg(vessels), 6) AS mean_vessels, round(quantile_cont(loss_pct, 0.25), 6) AS q1, round(quantile_cont(loss_pct, 0.5), 6) AS median, round(quantile_cont(loss_pct, 0.75), 6) AS q3 FROM daily_rates GROUP BY ALL",
        "spearman_trend": f"{base}, {_LEGACY}, {_DAILY}, ranks AS (SELECT *, date_diff('day', DATE '2000-01-01', day) AS x, rank() OVER (PARTITION BY category ORDER BY observed + loss) + (count(*) OVER (PARTITION BY category, observed + loss) - 1) / 2e0 AS re, rank() OVER (PARTITION BY category ORDER BY loss_pct) + (count(*) OVER (PARTITION BY category, loss_pct) - 1) / 2e0 AS rr FROM daily_rates WHERE loss_pct IS NOT NULL) SELECT category, round(regr_slope(loss_pct, x) * 30, 6) AS slope_30d, round(corr(re, rr), 6) AS spearman, round(avg(loss_pct), 6) AS mean_pct, round(stddev_samp(loss_pct), 6) AS sd_pct FROM ranks GROUP BY ALL",
        "year_comparison": f"""{base}, {_LEGACY}, shifted AS (SELECT category, CAST(floor(s_km / 10) AS INT) AS bin, mmsi, CAST(start_day + CAST(mmsi % 3 * 366 AS INT) AS DATE) AS day, loss FROM legacy), spine AS (SELECT DISTINCT CAST(year(day) AS INT) AS year, category, bin0 AS bin FROM shifted CROSS JOIN (SELECT CAST(unnest(generate_series(0, 7)) AS INT) AS bin0)),
sums AS (SELECT CAST(year(day) AS INT) AS year, category, bin, count(*) AS observed, CAST(sum(loss) AS BIGINT) AS loss, count(DISTINCT mmsi) AS vessels, count(DISTINCT (mmsi, day)) AS vessel_days FROM shifted GROUP BY ALL)
SELECT year, category, bin, coalesce(observed, 0) AS observed, coalesce(loss, 0) AS loss, coalesce(vessels, 0) AS vessels, coalesce(vessel_days, 0) AS vessel_days, round(CASE WHEN observed + loss > 0 THEN loss * 100e0 / (observed + loss) END, 6) AS loss_pct, round(CASE WHEN vessel_days > 0 THEN loss / CAST(vessel_days AS DOUBLE) END, 6) AS loss_per_vessel_day, coalesce(vessels, 0) < 3 AS small_sample FROM spine LEFT JOIN sums USING (year, category, bin)""",
    }
    for name, period in _PERIODS.items():
        sql[f"rollup_{name}"] = f"{base}, {_BAND_ROWS} SELECT period, band, vessel_class, {_SHOWN}, vessels, days, {_RATES} FROM {_rolled(period)}"
        if name != "year":
            kept = f"(SELECT {period} AS period, band, vessel_class, {_SUMS}, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(DISTINCT mmsi) AS vessels, count(DISTINCT day) AS days FROM parts WHERE day <> DATE '2024-01-03' AND day BETWEEN DATE '2023-12-31' AND DATE '2024-12-31' GROUP BY ALL)"
            sql[f"stored_rollup_{name}"] = f"{base}, {_BAND_ROWS} SELECT period, band, vessel_class, {_SHOWN}, first_bucket, last_bucket, vessels, days, {_RATES} FROM {kept}"
    shifted = "shifted AS MATERIALIZED (SELECT category, CAST(floor(s_km / 10) AS INT) AS bin, mmsi, CAST(start_day + CAST(mmsi % 3 * 366 AS INT) AS DATE) AS day, loss FROM legacy)"
    counted = "count(*) AS observed, CAST(sum(loss) AS BIGINT) AS loss, count(DISTINCT mmsi) AS vessels, count(DISTINCT day) AS days"
    pct = "round(loss * 100e0 / (observed + loss), 6)"
    sql |= {
        "research_bins": f"{base}, {_LEGACY}, {shifted} SELECT *, {pct} AS loss_pct FROM (SELECT strftime(day, '%Y') AS period, category, bin, {counted} FROM shifted GROUP BY ALL)",
        "overall_by_year": f"{base}, {_LEGACY}, {shifted} SELECT *, {pct} AS loss_pct, round(loss / (vessels * days), 6) AS loss_per_vessel_day FROM (SELECT CAST(year(day) AS INT) AS year, {counted} FROM shifted GROUP BY ALL)",
        "bin_metrics_by_weekday": f"""{base}, {_LEGACY}, {shifted}, asked AS (SELECT * FROM (VALUES ('ALL', 0), ('TUESDAY', 2), ('SUNDAY', 7)) AS t(weekday, no)), spine AS (SELECT weekday, CAST(unnest(generate_series(0, 7)) AS INT) AS bin FROM asked),
sums AS (SELECT weekday, bin, {counted} FROM asked JOIN shifted ON no = 0 OR isodow(day) = no GROUP BY ALL)
SELECT weekday, bin, coalesce(observed, 0) AS observed, coalesce(loss, 0) AS loss, coalesce(vessels, 0) AS vessels, coalesce(days, 0) AS days, coalesce(vessels, 0) < 3 AS small_sample, CASE WHEN vessels >= 3 THEN {pct} END AS loss_pct, CASE WHEN vessels >= 3 THEN round(loss / (vessels * days), 6) END AS loss_per_vessel_day FROM spine LEFT JOIN sums USING (weekday, bin)""",
    }
    from tidewatch.plans.queries import SNAPSHOT_NS

    used = "day NOT IN (DATE '2024-01-03', DATE '2024-01-04') AND day BETWEEN DATE '2023-12-31' AND DATE '2024-01-12'"
    same_day = f"{_DAY_NO % 'r.ts_ns'} = {_DAY_NO % 't.at_ns'}"
    listed = lambda c: ", ".join(f"{f} AS {c}_{n}" for n, f in (("days", f"CAST(count({c}) AS INT)"), ("least", f"round(min({c}) + {_OFF_TIES}, 4)"), ("most", f"round(max({c}) + {_OFF_TIES}, 4)"), ("first", f"round(arg_min({c}, day) + {_OFF_TIES}, 4)")))
    sql |= {
        "snapshot": f"{base}, {_snapshots(SNAPSHOT_NS)}",
        "replay_seek": f"{_DAYS_APART}, {_snapshots(SNAPSHOT_NS, 'r.mmsi // 100000', same_day)}",
        "stored_calibration": f"{base}, {_BAND_ROWS} SELECT day, band, vessel_class, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(missing) AS BIGINT) AS missing, CAST(count(DISTINCT mmsi) AS INT) AS vessels, CAST(sum(DISTINCT mmsi) AS BIGINT) AS mmsi_sum FROM parts WHERE {used} GROUP BY ALL",
        "stored_validation": f"""{base}, {_BAND_ROWS}, daily AS (SELECT *, {rates.percent('missing', 'observed + missing')} AS loss_pct, {rates.percent('stale_s', 'observed_s')} AS stale_pct FROM (SELECT day, band, vessel_class, {_SUMS} FROM parts WHERE {used} GROUP BY ALL)),
seen AS (SELECT band, vessel_class, count(DISTINCT mmsi) AS vessels FROM parts WHERE {used} GROUP BY ALL)
SELECT band, vessel_class, {_SHOWN}, days, vessels, COLUMNS('_pct_') FROM (SELECT band, vessel_class, {_SUMS}, count(*) AS days, {listed('loss_pct')}, {listed('stale_pct')} FROM daily GROUP BY ALL) JOIN seen USING (band, vessel_class)""",
        "gap_totals": f"""{base}, {_GAPS} SELECT category, count(*) AS messages, count(*) FILTER (kind <> 'FIRST') AS intervals, count(*) FILTER (kind = 'NEGATIVE') AS negative, count(*) FILTER (gap_s = 0) AS zero, count(*) FILTER (gap_s >= 0 AND gap_s < 0.5) AS below_half, count(*) FILTER (kind = 'TRACK_GAP') AS track_gaps,
  CAST(0 AS BIGINT) AS no_expected, count(*) FILTER (kind = 'VALID') AS valid, CAST(coalesce(sum(loss) FILTER (kind = 'VALID'), 0) AS BIGINT) AS loss, CAST(coalesce(sum(whole_loss) FILTER (kind = 'VALID'), 0) AS BIGINT) AS integer_loss, CAST(0 AS BIGINT) AS ceil_loss, count(*) FILTER (kind = 'VALID' AND loss <> whole_loss) AS changed FROM gaps GROUP BY ALL""",
        "gap_expected": f"{base}, {_GAPS} SELECT category, round(own_s, 6) AS expected_s, count(*) AS n FROM gaps WHERE kind = 'VALID' GROUP BY ALL",
        "gap_class_b": f"""{base}, {_GAPS} SELECT CASE WHEN unit = 'CARRIER_SENSE' THEN 'CS' ELSE 'SO' END AS unit, CASE WHEN sog IS NULL OR sog <= 2 THEN '0-2' WHEN sog <= 14 THEN '2-14' ELSE '>14' END AS speed, count(*) AS n, CAST(sum(loss) AS BIGINT) AS loss,
  {', '.join(f"CAST(quantile_disc(CAST(floor(gap_s + 0.5) AS BIGINT), {f}) FILTER (floor(gap_s + 0.5) < 1800) AS BIGINT) AS p{round(f * 100)}" for f in (0.5, 0.75, 0.9))} FROM gaps WHERE kind = 'VALID' AND category = 18 GROUP BY ALL""",
    }
    run_days = f"{base}, {_BAND_ROWS}, run_days AS (SELECT DISTINCT day FROM parts)"
    sql |= {
        "stored_days": f"{run_days} SELECT s.day, CASE WHEN r.day IS NULL THEN 0 ELSE 1 END AS runs, CASE WHEN s.day = DATE '2024-01-03' THEN 'EXCLUDED' WHEN r.day IS NULL THEN 'MISSING' ELSE 'INCLUDED' END AS state FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-01-12', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN run_days r ON r.day = s.day",
        "runs_overlapping": f"{run_days} SELECT * FROM (SELECT 'r' || turn || '-' || strftime(day, '%Y-%m-%d') AS run_id, day, epoch_us(day) + turn AS started_us, CASE WHEN day(day) % 2 = 0 THEN epoch_us(day) + 3600000000 END AS ended_us FROM run_days CROSS JOIN (SELECT unnest([1, 2]) AS turn)) WHERE coalesce(ended_us, started_us) >= 1704153600000000 + 1800000000 AND started_us < 1704153600000000 + 86400000002",
        "current_aggregate": f"{base}, {_BAND_ROWS} SELECT vessel_class, band, {_SHOWN} FROM (SELECT vessel_class, band, {_SUMS} FROM parts GROUP BY ALL)",
        "first_known_length": f"WITH {_UPDATES} SELECT mmsi, ship_length_m FROM updates WHERE ship_length_m > 0 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts_ns, seq) = 1",
        "weekday_means": f"{base}, {_LEGACY}, {_DAILY} SELECT CAST(isodow(day) AS INT) AS weekday, category, count(*) AS days, round(avg(observed), 6) AS mean_observed, round(avg(observed + loss), 6) AS mean_expected FROM daily_rates GROUP BY ALL",
        "matched_years": f"{base}, {_LEGACY}, {_DAILY} SELECT strftime(day, '%Y') AS period, category, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(loss) AS BIGINT) AS loss, count(DISTINCT mmsi) AS vessels, count(DISTINCT day) AS days, round(sum(loss) * 100e0 / sum(observed + loss), 6) AS loss_pct FROM daily WHERE month(day) < 7 OR (month(day) = 7 AND day(day) <= 3) GROUP BY ALL",
        "position_density": f"SELECT gx, gy, count(*) AS n FROM (SELECT CAST(floor((lon - {geo.RECEIVER_LON!r} + hx) / (2 * hx / 40)) AS INT) AS gx, CAST(floor((lat - {geo.RECEIVER_LAT!r} + hy) / (2 * hy / 40)) AS INT) AS gy FROM (SELECT lat, lon, 80e0 / 111.32e0 AS hy, 80e0 / (111.32e0 * cos(radians({geo.RECEIVER_LAT!r}))) AS hx FROM ({_REPORTS}))) WHERE gx BETWEEN 0 AND 39 AND gy BETWEEN 0 AND 39 GROUP BY ALL",
    }
    for name, period in _RESEARCH.items():
        sql[f"research_{name}"] = f"{base}, {_LEGACY}, {_DAILY} SELECT {period} AS period, category, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(loss) AS BIGINT) AS loss, count(DISTINCT mmsi) AS vessels, count(DISTINCT day) AS days, round(sum(loss) * 100e0 / sum(observed + loss), 6) AS loss_pct FROM daily GROUP BY ALL"
    return sql
