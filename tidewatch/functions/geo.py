"""Spherical distance, UTM zone 53N, grid cells and distance bands."""

from __future__ import annotations

from tidewatch.functions.steps import Steps

EARTH_KM = 6371.0
RECEIVER_LAT, RECEIVER_LON = 34.718983358515715, 135.29057866131427
GRID_M, BAND_KM, BANDS = 2000.0, 5.0, 14

_A, _F, _K0, _LON0, _FE = 6378137.0, 1 / 298.257223563, 0.9996, 135.0, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ROOT = 2 * _N**0.5 / (1 + _N)
#: Krueger series of the transverse Mercator projection to fourth order in the third flattening, fixed values.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def num(x: float) -> str:
    """A double literal that both Spark and ANSI SQL read as a double."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    return f"({2 * EARTH_KM}e0 * atan2(sqrt({a}), sqrt(greatest(0e0, 1e0 - {a}))))"


def receiver_km(lat: str, lon: str) -> str:
    return haversine_km(lat, lon, num(RECEIVER_LAT), num(RECEIVER_LON))


def _series(coefficients: tuple[float, ...], outer: str, inner: str, x: str, y: str, sign: str) -> str:
    return "".join(f" {sign} {num(c)} * {outer}({2 * k} * {x}) * {inner}({2 * k} * {y})" for k, c in enumerate(coefficients, 1))


def to_utm(lat: str, lon: str, e: str, n: str) -> Steps:
    """Steps that add easting and northing in metres."""
    p = f"{e}_"
    return [
        (f"{p}t", f"sinh(atanh(sin(radians({lat}))) - {num(_ROOT)} * atanh({num(_ROOT)} * sin(radians({lat}))))"),
        (f"{p}x", f"atan2({p}t, cos(radians(({lon}) - {num(_LON0)})))"),
        (f"{p}y", f"atanh(sin(radians(({lon}) - {num(_LON0)})) / sqrt(1e0 + {p}t * {p}t))"),
        (e, f"{num(_FE)} + {num(_K0 * _RADIUS)} * ({p}y{_series(_ALPHA, 'cos', 'sinh', f'{p}x', f'{p}y', '+')})"),
        (n, f"{num(_K0 * _RADIUS)} * ({p}x{_series(_ALPHA, 'sin', 'cosh', f'{p}x', f'{p}y', '+')})"),
    ]


def from_utm(e: str, n: str, lat: str, lon: str) -> Steps:
    """Steps that add latitude and longitude in degrees."""
    p = f"{lat}_"
    chi = "".join(f" + {num(d)} * sin({2 * k} * {p}c)" for k, d in enumerate(_DELTA, 1))
    return [
        (f"{p}x", f"({n}) / {num(_K0 * _RADIUS)}"),
        (f"{p}y", f"(({e}) - {num(_FE)}) / {num(_K0 * _RADIUS)}"),
        (f"{p}u", f"{p}x{_series(_BETA, 'sin', 'cosh', f'{p}x', f'{p}y', '-')}"),
        (f"{p}v", f"{p}y{_series(_BETA, 'cos', 'sinh', f'{p}x', f'{p}y', '-')}"),
        (f"{p}c", f"asin(sin({p}u) / cosh({p}v))"),
        (lat, f"degrees({p}c{chi})"),
        (lon, f"{num(_LON0)} + degrees(atan2(sinh({p}v), cos({p}u)))"),
    ]


def utm_scratch(e: str) -> tuple[str, ...]:
    return tuple(f"{e}_{c}" for c in "txy")


def geo_scratch(lat: str) -> tuple[str, ...]:
    return tuple(f"{lat}_{c}" for c in "xyuvc")


def cell(metres: str, origin: float = 0.0, size: float = GRID_M) -> str:
    return f"CAST(floor((({metres}) - {num(origin)}) / {num(size)}) AS BIGINT)"


def band(km: str, width: float = BAND_KM, bands: int = BANDS) -> str:
    """Half-open bands; the outer edge, within 1e-9, belongs to the last one; null beyond."""
    edge = width * bands
    return f"CASE WHEN ({km}) < {num(edge)} THEN CAST(floor(({km}) / {num(width)}) AS INT) WHEN ({km}) <= {num(edge)} + 1e-9 THEN {bands - 1} END"


def destination(lat: str, lon: str, km: str, bearing: str) -> tuple[str, str]:
    """Latitude and longitude of the point ``km`` away along a great circle."""
    d, b = f"(({km}) / {num(EARTH_KM)})", f"radians({bearing})"
    y = f"asin(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos({b}))"
    x = f"(({lon}) + degrees(atan2(sin({b}) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * sin({y}))))"
    return f"degrees({y})", f"({x} + 540e0) % 360e0 - 180e0"


def mercator(lat: str, lon: str) -> tuple[str, str]:
    """Ellipsoidal Mercator metres (x, y)."""
    ecc = (_F * (2 - _F)) ** 0.5
    s = f"sin(radians({lat}))"
    return f"{num(_A)} * radians({lon})", f"{num(_A)} * (atanh({s}) - {num(ecc)} * atanh({num(ecc)} * {s}))"
