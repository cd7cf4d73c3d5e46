"""UTM coordinates to longitude and latitude (WGS84), as one SQL expression.

The inverse transverse Mercator series of Krueger to the fourth order of the third flattening: its error is far below a
millimetre inside a zone.  The text is plain SQL, so that any engine can compute the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_n = FLATTENING / (2 - FLATTENING)
RADIUS = SCALE * AXIS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280)
DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630)


def _d(x: float) -> str:
    """A literal that is a double in any dialect."""
    return f"{x:.17e}"


def utm_sql(east: str, north: str, zone: str, south: str) -> tuple[str, str]:
    """(longitude, latitude) in degrees of metres in a zone; `south` is a boolean expression."""
    xi = f"(({north} - CASE WHEN {south} THEN {_d(1e7)} ELSE {_d(0)} END) / {_d(RADIUS)})"
    eta = f"(({east} - {_d(5e5)}) / {_d(RADIUS)})"
    terms = lambda f, g: "".join(f" - {_d(b)} * {f}({_d(2 * j)} * {xi}) * {g}({_d(2 * j)} * {eta})" for j, b in enumerate(BETA, 1))
    xi1, eta1 = f"({xi}{terms('sin', 'cosh')})", f"({eta}{terms('cos', 'sinh')})"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = chi + "".join(f" + {_d(c)} * sin({_d(2 * j)} * {chi})" for j, c in enumerate(DELTA, 1))
    lon = f"{_d(6)} * {zone} - {_d(183)} + degrees(atan(sinh({eta1}) / cos({xi1})))"
    return lon, f"degrees({lat})"


def utm_zone(crs: Column) -> Column:
    """Zone 1 to 60 of a WGS84 UTM code (EPSG:326zz north, EPSG:327zz south); null for other systems."""
    zone = F.regexp_extract(F.upper(crs), r"^EPSG:32[67](\d\d)$", 1).try_cast("int")
    return F.when(zone.between(1, 60), zone)


def crs_status(crs: Column) -> Column:
    """`degrees` (EPSG:4326, or no system given), `utm`, or `unsupported`."""
    return F.when(crs.isNull() | (F.upper(crs) == "EPSG:4326"), "degrees").when(utm_zone(crs).isNotNull(), "utm").otherwise("unsupported")


def to_degrees(crs: str, east: str, north: str) -> tuple[Column, Column]:
    """Longitude and latitude columns of a point of columns, by the system named in column `crs`; null if unsupported."""
    zone = utm_zone(F.col(crs))
    south = f"upper({crs}) LIKE 'EPSG:327%'"
    lon, lat = utm_sql(east, north, f"CAST(substring({crs}, 9, 2) AS DOUBLE)", south)
    kind = crs_status(F.col(crs))
    pick = lambda plain, sql: F.when(kind == "degrees", F.col(plain)).when(zone.isNotNull(), F.expr(sql))
    return pick(east, lon), pick(north, lat)


def with_degrees(df: DataFrame, crs: str, points: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """`df` with longitude and latitude columns {(lon, lat): (east, north)} of several points of a row, as by `to_degrees`.

    The series goes by stages: a value that the next stage reads several times is a column, so it is computed once and every
    generated method stays small.
    """
    if "_zone" not in df.columns:
        df = with_zone(df, crs)
    names = list(enumerate(points.items()))
    in_zone = lambda sql: F.when(F.col("_zone").isNotNull(), F.expr(sql))
    stage: dict[str, Column] = {}
    for i, (_, (east, north)) in names:
        stage[f"_xi{i}"] = in_zone(f"(({north} - CASE WHEN _south THEN {_d(1e7)} ELSE {_d(0)} END) / {_d(RADIUS)})")
        stage[f"_eta{i}"] = in_zone(f"(({east} - {_d(5e5)}) / {_d(RADIUS)})")
    df = df.withColumns(stage)
    terms = lambda f, g, i: "".join(f" - {_d(b)} * {f}({_d(2 * j)} * _xi{i}) * {g}({_d(2 * j)} * _eta{i})" for j, b in enumerate(BETA, 1))
    df = df.withColumns({f"_u{i}": in_zone(f"(_xi{i}{terms('sin', 'cosh', i)})") for i, _ in names} | {
        f"_v{i}": in_zone(f"(_eta{i}{terms('cos', 'sinh', i)})") for i, _ in names})
    df = df.withColumns({f"_chi{i}": in_zone(f"asin(sin(_u{i}) / cosh(_v{i}))") for i, _ in names})
    last: dict[str, Column] = {}
    for i, ((lon, lat), (east, north)) in names:
        series = f"_chi{i}" + "".join(f" + {_d(c)} * sin({_d(2 * j)} * _chi{i})" for j, c in enumerate(DELTA, 1))
        last[lon] = F.when(F.col("_plain"), F.col(east)).otherwise(in_zone(f"{_d(6)} * CAST(_zone AS DOUBLE) - {_d(183)} + degrees(atan(sinh(_v{i}) / cos(_u{i})))"))
        last[lat] = F.when(F.col("_plain"), F.col(north)).otherwise(in_zone(f"degrees({series})"))
    df = df.withColumns(last)
    return df.drop("_zone", "_south", "_plain", *[f"{c}{i}" for i, _ in names for c in ("_xi", "_eta", "_u", "_v", "_chi")])


def with_zone(df: DataFrame, crs: str) -> DataFrame:
    """The columns of a row's system that `with_degrees` reads; add them before rows are multiplied."""
    return df.withColumns({
        "_zone": utm_zone(F.col(crs)), "_south": F.upper(crs).startswith("EPSG:327"), "_plain": crs_status(F.col(crs)) == "degrees"})
