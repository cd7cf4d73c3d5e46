"""Facts read from scene file names, and ids built from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]+$", 1)


def sensor_of(name: Column) -> Column:
    up = F.upper(name)
    out = None
    for sensor, pattern in vocab.SENSOR_PATTERNS:
        out = F.when(up.rlike(pattern), F.lit(sensor)) if out is None else out.when(up.rlike(pattern), F.lit(sensor))
    return out


def date_of(name: Column) -> Column:
    """First valid YYYYMMDD, else YYYY-MM-DD, else YYYY_MM_DD (the last two are not calendar-checked)."""
    mm, dd = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
    packed = F.regexp_extract(name, r"(\d{4})" + mm + dd, 0)
    valid = F.date_format(F.try_to_date(packed, "yyyyMMdd"), "yyyy-MM-dd")
    dashed = F.nullif(F.regexp_extract(name, r"(\d{4})-" + mm + "-" + dd, 0), F.lit(""))
    scored = F.nullif(F.regexp_extract(name, r"(\d{4})_" + mm + "_" + dd, 0), F.lit(""))
    return F.coalesce(F.when(packed != "", valid), dashed, F.replace(scored, F.lit("_"), F.lit("-")))


def scene_id(path: Column, sensor: Column, date: Column) -> Column:
    """{SENS}_{YYYYMMDD}_{stem}; empty or missing parts are left out."""
    sensor_part = F.upper(F.substring(F.regexp_replace(F.nullif(sensor, F.lit("")), "[- ]", ""), 1, 4))
    date_part = F.replace(F.nullif(date, F.lit("")), F.lit("-"), F.lit(""))
    safe = F.regexp_replace(stem(path), "[^a-zA-Z0-9_-]", "_")
    return F.concat_ws("_", sensor_part, date_part, safe)


def tile_id(scene: Column, x: Column, y: Column) -> Column:
    return F.format_string("%s_x%02d_y%02d", scene, x.cast("int"), y.cast("int"))


def override(given: Column, extracted: Column) -> Column:
    """An empty override is no override."""
    return F.coalesce(F.nullif(given, F.lit("")), extracted)
