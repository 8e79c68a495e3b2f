"""Number, coordinate and date parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.binding import let
from hazardgrid.functions.text import strip

_INTEGER = r"^[+-]?\d+(_\d+)*$"
_DECIMAL = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
_NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


def parse_float(col) -> Column:
    """Text to DOUBLE; NULL when not a number, NaN for the not-finite words."""
    return let(strip(col), lambda text: (
        F.when(text.rlike(_DECIMAL), F.regexp_replace(text, "_", "").try_cast("double"))
        .when(text.rlike(_NOT_FINITE), F.lit(float("nan")))))


def finite(col) -> Column:
    """``col`` when it is a finite number, else NULL."""
    return let(col, lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))


def optional_nonneg_int(col) -> tuple[Column, Column]:
    """``(value, bad)`` of an optional count: blank is NULL, negative or text is bad."""
    text = strip(F.coalesce(col, F.lit("")))
    value = F.when(text.rlike(_INTEGER), F.regexp_replace(text, "_", "").try_cast("int"))
    good = let(value, lambda v: F.when(v >= 0, v))
    return good, (text != "") & good.isNull()


def dashboard_count(col) -> tuple[Column, Column]:
    """``(value, bad)`` where only plain digits up to the INT maximum are accepted."""
    text = strip(F.coalesce(col, F.lit("")))
    value = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return value, (text != "") & value.isNull()


def optional_number(col, minimum: float, maximum: float | None = None,
                    integer: bool = False) -> tuple[Column, Column]:
    """``(value, bad)`` of an optional measure where -999 also means missing."""
    def judge(v):
        inside = ~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= minimum)
        if maximum is not None:
            inside = inside & (v <= maximum)
        if integer:
            inside = inside & (v == F.floor(v))
        missing = F.coalesce(v == -999, F.lit(False))
        good = F.coalesce(inside, F.lit(False)) & ~missing
        return F.struct(F.when(good, v).alias("value"), (~missing & ~good).alias("bad"))

    text = F.coalesce(col.cast("string"), F.lit(""))
    judged = let(parse_float(text), judge)
    value = judged["value"].cast("long") if integer else judged["value"]
    return value, (text != "") & judged["bad"]


def inside_bounds(lon, lat, bounds=V.STATE_BOUNDS) -> Column:
    west, south, east, north = bounds
    return lon.between(west, east) & lat.between(south, north)


def reported_point(lat, lon) -> Column:
    """``struct(lon, lat, issue)``; a positive longitude is taken as west."""
    def judge(p):
        x = F.when(p["x"] > 0, -p["x"]).otherwise(p["x"])
        return F.struct(x.alias("x"), p["y"].alias("y"), (
            F.when((p["lat"] == "") & (p["lon"] == ""), "reported_missing")
            .when((p["lat"] == "") | (p["lon"] == ""), "reported_incomplete")
            .when(p["x"].isNull() | p["y"].isNull(), "reported_non_numeric")
            # Not-a-number sorts above every bound, so it is out of bounds too.
            .when(~inside_bounds(x, p["y"]), "reported_out_of_bounds")).alias("issue"))

    texts = F.struct(strip(F.coalesce(lat, F.lit(""))).alias("lat"), strip(F.coalesce(lon, F.lit(""))).alias("lon"))
    parsed = let(texts, lambda t: F.struct(
        t["lat"].alias("lat"), t["lon"].alias("lon"), parse_float(t["lon"]).alias("x"), parse_float(t["lat"]).alias("y")))
    return let(let(parsed, judge), lambda j: F.struct(
        F.when(j["issue"].isNull(), j["x"]).alias("lon"), F.when(j["issue"].isNull(), j["y"]).alias("lat"),
        j["issue"].alias("issue")))


def bounded_point(lon_text, lat_text) -> Column:
    """``struct(lon, lat)`` of two numeric texts inside the state bounds, else NULL."""
    parsed = F.struct(parse_float(lon_text).alias("lon"), parse_float(lat_text).alias("lat"))
    return let(parsed, lambda p: F.when(inside_bounds(p["lon"], p["lat"]), p))


def json_point(col) -> Column:
    """Point of a ``{"lon":…, "lat":…}`` cell; numbers may be quoted."""
    return let(F.from_json(col, "lon string, lat string"), lambda o: bounded_point(o["lon"], o["lat"]))


def share_pct(part, whole) -> Column:
    """``100 * part / whole``, NULL for a zero or unknown denominator."""
    return F.lit(100.0) * F.try_divide(part.cast("double"), whole.cast("double"))


def us_date(col) -> Column:
    """``m/d/yyyy`` to DATE, NULL when it is not a calendar date."""
    return let(strip(F.coalesce(col, F.lit(""))), lambda text: F.when(
        text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")))


def iso_date(col) -> Column:
    """``yyyy-MM-dd`` or ``yyyyMMdd`` to DATE, else NULL."""
    return (
        F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col, "yyyy-MM-dd"))
        .when(col.rlike(r"^\d{8}$"), F.try_to_date(col, "yyyyMMdd"))
    )


def iso_timestamp(col) -> Column:
    """ISO date-time text to TIMESTAMP_NTZ (wall clock), else NULL."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?)?(Z|[+-]\d{2}:\d{2})?$"
    wall = F.regexp_replace(F.regexp_replace(col, r"(\d{2}:?\d*)(Z|[+-]\d{2}:\d{2})$", "$1"), "T", " ")
    wall = F.regexp_replace(wall, r"[.,]\d+$", "")
    wall = F.when(wall.rlike(r" \d{2}$"), F.concat(wall, F.lit(":00"))).otherwise(wall)
    return F.when(col.rlike(shape), wall.try_cast("timestamp_ntz"))
