"""Coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casewell.functions.text import let, round_half_up, strip

_NUMBER = r"(\d+(?:\.\d+)?)"
_DMS = rf"(-?)\s*{_NUMBER}(?:[^\d.]+{_NUMBER})?(?:[^\d.]+{_NUMBER})?"


def parse_coordinate(c: Column, axis: str) -> Column:
    """Decimal degrees from decimal or degree-minute-second text.

    Accepts a decimal comma and the N/S/E/W letters; null outside the axis' range.
    """
    limit, negative = (90, "S") if axis == "lat" else (180, "W")

    def degrees(s: Column) -> Column:
        number = lambda i: F.regexp_extract(s, _DMS, i).try_cast("double")
        fraction = F.when(s.rlike("[°'\"]"), F.coalesce(number(3), F.lit(0.0)) / 60.0
                          + F.coalesce(number(4), F.lit(0.0)) / 3600.0).otherwise(0.0)
        below = (F.regexp_extract(s, _DMS, 1) == "-") | s.rlike(rf"\b{negative}\b|{negative}\s*$")
        return (number(2) + fraction) * F.when(below, -1.0).otherwise(1.0)

    text = F.translate(F.upper(strip(c.cast("string"))), ",", ".")
    return let(let(text, degrees), lambda v: F.when(v.between(-limit, limit), round_half_up(v, 6)))


def coordinate_pair(lat: Column, lon: Column) -> Column:
    """``struct(lat, lon, swapped)``; the two are swapped back when only that makes sense.

    A swap is recognised when the latitude is unusable, the longitude is usable
    and reading them the other way round gives a valid point.
    """
    readings = F.struct(parse_coordinate(lat, "lat").alias("lat"), parse_coordinate(lon, "lon").alias("lon"),
                        parse_coordinate(lon, "lat").alias("alt_lat"), parse_coordinate(lat, "lon").alias("alt_lon"))

    def settle(r: Column) -> Column:
        swapped = (r["lat"].isNull() & r["lon"].isNotNull() & r["alt_lat"].isNotNull() & r["alt_lon"].isNotNull())
        return F.struct(F.when(swapped, r["alt_lat"]).otherwise(r["lat"]).alias("lat"),
                        F.when(swapped, r["alt_lon"]).otherwise(r["lon"]).alias("lon"),
                        swapped.alias("swapped"))
    return let(readings, settle)


def is_valid_point(lat: Column, lon: Column) -> Column:
    """Both coordinates present and inside WGS84 bounds."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
