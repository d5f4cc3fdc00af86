"""Outputs: tables, GeoJSON, previews, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casewell.functions.places import is_valid_point
from casewell.functions.text import percent, round_half_up
from casewell.lexicon import UNMATCHED

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def geojson_features(df: DataFrame, lat: str = "geo_lat", lon: str = "geo_lon") -> DataFrame:
    """``value``: one GeoJSON feature per row with a valid point.

    All other columns are properties (numbers stay numbers, nulls are kept), plus
    ``_pcode`` and ``_match_level``.
    """
    types = dict(df.dtypes)

    def prop(c: str) -> Column:
        plain = types[c] in _NUMBERS or types[c].startswith("decimal")
        return (F.col(c) if plain else F.col(c).cast("string")).alias(c)
    properties = [prop(c) for c in df.columns if c not in (lat, lon)]
    for name, c in (("_pcode", "pcode_assigned"), ("_match_level", "match_level")):
        properties.append((F.col(c) if c in types else F.lit(None).cast("string")).alias(name))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"))
    return (df.where(is_valid_point(F.col(lat), F.col(lon)))
            .select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")))


def write_geojson(df: DataFrame, path: str, lat: str = "geo_lat", lon: str = "geo_lon", mode: str = "error") -> None:
    """Newline-delimited GeoJSON, written in parallel."""
    geojson_features(df, lat, lon).write.mode(mode).text(path)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.orderBy("row_id").limit(n) if "row_id" in df.columns else df.limit(n)


def map_points(df: DataFrame, lat: str = "geo_lat", lon: str = "geo_lon", n: int | None = None) -> DataFrame:
    """The points of a map (the first ``n`` if given): ``id, lat, lng, name, pcode, match_level, score, epi_week``."""
    pick = lambda c, alias: (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(alias)
    who = F.coalesce(F.col("case_id") if "case_id" in df.columns else F.lit(None).cast("string"),
                     F.concat(F.lit("Case "), F.col("row_id").cast("string")))
    points = df.where(is_valid_point(F.col(lat), F.col(lon))).orderBy("row_id")
    return ((points if n is None else points.limit(n))
            .select(who.alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lng"), pick("matched_name", "name"),
                    pick("pcode_assigned", "pcode"), pick("match_level", "match_level"),
                    (F.col("match_score") if "match_score" in df.columns else F.lit(100.0)).alias("score"),
                    pick("epi_week", "epi_week")))


def kpi_table(df: DataFrame, scores: DataFrame, trend: DataFrame, alerts: DataFrame,
              lat: str | None = None, lon: str | None = None, phone: str | None = None) -> DataFrame:
    """``(kpi_no, kpi, value, note)``: the ten dashboard indicators."""
    have = lambda c: c is not None and c in df.columns
    coded = F.col("match_level") != UNMATCHED if have("match_level") else F.lit(False)
    one = df.agg(
        F.count("*").alias("n"), F.count_if(coded).alias("coded"),
        (F.avg(F.when(F.col("match_score") > 0, F.col("match_score"))) if have("match_score") else F.lit(None)).alias("score"),
        (F.count("epi_week") if have("epi_week") else F.lit(0)).alias("weeks"),
        (F.count_if(is_valid_point(F.col(lat), F.col(lon))) if have(lat) and have(lon) else F.lit(0)).alias("points"),
        (F.count(phone) if have(phone) else F.lit(0)).alias("phones"))
    small = (one.crossJoin(F.broadcast(scores.select("overall", "grade")))
             .crossJoin(F.broadcast(alerts.agg(F.count("*").alias("alerts"))))
             .crossJoin(F.broadcast(trend.agg(F.first("trend").alias("trend"), F.first("weekly_growth_pct").alias("growth"),
                                              F.first("peak_week").alias("peak")))))
    txt = lambda c: c.cast("string")
    of = lambda c: F.concat(txt(c), F.lit(" / "), txt(F.col("n")))
    rows = [
        ("total cases", txt(F.col("n")), F.lit("rows after cleaning")),
        ("geocoding rate %", txt(percent(F.col("coded"), F.col("n"), 1)), F.lit("share with an official code")),
        ("geocoded cases", of(F.col("coded")), F.lit("absolute")),
        ("mean match score", txt(round_half_up(F.coalesce("score", F.lit(0.0)), 1)), F.lit("over matched cases")),
        ("quality score", txt(F.col("overall")), F.concat(F.lit("grade "), F.col("grade"))),
        ("epi weeks computed", of(F.col("weeks")), F.lit("readable primary dates")),
        ("valid coordinates", txt(F.col("points")), F.lit("WGS84, swaps repaired")),
        ("standardised phones", txt(F.col("phones")), F.lit("international form")),
        ("incidence trend", F.concat(F.col("trend"), F.lit(" ("), txt(F.col("growth")), F.lit("%)")),
         F.concat(F.lit("peak week "), F.col("peak"))),
        ("outbreak alerts", txt(F.col("alerts")), F.lit("weeks above threshold")),
    ]
    return small.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("kpi_no"), F.lit(k).alias("kpi"), v.alias("value"), note.alias("note"))
        for i, (k, v, note) in enumerate(rows, 1)])))
