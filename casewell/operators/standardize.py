"""Column cleaning over a case list, and the counters that go with it."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casewell.functions.ages import DEFAULT_BREAKS, age_band, parse_age, parse_age_with_unit
from casewell.functions.dates import day_month_votes, epi_week, epi_week_number, epi_year, parse_date, parse_rare_date
from casewell.functions.phones import clean_phone
from casewell.functions.places import coordinate_pair
from casewell.functions.text import is_missing, not_blank
from casewell.settings import ensure_checkpoint_dir

# Tokens the phone statistics count as "no phone given".
_PHONE_BLANK = ("", "NA", "nan", "None")


def text_columns(df: DataFrame) -> list[str]:
    return [name for name, dtype in df.dtypes if dtype == "string"]


def null_missing(df: DataFrame, columns: Sequence[str] | None = None, extra: Iterable[str] = ()) -> DataFrame:
    """Missing-value tokens become null in all (or the given) text columns."""
    chosen = set(columns if columns is not None else text_columns(df))
    return df.select(*[F.when(~is_missing(F.col(c), extra), F.col(c)).alias(c) if c in chosen else F.col(c)
                       for c in df.columns])


def long_stats(df: DataFrame, columns: Sequence[str], metrics: dict[str, "callable"], key: str = "column_name") -> DataFrame:
    """Many aggregates of many columns in one scan, one output row per column."""
    wide = df.agg(*[make(c).alias(f"{i}_{m}") for i, c in enumerate(columns) for m, make in metrics.items()])
    rows = F.array(*[
        F.struct(F.lit(c).alias(key), *[F.col(f"{i}_{m}").alias(m) for m in metrics])
        for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None, extra: Iterable[str] = ()) -> DataFrame:
    """``(column_name, token_cells, null_cells)``: tokens turned into null, and nulls already there."""
    return long_stats(df, columns or text_columns(df), {
        "token_cells": lambda c: F.count_if(F.col(c).isNotNull() & is_missing(F.col(c), extra)),
        "null_cells": lambda c: F.count_if(F.col(c).isNull()),
    })


# --- dates -----------------------------------------------------------------
def day_first_votes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, dmy_votes, mdy_votes, day_first)`` of text columns, one scan."""
    votes = long_stats(df, columns, {
        "dmy_votes": lambda c: day_month_votes(F.col(c))[0],
        "mdy_votes": lambda c: day_month_votes(F.col(c))[1],
    })
    return votes.withColumn("day_first", F.col("mdy_votes") <= F.col("dmy_votes"))


def infer_day_first(df: DataFrame, columns: Sequence[str], preference: str = "auto") -> dict[str, bool]:
    """Date order per column; one row per column reaches the driver."""
    if preference in ("DMY", "MDY") or not columns:
        return {c: preference != "MDY" for c in columns}
    return {r["column_name"]: r["day_first"] for r in day_first_votes(df, columns).collect()}


def clean_dates(df: DataFrame, day_first: dict[str, bool], century_pivot: int | None = None, rare: bool = False) -> DataFrame:
    """Parse the given columns into dates.

    With ``rare`` the distinct texts that stay unread are parsed once more, by the rules for rare shapes, and joined back.
    """
    types = dict(df.dtypes)
    texts = [c for c in day_first if not types[c].startswith(("date", "timestamp"))]

    def cleaned(c: str) -> Column:
        return parse_date(F.col(c), day_first[c], century_pivot=century_pivot) if c in texts else F.col(c).cast("date")
    found = _rare_dates(df, {c: day_first[c] for c in texts}, century_pivot) if rare and texts else None
    if found is None or found.isEmpty():
        return df.select(*[cleaned(c).alias(c) if c in day_first else F.col(c) for c in df.columns])
    for c in texts:
        mine = found.where(F.col("_first") == day_first[c]).select(F.col("_text").alias(f"_{c}_text"), F.col("_date").alias(f"_{c}_date"))
        df = df.join(mine, F.col(c) == F.col(f"_{c}_text"), "left").drop(f"_{c}_text")
    read = {c: F.coalesce(cleaned(c), F.col(f"_{c}_date")) if c in texts else cleaned(c) for c in day_first}
    return df.select(*[read[c].alias(c) if c in read else F.col(c) for c in df.columns if c not in {f"_{t}_date" for t in texts}])


def _rare_dates(df: DataFrame, day_first: dict[str, bool], century_pivot: int | None) -> DataFrame:
    """``_text``, ``_first``, ``_date``: the distinct texts of the columns that only the rules for rare shapes can read."""
    ensure_checkpoint_dir(df.sparkSession)
    cells = F.explode(F.array(*[F.struct(F.col(c).cast("string").alias("_text"), F.lit(first).alias("_first"),
                                         parse_date(F.col(c), first, century_pivot=century_pivot).alias("_read"))
                                for c, first in day_first.items()])).alias("x")
    unread = df.select(cells).select("x.*").where(F.col("_read").isNull() & ~is_missing(F.col("_text"))).select("_text", "_first").distinct()
    read = unread.withColumn("_date", parse_rare_date(F.col("_text"), F.col("_first"), century_pivot=century_pivot))
    return read.where(F.col("_date").isNotNull()).checkpoint()


def date_stats(df: DataFrame, day_first: dict[str, bool], century_pivot: int | None = None) -> DataFrame:
    """``(column_name, total_rows, raw_non_null, parsed, failed)`` of raw date columns, one scan."""
    columns = list(day_first)
    both = df.select(*[F.struct(F.col(c).alias("raw"), parse_date(F.col(c), day_first[c], century_pivot=century_pivot)
                                .alias("d")).alias(c) for c in columns])
    return long_stats(both, columns, {
        "total_rows": lambda c: F.count("*"),
        "raw_non_null": lambda c: F.count(F.col(f"{c}.raw")),
        "parsed": lambda c: F.count(F.col(f"{c}.d")),
        "failed": lambda c: F.count_if(F.col(f"{c}.d").isNull() & ~is_missing(F.col(f"{c}.raw"))),
    })


def failed_dates(df: DataFrame, column: str, day_first: bool = True, limit: int = 5) -> DataFrame:
    """The first values of a column that could not be read."""
    bad = parse_date(F.col(column), day_first).isNull() & ~is_missing(F.col(column))
    return df.where(bad).select("row_id", F.col(column).alias("value")).orderBy("row_id").limit(limit)


def add_epi_week(df: DataFrame, date_column: str) -> DataFrame:
    """Adds ``date_admission_clean, epi_week, epi_week_num, epi_year`` from a date column."""
    d = F.col(date_column)
    return (df.withColumn("date_admission_clean", d).withColumn("epi_week", epi_week(d))
            .withColumn("epi_week_num", epi_week_number(d)).withColumn("epi_year", epi_year(d)))


# --- ages ------------------------------------------------------------------
def age_years(age: str, unit: str | None = None) -> Column:
    return parse_age_with_unit(F.col(age), F.col(unit)) if unit else parse_age(F.col(age))


def clean_ages(df: DataFrame, age: str, unit: str | None = None, breaks: Sequence[int] = DEFAULT_BREAKS,
               labels: Sequence[str] | None = None, bands: bool = True) -> DataFrame:
    """Age in years, with ``age_group`` placed right after it."""
    out = df.withColumn(age, age_years(age, unit))
    if not bands:
        return out
    order = [x for c in df.columns for x in ((c, "age_group") if c == age else (c,)) if x != "age_group" or c == age]
    return out.withColumn("age_group", age_band(F.col(age), breaks, labels)).select(*order)


def age_stats(df: DataFrame, age: str, unit: str | None = None) -> DataFrame:
    """One row: ``total_rows, parsed_count, invalid_count, mean_age, median_age``."""
    years = df.select(F.col(age).alias("raw"), age_years(age, unit).alias("y"))
    return years.agg(
        F.count("*").alias("total_rows"), F.count("y").alias("parsed_count"),
        F.count_if(F.col("y").isNull() & ~is_missing(F.col("raw"))).alias("invalid_count"),
        F.coalesce(F.avg("y"), F.lit(0.0)).alias("mean_age"),
        F.coalesce(F.percentile("y", F.lit(0.5)), F.lit(0.0)).alias("median_age"))


# --- coordinates and phones ------------------------------------------------
def clean_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Decimal coordinates in place, repaired when the two were swapped; adds ``geo_lat, geo_lon``
    unless geocoding already did."""
    point = df.withColumn("_point", coordinate_pair(F.col(lat), F.col(lon)))
    out = point.withColumn(lat, F.col("_point.lat")).withColumn(lon, F.col("_point.lon"))
    if "geo_lat" not in df.columns:
        out = out.withColumn("geo_lat", F.col("_point.lat"))
    if "geo_lon" not in df.columns:
        out = out.withColumn("geo_lon", F.col("_point.lon"))
    return out.drop("_point")


def coordinate_stats(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row: ``cleaned, swapped_fixed, invalid``."""
    point = df.select(coordinate_pair(F.col(lat), F.col(lon)).alias("p"))
    usable = F.col("p.lat").isNotNull() & F.col("p.lon").isNotNull()
    return point.agg(F.count_if(usable).alias("cleaned"), F.count_if(F.col("p.swapped")).alias("swapped_fixed"),
                     F.count_if(~usable).alias("invalid"))


def phone_stats(df: DataFrame, phone: str, country_code: str = "+221") -> DataFrame:
    """One row: ``valid, invalid, total``."""
    both = df.select(F.col(phone).alias("raw"), clean_phone(F.col(phone), country_code).alias("clean"))
    given = ~F.trim("raw").isin(*_PHONE_BLANK)
    return both.agg(F.count("clean").alias("valid"),
                    F.count_if(F.col("clean").isNull() & F.col("raw").isNotNull() & given).alias("invalid"),
                    F.count("*").alias("total"))


# --- row filters -----------------------------------------------------------
def search_any_column(df: DataFrame, text: str) -> DataFrame:
    """Rows where any value contains ``text``, ignoring case."""
    needle = F.lit(text.lower())
    hit = None
    for c in df.columns:
        found = F.coalesce(F.contains(F.lower(F.col(c).cast("string")), needle), F.lit(False))
        hit = found if hit is None else hit | found
    return df.where(hit)


def level_filter(df: DataFrame, level: str) -> DataFrame:
    """Rows geocoded at ``level``; ``ALL`` keeps every row."""
    return df if level == "ALL" else df.where(F.col("match_level") == level)


def with_value(df: DataFrame, column: str) -> DataFrame:
    return df.where(not_blank(F.col(column)))
