"""Epidemiological indicators of a cleaned case list."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casewell.functions.ages import DEFAULT_BREAKS, age_band, band_order
from casewell.functions.dates import as_date, epi_week
from casewell.functions.text import percent, round_half_up
from casewell.settings import ensure_checkpoint_dir

MAX_DELAY = 180
DELAYS = (
    ("onset_to_consultation", "date_onset", "date_consultation"),
    ("onset_to_admission", "date_onset", "date_admission"),
    ("hospital_length_of_stay", "date_admission", "date_discharge"),
    ("onset_to_death", "date_onset", "date_death"),
)
DELAY_BINS = (("0-2 days", 0, 2), ("3-5 days", 3, 5), ("6-10 days", 6, 10), ("11-20 days", 11, 20),
              (">20 days", 21, MAX_DELAY))
PERIODS = ("day", "week", "month")


def _is(df: DataFrame, tags: dict[str, str], tag: str, value: str) -> Column:
    if tags.get(tag) not in df.columns:
        return F.lit(False)
    return F.coalesce(F.lower(F.col(tags[tag])) == value.lower(), F.lit(False))


def _date(df: DataFrame, column: str) -> Column:
    return as_date(F.col(column), dict(df.dtypes)[column])


def case_indicators(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """One row of counts, fatality ratios, hospitalisation rate and sex ratio."""
    if tags.get("hospitalized") in df.columns:
        hospital = _is(df, tags, "hospitalized", "Yes")
    elif tags.get("date_admission") in df.columns:
        hospital = F.col(tags["date_admission"]).isNotNull()
    else:
        hospital = F.lit(False)
    counts = {
        "total_cases": F.count("*"),
        "confirmed_cases": F.count_if(_is(df, tags, "case_definition", "Confirmed")),
        "probable_cases": F.count_if(_is(df, tags, "case_definition", "Probable")),
        "suspect_cases": F.count_if(_is(df, tags, "case_definition", "Suspect")),
        "deaths": F.count_if(_is(df, tags, "outcome", "Dead")),
        "recovered": F.count_if(_is(df, tags, "outcome", "Recovered")),
        "hospitalized_count": F.count_if(hospital),
        "male_count": F.count_if(_is(df, tags, "sex", "Male")),
        "female_count": F.count_if(_is(df, tags, "sex", "Female")),
    }
    one = df.agg(*[v.alias(k) for k, v in counts.items()])
    total, deaths, closed = F.col("total_cases"), F.col("deaths"), F.col("deaths") + F.col("recovered")
    male, female = F.col("male_count"), F.col("female_count")
    return one.select(
        *counts,
        percent(deaths, total, 2).alias("cfr_pct"),
        F.when(closed > 0, percent(deaths, closed, 2)).otherwise(percent(deaths, total, 2)).alias("closed_cfr_pct"),
        percent(F.col("hospitalized_count"), total, 2).alias("hospitalization_rate_pct"),
        F.when(female > 0, round_half_up(male / female, 2)).when(male > 0, male.cast("double")).otherwise(1.0)
        .alias("sex_ratio_m_f"))


def age_stats(df: DataFrame, age: str = "age") -> DataFrame:
    """One row: median, mean, quartiles, min and max of the age, one decimal."""
    y = F.col(age).try_cast("double")
    one = df.agg(F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg(y).alias("mean"),
                 F.min(y).alias("min"), F.max(y).alias("max"))
    r = lambda c: round_half_up(c, 1)
    return one.select(r(F.col("q")[1]).alias("median"), r(F.col("mean")).alias("mean"), r(F.col("q")[0]).alias("q25"),
                      r(F.col("q")[2]).alias("q75"), r(F.col("min")).alias("min"), r(F.col("max")).alias("max"))


def curve_column(df: DataFrame, tags: dict[str, str]) -> str | None:
    """Date the epidemic curve runs on: onset, else consultation, else admission."""
    return next((tags[t] for t in ("date_onset", "date_consultation", "date_admission") if tags.get(t) in df.columns), None)


def period_label(d: Column, unit: str) -> Column:
    if unit == "week":
        return epi_week(d)
    return F.date_format(d, {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit])


def epi_curve(df: DataFrame, date: str, unit: str = "day", stratify: str | None = None) -> DataFrame:
    """Cases per observed period, sorted: ``(period[, stratum], cases)``."""
    rows = df.select(period_label(_date(df, date), unit).alias("period"),
                     *([F.coalesce(F.col(stratify).cast("string"), F.lit("Unknown")).alias("stratum")] if stratify else []))
    keys = ["period", "stratum"] if stratify else ["period"]
    return (rows.where(F.col("period").isNotNull()).groupBy(*keys).agg(F.count("*").alias("cases")).orderBy(*keys))


def epi_curve_wide(df: DataFrame, date: str, unit: str, stratify: str, categories: Sequence[str] | None = None,
                   most: int = 64) -> DataFrame:
    """Zero-filled curve with one column per category and a total.

    Named categories need no extra pass, and other values count in the total only.  Without names the observed ones are
    looked up first, in the counted curve; beyond ``most`` of them the curve stays long: ``(period, stratum, cases)``.
    """
    long = epi_curve(df, date, unit, stratify)
    if categories is None:
        ensure_checkpoint_dir(df.sparkSession)
        long = long.checkpoint()
        categories = sorted(r[0] for r in long.select("stratum").distinct().limit(most + 1).collect())
        if len(categories) > most:
            return long
    return long.groupBy("period").agg(
        *[F.coalesce(F.sum(F.when(F.col("stratum") == c, F.col("cases"))), F.lit(0)).alias(c) for c in categories],
        F.sum("cases").alias("total")).orderBy("period")


def delays(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """``(delay, days)`` of the plausible delays (0 to 180 days) of every case."""
    usable = [(name, tags[a], tags[b]) for name, a, b in DELAYS if tags.get(a) in df.columns and tags.get(b) in df.columns]
    if not usable:
        return df.sparkSession.createDataFrame([], "delay string, days int")
    each = F.array(*[F.struct(F.lit(name).alias("delay"), F.datediff(_date(df, b), _date(df, a)).alias("days"))
                     for name, a, b in usable])
    return df.select(F.inline(each)).where(F.col("days").between(0, MAX_DELAY))


def delay_stats(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Count, mean, median, quartiles, min, max and histogram per delay.

    Delays are whole days up to 180, so they are counted per day first; the
    percentiles then work on at most 181 rows per delay whatever the case count.
    """
    per_day = delays(df, tags).groupBy("delay", "days").agg(F.count("*").alias("n"))
    n = F.col("n")
    q = F.percentile("days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    one = per_day.groupBy("delay").agg(
        F.sum("n").alias("count"), (F.sum(F.col("days") * n) / F.sum("n")).alias("mean"), q.alias("q"),
        F.min("days").alias("min_days"), F.max("days").alias("max_days"),
        *[F.coalesce(F.sum(F.when(F.col("days").between(lo, hi), n)), F.lit(0)).alias(name) for name, lo, hi in DELAY_BINS])
    r = lambda c: round_half_up(c, 1)
    return one.select("delay", "count", r(F.col("mean")).alias("mean_days"), r(F.col("q")[1]).alias("median_days"),
                      r(F.col("q")[0]).alias("q25_days"), r(F.col("q")[2]).alias("q75_days"), "min_days", "max_days",
                      *[name for name, _, _ in DELAY_BINS])


def delay_histogram(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """``(delay, bin, cnt)``, empty bins included for delays that occur."""
    bins = F.array(*[F.struct(F.lit(name).alias("bin"), F.col(name).alias("cnt")) for name, _, _ in DELAY_BINS])
    return delay_stats(df, tags).select("delay", F.inline(bins))


def _fatality(df: DataFrame, tags: dict[str, str], key: Column, name: str) -> DataFrame:
    rows = df.select(key.alias(name), _is(df, tags, "outcome", "Dead").alias("dead")).where(F.col(name).isNotNull())
    return (rows.groupBy(name).agg(F.count("*").alias("total"), F.count_if("dead").alias("deaths"))
            .withColumn("cfr_pct", percent(F.col("deaths"), F.col("total"), 2)))


def cfr_by_sex(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    sex = F.when(_is(df, tags, "sex", "Male"), "Male").when(_is(df, tags, "sex", "Female"), "Female")
    return _fatality(df, tags, sex, "sex")


def cfr_by_age_group(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    return _fatality(df, tags, F.col("age_group"), "age_group")


def pyramid(df: DataFrame, tags: dict[str, str], breaks: Sequence[int] = DEFAULT_BREAKS,
            labels: Sequence[str] | None = None) -> DataFrame:
    """``(band_no, age_group, male, female, other)`` in the order of the breaks."""
    if "age_group" in df.columns:
        band = F.col("age_group")
    else:
        band = age_band(F.col(tags["age"]).try_cast("double"), breaks, labels)
    male, female = _is(df, tags, "sex", "Male"), _is(df, tags, "sex", "Female")
    rows = df.select(band.alias("age_group"), male.alias("m"), female.alias("f")).where(F.col("age_group").isNotNull())
    return (rows.groupBy("age_group").agg(F.count_if("m").alias("male"), F.count_if("f").alias("female"),
                                          F.count_if(~F.col("m") & ~F.col("f")).alias("other"))
            .withColumn("band_no", band_order(F.col("age_group"), breaks, labels).cast("int"))
            .select("band_no", "age_group", "male", "female", "other").orderBy("band_no", "age_group"))

