"""Weekly counts, outbreak alerts and trends.

Everything after the first aggregation works on one row per week, a table whose
size depends on the calendar and not on the number of cases.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from casewell.functions.text import percent, round_half_up
from casewell.settings import ensure_checkpoint_dir

MIN_WEEKS = 3
MIN_CASES = 5


def weekly_counts(df: DataFrame, week: str = "epi_week", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, week, cases)``; rows without a week are left out.

    They are left out after counting: a filter on the week would be pushed below and parse every date again.
    """
    return df.groupBy(*by, F.col(week).alias("week")).agg(F.count(week).alias("cases")).where(F.col("cases") > 0)


def weekly_share(df: DataFrame, week: str = "epi_week") -> DataFrame:
    """``(week, cases, pct)``: share of all rows, those without a week included."""
    total = df.agg(F.count("*").alias("total"))
    return (weekly_counts(df, week).crossJoin(F.broadcast(total))
            .select("week", "cases", percent(F.col("cases"), F.col("total"), 1).alias("pct")).orderBy("week"))


def fill_weeks(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weeks without a case between the first and the last one, as zero rows."""
    ensure_checkpoint_dir(counts.sparkSession)
    counts = counts.checkpoint()        # a row per week, used twice
    monday = F.expr("date_add(trunc(make_date(cast(substr(week, 1, 4) as int), 1, 4), 'WEEK'), "
                    "7 * (cast(substr(week, 7) as int) - 1))")
    days = counts.withColumn("monday", monday)
    span = days.groupBy(*by).agg(F.sequence(F.min("monday"), F.max("monday"), F.expr("interval 7 days")).alias("all"))
    every = span.select(*by, F.explode("all").alias("monday"))
    label = F.concat(F.extract(F.lit("YEAROFWEEK"), "monday").cast("string"), F.lit("-W"),
                     F.lpad(F.weekofyear("monday").cast("string"), 2, "0"))
    return (every.join(days.drop("week"), [*by, "monday"], "left").withColumn("week", label)
            .select(*by, "week", F.coalesce("cases", F.lit(0)).alias("cases")))


def weekly_alerts(counts: DataFrame, by: Sequence[str] = (), multiplier: float = 1.5, min_cases: int = MIN_CASES) -> DataFrame:
    """``(*by, week, cases, baseline_mean, severity, threshold)`` of the weeks that stand out.

    At least three observed weeks are needed.  A week with ``min_cases`` or more
    is an alert above ``multiplier`` times the mean, or above the mean plus two
    standard deviations (population), which also makes it HIGH.
    """
    per = Window.partitionBy(*by)
    mean, sd, weeks = F.avg("cases").over(per), F.stddev_pop("cases").over(per), F.count("*").over(per)
    x = counts.withColumn("mean", mean).withColumn("sd", sd).withColumn("weeks", weeks)
    high = F.col("cases") > F.col("mean") + 2 * F.col("sd")
    alert = ((F.col("weeks") >= MIN_WEEKS) & (F.col("cases") >= min_cases)
             & ((F.col("cases") > F.col("mean") * multiplier) | ((F.col("sd") > 0) & high)))
    return x.where(alert).select(*by, "week", "cases", round_half_up(F.col("mean"), 1).alias("baseline_mean"),
                                 F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"),
                                 round_half_up(F.col("mean") * multiplier, 1).alias("threshold"))


def incidence_trend(counts: DataFrame, by: Sequence[str] = (), drop_last: bool = False) -> DataFrame:
    """One row per group: trend, growth in percent, doubling time, peak week, last two counts.

    Growth compares the last two observed weeks (``drop_last`` leaves a partial last
    week out); more than 20 % up or down is a trend.  Doubling time is in weeks and
    only given while cases grow.
    """
    if drop_last:
        last = F.max("week").over(Window.partitionBy(*by))
        counts = counts.withColumn("_last", last).where(F.col("week") < F.col("_last")).drop("_last")
    peak = F.expr("min_by(week, struct(-cases as c, week as w))")
    latest = F.max(F.struct("week", "cases"))
    previous = Window.partitionBy(*by).orderBy("week")
    x = counts.withColumn("before", F.lag("cases").over(previous))
    one = x.groupBy(*by).agg(
        F.count("*").alias("weeks"), peak.alias("peak_week"), latest["cases"].alias("last_week_cases"),
        F.max(F.struct("week", "before"))["before"].alias("previous_week_cases"))
    last, prev = F.col("last_week_cases"), F.col("previous_week_cases")
    growth = F.when((F.col("weeks") >= 2) & (prev > 0), round_half_up((last - prev) / prev * 100.0, 1)).otherwise(0.0)
    one = one.withColumn("weekly_growth_pct", growth)
    g = F.col("weekly_growth_pct")
    return one.select(
        *by, F.when(g > 20, "increasing").when(g < -20, "decreasing").otherwise("stable").alias("trend"),
        "weekly_growth_pct",
        F.when(g > 0, round_half_up(F.log(F.lit(2.0)) / F.log(1.0 + g / 100.0), 1)).alias("doubling_weeks"),
        "peak_week", F.when(F.col("weeks") >= 2, last).alias("last_week_cases"), "previous_week_cases")
