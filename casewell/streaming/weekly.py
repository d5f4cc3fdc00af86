"""The row-local cleaning rules on a stream, with weekly counts and alerts.

The rules are plain column expressions, so a stream uses the same functions as a
batch.  Alerts compare all weeks, so they are derived from the whole weekly table
whenever a micro-batch has changed it.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from casewell.functions.dates import epi_week
from casewell.operators.surveillance import weekly_alerts

# Epoch day 0 was a Thursday: shifting by four days makes seven-day windows start on Mondays.
_MONDAY = "4 days"


def weekly_counts_stream(cases: DataFrame, when: str, by: tuple[str, ...] = (), delay: str = "14 days") -> DataFrame:
    """``(*by, week, cases)`` per ISO week of the timestamp column ``when``.

    Rows later than ``delay`` are dropped in append and update mode; complete mode keeps all weeks and counts them still.
    """
    windows = (cases.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, delay)
               .groupBy(F.window(when, "7 days", "7 days", _MONDAY).alias("w"), *by).agg(F.count("*").alias("cases")))
    return windows.select(*by, epi_week(F.col("w.start").cast("date")).alias("week"), "cases")


def write_alerts(counts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, by: tuple[str, ...] = (),
                 multiplier: float = 1.5):
    """Start a query handing the current alerts to ``sink`` after every micro-batch."""
    def batch(table: DataFrame, number: int) -> None:
        sink(weekly_alerts(table, by, multiplier), number)
    return (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .foreachBatch(batch).start())
