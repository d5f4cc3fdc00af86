"""Quality scores and column profiles."""

from __future__ import annotations

from typing import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from casewell.functions.text import not_blank, percent, round_half_up
from casewell.lexicon import KEY_TAGS, TAG_BY_NAME, TAGS

# Weights of the overall score, penalties per row share, grade limits.
WEIGHTS = {"completeness": 0.30, "chronology": 0.25, "validity": 0.25, "uniqueness": 0.20}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
CHRONOLOGY_PENALTY, ERROR_PENALTY, WARNING_PENALTY, DUPLICATE_PENALTY = 2.0, 2.0, 0.5, 2.5


def quality_scores(df: DataFrame, tags: dict[str, str], issues: DataFrame | None, members: DataFrame | None) -> DataFrame:
    """One row: completeness, chronology, validity, uniqueness, overall (0-100) and grade.

    An empty list scores 100.
    """
    keys = [tags[t] for t in KEY_TAGS if tags.get(t) in df.columns] or [c for c in df.columns if c != "row_id"]
    rows = df.agg(F.count("*").alias("n"), *[F.count_if(not_blank(F.col(c))).alias(f"k{i}") for i, c in enumerate(keys)])
    chrono = F.col("issue_type") == "DATE_CHRONOLOGY"
    error = F.col("severity") == "ERROR"
    counted = issues.agg(
        F.count_if(chrono & error).alias("chrono"), F.count_if(~chrono & error).alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings")) if issues is not None else None
    extra = (members.agg((F.count("*") - F.count_distinct("group_id")).alias("surplus"))
             if members is not None else None)
    one = rows
    for part in (counted, extra):
        if part is not None:
            one = one.crossJoin(F.broadcast(part))       # single-row tables
    for name in ("chrono", "errors", "warnings", "surplus"):
        if name not in one.columns:
            one = one.withColumn(name, F.lit(0))
    n = F.col("n").cast("double")
    share = sum((F.col(f"k{i}") * 100.0 / n for i in range(len(keys))), F.lit(0.0)) / float(len(keys))
    floor0 = lambda penalty: F.greatest(F.lit(0.0), 100.0 - penalty / n * 100.0)
    scores = {
        "completeness": share,
        "chronology": floor0(F.col("chrono") * CHRONOLOGY_PENALTY),
        "validity": floor0(F.col("errors") * ERROR_PENALTY + F.col("warnings") * WARNING_PENALTY),
        "uniqueness": floor0(F.col("surplus") * DUPLICATE_PENALTY),
    }
    one = one.select("n", *[F.when(F.col("n") > 0, s).otherwise(100.0).alias(k) for k, s in scores.items()])
    overall = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    one = one.withColumn("overall", round_half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), overall)), 1))
    grade = None
    for limit, letter in GRADES:
        grade = F.when(F.col("overall") >= limit, letter) if grade is None else grade.when(F.col("overall") >= limit, letter)
    return one.select(
        "overall", grade.otherwise("F").alias("grade"),
        *[round_half_up(F.col(k), 1).alias(k) for k in scores])


def quality_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return (before.select(F.col("overall").alias("before")).crossJoin(after.select(F.col("overall").alias("after")))
            .withColumn("delta", round_half_up(F.col("after") - F.col("before"), 1)))


def _inferred(dtype: str, tag: str | None) -> str:
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return "numeric"
    if dtype.startswith(("date", "timestamp")):
        return "date"
    return TAG_BY_NAME[tag].kind if tag in TAG_BY_NAME else "string"


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, value, cnt)`` of non-blank values of all columns, one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (df.select(F.inline(cells)).where(not_blank(F.col("value")))
            .groupBy("column_name", "value").agg(F.count("*").alias("cnt")))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """``(column_name, value, cnt, rank)``: the ``k`` most frequent values per column."""
    counts = value_counts(df, columns)
    # the ``k`` best survive a per-slice ranking first, so one column never meets in one task whole
    sliced = Window.partitionBy("column_name", F.pmod(F.xxhash64("value"), F.lit(256))).orderBy(F.desc("cnt"), "value")
    few = counts.withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= k)
    best = Window.partitionBy("column_name").orderBy(F.desc("cnt"), "value")
    return few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "column_name", "value", "cnt", F.col("rank").cast("int").alias("rank"))


def _first_cells(columns: Sequence[str], k: int):
    """For each column, the first ``k`` filled cells of a task in row order; a few rows are held, whatever the task's size."""
    def first(ids, cells):
        filled = pc.sort_indices(ids, null_placement="at_start")
        filled = filled.filter(cells.is_valid().take(filled)).slice(0, k)
        return ids.take(filled), cells.take(filled)

    def pick(batches):
        best = [None] * len(columns)
        for batch in batches:
            for i in range(len(columns)):
                found = first(batch.column(0), batch.column(i + 1))
                best[i] = found if best[i] is None else first(*(pa.concat_arrays(pair) for pair in zip(best[i], found)))
        for name, found in zip(columns, best):
            if found is not None:
                ids, cells = found
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), ids, cells], ["column_name", "row_id", "value"])
    return pick


def sample_values(df: DataFrame, columns: Sequence[str], k: int = 4) -> DataFrame:
    """``(column_name, value, rank)``: the first ``k`` non-blank values per column in row order."""
    filled = [F.when(not_blank(F.col(c)), F.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)]
    # each task gives its ``k`` first cells of a column; sorting every cell would need the memory of all of them
    few = df.select("row_id", *filled).mapInArrow(
        _first_cells(list(columns), k), f"column_name string, row_id {dict(df.dtypes)['row_id']}, value string")
    first = Window.partitionBy("column_name").orderBy("row_id")
    return few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "column_name", "value", F.col("rank").cast("int").alias("rank"))


def column_summary(df: DataFrame, tags: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """``(column_name, inferred_type, mapped_tag, total_count, missing_count, missing_pct, unique_count)``."""
    types = dict(df.dtypes)
    tag_of = {c: t for t, c in tags.items()}
    facts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(_inferred(types[c], tag_of.get(c))).alias("inferred_type"),
                               F.lit(tag_of.get(c)).cast("string").alias("mapped_tag"),
                               F.lit(i).alias("position")) for i, c in enumerate(columns)])
    per = value_counts(df, columns).groupBy("column_name").agg(
        F.count("*").alias("unique_count"), F.sum("cnt").alias("filled"))
    total = df.agg(F.count("*").alias("total_count")).select("total_count", F.inline(facts))
    out = total.join(per, "column_name", "left").fillna(0, ["unique_count", "filled"])
    missing = F.col("total_count") - F.col("filled")
    return out.select("column_name", "inferred_type", "mapped_tag", "total_count", missing.alias("missing_count"),
                      percent(missing, F.col("total_count"), 1).alias("missing_pct"), "unique_count", "position")


def column_profile(df: DataFrame, tags: dict[str, str], issues: DataFrame | None = None,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """The full profile: summary, top-5 values, first four samples and issue count per column."""
    columns = list(columns or [c for c in df.columns if c != "row_id"])
    top = top_values(df, columns).groupBy("column_name").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))),
                                       lambda x: F.struct(x["value"], x["cnt"]))).alias("top_values"))
    samples = sample_values(df, columns).groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("sample_values"))
    out = column_summary(df, tags, columns).join(top, "column_name", "left").join(samples, "column_name", "left")
    if issues is None:
        return out.withColumn("issue_count", F.lit(0).cast("bigint"))
    hits = issues.groupBy("column_name").agg(F.count("*").alias("issue_count"))
    return out.join(hits, "column_name", "left").fillna(0, ["issue_count"])


def inspect_columns(df: DataFrame, tags: dict[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, mapped_tag, category, completeness_pct, unique_count, first_value)``."""
    columns = list(columns or [c for c in df.columns if c != "row_id"])
    category = F.create_map(*[F.lit(x) for t in TAGS for x in (t.name, t.category)])
    first = sample_values(df, columns, 1).select("column_name", F.col("value").alias("first_value"))
    return (column_summary(df, tags, columns).join(first, "column_name", "left")
            .select("column_name", "mapped_tag", F.coalesce(category[F.col("mapped_tag")], F.lit("unclassified")).alias("category"),
                    percent(F.col("total_count") - F.col("missing_count"), F.col("total_count"), 1).alias("completeness_pct"),
                    "unique_count", "first_value"))


def tag_legend(spark, first: int = 12) -> DataFrame:
    """``(category, tags, more)``: the canonical tags by category, the first twelve named."""
    rows = spark.createDataFrame([(t.category, i, t.name) for i, t in enumerate(TAGS)], "category string, i int, tag string")
    names = F.transform(F.array_sort(F.collect_list(F.struct("i", "tag"))), lambda x: x["tag"])
    return (rows.groupBy("category").agg(names.alias("names"), F.min("i").alias("i"))
            .select("category", F.array_join(F.slice("names", 1, first), ", ").alias("tags"),
                    (F.size("names") > first).alias("more"), "i").orderBy("i").drop("i"))
