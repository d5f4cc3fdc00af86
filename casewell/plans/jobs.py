"""User-level jobs: clean, validate, audit, geocode, profile, analyse, compare.

A job binds the schema on the driver and returns lazy DataFrames; nothing is
computed until they are written or counted, except the small facts a plan needs
(date order per column, greedy clusters, distinct place names).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from casewell.functions.categories import (
    standardize_binary, standardize_case_definition, standardize_outcome, standardize_sex,
)
from casewell.functions.phones import clean_phone
from casewell.lexicon import BINARY_TAGS
from casewell.operators import analytics, dedup, geocode, privacy, quality, standardize, surveillance, validate
from casewell.operators.facility import harmonize_facilities
from casewell.plans import binding
from casewell.settings import CleaningConfig, ensure_checkpoint_dir
from casewell.sources import sinks



@dataclass
class Bundle:
    """A job's outputs: the case list, the tag bindings and named report tables."""

    cases: DataFrame
    tags: dict[str, str]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, folder: str, fmt: str = "parquet", mode: str = "error") -> None:
        """One folder per table.  CSV has no nested types, so those are written as JSON text."""
        for name, table in {"cases": self.cases, **self.tables}.items():
            if fmt == "csv":
                nested = {n for n, t in table.dtypes if t.startswith(("array", "map", "struct"))}
                table = table.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in table.columns])
            sinks.write_table(table, f"{folder}/{name}", fmt, mode)


def bind(df: DataFrame, cfg: CleaningConfig) -> tuple[DataFrame, dict[str, str], list[binding.Binding], list[tuple[str, str]]]:
    """Standard headers and tag bindings; ``row_id`` is kept as it is."""
    content = [c for c in df.columns if c != "row_id"]
    pairs = binding.unique_identifiers(content) if cfg.standardize_headers else [(c, c) for c in content]
    out = df.select("row_id", *[F.col(f"`{old}`").alias(new) for old, new in pairs])
    custom = {**cfg.column_mapping}
    bound = binding.bind_columns([n for _, n in pairs], custom=custom) if cfg.auto_bind else \
        [b for b in binding.bind_columns([n for _, n in pairs], threshold=1.01, custom=custom)]
    return out, binding.tag_columns(bound), bound, pairs


def _issues(df: DataFrame, tags: dict[str, str], cfg: CleaningConfig) -> DataFrame:
    return validate.find_issues(df, tags, cfg.as_of, cfg.outbreak_start, cfg.validate_chronology,
                                cfg.validate_demographics, cfg.validate_clinical)


def clean(df: DataFrame, gazetteer: DataFrame | None = None, cfg: CleaningConfig = CleaningConfig()) -> Bundle:
    """The whole cleaning run over a list with ``row_id``.

    ``gazetteer`` needs its row order in ``ref_row``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spark = df.sparkSession
    logs: list[tuple[str, str, DataFrame]] = []
    df, tags, bound, pairs = bind(df, cfg)
    content = [c for c in df.columns if c != "row_id"]
    tables: dict[str, DataFrame] = {"bindings": binding.bindings_table(spark, bound)}

    if cfg.standardize_missing:
        logs.append(("missing values", "tokens to null", standardize.missing_counts(df, extra=cfg.extra_missing_tokens)
                     .select("column_name", F.col("token_cells").alias("affected"))))
        df = standardize.null_missing(df, extra=cfg.extra_missing_tokens)
    if cfg.baseline_quality:
        tables["quality_before"] = quality.quality_scores(
            df, tags, _issues(df, tags, cfg), dedup.find_duplicates(df, tags, "exact"))

    if cfg.standardize_dates:
        columns = binding.date_columns(content, tags)
        order = standardize.infer_day_first(df, columns, cfg.date_order)
        if columns:
            logs.append(("dates", "to dates", standardize.date_stats(df, order, int(cfg.as_of[:4]) if cfg.as_of else None)
                         .select("column_name", F.col("parsed").alias("affected"))))
        pivot = int(cfg.as_of[:4]) if cfg.as_of else None
        df = standardize.clean_dates(df, order, pivot, rare=True)
        primary = binding.primary_date(content, tags)
        if cfg.compute_epi_weeks and primary:
            df = standardize.add_epi_week(df, primary)
            logs.append(("epi weeks", f"from {primary}", standardize.long_stats(
                df, ["epi_week"], {"affected": lambda c: F.count(c)})))

    geocoded = cfg.geocode and gazetteer is not None
    if geocoded:
        places = binding.place_columns(content, tags)
        roles = binding.gazetteer_roles([c for c in gazetteer.columns if c != "ref_row"], cfg.gazetteer_mapping)
        if cfg.geocode_nested:
            df = geocode.geocode_nested(df, geocode.nested_index(gazetteer, roles), places, cfg.geocode_threshold)
        else:
            df = geocode.geocode(df, geocode.gazetteer_index(gazetteer, roles), places, cfg.geocode_threshold)
        tables["geocode_summary"] = geocode.geocode_summary(df)
        tables["gazetteer"] = gazetteer

    lat, lon = binding.coordinate_columns(content)
    if cfg.clean_coordinates and lat and lon:
        logs.append(("coordinates", "checked and unswapped", standardize.coordinate_stats(df, lat, lon)
                     .select(F.lit(lat).alias("column_name"), F.col("cleaned").alias("affected"))))
        df = standardize.clean_coordinates(df, lat, lon)
    if cfg.clean_phones and "phone" in tags:
        logs.append(("phones", "international form", standardize.phone_stats(df, tags["phone"], cfg.phone_country_code)
                     .select(F.lit(tags["phone"]).alias("column_name"), F.col("valid").alias("affected"))))
        df = df.withColumn(tags["phone"], clean_phone(F.col(tags["phone"]), cfg.phone_country_code))

    rules = {}
    if cfg.standardize_sex:
        rules["sex"] = standardize_sex
    if cfg.standardize_case_definitions:
        rules["case_definition"] = standardize_case_definition
    if cfg.standardize_outcomes:
        rules["outcome"] = standardize_outcome
    if cfg.standardize_binary:
        rules |= {t: standardize_binary for t in BINARY_TAGS}
    by_column = {tags[t]: rule for t, rule in rules.items() if t in tags}
    df = df.select(*[by_column[c](F.col(c)).alias(c) if c in by_column else F.col(c) for c in df.columns])
    if cfg.standardize_ages and "age" in tags:
        unit = tags.get("age_unit")
        logs.append(("ages", "to years", standardize.age_stats(df, tags["age"], unit)
                     .select(F.lit(tags["age"]).alias("column_name"), F.col("parsed_count").alias("affected"))))
        df = standardize.clean_ages(df, tags["age"], unit, cfg.age_breaks, cfg.age_labels, cfg.age_groups)
    # several tables below read the cleaned rows: computed once
    df = df.checkpoint()
    if cfg.harmonize_facilities and "health_facility" in tags:
        df = harmonize_facilities(df, tags["health_facility"], threshold=cfg.facility_threshold).checkpoint()

    issues = _issues(df, tags, cfg).checkpoint()
    tables["issues"] = issues
    tables["issue_counts"] = validate.issue_counts(issues)
    members = None
    if cfg.detect_duplicates:
        members = dedup.find_duplicates(df, tags, cfg.dedup_method, cfg.fuzzy_threshold).checkpoint()
        tables["duplicate_members"] = members
        tables["duplicate_groups"] = dedup.duplicate_groups(members)
        tables["duplicate_keys"] = dedup.match_keys(members)
        df = dedup.resolve_duplicates(df, members, cfg.dedup_action)
        if cfg.dedup_action != "flag":              # resolved groups no longer count as duplicates
            members = members.join(df.select("row_id"), "row_id")
    if cfg.anonymize:
        df = privacy.anonymize(df, tags, cfg.anonymize_method, cfg.anonymize_tags, cfg.hash_salt)

    profiled = [c for c in df.columns if c not in ("row_id", "is_duplicate", "duplicate_group_id")]
    tables["quality_after"] = quality.quality_scores(df, tags, issues, members)
    tables["column_profile"] = quality.column_profile(df, tags, issues, profiled)
    if "quality_before" in tables:
        tables["quality_delta"] = quality.quality_delta(tables["quality_before"], tables["quality_after"])
    if cfg.detect_alerts and "epi_week" in df.columns:
        counts = surveillance.weekly_counts(df)
        tables["weekly"] = surveillance.weekly_share(df)
        tables["alerts"] = surveillance.weekly_alerts(counts, multiplier=cfg.alert_multiplier)
        tables["trend"] = surveillance.incidence_trend(counts)
        tables["kpis"] = sinks.kpi_table(df, tables["quality_after"], tables["trend"], tables["alerts"],
                                         lat if lat else "geo_lat", lon if lon else "geo_lon", tags.get("phone"))
    tables["renamed"] = spark.createDataFrame(pairs, "old_name string, new_name string")
    if logs:
        tables["run_log"] = _run_log(logs)
    return Bundle(df, tags, tables)


def _run_log(logs: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``(step_no, step, action, column_name, affected)``."""
    out = None
    for i, (step, action, rows) in enumerate(logs, 1):
        part = rows.select(F.lit(i).alias("step_no"), F.lit(step).alias("step"), F.lit(action).alias("action"),
                           "column_name", F.col("affected").cast("bigint").alias("affected"))
        out = part if out is None else out.unionByName(part)
    return out


def report_tables(bundle: Bundle) -> dict[str, DataFrame]:
    """The six tables of the audit report, whole."""
    t = bundle.tables
    out = {"cases": bundle.cases, "issues": validate.top_issues(t["issues"]), "data_dictionary": t["column_profile"]}
    if "duplicate_groups" in t:
        out["duplicates"] = t["duplicate_groups"].orderBy("group_id")
    for name in ("kpis", "gazetteer", "weekly"):
        if name in t:
            out[name] = t[name]
    if "alerts" in t:
        out["alerts"] = t["alerts"].orderBy("week")
    out["tag_legend"] = quality.tag_legend(bundle.cases.sparkSession)
    return out


def validate_only(df: DataFrame, cfg: CleaningConfig = CleaningConfig()) -> Bundle:
    """Bind, check, look for duplicates, score and profile the list as it is."""
    df, tags, bound, _ = bind(df, cfg)
    issues = _issues(df, tags, cfg)
    members = dedup.find_duplicates(df, tags, cfg.dedup_method, cfg.fuzzy_threshold)
    return Bundle(df, tags, {
        "bindings": binding.bindings_table(df.sparkSession, bound), "issues": issues,
        "issue_counts": validate.issue_counts(issues), "duplicate_groups": dedup.duplicate_groups(members),
        "quality": quality.quality_scores(df, tags, issues, members),
        "column_profile": quality.column_profile(df, tags, issues)})


def audit(df: DataFrame, cfg: CleaningConfig = CleaningConfig()) -> dict[str, DataFrame]:
    """Clean without a gazetteer and return the report tables."""
    return report_tables(clean(df, None, cfg))


def geocode_only(df: DataFrame, gazetteer: DataFrame, cfg: CleaningConfig = CleaningConfig()) -> Bundle:
    """Bind and geocode."""
    df, tags, _, _ = bind(df, cfg)
    content = [c for c in df.columns if c != "row_id"]
    roles = binding.gazetteer_roles([c for c in gazetteer.columns if c != "ref_row"], cfg.gazetteer_mapping)
    df = standardize.null_missing(df, extra=cfg.extra_missing_tokens) if cfg.standardize_missing else df
    out = geocode.geocode(df, geocode.gazetteer_index(gazetteer, roles), binding.place_columns(content, tags),
                          cfg.geocode_threshold)
    return Bundle(out, tags, {"geocode_summary": geocode.geocode_summary(out)})


def profile(df: DataFrame, cfg: CleaningConfig = CleaningConfig()) -> DataFrame:
    df, tags, _, _ = bind(df, cfg)
    return quality.column_profile(df, tags)


def inspect(df: DataFrame, cfg: CleaningConfig = CleaningConfig()) -> DataFrame:
    df, tags, _, _ = bind(df, cfg)
    return quality.inspect_columns(df, tags)


def analyse(df: DataFrame, tags: dict[str, str], cfg: CleaningConfig = CleaningConfig()) -> dict[str, DataFrame]:
    """All indicators of a cleaned list."""
    out = {"indicators": analytics.case_indicators(df, tags), "delays": analytics.delay_stats(df, tags),
           "delay_histogram": analytics.delay_histogram(df, tags)}
    date = analytics.curve_column(df, tags)
    if date:
        for unit in analytics.PERIODS:
            out[f"curve_{unit}"] = analytics.epi_curve(df, date, unit)
        for tag in ("case_definition", "outcome", "sex"):
            if tags.get(tag) in df.columns:
                out[f"curve_week_by_{tag}"] = analytics.epi_curve(df, date, "week", tags[tag])
        counts = analytics.epi_curve(df, date, "week").select(F.col("period").alias("week"), "cases")
        out["growth"] = surveillance.incidence_trend(counts)
    if tags.get("age") in df.columns:
        out["ages"] = analytics.age_stats(df, tags["age"])
        out["pyramid"] = analytics.pyramid(df, tags, cfg.age_breaks, cfg.age_labels)
    out["cfr_by_sex"] = analytics.cfr_by_sex(df, tags)
    if "age_group" in df.columns:
        out["cfr_by_age_group"] = analytics.cfr_by_age_group(df, tags)
    return out


def compare(raw: DataFrame, cleaned: DataFrame, rows: int = 50) -> dict[str, object]:
    """Columns the cleaning added, and the first rows of both lists."""
    return {"added_columns": [c for c in cleaned.columns if c not in raw.columns],
            "raw": sinks.preview(raw, rows), "cleaned": sinks.preview(cleaned, rows)}
