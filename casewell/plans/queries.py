"""The registered queries: every operator over the derived case list or the raw tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewell.functions import ages, categories, dates, phones, places, privacy as private, text
from casewell.functions.text import round_half_up
from casewell.operators import (
    analytics, dedup, facility, geocode, privacy, quality, standardize, surveillance, validate,
)
from casewell.plans.casebook import _MOIS, AS_OF, CASE_COLUMNS, gazetteer, raw_cases
from casewell.settings import ensure_checkpoint_dir, keep
from casewell.sources import sinks, tabular

DATE_COLUMNS = ("date_birth", "date_onset", "date_report", "date_consultation", "date_admission", "date_discharge",
                "date_sample_collected", "date_lab_result", "date_death")
DAY_FIRST = {c: c != "date_report" for c in DATE_COLUMNS}
PLACES = {"Locality": "locality", "Admin3_Ward": "admin3", "Admin2_LGA": "admin2", "Admin1_State": "admin1"}
TAGS = {t: t for t in (
    "case_id", "full_name", "sex", "age", "age_unit", "date_birth", "date_onset", "date_consultation",
    "date_admission", "date_discharge", "date_sample_collected", "date_lab_result", "date_death", "outcome",
    "case_definition", "hospitalized", "pregnant", "phone", "health_facility", "admin1", "admin2", "admin3")}
SALT = "field-office"
_JOURS = ("dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi")
CONTENT = CASE_COLUMNS[1:]


def cleaned_cases(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The case list after all row-local cleaning (or just the named columns of it)."""
    wanted = set(columns or TAGS) | ({"age_unit"} if "age" in columns else set())
    df = raw_cases(spark, d)
    if columns:
        df = df.select("row_id", *[c for c in df.columns if c in wanted])
    df = standardize.clean_dates(df, {c: first for c, first in DAY_FIRST.items() if c in df.columns})
    if "age" in df.columns:
        df = standardize.clean_ages(df, "age", "age_unit")
    fixed = {
        "sex": categories.standardize_sex, "case_definition": categories.standardize_case_definition,
        "outcome": categories.standardize_outcome, "hospitalized": categories.standardize_binary,
        "pregnant": categories.standardize_binary, "phone": phones.clean_phone,
    }
    df = df.select(*[fixed[c](F.col(c)).alias(c) if c in fixed else F.col(c) for c in df.columns])
    return standardize.clean_coordinates(df, "lat", "lon") if "lat" in df.columns else df


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_type", dates.epi_week(F.col("ts").cast("date")).alias("epi_week"))


def _column(make, column: str, name: str):
    return lambda s, d: raw_cases(s, d).select("row_id", make(F.col(column)).alias(name))


def rare_dates(s, d):
    """Consultation dates written in rare ways: no year, the time first, with a weekday."""
    iso = F.col("date_consultation")
    day, month, year = (F.split(iso, "-")[k].cast("int") for k in (2, 1, 0))
    spelled = F.concat_ws(" ", day.cast("string"), F.element_at(F.array(*map(F.lit, _MOIS)), month))
    weekday = F.element_at(F.array(*map(F.lit, _JOURS)), F.dayofweek(iso.cast("date")))
    written = (F.when(F.col("row_id") % 3 == 0, spelled).when(F.col("row_id") % 3 == 1, F.concat(F.lit("10:30 "), iso))
               .otherwise(F.concat_ws(" ", weekday, spelled, year.cast("string"))))
    rows = raw_cases(s, d).select("row_id", written.alias("date_consultation"))
    return standardize.clean_dates(rows, {"date_consultation": True}, rare=True)


def _scratch(s, what):
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def csv_cases(s, d):
    """Names and notes with quotes and line breaks, written as delimited text and read back."""
    path = _scratch(s, "csv")
    note = F.concat(F.col("full_name"), F.lit('\n"'), F.coalesce("case_id", F.lit("none")), F.lit('", end'))
    rows = raw_cases(s, d).select(F.col("row_id").alias("case_row"), "full_name", note.alias("note"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = tabular.load_cases(s, f"{path}/*.csv", multiline=True)
    return back.select(F.col("case_row").cast("bigint").alias("case_row"), "full_name", "note")


def json_cases(s, d):
    """Names and nested dates, written as JSON and read back."""
    path = _scratch(s, "json")
    rows = raw_cases(s, d).select(F.col("row_id").alias("case_row"), F.concat(F.lit("} {["), F.col("full_name"), F.lit('"\\')).alias("label"),
                                  F.struct("date_birth", F.array("sex", "age").alias("pair")).alias("deep"))
    rows.write.json(path)
    back = tabular.read_json(s, f"{path}/*.json")
    return back.select(F.col("case_row").cast("bigint").alias("case_row"), "label", F.col("deep.date_birth").alias("date_birth"),
                       F.col("deep.pair")[0].alias("sex"), F.col("deep.pair")[1].alias("age"))


def excel_serial_dates(s, d):
    c = F.col("date_onset")
    return (raw_cases(s, d).where(dates.is_serial_date(c))
            .select("row_id", dates.serial_to_date(c).alias("serial_date")))


def epi_week_columns(s, d):
    rows = raw_cases(s, d).select("row_id", dates.parse_date(F.col("date_onset")).alias("onset"))
    return standardize.add_epi_week(rows, "onset").select("row_id", "onset", "epi_week", "epi_week_num", "epi_year")


def weekly_counts_share(s, d):
    rows = raw_cases(s, d).select(dates.epi_week(dates.parse_date(F.col("date_onset"))).alias("epi_week"))
    return surveillance.weekly_share(rows)


def age_from_birth(s, d):
    p = lambda c: dates.parse_date(F.col(c))
    return raw_cases(s, d).select("row_id", ages.age_from_birth(p("date_birth"), p("date_onset")).alias("age_at_onset"))


def age_bands(s, d):
    y = ages.parse_age_with_unit(F.col("age"), F.col("age_unit"))
    return (raw_cases(s, d).select(ages.age_band(y).alias("age_group"))
            .groupBy("age_group").agg(F.count("*").alias("cases")))


def _binary(s, d):
    return raw_cases(s, d).select("row_id", categories.standardize_binary(F.col("hospitalized")).alias("hospitalized"),
                                  categories.standardize_binary(F.col("pregnant")).alias("pregnant"))


def clean_coordinates(s, d):
    df = raw_cases(s, d).select("row_id", "lat", "lon")
    point = df.select("row_id", places.coordinate_pair(F.col("lat"), F.col("lon")).alias("p"))
    return point.select("row_id", "p.lat", "p.lon", F.col("p.swapped").cast("int").alias("swapped"))


def valid_points(s, d):
    df = standardize.clean_coordinates(raw_cases(s, d).select("row_id", "lat", "lon"), "lat", "lon")
    return df.where(places.is_valid_point(F.col("lat"), F.col("lon"))).select("row_id", "lat", "lon")


def pseudonymise(s, d):
    df = raw_cases(s, d).select("row_id", "full_name", "phone")
    return privacy.anonymize(df, TAGS)


def drop_pii(s, d):
    return privacy.anonymize(raw_cases(s, d), TAGS, "drop")


def strip_accents_documents(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    plain = text.strip_accents(F.lower("text"))
    return docs.select("doc_id", F.md5(plain).alias("plain_md5"), F.length(plain).cast("bigint").alias("plain_chars"))


def documents_missing(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("text", "lang", "source")
    return standardize.missing_counts(docs)


def normalise_places(s, d):
    df = raw_cases(s, d)
    return df.select("row_id", *[text.place_name(F.col(c)).alias(f"{c}_norm") for c in ("admin2", "admin3", "locality")])


def facility_titles(s, d):
    df = raw_cases(s, d).where(text.not_blank(F.col("health_facility")))
    return (df.select(text.title_case(F.trim("health_facility")).alias("facility"))
            .groupBy("facility").agg(F.count("*").alias("cases")))


def search_any_column(s, d):
    return standardize.search_any_column(raw_cases(s, d), "amina")


CHECKED = ("case_id", "sex", "age", "pregnant", "outcome", "hospitalized", *(c for c in DATE_COLUMNS if c != "date_report"))


def _issues(s, d, df=None):
    return validate.find_issues(df if df is not None else cleaned_cases(s, d, *CHECKED), TAGS, as_of=AS_OF)


def validation_issues(s, d):
    return _issues(s, d).drop("suggested_action")


def issues_before_outbreak(s, d):
    found = validate.find_issues(cleaned_cases(s, d, *CHECKED), TAGS, as_of=None, outbreak_start="1996-01-01",
                                 demographics=False, clinical=False)
    return found.groupBy("rule_no", "severity").agg(F.count("*").alias("cnt"))


def raw_age_issues(s, d):
    """The age rule on ages as entered, where it can still see impossible values."""
    found = validate.find_issues(raw_cases(s, d), {"case_id": "case_id", "age": "age"}, chronology=False, clinical=False)
    return found.where(F.col("rule_no") == 14).select("row_id", "severity", "raw_value")


def issues_top(s, d):
    return validate.top_issues(_issues(s, d)).select("row_id", "rule_no", "severity", "column_name")


def gazetteer_index(s, d):
    return geocode.gazetteer_index(gazetteer(s, d))


def _places_only(s, d):
    return raw_cases(s, d).select("row_id", *PLACES.values())


def geocode_exact(s, d):
    return geocode.geocode_exact(_places_only(s, d), gazetteer_index(s, d), PLACES).select("row_id", *geocode.OUTPUT)


def geocode_fuzzy(s, d):
    """Every distinct place name with its match."""
    probes = geocode._probe_names(_places_only(s, d), PLACES)
    found = geocode.match_names(probes, gazetteer_index(s, d))
    return found.select("level", "norm", "pcode", round_half_up(F.col("score"), 1).alias("score"))


def geocode_cascade(s, d):
    out = geocode.geocode(_places_only(s, d), gazetteer_index(s, d), PLACES)
    return out.select("row_id", *geocode.OUTPUT).withColumn("match_score", round_half_up(F.col("match_score"), 1))


def _nested(s, d, exact):
    rows = keep(_places_only(s, d))     # read for the names and for the result
    out = geocode.geocode_nested(rows, geocode.nested_index(gazetteer(s, d)), PLACES, exact=exact)
    return out.select("row_id", *geocode.OUTPUT).withColumn("match_score", round_half_up(F.col("match_score"), 1))


def geocode_summary(s, d):
    return geocode.geocode_summary(geocode.geocode(_places_only(s, d), gazetteer_index(s, d), PLACES))


def level_filter(s, d):
    exact = geocode.geocode_exact(_places_only(s, d), gazetteer_index(s, d), PLACES)
    return standardize.level_filter(exact, "Admin2_LGA").select("row_id", "pcode_assigned", "match_level")


def _exact_members(s, d):
    return dedup.find_duplicates(raw_cases(s, d), TAGS, "exact")


def exact_duplicates(s, d):
    return dedup.exact_duplicates(raw_cases(s, d)).select("row_id", "group_id")


def duplicate_ids(s, d):
    rows = raw_cases(s, d)
    return dedup.duplicate_ids(rows, dedup.exact_duplicates(rows)).select("row_id", "group_id", "case_id")


def duplicate_groups(s, d):
    groups = dedup.duplicate_groups(_exact_members(s, d))
    return groups.select("group_id", "duplicate_type", "size", "recommended_keep", "matching_id")


def _deduplicated(s, d, action):
    rows = keep(raw_cases(s, d))        # read by both searches and by the removal
    return dedup.resolve_duplicates(rows, dedup.find_duplicates(rows, TAGS, "exact"), action)


def _resolved(action):
    return lambda s, d: _deduplicated(s, d, action)


def dedup_flag(s, d):
    flagged = _deduplicated(s, d, "flag")
    return flagged.select("row_id", F.col("is_duplicate").cast("int").alias("is_duplicate"), "duplicate_group_id")


def _read_once(rows, name, make, *columns):
    """Adds ``name``, which ``make`` computes once for each distinct combination of ``columns`` (missing values are one of them)."""
    keys = [f"{name}_of_{c}" for c in columns]
    values = rows.select(*[F.col(c).alias(k) for c, k in zip(columns, keys)]).distinct()
    known = keep(values.withColumn(name, make(*[F.col(k) for k in keys])))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(columns, keys)])
    return rows.join(known, same, "left").drop(*keys)


def _person_rows(s, d):
    rows = keep(raw_cases(s, d).select(         # read for the distinct values, then for the rows
        "row_id", "full_name", *[F.col(c).alias(f"raw_{c}") for c in ("sex", "age", "age_unit", "date_onset")]))
    rows = _read_once(rows, "sex", categories.standardize_sex, "raw_sex")
    rows = _read_once(rows, "age", ages.parse_age_with_unit, "raw_age", "raw_age_unit")
    rows = _read_once(rows, "date_onset", dates.parse_date, "raw_date_onset")
    return rows.select("row_id", "full_name", "sex", "age", "date_onset")


def fuzzy_duplicates(s, d):
    return dedup.fuzzy_duplicates(_person_rows(s, d)).drop("own_score")


def facility_clusters(s, d):
    found = facility.facility_clusters(raw_cases(s, d).select("row_id", "health_facility"), "health_facility")
    return found.select("name", "canonical", "cnt", round_half_up(F.col("score"), 1).alias("score"))


def facility_harmonised(s, d):
    rows = facility.harmonize_facilities(raw_cases(s, d).select("row_id", "health_facility"), "health_facility")
    return rows.groupBy("health_facility").agg(F.count("*").alias("cases"))


def quality_scores(s, d):
    df = cleaned_cases(s, d, *CHECKED, "case_definition")
    return quality.quality_scores(df, TAGS, _issues(s, d, df), _exact_members(s, d))


def column_profile(s, d):
    return quality.column_summary(raw_cases(s, d), TAGS, CONTENT).drop("position")


def column_profile_full(s, d):
    df = keep(cleaned_cases(s, d))
    return quality.column_profile(df, TAGS, _issues(s, d, df))


def inspect_columns(s, d):
    return quality.inspect_columns(raw_cases(s, d), TAGS, CONTENT)


def profile_issue_counts(s, d):
    return _issues(s, d).groupBy("column_name").agg(F.count("*").alias("issue_count"))


def epi_curve_wide(s, d):
    return analytics.epi_curve_wide(cleaned_cases(s, d, "date_onset", "case_definition"), "date_onset", "month", "case_definition",
                                    ("Confirmed", "Probable", "Suspect", "Discarded", "Unknown"))


def epi_curve_wide_observed(s, d):
    """Monthly curve with a column for every sex that occurs."""
    return analytics.epi_curve_wide(cleaned_cases(s, d, "date_onset", "sex"), "date_onset", "month", "sex")


def weekly_alerts_cases(s, d):
    counts = surveillance.weekly_counts(standardize.add_epi_week(cleaned_cases(s, d, "date_onset"), "date_onset"))
    return surveillance.weekly_alerts(counts, multiplier=1.1)


def weekly_alerts_regions(s, d):
    counts = surveillance.weekly_counts(standardize.add_epi_week(cleaned_cases(s, d, "date_onset", "admin1"), "date_onset"), by=["admin1"])
    return surveillance.weekly_alerts(counts, by=["admin1"])


def _event_counts(s, d):
    return surveillance.weekly_counts(_events(s, d), by=["event_type"])


def weekly_alerts_events(s, d):
    return surveillance.weekly_alerts(_event_counts(s, d), by=["event_type"], multiplier=1.1)


def incidence_trend(s, d):
    return surveillance.incidence_trend(_event_counts(s, d), by=["event_type"]).drop("doubling_weeks")


def doubling_time(s, d):
    case_counts = surveillance.weekly_counts(standardize.add_epi_week(cleaned_cases(s, d, "date_onset", "admin1"), "date_onset"), by=["admin1"])
    trend = surveillance.incidence_trend(case_counts, by=["admin1"], drop_last=True)
    return trend.select("admin1", "weekly_growth_pct", "doubling_weeks")


def filled_weeks(s, d):
    counts = surveillance.weekly_counts(standardize.add_epi_week(cleaned_cases(s, d, "date_onset", "admin1"), "date_onset"), by=["admin1"])
    return surveillance.fill_weeks(counts, ["admin1"])


def geojson_features(s, d):
    df = geocode.geocode_exact(raw_cases(s, d), gazetteer_index(s, d), PLACES)
    return sinks.geojson_features(df, "geo_lat", "geo_lon")


def geojson_fields(s, d):
    """The features' fields read back out of the JSON."""
    shape = ("struct<type: string, geometry: struct<type: string, coordinates: array<double>>, properties: struct<row_id: bigint, "
             + ", ".join(f"{c}: string" for c in CONTENT) + ", _pcode: string, _match_level: string>>")
    f = geojson_features(s, d).select(F.from_json("value", shape).alias("f")).select("f.*")
    return f.select(F.col("type").alias("kind"), F.col("geometry.type").alias("shape"), F.col("geometry.coordinates")[0].alias("x"),
                    F.col("geometry.coordinates")[1].alias("y"), "properties.*")


def map_points(s, d):
    rows = standardize.add_epi_week(cleaned_cases(s, d), "date_onset")
    return sinks.map_points(geocode.geocode_exact(rows.drop("geo_lat", "geo_lon"), gazetteer_index(s, d), PLACES))


def kpi_table(s, d):
    rows = keep(standardize.add_epi_week(cleaned_cases(s, d), "date_onset"))
    coded = geocode.geocode_exact(rows.drop("geo_lat", "geo_lon"), gazetteer_index(s, d), PLACES)
    members = _exact_members(s, d)
    scores = quality.quality_scores(rows, TAGS, _issues(s, d, rows), members)
    counts = surveillance.weekly_counts(rows)
    return sinks.kpi_table(coded, scores, surveillance.incidence_trend(counts), surveillance.weekly_alerts(counts),
                           lat="lat", lon="lon", phone="phone")


def flagship(s, d):
    """Geocoded cases per week and level, with the alert weeks marked."""
    rows = raw_cases(s, d)
    coded = geocode.geocode(rows, gazetteer_index(s, d), PLACES)
    weekly = standardize.add_epi_week(
        coded.withColumn("onset", dates.parse_date(F.col("date_onset"))), "onset")
    counts = surveillance.weekly_counts(weekly, by=["match_level"])
    alerts = surveillance.weekly_alerts(counts, by=["match_level"]).select("match_level", "week", "severity")
    return counts.join(alerts, ["match_level", "week"], "left")


_A = analytics
DELAY_DATES = ("date_onset", "date_consultation", "date_admission", "date_discharge", "date_death")
_on_clean = lambda fn, *columns: (lambda s, d: fn(cleaned_cases(s, d, *columns)))

QUERIES = {
    "null_tokens": lambda s, d: standardize.missing_counts(raw_cases(s, d)),
    "null_tokens_documents": documents_missing,
    "excel_serial_dates": excel_serial_dates,
    "parse_mixed_dates": _column(dates.parse_date, "date_onset", "onset"),
    "rare_dates": rare_dates,
    "csv_cases": csv_cases,
    "json_cases": json_cases,
    "normalise_date_text": _column(dates.normalize_date_text, "date_onset", "onset_text"),
    "day_first_vote": lambda s, d: standardize.day_first_votes(raw_cases(s, d), list(DATE_COLUMNS)),
    "date_column_stats": lambda s, d: standardize.date_stats(raw_cases(s, d), DAY_FIRST),
    "epi_week_columns": epi_week_columns,
    "weekly_counts_share": weekly_counts_share,
    "age_years": _column(ages.parse_age, "age", "age_years"),
    "age_with_unit": lambda s, d: raw_cases(s, d).select(
        "row_id", ages.parse_age_with_unit(F.col("age"), F.col("age_unit")).alias("age_years")),
    "age_from_birth": age_from_birth,
    "age_bands": age_bands,
    "age_column_stats": lambda s, d: standardize.age_stats(raw_cases(s, d), "age", "age_unit"),
    "std_sex": _column(categories.standardize_sex, "sex", "sex_std"),
    "std_case_class": _column(categories.standardize_case_definition, "case_definition", "case_class"),
    "std_outcome": _column(categories.standardize_outcome, "outcome", "outcome_std"),
    "std_binary": _binary,
    "clean_coordinates": clean_coordinates,
    "coordinate_stats": lambda s, d: standardize.coordinate_stats(raw_cases(s, d), "lat", "lon"),
    "clean_phones": _column(phones.clean_phone, "phone", "phone_std"),
    "phone_stats": lambda s, d: standardize.phone_stats(raw_cases(s, d), "phone"),
    "mask_names": _column(private.mask_words, "full_name", "masked"),
    "hash_names": _column(lambda c: private.salted_hash(c, SALT), "full_name", "hashed"),
    "pseudonymise": pseudonymise,
    "drop_pii": drop_pii,
    "normalise_places": normalise_places,
    "strip_accents_documents": strip_accents_documents,
    "facility_titles": facility_titles,
    "valid_points": valid_points,
    "search_any_column": search_any_column,
    "level_filter": level_filter,
    "validation_issues": validation_issues,
    "raw_age_issues": raw_age_issues,
    "issues_before_outbreak": issues_before_outbreak,
    "issues_by_severity_type": lambda s, d: validate.issue_counts(_issues(s, d)),
    "issues_top": issues_top,
    "gazetteer_index": gazetteer_index,
    "geocode_exact": geocode_exact,
    "geocode_fuzzy": geocode_fuzzy,
    "geocode_cascade": geocode_cascade,
    "geocode_nested": lambda s, d: _nested(s, d, exact=False),
    "geocode_nested_exact": lambda s, d: _nested(s, d, exact=True),
    "geocode_summary": geocode_summary,
    "exact_duplicates": exact_duplicates,
    "duplicate_ids": duplicate_ids,
    "duplicate_groups": duplicate_groups,
    "duplicate_keys": lambda s, d: dedup.match_keys(_exact_members(s, d)),
    "dedup_flag": dedup_flag,
    "dedup_keep_first": _resolved("keep_first"),
    "dedup_keep_last": _resolved("keep_last"),
    "dedup_most_complete": _resolved("keep_most_complete"),
    "dedup_merge": _resolved("merge"),
    "fuzzy_duplicates": fuzzy_duplicates,
    "facility_clusters": facility_clusters,
    "facility_harmonised": facility_harmonised,
    "quality_scores": quality_scores,
    "column_profile": column_profile,
    "column_profile_full": column_profile_full,
    "top_values": lambda s, d: quality.top_values(raw_cases(s, d), CONTENT),
    "sample_values": lambda s, d: quality.sample_values(raw_cases(s, d), CONTENT),
    "inspect_columns": inspect_columns,
    "profile_issue_counts": profile_issue_counts,
    "case_indicators": _on_clean(lambda df: _A.case_indicators(df, TAGS), "sex", "outcome", "case_definition", "hospitalized"),
    "age_stats": _on_clean(lambda df: _A.age_stats(df, "age"), "age"),
    "epi_curve_day": _on_clean(lambda df: _A.epi_curve(df, "date_onset", "day"), "date_onset"),
    "epi_curve_week": _on_clean(lambda df: _A.epi_curve(df, "date_onset", "week"), "date_onset"),
    "epi_curve_month": _on_clean(lambda df: _A.epi_curve(df, "date_onset", "month"), "date_onset"),
    "epi_curve_stratified": _on_clean(lambda df: _A.epi_curve(df, "date_onset", "week", "outcome"), "date_onset", "outcome"),
    "epi_curve_wide": epi_curve_wide,
    "epi_curve_wide_observed": epi_curve_wide_observed,
    "delay_stats": _on_clean(lambda df: _A.delay_stats(df, TAGS), *DELAY_DATES),
    "delay_histogram": _on_clean(lambda df: _A.delay_histogram(df, TAGS), *DELAY_DATES),
    "cfr_by_sex": _on_clean(lambda df: _A.cfr_by_sex(df, TAGS), "sex", "outcome"),
    "cfr_by_age": _on_clean(lambda df: _A.cfr_by_age_group(df, TAGS), "age", "outcome"),
    "pyramid": _on_clean(lambda df: _A.pyramid(df, TAGS), "age", "sex"),
    "weekly_alerts_cases": weekly_alerts_cases,
    "weekly_alerts_regions": weekly_alerts_regions,
    "weekly_alerts_events": weekly_alerts_events,
    "incidence_trend": incidence_trend,
    "doubling_time": doubling_time,
    "filled_weeks": filled_weeks,
    "geojson_features": geojson_features,
    "geojson_fields": geojson_fields,
    "map_points": map_points,
    "kpi_table": kpi_table,
    "flagship": flagship,
}
