"""Chronology, demographic and clinical checks: every rule in one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from casewell.functions.dates import as_date
from casewell.functions.text import not_blank

CHRONOLOGY, STATUS, AGE, MANDATORY = "DATE_CHRONOLOGY", "INCONSISTENT_STATUS", "INVALID_AGE", "MISSING_MANDATORY"
DATE_TAGS = ("date_birth", "date_onset", "date_consultation", "date_admission", "date_discharge", "date_death",
             "date_sample_collected", "date_lab_result")

# (rule, earlier date, later date, tag the issue is filed under, severity)
SEQUENCE_RULES = (
    (2, "date_birth", "date_onset", "date_onset", "ERROR"),
    (3, "date_onset", "date_consultation", "date_consultation", "ERROR"),
    (4, "date_onset", "date_admission", "date_admission", "ERROR"),
    (5, "date_consultation", "date_admission", "date_admission", "WARNING"),
    (6, "date_admission", "date_discharge", "date_discharge", "ERROR"),
    (7, "date_onset", "date_death", "date_death", "ERROR"),
    (8, "date_admission", "date_death", "date_death", "ERROR"),
    (9, "date_sample_collected", "date_lab_result", "date_lab_result", "ERROR"),
)
FUTURE_RULES = ((10, "date_onset"), (11, "date_consultation"), (12, "date_admission"), (13, "date_death"))
SEVERITY_ORDER = ("ERROR", "WARNING", "INFO")


@dataclass(frozen=True)
class Rule:
    number: int
    tag: str
    kind: str
    severity: str
    broken: Column
    raw: Column
    message: Column
    action: str


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _rules(tags: dict[str, str], as_of: str | None, outbreak_start: str | None,
           chronology: bool, demographics: bool, clinical: bool) -> list[Rule]:
    bound = lambda *names: all(n in tags for n in names)
    day = lambda tag: F.col(f"_{tag}")
    status = lambda tag: F.initcap(F.trim(F.col(tags[tag]).cast("string")))
    rules: list[Rule] = []
    if bound("case_id"):
        rules.append(Rule(1, "case_id", MANDATORY, "ERROR", ~not_blank(F.col(tags["case_id"])), F.lit(None),
                          F.lit("case identifier is missing"), "assign an identifier"))
    if chronology:
        for number, first, second, tag, severity in SEQUENCE_RULES:
            if bound(first, second):
                rules.append(Rule(number, tag, CHRONOLOGY, severity, day(first) > day(second), day(tag),
                                  _text(f"{second} ", day(second), f" is before {first} ", day(first)),
                                  "check both dates"))
        for number, tag in FUTURE_RULES:
            if bound(tag) and as_of:
                rules.append(Rule(number, tag, CHRONOLOGY, "ERROR", day(tag) > F.lit(as_of).cast("date"), day(tag),
                                  _text(f"{tag} ", day(tag), f" is after {as_of}"), "check the year"))
        if bound("date_onset") and outbreak_start:
            rules.append(Rule(18, "date_onset", CHRONOLOGY, "WARNING",
                              day("date_onset") < F.lit(outbreak_start).cast("date"), day("date_onset"),
                              _text("date_onset ", day("date_onset"), f" is before the outbreak start {outbreak_start}"),
                              "check the year"))
    if demographics:
        if bound("age"):
            age = F.col(tags["age"]).try_cast("double")
            rules.append(Rule(14, "age", AGE, "ERROR", age < 0, age, _text("age is negative: ", age), "check the age"))
            rules.append(Rule(14, "age", AGE, "WARNING", age > 120, age, _text("age is above 120: ", age),
                              "check the unit"))
        if bound("pregnant", "sex"):
            rules.append(Rule(15, "pregnant", STATUS, "ERROR",
                              (status("pregnant") == "Yes") & (status("sex") == "Male"),
                              F.lit("Pregnant=Yes, Sex=Male"), F.lit("pregnant male"), "check sex and pregnancy"))
    if clinical:
        if bound("outcome", "date_death"):
            out = status("outcome")
            rules.append(Rule(16, "date_death", STATUS, "WARNING", (out == "Dead") & day("date_death").isNull(), out,
                              F.lit("outcome is Dead without a date of death"), "record the date of death"))
            rules.append(Rule(16, "outcome", STATUS, "ERROR",
                              out.isin("Recovered", "Discharged", "Alive") & day("date_death").isNotNull(),
                              _text("Outcome=", out, ", DateDeath=", day("date_death")),
                              _text("outcome is ", out, " with a date of death ", day("date_death")),
                              "check the outcome"))
        if bound("hospitalized", "date_admission"):
            rules.append(Rule(17, "hospitalized", STATUS, "WARNING",
                              (status("hospitalized") == "No") & day("date_admission").isNotNull(),
                              _text("Hospitalized=No, DateAdmission=", day("date_admission")),
                              _text("not hospitalized but admitted on ", day("date_admission")),
                              "check the hospitalized field"))
    return rules


def find_issues(
    df: DataFrame,
    tags: dict[str, str],
    as_of: str | None = None,
    outbreak_start: str | None = None,
    chronology: bool = True,
    demographics: bool = True,
    clinical: bool = True,
) -> DataFrame:
    """``(row_id, case_id, rule_no, column_name, issue_type, severity, message, raw_value, suggested_action)``.

    ``tags`` binds canonical tags to columns.  Dates may be dates or text starting
    with an ISO date; anything else is ignored by the date rules.
    """
    tags = {t: c for t, c in tags.items() if c in df.columns}
    types = dict(df.dtypes)
    dates = [as_date(F.col(tags[t]), types[tags[t]]).alias(f"_{t}") for t in DATE_TAGS if t in tags]
    needed = list(dict.fromkeys(["row_id", *tags.values()]))
    rows = df.select(*needed, *dates)
    case_id = F.col(tags["case_id"]).cast("string") if "case_id" in tags else F.lit(None).cast("string")
    who = F.coalesce(F.when(not_blank(case_id), case_id), F.concat(F.lit("Row "), F.col("row_id").cast("string")))
    issues = [
        F.when(r.broken, F.struct(
            (F.lit(None).cast("string") if r.number == 1 else who).alias("case_id"),
            F.lit(r.number).alias("rule_no"), F.lit(tags[r.tag]).alias("column_name"),
            F.lit(r.kind).alias("issue_type"), F.lit(r.severity).alias("severity"),
            r.message.alias("message"), r.raw.cast("string").alias("raw_value"),
            F.lit(r.action).alias("suggested_action")))
        for r in _rules(tags, as_of, outbreak_start, chronology, demographics, clinical)
    ]
    return rows.select("row_id", F.inline(F.array_compact(F.array(*issues))))


def issue_counts(issues: DataFrame) -> DataFrame:
    """``(dimension, value, cnt)`` by severity (zeros shown) and by type, in one pass."""
    spark = issues.sparkSession
    counted = (issues.select(F.inline(F.array(
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("issue_type").alias("dimension"), F.col("issue_type").alias("value")))))
        .groupBy("dimension", "value").agg(F.count("*").alias("cnt")))
    zeros = spark.range(1).select(F.lit("severity").alias("dimension"),
                                  F.explode(F.array(*[F.lit(s) for s in SEVERITY_ORDER])).alias("value"),
                                  F.lit(0).cast("bigint").alias("cnt"))
    return counted.unionByName(zeros).groupBy("dimension", "value").agg(F.sum("cnt").alias("cnt"))


def top_issues(issues: DataFrame, limit: int | None = None) -> DataFrame:
    """The report's issue list: errors first, then row order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    ordered = issues.orderBy(rank, "row_id", "rule_no")
    return ordered if limit is None else ordered.limit(limit)
