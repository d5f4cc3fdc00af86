import json

import pytest
from pyspark.sql import functions as F

import casewell as cw
from casewell.operators import analytics, dedup, privacy, quality, standardize, surveillance, validate
from casewell.plans import binding
from casewell.sources import sinks, tabular
from casewell.streaming import weekly


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_headers():
    names = ["Prénom & Nom", "Date de Début (Symptômes)", "   age--years   ", "ID_Patient #1", ""]
    assert [n for _, n in binding.unique_identifiers(names)] == [
        "prenom_nom", "date_de_debut_symptomes", "age_years", "id_patient_1", "unnamed_column"]
    assert [n for _, n in binding.unique_identifiers(["Case ID", "Patient Name", "Case ID", "Age (yrs)"])] == [
        "case_id", "patient_name", "case_id_1", "age_yrs"]


def test_binding_of_field_list():
    columns = ["patient_id", "patient_name", "gender", "lga_district", "watery_diarrhea", "clinical_outcome",
               "date_admission_ctc", "ward_subdistrict"]
    got = {b.column: (b.tag, round(b.score, 3)) for b in binding.bind_columns(columns)}
    assert got == {"patient_id": ("case_id", 1.0), "patient_name": ("full_name", 1.0), "gender": ("sex", 1.0),
                   "lga_district": ("admin2", 0.8), "watery_diarrhea": ("diarrhea", 1.0), "clinical_outcome": ("outcome", 0.828),
                   "date_admission_ctc": ("date_admission", 0.875), "ward_subdistrict": (None, 0.0)}
    assert binding.best_tag("My Col", custom={"My Col": "sex"}) == ("sex", 1.0)


def test_roles():
    cols = ["Admin1_Name", "Admin1_Pcode", "Admin2_Name", "Admin2_Pcode", "Ward", "Admin3_Pcode", "Locality_Name",
            "Locality_Pcode", "Latitude", "Longitude"]
    roles = binding.gazetteer_roles(cols)
    assert roles["admin3_name"] == "Ward" and roles["lat"] == "Latitude" and len(roles) == 10
    assert binding.coordinate_columns(["id", "gps_lat", "gps_lon"]) == ("gps_lat", "gps_lon")


def test_presets():
    cfg = cw.CleaningConfig().with_preset("ebola", geocode_threshold=70.0)
    assert cfg.geocode_threshold == 70.0 and cw.CleaningConfig().with_preset("Measles").age_breaks[1] == 1


def test_rules(spark):
    rows = [(1, "C1", "2023-01-10", "2023-01-05", "2023-01-12", "2023-01-18", -5.0, "Male", "Yes", "Dead", None),
            (2, None, "2023-01-15", "2023-01-16", "2023-01-17", "2023-01-10", 145.0, "Female", "No", "Alive", "2023-01-20")]
    df = frame(spark, rows, "row_id bigint, case_id string, date_onset string, date_consultation string, date_admission string, "
               "date_discharge string, age double, sex string, pregnant string, outcome string, date_death string")
    tags = {c: c for c in df.columns[1:]}
    issues = validate.find_issues(df, tags, as_of="2023-01-19")
    assert {(r.row_id, r.rule_no, r.severity) for r in issues.collect()} == {
        (1, 3, "ERROR"), (1, 14, "ERROR"), (1, 15, "ERROR"), (1, 16, "WARNING"),
        (2, 1, "ERROR"), (2, 6, "ERROR"), (2, 13, "ERROR"), (2, 14, "WARNING"), (2, 16, "ERROR")}
    counts = {(r.dimension, r.value): r.cnt for r in validate.issue_counts(issues).collect()}
    assert counts[("severity", "ERROR")] == 7 and counts[("severity", "INFO")] == 0


def test_perfect_quality(spark):
    rows = [(i, f"C{i}", "Male", 10.0 * i, "2023-01-01", "Recovered", "Confirmed") for i in range(1, 5)]
    df = frame(spark, rows, "row_id bigint, case_id string, sex string, age double, date_onset string, outcome string, case_definition string")
    tags = {c: c for c in df.columns[1:]}
    assert tuple(quality.quality_scores(df, tags, None, None).first()) == (100.0, "A", 100.0, 100.0, 100.0, 100.0)
    profile = {r.column_name: r for r in quality.column_profile(df, tags).collect()}
    assert profile["sex"].top_values == {"Male": 4} and profile["case_id"].sample_values == ["C1", "C2", "C3", "C4"]
    empty = quality.quality_scores(df.limit(0), tags, None, None).first()
    assert empty.overall == 100.0 and empty.grade == "A"


def test_nulls_and_nested_cells_tell_rows_apart(spark):
    rows = [(1, "x", None, [1, None]), (2, None, "x", [1, None]), (3, "x", None, [None, 1]), (4, "x", None, [1, None])]
    df = frame(spark, rows, "row_id bigint, a string, b string, c array<int>")
    assert [(r.row_id, r.group_id) for r in dedup.exact_duplicates(df).orderBy("row_id").collect()] == [(1, 1), (4, 1)]


def test_exact_duplicates(spark):
    rows = [(1, "C1", "Alice", None), (2, "C2", "Bob", "x"), (3, "C1", "Alice", None), (4, "C2", "Rob", None), (5, "C3", "Eve", "y")]
    df = frame(spark, rows, "row_id bigint, case_id string, full_name string, note string")
    tags = {"case_id": "case_id", "full_name": "full_name"}
    members = dedup.find_duplicates(df, tags, "exact").checkpoint()
    assert {(r.row_id, r.group_id, r.duplicate_type) for r in members.collect()} == {
        (1, 1, "exact"), (3, 1, "exact"), (2, 2, "exact_id"), (4, 2, "exact_id")}
    kept = lambda action: {r.row_id for r in dedup.resolve_duplicates(df, members, action).collect()}
    assert kept("keep_first") == {1, 2, 5} and kept("keep_last") == {3, 4, 5} and kept("keep_most_complete") == {1, 2, 5}
    flagged = {r.row_id: (r.is_duplicate, r.duplicate_group_id) for r in dedup.resolve_duplicates(df, members, "flag").collect()}
    assert flagged[4] == (True, 2) and flagged[5] == (False, None)


def test_privacy(spark):
    df = frame(spark, [(1, "Bob", "1"), (2, "Al", "2"), (3, "Bob", "3")], "row_id bigint, full_name string, phone string")
    tags = {"full_name": "full_name", "phone": "phone"}
    names = {r.row_id: r.full_name for r in privacy.anonymize(df, tags, "pseudonymize", ["full_name"]).collect()}
    assert names == {1: "PATIENT_0001", 2: "PATIENT_0002", 3: "PATIENT_0001"}
    assert privacy.anonymize(df, tags, "drop").columns == ["row_id"]
    with pytest.raises(ValueError):
        privacy.anonymize(df, tags, "hash")


def test_analytics(spark):
    rows = [(1, "Male", 10, "2023-01-01", "2023-01-02", "2023-01-05", "Recovered", "Confirmed"),
            (2, "Female", 25, "2023-01-01", "2023-01-03", "2023-01-08", "Dead", "Confirmed"),
            (3, "Male", 45, "2023-01-02", None, None, "Recovered", "Probable"),
            (4, "Female", 70, "2023-01-03", "2023-01-04", "2023-01-09", "Recovered", "Suspect")]
    df = frame(spark, rows, "row_id bigint, sex string, age int, date_onset string, date_admission string, date_discharge string, "
               "outcome string, case_definition string")
    tags = {c: c for c in df.columns[1:]}
    one = analytics.case_indicators(df, tags).first()
    assert (one.total_cases, one.deaths, one.cfr_pct, one.male_count, one.hospitalized_count) == (4, 1, 25.0, 2, 3)
    stay = {r.delay: r.median_days for r in analytics.delay_stats(df, tags).collect()}
    assert stay["hospital_length_of_stay"] == 5.0
    assert {r.period: r.cases for r in analytics.epi_curve(df, "date_onset").collect()}["2023-01-01"] == 2
    assert [r.age_group for r in analytics.pyramid(df, tags).collect()] == ["5-14", "15-29", "30-49", "65-79"]


def test_wide_curve_finds_its_categories(spark):
    rows = [(1, "2023-01-01", "a"), (2, "2023-01-01", "b"), (3, "2023-02-01", "a"), (4, "2023-02-03", None)]
    df = frame(spark, rows, "row_id bigint, day string, kind string")
    wide = analytics.epi_curve_wide(df, "day", "month", "kind")
    assert wide.columns == ["period", "Unknown", "a", "b", "total"]
    assert [tuple(r) for r in wide.collect()] == [("2023-01", 0, 1, 1, 2), ("2023-02", 1, 1, 0, 2)]
    assert analytics.epi_curve_wide(df, "day", "month", "kind", most=2).columns == ["period", "stratum", "cases"]


def test_alerts_and_trend(spark):
    counts = frame(spark, [("2023-W01", 5), ("2023-W02", 5), ("2023-W04", 6), ("2023-W05", 30)], "week string, cases bigint")
    alert = surveillance.weekly_alerts(counts).collect()
    assert [(a.week, a.cases, a.severity) for a in alert] == [("2023-W05", 30, "MEDIUM")]
    trend = surveillance.incidence_trend(counts).first()
    assert (trend.trend, trend.weekly_growth_pct, trend.doubling_weeks, trend.peak_week) == ("increasing", 400.0, 0.4, "2023-W05")
    assert surveillance.weekly_alerts(counts.limit(2)).count() == 0
    assert [r.cases for r in surveillance.fill_weeks(counts).orderBy("week").collect()] == [5, 5, 0, 6, 30]
    alone = surveillance.incidence_trend(counts.limit(1)).first()
    assert alone.trend == "stable" and alone.last_week_cases is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ID;Nom\n1;Béa\n2;\"x;y\"\n".encode("utf-8"))
    df = tabular.load_cases(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["row_id", "ID", "Nom"] and [tuple(r) for r in df.orderBy("row_id").collect()] == [(1, "1", "Béa"), (2, "2", "x;y")]
    (tmp_path / "b.csv").write_bytes("Nom;Âge\nBéa;3\n".encode("latin-1"))
    assert tabular.load_cases(spark, str(tmp_path / "b.csv")).first()["Âge"] == "3"
    (tmp_path / "c.tsv").write_text("a\tb\n1\t2\n")
    assert tuple(tabular.load_cases(spark, str(tmp_path / "c.tsv")).first()) == (1, "1", "2")
    (tmp_path / "d.csv").write_text("Ministry,,\nReport,,\nid,name,age\n1,Al,3\n2,Bo,4\n")
    found = tabular.load_cases(spark, str(tmp_path / "d.csv"))
    assert found.columns == ["row_id", "id", "name", "age"] and found.count() == 2
    assert tabular.load_cases(spark, str(tmp_path / "d.csv"), skip=2).orderBy("row_id").first()["name"] == "Al"
    (tmp_path / "e.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert tabular.load_cases(spark, str(tmp_path / "e.json")).count() == 2
    raw = frame(spark, [(1, "title", None), (2, " id ", "name"), (3, "7", "Al")], "row_id bigint, x string, y string")
    assert tabular.load_cases(spark, raw, skip=2).columns == ["row_id", "id", "name"]
    with pytest.raises(ValueError):
        tabular.load_gazetteer(spark, raw.limit(0))


def test_row_ids_of_small_splits(spark, tmp_path):
    lines = [f"{i},name {i % 100}" for i in range(120_000)]
    for part in range(2):
        (tmp_path / f"{part}.csv").write_text("title,\nid,name\n" + "\n".join(lines[part * 60_000:(part + 1) * 60_000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = tabular.load_cases(spark, str(tmp_path), skip=1)
        got = df.agg(F.count("*"), F.countDistinct("row_id"), F.min("row_id"), F.max("row_id"),
                     F.sum((F.col("row_id") != F.col("id").cast("bigint") + 1).cast("int"))).first()
        assert tuple(got) == (120_000, 120_000, 1, 120_000, 0)
        df.write.parquet(str(tmp_path / "p.parquet"))
        kept = tabular.load_cases(spark, spark.read.parquet(str(tmp_path / "p.parquet")).drop("row_id"), order="id")
        assert kept.agg(F.max("row_id")).first()[0] == 119_999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_charset_of_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,name\n" + b"1,plain\n" * 20_000 + "2,B\u00e9a\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("id,name\n3,Zo\u00e9\n".encode("utf-8"))
    df = tabular.load_cases(spark, str(tmp_path))
    assert {r.id: r.name for r in df.where("id > 1").collect()} == {"2": "B\u00e9a", "3": "Zo\u00e9"}
    assert df.count() == 20_002
    df = tabular.load_cases(spark, str(tmp_path), multiline=True)
    assert {r.id: r.name for r in df.where("id > 1").collect()} == {"2": "B\u00e9a", "3": "Zo\u00e9"} and df.count() == 20_002


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,note\n1,"a\nb"\n2,c\n')
    df = tabular.load_cases(spark, str(tmp_path / "m.csv"), multiline=True)
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(1, "1", "a\nb"), (2, "2", "c")]
    (tmp_path / "t.csv").write_text('5" title\nid,"long\nnote"\n1,"a\nb"\n\n2,c\n')
    df = tabular.load_cases(spark, str(tmp_path / "t.csv"), skip=1, multiline=True)
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(1, "1", "a\nb"), (3, "2", "c")]
    (tmp_path / "blank.csv").write_text("\n\nid,note\n1,x\n")
    assert tabular.load_cases(spark, str(tmp_path / "blank.csv")).first()["note"] == "x"


def test_missing_tokens(spark):
    df = frame(spark, [(1, "NA", "x"), (2, " -99 ", "?"), (3, "ok", "unknown"), (4, None, "n/a")], "row_id bigint, a string, b string")
    assert {r.column_name: (r.token_cells, r.null_cells) for r in standardize.missing_counts(df).collect()} == {"a": (2, 1), "b": (2, 0)}
    assert [r.a for r in standardize.null_missing(df).orderBy("row_id").collect()] == [None, None, "ok", None]


def test_clean_job(spark, tmp_path):
    rows = [("P1", "Ali Gana", "m", "12 mos", "24/09/2023", "Borno", "0770000899", "Sortie"),
            ("P2", "Zara Goni", "F", "48", "27-Aug-2023", "Borno", "NA", "DCD"),
            ("P2", "Zara Goni", "F", "48", "27-Aug-2023", "Borno", "NA", "DCD")]
    df = frame(spark, [(i + 1, *r) for i, r in enumerate(rows)], "row_id bigint, `Patient ID` string, `Patient Name` string, "
               "Gender string, Age string, `Admission Date` string, State string, Phone string, Outcome string")
    gaz = frame(spark, [(1, "Borno", "NG008", 11.8, 13.1)], "ref_row bigint, State string, Adm1_Pcode string, Latitude double, Longitude double")
    cfg = cw.CleaningConfig(as_of="2023-12-31", dedup_action="keep_first", anonymize=True, anonymize_method="mask")
    out = cw.clean(df, gaz, cfg)
    got = {r.row_id: r for r in out.cases.collect()}
    assert set(got) == {1, 2} and got[1].gender == "Male" and got[1].age == 1.0 and got[1].age_group == "<5"
    assert got[1].epi_week == "2023-W38" and got[1].pcode_assigned == "NG008" and got[1].phone == "+" + "*" * 11 + "9"
    assert got[2].outcome == "Dead" and got[2].patient_name == "Z**a G**i"
    assert out.tables["quality_after"].first().uniqueness == 100.0
    out.write(str(tmp_path / "bundle"), "csv")
    assert (tmp_path / "bundle" / "column_profile").is_dir()
    report = cw.report_tables(out)
    assert {"cases", "issues", "duplicates", "kpis", "gazetteer", "data_dictionary", "tag_legend"} <= set(report)
    assert report["tag_legend"].count() == 8
    sinks.write_geojson(out.cases, str(tmp_path / "geo"))
    feature = json.loads(spark.read.text(str(tmp_path / "geo")).orderBy("value").first()[0])
    assert feature["geometry"] == {"type": "Point", "coordinates": [13.1, 11.8]} and feature["properties"]["_pcode"] == "NG008"
    assert cw.compare(df, out.cases)["added_columns"]
    assert {"indicators", "curve_week", "delays"} <= set(cw.analyse(out.cases, out.tags))


def test_stream_equals_batch(spark, small_dir, tmp_path):
    schema = spark.read.parquet(f"{small_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").write_bytes(open(f"{small_dir}/events.parquet", "rb").read())
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seen = []
    counts = weekly.weekly_counts_stream(stream, "ts", ("event_type",))
    query = weekly.write_alerts(counts, lambda t, n: seen.append(sorted(map(tuple, t.collect()))), str(tmp_path / "cp"), ("event_type",), 1.1)
    query.processAllAvailable()
    query.stop()
    from casewell.plans.queries import weekly_alerts_events
    assert seen[-1] == sorted(map(tuple, weekly_alerts_events(spark, small_dir).collect()))


def test_rules_of_many_columns_leave_methods_the_jvm_compiles(spark, small_dir):
    from casewell.plans.casebook import raw_cases
    from casewell.settings import METHOD_LIMIT
    spark.conf.set(METHOD_LIMIT, "65535")
    raw_cases(spark, small_dir)
    assert spark.conf.get(METHOD_LIMIT) == "8000"
    spark.conf.set(METHOD_LIMIT, "20000")
    raw_cases(spark, small_dir)
    assert spark.conf.get(METHOD_LIMIT) == "20000"
    spark.conf.set(METHOD_LIMIT, "8000")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weekly_counts_parse_a_date_once(spark):
    from casewell.functions.dates import parse_date
    df = frame(spark, [("2024-01-01", "a"), ("02/01/2024", "a"), ("n/a", "a"), (None, None)], "d string, g string")
    weeks = standardize.add_epi_week(df.withColumn("day", parse_date(F.col("d"))), "day")
    counts = surveillance.weekly_counts(weeks, by=["g"])
    assert [tuple(r) for r in counts.collect()] == [("a", "2024-W01", 2)]
    assert _plan(counts).count("(0[1-9]|1[0-2])") == 1
    assert "(0[1-9]|1[0-2])" not in _plan(surveillance.fill_weeks(counts, ["g"]))


def test_first_cells_are_not_sorted_whole(spark):
    rows = [(i, " " if i % 3 else f"v{i}", None) for i in range(1000)] + [(None, "first", "x")]
    df = frame(spark, rows, "row_id bigint, a string, b string").repartition(7)
    found = quality.sample_values(df, ["a", "b"])
    assert sorted(map(tuple, found.collect())) == [("a", "first", 1), ("a", "v0", 2), ("a", "v3", 3), ("a", "v6", 4), ("b", "x", 1)]
    assert "Generate" not in _plan(found) and "MapInArrow" in _plan(found)


def test_kept_rows_are_computed_once(spark, small_dir):
    from casewell.plans.queries import QUERIES
    for name in ("dedup_merge", "dedup_keep_last", "column_profile_full"):
        assert "lineitem" not in QUERIES[name](spark, small_dir).inputFiles().__repr__(), name
