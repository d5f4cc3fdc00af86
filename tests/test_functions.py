import datetime

import pytest
from pyspark.sql import functions as F

from casewell.functions import ages, categories, dates, phones, places, privacy, text
from casewell.operators import standardize

D = datetime.date
VECTORS = [
    (lambda c: dates.parse_date(c, century_pivot=2026), {
        "2023-08-15": D(2023, 8, 15), "25/12/2022": D(2022, 12, 25), "14 juillet 2023": D(2023, 7, 14),
        "03 déc. 2022": D(2022, 12, 3), "12 de octubre de 2023": D(2023, 10, 12), "44856": D(2022, 10, 22),
        "20230514": D(2023, 5, 14), "15-Aug-23": D(2023, 8, 15), "August 5, 2023": D(2023, 8, 5), "31/02/2023": None,
        "invalid_date_text": None, "NA": None, "99999": None, "1/2/98": D(1998, 2, 1), "05/2023": D(2023, 5, 1)}),
    (lambda c: dates.parse_date(c, day_first=False), {"12/25/2022": D(2022, 12, 25), "25/12/2022": D(2022, 12, 25),
                                                      "03/04/2022": D(2022, 3, 4)}),
    (lambda c: dates.epi_week(dates.parse_date(c)), {"2023-01-05": "2023-W01", "2023-08-15": "2023-W33",
                                                     "2021-01-03": "2020-W53", "not_a_date": None}),
    (ages.parse_age, {"25": 25.0, "18 months": 1.5, "6m": 0.5, "14 days": 0.04, "45 ans": 45.0, "3w": 0.06,
                      "7,5 ans": 7.5, "NA": None, "-5": None, "999": None}),
    (ages.age_unit_of, {"25": "Years", "6m": "Months", "14 days": "Days", "3w": "Weeks", "x": None}),
    (categories.standardize_sex, {"M": "Male", "homme": "Male", "F": "Female", "2": "Female", "Other": "Other",
                                  "unknown": "Unknown", "NA": None}),
    (categories.standardize_case_definition, {"Confirmé": "Confirmed", "PCR+": "Confirmed", "Prob": "Probable",
                                              "Suspect": "Suspect", "Non-case": "Discarded"}),
    (categories.standardize_outcome, {"DCD": "Dead", "Mort": "Dead", "Guéri": "Recovered", "Sortie": "Discharged",
                                      "Evade": "LAMA", "Vivant": "Alive"}),
    (categories.standardize_binary, {"Oui": "Yes", "1": "Yes", "+": "Yes", "Non": "No", "0": "No", "-": "No"}),
    (text.place_name, {"Béni Village": "beni", "Ward Bolori I": "bolori i", "Maiduguri LGA": "maiduguri",
                       "Zone de Sante de Goma": "de goma"}),
    (text.title_case, {"el-miskin da'alti": "El-Miskin Da'Alti", "HOPITAL 3rd": "Hopital 3Rd"}),
    (text.strip_accents, {"Équateur ﬁn": "Equateur fin", "ñandú": "nandu"}),
    (privacy.mask_words, {"John Doe": "J**n D*e", "A": "A", "Al b": "A* b"}),
    (lambda c: places.parse_coordinate(c, "lat"), {"11°30'00\" S": -11.5, "12,5": 12.5, "95": None, "-12.5": -12.5}),
    (phones.clean_phone, {"0770000899": "+221770000899", "00221770000899": "+221770000899", "770000899": "+221770000899",
                          "12-34": None, "1234567": "+1234567"}),
]


@pytest.mark.parametrize("rule,cases", VECTORS)
def test_vectors(spark, rule, cases):
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    got = {r.v: r.r for r in df.select("v", rule(F.col("v")).alias("r")).collect()}
    assert got == cases


def test_hash_ignores_case(spark):
    df = spark.createDataFrame([(" John Doe",), ("JOHN DOE ",)], "v string")
    hashes = {r[0] for r in df.select(privacy.salted_hash(F.col("v"), "s")).collect()}
    assert len(hashes) == 1 and hashes.pop().startswith("HASH_")


def test_bands(spark):
    assert ages.band_labels([0, 5, 15, 30, 50, 65, 80]) == ["<5", "5-14", "15-29", "30-49", "50-64", "65-79", "80+"]
    assert ages.band_labels([0, 1, 2]) == ["<1", "1", "2+"]
    df = spark.createDataFrame([(2.5,), (10.0,), (70.0,), (85.0,), (None,)], "y double")
    assert [r[0] for r in df.select(ages.age_band(F.col("y"))).collect()] == ["<5", "5-14", "65-79", "80+", None]


def test_weeks_are_not_months(spark):
    df = spark.createDataFrame([("4", "semaines"), ("6", "mois"), ("10", "jours"), ("7", "ans")], "a string, u string")
    got = [r[0] for r in df.select(ages.parse_age_with_unit(F.col("a"), F.col("u"))).collect()]
    assert got == [0.08, 0.5, 0.03, 7.0]


def test_swapped_coordinates(spark):
    df = spark.createDataFrame([("120.5", "12.5"), ("12.5", "120.5"), ("x", "1")], "a string, b string")
    got = [tuple(r[0]) for r in df.select(places.coordinate_pair(F.col("a"), F.col("b"))).collect()]
    assert got == [(12.5, 120.5, True), (12.5, 120.5, False), (None, 1.0, False)]


def test_rare_dates(spark):
    cases = {"12 mai": "2000-05-12", "May 3rd": "2000-05-03", "10:30 2024-01-05": "2024-01-05", "lundi 5 janvier 2024": "2024-01-05",
             "Tuesday, 9 Jan 2024 8:15 pm": "2024-01-09", "14h30 05/02/2024": "2024-02-05", "31 novembre": None, "12 chat": None, "lundi": None,
             "2024-03-01": "2024-03-01", "": None, None: None}
    rows = spark.createDataFrame([(k, t, t) for k, t in enumerate(cases)], "row_id long, a string, b string")
    got = standardize.clean_dates(rows, {"a": True, "b": False}, rare=True).orderBy("row_id").collect()
    assert [str(r.a) if r.a else None for r in got] == list(cases.values()) and got[5].b.isoformat() == "2024-05-02"
    assert standardize.clean_dates(rows.where("a = 'lundi'"), {"a": True}, rare=True).first().a is None
