"""Fuzzy operators against plain sequential loops."""

import random

import pytest
from pyspark.sql import functions as F

from casewell.functions import ages, similarity as sim
from casewell.operators import candidates, dedup, facility, geocode
from casewell.operators.leaders import greedy_leaders
from casewell.operators.numbering import dense_number
from casewell.plans import queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    def one(s, l):
        m, n = len(s), len(l)
        windows = [l[:i] for i in range(1, m)] + [l[i:i + m] for i in range(n - m + 1)] + [l[i:] for i in range(n - m + 1, n)]
        return max(ratio(s, w) for w in windows)
    s, l = sorted((a, b), key=len)
    return max(one(s, l), one(l, s)) if len(s) == len(l) else one(s, l)


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    p, q = ((both + " " + " ".join(sorted(d))).strip() for d in (x - y, y - x))
    return max(ratio(p, q), ratio(both, p), ratio(both, q)) if both else ratio(p, q)


def name_score(a, b):
    srt = lambda t: " ".join(sorted(t.split()))
    return max(ratio(a, b), ratio(srt(a), srt(b)), token_set(a, b), partial(a, b))


def texts(n, seed, longest=12, letters="abc de"):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(3, longest))).split()) or "abc" for _ in range(n)]


@pytest.mark.parametrize("batch,plain", [(sim.ratio_scores, ratio), (sim.partial_scores, partial),
                                         (sim.token_set_scores, token_set), (sim.name_scores, name_score)])
def test_scores(batch, plain):
    a, b = texts(150, 1) + texts(4, 2, 100), texts(150, 3) + texts(4, 4, 100)
    assert batch(a, b) == pytest.approx([plain(x, y) for x, y in zip(a, b)])


@pytest.mark.parametrize("family,threshold,score", [
    ("sort", 0.85, lambda a, b: ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))),
    ("name", 0.80, name_score), ("name", 0.70, name_score)])
def test_no_pair_is_lost(spark, family, threshold, score):
    names = sorted(set(texts(110, 7, 10, "abcdefgh ")))
    df = spark.createDataFrame(list(enumerate(names)), "ord int, name string")
    nodes = candidates.with_features(df, "name", threshold, family, candidates.gram_frequencies(df, "name"))
    pairs = candidates.candidate_pairs(nodes, nodes, ["ord"], threshold, family, condition=F.col("l_ord") < F.col("r_ord"))
    got = {(r.l_ord, r.r_ord) for r in pairs.select("l_ord", "r_ord").collect()}
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names))
            if score(names[i], names[j]) >= threshold * 100 - 1e-9}
    assert want and want <= got


@pytest.mark.parametrize("prefix", [7, 1000])
def test_greedy_leaders(spark, prefix):
    rnd = random.Random(5)
    n = 60
    edges = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(150)})
    nodes = spark.createDataFrame([(i,) for i in range(n)], "ord bigint")
    table = spark.createDataFrame(edges, "l_ord bigint, r_ord bigint").withColumn("score", F.lit(1.0)).checkpoint()

    def find(left, right, within):
        return (table.join(left.withColumnRenamed("ord", "l_ord"), "l_ord")
                .join(right.withColumnRenamed("ord", "r_ord"), "r_ord").select("l_ord", "r_ord", "score"))
    got = {r.ord: r.leader for r in greedy_leaders(nodes, find, prefix).collect()}
    want, taken = {}, set()
    for i in range(n):
        if i in taken:
            continue
        for j in range(i + 1, n):
            if (i, j) in edges and j not in taken:
                want[j] = i
                taken.add(j)
    assert got == want


def test_fuzzy_duplicates(spark):
    rnd = random.Random(11)
    first, last = ["amina", "ibrahim", "john", "johnathan"], ["diallo", "doe", "gana", "goni"]
    rows = []
    for i in range(140):
        name = f"{rnd.choice(first)} {rnd.choice(last)}" + rnd.choice(["", "", " jr"])
        rows.append((i, name if rnd.random() > .05 else None, rnd.choice(["Male", "Female", None]),
                     rnd.choice([None, 5.0, 6.0, 7.0, 40.0]), rnd.choice([None, "2023-05-01", "2023-05-10", "2023-05-20", "2023-08-01"])))
    rows += [(200 + i, *rows[3][1:]) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id bigint, full_name string, sex string, age double, date_onset string").repartition(5)
    day = lambda s: int(s[5:7]) * 31 + int(s[8:])
    want, taken = {}, set()
    for i, a in enumerate(rows):
        if a[0] in taken or not a[1]:
            continue
        mine = []
        for b in rows[i + 1:]:
            if b[0] in taken or not b[1] or (a[2] and b[2] and a[2] != b[2]):
                continue
            if a[3] is not None and b[3] is not None and abs(a[3] - b[3]) > 1.5:
                continue
            if a[4] and b[4] and abs((__import__("datetime").date.fromisoformat(a[4]) - __import__("datetime").date.fromisoformat(b[4])).days) > 14:
                continue
            if name_score(a[1], b[1]) >= 80 - 1e-9:
                mine.append(b[0])
        if mine:
            taken.update([a[0], *mine])
            want.update({x: a[0] for x in [a[0], *mine]})
    for prefix in (25, 4000):
        got = {r.row_id: r.group_id for r in dedup.fuzzy_duplicates(df, first_prefix=prefix).collect()}
        assert got == want


def test_lower_threshold_pair(spark):
    rows = [(1, "Johnathan Doe", "Male", 35.0, "2023-05-01"), (2, "John Doe", "Male", 35.0, "2023-05-02"),
            (3, "Sarah Connor", "Female", 28.0, "2023-06-10")]
    df = spark.createDataFrame(rows, "row_id bigint, full_name string, sex string, age double, date_onset string")
    found = dedup.fuzzy_duplicates(df, threshold=0.75)
    assert {(r.row_id, r.group_id) for r in found.collect()} == {(1, 1), (2, 1)}


def test_facilities(spark):
    names = ["Hopital General"] * 3 + ["Hopital Général", "hopital  general", "Centre Goma", "Centre Gomma", None, " "]
    df = spark.createDataFrame(list(enumerate(names)), "row_id bigint, f string")
    got = {r.row_id: r.f for r in facility.harmonize_facilities(df, "f").collect()}
    assert [got[i] for i in range(9)] == ["Hopital General"] * 5 + ["Centre Goma"] * 2 + [None, None]


GAZ = [("Borno", "NG008", "Maiduguri", "NG008018", "Bolori I", "NG008018001", "Custom House IDP Camp", "L1", 11.8, 13.1),
       ("Borno", "NG008", "Maiduguri", "NG008018", "Bolori II", "NG008018002", "El-Miskin Camp", "L2", 11.9, 13.2),
       ("Borno", "NG008", "Jere", "NG008013", "Muna", "NG008013001", "Muna Garage IDP Camp", "L3", 11.7, 13.3)]


def test_cascade(spark):
    gaz = spark.createDataFrame([(i, *g) for i, g in enumerate(GAZ)], "ref_row bigint, admin1_name string, admin1_pcode string, "
                                "admin2_name string, admin2_pcode string, admin3_name string, admin3_pcode string, "
                                "locality_name string, locality_pcode string, lat double, long double")
    rows = [(1, "Custom House IDP Camp", None, None, None), (2, "Muna Garage Camp", None, None, None),
            (3, "Unknown bush", "Bolori II", None, None), (4, None, None, "Maiduguri LGA", None),
            (5, None, None, None, "Borno State"), (6, "Outside Continent", " ", None, "Nowhere")]
    df = spark.createDataFrame(rows, "row_id bigint, l string, a3 string, a2 string, a1 string")
    columns = {"Locality": "l", "Admin3_Ward": "a3", "Admin2_LGA": "a2", "Admin1_State": "a1"}
    out = geocode.geocode(df, geocode.gazetteer_index(gaz), columns)
    got = {r.row_id: (r.pcode_assigned, r.match_level, round(r.match_score, 1)) for r in out.collect()}
    assert got == {1: ("L1", "Locality", 100.0), 2: ("L3", "Locality", 88.9), 3: ("NG008018002", "Admin3_Ward", 100.0),
                   4: ("NG008018", "Admin2_LGA", 100.0), 5: ("NG008", "Admin1_State", 100.0), 6: (None, "Unmatched", 0.0)}
    summary = {r.match_level: r.cnt for r in geocode.geocode_summary(out).collect()}
    assert summary == {"Locality": 2, "Admin3_Ward": 1, "Admin2_LGA": 1, "Admin1_State": 1, "Unmatched": 1}


def test_what_binds_each_member(spark):
    rows = [(1, "A", "amina diallo", "F"), (2, "A", "amina diallo", "F"), (3, "B", "john doe", None), (4, "B", "ali goni", "M"),
            (5, "C", "ibrahim gana", "M"), (6, None, "ibrahim gano", None), (7, "D", "gana ibrahim", "M"), (8, "E", "nobody else", "F")]
    df = spark.createDataFrame(rows, "row_id bigint, case_id string, full_name string, sex string")
    members = dedup.find_duplicates(df, {t: t for t in ("case_id", "full_name", "sex")}, "both")
    got = {r.row_id: (r.group_id, r.duplicate_type, r.key, r.value) for r in dedup.match_keys(members).collect()}
    pair = ("ibrahim gana", "ibrahim gano")          # the best of the scores counts
    similar = round(max(ratio(*pair), partial(*pair)) / 100, 2)
    assert got == {1: (1, "exact", "all_columns", "identical row"), 2: (1, "exact", "all_columns", "identical row"),
                   3: (3, "exact_id", "case_id", "B"), 4: (3, "exact_id", "case_id", "B"), 5: (5, "fuzzy", "name_similarity", "1.0"),
                   6: (5, "fuzzy", "name_similarity", str(similar)), 7: (5, "fuzzy", "name_similarity", "1.0")}
    assert dedup.match_keys(dedup.find_duplicates(df.limit(0), {"case_id": "case_id"}, "exact")).collect() == []


def test_nested_cascade_tells_districts_apart(spark):
    columns = "row bigint, admin1_name string, admin1_pcode string, admin2_name string, admin2_pcode string, locality_name string, locality_pcode string"
    gaz = spark.createDataFrame([(1, "Borno", "B", "Jere", "B1", "Sabon Gari", "B1a"), (2, "Kano", "K", "Gwale", "K1", "Sabon Gari", "K1a"),
                                 (3, "Kano", "K", "Jere", "K2", "Dala Garden", "K2a"), (4, "Kano", "K", "Fagge", None, "Fagge Town", "K3a")], columns)
    rows = [(1, "Sabon Gari", "Jere", "Borno"), (2, "Sabon Gari", None, "Kano"), (3, "Sabon Gari", " ", None), (4, "Sabbon Gari", "Gwale", "Kano"),
            (5, "Dala Garden", "Jere", "Borno"), (6, "Dala Garden", "Jere", "Kano State"), (7, None, "Jere", "Elsewhere"), (8, None, None, None),
            (9, "Fagge Town", "Fagge", "Kano"), (2, "Sabon Gari", None, "Kano")]
    df = spark.createDataFrame(rows, "row_id bigint, locality string, admin2 string, admin1 string")
    index = geocode.nested_index(gaz, order="row")
    where = {"Locality": "locality", "Admin2_LGA": "admin2", "Admin1_State": "admin1"}
    got = sorted((r.row_id, r.pcode_assigned, r.match_level) for r in geocode.geocode_nested(df, index, where).collect())
    assert got == [(1, "B1a", "Locality"), (2, "K1a", "Locality"), (2, "K1a", "Locality"), (3, "K1a", "Locality"), (4, "K1a", "Locality"),
                   (5, "B1", "Admin2_LGA"), (6, "K2a", "Locality"), (7, "B1", "Admin2_LGA"), (8, None, "Unmatched"), (9, "K3a", "Locality")]
    exact = {r.row_id: r.pcode_assigned for r in geocode.geocode_nested(df, index, where, exact=True).collect()}
    assert exact[4] == "K1" and exact[6] == "B1"
    assert geocode.geocode_nested(df.limit(0), index, where, exact=True).columns == [*df.columns, *geocode.OUTPUT]


def test_dense_number_over_ranges(spark):
    df = spark.range(0, 400, 7).withColumn("k", F.col("id") * 3).repartition(6)
    rows = dense_number(df, "k").orderBy("k").collect()
    assert [r.number for r in rows] == list(range(1, len(rows) + 1))


def test_nested_names_are_normalised_once_each(spark):
    gazetteer = spark.createDataFrame([(1, "North", "N1", "Zoé", "Z1", 1.0, 2.0)], "ref_row long, admin1_name string, admin1_pcode string, "
                                      "locality_name string, locality_pcode string, latitude double, longitude double")
    df = spark.createDataFrame([(1, "north", "ZOE "), (2, "North", None), (3, None, None), (4, "north", "ZOE "), (None, None, None)],
                               "row_id long, admin1 string, locality string")
    out = geocode.geocode_nested(df, geocode.nested_index(gazetteer), {"Admin1_State": "admin1", "Locality": "locality"}, exact=True)
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()     # the rows are only joined
    got = sorted((r.row_id or 0, r.pcode_assigned) for r in out.collect())
    assert got == [(0, None), (1, "Z1"), (2, "N1"), (3, None), (4, "Z1")]


def test_person_values_are_read_once_each(spark, small_dir):
    plan = queries._person_rows(spark, small_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan         # rows are only joined with the values read
    rows = spark.createDataFrame([(1, "5", "mois"), (2, None, None), (3, "5", "mois"), (2, None, None), (4, "5", None), (5, "x", "ans")],
                                 "row_id long, a string, u string")
    got = queries._read_once(rows, "age", ages.parse_age_with_unit, "a", "u").orderBy("row_id").collect()
    assert [(r.row_id, r.a, r.u, r.age) for r in got] == [
        (1, "5", "mois", 0.42), (2, None, None, None), (2, None, None, None), (3, "5", "mois", 0.42), (4, "5", None, 5.0), (5, "x", "ans", None)]


def test_people_who_agree_are_one_node(spark):
    rows = [(1, "Amina Diallo", None, None), (2, "amina  diallo", None, None), (3, "amina diallo", "null", None), (4, None, None, None)]
    people = dedup.person_profiles(spark.createDataFrame(rows, "row_id long, n string, s string, a string"), "n", "s", "a", None)
    plan = people._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sha2" not in plan and "to_json" not in plan
    assert sorted((r["count"], r.sex) for r in people.groupBy(*dedup.PERSON).count().collect()) == [(1, "null"), (2, None)]


def test_pairs_meet_in_one_lane_and_wide_lanes_are_few(spark):
    rnd = random.Random(5)
    values = [None, None, 0.0, 1.5, 3.0, 1.6, 0.1, -1.5, 4.499999999999999, 6.0] + [round(rnd.uniform(0, 12), rnd.choice([0, 1, 2])) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for width in (1.6, 3.2):
        probe, own = dedup._lanes(F.col("v"), 1.5, width)
        rows = df.select("v", probe.alias("probe"), own.alias("own")).collect()
        for a in rows:
            for b in rows:
                met = len(set(a.probe) & set(b.own))
                near = a.v is None or b.v is None or abs(a.v - b.v) <= 1.5
                assert met == 1 if near else met <= 1
    assert max(len(r.probe) for r in rows) <= 3         # inside a prefix: two buckets at most and the missing values


def test_rows_of_one_id_do_not_link(spark):
    rows = [(1, "amina diallo"), (1, "diallo amina"), (2, "john doe"), (None, "amina dialo")]
    df = spark.createDataFrame(rows, "row_id long, full_name string")
    got = dedup.fuzzy_duplicates(df).collect()          # one id is one group, but no link: nothing was compared
    assert [tuple(r) for r in got] == [(1, 1, None, 1.0)] * 2
