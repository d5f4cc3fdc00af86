"""Exact and fuzzy duplicate detection and resolution.

Groups are kept in long form, one row per member, so that a group of any size
stays distributed.  ``group_id`` is the smallest ``row_id`` of the group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from casewell.functions.dates import as_date
from casewell.functions.similarity import name_score
from casewell.functions.text import not_blank, round_half_up, squeeze
from casewell.operators.candidates import candidate_pairs, gram_frequencies, with_features
from casewell.operators.leaders import greedy_leaders
from casewell.settings import ensure_checkpoint_dir

MEMBER_COLUMNS = ("row_id", "group_id", "duplicate_type", "match_score", "filled", "case_id", "own_score")
MAX_AGE_GAP = 1.5
FIRST_PEOPLE = 32_000   # people compared among themselves first; their pairs are few once names, onset and age must meet
MAX_ONSET_GAP = 14
_ONSET_LANE = MAX_ONSET_GAP + 1
_AGE_LANE = MAX_AGE_GAP + 0.1
PERSON = ("pid", "name", "sex", "age", "onset")
_ANY = -(2 ** 31)        # lane for "matches everything"
_NONE = _ANY + 1         # lane for rows without the value
_EXACT_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _content(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "row_id"]


def _filled(df: DataFrame) -> Column:
    """How many columns of the row have a value."""
    return sum((F.col(c).isNotNull().cast("int") for c in _content(df)), F.lit(0))


def _fingerprint(df: DataFrame) -> Column:
    """128-bit hash of the whole row, by type; nulls count as equal, each in its column, and times differ by the microsecond."""
    nested = {c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    cells = [F.to_json(F.struct(c), _EXACT_JSON) if c in nested else F.col(c) for c in _content(df)]
    blanks = F.concat(F.lit(""), *[F.col(c).isNull().cast("int").cast("string") for c in _content(df)])
    return F.struct(F.xxhash64(F.lit(1), blanks, *cells).alias("a"), F.xxhash64(F.lit(2), *reversed(cells), blanks).alias("b"))


def _members(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows whose key occurs more than once."""
    groups = (rows.groupBy(key).agg(F.count("*").alias("n"), F.min("row_id").alias("group_id"))
              .where(F.col("n") > 1).drop("n"))
    return rows.join(groups, key).select(
        "row_id", "group_id", F.lit(kind).alias("duplicate_type"), F.lit(1.0).alias("match_score"),
        "filled", "case_id", F.lit(1.0).alias("own_score"))


def exact_duplicates(df: DataFrame, case_id: str | None = "case_id") -> DataFrame:
    """Members of groups of rows with identical content; the list is read once."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select("row_id", _fingerprint(df).alias("print"), _filled(df).alias("filled"),
                     (F.col(case_id) if case_id in df.columns else F.lit(None)).cast("string").alias("case_id")).checkpoint()
    return _members(rows, "print", "exact")


def duplicate_ids(df: DataFrame, exact: DataFrame, case_id: str = "case_id") -> DataFrame:
    """Members of groups that share a case id, among rows not in ``exact``."""
    rows = (df.where(not_blank(F.col(case_id)))
            .select("row_id", F.col(case_id).cast("string").alias("case_id"), _filled(df).alias("filled"))
            .join(exact.select("row_id"), "row_id", "left_anti"))
    return _members(rows, "case_id", "exact_id")


def _lanes(value: Column, gap: float, width: float) -> tuple[Column, Column]:
    """Join lanes for "both within ``gap`` or one of them missing", from buckets of ``width``.

    Left rows look into all buckets within the gap and the lane of missing values;
    left rows without a value look into the lane every right row is in.
    Each pair meets in exactly one lane.
    """
    bucket = lambda v: F.floor(v / F.lit(width)).cast("int")
    reach = F.lit(gap + 1e-6)           # what rounding could take off; the exact test follows
    probe = F.when(value.isNull(), F.array(F.lit(_ANY))).otherwise(
        F.concat(F.sequence(bucket(value - reach), bucket(value + reach)), F.array(F.lit(_NONE))))
    own = F.array(F.coalesce(bucket(value), F.lit(_NONE)), F.lit(_ANY))
    return probe, own


def person_profiles(df: DataFrame, name: str, sex: str | None, age: str | None, onset: str | None) -> DataFrame:
    """Rows with what is compared: ``(row_id, pid, name, sex, age, onset)``.

    Rows that agree on all four are interchangeable: they are mutually similar and
    have the same neighbours, so they always share a cluster.  ``pid`` is a hash of the four,
    to be used together with them (``PERSON``).
    """
    dtypes = dict(df.dtypes)
    text = squeeze(F.lower(F.trim(F.col(name).cast("string"))))
    pick = lambda c, make: make(F.col(c)) if c in dtypes else F.lit(None)
    rows = df.select(
        "row_id", text.alias("name"),
        pick(sex, lambda c: F.lower(F.trim(c.cast("string")))).cast("string").alias("sex"),
        pick(age, lambda c: c.try_cast("double")).cast("double").alias("age"),
        pick(onset, lambda c: as_date(c, dtypes[onset])).cast("date").alias("onset"),
    ).where(F.length("name") >= 3)
    return rows.withColumn("pid", F.xxhash64("name", "sex", "age", "onset"))


def similar_names(names: DataFrame, threshold: float) -> DataFrame:
    """``(l_name, r_name, score)`` of all ordered pairs of distinct ``name`` that score ``threshold`` or more, each with itself too.

    ``names`` has a unique orderable ``nid``; every pair is scored once.
    """
    nodes = with_features(names, "name", threshold, "name", gram_frequencies(names, "name"), shortest=3)
    pairs = candidate_pairs(nodes, nodes, ["nid"], threshold, "name", condition=F.col("l_nid") < F.col("r_nid"),
                            pair_key=("l_nid", "r_nid"))
    scored = (pairs.withColumn("score", name_score("l_text", "r_text") / 100.0).where(F.col("score") >= threshold - 1e-9)
              .select(F.col("l_nid").alias("l_name"), F.col("r_nid").alias("r_name"), "score")).checkpoint()
    turned = scored.select(F.col("r_name").alias("l_name"), F.col("l_name").alias("r_name"), "score")
    own = names.select(F.col("nid").alias("l_name"), F.col("nid").alias("r_name"), F.lit(1.0).alias("score"))
    return scored.unionByName(turned).unionByName(own)


def fuzzy_duplicates(
    df: DataFrame,
    name: str = "full_name",
    sex: str | None = "sex",
    age: str | None = "age",
    onset: str | None = "date_onset",
    threshold: float = 0.80,
    first_prefix: int = FIRST_PEOPLE,
) -> DataFrame:
    """``(row_id, group_id, match_score, own_score)`` of fuzzy duplicate clusters.

    In row order, a free row leads a cluster and takes all later free rows with a
    name score of ``threshold`` or more, the same sex, ages within 1.5 years and
    onsets within 14 days; a missing value never separates.  Members are compared
    with the leader only.  Whole-name whitespace is squeezed first.  ``own_score`` is a row's similarity with its leader,
    ``match_score`` the best of the cluster.

    Distinct names are scored once into a table of similar names; people meet through
    it, on the partner's name and the lanes of onset and age, and are never scored.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = person_profiles(df, name, sex, age, onset).checkpoint()
    people = rows.groupBy(*PERSON).agg(F.min("row_id").alias("ord"), F.count("*").alias("copies")).checkpoint()
    names = people.select("name").distinct().withColumn("nid", F.monotonically_increasing_id()).checkpoint()
    similar = similar_names(names, threshold).checkpoint()
    days = F.datediff("onset", F.lit("1970-01-01").cast("date"))
    nodes = people.join(names, "name").select("ord", "nid", "sex", "age", days.alias("day"))

    def near(attribute: str, test: Column) -> Column:
        return F.col(f"l_{attribute}").isNull() | F.col(f"r_{attribute}").isNull() | test

    alike = (near("sex", F.col("l_sex") == F.col("r_sex"))
             & near("age", F.abs(F.col("l_age") - F.col("r_age")) <= MAX_AGE_GAP)
             & near("day", F.abs(F.col("l_day") - F.col("r_day")) <= MAX_ONSET_GAP))

    def side(part: DataFrame, which: str, widths: int) -> DataFrame:
        for lane, value, gap, width in (("onset_lane", "day", MAX_ONSET_GAP, _ONSET_LANE), ("age_lane", "age", MAX_AGE_GAP, _AGE_LANE)):
            probe, own = _lanes(F.col(value), gap, width * widths)
            part = part.withColumn(lane, F.explode(probe if which == "l" else own))
        return part.select("nid", "onset_lane", "age_lane", *[F.col(c).alias(f"{which}_{c}") for c in ("ord", "sex", "age", "day")])

    def edges(left: DataFrame, right: DataFrame, within: bool) -> DataFrame:
        # inside a prefix probes outnumber what they find, so buckets are wider there and two names are looked up one way only
        widths = 2 if within else 1
        looked_up = similar.where(F.col("l_name") <= F.col("r_name")) if within else similar
        probes = side(left, "l", widths).join(looked_up, F.col("nid") == F.col("l_name")).drop("nid")
        partners = side(right, "r", widths).withColumnRenamed("nid", "r_name")
        met = probes.join(partners, ["r_name", "onset_lane", "age_lane"]).where(alike)
        if not within:
            return met.where(F.col("l_ord") < F.col("r_ord")).select("l_ord", "r_ord", "score")
        return (met.where((F.col("l_ord") < F.col("r_ord")) | (F.col("l_name") != F.col("r_name")) & (F.col("l_ord") != F.col("r_ord")))
                .select(F.least("l_ord", "r_ord").alias("l_ord"), F.greatest("l_ord", "r_ord").alias("r_ord"), "score"))

    found = greedy_leaders(nodes, edges, first_prefix)
    person = people.join(found, "ord", "left").select(
        *PERSON, "ord", "copies", F.coalesce("leader", "ord").alias("group_id"), "score")
    best = (person.groupBy("group_id")
            .agg(F.sum("copies").alias("size"),
                 F.max(F.when((F.col("ord") == F.col("group_id")) & (F.col("copies") > 1), 1.0)
                       .otherwise(F.col("score"))).alias("best"))
            .where(F.col("size") > 1))
    grouped = person.join(best, "group_id").select(
        *[F.col(c).alias(f"of_{c}") for c in PERSON], "group_id", round_half_up(F.col("best"), 2).alias("match_score"),
        round_half_up(F.coalesce("score", F.lit(1.0)), 2).alias("own_score"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in PERSON[1:]], F.col("pid") == F.col("of_pid"))
    return rows.join(grouped, same).select("row_id", "group_id", "match_score", "own_score")


def find_duplicates(df: DataFrame, tags: dict[str, str], method: str = "both", threshold: float = 0.80) -> DataFrame:
    """All duplicate members (``MEMBER_COLUMNS``); a row is in one group at most.

    Identical rows come first, then shared case ids, then fuzzy clusters, each among
    the rows that are still free.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    schema = "row_id bigint, group_id bigint, duplicate_type string, match_score double, filled int, case_id string, own_score double"
    members = spark.createDataFrame([], schema)
    case_id = tags.get("case_id")
    if method in ("exact", "both"):
        members = exact_duplicates(df, case_id)
        if case_id in df.columns:
            members = members.checkpoint()
            members = members.unionByName(duplicate_ids(df, members, case_id))
    name = tags.get("full_name") or tags.get("first_name")
    if method in ("fuzzy", "both") and name in df.columns:
        members = members.checkpoint()
        free = df.join(members.select("row_id"), "row_id", "left_anti")
        fuzzy = fuzzy_duplicates(free, name, tags.get("sex"), tags.get("age"), tags.get("date_onset"), threshold)
        info = free.select("row_id", _filled(df).alias("filled"),
                           (F.col(case_id) if case_id in df.columns else F.lit(None)).cast("string").alias("case_id"))
        members = members.unionByName(
            fuzzy.join(info, "row_id").withColumn("duplicate_type", F.lit("fuzzy")).select(*MEMBER_COLUMNS))
    return members.select(*MEMBER_COLUMNS)


def duplicate_groups(members: DataFrame) -> DataFrame:
    """One row per group with its size and the row recommended to stay."""
    return members.groupBy("group_id", "duplicate_type").agg(
        F.max("match_score").alias("match_score"), F.count("*").alias("size"),
        F.min_by("row_id", F.struct(-F.col("filled"), F.col("row_id"))).alias("recommended_keep"),
        F.when(F.first("duplicate_type") == "exact_id", F.min("case_id")).alias("matching_id"))


def match_keys(members: DataFrame) -> DataFrame:
    """``(group_id, row_id, duplicate_type, key, value)``: what binds each member to its group, a row per member.

    Identical rows share all columns and rows of one case their id; a fuzzy member has the similarity of its name with the
    leader's (1.0 for the leader and for rows like it).
    """
    kind = F.col("duplicate_type")
    return members.select(
        "group_id", "row_id", "duplicate_type",
        F.when(kind == "exact", "all_columns").when(kind == "exact_id", "case_id").otherwise("name_similarity").alias("key"),
        F.when(kind == "exact", "identical row").when(kind == "exact_id", F.col("case_id"))
        .otherwise(F.col("own_score").cast("string")).alias("value"))


def _survivors(members: DataFrame, action: str) -> DataFrame:
    keep = {
        "keep_first": F.min("row_id"),
        "keep_last": F.max("row_id"),
        "keep_most_complete": F.min_by("row_id", F.struct(-F.col("filled"), F.col("row_id"))),
    }
    keep["merge"] = keep["keep_most_complete"]
    return members.groupBy("group_id").agg(keep[action].alias("keep_id"))


def flag_duplicates(df: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``is_duplicate`` and ``duplicate_group_id``."""
    marks = members.select("row_id", F.col("group_id").alias("duplicate_group_id"))
    return (df.join(marks, "row_id", "left")
            .withColumn("is_duplicate", F.col("duplicate_group_id").isNotNull())
            .select(*df.columns, "is_duplicate", "duplicate_group_id"))


def drop_duplicates(df: DataFrame, members: DataFrame, action: str) -> DataFrame:
    """Keep one row per group: ``keep_first``, ``keep_last`` or ``keep_most_complete``."""
    losers = (members.join(_survivors(members, action), "group_id")
              .where(F.col("row_id") != F.col("keep_id")).select("row_id"))
    return df.join(losers, "row_id", "left_anti").select(*df.columns)


def merge_duplicates(df: DataFrame, members: DataFrame) -> DataFrame:
    """Keep the most complete row of each group, its gaps filled by the other members in row order."""
    groups = members.join(_survivors(members, "merge"), "group_id").select("row_id", "group_id", "keep_id")
    order = F.struct((F.col("row_id") != F.col("keep_id")).cast("int"), F.col("row_id"))
    in_groups = df.join(groups, "row_id")
    merged = in_groups.groupBy("group_id").agg(
        F.first("keep_id").alias("row_id"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in _content(df)])
    alone = df.join(groups.select("row_id"), "row_id", "left_anti")
    return alone.select(*df.columns).unionByName(merged.select(*df.columns))


def resolve_duplicates(df: DataFrame, members: DataFrame, action: str = "flag") -> DataFrame:
    if action == "flag":
        return flag_duplicates(df, members)
    if action == "merge":
        return merge_duplicates(df, members)
    if action in ("keep_first", "keep_last", "keep_most_complete"):
        return drop_duplicates(df, members, action)
    raise ValueError(f"unknown action: {action}")
