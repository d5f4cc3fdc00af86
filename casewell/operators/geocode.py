"""Place names to official codes: exact, then fuzzy, from the finest level to the coarsest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casewell.functions.similarity import partial_score, token_sort_score
from casewell.functions.text import not_blank, place_name, round_half_up
from casewell.lexicon import MATCH_LEVELS, UNMATCHED
from casewell.operators.candidates import candidate_pairs, gram_frequencies, with_features
from casewell.settings import ensure_checkpoint_dir

PARTIAL_FLOOR = 85.0
# level -> gazetteer columns (name, code); the finest level keeps the last row of a name, the others the first
LEVEL_COLUMNS = {
    "Locality": ("locality_name", "locality_pcode"),
    "Admin3_Ward": ("admin3_name", "admin3_pcode"),
    "Admin2_LGA": ("admin2_name", "admin2_pcode"),
    "Admin1_State": ("admin1_name", "admin1_pcode"),
}
OUTPUT = ("pcode_assigned", "match_level", "match_score", "matched_name", "geo_lat", "geo_lon")


def _entries(gazetteer: DataFrame, mapping: dict[str, str] | None, order: str, within: bool) -> DataFrame:
    """One row per gazetteer row and level: ``(row, lat, lon, level, place, name, pcode, norm)``.

    ``place`` is where the name is looked up: the level, or with ``within`` the level alone and under each coarser place.
    """
    roles = mapping or {r: r for r in gazetteer.columns}
    col = lambda role: F.col(roles[role]) if roles.get(role) in gazetteer.columns else F.lit(None)
    lat, lon = col("lat" if "lat" in roles else "latitude"), col("long" if "long" in roles else "longitude")
    found = [(level, col(name).cast("string"), col(code).cast("string")) for level, (name, code) in LEVEL_COLUMNS.items()
             if roles.get(name) in gazetteer.columns and roles.get(code) in gazetteer.columns]
    levels = []
    for k, (level, name, code) in enumerate(found):
        own = F.lit(level)
        places = [own, *[_under(own, F.lit(up), up_code) for up, _, up_code in found[k + 1:] if within]]
        levels += [F.struct(own.alias("level"), place.alias("place"), name.alias("name"), code.alias("pcode")) for place in places]
    entries = gazetteer.select(
        F.col(order).cast("bigint").alias("row"), lat.try_cast("double").alias("lat"),
        lon.try_cast("double").alias("lon"), F.inline(F.array(*levels)))
    return (entries.withColumn("norm", place_name(F.col("name")))
            .where((F.col("norm") != "") & (F.col("pcode") != "") & F.col("place").isNotNull()))


def _under(level: Column, parent_level: Column, parent_code: Column) -> Column:
    """Key of the names of a level below one place; null without a code."""
    return F.when(parent_code != "", F.concat(level, F.lit("\n"), parent_level, F.lit("\n"), parent_code))


def _one_per_name(entries: DataFrame) -> DataFrame:
    rank = F.when(F.col("level") == MATCH_LEVELS[0], -F.col("row")).otherwise(F.col("row"))
    return (entries.groupBy(F.col("place").alias("level"), "norm")
            .agg(F.min_by(F.struct("pcode", "name", "lat", "lon"), rank).alias("v"), F.min("row").alias("cand_order"))
            .select("level", "norm", "v.*", "cand_order"))


def gazetteer_index(gazetteer: DataFrame, mapping: dict[str, str] | None = None, order: str = "ref_row") -> DataFrame:
    """``(level, norm, pcode, name, lat, lon, cand_order)``: one entry per level and name.

    ``mapping`` gives the gazetteer's column for each role; ``order`` is its row order.
    """
    return _one_per_name(_entries(gazetteer, mapping, order, within=False))


def nested_index(gazetteer: DataFrame, mapping: dict[str, str] | None = None, order: str = "ref_row") -> DataFrame:
    """As ``gazetteer_index``, one entry per name for each level and for each place above it.

    ``level`` names the level alone or with the place above, so names of two districts are two entries there; a row gives ten
    entries at most.  For ``geocode_nested``.
    """
    return _one_per_name(_entries(gazetteer, mapping, order, within=True))


def _probe_names(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct ``(level, norm)`` of the place columns."""
    levels = [F.struct(F.lit(level).alias("level"), place_name(F.col(c).cast("string")).alias("norm"))
              for level, c in columns.items()]
    return df.select(F.inline(F.array(*levels))).where(F.col("norm") != "").distinct()


def match_names(probes: DataFrame, index: DataFrame, threshold: float = 80.0) -> DataFrame:
    """``(level, norm, score, pcode, name, lat, lon)`` for the probes that match.

    Equal names score 100.  The others take the best token-sort score reaching
    ``threshold``, and failing that the best partial score reaching
    ``max(threshold, 85)``; on ties the earlier gazetteer entry wins.  Only distinct
    names are scored, whatever the number of cases.
    """
    ensure_checkpoint_dir(probes.sparkSession)
    # both are a row per distinct name, used several times below: computed once
    probes, index = probes.checkpoint(), index.checkpoint()
    entry = F.struct("pcode", "name", "lat", "lon")
    target = index.select("level", "norm", "cand_order", entry.alias("entry"))
    exact = probes.join(target, ["level", "norm"]).select("level", "norm", F.lit(100.0).alias("score"), "entry")
    residual = probes.join(index.select("level", "norm"), ["level", "norm"], "left_anti")

    frequencies = gram_frequencies(index, "norm")

    def best(left: DataFrame, family: str, scorer, floor: float) -> DataFrame:
        t = floor / 100.0
        l = with_features(left.withColumn("lane", F.array("level")), "norm", t, family, frequencies)
        r = with_features(target.withColumn("lane", F.array("level")), "norm", t, family, frequencies)
        l = l.withColumn("entry", F.lit(None)).withColumn("cand_order", F.lit(None))
        pairs = candidate_pairs(l, r, ["level", "norm", "cand_order", "entry"], t, family,
                                lanes={"lane_": ("lane", "lane")},
                                pair_key=("l_level", "l_norm", "r_norm"))
        scored = pairs.withColumn("score", scorer("l_text", "r_text")).where(F.col("score") >= floor - 1e-9)
        return (scored.groupBy(F.col("l_level").alias("level"), F.col("l_norm").alias("norm"))
                .agg(F.max_by(F.struct("score", "r_entry"), F.struct("score", -F.col("r_cand_order"))).alias("b"))
                .select("level", "norm", F.col("b.score").alias("score"), F.col("b.r_entry").alias("entry")))

    by_sort = best(residual, "sort", token_sort_score, threshold).checkpoint()
    left_over = residual.join(by_sort.select("level", "norm"), ["level", "norm"], "left_anti")
    by_part = best(left_over, "name", partial_score, max(threshold, PARTIAL_FLOOR))
    found = exact.unionByName(by_sort).unionByName(by_part)
    return found.select("level", "norm", "score", "entry.*").checkpoint()


def geocode(df: DataFrame, index: DataFrame, columns: dict[str, str], threshold: float = 80.0) -> DataFrame:
    """Adds the six match columns.  ``columns``: level -> place column of the case list."""
    matches = match_names(_probe_names(df, columns), index, threshold)
    return attach_matches(df, matches, columns)


def geocode_exact(df: DataFrame, index: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The cascade with equal names only."""
    return attach_matches(df, index.withColumn("score", F.lit(100.0)), columns)


def geocode_nested(df: DataFrame, index: DataFrame, columns: dict[str, str], threshold: float = 80.0, exact: bool = False) -> DataFrame:
    """The six match columns by a cascade in which places lie inside each other; ``index`` is a ``nested_index``.

    Levels are settled from the coarsest to the finest.  A name is looked up among the names below the finest place found so
    far for its row, and among all names of its level while none is found; so a name that several districts share goes to the
    row's own, and a name that its district lacks leaves the row at the district.  Equal names, then scores, as in ``match_names``
    (``exact``: equal names only).  Blank names are passed over.

    Only distinct combinations of names are normalised and settled, whatever the number of cases: a level costs one match of
    names that differ in text or in the place above.
    """
    ensure_checkpoint_dir(df.sparkSession)
    levels = [level for level in MATCH_LEVELS if level in columns]
    key = {level: f"_p{i}" for i, level in enumerate(levels)}
    given = {level: f"_g{i}" for i, level in enumerate(levels)}
    text = {level: F.col(columns[level]).cast("string") for level in levels}
    named = df.select(*[text[level].alias(given[level]) for level in levels]).distinct().withColumns({
        key[level]: F.coalesce(F.when(not_blank(F.col(given[level])), place_name(F.col(given[level]))), F.lit(""))
        for level in levels}).checkpoint()
    paths = named.select(*key.values()).distinct().withColumn("_m", F.lit(None).cast(
        "struct<pcode:string,level:string,score:double,name:string,lat:double,lon:double>"))
    index = index.checkpoint()
    for level in reversed(levels):
        inside = _under(F.lit(level), F.col("_m.level"), F.col("_m.pcode"))
        paths = paths.withColumn("_place", F.coalesce(inside, F.lit(level))).checkpoint()
        probes = paths.select(F.col("_place").alias("level"), F.col(key[level]).alias("norm")).where("norm <> ''").distinct()
        hits = index.withColumn("score", F.lit(100.0)) if exact else match_names(probes, index, threshold)
        hits = hits.select(F.col("level").alias("_at"), "norm", F.struct(
            "pcode", F.lit(level).alias("level"), F.col("score").cast("double").alias("score"), "name",
            F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("_hit"))
        paths = paths.join(hits, (F.col("_place") == F.col("_at")) & (F.col(key[level]) == F.col("norm")), "left").select(
            *key.values(), F.coalesce("_hit", "_m").alias("_m"))
    found = named.join(paths, list(key.values())).select(*given.values(), "_m")
    same = [text[level].eqNullSafe(F.col(given[level])) for level in levels]
    out = df.join(found, same, "left")
    return _spread(out.withColumn("_m", F.coalesce("_m", _no_match()))).drop(*given.values())


def attach_matches(df: DataFrame, matches: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Look every level up and keep the finest hit."""
    picks = []
    out = df
    for i, level in enumerate(l for l in MATCH_LEVELS if l in columns):
        hit = f"_hit{i}"
        side = matches.where(F.col("level") == level).select(
            F.col("norm").alias(f"_n{i}"),
            F.struct(F.col("pcode"), F.lit(level).alias("level"), F.col("score").cast("double").alias("score"),
                     F.col("name"), F.col("lat").cast("double").alias("lat"),
                     F.col("lon").cast("double").alias("lon")).alias(hit))
        raw = F.col(columns[level]).cast("string")
        out = out.withColumn(f"_k{i}", F.when(not_blank(raw), place_name(raw)))
        out = out.join(side, F.col(f"_k{i}") == F.col(f"_n{i}"), "left").drop(f"_n{i}", f"_k{i}")
        picks.append(hit)
    return _spread(out.withColumn("_m", F.coalesce(*[F.col(p) for p in picks], _no_match())).drop(*picks))


def _no_match() -> Column:
    return F.struct(F.lit(None).cast("string").alias("pcode"), F.lit(UNMATCHED).alias("level"),
                    F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("name"),
                    F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))


def _spread(out: DataFrame) -> DataFrame:
    """The fields of ``_m`` as the output columns."""
    for name, part in zip(OUTPUT, ("pcode", "level", "score", "name", "lat", "lon")):
        out = out.withColumn(name, F.col("_m").getField(part))
    return out.drop("_m")


def geocode_summary(df: DataFrame) -> DataFrame:
    """``(match_level, cnt, pct, total, geocoded, rate_pct, mean_score)``, one row per level, zeros shown."""
    spark = df.sparkSession
    levels = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (*MATCH_LEVELS, UNMATCHED)])).alias("match_level"))
    per = df.groupBy("match_level").agg(F.count("*").alias("cnt"), F.sum("match_score").alias("points"),
                                        F.count_if(F.col("match_score") > 0).alias("scored"))
    full = levels.join(per, "match_level", "left").fillna(0, ["cnt", "points", "scored"])
    totals = full.agg(F.sum("cnt").alias("total"), F.sum("points").alias("points"), F.sum("scored").alias("scored"),
                      F.sum(F.when(F.col("match_level") != UNMATCHED, F.col("cnt"))).alias("geocoded"))
    pct = lambda part: F.when(F.col("total") > 0, round_half_up(part * 100.0 / F.col("total"), 1)).otherwise(0.0)
    return full.select("match_level", "cnt").crossJoin(F.broadcast(totals)).select(
        "match_level", "cnt", pct(F.col("cnt")).alias("pct"), "total", "geocoded",
        pct(F.col("geocoded")).alias("rate_pct"),
        F.when(F.col("scored") > 0, round_half_up(F.col("points") / F.col("scored"), 1)).otherwise(0.0).alias("mean_score"))
