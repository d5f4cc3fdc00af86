"""Facility-name harmonisation: spellings follow the most frequent similar one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casewell.functions.similarity import token_sort_score
from casewell.functions.text import not_blank, title_case
from casewell.operators.candidates import candidate_pairs, gram_frequencies, with_features
from casewell.operators.leaders import greedy_leaders


def facility_clusters(df: DataFrame, column: str, row_id: str = "row_id", threshold: float = 85.0) -> DataFrame:
    """``(name_key, name, canonical, cnt, score)``: one row per distinct spelling.

    Names are compared in title case.  The most frequent spelling leads (the one
    seen first on ties) and takes later spellings whose token-sort score reaches
    ``threshold``.
    """
    name = title_case(F.trim(F.col(column).cast("string")))
    names = (df.where(not_blank(F.col(column)))
             .select(name.alias("name"), F.col(row_id).alias("_row"))
             .groupBy("name").agg(F.count("*").alias("cnt"), F.min("_row").alias("first_row"))
             .withColumn("name_key", F.lower("name")))
    # most frequent first, then first seen
    order = F.expr("cast(first_row as decimal(38,0)) - cast(cnt as decimal(18,0)) * 10000000000000000000BD")
    names = names.withColumn("ord", order)
    t = threshold / 100.0
    nodes = with_features(names, "name_key", t, "sort", gram_frequencies(names, "name_key"))

    def edges(left: DataFrame, right: DataFrame, within: bool) -> DataFrame:
        pairs = candidate_pairs(left, right, ["ord"], t, "sort", condition=F.col("l_ord") < F.col("r_ord"),
                                pair_key=("l_ord", "r_ord"))
        return (pairs.withColumn("score", token_sort_score("l_text", "r_text"))
                .where(F.col("score") >= threshold - 1e-9).select("l_ord", "r_ord", "score"))

    members = greedy_leaders(nodes, edges)
    leaders = names.select(F.col("ord").alias("leader"), F.col("name").alias("canonical"))
    matched = members.join(leaders, "leader").select("ord", "canonical", "score")
    return (names.join(matched, "ord", "left")
            .select("name_key", "name", F.coalesce("canonical", "name").alias("canonical"), "cnt",
                    F.coalesce("score", F.lit(100.0)).alias("score")))


def harmonize_facilities(df: DataFrame, column: str, row_id: str = "row_id", threshold: float = 85.0) -> DataFrame:
    """Replace every spelling by its leader's; blanks become null."""
    clusters = facility_clusters(df, column, row_id, threshold).select("name_key", "canonical")
    keyed = df.withColumn("_name_key", F.when(not_blank(F.col(column)), F.lower(F.trim(F.col(column).cast("string")))))
    joined = keyed.join(clusters, keyed["_name_key"] == clusters["name_key"], "left")
    return joined.withColumn(column, F.col("canonical")).drop("_name_key", "name_key", "canonical")
