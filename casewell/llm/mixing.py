"""Mixing sources to target weights along a time-varying curriculum, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casewell.llm.common import WORD, as_given, keep, set_aside

WEIGHTS = (5, 2, 1)             # by rank of the source, repeating
EPOCHS = 3                      # most times a document is taken
BUCKET_ROWS = 4096              # documents of a source that are put in order together
BROADCAST_SOURCES = 50_000      # sources up to which their table is broadcast
#: Relative weight of a source at the start and at the end of training, by rank, repeating.
RAMPS = ((1.25, 0.75), (1.0, 1.0), (0.5, 1.5))
OWN = ("_size", "_source_size", "_target", "_taken", "_positions")


def order_key(doc_id: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for a document."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
                   ramps: tuple[tuple[float, float], ...] = RAMPS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``n_docs``, ``target`` and its ramp ``w0``, ``w1``.

    ``sizes`` has ``source``, ``source_size`` and ``n_docs``.  Sources rank by code point, null last; their weights share
    the sum of all sizes, a target stops at ``epochs`` times its source, and the excess goes to the others by weight.
    That is water-filling: with sources sorted by limit per unit of weight, the first k are full and the rest share what
    is left by weight.  Too few or too many full ones give a lower share, so the level is the greatest over all k.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    pick = (lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int")))
    ranked = sizes.withColumn("k", rank).withColumn("weight", pick([float(w) for w in weights], F.col("k")))
    ranked = ranked.withColumn("w0", pick([float(a) for a, _ in ramps], F.col("k"))).withColumn(
        "w1", pick([float(b) for _, b in ramps], F.col("k")))
    limit = (F.col("source_size") * epochs).cast("double")
    ranked = ranked.withColumn("limit", limit).withColumn("level", F.col("limit") / F.col("weight"))
    fullest = Window.orderBy("level", "k").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(fullest), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fullest), F.lit(0.0))
    return (ranked.withColumn("share", left / open_weight).withColumn("water", F.max("share").over(everything))
            .withColumn("target", F.least(F.col("limit"), F.col("water") * F.col("weight")))
            .select("source", "source_size", "n_docs", "target", "w0", "w1"))


def position(demand: Column, target: Column, w0: Column, w1: Column) -> Column:
    """Training time in [0, 1] at which a source's cumulative demand reaches ``demand`` words.

    The weight runs from w0 to w1 in a straight line, so the integral up to t is w0 t + (w1 - w0) t^2 / 2, scaled to
    ``target`` at t = 1; this solves for t.
    """
    wanted = demand / target * (w0 + w1) / 2
    root = F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) * wanted, F.lit(0.0)))
    return F.least(2 * wanted / (w0 + root), F.lit(1.0))


def assign(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
           ramps: tuple[tuple[float, float], ...] = RAMPS, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """The documents with ``_size``, ``_source_size``, ``_target``, ``_taken`` and ``_positions`` (one per time taken).

    A source is a stream of its documents in a fixed pseudo-random order, repeated; a document is taken in a
    round if the middle of its words lies before the target, so a source misses its target by half a document at most.
    The order needs no source in one task: documents fall into numbered buckets of about BUCKET_ROWS, words are summed
    per bucket, and a window runs inside a bucket only.

    Null texts have size 0 and are never taken; null sources are one source, last in rank; null ids share one
    place in the order; repeated rows are taken one by one; texts of any length count whole.  All columns are kept, but those named
    like a result give way to it; an empty table stays empty.
    """
    given, names = set_aside(docs)
    found = _assigned(given, weights, epochs, ramps, names[id_col], names[text_col], names[source_col])
    return found.select(*as_given(names, without=OWN), *OWN)


def _assigned(docs: DataFrame, weights: tuple[int, ...], epochs: int, ramps: tuple[tuple[float, float], ...], id_col: str,
              text_col: str, source_col: str) -> DataFrame:
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    base = docs.select("*", source.alias("_source"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"),
                       order_key(F.col(id_col)).alias("_place"))
    sums = base.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"),
                                                              F.count("*").alias("n_docs"))
    targets = keep(source_targets(keep(sums), weights, epochs, ramps)).withColumnsRenamed(
        {"source": "_name", "source_size": "_source_size", "target": "_target", "n_docs": "_docs", "w0": "_w0", "w1": "_w1"})
    if targets.count() <= BROADCAST_SOURCES:                  # else Spark chooses
        targets = F.broadcast(targets)
    placed = base.join(targets, F.col("_source").eqNullSafe(F.col("_name")))
    bucket = F.floor(F.col("_place") * F.ceil(F.col("_docs") / BUCKET_ROWS)).cast("bigint")
    placed = placed.withColumn("_bucket", bucket)
    sizes = placed.groupBy("_name", "_bucket").agg(F.sum("_size").alias("_words"))
    earlier = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_name", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_name", "_bucket").orderBy("_place", id_col, F.md5(F.coalesce(text, F.lit("")))).rowsBetween(
        Window.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    starts = starts.withColumnsRenamed({"_name": "_name2", "_bucket": "_bucket2"})
    joined = summed.join(starts, F.col("_name").eqNullSafe(F.col("_name2")) & (F.col("_bucket") == F.col("_bucket2")))
    middle = F.col("_start") + F.col("_before") + F.col("_size") / 2
    rounds = F.array(*[F.when((F.col("_size") > 0) & (middle + e * F.col("_source_size") < F.col("_target")),
                              position(middle + e * F.col("_source_size"), F.col("_target"), F.col("_w0"), F.col("_w1")))
                       for e in range(epochs)])
    return (joined.withColumn("_positions", F.array_compact(rounds))
            .withColumn("_taken", F.size("_positions") * F.col("_size"))
            .select(*[F.col(c) for c in docs.columns], *OWN))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, ramps: tuple[tuple[float, float], ...] = RAMPS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the documents' columns, a row for each time taken, sorted by training position over all ranges.

    Columns of any names stay as given; nulls, empty and long texts, repeated rows and an empty table as in ``assign``.
    """
    given, names = set_aside(docs)
    found = _assigned(given, weights, epochs, ramps, names[id_col], names[text_col], names[source_col])
    taken = found.select(*given.columns, F.explode("_positions").alias("_position"))
    return taken.orderBy("_position").select(*as_given(names))
