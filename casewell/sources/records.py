"""Records of text files that are read in many splits.

A file is cut into pieces (lines, or what stands between closing braces) by one scan, whose rows are kept, so that
everything counted and everything read comes from the same splits.  What a piece means can depend on all pieces before
it: whether a quote is open, how deep the braces are.  Each split says what it does to that state from either start; only
the short table of splits is put in order, and then every piece knows its state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casewell.settings import ensure_checkpoint_dir

BROADCAST_SPLITS = 50_000       # file splits up to which their table is broadcast
MAX_PIECES = 1_000_000          # pieces of one record; more of them mean a quote or brace that is never closed
_TASK_ROWS = (1 << 33) - 1      # the bits of a monotonic id that count rows inside a task
_SPLIT = ("_file", "_block")


def read_pieces(spark: SparkSession, path: str, charset: str | None = None, separator: str | None = None) -> DataFrame:
    """The pieces of text files with ``_file``, ``_block`` (where their split begins) and ``_row`` (their place in it), kept
    from one scan.  Without a character set the bytes stay as they are."""
    ensure_checkpoint_dir(spark)
    reader = spark.read
    for name, value in (("encoding", charset), ("lineSep", separator)):
        reader = reader.option(name, value) if value else reader
    task_row = F.monotonically_increasing_id().bitwiseAND(F.lit(_TASK_ROWS))
    kept = reader.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                    F.col("_metadata.file_block_start").alias("_block"), task_row.alias("_at")).checkpoint()
    first = kept.groupBy(*_SPLIT).agg(F.min("_at").alias("_first"))
    return join_splits(kept, first).select("_file", "_block", (F.col("_at") - F.col("_first")).alias("_row"), "value")


def join_splits(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """Pieces with the columns of their split; the table of splits is broadcast only after a look at its size."""
    splits = splits.checkpoint()
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    return pieces.join(splits, list(_SPLIT))


def _before(column: str | Column, by: tuple[str, ...] = ()) -> Column:
    """The sum of ``column`` over all earlier splits (of the file, with ``by``)."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum(column).over(window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _inside(own: bool):
    """The pieces of a split up to a piece, itself included with ``own``."""
    return Window.partitionBy(*_SPLIT).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0 if own else -1)


def _joined(pieces: DataFrame, alone: Column, glue: str) -> DataFrame:
    """``record``, ``value``: the pieces of every record in order; pieces that are a record ``alone`` are not shuffled."""
    single, parts = pieces.where(alone).select("record", "value"), pieces.where(~alone)
    sizes = parts.groupBy("record").agg(F.count("*").alias("n")).where(F.col("n") > MAX_PIECES)
    if not sizes.isEmpty():
        raise ValueError("a quote or brace is opened and not closed")
    whole = parts.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("_block", "_row", "value"))).alias("all"))
    return single.unionByName(whole.select("record", F.array_join(F.transform("all", lambda x: x["value"]), glue).alias("value")))


def quoted_records(lines: DataFrame) -> DataFrame:
    """``record`` (1, 2, 3 ... by file and place), ``value``: lines joined while a double quote is open.

    Quotes are counted by the file: a line starts a record if the quotes before it are even.
    """
    text = F.col("value")
    lines = lines.withColumn("_odd", F.pmod(_count(text, '"'), F.lit(2)))
    lines = lines.withColumn("_open", F.pmod(F.coalesce(F.sum("_odd").over(_inside(False)), F.lit(0)), F.lit(2)))
    lines = lines.withColumn("_starts", F.array(
        F.sum((F.col("_open") == 0).cast("long")).over(_inside(True)), F.sum((F.col("_open") == 1).cast("long")).over(_inside(True)))).checkpoint()
    splits = lines.groupBy(*_SPLIT).agg(
        F.pmod(F.sum("_odd"), F.lit(2)).alias("odd"), *[F.sum((F.col("_open") == k).cast("long")).alias(f"n{k}") for k in (0, 1)])
    splits = splits.withColumn("_from", F.pmod(_before("odd", ("_file",)), F.lit(2)))
    splits = splits.withColumn("_base", _before(F.when(F.col("_from") == 0, F.col("n0")).otherwise(F.col("n1"))))
    lines = join_splits(lines, splits.select(*_SPLIT, "_from", "_base"))
    record = F.col("_base") + F.element_at("_starts", F.col("_from").cast("int") + 1)
    alone = (F.col("_open") == F.col("_from")) & (F.col("_odd") == 0)
    return _joined(lines.withColumn("record", record), alone, "\n")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _depth(text: Column) -> Column:
    """Opening less closing braces and brackets."""
    return _count(text, "{") + _count(text, "[") - _count(text, "}") - _count(text, "]")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (1, 2, 3 ... by file and place), ``value``: the JSON objects of arrays, of lines, or one after another.

    Files are cut after closing braces, wherever these stand, so that one array on one line is read by many tasks.  A cut
    ends a record if no string is open there and the depth is that of the file's outermost objects.  What follows the last
    whole object of a file is left out.
    """
    pieces = read_pieces(spark, path, separator="}")
    # strings stand between quotes that no backslash escapes; a piece is seen as one that starts outside a string, and inside one.
    # Each step is a column of its own, so that none is computed twice.
    plain = F.when(F.col("value").contains("\\"), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    pieces = pieces.withColumn("_plain", plain)
    without_strings = lambda text: F.regexp_replace(text, r'"[^"]*+(?:"|\z)', "")
    pieces = pieces.withColumns({
        "_odd": F.pmod(_count(F.col("_plain"), '"'), F.lit(2)),
        "_side0": without_strings(F.col("_plain")), "_side1": without_strings(F.concat(F.lit('"'), F.col("_plain")))}).drop("_plain")
    pieces = pieces.withColumns({f"_d{k}": _depth(F.col(f"_side{k}")) - (F.col("_odd") == k).cast("int") for k in (0, 1)}).drop("_side0", "_side1")
    pieces = pieces.withColumn("_open", F.pmod(F.coalesce(F.sum("_odd").over(_inside(False)), F.lit(0)), F.lit(2)))
    same, other = (F.when(F.col("_open") == k, F.col("_d0")).otherwise(F.col("_d1")) for k in (0, 1))
    pieces = pieces.withColumns({"_s0": F.sum(same).over(_inside(True)), "_s1": F.sum(other).over(_inside(True))}).checkpoint()
    splits = pieces.groupBy(*_SPLIT).agg(
        F.pmod(F.sum("_odd"), F.lit(2)).alias("odd"), F.max_by("_s0", "_row").alias("t0"), F.max_by("_s1", "_row").alias("t1"),
        F.max(F.when(F.col("_row") == 0, F.regexp_replace("value", r"^[\s\x{FEFF}]+", "").startswith("[").cast("long"))).alias("array"))
    splits = splits.withColumn("_from", F.pmod(_before("odd", ("_file",)), F.lit(2)))
    splits = splits.withColumn("_depth", _before(F.when(F.col("_from") == 0, F.col("t0")).otherwise(F.col("t1")), ("_file",)))
    splits = splits.withColumn("_outer", F.first("array").over(Window.partitionBy("_file").orderBy("_block")))
    pieces = join_splits(pieces, splits.select(*_SPLIT, "_from", "_depth", "_outer"))
    depth = F.col("_depth") + F.when(F.col("_from") == 0, F.col("_s0")).otherwise(F.col("_s1"))
    closed = F.pmod(F.col("_from") + F.col("_open") + F.col("_odd"), F.lit(2)) == 0
    pieces = pieces.withColumn("_end", (closed & (depth == F.col("_outer"))).cast("long"))
    pieces = pieces.withColumn("_ended", F.coalesce(F.sum("_end").over(_inside(False)), F.lit(0)))
    pieces = pieces.withColumn("_after", F.lag("_end").over(Window.partitionBy(*_SPLIT).orderBy("_row"))).select(
        *_SPLIT, "_row", "value", "_end", "_ended", "_after").checkpoint()
    totals = pieces.groupBy(*_SPLIT).agg(F.sum("_end").alias("n"))
    totals = totals.withColumn("_base", _before("n"))
    totals = totals.withColumn("_until", F.max(F.col("_base") + F.col("n")).over(Window.partitionBy("_file"))).drop("n")
    numbered = join_splits(pieces, totals).withColumn("record", F.col("_base") + F.col("_ended") + 1).where("record <= _until")
    alone = (F.col("_end") == 1) & F.coalesce(F.col("_after") == 1, F.lit(False))
    whole = _joined(numbered, alone, "}")
    return whole.select("record", F.concat(F.regexp_replace("value", r"^[\s,\[\x{FEFF}]+", ""), F.lit("}")).alias("value"))


def parse_json(records: DataFrame) -> DataFrame:
    """``row_id`` and the fields of JSON objects, all plain values as text; the fields are those of any record."""
    spark = records.sparkSession
    kept = records.checkpoint()
    folder = f"{spark.sparkContext.getCheckpointDir()}/json-{uuid.uuid4().hex}"
    kept.select(F.translate("value", "\r\n", "  ").alias("value")).write.text(folder)
    schema = spark.read.json(folder, primitivesAsString=True).schema
    parsed = F.from_json("value", schema, {"primitivesAsString": "true"})
    return kept.select(F.col("record").alias("row_id"), parsed.alias("r")).select("row_id", "r.*")
