"""Reading case lists and gazetteers: delimited text, JSON and DataFrames.

All values stay text; missing-value tokens are handled by the cleaning step, so
that nothing is guessed while reading.  Every list gets a ``row_id``.
"""

from __future__ import annotations

import csv
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casewell.sources.records import join_splits, json_records, parse_json, quoted_records, read_pieces

DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES = 10


def _numbered(lines: DataFrame, titles: int = 0, valid: Column | None = None) -> DataFrame:
    """Pieces but for the first ``titles`` of every file, with ``row_id`` 1, 2, 3 ... by file, split and row, ``_inside`` and ``_utf8``
    (all pieces of the file are ``valid``).

    Only the small table of splits is put in order in one task; title lines lie in the split a file begins with.
    """
    splits = lines.groupBy("_file", "_block").agg(
        F.count("*").alias("_rows"), F.bool_and(F.lit(True) if valid is None else valid).alias("_valid"))
    top = F.when(F.col("_block") == 0, F.lit(titles)).otherwise(0)
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_top", top).select(
        "_file", "_block", "_top", F.min("_valid").over(Window.partitionBy("_file")).alias("_utf8"),
        F.coalesce(F.sum(F.greatest(F.col("_rows") - F.col("_top"), F.lit(0))).over(before), F.lit(0)).alias("_start"))
    joined = join_splits(lines, starts).withColumn("_inside", F.col("_row") - F.col("_top")).where("_inside >= 0")
    return joined.withColumn("row_id", F.col("_start") + F.col("_inside") + 1).drop("_top", "_start")


def _head(lines: DataFrame, n: int) -> list[str]:
    """The first ``n`` lines of the first file by name."""
    first = lines.agg(F.min("_file").alias("file")).first()
    if first["file"] is None:
        return []
    top = lines.where((F.col("_file") == first["file"]) & (F.col("_block") == 0) & (F.col("_row") < n)).orderBy("_row")
    data = [bytes(r[0]) for r in top.select(F.col("value").cast("binary")).collect()]
    try:
        return [line.decode("utf-8-sig") for line in data]
    except UnicodeDecodeError:
        return [line.decode("latin-1") for line in data]


def guess_delimiter(lines: Sequence[str]) -> str:
    """The delimiter that splits the lines most evenly into most fields; comma by default."""
    def votes(d: str) -> tuple[int, int]:
        widths = [len(r) for r in csv.reader([line for line in lines if line.strip()], delimiter=d)]
        common = max(set(widths), key=widths.count, default=1)
        return (widths.count(common) if common > 1 else 0, common)
    best = max(DELIMITERS, key=votes)
    return best if votes(best)[0] else ","


def guess_header_row(rows: Sequence[Sequence[str]]) -> int:
    """Row with most text cells longer than one character; the first one on ties."""
    def is_text(cell: str) -> bool:
        cell = (cell or "").strip()
        return len(cell) > 1 and not cell.replace(".", "", 1).replace("-", "", 1).isdigit()
    counts = [sum(is_text(c) for c in row) for row in rows[:HEAD_LINES]]
    return counts.index(max(counts)) if counts else 0


def _looks_untitled(header: Sequence[str]) -> bool:
    return sum(not h.strip() for h in header) > 0.5 * max(len(header), 1)


def _unique(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(n.strip() or f"column_{j + 1}" for j, n in enumerate(names)):
        key = name.lower()
        seen[key] = seen.get(key, 0) + 1
        out.append(name if seen[key] == 1 else f"{name}_{seen[key] - 1}")
    return out


def with_row_id(df: DataFrame, path: str | None = None, order: str | None = None) -> DataFrame:
    """Adds ``row_id``.

    ``order`` names a unique numeric column to use.  Rows of Parquet files are numbered 1, 2, 3 ... by
    file name and place in the file, so the number depends on neither splits nor scheduling.
    """
    if order:
        return df.withColumn("row_id", F.col(order).cast("bigint"))
    if path is None:
        raise ValueError("name a unique ordering column for a list that is not read from files")
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    files = placed.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_file").withColumn("row_id", F.col("_start") + F.col("_row") + 1).drop("_file", "_row", "_start")


def _header_lines(head: Sequence[str], skip: int, delimiter: str) -> tuple[list[str], int]:
    """The header's fields and the number of lines it takes."""
    reader = csv.reader([line + "\n" for line in head[skip:]], delimiter=delimiter)
    fields = next(reader, [])
    return [f.replace("\n", " ") for f in fields], reader.line_num


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    skip: int = 0,
    charset: str | None = None,
    find_header: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Delimited text with a header; delimiter, character set and header row are found when not given.

    Every file is UTF-8 unless one of its lines is not; then it is Latin-1.  ``skip`` drops title lines at the
    top of every file.  If more than half of the header is blank, the header is looked for among the first lines.
    ``multiline`` allows line breaks inside quotes, across splits too.  Files are scanned once; the
    rows of that scan are both counted and returned.
    """
    lines = read_pieces(spark, path, charset)
    head = _head(lines, skip + HEAD_LINES)
    delimiter = delimiter or ("\t" if path.endswith(".tsv") else guess_delimiter(head[skip:]))
    rows = list(csv.reader(head, delimiter=delimiter))
    if skip == 0 and find_header and len(rows) > 1 and _looks_untitled(rows[0]):
        skip = guess_header_row(rows[:HEAD_LINES])
    while skip < len(head) and not head[skip].strip(f"{delimiter} \t\r\""):       # blank lines above the header
        skip += 1
    header, taken = _header_lines(head, skip, delimiter) if multiline else (rows[skip] if len(rows) > skip else [], 1)
    names = _unique(header)
    if not names:
        raise ValueError(f"no header in {path}")
    schema = ", ".join(f"`{n.replace('`', '')}` string" for n in names)
    options = {"sep": delimiter, "mode": "PERMISSIVE", "escape": '"'}
    numbered = _numbered(lines, skip + taken, None if charset else F.is_valid_utf8("value"))
    text = F.col("value")
    if not charset:
        text = F.when(F.col("_utf8"), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))
    # Spark may test a caller's condition before title lines are gone, so it must find nothing in them
    text = F.when(F.col("_inside") >= 0, text).alias("value")
    if multiline:
        options["multiLine"] = "true"
        kept = quoted_records(numbered.select("_file", "_block", "_row", text)).select(F.col("record").alias("row_id"), "value")
    else:
        kept = numbered.select("row_id", text)
    parsed = kept.where(F.trim("value") != "").select("row_id", F.from_csv("value", F.lit(schema), options).alias("r"))
    return parsed.select("row_id", "r.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects in an array, one per line or one after another, with ``row_id`` 1, 2, 3 ... by file and place.

    Files are split wherever a brace closes, so an array is read by many tasks.
    """
    return parse_json(json_records(spark, path))


def promote_header(df: DataFrame, row_id: str, header_row: int) -> DataFrame:
    """Take row number ``header_row`` (1-based, in ``row_id`` order) as header and drop it and the rows above."""
    content = [c for c in df.columns if c != row_id]
    top = df.orderBy(row_id).limit(header_row).collect()          # a handful of title rows
    if len(top) < header_row:
        return df
    header, last = top[-1], top[-1][row_id]
    names = _unique([str(header[c] if header[c] is not None else "") for c in content])
    return df.where(F.col(row_id) > last).toDF(*[
        row_id if c == row_id else names[content.index(c)] for c in df.columns])


def load_cases(spark: SparkSession, source: str | DataFrame, skip: int = 0, order: str | None = None, **options) -> DataFrame:
    """A case list from a path (``.csv``, ``.tsv``, ``.json``, ``.parquet``) or a DataFrame, with ``row_id``."""
    if isinstance(source, DataFrame):
        df = source.toDF(*[c.strip() for c in source.columns])
        if "row_id" not in df.columns:
            df = with_row_id(df, order=order)
        return promote_header(df, "row_id", skip) if skip else df
    if source.rstrip("/").endswith(".json"):
        return read_json(spark, source, **options)
    if source.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(source)
        names = df.columns
        return df if "row_id" in names else with_row_id(df, source, order).select("row_id", *names)
    return read_delimited(spark, source, skip=skip, **options)


def load_gazetteer(spark: SparkSession, source: str | DataFrame, **options) -> DataFrame:
    """A gazetteer with its row order in ``ref_row``; an empty one is refused."""
    df = load_cases(spark, source, **options).withColumnRenamed("row_id", "ref_row")
    if df.isEmpty():
        raise ValueError("the gazetteer has no rows")
    return df
