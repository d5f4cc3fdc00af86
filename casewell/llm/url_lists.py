"""URL filter lists that change over time, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casewell.llm.common import as_given, set_aside

BROADCAST_SPANS = 100_000       # (pattern, month) spans up to which they are broadcast


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def keys_of(url: Column, labels: Column | None = None, segments: Column | None = None) -> Column:
    """All patterns that cover a URL: ``host`` and its parent domains, and ``host/path`` prefixes by whole segments.

    ``labels`` and ``segments`` are the most that a pattern has, if known; longer keys would meet none and are not made.
    """
    host = host_of(url)
    parts_of_host = F.split(host, r"\.")
    size = F.size(parts_of_host)
    first = F.lit(1) if labels is None else F.greatest(size - labels + 1, F.lit(1))
    domains = F.when(first <= size, F.transform(F.sequence(first, size), lambda k: F.concat_ws(".", F.slice(parts_of_host, k, size)))).otherwise(
        F.array().cast("array<string>"))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.size(parts) if segments is None else F.least(F.size(parts), segments)
    prefixes = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda k: F.concat(
        host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``pattern``, ``verdict``, ``valid_from``, ``valid_to`` (open end: null) of dated list entries.

    ``entries`` has ``pattern``, ``action`` ('add' or 'remove'), ``verdict`` and ``dated``.  An entry holds until the next
    entry of its pattern; on one day a removal comes first, then verdicts by name, so the last one holds.
    Entries without pattern or date are no entries; repeated entries change nothing.  Hosts are told apart without case, paths
    with it.
    """
    host = F.substring_index("pattern", "/", 1)
    good = entries.where("pattern is not null and dated is not null and action in ('add', 'remove')").select(
        F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1)).alias("pattern"), "action", "verdict", F.col("dated").cast("date").alias("dated")).distinct()
    later = Window.partitionBy("pattern").orderBy("dated", F.col("action") == "add", "verdict")
    spans = good.withColumn("valid_to", F.lead("dated").over(later)).where("action = 'add'")
    return spans.where("valid_to is null or dated < valid_to").select("pattern", "verdict", F.col("dated").alias("valid_from"), "valid_to")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """The captures with ``matched_pattern``, ``matched_verdict`` and ``blocked``, as the list stood on the day of the capture.

    Entries become validity intervals.  Captures meet the intervals of the patterns that cover them in an equi-join on pattern and
    month, so a busy pattern is spread over months, an interval is copied once a month, and Spark can split what is still hot.  Among the
    patterns in force the longest path wins over hosts and the longer host over its parents; verdict 'block' blocks.

    Every capture is kept, in any number of copies.  URLs without a host and captures without a date match nothing; without entries
    nothing is blocked; all columns are kept, but those named like a result give way to it; an empty table stays empty.  Of a URL only as many labels and segments are tried as the
    longest pattern has, so URLs may be of any length.
    """
    given, names = set_aside(captures)
    url, day = F.col(names[url_col]).cast("string"), F.col(names[day_col]).cast("date")
    seen = given.select(url.alias("_url"), day.alias("_day")).where(
        "_url is not null and _day is not null").distinct()
    first, last = (F.lit(day).cast("date") for day in seen.agg(F.min("_day"), F.max("_day")).first())   # no interval need reach further
    ends = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    spans = validity(entries).where((F.col("valid_from") <= last) & (ends >= first)).withColumn("_month", F.explode(F.sequence(
        _month(F.greatest("valid_from", first)), _month(ends))))
    found = spans.agg(F.count("*"), *[F.coalesce(F.max(c), F.lit(0)) for c in (
        F.size(F.split(F.substring_index("pattern", "/", 1), r"\.")), F.size(F.split("pattern", "/")) - 1)]).first()
    if found[0] <= BROADCAST_SPANS:                 # else Spark joins by shuffle
        spans = F.broadcast(spans)
    asked = seen.select("_url", "_day", _month(F.col("_day")).alias("_month"), F.explode(keys_of(
        F.col("_url"), F.lit(found[1]), F.lit(found[2]))).alias("pattern"))
    met = asked.join(spans, ["pattern", "_month"]).where("valid_from <= _day and (valid_to is null or _day < valid_to)")
    rank = F.struct(F.instr("pattern", "/") > 0, F.length("pattern"), "pattern", "verdict")
    best = met.groupBy("_url", "_day").agg(F.max(rank).alias("_best"))
    out = given.join(best, (url == F.col("_url")) & (day == F.col("_day")), "left")
    own = {"matched_pattern": F.col("_best.pattern"), "matched_verdict": F.col("_best.verdict"),
           "blocked": F.coalesce(F.col("_best.verdict") == "block", F.lit(False))}
    return out.select(*as_given(names, without=own), *[c.alias(name) for name, c in own.items()])
