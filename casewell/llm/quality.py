"""Quality rules by divergence from language references, with column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casewell.llm.common import WORD_GAPS, as_given, keep, set_aside, word_list

COMMON_WORDS = 30               # of each language
BROADCAST_LANGUAGES = 10_000    # languages up to which their references (about 1 kB each) are broadcast
LISTED_LANGUAGES = 64           # up to which words are looked up in one set before, which saves work only
#: Signs that count as symbols.
SYMBOLS = "#*$%&|<>"
ANY_LANGUAGE = "*"
CLASSES = ("lower", "upper", "digit", "symbol", "other")


@dataclass(frozen=True)
class Limits:
    """Greatest Jensen-Shannon distances (0..1), the lengths from which they count, and the words a language needs for a reference.

    A language with fewer than ``least_reference`` words would be its own yardstick.  Its texts are judged by their share of symbols
    alone: where it is above that of the whole table, the distance of symbols and the rest counts.
    """

    classes: float = 0.30
    words: float = 0.45
    min_chars: int = 200
    min_words: int = 40
    least_reference: int = 0


PRODUCTION = Limits(least_reference=2_000)


def _without(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def class_counts(text: Column) -> dict[str, Column]:
    """Characters of each class; white space is in none."""
    whole = F.coalesce(text, F.lit(""))
    left = F.regexp_replace(whole, r"\p{Ll}+", "")
    no_upper = F.regexp_replace(left, r"\p{Lu}+", "")
    visible = F.length(F.translate(no_upper, WORD_GAPS, ""))
    symbol = _without(no_upper, SYMBOLS)
    digit = _without(no_upper, "0123456789")
    return {"lower": F.length(whole) - F.length(left), "upper": F.length(left) - F.length(no_upper), "digit": digit,
            "symbol": symbol, "other": visible - symbol - digit}


def _distance(mine: list[Column], theirs: list[Column]) -> Column:
    """Jensen-Shannon distance (base 2) of two distributions given bin by bin."""
    parts = []
    for p, q in zip(mine, theirs):
        m = (p + q) / 2
        parts.append(F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0))
    return F.sqrt(F.greatest(sum(parts[1:], parts[0]) / 2, F.lit(0.0)))


def reference_table(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Per language and for the whole table (``_whole``): shares of the character classes and of the COMMON_WORDS commonest words.

    One count of (language, word) over all documents gives both, as a word's classes follow from the word.
    A row for every language, however many; nothing is gathered.
    """
    words = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.explode(word_list(F.col(text_col).cast("string"))).alias("word"))
    counts = keep(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    kinds = class_counts(F.col("word"))
    kept = counts.select("lang", F.lower("word").alias("word"), "n", *[(c * F.col("n")).alias(k) for k, c in kinds.items()])
    numbers = ["n", *CLASSES]
    sums = kept.groupBy("lang").agg(*[F.sum(c).alias(c) for c in numbers])
    totals = kept.agg(*[F.sum(c).alias(c) for c in numbers]).where("n > 0")
    sums = sums.select(F.lit(False).alias("_whole"), F.col("lang").alias("_ref"), *numbers).union(
        totals.select(F.lit(True), F.lit(ANY_LANGUAGE), *numbers))
    group = F.explode(F.array(F.struct(F.lit(True).alias("w"), F.lit(ANY_LANGUAGE).alias("r")),
                              F.struct(F.lit(False).alias("w"), F.col("lang").alias("r"))))
    by_word = kept.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 1").select(group.alias("g"), "word", "n")
    by_word = by_word.groupBy(F.col("g.w").alias("w"), F.col("g.r").alias("r"), "word").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("w", "r").orderBy(F.desc("n"), "word")
    common = by_word.withColumn("k", F.row_number().over(first)).where(F.col("k") <= COMMON_WORDS).groupBy("w", "r").agg(
        F.sort_array(F.collect_list(F.struct("k", "word", F.col("n").alias("count")))).alias("top"))
    found = sums.join(common, (F.col("_whole") == F.col("w")) & (F.col("_ref") == F.col("r")), "left")
    signs = F.greatest(sum((F.col(c) for c in CLASSES), F.lit(0)), F.lit(1))
    top = F.coalesce("top", F.array().cast("array<struct<k:int,word:string,count:bigint>>"))
    return found.select("_whole", "_ref", F.col("n").alias("_ref_size"), F.array(*[F.col(c) / signs for c in CLASSES]).alias("_ref_classes"),
                        F.transform(top, lambda x: x["word"]).alias("_ref_words"),
                        F.transform(top, lambda x: x["count"] / F.col("n")).alias("_ref_shares"))


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[dict]:
    """``reference_table`` as a list, the whole table first; for tables with few languages."""
    return [{"lang": r["_ref"], "size": r["_ref_size"], "classes": r["_ref_classes"], "words": r["_ref_words"], "shares": r["_ref_shares"]}
            for r in reference_table(docs, lang_col, text_col).orderBy(F.desc("_whole"), "_ref").collect()]


def _as_table(spark: SparkSession, found: list[dict]) -> DataFrame:
    """The listed references as a table; the first one named ANY_LANGUAGE is that of the whole table."""
    names = [r["lang"] for r in found]
    rows = [(r["lang"] == ANY_LANGUAGE and ANY_LANGUAGE not in names[:k], r["lang"], r["size"], r["classes"], r["words"], r["shares"])
            for k, r in enumerate(found)]
    return spark.createDataFrame(rows, "_whole boolean, _ref string, _ref_size bigint, _ref_classes array<double>, _ref_words array<string>, "
                                       "_ref_shares array<double>")


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_words`` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all with ``_``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.withColumn("_text", text).withColumn("_words", word_list(text))
    size = F.size("_words")
    # hashes of all 5-word windows; equal windows of a text have equal hashes
    window = F.transform(F.sequence(F.lit(1), size - 4), lambda k: F.xxhash64(
        *[F.element_at("_words", k + d) for d in range(5)]))
    filled = F.filter(F.split("_text", "\n"), lambda line: F.translate(line, WORD_GAPS, "") != "")
    measured = words.withColumn("_n_words", size.cast("bigint")).withColumn(
        "_windows", F.when(size >= 5, window).otherwise(F.array().cast("array<bigint>"))).withColumn("_lines", filled)
    # positions of windows that occur again: neighbours in the sorted (hash, position) list
    pairs = F.transform("_windows", lambda h, k: F.struct(h.alias("h"), k.alias("k")))
    measured = measured.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(pairs)))
    both = F.zip_with(F.slice("_sorted", 1, F.size("_sorted") - 1), F.slice("_sorted", 2, F.size("_sorted") - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["k"], b["k"])))
    measured = measured.withColumn("_again", F.sort_array(F.array_distinct(F.flatten(F.array_compact(both)))))
    gaps = F.zip_with("_again", F.slice("_again", 2, F.greatest(F.size("_again") - 1, F.lit(0))),
                      lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0))
    return measured.withColumns({
        "_word_chars": F.length(F.translate("_text", WORD_GAPS, "")).cast("bigint"),
        "_n_symbols": _without(F.col("_text"), SYMBOLS).cast("bigint"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_n_repeat_words": repeated.cast("bigint"),
    }).drop("_windows", "_lines", "_sorted", "_again")


OWN = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_class_distance",
       "_word_distance", "_kept")


def judge(docs: DataFrame, found: DataFrame | list[dict], limits: Limits = Limits(), lang_col: str = "lang",
          text_col: str = "text") -> DataFrame:
    """The documents with ``_`` columns: the base counts, ``_base_failed``, ``_class_distance``, ``_word_distance``, ``_kept``.

    ``found`` comes from ``reference_table`` or ``references``.  A document passes if the base rules hold and neither histogram is further from
    its language's reference than the limit; a histogram of a text below the least length is not judged.

    Null texts are empty and fail the base rules; a language without a reference is held against the whole
    table (or by ``limits.least_reference``, as a small one); a null language counts as one; repeated rows are judged alike; all
    columns are kept, but those named like a result give way to it; an empty table stays empty.  Texts of any length count whole.
    """
    given, names = set_aside(docs)
    judged = _judged(given, found, limits, names[lang_col], names[text_col])
    return judged.select(*as_given(names, without=OWN), *OWN)


def _judged(docs: DataFrame, found: DataFrame | list[dict], limits: Limits, lang_col: str, text_col: str) -> DataFrame:
    refs = keep(found if isinstance(found, DataFrame) else _as_table(docs.sparkSession, found))
    whole = refs.where("_whole").first()                      # one row
    refs = refs.where("not _whole").drop("_whole")
    number = refs.count()
    measured = base_measures(docs, text_col).withColumn("_ref_key", F.coalesce(F.col(lang_col).cast("string"), F.lit("")))
    kinds = class_counts(F.col("_text"))
    measured = measured.withColumns({f"_{k}": c.cast("double") for k, c in kinds.items()})
    listed = F.col("_words")
    if number <= LISTED_LANGUAGES:
        names = {w for r in [whole, *refs.collect()] if r for w in r["_ref_words"]}
        listed = F.filter(listed, lambda w: F.lower(w).isin(sorted(names) or [""]))
    measured = measured.withColumn("_listed", F.transform(listed, F.lower))
    joined = measured.join(F.broadcast(refs) if number <= BROADCAST_LANGUAGES else refs, F.col("_ref_key") == F.col("_ref"), "left")
    if whole:
        joined = joined.withColumns({c: F.coalesce(c, F.array(*map(F.lit, whole[c])).cast(kind)) for c, kind in (
            ("_ref_classes", "array<double>"), ("_ref_words", "array<string>"), ("_ref_shares", "array<double>"))})
    places = F.sort_array(F.filter(F.transform("_listed", lambda w: F.array_position("_ref_words", w)), lambda k: k > 0))
    joined = joined.withColumn("_places", places).withColumn("_bins", F.array_distinct("_places"))
    # a bin's count is the distance between the first places of it and of the next bin
    firsts = F.transform("_bins", lambda k: F.array_position("_places", k))
    joined = joined.withColumn("_firsts", firsts)
    after = F.concat(F.slice("_firsts", 2, F.greatest(F.size("_firsts") - 1, F.lit(0))), F.array(F.size("_places") + 1))
    joined = joined.withColumn("_counts", F.zip_with("_firsts", after, lambda a, b: b - a))
    total = F.greatest(F.col("_n_words"), F.lit(1)).cast("double")
    mass = F.zip_with("_bins", "_counts", lambda k, n: F.struct((n / total).alias("p"), F.element_at("_ref_shares", k.cast("int")).alias("q")))
    joined = joined.withColumn("_mass", mass)
    half = (lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0))
    in_bins = F.aggregate("_mass", F.lit(0.0), lambda s, x: s + half(x["p"], (x["p"] + x["q"]) / 2) + half(x["q"], (x["p"] + x["q"]) / 2))
    seen_p = F.aggregate("_mass", F.lit(0.0), lambda s, x: s + x["p"])
    seen_q = F.aggregate("_mass", F.lit(0.0), lambda s, x: s + x["q"])
    all_q = F.aggregate("_ref_shares", F.lit(0.0), lambda s, x: s + x)
    joined = joined.withColumns({"_in": in_bins, "_p": seen_p, "_q": seen_q, "_all_q": all_q})
    rest_p, rest_q = 1 - F.col("_p"), 1 - F.col("_all_q")
    middle = (rest_p + rest_q) / 2
    # bins that the text lacks add q * log2(q / (q / 2)) = q each
    words = F.sqrt(F.greatest((F.col("_in") + F.col("_all_q") - F.col("_q") + half(rest_p, middle) + half(rest_q, middle)) / 2,
                              F.lit(0.0)))
    chars = F.greatest(F.col("_word_chars"), F.lit(1)).cast("double")
    classes = _distance([F.col(f"_{k}") / chars for k in CLASSES],
                        [F.element_at("_ref_classes", k + 1) for k in range(len(CLASSES))])
    small = F.coalesce("_ref_size", F.lit(0)) < limits.least_reference
    if whole:
        mine, theirs = F.col("_symbol") / chars, F.lit(whole["_ref_classes"][CLASSES.index("symbol")])
        classes = F.when(~small, classes).otherwise(F.when(mine > theirs, _distance([mine, 1 - mine], [theirs, 1 - theirs])))
    judged = joined.withColumns({
        "_class_distance": F.when(F.col("_word_chars") >= limits.min_chars, classes),
        "_word_distance": F.when((F.col("_n_words") >= limits.min_words) & ~small, words),
        "_base_failed": (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words")),
    })
    fine = (F.coalesce(F.col("_class_distance") <= limits.classes, F.lit(True))
            & F.coalesce(F.col("_word_distance") <= limits.words, F.lit(True)))
    return judged.withColumn("_kept", ~F.col("_base_failed") & fine).select(*docs.columns, *OWN)


def keep_good(docs: DataFrame, limits: Limits = PRODUCTION, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents that pass, judged by references of the same table; columns as given, whatever their names.

    Nulls, empty and long texts, repeated rows and an empty table as in ``judge``.
    """
    given, names = set_aside(docs)
    lang, text = names[lang_col], names[text_col]
    judged = _judged(given, reference_table(given, lang, text), limits, lang, text)
    # a filter is not pushed through a row number; pushed down, it would repeat the whole rule at every step
    return judged.withColumn("_row", F.monotonically_increasing_id()).where("_kept and _row >= 0").select(*as_given(names))
