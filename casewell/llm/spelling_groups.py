"""Spelling variants: words one edit apart, found on a distributed trie."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casewell.llm.common import keep

#: Fixed value: the letters of a word, Latin with its first supplement.
LETTERS = r"[A-Za-zÀ-ÿ]"
TRIE_DEPTH = 48                 # words up to this length go through the trie, longer ones by the texts left after a deletion
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_words(text: Column) -> Column:
    """The runs of letters of a text, A-Z in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[^a-zÀ-ÿ]+"), "")


def misspell(word: Column, key: Column, one_in: int) -> Column:
    """The word without one letter if the checksum of ``key:word`` is a multiple of ``one_in``; the checksum chooses it."""
    check = F.crc32(F.concat(key.cast("string"), F.lit(":"), word).cast("binary"))
    at = (check % F.length(word)).cast("int")
    less = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(check % one_in == 0, less).otherwise(word)


def count_words(docs: DataFrame, words: Column, shortest: int, least: int) -> DataFrame:
    """``word``, ``n``: the words of at least ``shortest`` code points that occur ``least`` times or more."""
    each = docs.select(F.explode(words).alias("word")).where(F.length("word") >= shortest)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _edges(words: DataFrame, shallowest: int) -> DataFrame:
    """The trie's edges from a depth on: a prefix (``node``), a letter that follows it in some word and the one ``after``; empty
    where a word ends."""
    steps = F.sequence(F.lit(shallowest), F.length("word"))
    letter = lambda k: F.substring("word", F.col("depth") + k, F.lit(1))
    placed = words.where(F.length("word") >= shallowest).select("side", "word", F.explode(steps).alias("depth"))
    return placed.select("side", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), letter(1).alias("letter"),
                         letter(2).alias("after")).distinct()


def _trie_pairs(words: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of words one edit apart, each at least once, by walking all words down the trie together.

    A state is (word, position, node, edits): the word's letters up to the position have led to the node with that many
    edits.  Each level joins the states that stand on nodes of that depth with the edge table: a state without edits goes
    on by its own letter, leaves out a letter, or takes another letter that sorts after its own; a state with one edit
    follows its own letters; all go only where the letter after leads on.  Insertions are the deletions of the
    other word, and so are half the replacements.  Edits are tried in the second half of a word only, where few words
    share a node; the first half is the second of the word read backwards, in a trie of its own.
    """
    both = words.select(F.lit(0).alias("side"), "word").union(words.select(F.lit(1).alias("side"), F.reverse("word").alias("word")))
    size = F.length("word")
    half = F.when(F.col("side") == 0, F.floor(size / 2)).otherwise(F.ceil(size / 2)).cast("int")
    entering = keep(both.select("side", "word", half.alias("position"), F.substring("word", F.lit(1), half).alias("node"),
                                F.lit(0).alias("edits")))
    depths = [r[0] for r in entering.select("position").distinct().collect()]       # TRIE_DEPTH values at most
    last = words.agg(F.max(F.length("word"))).first()[0] or 0
    trie = keep(_edges(both, min(depths, default=0)))
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, states = [], None
    for depth in range(min(depths, default=last + 1), last + 1):
        if states is not None and depth > max(depths) and states.isEmpty():
            break
        here = entering.where(F.col("position") == depth)
        if states is not None:
            here = here.unionByName(states).coalesce(parts)       # else partitions add up from level to level
        stay, skip = F.struct("position", "edits"), F.struct((F.col("position") + 1).alias("position"), F.lit(1).alias("edits"))
        both_ways = F.when((F.col("edits") == 0) & (F.col("position") < size), F.array(stay, skip)).otherwise(F.array(stay))
        here = here.select("side", "word", "node", F.explode(both_ways).alias("at")).select("side", "word", "node", "at.*")
        here = here.withColumns({n: F.substring("word", F.col("position") + k, F.lit(1)) for n, k in (("own", 1), ("ahead", 2))})
        # what stands at a word's end without an edit has nothing left to change
        here = here.where((F.col("edits") == 1) | (F.col("own") != ""))
        edges = trie.where(F.col("depth") == depth).select("side", "node", "letter", F.col("after").alias("ahead"))
        takes = F.when(F.col("edits") == 0, F.col("letter") >= F.col("own")).otherwise(F.col("letter") == F.col("own"))
        now = keep(here.join(edges, ["side", "node", "ahead"]).where(takes).select(
            "side", "word", (F.col("position") + 1).alias("position"), F.concat("node", "letter").alias("node"),
            (F.col("edits") + (F.col("letter") != F.col("own")).cast("int")).alias("edits"), (F.col("letter") == "").alias("arrived")))
        found.append(now.where("arrived").select("side", "word", "node"))
        states = now.where(~F.col("arrived")).drop("arrived")
    if not found:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).where("false")
    ends = reduce(DataFrame.union, found)
    turned = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    return ends.select(turned("word").alias("a"), turned("node").alias("b"))


def _long_pairs(words: DataFrame, longer_than: int) -> DataFrame:
    """Pairs (``a``, ``b``) one edit apart of which one is longer than ``longer_than``, by what is left after a deletion.

    Two words of equal length are near if they agree once the same place is left out, two of unequal length if
    the longer one without a letter is the other.  Rows that meet are near, so no key gathers unrelated words.
    """
    long = words.where(F.length("word") > longer_than)
    left = long.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")).select(
        "word", "at", F.concat(F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, F.length("word")))
        .alias("rest"))
    key = F.struct(F.xxhash64("rest"), F.hash("rest"), F.length("rest"))
    coded = left.select("word", "at", key.alias("rest"))
    target = words.where(F.length("word") >= longer_than).select(
        F.col("word").alias("b"), F.struct(F.xxhash64("word"), F.hash("word"), F.length("word")).alias("rest"))
    shorter = coded.join(target, "rest").select(F.col("word").alias("a"), "b")
    other = coded.select(F.col("word").alias("b"), "at", "rest")
    equal = coded.join(other, ["at", "rest"]).where(F.col("word") < F.col("b")).select(F.col("word").alias("a"), "b")
    return shorter.union(equal)


def near_words(words: DataFrame, trie_depth: int = TRIE_DEPTH) -> DataFrame:
    """``word``, ``near``: all ordered pairs of the distinct words that differ by one inserted, deleted or replaced code point.

    Words of up to ``trie_depth`` code points are walked down a trie level by level; beyond, where a word would need a
    level per letter, words meet by what is left after a deletion.  Every pair is confirmed on the words.
    """
    words = words.select("word")
    pairs = _trie_pairs(words.where(F.length("word") <= trie_depth)).union(_long_pairs(words, trie_depth))
    sure = pairs.where(F.levenshtein("a", "b", 1) == 1)
    return sure.union(sure.select("b", "a")).distinct().toDF("word", "near")


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last word that is reached by following ``form``; a word without one is its own.

    Counts at least double on the way, so no way is circular; each round doubles the steps taken.
    """
    now = keep(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = keep(now.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variant_forms(words: DataFrame, times: int = 2, trie_depth: int = TRIE_DEPTH) -> DataFrame:
    """Each word's spelling variants: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``words`` has distinct ``word`` with its count ``n``.  ``form`` is the near word (one edit away) of largest count,
    the first in code-point order among equals, if it occurs at least ``times`` as often; else null.  ``root`` is the
    last word reached by forms, ``n_near`` the number of near words.  Other columns are ignored; null words
    are left out; without words the result is empty; words of any length count whole.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    words = keep(words.where("word is not null").select("word", F.col("n").cast("bigint").alias("n")))
    pairs = near_words(words, trie_depth)
    counted = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    forms = keep(joined.select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, -F.col("best.less")).alias("form_n")))
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3,
                      one_in: int = 97) -> DataFrame:
    """``variant_forms`` of the words of whole texts, some of them misspelt on purpose.

    A word of a document loses a letter if the checksum of its id and the word is a multiple of ``one_in`` (0: none does).
    Null and empty texts have no words; a null id counts as an empty one in the checksum; equal ids and
    repeated rows count like any others; the other columns are ignored; texts of any length count whole.
    """
    words, key = text_words(F.col(text_col)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    words = F.filter(words, lambda w: F.length(w) >= shortest)
    if one_in:
        words = F.transform(words, lambda w: misspell(w, key, one_in))
    return variant_forms(count_words(docs, words, shortest, least))
