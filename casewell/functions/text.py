"""Text helpers as column expressions (all JVM-side)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import Callable, Iterable

from pyspark.sql import Column, functions as F

from casewell.lexicon import MISSING_TOKENS, PLACE_STOPWORDS, strip_marks


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used several times inside one expression is repeated in the generated
    code each time; binding it keeps long text rules small and computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Precomposed letters -> base letters, derived from the Unicode database.

    Spark has no ``normalize`` function, so the one-to-one part becomes a
    ``translate`` call and the few one-to-many compatibility letters (ligatures)
    become ``replace`` calls.
    """
    src, dst, multi = [], [], []
    for lo, hi in ((0xA0, 0x250), (0x1E00, 0x1F00), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)):
        for code in range(lo, hi):
            ch = chr(code)
            base = strip_marks(ch)
            if base == ch or not base or not unicodedata.category(ch).startswith("L"):
                continue
            if len(base) == 1:
                src.append(ch)
                dst.append(base)
            else:
                multi.append((ch, base))
    return "".join(src), "".join(dst), tuple(multi)


def strip_accents(c: Column) -> Column:
    src, dst, multi = _fold_table()
    ligatures = [(ch, base) for ch, base in multi if ord(ch) >= 0xFB00 or ch in "ĳŉǆǉǌǳ"]

    def fold(text: Column) -> Column:
        folded = F.translate(text, src, dst)
        spelled = F.aggregate(
            F.split(F.lit("|".join(f"{ch}={base}" for ch, base in ligatures)), r"\|"), folded,
            lambda acc, p: F.replace(acc, F.substring_index(p, "=", 1), F.substring_index(p, "=", -1)))
        rare = "[" + "".join(ch for ch, _ in ligatures) + "]"
        return F.regexp_replace(F.when(folded.rlike(rare), spelled).otherwise(folded), r"\p{Mn}+", "")

    return let(c, lambda text: F.when(text.rlike(r"[^\x00-\x7F]"), fold(text)).otherwise(text))


#: White space that may surround a value.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def token(c: Column) -> Column:
    """Trimmed, lower-case, accent-free text with single spaces."""
    return squeeze(strip_accents(F.lower(strip(c.cast("string")))))


def blank_to_null(c: Column) -> Column:
    return F.when(not_blank(c), c)


def not_blank(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")) != "", F.lit(False))


def missing_tokens(extra: Iterable[str] = ()) -> list[str]:
    """The missing-value tokens plus custom ones, ready for ``isin``."""
    out = dict.fromkeys(t.strip().lower() for t in MISSING_TOKENS)
    out.update(dict.fromkeys(t.strip().lower() for t in extra))
    return list(out)


def one_of(c: Column, words: Iterable[str]) -> Column:
    """Membership in a fixed word list, sent as one literal."""
    return F.array_contains(F.split(F.lit("\u0001".join(words)), "\u0001"), c)


def is_missing(c: Column, extra: Iterable[str] = ()) -> Column:
    """Null, or one of the tokens that mean "no value"."""
    return c.isNull() | one_of(F.lower(strip(c.cast("string"))), missing_tokens(extra))


def place_name(c: Column) -> Column:
    """Comparable form of a place name; empty text when nothing is left."""
    words = "|".join(PLACE_STOPWORDS)
    s = strip_accents(F.lower(c))
    # one pass: runs of dropped words, punctuation and space become one space
    s = F.regexp_replace(s, rf"(?U)(?:\b(?:{words})\b|[^\w])+", " ")
    return F.coalesce(F.trim(s), F.lit(""))


def sorted_tokens(c: Column) -> Column:
    """Whitespace tokens in code-point order, joined by one space."""
    return F.array_join(F.array_sort(F.split(squeeze(c), " ")), " ")


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    ``initcap`` only looks at spaces, so each non-letter gets a marker and a
    space after it, which are taken out again afterwards.
    """
    marked = F.regexp_replace(F.lower(c), r"([^\p{L}])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def round_half_up(c: Column, digits: int) -> Column:
    """Half-up rounding by one multiplication; equal on every engine."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part`` in percent of ``whole``; zero when there is no whole."""
    ratio = part.cast("double") * 100.0 / whole.cast("double")
    return F.when(whole > 0, round_half_up(ratio, digits)).otherwise(F.lit(0.0))


def word_map(groups: dict[object, Iterable[str]]) -> Column:
    """Spelling -> value map from value -> spellings, sent as one literal."""
    pairs: dict[str, object] = {}
    for value, words in groups.items():
        for word in words:
            pairs.setdefault(word, value)
    return F.str_to_map(F.lit("\u0002".join(f"{w}\u0001{v}" for w, v in pairs.items())), F.lit("\u0002"), F.lit("\u0001"))
