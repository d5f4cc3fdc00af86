"""Closed categories: sex, case classification, outcome and yes/no fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casewell.functions.text import let, missing_tokens, one_of, token, word_map
from casewell.lexicon import (
    BINARY_WORDS, CASE_FRAGMENTS, CASE_WORDS, OUTCOME_FRAGMENTS, OUTCOME_WORDS, SEX_WORDS,
)


def _standardize(c: Column, words: dict, fallback) -> Column:
    """Known spelling, else missing token -> null, else the fallback rules."""
    def pick(t: Column) -> Column:
        known = F.element_at(word_map(words), t)
        guess = F.when(one_of(t, missing_tokens()), F.lit(None)).otherwise(fallback(t))
        return F.when(t != "", F.coalesce(known, guess))
    return let(token(c), pick)


def _by_fragment(groups) -> "callable":
    def pick(t: Column) -> Column:
        out = None
        for value, fragments in groups:
            hit = t.rlike("|".join(fragments))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise("Unknown")
    return pick


def standardize_sex(c: Column) -> Column:
    """Male, Female, Other, Unknown or null."""
    def fallback(t: Column) -> Column:
        return (F.when(t.startswith("m") & ~t.rlike("fem|muj"), "Male")
                .when(t.rlike("^[fw]|muj|fem"), "Female").otherwise("Unknown"))
    return _standardize(c, SEX_WORDS, fallback)


def standardize_case_definition(c: Column) -> Column:
    """Confirmed, Probable, Suspect, Discarded, Unknown or null."""
    return _standardize(c, CASE_WORDS, _by_fragment(CASE_FRAGMENTS))


def standardize_outcome(c: Column) -> Column:
    """Dead, Recovered, Discharged, Transferred, LAMA, Alive, Unknown or null."""
    return _standardize(c, OUTCOME_WORDS, _by_fragment(OUTCOME_FRAGMENTS))


def standardize_binary(c: Column) -> Column:
    """Yes, No, Unknown or null."""
    def fallback(t: Column) -> Column:
        return (F.when(t.rlike("^[yosv]"), "Yes").when(t.rlike("^[nf]"), "No").otherwise("Unknown"))
    return _standardize(c, BINARY_WORDS, fallback)
