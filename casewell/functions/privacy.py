"""De-identification of single values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mask_words(c: Column) -> Column:
    """Keep the first and last letter of every word: ``John Doe`` -> ``J**n D*e``."""
    def mask(w: Column) -> Column:
        n = F.length(w)
        return (F.when(n <= 1, w)
                .when(n == 2, F.concat(F.substring(w, 1, 1), F.lit("*")))
                .otherwise(F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(w, F.lit(1)))))
    words = F.split(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")), " ")
    return F.array_join(F.transform(words, mask), " ")


def salted_hash(c: Column, salt: str) -> Column:
    """``HASH_`` and 10 hex digits of a salted SHA-256; case and outer space do not matter."""
    text = F.concat(F.lit(salt + ":"), F.lower(F.trim(c.cast("string"))))
    return F.concat(F.lit("HASH_"), F.upper(F.substring(F.sha2(text, 256), 1, 10)))
