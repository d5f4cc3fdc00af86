"""De-identification of the personal columns of a case list."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from casewell.functions.privacy import mask_words, salted_hash
from casewell.lexicon import PERSONAL_TAGS
from casewell.operators.numbering import dense_number


def personal_columns(df: DataFrame, tags: dict[str, str], fields: Sequence[str] = PERSONAL_TAGS) -> list[str]:
    """Columns bound to the personal tags."""
    return [c for c in dict.fromkeys(tags.get(t) for t in fields) if c in df.columns]


def pseudonyms(df: DataFrame, column: str, prefix: str = "PATIENT_") -> DataFrame:
    """``(value, pseudonym)``: values numbered by first appearance."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min("row_id").alias("first_row"))
    numbered = dense_number(firsts, "first_row")
    digits = F.col("number").cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return numbered.select("value", F.concat(F.lit(prefix), padded).alias("pseudonym"))


def pseudonymize(df: DataFrame, column: str) -> DataFrame:
    table = pseudonyms(df, column)
    return (df.join(table, F.col(column) == F.col("value"), "left").withColumn(column, F.col("pseudonym"))
            .select(*df.columns))


def anonymize(df: DataFrame, tags: dict[str, str], method: str = "pseudonymize",
              fields: Sequence[str] = PERSONAL_TAGS, salt: str | None = None) -> DataFrame:
    """``pseudonymize``, ``mask``, ``hash`` (needs a salt) or ``drop`` the personal columns."""
    columns = personal_columns(df, tags, fields)
    if method == "drop":
        return df.drop(*columns)
    if method == "hash" and not salt:
        raise ValueError("hashing needs a secret salt")
    for c in columns:
        if method == "pseudonymize":
            df = pseudonymize(df, c)
        elif method in ("mask", "hash"):
            df = df.withColumn(c, mask_words(F.col(c)) if method == "mask" else salted_hash(F.col(c), salt))
        else:
            raise ValueError(f"unknown method: {method}")
    return df
