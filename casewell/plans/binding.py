"""Schema binding: headers to identifiers, tags and roles.

Only header names are handled here, a few dozen strings on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from casewell.functions.similarity import ratio_scores, token_sort_scores
from casewell.lexicon import (
    DATE_HEADER_HINTS, GAZETTEER_ROLES, LAT_HEADER_HINTS, LAT_HEADER_NAMES, LON_HEADER_HINTS, LON_HEADER_NAMES,
    PLACE_HEADER_HINTS, TAG_BY_NAME, TAGS, Tag, identifier,
)

BIND_THRESHOLD = 0.78


@dataclass(frozen=True)
class Binding:
    column: str
    tag: str | None
    score: float
    label: str
    category: str

    @property
    def is_mapped(self) -> bool:
        return self.tag is not None


def unique_identifiers(headers: Sequence[str]) -> list[tuple[str, str]]:
    """``(old, new)`` pairs in column order; repeated names get ``_1``, ``_2`` ..."""
    taken: set[str] = set()
    pairs = []
    for header in headers:
        base = name = identifier(header)
        n = 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        pairs.append((header, name))
    return pairs


def standardize_headers(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    pairs = unique_identifiers(df.columns)
    return df.toDF(*[new for _, new in pairs]), pairs


def best_tag(column: str, threshold: float = BIND_THRESHOLD, custom: Mapping[str, str] | None = None,
             tags: Sequence[Tag] = TAGS) -> tuple[str | None, float]:
    """Best tag of a header and its score (0 to 1); no tag below ``threshold``.

    A custom mapping comes first (raw or cleaned header), then an equal tag name or
    spelling, then the most similar spelling; the earlier tag wins a tie.
    """
    name = identifier(column)
    known = {t.name for t in tags}
    for key, tag in (custom or {}).items():
        if tag in known and (key == column or identifier(key) == name):
            return tag, 1.0
    if name in known:
        return name, 1.0
    pairs = [(t.name, s) for t in tags for s in t.spellings]
    for tag, spelling in pairs:
        if spelling == name:
            return tag, 1.0
    spellings = [s for _, s in pairs]
    scores = np.maximum(ratio_scores([name] * len(pairs), spellings), token_sort_scores([name] * len(pairs), spellings))
    top = int(scores.argmax())
    score = float(scores[top]) / 100.0
    return (pairs[top][0] if score >= threshold else None), score


def bind_columns(columns: Iterable[str], threshold: float = BIND_THRESHOLD, custom: Mapping[str, str] | None = None,
                 tags: Sequence[Tag] = TAGS) -> list[Binding]:
    """Bind columns to tags: exact matches first, then similar ones; a tag is used once."""
    columns = list(columns)
    by_name = {t.name: t for t in tags}
    found = {c: best_tag(c, threshold, custom, tags) for c in columns}
    taken: set[str] = set()
    chosen: dict[str, str] = {}
    for exact in (True, False):
        for c in columns:
            tag, score = found[c]
            if c in chosen or tag is None or tag in taken or (exact and score < 1.0):
                continue
            chosen[c] = tag
            taken.add(tag)
    return [
        Binding(c, chosen[c], found[c][1], by_name[chosen[c]].label, by_name[chosen[c]].category) if c in chosen
        else Binding(c, None, found[c][1] if found[c][0] else 0.0, "Unmapped", "unclassified")
        for c in columns
    ]


def tag_columns(bindings: Iterable[Binding]) -> dict[str, str]:
    """``tag -> column``."""
    return {b.tag: b.column for b in bindings if b.tag}


def bindings_table(spark: SparkSession, bindings: Sequence[Binding]) -> DataFrame:
    return spark.createDataFrame(
        [(b.column, b.tag, b.score, b.label, b.category, b.is_mapped) for b in bindings],
        "column_name string, mapped_tag string, score double, label string, category string, is_mapped boolean")


def date_columns(columns: Sequence[str], tags: Mapping[str, str]) -> list[str]:
    """Date columns by tag, then by header wording; in column order, so the choice is stable."""
    tagged = {c for t, c in tags.items() if t in TAG_BY_NAME and TAG_BY_NAME[t].kind == "date"}
    return [c for c in columns if c in tagged or any(h in c.lower() for h in DATE_HEADER_HINTS)]


def primary_date(columns: Sequence[str], tags: Mapping[str, str]) -> str | None:
    """Date the epidemiological week is taken from."""
    for tag in ("date_admission", "date_onset", "date_consultation"):
        if tags.get(tag) in columns:
            return tags[tag]
    found = date_columns(columns, tags)
    return found[0] if found else None


def place_columns(columns: Sequence[str], tags: Mapping[str, str]) -> dict[str, str]:
    """Geocoding level -> column, by tag and else by header wording."""
    roles = {
        "locality": tags.get("admin3") or tags.get("health_facility"),
        "admin3": tags.get("admin3"), "admin2": tags.get("admin2"), "admin1": tags.get("admin1"),
    }
    for role, hints in PLACE_HEADER_HINTS.items():
        if not roles[role]:
            roles[role] = next((c for c in columns if any(h in c.lower() for h in hints)), None)
    levels = {"locality": "Locality", "admin3": "Admin3_Ward", "admin2": "Admin2_LGA", "admin1": "Admin1_State"}
    return {levels[r]: c for r, c in roles.items() if c}


def coordinate_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """Latitude and longitude columns by header wording."""
    lat = next((c for c in columns if any(h in c.lower() for h in LAT_HEADER_HINTS) and "long" not in c.lower()), None)
    lon = next((c for c in columns if any(h in c.lower() for h in LON_HEADER_HINTS)), None)
    lat = lat or next((c for c in columns if c.lower().strip() in LAT_HEADER_NAMES), None)
    lon = lon or next((c for c in columns if c.lower().strip() in LON_HEADER_NAMES), None)
    return lat, lon


def gazetteer_roles(columns: Sequence[str], mapping: Mapping[str, str] | None = None) -> dict[str, str]:
    """Gazetteer role -> column: equal identifiers, then contained ones; a given mapping wins.

    Short coordinate spellings such as ``x`` only count when equal.
    """
    names = {c: identifier(c) for c in columns}
    roles: dict[str, str] = {}
    used: set[str] = set()
    for exact in (True, False):
        for role, spellings in GAZETTEER_ROLES.items():
            if role in roles:
                continue
            for c in columns:
                fits = names[c] in spellings if exact else any(len(s) > 3 and s in names[c] for s in spellings)
                if c not in used and fits:
                    roles[role] = c
                    used.add(c)
                    break
    roles.update({r: c for r, c in (mapping or {}).items() if c in columns})
    return roles
