"""Age expressions, units and bands."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F

from casewell.functions.text import is_missing, let, round_half_up, strip, strip_accents

DEFAULT_BREAKS = (0, 5, 15, 30, 50, 65, 80)
DAYS_PER_YEAR = 365.25

# Unit words.
MONTH_UNITS = "m|mo|mos|month|months|mois|mes|meses"
DAY_UNITS = "d|day|days|jour|jours|dia|dias|j"
WEEK_UNITS = "w|wk|wks|week|weeks|semaine|semaines|sem"
YEAR_UNITS = "y|yr|yrs|yo|year|years|an|ans|ano|anos|a"

_AGE = rf"^(\d+(?:\.\d+)?)\s*({MONTH_UNITS}|{DAY_UNITS}|{WEEK_UNITS}|{YEAR_UNITS})?$"


def _plausible(years: Column) -> Column:
    return let(years, lambda y: F.when(y.between(0, 120), round_half_up(y, 2)))


def _text(c: Column) -> Column:
    return F.translate(strip_accents(F.lower(strip(c.cast("string")))), ",", ".")


def _by_unit(n: Column, months: Column, days: Column, weeks: Column) -> Column:
    return (F.when(months, n / 12.0).when(days, n / DAYS_PER_YEAR)
            .when(weeks, n * 7 / DAYS_PER_YEAR).otherwise(n))


def age_unit_of(c: Column) -> Column:
    """Unit an age expression is written in: Years, Months, Weeks or Days."""
    def named(unit: Column) -> Column:
        return (F.when(unit.rlike(f"^({MONTH_UNITS})$"), "Months").when(unit.rlike(f"^({DAY_UNITS})$"), "Days")
                .when(unit.rlike(f"^({WEEK_UNITS})$"), "Weeks").otherwise("Years"))
    return F.when(parse_age(c).isNotNull(), let(F.regexp_extract(_text(c), _AGE, 2), named))


def parse_age(c: Column) -> Column:
    """Age in years from text such as ``18 mois``, ``3w``, ``45 ans`` or ``7,5``."""
    def years(parts: Column) -> Column:
        n, unit = parts["n"], parts["unit"]
        return _plausible(_by_unit(n, unit.rlike(f"^({MONTH_UNITS})$"), unit.rlike(f"^({DAY_UNITS})$"),
                                   unit.rlike(f"^({WEEK_UNITS})$")))
    parts = let(_text(c), lambda s: F.struct(F.regexp_extract(s, _AGE, 1).try_cast("double").alias("n"),
                                             F.regexp_extract(s, _AGE, 2).alias("unit")))
    return F.when(~is_missing(c), let(parts, years))


def parse_age_with_unit(c: Column, unit: Column) -> Column:
    """Age in years where a second column names the unit.

    Weeks are tested before months so that ``semaines`` is not read as months.
    Text the unit cannot be applied to is parsed on its own.
    """
    n = F.translate(strip(c.cast("string")), ",", ".").try_cast("double")

    def years(u: Column) -> Column:
        weeks = u.contains("w") | u.contains("sem")
        months = ~weeks & u.contains("m")
        days = u.contains("d") | u.contains("jour")
        return _plausible(_by_unit(n, months, days, weeks))
    return F.coalesce(F.when(unit.isNotNull(), let(strip_accents(F.lower(F.trim(unit))), years)), parse_age(c))


def age_from_birth(birth: Column, onset: Column) -> Column:
    """Years between two dates; null when the birth is later."""
    days = F.datediff(onset, birth)
    return F.when(days >= 0, round_half_up(days / DAYS_PER_YEAR, 2))


def band_labels(breaks: Sequence[int]) -> list[str]:
    """``[0, 5, 15]`` -> ``['<5', '5-14', '15+']``."""
    cuts = sorted(set(breaks))
    labels = []
    for low, high in zip(cuts, cuts[1:]):
        if low == cuts[0] == 0:
            labels.append(f"<{high}")
        else:
            labels.append(str(low) if high - low == 1 else f"{low}-{high - 1}")
    return labels + [f"{cuts[-1]}+"]


def age_band(age: Column, breaks: Sequence[int] = DEFAULT_BREAKS, labels: Sequence[str] | None = None) -> Column:
    """Left-closed band label; null below the first break."""
    cuts = sorted(set(breaks))
    names = list(labels) if labels is not None and len(labels) == len(cuts) else band_labels(cuts)
    out = F.when(age < cuts[0], F.lit(None).cast("string"))
    for high, name in zip(cuts[1:], names):
        out = out.when(age < high, name)
    return out.when(age >= cuts[-1], names[-1])


def band_order(band: Column, breaks: Sequence[int] = DEFAULT_BREAKS, labels: Sequence[str] | None = None) -> Column:
    cuts = sorted(set(breaks))
    names = list(labels) if labels is not None and len(labels) == len(cuts) else band_labels(cuts)
    return F.array_position(F.array(*[F.lit(n) for n in names]), band)
