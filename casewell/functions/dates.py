"""Date parsing and epidemiological weeks as column expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, functions as F

from casewell.functions.text import is_missing, let, strip, strip_accents, word_map
from casewell.lexicon import MONTH_WORDS

# Spreadsheet day zero and the serial numbers taken as dates.
SERIAL_EPOCH = "1899-12-30"
SERIAL_MIN, SERIAL_MAX = 25569, 60000

# Ambiguous day/month text; the same shape decides the column's order.
DAY_MONTH_SHAPE = r"(\d{1,2})[/\-\.](\d{1,2})[/\-\.](\d{2,4})"


def _english_months() -> dict[str, list[str]]:
    """English spelling -> month words: long words become the name, short ones its abbreviation."""
    groups: dict[str, list[str]] = {}
    for words in MONTH_WORDS.values():
        for w in words:
            groups.setdefault(words[0] if len(w) > 4 else words[0][:3], []).append(w)
    return groups


def normalize_date_text(c: Column) -> Column:
    """Trim quotes and punctuation, drop connectives, put months into English."""
    s = F.regexp_replace(strip(c), r"^['\"`.,]+|['\"`.,]+$", "")
    s = F.regexp_replace(s, r"(?i)\b(?:de|del|le)\b", " ")
    pieces = F.split(s, r"(?<=\p{L})(?=[^\p{L}])|(?<=[^\p{L}])(?=\p{L})")
    months = word_map(_english_months())
    s = F.array_join(
        F.transform(pieces, lambda w: F.coalesce(F.element_at(months, strip_accents(F.lower(w))), w)), "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def is_serial_date(c: Column) -> Column:
    """A spreadsheet serial number in the plausible range (about 1970 to 2064)."""
    s = strip(c.cast("string"))
    number = s.try_cast("double")
    return F.coalesce(s.rlike(r"^\d{5}(\.\d+)?$") & number.between(SERIAL_MIN, SERIAL_MAX), F.lit(False))


def serial_to_date(c: Column) -> Column:
    days = F.floor(strip(c.cast("string")).try_cast("double")).cast("int")
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), days)


def day_month_votes(c: Column) -> tuple[Column, Column]:
    """Aggregates counting values that can only be day-first / only month-first."""
    s = c.cast("string")
    a = F.regexp_extract(s, DAY_MONTH_SHAPE, 1).try_cast("int")
    b = F.regexp_extract(s, DAY_MONTH_SHAPE, 2).try_cast("int")
    return (
        F.count_if(F.coalesce((a > 12) & (b <= 12), F.lit(False))),
        F.count_if(F.coalesce((b > 12) & (a <= 12), F.lit(False))),
    )


# Shapes a date is written in, and the year-month-day order of their parts.
# All shapes of this block.
_CLOCK = r"(?:[T ,]+\d{1,2}[:hH].*)?"
_NUMERIC_SHAPES = (
    (r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})(?:[T\s].*)?$", "$1-$2-$3"),
    (r"^((?:19|20)\d\d)(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", "$1-$2-$3"),
    (r"^(\d{4})[/\-](\d{1,2})$", "$1-$2-1"),
    (r"^(\d{1,2})[/\-](\d{4})$", "$2-$1-1"),
    (r"^(\d{4})$", "$1-1-1"),
)
_DAY_MONTH_YEAR = (r"^(\d{1,2})[/\-. ](\d{1,2})[/\-. ](\d{4}|\d{2})" + _CLOCK + "$", r"^(\d{2})(\d{2})(\d{2})$")
# "m7" stands for a month word
_WORD_SHAPES = (
    (r"^(\d{1,2})(?:st|nd|rd|th|er)? ?m(\d+) ?(\d{4}|\d{2})(?: \d{1,2}[:h].*)?$", "$3-$2-$1"),
    (r"^m(\d+) ?(\d{1,2})(?:st|nd|rd|th|er)? (\d{4}|\d{2})(?: \d{1,2}[:h].*)?$", "$3-$1-$2"),
    (r"^m(\d+) (\d{4})$", "$2-$1-1"),
)


def _rewrite(c: Column, shapes) -> Column:
    for pattern, order in shapes:
        c = F.regexp_replace(c, pattern, order)
    return c


def parse_date(
    c: Column,
    day_first: bool | Column = True,
    min_year: int = 1900,
    max_year: int = 2100,
    century_pivot: int | None = None,
) -> Column:
    """Date from the usual ways line lists write one; null when unreadable.

    Missing tokens are null.  Spreadsheet serials are converted; everything else is
    rewritten to year-month-day: ``yyyyMMdd``, year first, day/month/year in numbers,
    month words (English, French, Spanish) in either order, and dates without a day
    or month, which start at the first.  ``day_first`` settles numeric dates where both
    readings exist; the other reading is tried when the preferred one is no date.
    Two-digit years land within 50 years of ``century_pivot`` (default: this year).
    """
    low = (century_pivot or datetime.date.today().year) - 50
    order = (F.when(day_first, "$3-$2-$1").otherwise("$3-$1-$2") if isinstance(day_first, Column)
             else "$3-$2-$1" if day_first else "$3-$1-$2")

    def numbers(s: Column) -> Column:
        return _rewrite(_rewrite(s, _NUMERIC_SHAPES), [(shape, order) for shape in _DAY_MONTH_YEAR])

    def words(s: Column) -> Column:
        # connectives and weekday names out, one space between parts, month word -> number
        w = F.regexp_replace(strip_accents(F.lower(s)), r"\b(?:de|del|le|[a-z]+day|mon|tue|wed|thu|fri|sat|sun)\b", " ")
        w = F.trim(F.regexp_replace(w, r"[\s\-/.,]+", " "))

        def numbered(w: Column) -> Column:
            word = F.regexp_extract(w, r"[a-z]{3,}", 0)
            return F.replace(w, word, F.concat(F.lit("m"), F.element_at(word_map(MONTH_WORDS), word)))
        return _rewrite(let(w, numbered), _WORD_SHAPES)

    def year_month_day(s: Column) -> Column:
        spelled = s.rlike(r"[A-Za-z\u00C0-\u024F]") & ~s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]")
        return F.when(spelled, words(s)).otherwise(numbers(s))

    def full_year(ymd: Column) -> Column:
        year = F.pmod(F.substring(ymd, 1, 2).try_cast("int") - low, F.lit(100)) + low
        return F.when(ymd.rlike(r"^\d{2}-"), F.concat(year.cast("string"), F.substring(ymd, 3, 9))).otherwise(ymd)

    def readable(ymd: Column) -> Column:
        other = F.regexp_replace(ymd, r"^(\d+)-(\d+)-(\d+)$", "$1-$3-$2")
        return F.when(ymd.rlike(r"^\d{4}-\d+-\d+$"), F.coalesce(ymd.try_cast("date"), other.try_cast("date")))

    def parsed(raw: Column) -> Column:
        # a real date written yyyy-MM-dd needs none of the rules below
        plain = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date"))
        return F.coalesce(plain, by_rules(raw))

    def by_rules(raw: Column) -> Column:
        s = F.regexp_replace(raw, r"^['\"`.,]+|['\"`.,]+$", "")
        text_date = let(let(let(s, year_month_day), full_year), readable)
        return F.when(is_missing(raw), None).when(is_serial_date(raw), serial_to_date(raw)).otherwise(text_date)

    in_range = lambda d: F.when(F.year(d).between(min_year, max_year), d)
    return let(let(strip(c.cast("string")), parsed), in_range)


# Weekday words, and the year of dates written without one.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "wed", "thu", "fri", "sat", "sun",
            "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche",
            "lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")
YEARLESS = 2000


def parse_rare_date(c: Column, day_first: bool | Column = True, min_year: int = 1900, max_year: int = 2100,
                    century_pivot: int | None = None) -> Column:
    """Date from what ``parse_date`` cannot read: a clock time or weekday words anywhere, or a day and month without a year."""
    s = strip_accents(F.lower(strip(c.cast("string"))))
    s = F.regexp_replace(s, r"\b\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]m\b|z\b)?|\b\d{1,2}h(?:\d{2})?\b", " ")
    s = F.regexp_replace(s, r"\b(?:" + "|".join(WEEKDAYS) + r")\b", " ")
    s = F.trim(F.regexp_replace(s, r"[\s,]+", " "))
    dated = parse_date(s, day_first, min_year, max_year, century_pivot)
    shape = r"^(?:\d{1,2}(?:st|nd|rd|th|er)? ?(?:de )?[a-z]{3,}\.?|[a-z]{3,}\.? \d{1,2}(?:st|nd|rd|th)?)$"
    month = F.element_at(word_map(MONTH_WORDS), F.regexp_extract(s, r"[a-z]{3,}", 0))
    yearless = F.concat_ws("-", F.lit(str(YEARLESS)), month, F.regexp_extract(s, r"\d{1,2}", 0)).try_cast("date")
    return F.coalesce(dated, F.when(s.rlike(shape) & month.isNotNull(), yearless))


def as_date(c: Column, dtype: str) -> Column:
    """Date from a date column, or from text that starts with an ISO date."""
    if dtype.startswith(("date", "timestamp")):
        return c.cast("date")
    s = c.cast("string")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10).try_cast("date"))


def epi_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d).cast("int")


def epi_week_number(d: Column) -> Column:
    return F.weekofyear(d).cast("int")


def epi_week(d: Column) -> Column:
    """ISO 8601 / WHO week label such as ``2023-W42``; null for a null date."""
    label = F.concat(epi_year(d).cast("string"), F.lit("-W"),
                     F.lpad(epi_week_number(d).cast("string"), 2, "0"))
    return F.when(d.isNotNull(), label)
