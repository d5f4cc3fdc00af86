"""Phone numbers in international form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casewell.functions.text import let, strip

# Tokens a phone field uses for "none"; national number length by
# country code, and national numbers that are recognisable by themselves.
NO_PHONE = ("", "na", "n/a", "unknown", "inconnu", "-")
NATIONAL_LENGTH = {"+221": 9}
SELF_EVIDENT = (("^7\\d{9}$", "+221"),)


def clean_phone(c: Column, country_code: str = "+221") -> Column:
    """``+`` and 7 to 15 digits, or null.

    ``00`` becomes ``+``; a leading 0 (9 digits or more) or a number of the
    country's national length gets the country code; 10 to 15 digits are taken
    as already international.
    """
    plus, code = F.lit("+"), F.lit(country_code)

    def international(kept: Column) -> Column:
        size = F.length(kept)
        out = F.when(kept.startswith("+"), kept)
        out = out.when(kept.startswith("0") & (size >= 9), F.concat(code, F.ltrim(kept, F.lit("0"))))
        if country_code in NATIONAL_LENGTH:
            out = out.when(size == NATIONAL_LENGTH[country_code], F.concat(code, kept))
        for pattern, known in SELF_EVIDENT:
            out = out.when(kept.rlike(pattern), F.concat(F.lit(known), kept))
        return out.when(size.between(10, 15), F.concat(plus, kept)).otherwise(kept)

    def digits_only(digits: Column) -> Column:
        return F.when(F.length(digits).between(7, 15), F.concat(plus, digits))

    def clean(s: Column) -> Column:
        kept = F.regexp_replace(F.regexp_replace(s, r"[^\d+]", ""), r"\++", "+")
        built = let(F.regexp_replace(kept, r"^00", "+"), international)
        fallback = let(F.regexp_replace(s, r"\D", ""), digits_only)
        good = let(built, lambda b: F.when(b.rlike(r"^\+\d{8,15}$"), b))
        return F.when(~F.lower(s).isin(*NO_PHONE), F.coalesce(good, fallback))

    return let(strip(c.cast("string")), clean)
