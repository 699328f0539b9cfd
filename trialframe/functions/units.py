"""Unit tables as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col
from .text import norm_key, text_or_empty

# Time units and their length in hours.
HOUR_UNITS = ("h", "hr", "hrs", "hour", "hours")
MINUTE_UNITS = ("min", "mins", "minute", "minutes")
SECOND_UNITS = ("s", "sec", "secs", "second", "seconds")
# Phrases of a balance ingredient.
BALANCE = r"\bqs\b|\bq\.\s?s\.|\bbalance\b|make up to"
# The amounts that are no flux, as a whole text without spaces: a mass, alone or over an area.
AMOUNT = r"^(ug|mg|ng)(([/.*]|per)?(cm2|cm\^?2|sqcm|squarecm)|[.*]?cm\^?-2)?$"
NUMBER = r"(\d+(?:\.\d+)?)"
TARGET_PERCENT = 5.0
# Spellings of the target concentration.
STATED_TARGET = r"\b5(\.0)?\s*%\s*(w/w)?\b|\b50(\.0)?\s*mg\s*/\s*g\b|\b50(\.0)?\s*mg\s*g-1\b|\b0\.05\s*\(?\s*w/w\s*\)?"


def clean_unit(c) -> Column:
    """Lower case without spaces; micro signs become u, raised digits and minus signs plain ones, dots one dot."""
    return F.translate(F.lower(text_or_empty(c)), "µμ¹²³⁻−–·⋅^ \t\n\r\xa0", "uu123---..")


def _number(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, pattern, 1).try_cast("double")  # no match is empty, and casts to null


def parse_concentration(c) -> Column:
    """Percent by weight from text: '5 % w/w', '50 mg/g', '5 g/100 g' or '5 g per 100 g'.

    A plain substring test in front spares most rows the pattern.
    """
    text = text_or_empty(c)
    has = lambda t: F.contains(text, F.lit(t))
    return F.coalesce(
        F.when(has("%"), _number(text, rf"(?i){NUMBER}\s*(?:%|wt%|w/w%|%w/w)")),
        F.when(has("/"), _number(text, rf"(?i){NUMBER}\s*mg\s*/\s*g") * 0.1),
        F.when(has("100"), _number(text, rf"(?i){NUMBER}\s*g\s*(?:/|per)\s*100\s*g")),
    )


def to_percent_w_w(value, unit, basis) -> Column:
    return percent_of(col(value).cast("double"), clean_unit(unit), F.lower(text_or_empty(basis)))


def percent_of(v: Column, u: Column, b: Column) -> Column:
    """As ``to_percent_w_w`` for a cleaned unit and a lower-case basis."""
    has = lambda text: F.contains(u, F.lit(text))
    return (
        F.when(v.isNull() | F.isnan(v), None)
        .when(has("%") | has("w/w"), v)
        .when(has("mg/g") | has("mgperg"), v * 0.1)
        .when(has("g/100g") | has("gper100g"), v)
        .when(F.contains(b, F.lit("mg/g")), v * 0.1)
    )


def is_target(pct, mode: str = "exact") -> Column:
    """``exact``: 5 % within 1e-6; ``band``: within 4.8 to 5.2, the rounding tolerance of the rules."""
    p = col(pct)
    hit = F.abs(p - TARGET_PERCENT) < 1e-6 if mode == "exact" else p.between(4.8, 5.2)
    return F.coalesce(hit, F.lit(False))


def target_answer(raw, value, unit, basis) -> Column:
    """yes / no / uncertain for '5 % w/w' from the raw text, then from value, unit and basis."""
    text, v = F.lower(text_or_empty(raw)), col(value).cast("double")
    u, b = F.lower(text_or_empty(unit)), F.lower(text_or_empty(basis))
    stated = F.contains(text, F.lit("5")) & text.rlike(STATED_TARGET)
    by_percent = v.isNotNull() & (b == "w/w") & u.isin("%", "percent", "percentage")
    by_mass = v.isNotNull() & (b == "mg_per_g") & F.contains(u, F.lit("mg/g"))
    return (
        F.when(stated, "yes")
        .when(by_percent, F.when(F.abs(v - 5.0) <= 0.2, "yes").otherwise("no"))
        .when(by_mass, F.when(F.abs(v - 50.0) <= 2.0, "yes").otherwise("no"))
        .otherwise("uncertain")
    )


def time_to_hours(value, unit) -> Column:
    return hours_of(col(value).cast("double"), norm_key(unit))


def hours_of(v: Column, u: Column) -> Column:
    return (
        F.when(u.isin(*HOUR_UNITS), v).when(u.isin(*MINUTE_UNITS), v / 60.0).when(u.isin(*SECOND_UNITS), v / 3600.0)
    )


def amount_to_ug_cm2(value, unit, area, kind, mode: str = "strict") -> Column:
    """Micrograms per square centimetre. Totals need an area; percentages give null.

    ``strict`` accepts a mass, or a mass over square centimetres, and nothing else, so no flux; ``loose``
    accepts any unit text that contains the mass (and area) unit.
    """
    return amount_of(col(value).cast("double"), clean_unit(unit), col(area).cast("double"), col(kind), mode)


def amount_of(v: Column, u: Column, a: Column, k: Column, mode: str = "strict") -> Column:
    """As ``amount_to_ug_cm2`` for a cleaned unit."""
    scale = F.when(F.contains(u, F.lit("ug")), 1.0).when(F.contains(u, F.lit("mg")), 1000.0).when(
        F.contains(u, F.lit("ng")), 0.001
    )
    share = F.when((k == "amount_per_area") & F.contains(u, F.lit("cm")), 1.0).when((k == "amount_total") & (a > 0), a)
    out = v * scale / share
    if mode == "loose":
        return out
    return F.when(u.rlike(AMOUNT), out)


def is_balance(c) -> Column:
    return F.lower(text_or_empty(c)).rlike(BALANCE)
