"""Typed values from raw text cells, as column expressions.

Two rules of the data model meet here: a missing count is 0, a missing
measurement is null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: markers of a missing cell
MISSING = ("---", "--", "", "N/A")
#: fixed values: formats of dates, the first that parses wins
BIRTH_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "M/d/yyyy", "d MMM yyyy")
EVENT_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "M/d/yyyy", "d MMMM yyyy")
#: fixed values: labels of outcomes, tried in this order; KNOCKOUT families come before decisions
OUTCOMES = (
    (("KO", "TKO", "DOCTOR", "COULD NOT CONTINUE"), "KO"),
    (("SUB",), "SUB"),
    (("UNANIMOUS", "U-DEC"), "U-DEC"),
    (("SPLIT", "S-DEC"), "S-DEC"),
    (("MAJORITY", "M-DEC"), "M-DEC"),
    (("DQ", "DISQUAL"), "DQ"),
    (("NO CONTEST", "NC", "OVERTURNED"), "NC"),
    (("DEC",), "U-DEC"),
)
#: fixed values: labels of stances
STANCES = (("ORTHODOX", "ORTHO"), ("SOUTHPAW", "SOUTH"), ("SWITCH", "SWITCH"), ("OPEN", "OPEN"))


def missing(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin(*MISSING)


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.trim(c), pattern, group).try_cast("double")


def x_of_y(c: Column) -> Column:
    """``'9 of 12'`` as struct(landed, tried); a bare n is (n, n), anything else (0, 0)."""
    text = F.trim(c)
    bare = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    part = lambda k: F.regexp_extract(text, r"^(\d+)\s+of\s+(\d+)", k).try_cast("int")
    return F.struct(F.coalesce(part(1), bare, F.lit(0)).alias("landed"), F.coalesce(part(2), bare, F.lit(0)).alias("tried"))


def clock_seconds(c: Column) -> Column:
    """``'m:ss'`` in seconds; missing or bad is 0."""
    part = lambda k: F.regexp_extract(F.trim(c), r"^(\d+):(\d+)$", k).try_cast("int")
    return F.coalesce(part(1) * 60 + part(2), F.lit(0))


def feet_inches(c: Column) -> Column:
    """``5' 11"`` in inches; missing is null."""
    part = lambda k: _number(c, r"^(\d+)'\s*(\d+)", k)
    return part(1) * 12 + part(2)


def leading_number(c: Column) -> Column:
    """Number that a measurement such as ``'155 lbs.'`` or ``'66"'`` begins with; missing is null."""
    return F.when(~missing(c), _number(c, r"^(-?\d+(?:\.\d+)?)"))


def first_date(c: Column, formats: Sequence[str] = EVENT_FORMATS) -> Column:
    """Date in the first of the formats that parses."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in formats))


def percent(c: Column) -> Column:
    """``'45%'`` as 0.45; values above 1 are percentages."""
    value = F.when(~missing(c), F.regexp_replace(F.trim(c), "%", "").try_cast("double"))
    return F.when(value > 1.0, value / 100).otherwise(value)


def scheduled_rounds(c: Column, default: int = 3) -> Column:
    """Leading number of ``'3 Rnd (5-5-5)'``."""
    return F.coalesce(F.regexp_extract(F.trim(c), r"^(\d+)\s*Rnd", 1).try_cast("int"), F.lit(default))


def url_tail(c: Column) -> Column:
    """Last segment of a URL; null if it has none."""
    return F.nullif(F.regexp_extract(c, r"/([0-9a-zA-Z]+)\s*$", 1), F.lit(""))


def first_match(c: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Label of the first rule of which a part occurs in the upper-cased text."""
    text = F.upper(F.trim(c))
    out = None
    for parts, label in rules:
        test = None
        for part in parts:
            test = text.contains(part) if test is None else test | text.contains(part)
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.coalesce(out, F.lit(default))


def outcome_label(c: Column) -> Column:
    return first_match(c, OUTCOMES, "NC")


def stance_label(c: Column) -> Column:
    return first_match(c, [((k,), v) for k, v in STANCES], "UNKNOWN")


def elapsed_seconds(round_number: Column, seconds: Column, round_length: int = 300) -> Column:
    """Seconds from the start; null if either part is."""
    return (round_number - 1) * round_length + seconds


def ticker_date(c: Column) -> Column:
    """Date in a ticker such as ``EV-26JUL11ABCDEF``."""
    text = F.initcap(F.lower(F.regexp_extract(c, r"-(\d{2}[A-Za-z]{3}\d{2})", 1)))
    month = F.concat(F.substring(text, 1, 2), F.initcap(F.substring(text, 3, 3)), F.substring(text, 6, 2))
    return F.try_to_timestamp(month, F.lit("yyMMMdd")).cast("date")


def ticker_code(c: Column) -> Column:
    return F.split(c, "-").getItem(1)


def ticker_tail(c: Column) -> Column:
    return F.substring_index(c, "-", -1)


#: fixed values: pounds of the weight classes
CLASS_POUNDS = {
    "strawweight": 115.0, "flyweight": 125.0, "bantamweight": 135.0, "featherweight": 145.0, "lightweight": 155.0,
    "welterweight": 170.0, "middleweight": 185.0, "light heavyweight": 205.0, "heavyweight": 265.0, "super heavyweight": 265.0,
}


def class_pounds(label: Column, pounds: Mapping[str, float] = CLASS_POUNDS, prefix: str = "women") -> Column:
    """Pounds of a canonical class label, with or without the prefix; null for a class without a fixed weight."""
    known = F.create_map(*(F.lit(x) for pair in pounds.items() for x in pair))
    return F.try_element_at(known, F.regexp_replace(F.lower(F.trim(label)), rf"^{prefix}('s)?\s+", ""))


def class_label(c: Column, names: Sequence[str], prefix: str = "women") -> Column:
    """Canonical class in a noisy label: longest name first, with the prefix kept."""
    text = F.lower(F.trim(c))
    out = None
    for name in sorted(names, key=len, reverse=True):
        test = text.contains(name.lower())
        out = F.when(test, name) if out is None else out.when(test, name)
    found = out
    return F.when(text.contains(prefix) & found.isNotNull(), F.concat(F.lit(f"{prefix} "), found)).otherwise(found)


def stat_rule(c: Column, rules: Sequence[tuple[Sequence[str], str | None, float]]) -> Column:
    """struct(market, factor) of the first rule all of whose tokens occur; a rule without market skips the label."""
    text = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", " ")
    out = None
    for tokens, market, factor in rules:
        test = F.lit(True)
        for token in tokens:
            test = test & text.contains(token)
        value = F.struct(F.lit(market).cast("string").alias("market"), F.lit(float(factor)).alias("factor"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out
