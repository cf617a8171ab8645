"""Keys made from names."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: suffixes that say nothing about identity
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


def _fold(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def fold_accents(name: Column) -> Column:
    """Letters without their accents, other characters beyond ASCII dropped; Spark SQL has no such function."""
    return F.pandas_udf(_fold, "string")(name)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tight_key(c: Column) -> Column:
    """Lower case, punctuation deleted."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))


def spaced_key(c: Column) -> Column:
    """Lower case, punctuation turned into spaces."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "))


def plain_key(c: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """``spaced_key`` without suffix tokens."""
    return F.array_join(F.filter(F.split(spaced_key(c), " "), lambda t: ~t.isin(*suffixes)), " ")


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def pair_key(date: Column, a: Column, b: Column) -> Column:
    """The same key for both orders of a pair."""
    return F.concat_ws("|", date.cast("string"), F.least(a, b), F.greatest(a, b))


def line_key(pair: Column, *parts: Column, line: Column) -> Column:
    """Pair key with further parts and a line of four decimals."""
    return F.concat_ws("|", pair, *(F.coalesce(p, F.lit("")) for p in parts), F.format_string("%.4f", line))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer name."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))
