"""Fields of stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_tag(html: Column, tag: str) -> Column:
    """Text of the first element with the tag; null if there is none."""
    return F.nullif(F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def record(text: Column) -> Column:
    """``W-L-D`` as struct(wins, losses, draws), null parts if it does not occur."""
    part = lambda k: F.regexp_extract(text, r"(\d+)-(\d+)-(\d+)", k).try_cast("int")
    return F.struct(part(1).alias("wins"), part(2).alias("losses"), part(3).alias("draws"))


def labelled_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``label: value`` list items of each page in order; ``--`` is null and percentages are fractions."""
    items = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<li[^>]*>\s*(?:<[^>]*>\s*)*([^<:]+:[^<]*)"), F.lit(1))
    rows = pages.select(key, F.posexplode(items).alias("pos", "item"))
    value = F.trim(F.substring_index("item", ":", -1))
    number = F.regexp_replace(value, "%", "").try_cast("double")
    return rows.select(key, "pos", F.trim(F.substring_index("item", ":", 1)).alias("label"), F.when(value != "--", value).alias("value"), F.when(value.contains("%"), number / 100).otherwise(number).alias("number"))


def page_fields(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    found = links(html)
    return pages.select(
        "page_id", F.nullif(F.regexp_extract(html, r'<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"), first_tag(html, "title").alias("title"),
        first_tag(html, "h1").alias("heading"), F.size(found).cast("long").alias("n_links"), F.get(found, F.lit(0)).alias("first_link"),
    )
