"""Text functions that pipelines use: lists, clocks, slugs, scrubbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is masked, and by what, in order.
MASKS = [
    (r"https?://[^ \t\n<>\"]+", "<url>"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\+[0-9][0-9 ().-]{7,}[0-9]", "<phone>"),
    (r"[0-9]{6,}", "<number>"),
]
EMAIL = MASKS[1][0]


def join_list(col: Column) -> Column:
    """`a, b` of trimmed items that are not empty; `none` where there are none."""
    kept = F.filter(F.transform(col, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(kept, ", "), F.lit("")), F.lit("none"))


def clock(text: Column) -> Column:
    """Characters 12 to 16 of a timestamp text that is long enough."""
    return F.when(F.length(text) >= 16, F.substring(text, 12, 5)).otherwise(text)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one dash; `step` where nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("step"))


def truncate(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where more stood."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(" …"))).otherwise(text)


def scrub_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "<email>")


def mask_private(text: Column) -> Column:
    for pattern, mark in MASKS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def pseudonym(name: Column, salt: str) -> Column:
    """A name that is the same wherever the trimmed lower-case name and the salt are."""
    return F.concat(F.lit("TM-"), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.lower(F.trim(name))).cast("binary"), 256), 1, 4))


# Fixed value: a line's clock, if it has one, and its speaker: up to 60 characters before the first colon, which white space follows.
SPEAKER = r"^((?:[0-9]{1,2}:[0-9]{2}[\t\n\f\r ]+)?)([^:\n]{1,60}):([\t\n\f\r ])"


def pseudonymize_speakers(df: DataFrame, text_col: str) -> DataFrame:
    """The speaker that begins a line becomes S1, S2, ... by first appearance within the record; a clock before it stays.  No shuffle."""
    lines = F.split(F.col(text_col), "\n", -1)
    parts = F.transform(lines, lambda s: F.struct(s.alias("line"), F.regexp_extract(s, SPEAKER, 1).alias("clock"), F.regexp_extract(s, SPEAKER, 2).alias("name")))
    d = df.withColumn("__parts", parts)
    names = F.array_distinct(F.transform(F.filter("__parts", lambda p: p["name"] != ""), lambda p: F.trim(p["name"])))
    one = lambda p: F.when(
        p["name"] != "",
        F.concat(p["clock"], F.lit("S"), F.array_position("__names", F.trim(p["name"])).cast("string"), F.substr(p["line"], F.length(p["clock"]) + F.length(p["name"]) + 1)),
    ).otherwise(p["line"])
    return d.withColumn("__names", names).withColumn(text_col, F.array_join(F.transform("__parts", one), "\n")).drop("__names", "__parts")
