"""Display strings of a file row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

UNITS = ("B", "KB", "MB", "GB", "TB")


def _trimmed(value: Column, decimals: int) -> Column:
    text = F.format_string(f"%.{decimals}f", F.round(value, decimals))
    return F.regexp_replace(text, r"\.?0+$", "") if decimals else text


def format_bytes(size, decimals: int = 2) -> Column:
    """1024 steps up to TB, trailing zeros dropped, whole bytes below 1 KB."""
    b = col(size)
    result = F.concat(b.cast("string"), F.lit(" B"))
    for power, unit in enumerate(UNITS[1:], start=1):
        scaled = b.cast("double") / F.lit(float(1024 ** power))
        result = F.when(b >= 1024 ** power, F.concat(_trimmed(scaled, decimals), F.lit(f" {unit}"))).otherwise(result)
    return result


def numbering_display(season="season", episode="episode", end="episode_end") -> Column:
    s, e, last = col(season), col(episode), col(end)
    one = F.format_string("S%02dE%02d", s, e)
    return (
        F.when(s.isNull() | e.isNull(), F.lit(""))
        .when(last > e, F.concat(one, F.format_string("-E%02d", last)))
        .otherwise(one)
    )


def length_display(seconds="duration_seconds") -> Column:
    s = F.bround(col(seconds), 0).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(col(seconds) <= 0, F.lit(""))
        .when(s >= 3600, F.format_string("%d:%02d:%02d", hours, minutes, rest))
        .otherwise(F.format_string("%d:%02d", minutes, rest))
    )


def quality_display(kind="kind", quality="quality") -> Column:
    q = col(quality)
    return (
        F.when(q <= 0, F.lit(""))
        .when(col(kind) == "Audio", F.concat(q.cast("string"), F.lit(" kbps")))
        .otherwise(F.concat(q.cast("string"), F.lit("p")))
    )


def describe_seconds(seconds) -> Column:
    s = F.bround(F.abs(col(seconds)), 0).cast("bigint")
    return (
        F.when(s.isNull(), None)
        .when(s == 1, F.lit("1 second"))
        .when(s < 60, F.concat(s.cast("string"), F.lit(" seconds")))
        .when(s < 3600, F.format_string("%d:%02d", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))
    )


def episode_numbers(episode="episode", end="episode_end") -> Column:
    """Every episode number a file holds."""
    e, last = col(episode), col(end)
    return F.sequence(e, F.when(last > e, last).otherwise(e))


def run_end(episode="episode", end="episode_end") -> Column:
    return F.when(col(end) > col(episode), col(end)).otherwise(col(episode))
