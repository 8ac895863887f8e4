"""``*`` and ``?`` patterns, case-insensitive and anchored at both ends."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col


def has_wildcard(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def wildcard_body(pattern: str) -> str:
    return "".join(r"[^\n]*" if c == "*" else r"[^\n]" if c == "?" else re.escape(c) for c in pattern)


def wildcard_regex(pattern: str) -> str:
    """Java regex of one pattern. A newline may follow the end, and ``*`` does not cross one."""
    return f"(?iu)^{wildcard_body(pattern)}\\n?\\z"


def any_body(value, bodies) -> Column:
    """Whether any of the regex bodies covers the whole value: one regex, however many bodies."""
    unique = list(dict.fromkeys(bodies))
    return col(value).rlike(f"(?iu)^(?:{'|'.join(unique)})\\n?\\z") if unique else F.lit(False)


def wildcard_match(value, pattern: str) -> Column:
    """A pattern without a wildcard means "contains"; an empty one always matches."""
    if not pattern:
        return F.lit(True)
    text = F.coalesce(col(value), F.lit(""))
    if not has_wildcard(pattern):
        return F.contains(F.upper(text), F.upper(F.lit(pattern)))
    return text.rlike(wildcard_regex(pattern))


def wildcard_match_whole(value, pattern: str) -> Column:
    """A pattern without a wildcard means equality; an empty one never matches."""
    if not pattern:
        return F.lit(False)
    if not has_wildcard(pattern):
        return F.upper(F.coalesce(col(value), F.lit(""))) == F.upper(F.lit(pattern))
    return wildcard_match(value, pattern)


def wildcard_column_regex(pattern) -> Column:
    """The same translation for a pattern held in a column."""
    escaped = F.regexp_replace(col(pattern), r"([\\.\[\]{}()+\-^$|#&~])", r"\\$1")
    starred = F.regexp_replace(escaped, r"\*", r"[^\\n]*")
    return F.concat(F.lit("(?iu)^"), F.regexp_replace(starred, r"\?", r"[^\\n]"), F.lit("\\n?\\z"))


def any_of(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result
