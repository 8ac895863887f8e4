"""Titles, keys and number words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

# Number words and what they stand for.
UNITS = {
    "zero": 0, "one": 1, "first": 1, "two": 2, "second": 2, "three": 3, "third": 3,
    "four": 4, "fourth": 4, "five": 5, "fifth": 5, "six": 6, "sixth": 6, "seven": 7, "seventh": 7,
    "eight": 8, "eighth": 8, "nine": 9, "ninth": 9, "ten": 10, "tenth": 10, "eleven": 11, "eleventh": 11,
    "twelve": 12, "twelfth": 12, "thirteen": 13, "thirteenth": 13, "fourteen": 14, "fourteenth": 14,
    "fifteen": 15, "fifteenth": 15, "sixteen": 16, "sixteenth": 16, "seventeen": 17, "seventeenth": 17,
    "eighteen": 18, "eighteenth": 18, "nineteen": 19, "nineteenth": 19,
}
TENS = {
    "twenty": 20, "twentieth": 20, "thirty": 30, "thirtieth": 30, "forty": 40, "fortieth": 40,
    "fifty": 50, "fiftieth": 50, "sixty": 60, "sixtieth": 60, "seventy": 70, "seventieth": 70,
    "eighty": 80, "eightieth": 80, "ninety": 90, "ninetieth": 90,
}

_WORD = "|".join(sorted([*TENS, *UNITS], key=len, reverse=True))
# A season or episode number in digits or in words.
NUMBER = rf"(?:\d{{1,3}}|(?:{_WORD})(?:[\s\-](?:{_WORD}))?)"
_LOW_UNIT = "|".join(sorted((w for w, v in UNITS.items() if 0 < v < 10), key=len, reverse=True))
# The same where it has to mean something: tens may be followed by a unit, nothing else may.
VALID_NUMBER = rf"(?:\d{{1,3}}|(?:{'|'.join(TENS)})[\s\-](?:{_LOW_UNIT})|(?:{_WORD}))"

INVALID_NAME_CHARS = r'[\x00-\x1f"<>|:*?\\/]'
WHITE = r"[\s\p{Z}]"
NOT_WHITE = r"[^\s\p{Z}]"


def _number_table() -> dict[str, int]:
    table = {**UNITS, **TENS}
    for tens, value in TENS.items():
        for unit, digit in UNITS.items():
            if 0 < digit < 10:
                table[f"{tens} {unit}"] = value + digit
    return table


_NUMBERS = _number_table()


def number_value(text) -> Column:
    """Integer of a number written in digits or words; null when it is neither."""
    t = col(text)
    spoken = F.lower(F.trim(F.regexp_replace(t, r"[\s\-]+", " ")))
    words = F.create_map(*[F.lit(x) for pair in _NUMBERS.items() for x in pair])
    return (
        F.when(t.isNull() | (t == ""), None)
        .when(t.rlike(r"^\s*\d+\s*$"), F.trim(t).try_cast("int"))
        .otherwise(F.try_element_at(words, spoken))
    )


def digits_value(text: Column) -> Column:
    """Integer of digits; null of an empty text. A failed ``try_cast`` throws and catches an error for each row."""
    return F.nullif(text, F.lit("")).try_cast("int")


def strip(text) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(col(text), rf"^{WHITE}+|{WHITE}+$", "")


def is_blank(text) -> Column:
    return ~F.coalesce(col(text).rlike(NOT_WHITE), F.lit(False))


def not_blank(text) -> Column:
    return ~is_blank(text)


def title_key(title) -> Column:
    """Claimed-title key: letters and digits in lower case, every other run one space."""
    spaced = F.regexp_replace(F.coalesce(col(title), F.lit("")), r"[^\p{L}\p{N}]+", " ")
    return F.lower(F.trim(spaced))


def lookup_key(title) -> Column:
    """Title-dataset key: letters and decimal digits only, no spaces at all."""
    return F.lower(F.regexp_replace(F.coalesce(col(title), F.lit("")), r"[^\p{L}\p{Nd}]+", ""))


def effective_title() -> Column:
    return F.when(not_blank("confirmed_title"), F.col("confirmed_title")).otherwise(F.col("parsed_title"))


def title_verified() -> Column:
    return F.col("from_dataset") | F.col("from_online") | F.col("title_manual")


def has_hash() -> Column:
    return F.coalesce(F.length("sha256"), F.lit(0)) > 0


def packed(key) -> Column:
    """(hash, text) of a key: its bytes where it is written in capital hexadecimal, else the text. Keys are equal
    where these are, and a hash moves in half the bytes."""
    k = col(key)
    hexadecimal = k.rlike(r"^(?:[0-9A-F]{2})+\z")
    return F.struct(F.when(hexadecimal, F.unhex(k)).alias("hash"), F.when(~hexadecimal, k).alias("text"))


def digest(text) -> Column:
    """The first 128 bits of a text's SHA-256: equal for equal texts only, but for a chance of 1 in 2^128 a pair."""
    return F.substring(F.unhex(F.sha2(col(text), 256)), 1, 16)


def is_extra() -> Column:
    return F.col("video_category").isin("TvExtra", "MovieExtra")


def title_case(text) -> Column:
    """Upper-case the first letter of each word when it is lower case; leave the rest alone."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'’.]*|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))),
        "",
    )


def sanitize(name) -> Column:
    """A usable file or folder name: invalid characters out, spaces collapsed, no trailing dot."""
    cleaned = F.regexp_replace(F.regexp_replace(col(name), INVALID_NAME_CHARS, " "), r"\s{2,}|[^\S ]", " ")
    return F.regexp_replace(F.trim(cleaned), r"[. ]+$", "")


def sort_name(title, enabled: bool = False) -> Column:
    """``The X`` -> ``X (The)`` when articles go last."""
    if not enabled:
        return col(title)
    return F.when(
        F.trim(col(title)).rlike(r"(?iu)^(the|a|an)\s+\S"),
        F.regexp_replace(F.trim(col(title)), r"(?iu)^(the|a|an)\s+(\S.*?)\s*$", "$2 ($1)"),
    ).otherwise(col(title))


def letter_bucket(name) -> Column:
    first = F.substring(F.regexp_replace(col(name), r"^\s+", ""), 1, 1)
    return F.when(first.rlike(r"^\p{L}"), F.upper(first)).otherwise(F.lit("#"))


def title_id_value(text) -> Column:
    """``tt0369179`` -> 369179; anything else -> 0."""
    digits = F.regexp_extract(col(text), r"^(?:tt)?(\d+)$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def title_id_text(number) -> Column:
    return F.format_string("tt%07d", col(number))


def identifier(text) -> Column:
    """A field name as an identifier: the letter after a separator is raised, the rest kept."""
    parts = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"[^\p{L}\p{Nd}]+"), lambda p: F.length(p) > 0)
    raised = F.transform(
        parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    )
    joined = F.regexp_replace(F.array_join(raised, ""), r"^\P{L}+", "")
    return F.concat(F.upper(F.substring(joined, 1, 1)), joined.substr(F.lit(2), F.length(joined)))
