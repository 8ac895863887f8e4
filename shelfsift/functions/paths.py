"""Path expressions. Both separators are accepted; folder comparison goes through an upper-cased key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def slashed(path) -> Column:
    """The path with forward slashes only."""
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def path_key(path) -> Column:
    """The join key under which two spellings of one path are equal."""
    return F.upper(slashed(path))


def trim_slashes(path) -> Column:
    return F.regexp_replace(col(path), r"[\\/]+$", "")


def parent_dir(path) -> Column:
    return F.regexp_replace(col(path), r"[\\/][^\\/]*$", "")


def base_name(path) -> Column:
    """What follows the last separator: searched from the end, since a pattern is tried at every letter."""
    return F.right(col(path), F.length(F.substring_index(slashed(path), "/", -1)))


def extension_of(name) -> Column:
    return F.regexp_extract(col(name), r"(\.[^.\\/]+)$", 1)


def stem_of(name) -> Column:
    return F.regexp_replace(col(name), r"\.[^.\\/]*$", "")


def ancestor_dirs(path, levels: int | None = None) -> Column:
    """Folders above a file, nearest first, as slashed paths; at most ``levels`` of them."""
    parts = F.split(slashed(path), "/")
    count = F.size(parts) - 1
    last = F.lit(1) if levels is None else F.greatest(count - (levels - 1), F.lit(1))
    indexes = F.when(count >= 1, F.sequence(count, last, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    dirs = F.transform(indexes, lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.filter(dirs, lambda d: F.length(d) > 0)


def folder_names(path) -> Column:
    """Names of the folders above a file, nearest first, without a drive root."""
    parts = F.split(slashed(path), "/")
    names = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.filter(names, lambda n: (F.length(n) > 0) & ~n.rlike(r"^[A-Za-z]:$"))


def is_under(path, root, or_equal: bool = True) -> Column:
    """Whether ``path`` lies below ``root`` (or is it), ignoring case."""
    p, r = path_key(path), path_key(trim_slashes(root))
    below = F.startswith(p, F.concat(r, F.lit("/"))) & (F.length(r) > 0)
    return below | (p == r) if or_equal else below


def is_drive_root(path) -> Column:
    return slashed(trim_slashes(path)).rlike(r"^([A-Za-z]:)?$")


def path_root(path) -> Column:
    """Drive of a path (``D:``), a UNC share, or ``/``."""
    p = slashed(path)
    return F.upper(
        F.when(p.rlike(r"^[A-Za-z]:"), F.substring(p, 1, 2))
        .when(p.startswith("//"), F.regexp_extract(p, r"^(//[^/]+/[^/]+)", 1))
        .otherwise(F.lit("/"))
    )


def same_volume(a, b) -> Column:
    return path_root(a) == path_root(b)
