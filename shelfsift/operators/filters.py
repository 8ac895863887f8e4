"""Scope filters, exclusion rules and the column filters of the display view."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import format_bytes, length_display, numbering_display, quality_display
from ..functions.paths import ancestor_dirs, parent_dir, path_key, slashed
from ..functions.text import effective_title, is_blank, title_verified
from ..functions.wildcards import any_body, any_of, has_wildcard, wildcard_body, wildcard_column_regex, wildcard_match, wildcard_match_whole
from ..session import stored
from .categories import is_incomplete, media_kind

# System folders left out by default.
SYSTEM_FOLDERS = (
    r"?:\Windows", r"?:\Windows.old", r"?:\Program Files", r"?:\Program Files (x86)", r"?:\ProgramData",
    r"?:\$Recycle.Bin", r"?:\$RECYCLE.BIN", r"?:\System Volume Information", r"?:\Recovery", r"?:\$WinREAgent",
    r"?:\MSOCache", r"?:\PerfLogs", r"*\AppData\Local\Temp", r"*\AppData\Local\Packages",
)


@dataclass(frozen=True)
class Exclusion:
    path: str
    include_subdirectories: bool = True


def effective_exclusions(rules: Sequence[Exclusion], system: bool = True) -> list[Exclusion]:
    return [*rules, *(Exclusion(p) for p in SYSTEM_FOLDERS)] if system else list(rules)


def _trim(path: str) -> str:
    return path.rstrip("\\/").replace("\\", "/")


def _below(root: str) -> str:
    return re.escape(root) + r"(?:/[\s\S]*)?"


def path_excluded(rules: Sequence[Exclusion], path="full_path") -> Column:
    """Whether any rule covers a file. The rules are policy, so they become one scan-side regex."""

    def bodies(rule: Exclusion) -> list[str]:
        root = _trim(rule.path)
        if not rule.path:
            return []
        if has_wildcard(rule.path):
            return [wildcard_body(root), *([wildcard_body(root + "/*")] if rule.include_subdirectories else [])]
        return [_below(root) if rule.include_subdirectories else re.escape(root) + "(?:/[^/]*)?"]

    return any_body(slashed(path), [body for rule in rules for body in bodies(rule)])


def descent_blocked(rules: Sequence[Exclusion], folder="folder") -> Column:
    """The same test on a folder, to leave out whole subtrees."""

    def bodies(rule: Exclusion) -> list[str]:
        root = _trim(rule.path)
        if not rule.path or not rule.include_subdirectories:
            return []
        if has_wildcard(rule.path):
            bare = root[:-2] if root.endswith("/*") else root
            return [wildcard_body(p) for p in (root, root + "/*", bare, bare + "/*")]
        return [_below(root)]

    return any_body(slashed(folder), [body for rule in rules for body in bodies(rule)])


def path_exclusion(files: DataFrame, rules: Sequence[Exclusion]) -> DataFrame:
    return files.filter(~path_excluded(rules))


def descent_block(files: DataFrame, rules: Sequence[Exclusion]) -> DataFrame:
    """Drop files below a blocked folder: each distinct folder is tested once, not each file."""
    keyed = files.withColumn("_dir", path_key(parent_dir("full_path")))
    folders = keyed.select("_dir").distinct()
    above = folders.select("_dir", F.explode(ancestor_dirs(F.concat("_dir", F.lit("/x")))).alias("folder"))
    blocked = above.filter(descent_blocked(rules)).select("_dir").distinct()
    return keyed.join(blocked, "_dir", "left_anti").drop("_dir")


def literal_part(pattern: Column) -> Column:
    """What every path that matches a wildcard pattern (or begins with it) has in common with it: its
    longest folder name without wildcards, else three letters of its longest literal run, else one
    letter, else nothing. The first letter tells the four kinds apart."""
    plain = F.filter(F.split(pattern, "/"), lambda n: (F.length(n) > 0) & ~n.rlike("[*?]"))
    runs = F.filter(F.split(pattern, "[*?]+"), lambda r: F.length(r) > 0)
    longest = lambda texts: F.array_max(F.transform(texts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    run = longest(runs)
    return (
        F.when(F.size(plain) > 0, F.concat(F.lit("f"), longest(plain)))
        .when(F.length(run) >= 3, F.concat(F.lit("t"), F.right(run, F.lit(3))))
        .when(F.length(run) >= 1, F.concat(F.lit("l"), F.right(run, F.lit(1))))
        .otherwise("n")
    )


def literal_parts(path) -> Column:
    """All parts of a path that ``literal_part`` of a matching pattern may be."""
    text = F.col(path) if isinstance(path, str) else path
    names = F.transform(F.split(text, "/"), lambda n: F.concat(F.lit("f"), n))
    grams = lambda n, kind: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.concat(F.lit(kind), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(names, grams(3, "t"), grams(1, "l"), F.array(F.lit("n"))))


def rule_supersedes(rules: DataFrame) -> DataFrame:
    """Pairs (outer_path, inner_path) where the outer exclusion makes the inner one redundant.

    A recursive plain rule covers rules below it, found by joining on the inner rule's ancestors; a
    recursive wildcard rule covers the plain rules its pattern matches. A path that a pattern matches
    holds the pattern's literal parts, so the two are joined on one of these and only then compared.
    """
    # Read several times below, so the input runs once for them.
    clean = stored(rules.filter(~is_blank("path")).select(
        "path", "include_subdirectories", path_key(F.regexp_replace("path", r"[\\/]+$", "")).alias("key"),
        F.col("path").rlike(r"[*?]").alias("wild"),
    ))
    outer = clean.select(*[F.col(c).alias(f"outer_{c}") for c in clean.columns])
    inner = clean.select(*[F.col(c).alias(f"inner_{c}") for c in clean.columns])
    same = outer.join(inner, F.col("outer_key") == F.col("inner_key")).filter(
        (F.col("outer_path") != F.col("inner_path")) | (F.col("outer_include_subdirectories") != F.col("inner_include_subdirectories"))
    ).filter(F.col("outer_include_subdirectories") | ~F.col("inner_include_subdirectories"))
    plain_inner = inner.filter(~F.col("inner_wild"))
    above = plain_inner.withColumn("outer_key", F.explode(ancestor_dirs("inner_key")))
    below = outer.filter(F.col("outer_include_subdirectories") & ~F.col("outer_wild")).join(above, "outer_key")
    bare = F.regexp_replace("outer_key", r"/\*$", "")
    covered = reduce(
        lambda x, y: x | y,
        [F.regexp_like("inner_key", wildcard_column_regex(p)) for p in (F.col("outer_key"), F.concat("outer_key", F.lit("/*")), bare, F.concat(bare, F.lit("/*")))],
    )
    # Stored, so that Spark knows how many there are: paths are only taken apart and moved if the patterns are too many for each task.
    patterns = stored(outer.filter(F.col("outer_include_subdirectories") & F.col("outer_wild")).withColumn("part", literal_part(bare)))
    wild = patterns.join(plain_inner.withColumn("part", F.explode(literal_parts("inner_key"))), "part").filter(covered)
    columns = ["outer_path", "inner_path"]
    return same.select(*columns).unionByName(below.select(*columns)).unionByName(wild.select(*columns)).distinct()


def extension_ignored(rules: Sequence[str], extension="extension") -> Column:
    patterns = [rule.strip() for rule in rules if rule.strip()]
    return (F.length(extension) > 0) & any_of(wildcard_match_whole(extension, p) for p in patterns)


def ignored_extensions(files: DataFrame, rules: Sequence[str]) -> DataFrame:
    return files.filter(~extension_ignored(rules))


def size_in_range(minimum: int, maximum: int, size="size_bytes") -> Column:
    too_small = F.lit(minimum > 0) & (F.col(size) < minimum)
    too_large = F.lit(maximum > 0) & (F.col(size) > maximum)
    return (F.col(size) <= 0) | ~(too_small | too_large)


def size_filter(files: DataFrame, minimum: int, maximum: int) -> DataFrame:
    return files.filter(size_in_range(minimum, maximum))


def extension_scanned(mode: str, plugin_extensions: tuple[str, ...] = ()) -> Column:
    """``all``, ``video`` or ``audio``; a narrowed scan leaves half-downloaded files alone."""
    if mode == "all":
        return F.lit(True)
    wanted = "Video" if mode == "video" else "Audio"
    return ~is_incomplete() & (media_kind(plugin_extensions=plugin_extensions) == wanted)


def kind_filter(files: DataFrame, mode: str) -> DataFrame:
    return files.filter(extension_scanned(mode))


def visible_files(files: DataFrame, exclusions: Sequence[Exclusion], ignored: Sequence[str]) -> DataFrame:
    return files.filter(~path_excluded(exclusions) & ~extension_ignored(ignored))


def drop_files(files: DataFrame, selection: DataFrame) -> DataFrame:
    return files.join(selection.select("id"), "id", "left_anti")


def without_title(files: DataFrame, category: Column) -> DataFrame:
    return files.filter(is_blank(effective_title()) & ~category.isin("TvExtra", "MovieExtra"))


VIEWS = {
    "All": lambda: F.lit(True),
    "Video": lambda: F.col("kind") == "Video",
    "Audio": lambda: F.col("kind") == "Audio",
    "Movies": lambda: F.col("category") == "Movie",
    "TvShows": lambda: F.col("category") == "TvShow",
    "Extras": lambda: F.col("category").isin("TvExtra", "MovieExtra"),
    "Consolidated": lambda: F.col("consolidated"),
    "NotConsolidated": lambda: ~F.col("consolidated"),
    "Duplicates": lambda: F.col("duplicate_flag") == "DUP",
    "NearDuplicates": lambda: F.col("duplicate_flag") == "~dup",
    "SameTitle": lambda: F.col("is_title_duplicate"),
    "UncertainYear": lambda: F.col("year_ambiguous"),
    "Problems": lambda: F.col("integrity").isin("Corrupt", "IncompleteDownload"),
}


def view_filter(rows: DataFrame, view: str) -> DataFrame:
    """One of the named views. ``rows`` has ``category``, ``duplicate_flag`` and ``is_title_duplicate``."""
    return rows.filter(VIEWS[view]())


def view_counts(rows: DataFrame) -> DataFrame:
    """How many rows each named view shows, in one pass."""
    counts = rows.agg(*[F.count_if(test()).alias(name) for name, test in VIEWS.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("view"), F.col(n).alias("rows")) for n in VIEWS])
    return counts.select(F.inline(pairs))


def display_view(rows: DataFrame, plugin_labels: dict[str, str] | None = None) -> DataFrame:
    """The display columns as text. ``rows`` has ``category`` and ``duplicate_flag``; labels map label -> field."""
    columns = {
        "Name": F.col("file_name"),
        "Kind": F.col("kind"),
        "Category": F.col("category"),
        "Primary title": effective_title(),
        "Secondary title": F.col("secondary_title"),
        "Genres": F.col("genres"),
        "Year": F.when(F.col("year").isNull(), "").when(F.col("year_ambiguous"), F.concat(F.col("year").cast("string"), F.lit(" ?"))).otherwise(F.col("year").cast("string")),
        "S/E": numbering_display(),
        "Size": format_bytes("size_bytes"),
        "Length": length_display(),
        "Quality": quality_display(),
        "Integrity": F.col("integrity"),
        "Path": F.col("full_path"),
        "Dup": F.col("duplicate_flag"),
        "TMDb": F.when(F.col("title_manual"), "✎").when(title_verified(), "✓").otherwise(""),
        "Consolidated": F.when(F.col("consolidated"), "yes").otherwise("no"),
    }
    for label, field in (plugin_labels or {}).items():
        columns[label] = F.coalesce(F.try_element_at(F.col("plugin_fields"), F.lit(field.lower())), F.lit(""))
    return rows.select("id", *[value.alias(name) for name, value in columns.items()])


@dataclass(frozen=True)
class Clause:
    column: str
    pattern: str
    negate: bool = False


BLANK_TOKEN = "(blank)"


def column_filter(view: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """Conjunction of clauses over display columns."""

    def test(clause: Clause) -> Column:
        value = F.col(f"`{clause.column}`")
        hit = is_blank(value) if clause.pattern.strip().lower() == BLANK_TOKEN else wildcard_match(value, clause.pattern)
        return ~hit if clause.negate else hit

    return view.filter(reduce(lambda a, b: a & b, [test(c) for c in clauses], F.lit(True)))


def distinct_genres(files: DataFrame) -> DataFrame:
    """Known genres, each once."""
    names = F.filter(F.transform(F.split("genres", ","), lambda g: F.trim(g)), lambda g: F.length(g) > 0)
    return files.select(F.explode(names).alias("genre")).distinct()
