"""Merging a directory listing into the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name, extension_of, folder_names, is_under, path_key
from ..functions.staging import staged
from ..functions.text import has_hash
from ..functions.wildcards import any_of
from .categories import is_incomplete, media_kind
from .filters import extension_scanned, size_in_range
from .skew import first_by
from .reports import one_row


def under_any(roots: Sequence[str], path="full_path") -> Column:
    return any_of(is_under(path, F.lit(root), or_equal=False) for root in roots if root.rstrip("\\/"))


def _listed_once(listing: DataFrame) -> DataFrame:
    """The listing by path key. Where a path is listed more than once, its first row stands."""
    rows = listing.select(
        path_key("full_path").alias("_k"), F.col("full_path").alias("_full"), F.col("size_bytes").alias("_size"), F.col("last_modified_utc").alias("_time"), F.col("pos").alias("_pos")
    )
    return first_by(rows, ["_k"], ["_pos", "_full"])


def _moves(apart: DataFrame) -> DataFrame:
    """(_size_key, _time_key, _moved, _adopted): of each size and time the one hashed file that vanished
    and the first path that appeared. ``apart`` has the rows that met nothing: files without a
    listing (``_full`` null) and listed paths without a file (``id`` null)."""
    vanished, appeared = F.col("_full").isNull() & has_hash(), F.col("id").isNull()
    found = apart.groupBy(*_content()).agg(
        F.count_if(vanished).alias("_n"),
        F.min(F.when(vanished, F.struct("id", "full_path"))).alias("_moved"),
        F.min_by(F.when(appeared, F.struct("_k", "_full", "_size", "_time")), F.when(appeared, F.struct("_pos", "_full"))).alias("_adopted"),
    )
    return found.filter("_n = 1 AND _adopted IS NOT NULL AND _size_key IS NOT NULL AND _time_key IS NOT NULL").drop("_n")


def _content() -> list[Column]:
    return [F.coalesce("_size", "size_bytes").alias("_size_key"), F.coalesce("_time", "last_modified_utc").alias("_time_key")]


def detect_moves(files: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, old_path, new_path): a vanished hashed file continues under a new path with its size and time.

    Only when exactly one vanished file has that size and time; the first new path by ``pos`` adopts it.
    One outer join by path tells what vanished from what appeared, on the few columns that matter.
    """
    held = files.select("id", "full_path", "size_bytes", "last_modified_utc", "sha256", path_key("full_path").alias("_k"))
    apart = held.join(_listed_once(listing), "_k", "full_outer").filter("id IS NULL OR _full IS NULL")
    return _moves(apart).select("_moved.id", F.col("_moved.full_path").alias("old_path"), F.col("_adopted._full").alias("new_path"))


def merge_listing(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Upsert a listing by path, ignoring case, after moves. ``status`` is kept, changed, moved, added or unlisted.

    A changed size or time clears the hash, the hash failure and the plugin fields; all other columns stay.

    The tables meet once, in a full outer join by path. Rows that met nothing are joined with the moves
    found among them, by size and time; the others are done. Several catalogue rows may claim one
    path, and each takes what the listing says of it.
    """
    both = files.withColumn("_k", path_key("full_path")).join(_listed_once(listing), "_k", "full_outer")
    # A computed mark, so that both parts read one and the same join; a plain filter would make two of it.
    # The columns go through it as well: the search for moves reads few of them, and would else move these once more.
    joined = staged(both, {**{c: F.col(c) for c in both.columns}, "_apart": F.col("id").isNull() | F.col("_full").isNull()})
    met = joined.filter("NOT _apart").withColumn("_was_moved", F.lit(False))
    apart = joined.filter("_apart")
    keyed = apart.withColumns(dict(zip(("_size_key", "_time_key"), _content(), strict=True))).join(_moves(apart), ["_size_key", "_time_key"], "left")
    was_moved = F.coalesce(F.col("id") == F.col("_moved.id"), F.lit(False))
    taken = F.coalesce(F.col("id").isNull() & (F.col("_k") == F.col("_adopted._k")), F.lit(False))
    other = keyed.filter(~taken).withColumns({"_was_moved": was_moved, **{c: F.when(was_moved, F.col("_adopted")[c]).otherwise(F.col(c)) for c in ("_full", "_size", "_time")}})
    rows = met.unionByName(other.select(*met.columns))
    listed = F.col("_full").isNotNull()
    added = F.col("id").isNull()
    changed = listed & ~added & ~(F.col("size_bytes").eqNullSafe(F.col("_size")) & F.col("last_modified_utc").eqNullSafe(F.col("_time")))
    status = F.when(added, "added").when(~listed, "unlisted").when(F.col("_was_moved"), "moved").when(changed, "changed").otherwise("kept")
    path = F.when(listed, F.col("_full")).otherwise(F.col("full_path"))
    fresh = changed | added
    new = {
        "full_path": path,
        "file_name": base_name(path),
        "extension": extension_of(base_name(path)),
        "size_bytes": F.when(listed, F.col("_size")).otherwise(F.col("size_bytes")),
        "last_modified_utc": F.when(listed, F.col("_time")).otherwise(F.col("last_modified_utc")),
        "sha256": F.when(fresh, F.lit("")).otherwise(F.col("sha256")),
        "hash_failed": F.when(fresh, F.lit(False)).otherwise(F.col("hash_failed")),
        "plugin_fields": F.when(fresh, F.create_map().cast("map<string,string>")).otherwise(F.col("plugin_fields")) if "plugin_fields" in files.columns else None,
    }
    # Every other column of the row stays as it is; an added row has nulls there until it is analysed.
    return rows.withColumn("status", status).select(*[new[c].alias(c) if new.get(c) is not None else F.col(c) for c in files.columns], "status")


def prune_missing(files: DataFrame, listing: DataFrame, walked: Sequence[str], mode: str = "all") -> DataFrame:
    """Drop rows that vanished from roots that were walked; absent roots and other kinds stay."""
    listed = listing.select(path_key("full_path").alias("_k")).distinct()
    in_scope = extension_scanned(mode) & under_any(walked)
    keyed = files.withColumn("_k", path_key("full_path"))
    # One anti join for all rows: a row out of scope gets a key no listing has.
    kept = keyed.join(listed.withColumn("_listed", F.lit(True)), "_k", "left")
    return kept.filter(F.col("_listed").isNotNull() | ~in_scope).drop("_k", "_listed")


def scan_report(listing: DataFrame, merged: DataFrame, minimum: int, maximum: int) -> DataFrame:
    """One row: missing (outside Temp folders), skipped by size, unhashed."""
    temp = F.exists(F.transform(folder_names("full_path"), lambda n: F.upper(n)), lambda n: n == "TEMP")
    seen = listing.agg(
        F.count_if(~F.col("present") & ~temp).alias("missing"),
        F.count_if(F.col("present") & ~size_in_range(minimum, maximum)).alias("skipped_by_size"),
        F.count_if(F.col("present")).alias("listed"),
    )
    hashed = merged.agg(F.count_if(~has_hash() & (F.col("size_bytes") > 0) & ~is_incomplete()).alias("unhashed"))
    return one_row(seen, hashed)


def adopt_listing(files: DataFrame, listing: DataFrame, excluded: Column, ignored: Column) -> DataFrame:
    """Insert-only merge: media files not yet known, not excluded, not ignored."""
    fresh = listing.withColumns({"file_name": base_name("full_path"), "extension": extension_of(base_name("full_path"))})
    fresh = fresh.withColumn("kind", media_kind()).filter((F.col("kind") != "Unknown") & ~excluded & ~ignored)
    known = files.select(path_key("full_path").alias("_k"))
    fresh = first_by(fresh.withColumn("_k", path_key("full_path")), ["_k"], ["pos", "full_path"])
    return fresh.join(known, "_k", "left_anti").drop("_k")


def deferred_roots(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Mark each listed file ``process`` or ``deferred`` by whether its root is available.

    ``roots``: root, available. A file belongs to a root that is one of its ancestors.
    """
    from .folders import folder_ancestors, with_folder
    from ..functions.paths import trim_slashes

    absent = roots.filter(~F.col("available")).select(path_key(trim_slashes("root")).alias("above")).distinct()
    waiting = folder_ancestors(listing).join(absent, "above", "left_semi").select("folder_key").distinct().withColumn("_d", F.lit(True))
    joined = with_folder(listing).join(waiting, "folder_key", "left")
    return joined.withColumn("phase", F.when(F.col("_d"), "deferred").otherwise("process")).drop("folder_key", "_d")


def resume_backlog(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned ids of an interrupted run that its log does not mention."""
    return planned.join(done.select("id"), "id", "left_anti")


def lookup_cache(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Answers of earlier checks by (kind, trimmed query), ignoring case; tv falls back to the old bare kind.

    ``questions``: kind, query. ``cache``: kind, query, found, canonical_name, pos (first put wins).
    """
    keyed = cache.select(
        F.coalesce("kind", F.lit("")).alias("kind"), F.upper(F.trim("query")).alias("_q"), F.struct("found", "canonical_name").alias("_a"), "pos"
    )
    index = keyed.groupBy("kind", "_q").agg(F.min_by("_a", "pos").alias("_a"))
    asked = questions.withColumn("_q", F.upper(F.trim("query")))
    # Both kinds a question may be answered under become rows of one equi-join.
    tried = asked.withColumn(
        "_try",
        F.explode(F.when(F.col("kind") == "tv", F.array(F.lit("tv"), F.lit(""))).otherwise(F.array("kind"))),
    )
    answers = tried.select("kind", "_q", "_try").distinct().join(index.withColumnRenamed("kind", "_try"), ["_try", "_q"])
    best = answers.groupBy("kind", "_q").agg(F.max_by("_a", F.length("_try")).alias("_a"))
    return asked.join(best, ["kind", "_q"], "left").drop("_q").withColumns(
        {"found": F.col("_a.found"), "canonical_name": F.col("_a.canonical_name")}
    ).drop("_a")


def lookup_cache_put(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """New answers appended; a key already held keeps its first answer."""
    key = [F.coalesce("kind", F.lit("")).alias("_kind"), F.upper(F.trim("query")).alias("_q")]
    held = cache.select(*key).distinct()
    fresh = answers.select("*", *key).join(held, ["_kind", "_q"], "left_anti")
    fresh = first_by(fresh, ["_kind", "_q"], ["pos"]).withColumn("query", F.trim("query"))
    return cache.unionByName(fresh.select(*cache.columns))
