"""Duplicates by content hash and by claimed identity.

Groups are reported as one summary row plus a flat membership table, so a group of any size stays
spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import format_bytes, numbering_display
from ..functions.staging import staged
from ..functions.text import digest, effective_title, has_hash, is_blank, is_extra, strip, title_key
from .categories import auto_category
from .reports import one_row


def exact_duplicates(files: DataFrame) -> DataFrame:
    """One row per content held more than once; reclaimable is the first member's size times the rest."""
    keyed = files.filter(has_hash()).withColumn("hash_key", F.upper("sha256"))
    return (
        keyed.groupBy("hash_key")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min_by("size_bytes", F.struct("full_path", "id")).alias("first_size"),
            F.min("full_path").alias("first_path"),
        )
        .filter("copies > 1")
        .withColumn("reclaimable", F.col("first_size") * (F.col("copies") - 1))
        .drop("first_size")
    )


def exact_duplicate_members(files: DataFrame) -> DataFrame:
    """Every file that shares its content with another one."""
    keyed = files.filter(has_hash()).withColumn("hash_key", F.upper("sha256"))
    held = keyed.groupBy("hash_key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return keyed.join(held, "hash_key").select("hash_key", "id", "full_path", "size_bytes")


def copies_of(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Files with the content of a selected file, minus the selection."""
    wanted = selection.filter(has_hash()).select(F.upper("sha256").alias("_h")).distinct()
    return (
        files.filter(has_hash()).withColumn("_h", F.upper("sha256"))
        .join(wanted, "_h", "left_semi").drop("_h")
        .join(selection.select("id"), "id", "left_anti")
    )


def claimed_identity(category: Column) -> Column:
    """Key under which two files claim to be the same thing; null when a file claims nothing."""
    title = title_key(effective_title())
    numbered = F.col("season").isNotNull() & F.col("episode").isNotNull()
    programme = (category == "TvShow") | (F.col("video_category") == "TvShow") | numbered
    run = F.when(F.col("episode_end") > F.col("episode"), F.format_string("-%03d", "episode_end")).otherwise("")
    tv = F.concat(F.lit("tv|"), title, F.format_string("|S%03dE%03d", "season", "episode"), run)
    other = F.concat_ws("|", F.col("kind"), title, F.coalesce(F.col("year").cast("string"), F.lit("")))
    excluded = (title == "") | ~F.col("kind").isin("Video", "Audio") | category.isin("TvExtra", "MovieExtra") | is_extra()
    return F.when(excluded, None).when(programme, F.when(numbered, tv)).otherwise(other)


def _with_identity(files: DataFrame, category: Column | None) -> DataFrame:
    keyed = staged(files, {"title_group": claimed_identity(auto_category() if category is None else category)})
    return keyed.filter(F.col("title_group").isNotNull())


def title_duplicates(files: DataFrame, category: Column | None = None) -> DataFrame:
    """Claimed identities held by at least two files with at least two distinct contents.

    Hashes are counted through a first aggregate per (identity, hash), so a hot identity is reduced
    before its distinct contents meet in one place.
    """
    keyed = _with_identity(files, category)
    per_content = keyed.groupBy("title_group", F.upper("sha256").alias("_hash")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size_bytes").alias("bytes"),
        F.max("size_bytes").alias("largest"),
        F.min("size_bytes").alias("smallest"),
        F.min_by(F.struct(effective_title().alias("t"), numbering_display().alias("n"), "year"), F.struct("ord", "id")).alias("head"),
        F.min(F.struct("ord", "id")).alias("head_at"),
    )
    unhashed = F.coalesce(F.length("_hash"), F.lit(0)) == 0
    groups = per_content.groupBy("title_group").agg(
        F.sum("n").alias("members"),
        (F.count_if(~unhashed) + F.coalesce(F.sum(F.when(unhashed, F.col("n"))), F.lit(0))).alias("contents"),
        F.sum("bytes").alias("total_bytes"),
        (F.sum("bytes") - F.max("largest")).alias("reclaimable"),
        (F.max("largest") != F.min("smallest")).alias("differs_in_size"),
        F.min_by("head", "head_at").alias("head"),
    )
    title = strip("head.t")
    display = (
        F.when(F.col("head.n") != "", F.concat_ws(" — ", title, F.col("head.n")))
        .when(F.col("head.year").isNotNull(), F.concat(title, F.lit(" ("), F.col("head.year").cast("string"), F.lit(")")))
        .otherwise(title)
    )
    return groups.filter("members >= 2 AND contents >= 2").withColumn("display", display).drop("head")


def title_duplicate_members(files: DataFrame, category: Column | None = None) -> DataFrame:
    keyed = _with_identity(files, category)
    return keyed.join(title_duplicates(files, category).select("title_group"), "title_group", "left_semi").select(
        "title_group", "id", "full_path", "size_bytes"
    )


def title_duplicate_group_for(files: DataFrame, selection: DataFrame, category: Column | None = None) -> DataFrame:
    """The whole claimed-identity groups that contain a selected file."""
    members = title_duplicate_members(files, category)
    wanted = members.join(selection.select("id"), "id", "left_semi").select("title_group").distinct()
    return members.join(wanted, "title_group", "left_semi")


def with_duplicate_flags(files: DataFrame, near_ids: DataFrame, category: Column | None = None) -> DataFrame:
    """Attach ``duplicate_flag`` (DUP beats ~dup beats title) and ``is_title_duplicate``.

    Rows meet the groups they may belong to by the groups' own keys, so a filter on the result holds for the
    rows that are joined, while groups are always told from all files. Rows without a key get one of their own.
    Keys move as digests of 128 bits, and of a group's files no more than those.
    """
    hashed, titled = has_hash(), F.col("title_group").isNotNull()
    lone = digest(F.concat(F.lit("#"), "id"))
    keys = staged(files, {"title_group": claimed_identity(auto_category() if category is None else category)}).withColumns({
        "_content": F.when(hashed, digest(F.concat(F.lit("="), F.upper("sha256")))).otherwise(lone),
        "_identity": F.when(titled, digest(F.concat(F.lit("="), "title_group"))).otherwise(lone),
    })
    held = keys.filter(has_hash()).groupBy("_content").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_content", F.lit(True).alias("_exact"))
    # A row without a hash is a content of its own; those of a group are counted, not listed.
    each = F.when(has_hash(), F.col("_content"))
    groups = keys.filter(titled).groupBy("_identity", each.alias("_each")).agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.groupBy("_identity").agg(F.sum(F.when(F.col("_each").isNull(), F.col("_n")).otherwise(1)).alias("_contents"))
    groups = groups.filter("_contents >= 2").select("_identity", F.lit(True).alias("_title"))
    near = near_ids.select("id").distinct().withColumn("_near", F.lit(True))
    joined = keys.join(held, "_content", "left").drop("_content").join(groups, "_identity", "left").drop("_identity").join(near, "id", "left")
    flag = F.when(F.col("_exact"), "DUP").when(F.col("_near"), "~dup").when(F.col("_title"), "title").otherwise("")
    return joined.withColumns({"duplicate_flag": flag, "is_title_duplicate": F.coalesce("_title", F.lit(False))}).select(
        *files.columns, "duplicate_flag", "is_title_duplicate"
    )


def duplicate_flags(files: DataFrame, near_ids: DataFrame, category: Column | None = None) -> DataFrame:
    """DUP beats ~dup beats title, one flag per file."""
    return with_duplicate_flags(files, near_ids, category).select("id", "full_path", "duplicate_flag")


def catalog_summary(files: DataFrame, near_groups: DataFrame, category: Column | None = None) -> DataFrame:
    """The one-row overview: counts, duplicate sets, reclaimable bytes, unhashed files."""
    base = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("kind") == "Video").alias("video"),
        F.count_if(F.col("kind") == "Audio").alias("audio"),
        F.count_if(~has_hash()).alias("unhashed"),
    )
    exact = exact_duplicates(files).agg(
        F.count(F.lit(1)).alias("duplicate_sets"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable")
    )
    near = near_groups.agg(F.count(F.lit(1)).alias("near_sets"))
    title = title_duplicates(files, category).agg(F.count(F.lit(1)).alias("title_sets"))
    return one_row(base, exact, near, title).withColumn("reclaimable_text", format_bytes("reclaimable"))
