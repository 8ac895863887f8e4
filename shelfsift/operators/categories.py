"""Kinds, categories and category policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_hash, is_blank, is_extra, not_blank
from .skew import first_by

# Extensions by kind.
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".m4v", ".mpg", ".mpeg", ".webm", ".ts", ".m2ts",
                    ".mts", ".vob", ".divx", ".3gp", ".ogv", ".rm", ".rmvb")
AUDIO_EXTENSIONS = (".mp3", ".flac", ".aac", ".m4a", ".wav", ".ogg", ".opus", ".wma", ".aiff", ".aif", ".ape", ".alac",
                    ".m4b", ".wv", ".mka")
INCOMPLETE_EXTENSIONS = (".part", ".crdownload", ".partial", ".!ut", ".bc!", ".download", ".tmp")
BUILT_IN_CATEGORIES = ("Movie", "TvShow", "TvExtra", "MovieExtra", "Other", "Unknown", "Audio")


def media_kind(extension="extension", plugin_extensions: tuple[str, ...] = ()) -> Column:
    ext = F.lower(F.col(extension) if isinstance(extension, str) else extension)
    return (
        F.when(ext.isin(*VIDEO_EXTENSIONS), "Video")
        .when(ext.isin(*AUDIO_EXTENSIONS), "Audio")
        .when(ext.isin(*plugin_extensions) if plugin_extensions else F.lit(False), "Other")
        .otherwise("Unknown")
    )


def is_incomplete(extension="extension") -> Column:
    return F.lower(F.col(extension)).isin(*INCOMPLETE_EXTENSIONS)


def quick_integrity() -> Column:
    return F.when(is_incomplete(), "IncompleteDownload").when(F.col("size_bytes") == 0, "Corrupt").otherwise("Ok")


def auto_category(plugin_category: Column | None = None) -> Column:
    """Category from what is known of a file: a plugin's, TvShow when numbered, else by kind."""
    from_plugin = F.lit(None).cast("string") if plugin_category is None else plugin_category
    numbered = F.col("season").isNotNull() & F.col("episode").isNotNull() & ~is_extra()
    return (
        F.when((F.col("kind") == "Other") & not_blank(from_plugin), from_plugin)
        .when(numbered, "TvShow")
        .when(F.col("kind") == "Video", F.col("video_category"))
        .when(F.col("kind") == "Audio", "Audio")
        .otherwise("Unknown")
    )


def effective_category(folder_category: Column | None = None, plugin_category: Column | None = None) -> Column:
    """Override, else the folder rule's category, else the automatic one."""
    by_folder = F.lit(None).cast("string") if folder_category is None else folder_category
    return F.coalesce(
        F.when(not_blank("category_override"), F.col("category_override")),
        F.when(not_blank(by_folder), by_folder),
        auto_category(plugin_category),
    )


def keeps_numbering(category: Column) -> Column:
    return category.isin("TvShow", "TvExtra")


def strip_numbering(files: DataFrame, category: Column) -> DataFrame:
    """Season and episode go from everything that is no programme, unless typed by hand."""
    numbered = F.col("season").isNotNull() | F.col("episode").isNotNull() | F.col("episode_end").isNotNull()
    strip = ~keeps_numbering(category) & ~F.col("numbering_manual") & numbered
    marked = files.withColumn("unnumbered", F.coalesce(strip, F.lit(False)))
    cleared = {c: F.when(~F.col("unnumbered"), F.col(c)) for c in ("season", "episode", "episode_end")}
    return marked.withColumns(cleared)


def category_list(spark, plugin: DataFrame, custom: DataFrame, order: DataFrame) -> DataFrame:
    """Built-ins, then plugin, then custom categories, unique ignoring case, in the user's order first.

    The inputs have ``category`` and ``pos``.
    """
    built_in = spark.createDataFrame(list(enumerate(BUILT_IN_CATEGORIES)), "pos bigint, category string")
    everything = (
        built_in.select(F.lit(0).alias("source"), "pos", "category")
        .unionByName(plugin.select(F.lit(1).alias("source"), "pos", "category"))
        .unionByName(custom.filter(not_blank("category")).select(F.lit(2).alias("source"), "pos", "category"))
        .withColumn("_key", F.upper("category"))
    )
    unique = first_by(everything, ["_key"], ["source", "pos"])
    wanted = order.groupBy(F.upper("category").alias("_key")).agg(F.min("pos").alias("wanted"))
    return unique.join(wanted, "_key", "left").select(
        "category", "source", "pos", F.col("wanted"),
        (~F.col("category").isin("TvExtra", "MovieExtra")).alias("consolidatable"),
    )


def with_inherited(policies: DataFrame) -> DataFrame:
    """Policy rows plus those that extras inherit from their main category."""
    main_of = F.when(F.upper("category") == "TVSHOW", "TvExtra").when(F.upper("category") == "MOVIE", "MovieExtra")
    inherited = policies.withColumn("category", main_of).filter(F.col("category").isNotNull())
    keyed = policies.withColumn("category_key", F.upper("category"))
    missing = inherited.withColumn("category_key", F.upper("category")).join(
        keyed.select("category_key"), "category_key", "left_anti"
    )
    return keyed.unionByName(missing)


def policy_for(files: DataFrame, category: Column, policies: DataFrame, defaults: dict) -> DataFrame:
    """Attach a category's policy columns; a missing or negative number becomes its default."""
    names = list(defaults)
    table = with_inherited(policies).select("category_key", *names)
    joined = files.withColumn("category", category).withColumn("category_key", F.upper("category")).join(table, "category_key", "left")
    filled = {n: F.greatest(F.coalesce(F.col(n), F.lit(v)), F.lit(v)) for n, v in defaults.items()}
    return joined.withColumns(filled).drop("category_key")


def needs_probe() -> Column:
    return (
        F.col("kind").isin("Audio", "Video")
        & (F.col("integrity") != "IncompleteDownload")
        & ((F.col("duration_seconds") <= 0) | (F.col("quality") <= 0))
    )


def needs_fingerprint() -> Column:
    missing_audio = (F.col("kind") == "Audio") & is_blank("audio_fingerprint")
    missing_video = (F.col("kind") == "Video") & is_blank("video_fingerprint")
    return missing_audio | missing_video


def pending_rehash(files: DataFrame) -> DataFrame:
    return files.filter(F.col("awaiting_download") | ~has_hash())
