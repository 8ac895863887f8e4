"""The title dataset on disk: raw TSV files and the compact extract."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.titles import valid_year
from .layout import spread

# Column names of the raw files and where they stand when a header lacks them.
BASICS = {"tconst": 0, "titleType": 1, "primaryTitle": 2, "startYear": 5, "endYear": 6, "genres": 8}
EPISODES = {"tconst": 0, "parentTconst": 1, "seasonNumber": 2, "episodeNumber": 3}


def _fields(spark: SparkSession, path: str, layout: dict[str, int]) -> DataFrame:
    """One string column per layout name. Columns go by header name, else by position; short lines are dropped.

    ``pos`` is the order of the lines. Text is split here rather than by the CSV reader because quotes
    mean nothing in these files.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_n"))
    # A file's first line is its header: one row a file, found by an aggregate.
    headers = lines.groupBy("_file").agg(F.min_by("value", F.struct("_from", "_n")).alias("_header"), F.min(F.struct("_from", "_n")).alias("_first"))
    names = F.split(F.lower("_header"), "\t")
    parts = F.split("value", "\t")
    # Lines of one split are numbered in order; splits go by file and offset.
    rows = lines.join(headers, "_file").filter(F.struct("_from", "_n") != F.col("_first"))
    places = {name: F.when(F.array_contains(names, name.lower()), F.array_position(names, name.lower()).cast("int") - 1).otherwise(F.lit(fallback)) for name, fallback in layout.items()}
    whole = rows.filter(F.size(parts) > F.greatest(*places.values()))
    return whole.select(F.struct("_file", "_from", "_n").alias("pos"), *[F.get(parts, at).alias(name) for name, at in places.items()])


def _value(name: str) -> Column:
    text = F.trim(name)
    return F.when((text != "") & (text != "\\N"), text)


def read_title_basics(spark: SparkSession, path: str) -> DataFrame:
    """Raw titles (plain or gzip). A gzip file is one split, so it is spread out again after reading."""
    raw = _fields(spark, path, BASICS).select(
        "pos", "tconst", _value("titleType").alias("title_type"), F.when(F.col("primaryTitle") != "\\N", F.col("primaryTitle")).alias("primary_title"),
        valid_year(_value("startYear").try_cast("int")).alias("start_year"), valid_year(_value("endYear").try_cast("int")).alias("end_year"),
        _value("genres").alias("genres"),
    )
    return spread(raw, "tconst")


def read_title_episodes(spark: SparkSession, path: str) -> DataFrame:
    raw = _fields(spark, path, EPISODES).select(
        "pos", "tconst", F.col("parentTconst").alias("parent_tconst"),
        _value("seasonNumber").try_cast("int").alias("season"), _value("episodeNumber").try_cast("int").alias("episode"),
    )
    return spread(raw, "tconst")


def write_title_extract(titles: DataFrame, episodes: DataFrame, codes: DataFrame, folder: str) -> None:
    """A new version beside the old ones; the pointer moves last, so a reader sees one version whole."""
    spark = titles.sparkSession
    version = f"{folder}/v-{uuid.uuid4().hex}"
    for name, rows in (("codes", codes), ("episodes", episodes), ("titles", titles)):
        rows.write.parquet(f"{version}/{name}")
    pointer = spark.createDataFrame([(version,)], "version string").withColumn("written", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/pointer")


def read_title_extract(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    current = spark.read.parquet(f"{folder}/pointer").agg(F.max_by("version", "written")).first()[0]
    return tuple(spark.read.parquet(f"{current}/{name}") for name in ("titles", "episodes", "codes"))


def _number(text: Column) -> Column:
    return text.try_cast("int")


def parse_title_lines(lines: DataFrame) -> DataFrame:
    """Text lines (``value``, ``pos``) of a compact extract; old two-column lines count as id 0 of no type."""
    parts = F.split("value", "\t")
    part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    rows = lines.filter((F.length("value") > 0) & ~F.startswith("value", F.lit("#")))
    current = (F.size(parts) >= 3) & (F.coalesce(_number(part(0)), F.lit(0)) > 0) & (part(2) != "")
    legacy = (F.size(parts) >= 2) & (part(0) != "")
    genres = F.filter(F.transform(F.split(part(5), ","), _number), lambda g: g >= 0)
    old_year = _number(F.regexp_replace("value", r"^[^\t]*\t", ""))
    return rows.filter(current | legacy).select(
        F.when(current, _number(part(0))).otherwise(0).alias("id"),
        F.when(current, F.coalesce(_number(part(1)), F.lit(0))).otherwise(-1).alias("type_code"),
        F.when(current, part(2)).otherwise(part(0)).alias("title"),
        F.when(current, valid_year(_number(part(3)))).otherwise(valid_year(old_year)).alias("start_year"),
        F.when(current, valid_year(_number(part(4)))).alias("end_year"),
        F.when(current, genres).otherwise(F.array().cast("array<int>")).alias("genre_codes"),
        "pos",
    )


def parse_episode_lines(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    number = lambda i: _number(F.get(parts, i))
    rows = lines.filter((F.length("value") > 0) & ~F.startswith("value", F.lit("#")))
    return rows.select(number(0).alias("id"), number(1).alias("series_id"), number(2).alias("season"), number(3).alias("episode"), "pos").filter("id > 0 AND series_id > 0")
