"""Static schemas of the tables the operators take and give."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per catalogued file. ``ord`` is the catalogue position: "first" means lowest ``(ord, id)``.
FILES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("full_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("last_modified_utc", T.TimestampNTZType()),
    T.StructField("kind", T.StringType()),
    T.StructField("video_category", T.StringType()),
    T.StructField("integrity", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("parsed_title", T.StringType()),
    T.StructField("secondary_title", T.StringType()),
    T.StructField("genres", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("episode", T.IntegerType()),
    T.StructField("episode_end", T.IntegerType()),
    T.StructField("numbering_manual", T.BooleanType()),
    T.StructField("category_override", T.StringType()),
    T.StructField("from_online", T.BooleanType()),
    T.StructField("from_dataset", T.BooleanType()),
    T.StructField("confirmed_title", T.StringType()),
    T.StructField("title_manual", T.BooleanType()),
    T.StructField("year_ambiguous", T.BooleanType()),
    T.StructField("alternative_year", T.IntegerType()),
    T.StructField("linked_file_id", T.StringType()),
    T.StructField("feature_version", T.IntegerType()),
    T.StructField("consolidated", T.BooleanType()),
    T.StructField("awaiting_download", T.BooleanType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("quality", T.IntegerType()),
    T.StructField("audio_fingerprint", T.StringType()),
    T.StructField("video_fingerprint", T.StringType()),
    T.StructField("indexed_utc", T.TimestampNTZType()),
    T.StructField("plugin_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("hash_failed", T.BooleanType()),
])

TITLES = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("start_year", T.IntegerType()),
    T.StructField("end_year", T.IntegerType()),
    T.StructField("genres", T.ArrayType(T.StringType())),
    T.StructField("pos", T.LongType()),
])

EPISODES = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("series_id", T.IntegerType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("episode", T.IntegerType()),
    T.StructField("pos", T.LongType()),
])

LISTING = T.StructType([
    T.StructField("full_path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("last_modified_utc", T.TimestampNTZType()),
])
