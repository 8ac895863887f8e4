"""The stored catalogue: XML import, Parquet storage, scan progress."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FILES

VERSION = 1
# Files a task may have open at once; a catalogue of more kinds is sorted from there on.
OPEN_FILES_CONF, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 8

# Element names of the XML catalogue, by column.
XML_NAMES = {
    "id": "Id", "full_path": "FullPath", "file_name": "FileName", "extension": "Extension", "size_bytes": "SizeBytes",
    "last_modified_utc": "LastModifiedUtc", "kind": "Kind", "video_category": "VideoCategory", "integrity": "Integrity",
    "sha256": "Sha256", "parsed_title": "ParsedTitle", "secondary_title": "SecondaryTitle", "genres": "Genres", "year": "Year",
    "season": "Season", "episode": "Episode", "episode_end": "EpisodeEnd", "numbering_manual": "NumberingManuallySet",
    "category_override": "CategoryOverride", "from_online": "TmdbVerified", "from_dataset": "ImdbVerified",
    "confirmed_title": "TmdbName", "title_manual": "TitleManuallySet", "year_ambiguous": "YearAmbiguous",
    "alternative_year": "AlternativeYear", "linked_file_id": "LinkedFileId", "feature_version": "FeatureVersion",
    "consolidated": "Consolidated", "awaiting_download": "AwaitingDownload", "duration_seconds": "DurationSeconds",
    "quality": "Quality", "audio_fingerprint": "AudioFingerprint", "video_fingerprint": "VideoFingerprint",
    "indexed_utc": "IndexedUtc", "hash_failed": "HashFailed",
}
BLANKS = {T.StringType(): "", T.BooleanType(): False, T.LongType(): 0, T.DoubleType(): 0.0}
NULLABLE = {"year", "season", "episode", "episode_end", "alternative_year"}


def _xml_schema(row_names: bool = True) -> T.StructType:
    field = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Value", T.StringType())])
    fields = [T.StructField(xml, T.StringType() if isinstance(FILES[c].dataType, T.TimestampNTZType) else FILES[c].dataType) for c, xml in XML_NAMES.items()]
    wrapper = T.StructType([T.StructField("Field", T.ArrayType(field))])
    return T.StructType([*fields, T.StructField("PluginFields", wrapper)])


def empty_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILES)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Import the XML catalogue; a missing one is empty. ``ord`` follows the order of the elements.

    Sorting by nothing but the read order is what makes ``ord``, so it is taken as the file is read:
    ids grow along the file within a split and from split to split.
    """
    try:
        raw = spark.read.format("xml").option("rowTag", "File").schema(_xml_schema()).load(path)
    except AnalysisException:
        return empty_catalogue(spark)
    columns = []
    for field in FILES:
        name, kind = field.name, field.dataType
        if name == "ord":
            columns.append(F.monotonically_increasing_id().alias("ord"))
        elif name == "plugin_fields":
            entries = F.transform(F.coalesce("PluginFields.Field", F.array()), lambda e: F.struct(F.lower(e["Name"]), e["Value"]))
            columns.append(F.map_from_entries(entries).alias(name))
        elif isinstance(kind, T.TimestampNTZType):
            columns.append(F.expr(f"to_timestamp_ntz({XML_NAMES[name]})").alias(name))
        else:
            value = F.col(XML_NAMES[name])
            blank = BLANKS.get(kind, 0)
            columns.append((value if name in NULLABLE else F.coalesce(value, F.lit(blank))).cast(kind).alias(name))
    return migrate_catalog(raw.select(*columns), VERSION)


def migrate_catalog(files: DataFrame, version: int) -> DataFrame:
    """Changes between stored versions go here, one step per version."""
    return files


def write_catalog(files: DataFrame, folder: str) -> str:
    """Store a new version beside the old ones, then move the pointer: a reader sees the old or the new one whole.

    Gives the folder of the version written.
    """
    spark = files.sparkSession
    version = f"{folder}/v-{uuid.uuid4().hex}"
    # A task holds a file open for each of the few kinds; without that, Spark sorts the wide rows by kind, and spills them.
    open_files = spark.conf.get(OPEN_FILES_CONF)
    spark.conf.set(OPEN_FILES_CONF, str(OPEN_FILES))
    try:
        files.write.partitionBy("kind").parquet(version)
    finally:
        spark.conf.set(OPEN_FILES_CONF, open_files)
    pointer = spark.createDataFrame([(version,)], "version string").withColumn("written", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return version


def read_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The version the pointer names last; older ones stay readable for going back."""
    try:
        current = spark.read.parquet(f"{folder}/pointer").agg(F.max_by("version", "written")).first()[0]
    except AnalysisException:
        return empty_catalogue(spark)
    return spark.read.schema(FILES).parquet(current)
