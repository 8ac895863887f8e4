"""Listing and hashing files where they lie."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, extension_of
from ..functions.text import has_hash
from ..operators.categories import is_incomplete, media_kind
from ..operators.filters import Exclusion, descent_blocked, extension_ignored, path_excluded
from ..session import ensure_checkpoint_dir

#: Entries of one frame, and bytes read at once: what a task holds does not grow with folders or files.
FRAME_ROWS = 10_000
READ_BYTES = 1 << 20


def _entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(path, is folder, bytes, microseconds) of what lies in a folder, of a mounted path or of a path
    with a scheme. Links are not followed and what cannot be read is passed over."""
    if "://" in folder:
        store, inner = pafs.FileSystem.from_uri(folder)
        scheme = folder[: len(folder) - len(inner)] if folder.endswith(inner) else folder.split("://", 1)[0] + "://"
        for entry in store.get_file_info(pafs.FileSelector(inner, recursive=False)):
            yield scheme + entry.path, entry.type == pafs.FileType.Directory, entry.size or 0, (entry.mtime_ns or 0) // 1000
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                if not entry.is_symlink():
                    stat = entry.stat(follow_symlinks=False)
                    yield entry.path, entry.is_dir(follow_symlinks=False), stat.st_size, stat.st_mtime_ns // 1000
            except OSError:
                continue


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frame = lambda rows: pd.DataFrame(rows, columns=["full_path", "is_folder", "size_bytes", "at_us"])
    for batch in batches:
        rows: list[tuple] = []
        for folder in batch["folder"]:
            try:
                for entry in _entries(folder):
                    rows.append(entry)
                    if len(rows) >= FRAME_ROWS:
                        yield frame(rows)
                        rows = []
            except OSError:
                continue
        yield frame(rows)


def walk(spark: SparkSession, roots: Sequence[str], exclusions: Sequence[Exclusion] = ()) -> DataFrame:
    """Files below mounted folders or paths with a scheme, one job per depth; a blocked folder is not entered.

    Folders of one depth are scanned by all tasks. Empty files are seen on either kind of path.
    """
    ensure_checkpoint_dir(spark)
    level, found = spark.createDataFrame([(root,) for root in roots], "folder string"), None
    while True:
        entries = level.repartition("folder").mapInPandas(_scan, "full_path string, is_folder boolean, size_bytes bigint, at_us bigint").checkpoint()
        files = entries.filter("NOT is_folder").select("full_path", "size_bytes", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("last_modified_utc"))
        found = files if found is None else found.unionByName(files)
        level = entries.filter("is_folder").select(F.col("full_path").alias("folder")).filter(~descent_blocked(exclusions, "folder"))
        if level.isEmpty():
            return found


def list_files(
    spark: SparkSession, roots: Sequence[str], exclusions: Sequence[Exclusion] = (), ignored: Sequence[str] = (), plugin_extensions: tuple[str, ...] = ()
) -> DataFrame:
    """Media and half-downloaded files below the roots; only metadata is read."""
    found = walk(spark, roots, exclusions)
    named = found.withColumn("file_name", base_name("full_path")).withColumn("extension", extension_of("file_name"))
    named = named.withColumn("kind", media_kind(plugin_extensions=plugin_extensions)).filter((F.col("kind") != "Unknown") | is_incomplete())
    return named.filter(~extension_ignored(ignored) & ~path_excluded(exclusions))


def _open(path: str):
    if "://" in path:
        store, inner = pafs.FileSystem.from_uri(path)
        return store.open_input_stream(inner)
    return open(path, "rb")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of files read piece by piece, whatever their size."""
    for batch in batches:
        sums = []
        for path in batch["full_path"]:
            digest = hashlib.sha256()
            try:
                with _open(path) as source:
                    while piece := source.read(READ_BYTES):
                        digest.update(piece)
                sums.append(digest.hexdigest())
            except OSError:
                sums.append("")
        yield pd.DataFrame({"full_path": batch["full_path"], "_sum": sums})


def hash_files(files: DataFrame) -> DataFrame:
    """Fill ``sha256`` of rows without one (not empty, not incomplete); what cannot be read is marked
    ``hash_failed``. Only the files of these rows are opened, each path once."""
    wanted = ~has_hash() & (F.col("size_bytes") > 0) & ~is_incomplete()
    todo = files.filter(wanted).select("full_path").distinct()
    sums = todo.repartition("full_path").mapInPandas(_digest, "full_path string, _sum string")
    joined = files.withColumn("_todo", wanted).join(sums, "full_path", "left")
    return joined.withColumns({
        "sha256": F.when(F.col("_todo"), F.coalesce("_sum", F.lit(""))).otherwise(F.col("sha256")),
        "hash_failed": F.when(F.col("_todo"), F.coalesce(F.length("_sum"), F.lit(0)) == 0).otherwise(F.col("hash_failed")),
    }).drop("_sum", "_todo")


def scan_remaining(spark: SparkSession, listing_dir: str, done_dir: str) -> DataFrame:
    """What an interrupted scan still has to do: the saved listing less the rows already written.

    The listing is saved once (``listing.write.parquet(listing_dir)``); every finished part of the work is
    appended to ``done_dir``, so a resumed run starts where the last append ended.
    """
    listing = spark.read.parquet(listing_dir)
    try:
        done = spark.read.parquet(done_dir)
    except AnalysisException:
        return listing
    return listing.join(done.select("full_path"), "full_path", "left_anti")
