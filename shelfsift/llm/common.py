"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Word separators: the ASCII white space the contracts name.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and every executor share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: lineage ends here.

    Spark's output committer publishes each task once, so the rows stay as first written even
    when executors are lost and tasks run again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) runs of rows of about ``limit`` in all; one larger row is a run of its own. What a
    task holds is then bounded by the limit and its largest row."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def split_long(df: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` as a row of their own behind a generator, so the optimizer does not inline
    them into lambdas that would evaluate them once an element."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def give_back() -> None:
    """Return freed memory of this Python worker to the system. Spark keeps workers from stage to
    stage, and both allocators would hold on to the most that any stage has used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(function):
    """A function of one or two Arrow groups that gives its memory back when it has made its table."""

    def one(table):
        made = function(table)
        give_back()
        return made

    def two(left, right):
        made = function(left, right)
        give_back()
        return made

    return two if len(inspect.signature(function).parameters) == 2 else one
