"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows one task may hold for a single key before the key is treated as hot and split.
HOT_ROWS_CONF = "spark.shelfsift.hotRows"
HOT_ROWS_DEFAULT = 500_000


# HotSpot does not compile methods above 8000 bytes of bytecode. Wide expression trees reach that in
# one fused method; past the limit Spark should split the work instead of running it interpreted.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators are planned with; anything the session sets already stays."""
    for key, value in TUNING.items():
        if spark.conf.get(key, None) in (None, "65535"):
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.appName("shelfsift")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(builder.getOrCreate())


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for ``checkpoint()``.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of its own, since nobody else has to read it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if configured:
        context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows written once, as Parquet in the checkpoint folder, and read from there.

    Cuts the lineage as ``checkpoint()`` does, but rows are compressed, and each later step reads only
    the columns it needs.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
