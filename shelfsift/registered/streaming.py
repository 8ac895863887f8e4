"""Streams over the events table, read as a file source and run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..operators.filters import Exclusion
from ..session import ensure_checkpoint_dir
from ..streaming.watch import new_file_notices, notice_text, open_bursts, read_watched, run_to_table, settled_files, use_state_store, watch_new_files
from ..testtables import event_files, event_files_sql, table
from .common import register


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    view = f"events_stream_{uuid.uuid4().hex}"
    source.createOrReplaceTempView(view)
    # The watermark needs a timestamp with a zone.
    return spark.sql(event_files_sql(sf, events=view)).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@register(
    "watch_new_files",
    """WITH known AS (SELECT DISTINCT full_path FROM event_files WHERE event_id % 50 = 7), ok AS (SELECT * FROM event_files WHERE NOT full_path LIKE '%.txt' AND size_bytes > 0
        AND NOT starts_with(full_path, '/inbox/u12/') AND NOT (full_path LIKE '%.mp3' AND full_path LIKE '/inbox/u3_/%' AND false)),
    firsts AS (SELECT full_path, arg_min({'s': size_bytes, 't': epoch_us(ts)}, (ts, event_id)) AS f FROM ok WHERE full_path NOT IN (SELECT full_path FROM known) GROUP BY full_path)
    SELECT full_path, regexp_extract(full_path, '[^/]*$') AS file_name, CASE WHEN full_path LIKE '%.mp3' THEN 'Audio' ELSE 'Video' END AS kind, f.s AS size_bytes, f.t AS at_us, true AS awaiting_download FROM firsts""",
    "event_files",
)
def _(spark, sf):
    folder, known = _folder(spark), event_files(spark, sf).filter("event_id % 50 = 7").select("full_path")
    use_state_store(spark)
    watch_new_files(_stream(spark, sf), known, f"{folder}/rows", f"{folder}/state", [Exclusion("/inbox/u12")], [".tmp"]).trigger(availableNow=True).start().awaitTermination()
    return read_watched(spark, f"{folder}/rows").select("full_path", "file_name", "kind", "size_bytes", F.unix_micros("ts").alias("at_us"), "awaiting_download")


@register(
    "settled_files",
    f"""WITH e AS (SELECT full_path, size_bytes AS s, epoch_us(ts) AS t, row_number() OVER (PARTITION BY full_path ORDER BY ts, event_id) AS n FROM event_files),
    w AS (SELECT full_path, n, t AS first_us, s AS size, 0 AS repeats, true AS is_open, NULL::BIGINT AS lost_us, NULL::BIGINT AS settled_us FROM e WHERE n = 1
      UNION ALL
      SELECT full_path, n, CASE WHEN anew THEN t ELSE first_us END, s, CASE WHEN anew OR NOT same THEN 0 ELSE repeats + 1 END, anew OR NOT same OR repeats + 1 < 2,
        CASE WHEN is_open AND late THEN first_us + 1800000000 END, CASE WHEN NOT anew AND same AND repeats + 1 >= 2 THEN t END
      FROM (SELECT w.full_path, e.n, e.s, e.t, w.first_us, w.repeats, w.is_open, e.t >= w.first_us + 1800000000 AS late, NOT w.is_open OR e.t >= w.first_us + 1800000000 AS anew, e.s = w.size AND e.s > 0 AS same
            FROM w JOIN e ON e.full_path = w.full_path AND e.n = w.n + 1) x),
    ends AS (SELECT full_path, arg_max(first_us, n) AS first_us, arg_max(is_open, n) AS is_open FROM w GROUP BY full_path)
    SELECT full_path, 'given up' AS outcome, NULL::BIGINT AS size_bytes, lost_us AS at_us FROM w WHERE lost_us IS NOT NULL
    UNION ALL SELECT full_path, 'settled', size, settled_us FROM w WHERE settled_us IS NOT NULL
    UNION ALL SELECT full_path, 'given up', NULL, first_us + 1800000000 FROM ends WHERE is_open AND first_us + 1800000000 <= (SELECT max(t) // 1000 * 1000 - 60000000 FROM e)""",
    "event_files",
)
def _(spark, sf):
    folder = _folder(spark)
    return run_to_table(settled_files(_stream(spark, sf)), f"{folder}/out", f"{folder}/state")


@register(
    "new_file_notices",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY watcher ORDER BY t, event_id) AS n FROM
      (SELECT event_id, epoch_us(ts) AS t, regexp_extract(full_path, '^/inbox/([^/]*)/', 1) AS watcher, regexp_extract(full_path, '[^/]*$') AS name FROM event_files)),
    b AS (SELECT watcher, n, t AS opened_us, name AS first_name FROM e WHERE n = 1
      UNION ALL SELECT e.watcher, e.n, CASE WHEN e.t >= b.opened_us + 20000000 THEN e.t ELSE b.opened_us END, CASE WHEN e.t >= b.opened_us + 20000000 THEN e.name ELSE b.first_name END
      FROM b JOIN e ON e.watcher = b.watcher AND e.n = b.n + 1)
    SELECT watcher, opened_us, count(*) AS files, min(first_name) AS first_name,
      CASE WHEN count(*) = 1 THEN concat('Added new file: ', min(first_name)) ELSE concat('Added ', count(*), ' new files, starting with ', min(first_name), '.') END AS message
    FROM b GROUP BY watcher, opened_us""",
    "event_files",
)
def _(spark, sf):
    folder = _folder(spark)
    arrivals = _stream(spark, sf).select(
        "event_id", "ts", F.regexp_extract("full_path", r"^/inbox/([^/]*)/", 1).alias("watcher"), base_name("full_path").alias("file_name")
    )
    closed = run_to_table(new_file_notices(arrivals), f"{folder}/out", f"{folder}/state")
    return closed.unionByName(open_bursts(spark, f"{folder}/state")).withColumn("message", notice_text())
