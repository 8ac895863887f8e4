"""Catalogue-shaped views over the given test tables.

The text of each view is valid in Spark and in DuckDB alike (only the hash function and the
table references differ), so the oracle reads exactly the rows the operators read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.layout import spread

_FILES = """
SELECT id, ord, full_path, file_name, extension, kind, video_category, parsed_title, secondary_title,
       CASE WHEN ord % 5 = 0 THEN 'Drama, Comedy' ELSE '' END AS genres,
       CASE WHEN title_manual THEN concat(parsed_title, ' Cut')
            WHEN from_dataset OR from_online THEN concat('The ', parsed_title) ELSE '' END AS confirmed_title,
       from_dataset, from_online, title_manual, year,
       (film AND pk % 9 = 0) AS year_ambiguous,
       CASE WHEN film AND pk % 9 = 0 THEN year - 7 END AS alternative_year,
       season, episode, episode_end, numbering_manual, category_override,
       '' AS linked_file_id, feature_version, consolidated, awaiting_download,
       duration_seconds, quality, integrity, sha256, false AS hash_failed, size_bytes, last_modified_utc
FROM (
  SELECT *,
    concat(file_stem, extension) AS file_name,
    concat(folder, '/', file_stem, extension) AS full_path,
    CASE WHEN pk % 10 = 2 THEN 'Audio' ELSE 'Video' END AS kind,
    CASE WHEN pk % 10 = 2 THEN 'Unknown'
         WHEN film AND extra THEN 'MovieExtra' WHEN film THEN 'Movie'
         WHEN extra THEN 'TvExtra' ELSE 'TvShow' END AS video_category
  FROM (
    SELECT *,
      CASE WHEN film THEN concat('/lib/films/', letter, '/', title, ' (', CAST(1980 + pk % 40 AS STRING), ')', CASE WHEN extra THEN '/Extras' ELSE '' END)
           WHEN music THEN concat('/music/', letter, '/', title)
           ELSE concat('/lib/', letter, '/', title, '/Season 0', CAST(snum AS STRING), CASE WHEN extra THEN '/Extras' ELSE '' END) END AS folder,
      CASE WHEN film THEN concat(title, ' ', CAST(1980 + pk % 40 AS STRING), ' ', q, CASE WHEN extra THEN '-trailer' ELSE '' END)
           WHEN music THEN concat(title, ' - Track ', CAST(l_linenumber AS STRING))
           WHEN extra THEN concat('Behind the Scenes ', CAST(l_linenumber AS STRING), ' ', q)
           ELSE concat(title, ' S0', CAST(snum AS STRING), 'E0', CAST(l_linenumber AS STRING), ' ', q) END AS file_stem,
      CASE WHEN music THEN CASE WHEN l_returnflag = 'A' THEN '.flac' ELSE '.mp3' END
           WHEN l_returnflag = 'A' THEN '.mkv' WHEN l_returnflag = 'N' THEN '.mp4' ELSE '.AVI' END AS extension,
      CASE WHEN NOT film AND NOT music THEN CAST(snum AS INT) END AS season,
      CASE WHEN NOT film AND NOT music AND NOT extra THEN l_linenumber END AS episode,
      CASE WHEN NOT film AND NOT music AND l_linenumber = 5 AND l_suppkey % 10 = 0 THEN 6 END AS episode_end,
      CASE WHEN film AND pk % 7 <> 0 THEN CAST(1980 + pk % 40 AS INT) END AS year,
      title AS parsed_title,
      CASE WHEN l_linenumber = 1 THEN concat('Part of ', title) ELSE '' END AS secondary_title
    FROM (
      SELECT
        concat('m', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-',
               CAST(l_suppkey AS STRING), '-', CAST(CAST(l_shipdate AS DATE) AS STRING)) AS id,
        l_orderkey * 8 + l_linenumber AS ord,
        l_partkey AS pk, l_suppkey, l_linenumber, l_returnflag,
        concat(p_name, ' ', CAST(p_partkey AS STRING)) AS title,
        upper(substr(p_name, 1, 1)) AS letter,
        l_orderkey % 3 + 1 AS snum,
        l_partkey % 10 < 2 AS film, l_partkey % 10 = 2 AS music, l_linenumber = 7 AS extra,
        CASE l_suppkey % 4 WHEN 0 THEN '480p' WHEN 1 THEN '720p' WHEN 2 THEN '1080p' ELSE '2160p' END AS q,
        CASE WHEN l_tax = 0.02 THEN 0 WHEN l_suppkey % 4 = 0 THEN 480 WHEN l_suppkey % 4 = 1 THEN 720
             WHEN l_suppkey % 4 = 2 THEN 1080 ELSE 2160 END AS quality,
        CAST(l_quantity * 1048576 AS BIGINT) AS size_bytes,
        CAST(CASE WHEN l_tax = 0.01 THEN 0 ELSE 2400 + l_quantity * 1.5 END AS DOUBLE) AS duration_seconds,
        CASE WHEN l_discount >= 0.09 THEN 'Corrupt' WHEN l_tax = 0.03 AND l_discount = 0.0 THEN 'IncompleteDownload'
             WHEN l_linestatus = 'O' THEN 'Ok' ELSE 'NotChecked' END AS integrity,
        CASE WHEN l_tax = 0.08 THEN '' ELSE {sha}(concat(CAST(l_partkey AS STRING), '|', CAST(l_orderkey % 3 AS STRING), '|',
             CAST(l_linenumber AS STRING), '|', CAST(l_suppkey % 4 AS STRING)){bits}) END AS sha256,
        l_shipdate AS last_modified_utc,
        l_discount = 0.04 AS title_manual, l_discount = 0.05 AS from_dataset, l_discount = 0.01 AS from_online,
        (l_tax = 0.04 AND l_discount = 0.02) AS numbering_manual,
        CASE WHEN l_partkey % 50 = 13 THEN 'Documentary' ELSE '' END AS category_override,
        CASE WHEN l_suppkey % 5 = 0 THEN 5 ELSE 6 END AS feature_version,
        l_returnflag = 'A' AS consolidated,
        (l_tax = 0.07 AND l_discount = 0.0) AS awaiting_download
      FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
    ) a
  ) b
) c
"""

_GUIDE = """
SELECT CAST((p_partkey + 1) * 1000 + season * 20 + episode AS INT) AS id, CAST(p_partkey + 1 AS INT) AS series_id,
       season, episode, concat(p_type, ' tale ', CAST(episode AS STRING)) AS title,
       p_partkey * 100 + season * 20 + episode AS pos
FROM (SELECT p_partkey, p_type, CAST(floor(slot / 9) AS INT) + 1 AS season, CAST(slot % 9 AS INT) + 1 AS episode
      FROM (SELECT p_partkey, p_type, {slots} AS slot FROM {part}) g) t
WHERE season <= 3 OR p_partkey % 4 = 0
"""

# Raw rows as a title dataset has them: text ids, ``\\N`` handled upstream as null.
_TITLE_ROWS = """
SELECT pos, tconst, title_type, primary_title, start_year, end_year, genres FROM (
  SELECT CAST(p_partkey * 2 AS BIGINT) AS pos, concat('tt', CAST(p_partkey + 1 AS STRING)) AS tconst,
         CASE WHEN p_partkey % 10 < 2 THEN 'movie' WHEN p_partkey % 10 < 8 THEN 'tvSeries' ELSE 'TVMINISERIES' END AS title_type,
         CASE WHEN p_partkey % 31 = 0 THEN concat('Episode #', CAST(p_partkey AS STRING))
              WHEN p_partkey % 37 = 0 THEN '21.01.2015' ELSE concat(p_name, ' ', CAST(p_partkey AS STRING)) END AS primary_title,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST(1940 + p_size AS INT) END AS start_year, CAST(NULL AS INT) AS end_year,
         CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat(p_type, ',', substr(p_brand, 1, 7)) END AS genres
  FROM {part}
  UNION ALL
  SELECT CAST(p_partkey * 2 + 1 AS BIGINT) AS pos, concat('tt', CAST(p_partkey + 5000001 AS STRING)) AS tconst,
         CASE WHEN p_partkey % 3 = 0 THEN 'tvSeries' ELSE 'tvMovie' END AS title_type,
         upper(concat(p_name, '-', CAST(p_partkey AS STRING))) AS primary_title,
         CAST(1990 + p_partkey % 35 AS INT) AS start_year, CAST(2000 + p_partkey % 20 AS INT) AS end_year,
         lower(p_type) AS genres
  FROM {part} WHERE p_partkey % 2 = 0
) t
"""

_EVENT_FILES = """
SELECT event_id, {ts} AS ts, concat('/inbox/u', CAST(user_id AS STRING), '/', event_type, ' ', CAST(user_id % 10 AS STRING), ' S01E0',
       CAST(user_id % 9 + 1 AS STRING), CASE WHEN user_id % 11 = 0 THEN '.txt' WHEN user_id % 2 = 0 THEN '.mkv' ELSE '.mp3' END) AS full_path,
       CAST(floor(value / 12) AS BIGINT) AS size_bytes
FROM {events}
"""

# Each vector gives three signatures: its sign bits, and two with vec_id % 10 bits flipped at one end.
_FINGERPRINTS = """
SELECT CAST(vec_id * 3 + v AS STRING) AS id, vec_id * 3 + v AS ord, 'Video' AS kind, frames,
       CAST(CASE WHEN label = 0 THEN 0 ELSE 1200 + label * 20 + v * 25 END AS DOUBLE) AS duration_seconds
FROM {signs}
"""


def _table(spark_dir: str | None, name: str) -> str:
    return f"parquet.`{spark_dir}/{name}.parquet`" if spark_dir else name


def files_sql() -> str:
    return _FILES.format(sha="sha256", bits="", lineitem="lineitem", part="part")


def guide_sql(spark_dir: str | None = None) -> str:
    slots = "explode(sequence(0, 35))" if spark_dir else "unnest(range(0, 36))"
    return _GUIDE.format(part=_table(spark_dir, "part"), slots=slots)


def title_rows_sql(spark_dir: str | None = None) -> str:
    return _TITLE_ROWS.format(part=_table(spark_dir, "part"))


def event_files_sql(spark_dir: str | None = None, events: str | None = None) -> str:
    # A month of events squeezed into 43 minutes, the pace at which a folder is polled.
    if spark_dir:
        ts = "timestamp_micros(CAST(1704067200000000 + floor((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 1000) AS BIGINT))"
    else:
        ts = "make_timestamp(CAST(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 1000 AS BIGINT))"
    return _EVENT_FILES.format(events=events or _table(spark_dir, "events"), ts=ts)


def fingerprints_sql(spark_dir: str | None = None) -> str:
    if spark_dir:
        signs = (
            "(SELECT vec_id, label, v, array(w ^ CASE v WHEN 0 THEN 0L WHEN 1 THEN shiftleft(1L, CAST(vec_id % 10 AS INT)) - 1 "
            "ELSE shiftleft(shiftleft(1L, CAST(vec_id % 10 AS INT)) - 1, 20) END) AS frames FROM "
            "(SELECT vec_id, label, explode(sequence(0, 2)) AS v, aggregate(sequence(0, 63), 0L, (a, i) -> a | shiftleft("
            "CAST(CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END AS BIGINT), i)) AS w "
            f"FROM {_table(spark_dir, 'embeddings')}) b) s"
        )
    else:
        signs = (
            "(SELECT vec_id, label, v, xor(w, CASE v WHEN 0 THEN 0::HUGEINT WHEN 1 THEN (1::HUGEINT << (vec_id % 10)) - 1 "
            "ELSE ((1::HUGEINT << (vec_id % 10)) - 1) << 20 END) AS frames FROM "
            "(SELECT vec_id, label, unnest(range(0, 3)) AS v, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 "
            "THEN CAST(1 AS HUGEINT) << i ELSE CAST(0 AS HUGEINT) END)) AS w FROM embeddings) b) s"
        )
    return _FINGERPRINTS.format(signs=signs)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return spark.sql(_FILES.format(sha="sha2", bits=", 256", lineitem="{lines}", part="{parts}"), lines=rows, parts=table(spark, sf_dir, "part"))


def guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(guide_sql(sf_dir))


def title_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(title_rows_sql(sf_dir))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(event_files_sql(sf_dir))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(fingerprints_sql(sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
