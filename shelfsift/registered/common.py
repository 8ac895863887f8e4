"""Registration of queries with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import testtables
from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "files": testtables.files_sql,
    "guide": testtables.guide_sql,
    "title_rows": testtables.title_rows_sql,
    "event_files": testtables.event_files_sql,
    "fingerprints": testtables.fingerprints_sql,
}


def oracle(body: str, *views: str) -> str:
    """DuckDB text with the wanted views in front; the body may open with its own WITH."""
    heads = [f"{view} AS ({VIEWS[view]()})" for view in (views or ("files",))]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        heads.append(body[5:])
        return "WITH RECURSIVE " + ", ".join(heads)
    return "WITH RECURSIVE " + ", ".join(heads) + " " + body


def register(name: str, sql: str | None = None, *views: str):
    """Decorator: register a query, with its oracle when it has one."""

    def add(query: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: query(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return query

    return add


# SQL text shared by the oracles.
EFF = "(CASE WHEN trim(confirmed_title) <> '' THEN confirmed_title ELSE parsed_title END)"
VERIFIED = "(from_dataset OR from_online OR title_manual)"
AUTO = (
    "(CASE WHEN season IS NOT NULL AND episode IS NOT NULL AND video_category NOT IN ('TvExtra','MovieExtra') THEN 'TvShow' "
    "WHEN kind = 'Video' THEN video_category WHEN kind = 'Audio' THEN 'Audio' ELSE 'Unknown' END)"
)
CAT = f"(CASE WHEN trim(category_override) <> '' THEN category_override ELSE {AUTO} END)"
DIR = "regexp_replace(full_path, '/[^/]*$', '')"
NUMBERING = (
    "(CASE WHEN season IS NULL OR episode IS NULL THEN '' WHEN episode_end > episode "
    "THEN printf('S%02dE%02d-E%02d', season, episode, episode_end) ELSE printf('S%02dE%02d', season, episode) END)"
)


def title_key(text: str) -> str:
    return f"lower(trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


def lookup_key(text: str) -> str:
    return f"lower(regexp_replace({text}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'))"


IDENTITY = (
    f"(CASE WHEN {title_key(EFF)} = '' OR kind NOT IN ('Video','Audio') OR {CAT} IN ('TvExtra','MovieExtra') "
    "OR video_category IN ('TvExtra','MovieExtra') THEN NULL "
    f"WHEN {CAT} = 'TvShow' OR video_category = 'TvShow' OR (season IS NOT NULL AND episode IS NOT NULL) THEN "
    "CASE WHEN season IS NOT NULL AND episode IS NOT NULL THEN "
    f"concat('tv|', {title_key(EFF)}, printf('|S%03dE%03d', season, episode), "
    "CASE WHEN episode_end > episode THEN printf('-%03d', episode_end) ELSE '' END) END "
    f"ELSE concat(kind, '|', {title_key(EFF)}, '|', coalesce(CAST(year AS VARCHAR), '')) END)"
)

TITLE_GROUPS = f"""keyed AS (SELECT *, {IDENTITY} AS title_group FROM files),
title_groups AS (
  SELECT title_group, count(*) AS members,
         count(DISTINCT nullif(upper(sha256), '')) + count(*) FILTER (sha256 = '') AS contents,
         CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
         CAST(sum(size_bytes) - max(size_bytes) AS BIGINT) AS reclaimable,
         count(DISTINCT size_bytes) > 1 AS differs_in_size,
         arg_min({{'t': trim({EFF}), 'n': {NUMBERING}, 'y': year}}, (ord, id)) AS head
  FROM keyed WHERE title_group IS NOT NULL GROUP BY title_group
  HAVING count(*) >= 2 AND count(DISTINCT nullif(upper(sha256), '')) + count(*) FILTER (sha256 = '') >= 2)"""

EXACT_GROUPS = """exact_groups AS (
  SELECT upper(sha256) AS hash_key, count(*) AS copies, arg_min(size_bytes, (full_path, id)) * (count(*) - 1) AS reclaimable,
         min(full_path) AS first_path
  FROM files WHERE sha256 <> '' GROUP BY upper(sha256) HAVING count(*) > 1)"""

BYTES_TEXT = """(CASE WHEN {x} < 1024 THEN concat({x}, ' B')
 WHEN {x} < 1048576 THEN concat(regexp_replace(printf('%.2f', round({x} / 1024.0, 2)), '\\.?0+$', ''), ' KB')
 WHEN {x} < 1073741824 THEN concat(regexp_replace(printf('%.2f', round({x} / 1048576.0, 2)), '\\.?0+$', ''), ' MB')
 WHEN {x} < 1099511627776 THEN concat(regexp_replace(printf('%.2f', round({x} / 1073741824.0, 2)), '\\.?0+$', ''), ' GB')
 ELSE concat(regexp_replace(printf('%.2f', round({x} / 1099511627776.0, 2)), '\\.?0+$', ''), ' TB') END)"""
