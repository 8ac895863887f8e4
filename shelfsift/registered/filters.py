"""Filters, views and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import parent_dir
from ..functions.text import effective_title, identifier, title_id_text, title_id_value
from ..operators import categories as C
from ..operators import duplicates as D
from ..operators import filters as X
from ..testtables import event_files, files, table
from .common import BYTES_TEXT, CAT, DIR, EFF, EXACT_GROUPS, NUMBERING, TITLE_GROUPS, VERIFIED, register

RULES = (
    X.Exclusion("/lib/films/R"), X.Exclusion("/lib/S/", True), X.Exclusion("*/blue * 1?? */*", False),
    X.Exclusion("/music/c*", True), X.Exclusion("/lib/B", False),
)
_EXCLUDED = """(upper(full_path) LIKE '/LIB/FILMS/R/%' OR upper(full_path) LIKE '/LIB/S/%'
  OR regexp_matches(full_path, '(?i)^.*/blue .* 1.. .*/.*$') OR regexp_matches(full_path, '(?i)^/music/c.*$'))"""


@register("size_filter", "SELECT id, size_bytes FROM files WHERE size_bytes <= 0 OR (size_bytes >= 5000000 AND size_bytes <= 40000000)")
def _(spark, sf):
    return X.size_filter(files(spark, sf), 5_000_000, 40_000_000).select("id", "size_bytes")


@register("kind_filter", "SELECT id, extension FROM files WHERE lower(extension) IN ('.flac', '.mp3')")
def _(spark, sf):
    return X.kind_filter(files(spark, sf), "audio").select("id", "extension")


@register("ignored_extensions", "SELECT id, extension FROM files WHERE lower(extension) <> '.avi' AND NOT lower(extension) LIKE '.m_4'")
def _(spark, sf):
    return X.ignored_extensions(files(spark, sf), [" .avi ", ".m?4", ""]).select("id", "extension")


@register("path_exclusion", f"SELECT id, full_path FROM files WHERE NOT {_EXCLUDED}")
def _(spark, sf):
    return X.path_exclusion(files(spark, sf), X.effective_exclusions(RULES)).select("id", "full_path")


@register(
    "descent_block",
    f"""SELECT id, full_path FROM files WHERE NOT (upper({DIR}) = '/LIB/FILMS/R' OR upper({DIR}) LIKE '/LIB/FILMS/R/%' OR upper({DIR}) LIKE '/LIB/S/%'
        OR regexp_matches({DIR}, '(?i)^/music/c.*$') OR regexp_matches({DIR}, '(?i)/Season 03(/|$)'))""",
)
def _(spark, sf):
    rules = X.effective_exclusions([*RULES[:2], RULES[3], X.Exclusion("*/Season 03")])
    return X.descent_block(files(spark, sf), rules).select("id", "full_path")


@register(
    "rule_supersedes",
    """WITH rules AS (SELECT DISTINCT {d} AS path, season IS NULL OR season <> 2 AS rec FROM files),
    r AS (SELECT path, rec, upper(path) AS k FROM rules UNION ALL SELECT '*/Season 03', true, '*/SEASON 03' UNION ALL SELECT '/lib/films', true, '/LIB/FILMS')
    SELECT DISTINCT o.path AS outer_path, i.path AS inner_path FROM r o JOIN r i ON
      (o.k = i.k AND (o.path <> i.path OR o.rec <> i.rec) AND (o.rec OR NOT i.rec))
      OR (o.k <> i.k AND o.rec AND o.k NOT LIKE '%*%' AND i.k NOT LIKE '%*%' AND starts_with(i.k, o.k || '/') AND o.path NOT LIKE '/lib/films/%')
      OR (o.k <> i.k AND o.rec AND o.k NOT LIKE '%*%' AND i.k NOT LIKE '%*%' AND starts_with(i.k, o.k || '/') AND o.path LIKE '/lib/films/%')
      OR (o.k = '*/SEASON 03' AND i.k NOT LIKE '%*%' AND regexp_matches(i.k, '^.*/SEASON 03(/.*)?$'))""".replace("{d}", DIR),
)
def _(spark, sf):
    rules = files(spark, sf).select(
        parent_dir("full_path").alias("path"), (F.col("season").isNull() | (F.col("season") != 2)).alias("include_subdirectories")
    ).distinct()
    extra = spark.createDataFrame([("*/Season 03", True), ("/lib/films", True)], rules.schema)
    return X.rule_supersedes(rules.unionByName(extra))


@register("visible_files", f"SELECT id, full_path FROM files WHERE NOT {_EXCLUDED} AND lower(extension) <> '.avi'")
def _(spark, sf):
    return X.visible_files(files(spark, sf), X.effective_exclusions(RULES), [".avi"]).select("id", "full_path")


@register("drop_files", "SELECT id FROM files WHERE NOT (ord % 5 = 1)")
def _(spark, sf):
    rows = files(spark, sf)
    return X.drop_files(rows, rows.filter("ord % 5 = 1")).select("id")


def _display(spark, sf):
    rows = files(spark, sf)
    flagged = D.with_duplicate_flags(rows, rows.filter("duration_seconds > 2470"), C.effective_category())
    return flagged.withColumn("category", C.effective_category())


_ENRICHED = f"""{EXACT_GROUPS}, {TITLE_GROUPS}, enriched AS (SELECT *, {CAT} AS category,
  CASE WHEN sha256 <> '' AND upper(sha256) IN (SELECT hash_key FROM exact_groups) THEN 'DUP' WHEN duration_seconds > 2470 THEN '~dup'
       WHEN title_group IN (SELECT title_group FROM title_groups) THEN 'title' ELSE '' END AS duplicate_flag,
  coalesce(title_group IN (SELECT title_group FROM title_groups), false) AS is_title_duplicate FROM keyed)"""


@register(
    "view_filter",
    f"""WITH {_ENRICHED}
    SELECT 'All' AS view, count(*) AS rows FROM enriched UNION ALL SELECT 'Video', count(*) FILTER (kind = 'Video') FROM enriched
    UNION ALL SELECT 'Audio', count(*) FILTER (kind = 'Audio') FROM enriched UNION ALL SELECT 'Movies', count(*) FILTER (category = 'Movie') FROM enriched
    UNION ALL SELECT 'TvShows', count(*) FILTER (category = 'TvShow') FROM enriched
    UNION ALL SELECT 'Extras', count(*) FILTER (category IN ('TvExtra','MovieExtra')) FROM enriched
    UNION ALL SELECT 'Consolidated', count(*) FILTER (consolidated) FROM enriched UNION ALL SELECT 'NotConsolidated', count(*) FILTER (NOT consolidated) FROM enriched
    UNION ALL SELECT 'Duplicates', count(*) FILTER (duplicate_flag = 'DUP') FROM enriched
    UNION ALL SELECT 'NearDuplicates', count(*) FILTER (duplicate_flag = '~dup') FROM enriched
    UNION ALL SELECT 'SameTitle', count(*) FILTER (is_title_duplicate) FROM enriched UNION ALL SELECT 'UncertainYear', count(*) FILTER (year_ambiguous) FROM enriched
    UNION ALL SELECT 'Problems', count(*) FILTER (integrity IN ('Corrupt','IncompleteDownload')) FROM enriched""",
)
def _(spark, sf):
    return X.view_counts(_display(spark, sf))


@register("view_problems", f"WITH {_ENRICHED} SELECT id, full_path, category, duplicate_flag FROM enriched WHERE integrity IN ('Corrupt','IncompleteDownload')")
def _(spark, sf):
    return X.view_filter(_display(spark, sf), "Problems").select("id", "full_path", "category", "duplicate_flag")


_SECONDS = "CAST(round_even(duration_seconds, 0) AS BIGINT)"
_DISPLAY = f"""shown AS (SELECT id, file_name AS "Name", kind AS "Kind", {CAT} AS "Category", {EFF} AS "Primary title", secondary_title AS "Secondary title",
  genres AS "Genres", CASE WHEN year IS NULL THEN '' WHEN year_ambiguous THEN concat(year, ' ?') ELSE CAST(year AS VARCHAR) END AS "Year", {NUMBERING} AS "S/E",
  {BYTES_TEXT.format(x='size_bytes')} AS "Size",
  CASE WHEN duration_seconds <= 0 THEN '' WHEN {_SECONDS} >= 3600 THEN printf('%d:%02d:%02d', {_SECONDS} // 3600, {_SECONDS} % 3600 // 60, {_SECONDS} % 60)
       ELSE printf('%d:%02d', {_SECONDS} // 60, {_SECONDS} % 60) END AS "Length",
  CASE WHEN quality <= 0 THEN '' WHEN kind = 'Audio' THEN concat(quality, ' kbps') ELSE concat(quality, 'p') END AS "Quality",
  integrity AS "Integrity", full_path AS "Path", '' AS "Dup", CASE WHEN title_manual THEN '✎' WHEN {VERIFIED} THEN '✓' ELSE '' END AS "TMDb",
  CASE WHEN consolidated THEN 'yes' ELSE 'no' END AS "Consolidated" FROM files)"""


def _shown(spark, sf):
    rows = files(spark, sf).withColumns({"category": C.effective_category(), "duplicate_flag": F.lit("")})
    return X.display_view(rows)


@register("display_view", f"WITH {_DISPLAY} SELECT * FROM shown")
def _(spark, sf):
    return _shown(spark, sf)


@register(
    "column_filter",
    f"""WITH {_DISPLAY} SELECT id, "Name", "Quality" FROM shown WHERE regexp_matches("Name", '(?i)^.*S0.E0[1-3].*\\.mkv$') AND contains(lower("Quality"), 'p')
        AND NOT trim("Secondary title") = '' AND NOT contains(lower("Primary title"), 'cut')""",
)
def _(spark, sf):
    clauses = [X.Clause("Name", "*s0?e0?*.mkv"), X.Clause("Quality", "p"), X.Clause("Secondary title", "(blank)", True), X.Clause("Primary title", "CUT", True)]
    return X.column_filter(_shown(spark, sf), clauses).select("id", "Name", "Quality")


@register("distinct_values", "SELECT DISTINCT trim(g) AS genre FROM (SELECT unnest(string_split(genres, ',')) AS g FROM files) WHERE trim(g) <> ''")
def _(spark, sf):
    return X.distinct_genres(files(spark, sf))


@register(
    "category_list",
    """WITH builtin AS (SELECT * FROM (VALUES (0,'Movie'),(1,'TvShow'),(2,'TvExtra'),(3,'MovieExtra'),(4,'Other'),(5,'Unknown'),(6,'Audio')) b(pos, category)),
    every AS (SELECT 0 AS source, pos, category FROM builtin UNION ALL SELECT 1, min(p_partkey), p_type FROM part GROUP BY p_type
      UNION ALL SELECT 2, min(ord), category_override FROM files WHERE category_override <> '' GROUP BY category_override UNION ALL SELECT 2, 0, 'movie'),
    uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upper(category) ORDER BY source, pos) AS rn FROM every) WHERE rn = 1)
    SELECT category, source, pos, w.wanted, category NOT IN ('TvExtra','MovieExtra') AS consolidatable
    FROM uniq LEFT JOIN (SELECT upper(label_name) AS k, min(p) AS wanted FROM (SELECT p_type AS label_name, min(p_size) AS p FROM part GROUP BY 1) GROUP BY 1) w ON upper(category) = w.k""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    plugin = part.groupBy(F.col("p_type").alias("category")).agg(F.min("p_partkey").alias("pos"))
    custom = files(spark, sf).filter("category_override <> ''").groupBy(F.col("category_override").alias("category")).agg(F.min("ord").alias("pos"))
    custom = custom.unionByName(spark.createDataFrame([("movie", 0)], "category string, pos bigint"))
    order = part.groupBy(F.col("p_type").alias("category")).agg(F.min("p_size").alias("pos"))
    return C.category_list(spark, plugin, custom, order)


@register(
    "needs_probe",
    """SELECT id, kind FROM files WHERE kind IN ('Audio','Video') AND integrity <> 'IncompleteDownload' AND (duration_seconds <= 0 OR quality <= 0)""",
)
def _(spark, sf):
    return files(spark, sf).filter(C.needs_probe()).select("id", "kind")


@register("needs_fingerprint", "SELECT id FROM files WHERE kind = 'Audio' OR kind = 'Video' AND ord % 3 <> 0")
def _(spark, sf):
    rows = files(spark, sf).withColumns({
        "audio_fingerprint": F.lit(""), "video_fingerprint": F.when(F.col("ord") % 3 == 0, F.col("id")).otherwise(""),
    })
    return rows.filter(C.needs_fingerprint()).select("id")


@register("without_title", f"SELECT id FROM files WHERE trim(CASE WHEN ord % 4 = 0 AND confirmed_title = '' THEN ' ' ELSE {EFF} END) = '' AND {CAT} NOT IN ('TvExtra','MovieExtra')")
def _(spark, sf):
    rows = files(spark, sf).withColumn("parsed_title", F.when(F.col("ord") % 4 == 0, " ").otherwise(F.col("parsed_title")))
    return X.without_title(rows, C.effective_category()).select("id")


@register("pending_rehash", "SELECT id, awaiting_download FROM files WHERE awaiting_download OR sha256 = ''")
def _(spark, sf):
    return C.pending_rehash(files(spark, sf)).select("id", "awaiting_download")


@register("quick_integrity", """SELECT integrity, count(*) AS files FROM (SELECT CASE WHEN lower(regexp_extract(full_path, '(\\.[^.]+)$', 1)) = '.txt' THEN 'IncompleteDownload'
  WHEN size_bytes = 0 THEN 'Corrupt' ELSE 'Ok' END AS integrity FROM event_files) t GROUP BY 1""", "event_files")
def _(spark, sf):
    rows = event_files(spark, sf).withColumn("extension", F.when(F.col("full_path").endswith(".txt"), ".part").otherwise(".mkv"))
    return rows.groupBy(C.quick_integrity().alias("integrity")).agg(F.count(F.lit(1)).alias("files"))


@register(
    "policy_for",
    f"""WITH c AS (SELECT id, {CAT} AS category FROM files)
    SELECT id, category, CASE category WHEN 'TvShow' THEN 20 WHEN 'TvExtra' THEN 20 WHEN 'Movie' THEN 0 WHEN 'MovieExtra' THEN 5 ELSE 0 END AS tolerance,
           CASE category WHEN 'TvShow' THEN 5000 WHEN 'TvExtra' THEN 5000 WHEN 'Movie' THEN 70000 WHEN 'MovieExtra' THEN 1 ELSE 0 END AS threshold FROM c""",
)
def _(spark, sf):
    policies = spark.createDataFrame(
        [("tvshow", 20, 5000), ("Movie", -3, 70000), ("MovieExtra", 5, 1)], "category string, tolerance int, threshold int"
    )
    return C.policy_for(files(spark, sf), C.effective_category(), policies, {"tolerance": 0, "threshold": 0}).select("id", "category", "tolerance", "threshold")


@register(
    "strip_numbering",
    f"""WITH s AS (SELECT *, {CAT} NOT IN ('TvShow','TvExtra') AND NOT numbering_manual AND (season IS NOT NULL OR episode IS NOT NULL OR episode_end IS NOT NULL) AS unnumbered FROM files)
    SELECT id, unnumbered, CASE WHEN NOT unnumbered THEN season END AS season, CASE WHEN NOT unnumbered THEN episode END AS episode,
           CASE WHEN NOT unnumbered THEN episode_end END AS episode_end FROM s""",
)
def _(spark, sf):
    return C.strip_numbering(files(spark, sf), C.effective_category()).select("id", "unnumbered", "season", "episode", "episode_end")


@register(
    "title_ids",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE CAST(doc_id AS INT) END AS number, CASE WHEN doc_id % 5 = 0 THEN 'tt0000000' ELSE printf('tt%07d', doc_id) END AS id_text,
       CASE WHEN doc_id % 2 = 0 THEN concat('Source', upper(substr(source, 1, 1)), substr(source, 2)) ELSE concat('Lang', upper(substr(lang, 1, 1)), substr(lang, 2), CAST(doc_id AS VARCHAR)) END AS field FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    number = title_id_value(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("tt99999999999"), "doc_id")).otherwise(F.concat(F.lit("tt"), F.col("doc_id"))))
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("1 source_"), "source")).otherwise(F.concat(F.lit("lang "), "lang", F.lit("-"), "doc_id"))
    return docs.select("doc_id", number.alias("number"), title_id_text(number).alias("id_text"), identifier(name).alias("field"))
