"""Folder hierarchy, edits and ingest queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.paths import parent_dir, path_key
from ..functions.text import effective_title
from ..operators import edits as E
from ..operators import folders as H
from ..operators import ingest as I
from ..operators.categories import effective_category
from ..operators.filters import Exclusion, extension_ignored, path_excluded
from ..operators.skew import first_by
from ..testtables import event_files, files, table
from .common import AUTO, CAT, DIR, EFF, VERIFIED, register

RULES_SQL = """rules AS (
  SELECT concat('/lib/', upper(substr(p_name, 1, 1)), '/', p_name, ' ', CAST(p_partkey AS STRING)) AS path, p_partkey % 3 <> 0 AS include_subdirectories,
         p_type AS value, p_partkey AS pos FROM {part} WHERE p_partkey % 4 = 3
  UNION ALL SELECT concat('/lib/', upper(substr(p_name, 1, 1)), '/', p_name, ' ', CAST(p_partkey AS STRING), '/Season 02/') AS path, p_partkey % 2 = 0 AS include_subdirectories,
         p_brand AS value, p_partkey + 1000000 AS pos FROM {part} WHERE p_partkey % 3 = 0
  UNION ALL SELECT '/lib/S' AS path, true AS include_subdirectories, 'Shelf S' AS value, -1 AS pos)"""
RULES = RULES_SQL.format(part="part")
# Rules meet files on equality of one of the file's folders.
HITS = f"""levels AS (SELECT DISTINCT {DIR} AS dir FROM files),
chains AS (SELECT dir, unnest(list_transform(range(2, len(string_split(dir, '/')) + 1), lambda n: array_to_string(list_slice(string_split(dir, '/'), 1, n), '/'))) AS above FROM levels),
hits AS (SELECT c.dir, r.* FROM chains c JOIN rules r ON upper(c.above) = upper(rtrim(r.path, '/')) WHERE r.include_subdirectories OR c.above = c.dir),
best AS (SELECT dir, arg_min(value, (-length(path), pos)) AS value FROM hits GROUP BY dir)"""


def rules(spark, sf):
    return spark.sql(f"WITH {RULES_SQL.format(part=f'parquet.`{sf}/part.parquet`')} SELECT * FROM rules")


@register("folder_rule", f"WITH {RULES}, {HITS} SELECT f.id, b.value AS rule_value FROM files f LEFT JOIN best b ON b.dir = {DIR}")
def _(spark, sf):
    return H.folder_rule(files(spark, sf), rules(spark, sf), "rule_value").select("id", "rule_value")


@register(
    "effective_category",
    f"WITH {RULES}, {HITS} SELECT f.id, CASE WHEN category_override <> '' THEN category_override ELSE coalesce(b.value, {AUTO}) END AS category FROM files f LEFT JOIN best b ON b.dir = {DIR}",
)
def _(spark, sf):
    ruled = H.folder_rule(files(spark, sf), rules(spark, sf), "rule_value")
    return ruled.select("id", effective_category(F.col("rule_value")).alias("category"))


@register(
    "apply_folder_title",
    f"""WITH {RULES}, {HITS} SELECT f.id, CASE WHEN NOT {VERIFIED} AND b.value IS NOT NULL THEN b.value ELSE confirmed_title END AS confirmed_title,
        title_manual OR (NOT {VERIFIED} AND b.value IS NOT NULL) AS title_manual FROM files f LEFT JOIN best b ON b.dir = {DIR}""",
)
def _(spark, sf):
    return H.apply_folder_title(files(spark, sf), rules(spark, sf)).select("id", "confirmed_title", "title_manual")


@register(
    "adopt_folder_rules",
    f"""WITH {RULES}, {HITS}, firsts AS (SELECT dir, arg_min(value, pos) AS cat, arg_max(value, pos) AS title FROM hits GROUP BY dir)
    SELECT f.id, CASE WHEN category_override = '' AND b.cat IS NOT NULL THEN b.cat ELSE category_override END AS category_override,
           coalesce(b.title, confirmed_title) AS confirmed_title, title_manual OR b.title IS NOT NULL AS title_manual, from_online AND b.title IS NULL AS from_online
    FROM files f LEFT JOIN firsts b ON b.dir = {DIR}""",
)
def _(spark, sf):
    adopted, _, _ = H.adopt_folder_rules(files(spark, sf), rules(spark, sf), rules(spark, sf))
    return adopted.select("id", "category_override", "confirmed_title", "title_manual", "from_online")


@register(
    "adopt_folder_rules_retired",
    f"WITH {RULES}, {HITS} SELECT path, pos, 'category' AS rule FROM rules WHERE pos IN (SELECT pos FROM hits) UNION ALL SELECT path, pos, 'title' FROM rules WHERE pos IN (SELECT pos FROM hits)",
)
def _(spark, sf):
    _, retired, _ = H.adopt_folder_rules(files(spark, sf), rules(spark, sf), rules(spark, sf))
    return retired.select("path", "pos", "rule")


@register("files_under", "SELECT id, full_path FROM files WHERE starts_with(full_path, '/lib/B/')")
def _(spark, sf):
    return H.files_under(files(spark, sf), "/LIB/b/").select("id", "full_path")


@register("files_under_any", f"WITH {RULES}, {HITS} SELECT id, full_path FROM files WHERE {DIR} IN (SELECT c.dir FROM chains c JOIN rules r ON c.above = rtrim(r.path, '/'))")
def _(spark, sf):
    return H.files_under_any(files(spark, sf), rules(spark, sf)).select("id", "full_path")


@register("siblings_of", f"SELECT id, full_path FROM files WHERE NOT (ord % 97 = 3) AND {DIR} IN (SELECT {DIR} FROM files WHERE ord % 97 = 3)")
def _(spark, sf):
    rows = files(spark, sf)
    return H.siblings_of(rows, rows.filter("ord % 97 = 3")).select("id", "full_path")


_OWNERS = f"""mains AS (SELECT id, ord, size_bytes, season, {DIR} AS dir FROM files WHERE kind = 'Video' AND video_category IN ('TvShow','Movie')),
extras AS (SELECT id, season, {DIR} AS dir FROM files WHERE video_category IN ('TvExtra','MovieExtra')),
main_up AS (SELECT *, unnest(list_transform(range(greatest(2, len(string_split(dir, '/')) - 5), len(string_split(dir, '/')) + 1), lambda n: array_to_string(list_slice(string_split(dir, '/'), 1, n), '/'))) AS above FROM mains),
best_s AS (SELECT above, season, min((-size_bytes, ord, id)) AS pick FROM main_up GROUP BY ALL),
best_a AS (SELECT above, min((-size_bytes, ord, id)) AS pick FROM main_up GROUP BY ALL),
extra_up AS (SELECT *, unnest(list_transform(range(greatest(2, len(string_split(dir, '/')) - 5), len(string_split(dir, '/')) + 1), lambda n: array_to_string(list_slice(string_split(dir, '/'), 1, n), '/'))) AS above FROM extras),
found AS (SELECT e.id, len(e.above) AS depth, coalesce(s.pick, a.pick) AS pick FROM extra_up e JOIN best_a a USING (above)
  LEFT JOIN best_s s ON s.above = e.above AND s.season = nullif(e.season, 0)),
owners AS (SELECT f.id, arg_max(o.id, depth) AS owner_id FROM found f JOIN mains o ON o.id = struct_extract_at(f.pick, 3) GROUP BY f.id)"""


@register(
    "link_extras",
    f"""WITH {_OWNERS}
    SELECT f.id, CASE WHEN f.video_category IN ('TvExtra','MovieExtra') THEN coalesce(o.id, '') ELSE f.linked_file_id END AS linked_file_id,
      CASE WHEN o.id IS NULL THEN f.video_category WHEN o.video_category = 'TvShow' THEN 'TvExtra' ELSE 'MovieExtra' END AS video_category,
      CASE WHEN o.id IS NOT NULL AND NOT f.title_manual THEN o.parsed_title ELSE f.parsed_title END AS parsed_title,
      CASE WHEN o.id IS NOT NULL AND NOT f.title_manual AND o.confirmed_title <> '' THEN o.confirmed_title ELSE f.confirmed_title END AS confirmed_title,
      CASE WHEN o.id IS NOT NULL AND NOT f.title_manual AND o.confirmed_title <> '' THEN o.title_manual ELSE f.title_manual END AS title_manual,
      CASE WHEN o.id IS NOT NULL THEN coalesce(f.year, o.year) ELSE f.year END AS year
    FROM files f LEFT JOIN owners w ON w.id = f.id LEFT JOIN files o ON o.id = w.owner_id""",
)
def _(spark, sf):
    return H.link_extras(files(spark, sf)).select(
        "id", "linked_file_id", "video_category", "parsed_title", "confirmed_title", "title_manual", "year"
    )


@register("linked_extras", f"WITH {_OWNERS} SELECT w.id, w.owner_id AS linked_file_id FROM owners w JOIN files f ON f.id = w.owner_id WHERE f.ord % 3 = 0")
def _(spark, sf):
    # Linking changes neither ids nor positions, so the selection is read from the files as they are.
    rows = files(spark, sf)
    return H.linked_extras(H.link_extras(rows), rows.filter("ord % 3 = 0")).select("id", "linked_file_id")


@register(
    "folder_details",
    f"""SELECT upper({DIR}) AS folder_key, count(*) AS files,
      CASE WHEN count(DISTINCT {EFF}) = 1 THEN min({EFF}) END AS title,
      CASE WHEN count(DISTINCT coalesce(year, -1)) = 1 THEN min(year) END AS year, CASE WHEN count(DISTINCT {CAT}) = 1 THEN min({CAT}) END AS category
      FROM files GROUP BY 1""",
)
def _(spark, sf):
    return H.folder_details(files(spark, sf), effective_category())


_LEFT = f"""lim AS (SELECT upper({DIR}) AS folder, min(CASE WHEN season IS NULL THEN 40000000 ELSE 250000000 END) AS threshold FROM files GROUP BY 1),
lst AS (SELECT upper({DIR}) AS dir, size_bytes, (integrity = 'IncompleteDownload') AS unfinished, id, file_name, upper(full_path) AS p, full_path FROM files),
per AS (SELECT dir, sum(CASE WHEN unfinished THEN 0 ELSE size_bytes END) AS bytes, count(*) AS n, bool_or(unfinished) AS u FROM lst GROUP BY 1),
tot AS (SELECT l.folder, min(threshold) AS threshold, sum(bytes) AS bytes, sum(n) AS files, bool_or(u) AS u FROM lim l
  JOIN per ON per.dir = l.folder OR (starts_with(per.dir, l.folder || '/')) GROUP BY 1),
leftover AS (SELECT folder, CAST(bytes AS BIGINT) AS bytes, CAST(files AS BIGINT) AS files, threshold FROM tot WHERE NOT u AND bytes <= threshold AND folder NOT LIKE '/LIB/S/%/SEASON 01')"""


def _leftovers(spark, sf):
    rows = files(spark, sf)
    listing = rows.withColumn("unfinished", F.col("integrity") == "IncompleteDownload")
    limits = rows.select(parent_dir("full_path").alias("folder"), F.when(F.col("season").isNull(), 40_000_000).otherwise(250_000_000).alias("threshold"))
    configured = rows.select(parent_dir("full_path").alias("path")).filter("path LIKE '/lib/S/%/Season 01'").distinct()
    return listing, H.leftover_folders(listing, limits, configured)


@register("leftover_folders", f"WITH {_LEFT} SELECT * FROM leftover")
def _(spark, sf):
    return _leftovers(spark, sf)[1]


@register(
    "leftover_examples",
    f"""WITH {_LEFT} SELECT folder, position, name FROM (SELECT o.folder, l.file_name AS name, row_number() OVER (PARTITION BY o.folder ORDER BY l.full_path, l.id) AS position
        FROM leftover o JOIN lst l ON l.dir = o.folder OR starts_with(l.dir, o.folder || '/')) WHERE position <= 6""",
)
def _(spark, sf):
    listing, leftovers = _leftovers(spark, sf)
    return H.leftover_examples(listing, leftovers)


@register(
    "empty_folders",
    f"""WITH d AS (SELECT DISTINCT upper({DIR}) AS folder FROM files WHERE size_bytes < 30000000), k AS (SELECT DISTINCT upper({DIR}) AS dir FROM files WHERE size_bytes >= 30000000),
    up AS (SELECT DISTINCT unnest(list_transform(range(2, len(string_split(dir, '/')) + 1), lambda n: array_to_string(list_slice(string_split(dir, '/'), 1, n), '/'))) AS above FROM k)
    SELECT folder, CAST(length(folder) AS INT) AS depth FROM d WHERE folder NOT IN (SELECT above FROM up)""",
)
def _(spark, sf):
    rows = files(spark, sf)
    return H.empty_folders(rows.filter("size_bytes < 30000000"), rows.filter("size_bytes >= 30000000"))


@register(
    "propagate_duplicate_metadata",
    f"""WITH src AS (SELECT upper(sha256) AS h, count(*) AS n,
        arg_min({{'id': id, 't': confirmed_title, 'o': from_online, 'd': from_dataset, 'm': title_manual}}, (CASE WHEN title_manual THEN 0 WHEN from_dataset THEN 1 ELSE 2 END, ord, id)) FILTER ({VERIFIED}) AS t,
        arg_min({{'id': id, 's': season, 'e': episode, 'x': episode_end, 'm': numbering_manual}}, (CASE WHEN numbering_manual THEN 0 ELSE 1 END, ord, id)) FILTER (season IS NOT NULL AND episode IS NOT NULL) AS k
      FROM files WHERE sha256 <> '' GROUP BY 1 HAVING count(*) > 1),
    m AS (SELECT f.*, s.t, s.k, coalesce(s.t.id <> f.id AND (NOT from_online OR confirmed_title <> s.t.t), false) AS tt,
        coalesce(s.k.id <> f.id AND NOT (numbering_manual AND NOT s.k.m) AND (season IS DISTINCT FROM s.k.s OR episode IS DISTINCT FROM s.k.e OR episode_end IS DISTINCT FROM s.k.x), false) AS tn
      FROM files f LEFT JOIN src s ON f.sha256 <> '' AND upper(f.sha256) = s.h)
    SELECT id, CASE WHEN tt THEN t.t ELSE confirmed_title END AS confirmed_title, CASE WHEN tt THEN t.o ELSE from_online END AS from_online,
      CASE WHEN tt THEN t.m ELSE title_manual END AS title_manual, CASE WHEN tn THEN k.x ELSE episode_end END AS episode_end,
      CASE WHEN tn THEN k.m ELSE numbering_manual END AS numbering_manual, CAST(tt AS INT) + CAST(tn AS INT) AS changes FROM m""",
)
def _(spark, sf):
    return E.propagate_duplicate_metadata(files(spark, sf)).select(
        "id", "confirmed_title", "from_online", "title_manual", "episode_end", "numbering_manual", "changes"
    )


@register(
    "propagate_duplicate_metadata_text",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, upper(sha256(text)) AS h, concat('Doc ', doc_id) AS title, coalesce(quality, 0) = 1 AS manual
        FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT h, arg_min({'id': id, 't': title}, (ord, id)) FILTER (manual) AS src FROM d GROUP BY h HAVING count(*) > 1)
    SELECT d.id, CASE WHEN s.src.id <> d.id THEN s.src.t WHEN manual THEN title ELSE '' END AS confirmed_title FROM d LEFT JOIN s ON d.h = s.h""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    manual = F.coalesce(F.col("quality"), F.lit(0)) == 1
    none = F.lit(None).cast("int")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("sha256"),
        F.when(manual, F.concat(F.lit("Doc "), "doc_id")).otherwise("").alias("confirmed_title"), manual.alias("title_manual"),
        F.lit(False).alias("from_online"), F.lit(False).alias("from_dataset"), none.alias("season"), none.alias("episode"),
        none.alias("episode_end"), F.lit(False).alias("numbering_manual"),
    )
    return E.propagate_duplicate_metadata(rows).select("id", "confirmed_title")


@register(
    "set_title",
    f"""SELECT id, CASE WHEN ord % 6 = 0 THEN concat('New ', parsed_title) ELSE confirmed_title END AS confirmed_title, title_manual OR ord % 6 = 0 AS title_manual,
        from_online AND ord % 6 <> 0 AS from_online, ord % 6 = 0 AND (confirmed_title <> concat('New ', parsed_title) OR NOT {VERIFIED} OR NOT title_manual) AS title_changed FROM files""",
)
def _(spark, sf):
    rows = files(spark, sf)
    edits = rows.filter("ord % 6 = 0").select("id", F.concat(F.lit(" New "), "parsed_title").alias("title"))
    return E.set_title(rows, edits).select("id", "confirmed_title", "title_manual", "from_online", "title_changed")


@register(
    "propagate_title",
    f"""WITH e AS (SELECT upper(trim({EFF})) AS k, arg_min({{'id': id, 't': concat('Renamed ', parsed_title)}}, (ord, id)) AS x FROM files WHERE ord % 13 = 0 GROUP BY 1)
    SELECT f.id, CASE WHEN x.id <> f.id THEN x.t ELSE confirmed_title END AS confirmed_title, CASE WHEN x.id <> f.id THEN false ELSE title_manual END AS title_manual,
      CASE WHEN x.id <> f.id THEN true ELSE from_online END AS from_online FROM files f LEFT JOIN e ON e.k = upper(trim({EFF}))""",
)
def _(spark, sf):
    rows = files(spark, sf)
    edits = rows.filter("ord % 13 = 0").select(
        "id", effective_title().alias("previous"), F.concat(F.lit("Renamed "), "parsed_title").alias("title"), F.struct("ord", "id").alias("pos")
    )
    return E.propagate_title(rows, edits).select("id", "confirmed_title", "title_manual", "from_online")


@register(
    "bulk_edit",
    f"""WITH hit AS (SELECT id FROM files WHERE starts_with(full_path, '/lib/films/B/') UNION SELECT id FROM files WHERE sha256 <> '' AND upper(sha256) IN
        (SELECT upper(sha256) FROM files WHERE starts_with(full_path, '/lib/films/B/')))
    SELECT f.id, CASE WHEN h.id IS NOT NULL THEN 1999 ELSE year END AS year, coalesce(h.id IS NULL, true) AND year_ambiguous AS year_ambiguous,
      CASE WHEN h.id IS NOT NULL THEN 'Documentary' ELSE category_override END AS category_override FROM files f LEFT JOIN hit h ON h.id = f.id
    WHERE video_category NOT IN ('TvExtra', 'MovieExtra')""",
)
def _(spark, sf):
    edited = E.bulk_edit(files(spark, sf), "/lib/films/B", title="One Title", year=1999, change_year=True, category="Documentary")
    return edited.filter(~F.col("video_category").isin("TvExtra", "MovieExtra")).select("id", "year", "year_ambiguous", "category_override")


# --- ingest: the catalogue is one row per path, the listing is what is on disk now -----------------

CATALOGUE = "cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upper(full_path) ORDER BY ord, id) AS rn FROM files) WHERE rn = 1)"
LISTING = CATALOGUE + """, listing AS (SELECT CASE WHEN ord % 7 = 1 THEN replace(full_path, '/lib/', '/moved/') ELSE full_path END AS full_path,
   CASE WHEN ord % 11 = 2 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, last_modified_utc, ord * 1000 + 1 AS pos, id AS lid FROM cat WHERE ord % 5 <> 3)"""
MOVES = """, gone AS (SELECT * FROM cat WHERE sha256 <> '' AND upper(full_path) NOT IN (SELECT upper(full_path) FROM listing)),
fresh AS (SELECT * FROM listing WHERE upper(full_path) NOT IN (SELECT upper(full_path) FROM cat)),
single AS (SELECT size_bytes, last_modified_utc, min(id) AS id, min(full_path) AS old_path FROM gone GROUP BY 1, 2 HAVING count(*) = 1),
moves AS (SELECT s.id, s.old_path, f.new_path FROM single s JOIN (SELECT size_bytes, last_modified_utc, arg_min(full_path, (pos, full_path)) AS new_path FROM fresh GROUP BY 1, 2) f USING (size_bytes, last_modified_utc))"""


def catalogue(spark, sf, hashes=True):
    """One row per path. Without ``hashes``, a hash is its first digit: enough to tell that there is one."""
    # A window and not an aggregate of whole rows, so that a query moves only the columns it reads.
    rows = files(spark, sf) if hashes else files(spark, sf).withColumn("sha256", F.substring("sha256", 1, 1))
    rows = rows.repartition(path_key("full_path"))
    place = F.row_number().over(Window.partitionBy(path_key("full_path")).orderBy("ord", "id"))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def listing(spark, sf):
    moved = F.when(F.col("ord") % 7 == 1, F.replace("full_path", F.lit("/lib/"), F.lit("/moved/"))).otherwise(F.col("full_path"))
    return catalogue(spark, sf).filter("ord % 5 <> 3").select(
        moved.alias("full_path"), F.when(F.col("ord") % 11 == 2, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        "last_modified_utc", (F.col("ord") * 1000 + 1).alias("pos"),
    )


@register("detect_moves", f"WITH {LISTING}{MOVES} SELECT * FROM moves")
def _(spark, sf):
    return I.detect_moves(catalogue(spark, sf, hashes=False), listing(spark, sf))


@register(
    "merge_listing",
    f"""WITH {LISTING}{MOVES}, cur AS (SELECT c.*, m.new_path, coalesce(m.new_path, c.full_path) AS p FROM cat c LEFT JOIN moves m ON m.id = c.id),
    inc AS (SELECT upper(full_path) AS k, arg_min({{'f': full_path, 's': size_bytes, 't': last_modified_utc}}, (pos, full_path)) AS l FROM listing GROUP BY 1),
    j AS (SELECT cur.*, l, CASE WHEN cur.id IS NULL THEN 'added' WHEN l IS NULL THEN 'unlisted' WHEN new_path IS NOT NULL THEN 'moved'
        WHEN size_bytes IS DISTINCT FROM l.s OR last_modified_utc IS DISTINCT FROM l.t THEN 'changed' ELSE 'kept' END AS status FROM cur FULL OUTER JOIN inc ON upper(cur.p) = inc.k)
    SELECT id, ord, coalesce(l.f, full_path) AS full_path, coalesce(l.s, size_bytes) AS size_bytes, CASE WHEN status IN ('added', 'changed') THEN '' ELSE sha256 END AS sha256, status,
           regexp_extract(coalesce(l.f, full_path), '([^/]*)$', 1) AS file_name, kind, parsed_title, confirmed_title, season, episode, year, quality, title_manual, duration_seconds FROM j""",
)
def _(spark, sf):
    kept = ["kind", "parsed_title", "confirmed_title", "season", "episode", "year", "quality", "title_manual", "duration_seconds"]
    held = catalogue(spark, sf).select("id", "ord", "full_path", "file_name", "extension", "size_bytes", "last_modified_utc", "sha256", "hash_failed", *kept)
    return I.merge_listing(held, listing(spark, sf)).select("id", "ord", "full_path", "size_bytes", "sha256", "status", "file_name", *kept)


@register(
    "prune_missing",
    f"""WITH {LISTING} SELECT id, full_path FROM cat WHERE upper(full_path) IN (SELECT upper(full_path) FROM listing)
        OR NOT (kind = 'Video' AND (starts_with(full_path, '/lib/films/') OR starts_with(full_path, '/lib/B/')))""",
)
def _(spark, sf):
    return I.prune_missing(catalogue(spark, sf), listing(spark, sf), ["/lib/films/", "/lib/b"], "video").select("id", "full_path")


@register(
    "scan_report",
    f"""WITH {LISTING} SELECT count(*) FILTER (pos % 17 = 0 AND NOT (full_path LIKE '/moved/T%')) AS missing, count(*) FILTER (pos % 17 <> 0 AND size_bytes > 0 AND size_bytes < 3000000) AS skipped_by_size,
        count(*) FILTER (pos % 17 <> 0) AS listed, (SELECT count(*) FROM cat WHERE sha256 = '' AND size_bytes > 0) AS unhashed FROM listing""",
)
def _(spark, sf):
    rows = listing(spark, sf).withColumns({
        "present": F.col("pos") % 17 != 0,
        "full_path": F.when(F.col("full_path").like("/moved/T%"), F.concat(F.lit("/temp"), "full_path")).otherwise(F.col("full_path")),
    })
    return I.scan_report(rows, catalogue(spark, sf, hashes=False), 3_000_000, 0)


@register(
    "adopt_listing",
    f"""WITH {LISTING} SELECT full_path, kind FROM (SELECT full_path, CASE WHEN lower(full_path) LIKE '%.mp3' OR lower(full_path) LIKE '%.flac' THEN 'Audio' ELSE 'Video' END AS kind FROM listing)
        WHERE upper(full_path) NOT IN (SELECT upper(full_path) FROM files) AND NOT starts_with(full_path, '/moved/R/') AND NOT lower(full_path) LIKE '%.avi'""",
)
def _(spark, sf):
    rules = [Exclusion("/moved/R")]
    return I.adopt_listing(files(spark, sf), listing(spark, sf), path_excluded(rules), extension_ignored([".avi"])).select("full_path", "kind")


@register(
    "deferred_roots",
    """SELECT id, CASE WHEN starts_with(full_path, '/lib/films/') OR starts_with(full_path, '/music/R/') THEN 'deferred' ELSE 'process' END AS phase FROM files""",
)
def _(spark, sf):
    roots = spark.createDataFrame([("/lib/films/", False), ("/music/R", False), ("/lib", True)], "root string, available boolean")
    return I.deferred_roots(files(spark, sf), roots).select("id", "phase")


@register("resume_backlog", "SELECT id, full_path FROM files WHERE consolidated AND NOT (ord % 2 = 0)")
def _(spark, sf):
    rows = files(spark, sf)
    return I.resume_backlog(rows.filter("consolidated"), rows.filter("ord % 2 = 0")).select("id", "full_path")


_CACHE = """cache AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'tv' WHEN 1 THEN 'movie' ELSE NULL END AS kind, concat(' ', upper(p_name), ' ', CAST(p_partkey AS STRING)) AS query,
   p_partkey % 5 <> 0 AS found, concat(p_name, ' canonical') AS canonical_name, p_partkey AS pos FROM {part} WHERE p_partkey % 4 <> 1)"""


def cache(spark, sf):
    return spark.sql(f"WITH {_CACHE.format(part=f'parquet.`{sf}/part.parquet`')} SELECT * FROM cache")


@register(
    "lookup_cache",
    f"""WITH {_CACHE.format(part='part')}, q AS (SELECT DISTINCT parsed_title AS query, CASE WHEN season IS NULL THEN 'movie' ELSE 'tv' END AS kind FROM files)
    SELECT q.kind, q.query, coalesce(a.found, b.found) AS found, coalesce(a.canonical_name, b.canonical_name) AS canonical_name FROM q
    LEFT JOIN cache a ON a.kind = q.kind AND upper(trim(a.query)) = upper(trim(q.query))
    LEFT JOIN cache b ON q.kind = 'tv' AND b.kind IS NULL AND upper(trim(b.query)) = upper(trim(q.query))""",
)
def _(spark, sf):
    questions = files(spark, sf).select(F.col("parsed_title").alias("query"), F.when(F.col("season").isNull(), "movie").otherwise("tv").alias("kind")).distinct()
    return I.lookup_cache(questions, cache(spark, sf))


@register(
    "lookup_cache_put",
    f"""WITH {_CACHE.format(part='part')}, ans AS (SELECT DISTINCT parsed_title AS query, 'tv' AS kind FROM files WHERE season IS NOT NULL)
    SELECT kind, query, found FROM cache UNION ALL SELECT kind, query, true FROM ans WHERE upper(query) NOT IN (SELECT upper(trim(query)) FROM cache WHERE kind = 'tv')""",
)
def _(spark, sf):
    answers = files(spark, sf).filter("season IS NOT NULL").select(
        F.col("parsed_title").alias("query"), F.lit("tv").alias("kind"), F.lit(True).alias("found"), F.lit("x").alias("canonical_name"), F.col("ord").alias("pos")
    )
    return I.lookup_cache_put(cache(spark, sf), answers).select("kind", "query", "found")
