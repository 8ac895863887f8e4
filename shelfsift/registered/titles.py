"""Title dataset and gap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import effective_title
from ..operators import gaps as G
from ..operators import titles as T
from ..operators.categories import effective_category
from ..testtables import files, guide, table, title_rows
from .common import AUTO, CAT, EFF, VERIFIED, lookup_key, register, title_key
from .folders import _CACHE, cache

VERDICT = """CASE WHEN primary_title IS NULL OR primary_title = '' THEN 'no title'
  WHEN regexp_matches(primary_title, '(?i)^Episode\\s*(#|dated\\b|\\d{1,4})') THEN 'generic title'
  WHEN regexp_matches(primary_title, '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}\\b') THEN 'timestamp title'
  WHEN CASE WHEN start_year > 1800 AND start_year < 2200 THEN start_year END < 1950 THEN 'outside years'
  WHEN coalesce(TRY_CAST(substr(tconst, 3) AS INT), 0) <= 0 THEN 'bad id' ELSE 'kept' END"""
TITLES = f"""titles AS (SELECT CAST(substr(tconst, 3) AS INT) AS id, coalesce(title_type, 'unknown') AS type, primary_title AS title, start_year, end_year,
   list_filter(string_split(coalesce(genres, ''), ','), lambda g: g <> '') AS genres, pos FROM title_rows WHERE {VERDICT} = 'kept')"""
INDEX = f"""tindex AS (SELECT {lookup_key('title')} AS lookup_key, arg_min(title, pos) AS title, max(start_year) AS year, min(start_year) AS earliest_year,
   coalesce(min(start_year) <> max(start_year), false) AS ambiguous, arg_min(array_to_string(genres, ', '), pos) FILTER (len(genres) > 0) AS genres,
   coalesce(arg_max(id, (coalesce(start_year, 0), pos)) FILTER (lower(type) IN ('tvseries', 'tvminiseries')), 0) AS series_id
   FROM titles WHERE {lookup_key('title')} <> '' GROUP BY 1)"""


def titles(spark, sf):
    return T.extract_titles(title_rows(spark, sf))


@register("extract_titles", f"WITH {TITLES} SELECT id, type, title, start_year, end_year, array_to_string(genres, ',') AS genres, pos FROM titles", "title_rows")
def _(spark, sf):
    return titles(spark, sf).withColumn("genres", F.array_join("genres", ","))


@register("extraction_report", f"SELECT {VERDICT} AS verdict, count(*) AS rows FROM title_rows GROUP BY 1", "title_rows")
def _(spark, sf):
    return T.extraction_report(title_rows(spark, sf))


@register(
    "title_codes",
    f"""WITH {TITLES}, names AS (SELECT 'type' AS kind, type AS name, pos, 0 AS spot FROM titles UNION ALL
        SELECT 'genre', genres[i], pos, i - 1 FROM (SELECT genres, pos, unnest(range(1, len(genres) + 1)) AS i FROM titles)),
    firsts AS (SELECT kind, upper(name) AS k, arg_min(name, (pos, spot)) AS name, min((pos, spot)) AS f FROM names GROUP BY 1, 2)
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY f, k) - 1 AS code, name FROM firsts""",
    "title_rows",
)
def _(spark, sf):
    return T.title_codes(titles(spark, sf))


@register(
    "encode_titles",
    f"""WITH {TITLES}, firsts AS (SELECT upper(type) AS k, min(pos) AS f FROM titles GROUP BY 1), codes AS (SELECT k, row_number() OVER (ORDER BY f) - 1 AS code FROM firsts)
    SELECT id, code AS type_code FROM titles JOIN codes ON upper(type) = k""",
    "title_rows",
)
def _(spark, sf):
    rows = titles(spark, sf)
    return T.encode_titles(rows, T.title_codes(rows)).select("id", "type_code")


RAW_EPISODES = """raw_episodes AS (SELECT concat('tt', CAST(p_partkey + 1 AS STRING)) AS tconst,
  CASE WHEN p_partkey % 13 = 0 THEN '\\N' ELSE concat('tt', CAST(p_partkey % 100 + 1 AS STRING)) END AS parent_tconst,
  CASE WHEN p_partkey % 5 <> 0 THEN p_size % 4 END AS season, CASE WHEN p_partkey % 10 <> 0 THEN p_size % 9 + 1 END AS episode, p_partkey AS pos FROM {part})"""


@register(
    "extract_episodes",
    f"""WITH {TITLES}, {RAW_EPISODES.format(part='part')} SELECT CAST(substr(tconst, 3) AS INT) AS id, CAST(substr(parent_tconst, 3) AS INT) AS series_id, season, episode, pos
    FROM raw_episodes WHERE parent_tconst LIKE 'tt%' AND (season IS NOT NULL OR episode IS NOT NULL) AND CAST(substr(tconst, 3) AS INT) IN (SELECT id FROM titles)""",
    "title_rows",
)
def _(spark, sf):
    raw = spark.sql("WITH " + RAW_EPISODES.format(part=f"parquet.`{sf}/part.parquet`").replace("'\\N'", "'N'") + " SELECT * FROM raw_episodes")
    return T.extract_episodes(raw, titles(spark, sf))


@register("title_index", f"WITH {TITLES}, {INDEX} SELECT * FROM tindex", "title_rows")
def _(spark, sf):
    return T.title_index(titles(spark, sf))


@register(
    "lookup_titles",
    f"""WITH {TITLES}, {INDEX}, q AS (SELECT DISTINCT {EFF} AS question FROM files)
    SELECT question, {lookup_key('question')} AS lookup_key, title, year, earliest_year, ambiguous, genres, series_id FROM q LEFT JOIN tindex ON tindex.lookup_key = {lookup_key('question')}""",
    "files", "title_rows",
)
def _(spark, sf):
    return T.lookup_titles(files(spark, sf).select(effective_title().alias("question")), titles(spark, sf))


@register(
    "lookup_by_id",
    f"WITH {TITLES} SELECT id, arg_max(title, pos) AS title FROM titles WHERE id IN (SELECT p_partkey + 1 FROM part WHERE p_size > 20) GROUP BY id",
    "title_rows",
)
def _(spark, sf):
    ids = table(spark, sf, "part").filter("p_size > 20").select((F.col("p_partkey") + 1).cast("int").alias("id"))
    return T.lookup_by_id(titles(spark, sf), ids).select("id", "title")


@register("known_genres", f"WITH {TITLES} SELECT DISTINCT unnest(genres) AS genre FROM titles", "title_rows")
def _(spark, sf):
    return T.known_genres(titles(spark, sf))


# Candidate names of the test catalogue: the title, then the folders (nearest first), short and season folders last.
_CANDS = """named AS (SELECT *, list_reverse(list_filter(string_split(regexp_replace(full_path, '/[^/]*$', ''), '/'), lambda x: x <> '')) AS fs FROM files),
ordered AS (SELECT *, list_concat([parsed_title], list_concat(
   list_filter(fs, lambda n: NOT (length(n) <= 1 OR regexp_matches(n, '(?i)^(season|series)\\s*\\d+$'))),
   list_filter(fs, lambda n: length(n) <= 1 OR regexp_matches(n, '(?i)^(season|series)\\s*\\d+$')))) AS os FROM named),
cleaned AS (SELECT *, list_transform(os, lambda n: trim(regexp_replace(n, '[._]', ' ', 'g'))) AS cs FROM ordered),
flat AS (SELECT *, list_filter(flatten(list_transform(cs, lambda n: [n, trim(regexp_replace(n, '[(\\[{][^)\\]}]*[)\\]}]\\s*$', '')),
   trim(regexp_replace(CASE WHEN trim(regexp_replace(n, '[(\\[{][^)\\]}]*[)\\]}]\\s*$', '')) <> '' THEN trim(regexp_replace(n, '[(\\[{][^)\\]}]*[)\\]}]\\s*$', '')) ELSE n END,
       '[\\s._-]+(19|20)\\d{2}\\s*$', ''))])), lambda n: n <> '') AS vs FROM cleaned),
cand AS (SELECT id, rank, candidate FROM (SELECT id, candidate, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS rank FROM (
   SELECT id, arg_min(candidate, i) AS candidate, min(i) AS i FROM (SELECT id, unnest(vs) AS candidate, unnest(range(1, len(vs) + 1)) AS i FROM flat) GROUP BY id, upper(candidate)))
   WHERE true)"""


@register("title_candidates", f"WITH {_CANDS} SELECT id, CAST(rank AS INT) AS rank, candidate FROM cand")
def _(spark, sf):
    return T.title_candidates(files(spark, sf))


_NEEDS = f"(kind = 'Video' AND video_category IN ('Movie','TvShow','MovieExtra','TvExtra') AND NOT {VERIFIED})"


@register(
    "verify_titles",
    f"""WITH {TITLES}, {INDEX}, {_CANDS}, {_CACHE.format(part='part')},
    hits AS (SELECT c.id, arg_min({{'t': i.title, 'g': i.genres}}, c.rank) AS h FROM cand c JOIN files f ON f.id = c.id AND {_NEEDS} JOIN tindex i ON i.lookup_key = {lookup_key('c.candidate')} GROUP BY 1),
    online AS (SELECT c.id, arg_min(coalesce(a.canonical_name, b.canonical_name), c.rank) AS n FROM cand c JOIN files f ON f.id = c.id AND {_NEEDS}
      LEFT JOIN cache a ON a.kind = CASE WHEN f.video_category IN ('Movie','MovieExtra') THEN 'movie' ELSE 'tv' END AND upper(trim(a.query)) = upper(trim(c.candidate))
      LEFT JOIN cache b ON f.video_category NOT IN ('Movie','MovieExtra') AND b.kind IS NULL AND upper(trim(b.query)) = upper(trim(c.candidate))
      WHERE coalesce(a.found, b.found) GROUP BY 1)
    SELECT f.id, CASE WHEN NOT {_NEEDS} THEN NULL WHEN h.id IS NOT NULL THEN 'dataset' WHEN o.id IS NOT NULL THEN 'online' ELSE 'unresolved' END AS outcome,
      CASE WHEN {_NEEDS} AND h.id IS NOT NULL THEN h.h.t WHEN {_NEEDS} AND o.id IS NOT NULL THEN o.n ELSE confirmed_title END AS confirmed_title,
      CASE WHEN {_NEEDS} AND h.id IS NOT NULL AND f.genres = '' THEN coalesce(h.h.g, '') ELSE f.genres END AS genres
    FROM files f LEFT JOIN hits h ON h.id = f.id LEFT JOIN online o ON o.id = f.id""",
    "files", "title_rows",
)
def _(spark, sf):
    return T.verify_titles(files(spark, sf), titles(spark, sf), cache(spark, sf)).select("id", "outcome", "confirmed_title", "genres")


@register(
    "fill_years",
    f"""WITH {TITLES}, {INDEX} SELECT f.id, coalesce(f.year, CASE WHEN kind = 'Video' THEN i.year END) AS year,
      CASE WHEN f.year IS NULL AND kind = 'Video' AND i.year IS NOT NULL THEN i.ambiguous ELSE year_ambiguous END AS year_ambiguous,
      CASE WHEN f.year IS NULL AND kind = 'Video' AND i.year IS NOT NULL THEN CASE WHEN i.ambiguous THEN i.earliest_year END ELSE alternative_year END AS alternative_year
      FROM files f LEFT JOIN tindex i ON i.lookup_key = {lookup_key(EFF)}""",
    "files", "title_rows",
)
def _(spark, sf):
    return T.fill_years(files(spark, sf), titles(spark, sf)).select("id", "year", "year_ambiguous", "alternative_year")


@register(
    "fill_genres",
    f"""WITH {TITLES}, {INDEX} SELECT f.id, CASE WHEN trim(f.genres) = '' THEN coalesce(i.genres, f.genres) ELSE f.genres END AS genres
      FROM files f LEFT JOIN tindex i ON i.lookup_key = {lookup_key(EFF)}""",
    "files", "title_rows",
)
def _(spark, sf):
    return T.fill_genres(files(spark, sf), titles(spark, sf)).select("id", "genres")


@register(
    "verification_report",
    f"""WITH {TITLES}, {INDEX}, {_CANDS},
    hits AS (SELECT DISTINCT c.id FROM cand c JOIN tindex i ON i.lookup_key = {lookup_key('c.candidate')})
    SELECT count(*) FILTER ({_NEEDS} AND h.id IS NOT NULL) AS dataset_verified, CAST(0 AS BIGINT) AS online_verified, count(*) FILTER ({_NEEDS} AND h.id IS NULL) AS unresolved,
      count(*) FILTER (f.year IS NULL AND kind = 'Video' AND i.year IS NOT NULL) AS years_filled,
      count(*) FILTER (f.year IS NULL AND kind = 'Video' AND i.year IS NOT NULL AND i.ambiguous) AS years_uncertain,
      count(*) FILTER (trim(f.genres) = '' AND i.genres IS NOT NULL) AS genres_filled
    FROM files f LEFT JOIN hits h ON h.id = f.id LEFT JOIN tindex i ON i.lookup_key = {lookup_key(EFF)}""",
    "files", "title_rows",
)
def _(spark, sf):
    rows, known = files(spark, sf), titles(spark, sf)
    return T.verification_report(T.verify_titles(rows, known), T.fill_years(rows, known), T.fill_genres(rows, known))


# --- gaps ------------------------------------------------------------------------------------------

EPISODE_TITLES = "etitles AS (SELECT id, title FROM guide WHERE id % 3 <> 0)"
HELD = f"""holders AS (SELECT {title_key(EFF)} AS show_key, season, unnest(range(episode, greatest(coalesce(episode_end, 0), episode) + 1)) AS number, ord, id, {EFF} AS eff, secondary_title
  FROM files WHERE consolidated AND {CAT} = 'TvShow' AND season IS NOT NULL AND episode IS NOT NULL AND {title_key(EFF)} <> ''),
held AS (SELECT show_key, season, number, arg_min(id, (ord, id)) AS file_id, arg_min(secondary_title, (ord, id)) AS secondary_title FROM holders GROUP BY 1, 2, 3),
shows AS (SELECT show_key, show_name, coalesce(series_id, 0) AS series_id FROM (SELECT show_key, arg_min(trim(eff), (ord, id)) AS show_name FROM holders GROUP BY 1) s
  LEFT JOIN tindex ON lookup_key = {lookup_key('show_name')}),
gs AS (SELECT series_id, season, count(*) AS episodes, max(episode) AS last_episode FROM guide GROUP BY 1, 2),
expect AS (SELECT h.show_key, h.season, count(*) AS held, greatest(max(number), coalesce(any_value(last_episode), 0)) AS expected, coalesce(any_value(last_episode), 0) > 0 AS from_guide,
   any_value(show_name) AS show_name, any_value(s.series_id) AS series_id FROM held h JOIN shows s USING (show_key) LEFT JOIN gs ON gs.series_id = s.series_id AND gs.season = h.season GROUP BY 1, 2),
missing AS (SELECT e.show_name, e.season, CAST(e.number AS INT) AS number, coalesce(t.title, '') AS episode_title, e.held, e.expected, e.from_guide FROM
   (SELECT *, unnest(range(1, expected + 1)) AS number FROM expect) e LEFT JOIN held h ON h.show_key = e.show_key AND h.season = e.season AND h.number = e.number
   LEFT JOIN guide g ON g.series_id = e.series_id AND g.season = e.season AND g.episode = e.number LEFT JOIN etitles t ON t.id = g.id WHERE h.number IS NULL)"""
_G = ("files", "title_rows", "guide")


def _gap_inputs(spark, sf):
    rows = files(spark, sf)
    category = effective_category()
    episodes = guide(spark, sf)
    names = episodes.filter("id % 3 <> 0").select("id", "title", "pos")
    shows = G.shows_of(rows, category, titles(spark, sf))
    held = G.held_episodes(rows, category)
    wanted = G.series_guide(episodes, shows)
    return rows, held, shows, wanted, names


@register("series_guide", f"WITH {TITLES}, {INDEX}, {HELD} SELECT series_id, season, episode, id FROM guide WHERE series_id IN (SELECT series_id FROM shows)", *_G)
def _(spark, sf):
    return _gap_inputs(spark, sf)[3]


@register("held_episodes", f"WITH {TITLES}, {INDEX}, {HELD} SELECT show_key, season, CAST(number AS INT) AS number, file_id FROM held", *_G)
def _(spark, sf):
    return _gap_inputs(spark, sf)[1].drop("secondary_title")


@register("missing_episodes", f"WITH {TITLES}, {INDEX}, {EPISODE_TITLES}, {HELD} SELECT * FROM missing", *_G)
def _(spark, sf):
    _, held, shows, wanted, names = _gap_inputs(spark, sf)
    return G.missing_episodes(held, shows, wanted, names)


@register(
    "missing_seasons",
    f"WITH {TITLES}, {INDEX}, {HELD} SELECT show_name, gs.season, episodes FROM shows s JOIN gs ON gs.series_id = s.series_id WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.show_key = s.show_key AND h.season = gs.season)",
    *_G,
)
def _(spark, sf):
    _, held, shows, wanted, _ = _gap_inputs(spark, sf)
    return G.missing_seasons(held, shows, wanted)


_NAMED = """named AS (SELECT h.file_id AS id, arg_min(t.title, h.number) AS name FROM held h JOIN shows s USING (show_key) JOIN guide g ON g.series_id = s.series_id AND g.season = h.season AND g.episode = h.number
  JOIN etitles t ON t.id = g.id WHERE trim(h.secondary_title) = '' GROUP BY 1)"""


@register(
    "name_episodes",
    f"WITH {TITLES}, {INDEX}, {EPISODE_TITLES}, {HELD}, {_NAMED} SELECT f.id, coalesce(n.name, f.secondary_title) AS secondary_title, n.id IS NOT NULL AS named FROM files f LEFT JOIN named n ON n.id = f.id",
    *_G,
)
def _(spark, sf):
    return G.name_episodes(*_gap_inputs(spark, sf)).select("id", "secondary_title", "named")


@register(
    "gap_report",
    f"""WITH {TITLES}, {INDEX}, {EPISODE_TITLES}, {HELD}, {_NAMED} SELECT count(*) AS shows_checked, count(*) FILTER (series_id > 0) AS identified,
        (SELECT count(*) FROM missing) AS missing, (SELECT count(*) FROM named) AS named FROM shows""",
    *_G,
)
def _(spark, sf):
    rows, held, shows, wanted, names = _gap_inputs(spark, sf)
    return G.gap_report(shows, G.missing_episodes(held, shows, wanted, names), G.name_episodes(rows, held, shows, wanted, names))
