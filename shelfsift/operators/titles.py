"""The external title dataset: extraction, lookup, verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder_names, slashed
from ..functions.text import effective_title, is_blank, lookup_key, not_blank, strip, title_id_value, title_verified
from ..session import ensure_checkpoint_dir
from .skew import first_by, ranked
from .reports import one_row

# Titles that name no work.
GENERIC_EPISODE = r"(?iu)^Episode\s*(?:#|dated\b|\d{1,4}(?!\d))"
TIMESTAMP_TITLE = (
    r"(?iu)^\d{1,2}\s*[.\-/]\s*\p{L}{3,}\.?\s*[.\-/]?\s*\d{4}\b"
    r"|^\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{4}\b"
    r"|\bkl\.?\s*\d{1,2}[:.]\d{2}\b"
    r"|^\d{1,2}[:.]\d{2}(?::\d{2})?$"
)


def valid_year(year) -> Column:
    value = F.col(year) if isinstance(year, str) else year
    return F.when((value > 1800) & (value < 2200), value)


def extraction_verdict(start: int | None = 1950, end: int | None = None) -> Column:
    """Why a raw title row is dropped, or ``kept``."""
    title, year = F.col("primary_title"), valid_year("start_year")
    outside = F.lit(False)
    if start is not None:
        outside = outside | (year < start)
    if end is not None:
        outside = outside | (year > end)
    return (
        F.when(title.isNull() | (title == ""), "no title")
        .when(F.regexp_replace(title, r"^\s+", "").rlike(GENERIC_EPISODE), "generic title")
        .when(F.trim(title).rlike(TIMESTAMP_TITLE), "timestamp title")
        .when(F.coalesce(outside, F.lit(False)), "outside years")
        .when(title_id_value("tconst") <= 0, "bad id")
        .otherwise("kept")
    )


def extract_titles(raw: DataFrame, start: int | None = 1950, end: int | None = None) -> DataFrame:
    """Title rows worth keeping, with numeric ids and split genres."""
    kept = raw.filter(extraction_verdict(start, end) == "kept")
    genres = F.filter(F.split(F.coalesce("genres", F.lit("")), ","), lambda g: F.length(g) > 0)
    return kept.select(
        title_id_value("tconst").alias("id"),
        F.coalesce(F.when(not_blank("title_type"), F.trim("title_type")), F.lit("unknown")).alias("type"),
        F.col("primary_title").alias("title"),
        valid_year("start_year").alias("start_year"),
        valid_year("end_year").alias("end_year"),
        genres.alias("genres"),
        "pos",
    )


def extraction_report(raw: DataFrame, start: int | None = 1950, end: int | None = None) -> DataFrame:
    return raw.groupBy(extraction_verdict(start, end).alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


def title_codes(titles: DataFrame) -> DataFrame:
    """Dense ids of types and genres in first-seen order, ignoring case; the first spelling stays."""
    types = titles.select(F.lit("type").alias("kind"), F.col("type").alias("name"), "pos", F.lit(0).alias("at"))
    genres = titles.select(F.lit("genre").alias("kind"), "pos", F.posexplode("genres").alias("at", "name")).select("kind", "name", "pos", "at")
    names = types.unionByName(genres).filter(not_blank("name")).withColumn("name", F.trim("name"))
    first = names.groupBy("kind", F.upper("name").alias("_key")).agg(
        F.min_by("name", F.struct("pos", "at")).alias("name"), F.min(F.struct("pos", "at")).alias("first_at")
    )
    # The distinct names are a few hundred at most, so numbering them is a small window per kind.
    numbered = ranked(first.select("kind", "name", "_key", "first_at.*"), ["kind"], ["pos", "at", "_key"], "code")
    return numbered.select("kind", (F.col("code") - 1).alias("code"), "name")


def encode_titles(titles: DataFrame, codes: DataFrame) -> DataFrame:
    """Titles with their type as a code."""
    types = codes.filter("kind = 'type'").select(F.upper("name").alias("_t"), F.col("code").alias("type_code"))
    return titles.withColumn("_t", F.upper("type")).join(types, "_t", "left").drop("_t")


def extract_episodes(raw: DataFrame, titles: DataFrame) -> DataFrame:
    """Episode rows with valid ids, a kept title, and a season or an episode number.

    ``raw``: tconst, parent_tconst, season, episode, pos. When no title was kept at all, none is required.
    """
    rows = raw.select(
        title_id_value("tconst").alias("id"), title_id_value("parent_tconst").alias("series_id"), "season", "episode", "pos"
    ).filter("id > 0 AND series_id > 0 AND (season IS NOT NULL OR episode IS NOT NULL)")
    if titles.isEmpty():
        return rows
    return rows.join(titles.select("id"), "id", "left_semi")


def title_index(titles: DataFrame) -> DataFrame:
    """One answer per lookup key: title, years, ambiguity, genres and the latest series of that name."""
    keyed = titles.withColumn("lookup_key", lookup_key("title")).filter(F.col("lookup_key") != "")
    has_genres = F.size("genres") > 0
    series = F.lower("type").isin("tvseries", "tvminiseries")
    return keyed.groupBy("lookup_key").agg(
        F.min_by("title", "pos").alias("title"),
        F.max("start_year").alias("year"),
        F.min("start_year").alias("earliest_year"),
        F.coalesce(F.min("start_year") != F.max("start_year"), F.lit(False)).alias("ambiguous"),
        F.min_by(F.when(has_genres, F.array_join("genres", ", ")), F.when(has_genres, F.col("pos"))).alias("genres"),
        F.coalesce(
            F.max_by(F.when(series, F.col("id")), F.when(series, F.struct(F.coalesce("start_year", F.lit(0)), "pos"))), F.lit(0)
        ).alias("series_id"),
    )


def lookup_titles(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """Answer many titles in one pass; misses stay null. The questions prune the dataset before it is aggregated."""
    asked = questions.select("question").distinct().withColumn("lookup_key", lookup_key("question"))
    wanted = asked.select("lookup_key").filter(F.col("lookup_key") != "").distinct()
    relevant = titles.withColumn("lookup_key", lookup_key("title")).join(wanted, "lookup_key", "left_semi").drop("lookup_key")
    return asked.join(title_index(relevant), "lookup_key", "left")


def lookup_by_id(titles: DataFrame, ids: DataFrame) -> DataFrame:
    """Title rows of the wanted ids; on a repeated id the later row stands."""
    hits = titles.join(ids.select("id").distinct(), "id", "left_semi")
    return first_by(hits, ["id"], [-F.col("pos")])


def known_genres(titles: DataFrame) -> DataFrame:
    return titles.select(F.explode("genres").alias("genre")).filter(not_blank("genre")).distinct()


def name_variants(name: Column) -> Column:
    """A name to try, best first: as it is, without a bracket at its end, and without a year there."""

    whole = F.trim(F.regexp_replace(name, r"[._]", " "))
    stripped = F.trim(F.regexp_replace(whole, r"[(\[{][^)\]}]*[)\]}]\s*$", ""))
    undated = F.trim(F.regexp_replace(F.when(F.length(stripped) > 0, stripped).otherwise(whole), r"[\s._-]+(?:19|20)\d{2}\s*$", ""))
    return F.filter(F.array(whole, stripped, undated), lambda n: F.length(n) > 0)


def names_by_rank(names: Column) -> Column:
    """Folder names in the order they are tried: short names and season folders come last."""
    late = lambda n: (F.length(n) <= 1) | n.rlike(r"(?iu)^(season|series)\s*\d+$")
    return F.concat(F.filter(names, lambda n: ~late(n)), F.filter(names, late))


def candidate_names() -> Column:
    """Names to try for a file, best first: its title, then its folders, each with and without bracket and year."""
    ordered = F.concat(F.array("parsed_title"), names_by_rank(folder_names("full_path")))
    return F.flatten(F.transform(F.filter(ordered, lambda n: n.isNotNull()), name_variants))


def title_candidates(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, rank, candidate): unique ignoring case, first spelling kept; with a ``limit``, the first so many of them.

    All candidates of a file come from its own path, so they are made unique inside the row.
    """
    named = files.select("id", candidate_names().alias("_names"))
    seen = F.transform("_names", lambda n: F.upper(n))
    unique = F.filter("_names", lambda n, i: F.array_position(seen, F.upper(n)) == i + 1)
    kept = F.slice(unique, 1, limit) if limit else unique
    return named.select("id", F.posexplode(kept).alias("rank", "candidate"))


def needs_verification() -> Column:
    film_or_show = F.col("video_category").isin("Movie", "TvShow", "MovieExtra", "TvExtra")
    return (F.col("kind") == "Video") & film_or_show & ~title_verified()


def needs_year() -> Column:
    return (F.col("kind") == "Video") & F.col("year").isNull() & not_blank(effective_title())


def _ask(files: DataFrame, question: Column, titles: DataFrame) -> DataFrame:
    """Attach the index answer to ``question`` as struct ``_hit``; the dataset is pruned to asked keys first."""
    # Rows that ask nothing share no key, or one task would get them all; a key has no space.
    asked = lookup_key(question)
    keyed = files.withColumn("_key", F.when(asked == "", F.concat(F.lit(" "), F.xxhash64("id").cast("string"))).otherwise(asked))
    wanted = keyed.select("_key").filter("NOT startswith(_key, ' ')").distinct()
    relevant = titles.join(wanted, lookup_key("title") == F.col("_key"), "left_semi")
    index = title_index(relevant).select(F.col("lookup_key").alias("_key"), F.struct("title", "year", "earliest_year", "ambiguous", "genres").alias("_hit"))
    return keyed.join(index, "_key", "left").drop("_key")


def store_title_index(titles: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """The index as a table bucketed and sorted by its key: what joins it by that key moves only the
    other side. Written once for each version of the dataset and passed to ``verify_titles``."""
    writer = title_index(titles).write.bucketBy(buckets, "lookup_key").sortBy("lookup_key").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return titles.sparkSession.table(table)


def _first_known(names: DataFrame, answers: DataFrame, key: Sequence[str], answer: str) -> DataFrame:
    """(kind, name, answer): of each name the answer to its best variant that has one."""
    tried = names.select("kind", "name", F.posexplode(name_variants(F.col("name"))).alias("at", "query"))
    tried = tried.withColumn("lookup_key", lookup_key("query")).filter("lookup_key <> ''") if "lookup_key" in key else tried
    return tried.join(answers, list(key)).groupBy("kind", "name").agg(F.min_by(answer, "at").alias(answer))


def _verification_answers(targets: DataFrame, titles: DataFrame | None, cache: DataFrame | None, index: DataFrame | None) -> DataFrame:
    """(title, folder, kind, _dataset, _online) for each distinct title, folder and kind of the targets.

    Names are asked once, however many files and folders bear them; what a folder is worth is found
    once for all its files.
    """
    from .ingest import lookup_cache

    # Read some six times below, so the input runs once for them.
    ensure_checkpoint_dir(targets.sparkSession)
    places = targets.select(*_place()).distinct().checkpoint()
    folders = places.select("folder", "kind").distinct()
    ordered = names_by_rank(F.filter(F.reverse(F.split("folder", "/")), lambda n: (F.length(n) > 0) & ~n.rlike(r"^[A-Za-z]:$")))
    listed = folders.select("folder", "kind", F.posexplode(ordered).alias("rank", "name"))
    names = places.select("kind", F.col("title").alias("name")).union(listed.select("kind", "name")).distinct()

    def spread_out(known: DataFrame, answer: str) -> DataFrame:
        """A name's answer to the places that bear it: by title first, then by the best folder name."""
        by_title = known.select("kind", F.col("name").alias("title"), F.col(answer).alias("_own"))
        by_folder = listed.join(known, ["kind", "name"]).groupBy("folder", "kind").agg(F.min_by(answer, "rank").alias("_above"))
        joined = places.join(by_title, ["kind", "title"], "left").join(by_folder, ["folder", "kind"], "left")
        return joined.select("title", "folder", "kind", F.coalesce("_own", "_above").alias(answer)).filter(F.col(answer).isNotNull())

    any_kind = names.select(F.lit("").alias("kind"), "name").distinct()
    if index is None:
        asked = any_kind.select(F.explode(name_variants(F.col("name"))).alias("q")).select(lookup_key("q").alias("lookup_key")).filter("lookup_key <> ''").distinct()
        relevant = titles.withColumn("lookup_key", lookup_key("title")).join(asked, "lookup_key", "left_semi").drop("lookup_key")
        index = title_index(relevant)
    hits = index.select("lookup_key", F.struct("title", "year", "earliest_year", "ambiguous", "genres").alias("_dataset"))
    known = _first_known(any_kind, hits, ["lookup_key"], "_dataset").drop("kind")
    answered = spread_out(names.join(known, "name"), "_dataset")
    if cache is None:
        return answered.withColumn("_online", F.lit(None).cast("string"))
    questions = names.select("kind", F.explode(name_variants(F.col("name"))).alias("query")).distinct()
    found = lookup_cache(questions, cache).filter("found").select("kind", "query", F.col("canonical_name").alias("_online"))
    online = spread_out(_first_known(names, found, ["kind", "query"], "_online"), "_online")
    return answered.join(online, ["title", "folder", "kind"], "full_outer")


def _place() -> list[Column]:
    """What a file's candidates depend on: its title, its folder, and the kind of the online question."""
    parts = F.split(slashed("full_path"), "/")
    return [
        F.coalesce("parsed_title", F.lit("")).alias("title"),
        F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("folder"),
        F.when(F.col("video_category").isin("Movie", "MovieExtra"), "movie").otherwise("tv").alias("kind"),
    ]


def verify_titles(files: DataFrame, titles: DataFrame | None, cache: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Confirm titles: the first candidate the dataset knows, else the first one an earlier online check found.

    ``outcome`` is dataset, online, unresolved, or null for rows that needed nothing. An ``index``
    kept by ``store_title_index`` takes the place of ``titles``.
    """
    targets = files.filter(needs_verification())
    title, folder, kind = _place()
    keyed = files.withColumns({"_title": title, "_folder": folder, "_kind": kind})
    answers = _verification_answers(targets, titles, cache, index).toDF("_title", "_folder", "_kind", "_dataset", "_online")
    joined = keyed.join(answers, ["_title", "_folder", "_kind"], "left").drop("_title", "_folder", "_kind")
    asked = needs_verification()
    by_dataset = asked & F.col("_dataset").isNotNull()
    by_online = asked & ~by_dataset & F.col("_online").isNotNull()
    marked = joined.withColumn(
        "outcome", F.when(by_dataset, "dataset").when(by_online, "online").when(asked, "unresolved")
    )
    takes_genres = (F.col("outcome") == "dataset") & is_blank("genres") & F.col("_dataset.genres").isNotNull()
    return marked.withColumns({
        "confirmed_title": F.when(F.col("outcome") == "dataset", F.col("_dataset.title")).when(F.col("outcome") == "online", F.col("_online")).otherwise(F.col("confirmed_title")),
        "from_dataset": F.col("from_dataset") | F.coalesce(F.col("outcome") == "dataset", F.lit(False)),
        "from_online": F.col("from_online") | F.coalesce(F.col("outcome") == "online", F.lit(False)),
        "genres": F.when(takes_genres, F.col("_dataset.genres")).otherwise(F.col("genres")),
    }).drop("_dataset", "_online")


def _with_years(asked: DataFrame) -> DataFrame:
    fills = needs_year() & F.col("_hit.year").isNotNull()
    marked = asked.withColumn("year_filled", F.coalesce(fills, F.lit(False)))
    doubt = F.col("year_filled") & F.col("_hit.ambiguous")
    return marked.withColumns({
        "alternative_year": F.when(doubt, F.col("_hit.earliest_year")).when(~F.col("year_filled"), F.col("alternative_year")),
        "year_ambiguous": F.when(F.col("year_filled"), F.col("_hit.ambiguous")).otherwise(F.col("year_ambiguous")),
        "year": F.when(F.col("year_filled"), F.col("_hit.year")).otherwise(F.col("year")),
    })


def _with_genres(asked: DataFrame) -> DataFrame:
    fills = F.coalesce(is_blank("genres") & F.col("_hit.genres").isNotNull(), F.lit(False))
    marked = asked.withColumn("genres_filled", fills)
    return marked.withColumn("genres", F.when(F.col("genres_filled"), F.col("_hit.genres")).otherwise(F.col("genres")))


def fill_years(files: DataFrame, titles: DataFrame) -> DataFrame:
    """Missing years from the index, with the doubt and the earliest alternative recorded."""
    return _with_years(_ask(files, F.when(needs_year(), effective_title()), titles)).drop("_hit")


def fill_genres(files: DataFrame, titles: DataFrame) -> DataFrame:
    """Missing genres from the index."""
    return _with_genres(_ask(files, F.when(is_blank("genres"), effective_title()), titles)).drop("_hit")


def fill_years_and_genres(files: DataFrame, titles: DataFrame) -> DataFrame:
    """``fill_genres`` after ``fill_years``: both ask for the same title, so rows ask and move once."""
    asked = _ask(files, F.when(needs_year() | is_blank("genres"), effective_title()), titles)
    return _with_genres(_with_years(asked)).drop("_hit")


def verification_report(verified: DataFrame, years: DataFrame, genres: DataFrame) -> DataFrame:
    """Counts of a verification run, one row."""
    titles = verified.agg(
        F.count_if(F.col("outcome") == "dataset").alias("dataset_verified"),
        F.count_if(F.col("outcome") == "online").alias("online_verified"),
        F.count_if(F.col("outcome") == "unresolved").alias("unresolved"),
    )
    year = years.agg(
        F.count_if("year_filled").alias("years_filled"), F.count_if(F.col("year_filled") & F.col("year_ambiguous")).alias("years_uncertain")
    )
    genre = genres.agg(F.count_if("genres_filled").alias("genres_filled"))
    return one_row(titles, year, genre)
