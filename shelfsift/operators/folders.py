"""Joins along the folder hierarchy: rules, extras, folder details, leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestor_dirs, is_drive_root, is_under, parent_dir, path_key, slashed, trim_slashes, base_name
from ..functions.text import effective_title, is_blank, is_extra, not_blank, title_verified
from ..session import stored

# Fixed value: how many folders above an extra its owner may be.
MAX_LINK_LEVELS = 6


def with_folder(files: DataFrame) -> DataFrame:
    return files.withColumn("folder_key", path_key(parent_dir("full_path")))


def folder_ancestors(files: DataFrame) -> DataFrame:
    """Each distinct folder of the files with itself and the folders above it (``level`` 0 is itself)."""
    return ancestors_of(with_folder(files).select("folder_key").distinct())


def ancestors_of(folders: DataFrame) -> DataFrame:
    """The same for folders that are listed once each (``folder_key``)."""
    return folders.select("folder_key", F.posexplode(ancestor_dirs(F.concat("folder_key", F.lit("/x")))).alias("level", "above"))


def folder_rule(files: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """Attach the value of the longest rule covering each file (first rule on ties) as ``name``.

    ``rules``: path, include_subdirectories, value, pos. Distinct folders are expanded into their
    ancestors and joined to the rules by equality, so neither side is scanned per pair.
    """
    live = rules.filter(not_blank("value") & (F.length("path") > 0)).select(
        path_key(trim_slashes("path")).alias("above"), "include_subdirectories", "value", F.length("path").alias("len"), "pos"
    )
    # Read twice below, so the files run once for it.
    folders = stored(with_folder(files).select("folder_key").distinct())
    hits = ancestors_of(folders).join(live, "above").filter(F.col("include_subdirectories") | (F.col("level") == 0))
    best = hits.groupBy("folder_key").agg(F.min_by("value", F.struct(-F.col("len"), "pos")).alias(name))
    # A recursive rule also covers a file whose own path is the rule's path. Such a rule stands in a folder that
    # holds files itself; the few that do are stored, so that Spark knows their size and need not move the files.
    exact = live.filter("include_subdirectories").groupBy(F.col("above").alias("_own")).agg(
        F.min_by(F.struct("value", "len"), F.struct(-F.col("len"), "pos")).alias("_exact")
    )
    exact = stored(exact.withColumn("folder_key", parent_dir("_own")).join(folders, "folder_key", "left_semi").select("_own", "_exact"))
    # Folders begin alike, so rows are sorted by a hash of the folder before the folder itself.
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("folder_key"))
    joined = hashed(with_folder(files)).join(hashed(best), ["_hash", "folder_key"], "left").drop("_hash")
    joined = joined.withColumn("_own", path_key("full_path")).join(exact, "_own", "left")
    return joined.withColumn(name, F.coalesce(F.col("_exact.value"), F.col(name))).drop("_own", "_exact", "folder_key")


def apply_folder_title(files: DataFrame, rules: DataFrame) -> DataFrame:
    """An unverified file takes the title of its folder rule and counts as typed by hand."""
    ruled = folder_rule(files, rules, "_title")
    takes = F.coalesce(~title_verified() & not_blank("_title") & (F.coalesce(F.col("confirmed_title"), F.lit("")) != F.col("_title")), F.lit(False))
    return ruled.withColumns({
        "confirmed_title": F.when(takes, F.trim("_title")).otherwise(F.col("confirmed_title")),
        "title_manual": F.col("title_manual") | takes,
        "took_folder_title": takes,
    }).drop("_title")


def under_folder(folder: str, include_subdirectories: bool = True) -> Column:
    if include_subdirectories:
        return is_under("full_path", F.lit(folder), or_equal=False)
    return path_key(parent_dir("full_path")) == path_key(trim_slashes(F.lit(folder)))


def files_under(files: DataFrame, folder: str, include_subdirectories: bool = True) -> DataFrame:
    """Rows in one folder; a scan-side predicate."""
    return files.filter(under_folder(folder, include_subdirectories))


def files_under_any(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows in any of many folders (``path``), by ancestor equality."""
    wanted = folders.select(path_key(trim_slashes("path")).alias("above")).distinct()
    inside = folder_ancestors(files).join(wanted, "above", "left_semi").select("folder_key").distinct()
    return with_folder(files).join(inside, "folder_key", "left_semi").drop("folder_key")


def siblings_of(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows in the folders of a selection, minus the selection."""
    folders = with_folder(selection).select("folder_key").distinct()
    return with_folder(files).join(folders, "folder_key", "left_semi").drop("folder_key").join(
        selection.select("id"), "id", "left_anti"
    )


def linked_extras(files: DataFrame, selection: DataFrame) -> DataFrame:
    owners = selection.select(F.col("id").alias("linked_file_id"))
    return files.filter(is_extra() & not_blank("linked_file_id")).join(owners, "linked_file_id", "left_semi")


def claimed_as_main() -> Column:
    return F.upper(F.coalesce("category_override", F.lit(""))).isin("TVSHOW", "MOVIE")


def counts_as_extra() -> Column:
    return is_extra() & ~claimed_as_main()


def find_owners(files: DataFrame, levels: int | None = MAX_LINK_LEVELS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, owner_id, level) of every extra with a main video at or above its folder, nearest folder first;
    at most ``levels`` folders up, or all of them with None. The owner's columns ``carried`` come along as ``_o_<name>``.

    The main side is first reduced to the best file per (folder, season) and per folder, so a folder
    meets each extra with at most two rows whatever it holds.
    """
    keyed = with_folder(files)
    mains = keyed.filter(
        (F.col("kind") == "Video") & ~counts_as_extra() & (F.col("video_category").isin("TvShow", "Movie") | claimed_as_main())
    )
    # Combine per (own folder, season) before climbing to the ancestors.
    chain = ancestor_dirs(F.concat("folder_key", F.lit("/x")), levels)
    pick = F.struct(-F.col("size_bytes"), "ord", "id", *[F.col(c).alias(f"_o_{c}") for c in carried])
    nearest = mains.groupBy("folder_key", "season").agg(F.min(pick).alias("_pick"))
    placed = nearest.select("season", "_pick", F.explode(chain).alias("dir"))
    per_season = placed.groupBy("dir", "season").agg(F.min("_pick").alias("season_pick"))
    per_folder = placed.groupBy("dir").agg(F.min("_pick").alias("any_pick"))
    # Owners are found once per (folder, season) that holds extras, not once per extra.
    extras = keyed.filter(counts_as_extra()).select("id", "folder_key", F.coalesce("season", F.lit(0)).alias("season"))
    places = extras.select("folder_key", "season").distinct().select("folder_key", "season", F.posexplode(chain).alias("level", "dir"))
    found = places.join(per_folder, "dir").join(per_season.filter("season <> 0"), ["dir", "season"], "left")
    owner = F.struct("level", F.coalesce("season_pick", "any_pick").alias("pick"))
    nearest_owner = found.groupBy("folder_key", "season").agg(F.min_by(owner, "level").alias("_o"))
    return extras.join(nearest_owner, ["folder_key", "season"]).select(
        "id", F.col("_o.pick.id").alias("owner_id"), "_o.level", *[f"_o.pick._o_{c}" for c in carried]
    )


def link_extras(files: DataFrame, levels: int | None = MAX_LINK_LEVELS) -> DataFrame:
    """Extras adopt their owner's link, category, title and year; extras without one lose their link.

    What is inherited comes with the owner, and only extras are joined with theirs: other rows stay where they are.
    """
    inherited = ("video_category", "parsed_title", "confirmed_title", "from_online", "from_dataset", "title_manual", "year")
    adopted = find_owners(files, levels, inherited).drop("level")
    is_one = F.coalesce(counts_as_extra(), F.lit(False))
    joined = files.filter(is_one).join(adopted, "id", "left")
    extra, owned = counts_as_extra(), F.col("owner_id").isNotNull()
    open_title = owned & ~F.col("title_manual")
    confirmed = open_title & not_blank("_o_confirmed_title")
    pick = lambda test, column: F.when(test, F.col(f"_o_{column}")).otherwise(F.col(column))
    return joined.withColumns({
        "linked_file_id": F.when(extra, F.coalesce("owner_id", F.lit(""))).otherwise(F.col("linked_file_id")),
        "video_category": F.when(owned, F.when(F.col("_o_video_category") == "TvShow", "TvExtra").otherwise("MovieExtra")).otherwise(F.col("video_category")),
        "parsed_title": pick(open_title & not_blank("_o_parsed_title"), "parsed_title"),
        "confirmed_title": pick(confirmed, "confirmed_title"),
        "from_online": pick(confirmed, "from_online"),
        "from_dataset": pick(confirmed, "from_dataset"),
        "title_manual": pick(confirmed, "title_manual"),
        "year": F.when(owned, F.coalesce("year", "_o_year")).otherwise(F.col("year")),
    }).select(*files.columns).unionByName(files.filter(~is_one))


def folder_details(files: DataFrame, category: Column) -> DataFrame:
    """Per folder the title, year and category all its files agree on; null where they differ."""
    rows = with_folder(files).withColumns({"_t": F.coalesce(effective_title(), F.lit("")), "_c": category})

    def agreed(column: str) -> Column:
        value = F.col(column)
        same = (F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1)))
        return F.when(same, F.min(value))

    return rows.groupBy("folder_key").agg(
        F.count(F.lit(1)).alias("files"),
        agreed("_t").alias("title"), agreed("year").alias("year"), agreed("_c").alias("category"),
    ).withColumn("title", F.when(not_blank("title"), F.col("title")))


def leftover_folders(listing: DataFrame, limits: DataFrame, configured: DataFrame) -> DataFrame:
    """Folders whose whole subtree holds at most the allowed bytes and nothing waiting to be filed.

    ``listing``: full_path, size_bytes, unfinished. ``limits``: folder, threshold (the smallest of a
    folder's limits counts). ``configured``: path of folders that must stay.
    """
    wanted = limits.filter(not_blank("folder") & ~is_drive_root("folder")).groupBy(path_key("folder").alias("above")).agg(
        F.min("threshold").alias("threshold")
    )
    keep = configured.select(path_key(trim_slashes("path")).alias("above"))
    wanted = wanted.join(keep, "above", "left_anti")
    # Sizes are combined per folder first; only the folder totals climb to the ancestors.
    per_folder = with_folder(listing).groupBy("folder_key").agg(
        F.sum(F.when(F.col("unfinished"), 0).otherwise(F.col("size_bytes"))).alias("bytes"),
        F.count(F.lit(1)).alias("files"),
        F.max("unfinished").alias("unfinished"),
    )
    # Added up before they meet the limits: the top folder stands above all others, and its sums are combined before they move.
    chains = per_folder.select("bytes", "files", "unfinished", F.explode(ancestor_dirs(F.concat("folder_key", F.lit("/x")))).alias("above"))
    totals = chains.groupBy("above").agg(
        F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.max("unfinished").alias("unfinished")
    )
    kept = wanted.join(totals, "above", "left").filter(~F.coalesce("unfinished", F.lit(False)))
    kept = kept.filter(F.coalesce("bytes", F.lit(0)) <= F.col("threshold"))
    return kept.select(
        F.col("above").alias("folder"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce("files", F.lit(0)).cast("bigint").alias("files"), "threshold",
    )


def leftover_examples(listing: DataFrame, leftovers: DataFrame, examples: int = 6) -> DataFrame:
    """Up to ``examples`` file names per leftover folder, by path.

    Each folder offers its smallest names to its ancestors. A filter on a row number is a limit that Spark
    also keeps in front of the shuffle, so of any folder, the top one too, a task sends on a few names only.
    """
    def first(rows: DataFrame, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy("p", "id"))
        return rows.withColumn("position", place).filter(F.col("position") <= examples)

    few = first(with_folder(listing).select("folder_key", "id", slashed("full_path").alias("p")), "folder_key")
    chains = few.select("id", "p", F.explode(ancestor_dirs(F.concat("folder_key", F.lit("/x")))).alias("folder"))
    hits = first(chains, "folder").join(leftovers.filter("files > 0").select("folder"), "folder", "left_semi")
    return hits.select("folder", F.col("position").cast("bigint").alias("position"), base_name("p").alias("name"))


def empty_folders(deleted: DataFrame, listing: DataFrame) -> DataFrame:
    """Folders of deleted files below which nothing is left; deepest first when sorted by ``depth`` descending."""
    emptied = with_folder(deleted).select(F.col("folder_key").alias("folder")).filter(~is_drive_root("folder")).distinct()
    occupied = folder_ancestors(listing).select(F.col("above").alias("folder")).distinct()
    return emptied.join(occupied, "folder", "left_anti").withColumn("depth", F.length("folder"))


def adopt_folder_rules(files: DataFrame, category_rules: DataFrame, title_rules: DataFrame, folders: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write rules onto the files they cover, then retire them.

    Category: the first rule in list order wins and only where no override is set. Title: the last one
    wins. Gives (files, retired rules, rules kept). A rule covers files strictly below its folder. ``folders``
    (folder_key, each once) spares working ``files`` out a second time to list theirs.
    """
    expanded = folder_ancestors(files) if folders is None else ancestors_of(folders)

    def covering(rules: DataFrame) -> DataFrame:
        live = rules.filter(not_blank("path") & not_blank("value")).select(
            path_key(trim_slashes("path")).alias("above"), "path", "include_subdirectories", "value", "pos"
        ).filter(F.length("above") > 0)
        return expanded.join(live, "above").filter(F.col("include_subdirectories") | (F.col("level") == 0))

    category_hits, title_hits = covering(category_rules), covering(title_rules)
    first = category_hits.groupBy("folder_key").agg(F.min_by("value", "pos").alias("_category"))
    last = title_hits.groupBy("folder_key").agg(F.max_by("value", "pos").alias("_title"))
    joined = with_folder(files).join(first, "folder_key", "left").join(last, "folder_key", "left")
    titled = F.col("_title").isNotNull()
    updated = joined.withColumns({
        "category_override": F.when(is_blank("category_override") & F.col("_category").isNotNull(), F.col("_category")).otherwise(F.col("category_override")),
        "confirmed_title": F.when(titled, F.trim("_title")).otherwise(F.col("confirmed_title")),
        "title_manual": F.col("title_manual") | titled,
        "from_online": F.col("from_online") & ~titled,
        "from_dataset": F.col("from_dataset") & ~titled,
    }).select(*files.columns)
    tagged = category_rules.withColumn("rule", F.lit("category")).unionByName(title_rules.withColumn("rule", F.lit("title")))
    used = category_hits.select("pos", F.lit("category").alias("rule")).unionByName(title_hits.select("pos", F.lit("title").alias("rule"))).distinct()
    blank = is_blank("path") | is_blank("value")
    retired = tagged.filter(blank).unionByName(tagged.filter(~blank).join(used, ["pos", "rule"], "left_semi").select(*tagged.columns))
    kept = tagged.filter(~blank).join(used, ["pos", "rule"], "left_anti").select(*tagged.columns)
    return updated, retired, kept
