"""From files to decisions: what is filed as what, which copy is kept, what goes to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import numbering_display, run_end
from ..functions.fingerprints import shifted_similarity
from ..functions.paths import path_key, stem_of
from ..functions.staging import staged
from ..functions.text import effective_title, has_hash, is_blank, is_extra, packed, strip, title_key
from ..operators.survivorship import choose_by_policies, library_preference, policy_columns, quality_of, rank_order
from ..session import stored
from .destinations import Library


def missing_information(library: Library) -> Column:
    """Why a file cannot be filed yet; null when it can. Needs ``category``."""
    category = F.col("category")
    return (
        F.when(is_blank("category") | (category == "Unknown"), F.lit("no_category"))
        .when(is_blank(library.folder(category)), F.concat(F.lit("no_folder:"), category))
        .when(is_blank(effective_title()), F.lit("no_title"))
        .when((category == "TvShow") & (F.col("season").isNull() | F.col("episode").isNull()),
              F.lit("no_number"))
        .when((category == "Movie") & F.col("year").isNull(), F.lit("no_year"))
        .when(F.col("integrity") == "IncompleteDownload", F.lit("downloading"))
    )


def job_key(library: Library) -> Column:
    """Key of the job a file belongs to, by its category's way of matching."""
    category, title = F.col("category"), title_key(effective_title())
    run = F.when(F.col("episode_end") > F.col("episode"), F.format_string("-%03d", "episode_end")).otherwise("")
    tv = F.concat(F.lit("tv|"), title, F.format_string("|S%03dE%03d", "season", "episode"), run)
    numbered = F.col("season").isNotNull() & F.col("episode").isNotNull()
    other = F.concat_ws("|", category, title, F.coalesce(F.col("year").cast("string"), F.lit("")))
    claimed = F.when((category == "TvShow") & numbered, tv).otherwise(other)
    mode = library.match_mode(category)
    return F.upper(
        F.when(mode == "name", F.concat(F.lit("name|"), F.lower(stem_of("file_name"))))
        .when(mode == "content", F.when(has_hash(), F.concat(F.lit("sha|"), F.lower("sha256"))).otherwise(F.concat(F.lit("unhashed|"), "full_path")))
        .otherwise(claimed)
    )


def job_files(files: DataFrame, library: Library) -> DataFrame:
    """Files that take part, with ``reason`` (null: fileable), ``job_key`` and ``content_key``."""
    rows = files.filter(~F.col("category").isin("TvExtra", "MovieExtra") & ~is_extra() & F.col("kind").isin("Audio", "Video", "Other"))
    content = F.when(has_hash(), F.upper("sha256")).otherwise(F.concat(F.lit("#"), "id"))
    judged = staged(rows, {"reason": missing_information(library), "content_key": content})
    return staged(judged, {"job_key": F.when(F.col("reason").isNull(), job_key(library))})


def plan_review(files: DataFrame, library: Library) -> DataFrame:
    return job_files(files, library).filter("reason IS NOT NULL").select("id", "full_path", "reason")


def plan_jobs(files: DataFrame, library: Library) -> DataFrame:
    """One row per job: kind, display, category, members and distinct contents."""
    return jobs_of(job_files(files, library).filter("reason IS NULL"))


def jobs_of(rows: DataFrame) -> DataFrame:
    """The jobs of rows that already carry job_key and content_key."""
    # First per content, so a hot job is reduced before its contents are counted.
    head = F.struct(strip(effective_title()).alias("t"), numbering_display().alias("n"), "year", "category")
    per_content = rows.groupBy("job_key", "content_key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(head, F.struct("ord", "id")).alias("head"), F.min(F.struct("ord", "id")).alias("at")
    )
    jobs = per_content.groupBy("job_key").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("contents"), F.min_by("head", "at").alias("head"))
    display = (
        F.when(F.col("head.n") != "", F.concat_ws(" — ", "head.t", "head.n"))
        .when(F.col("head.year").isNotNull(), F.concat("head.t", F.lit(" ("), F.col("head.year").cast("string"), F.lit(")")))
        .otherwise(F.col("head.t"))
    )
    return jobs.select("job_key", job_kind(F.col("members"), F.col("contents")).alias("job_kind"), display.alias("display"), F.col("head.category").alias("category"), "members", "contents")


def job_candidates(rows: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """One candidate per (job, content): the library's copy where there is one.

    Needs job_key, content_key and ``library_rank``. ``set_at`` is where the content first appears, hashed contents
    before unhashed ones; ``first_at`` is the same without that, with the category of that row. Only what the
    judgements read is moved, and ``carried`` besides.
    """
    read = {c: F.col(c) for c in ("kind", "frames", "duration_seconds", "integrity", "size_bytes")}
    read |= {"_unhashed": F.length("sha256") == 0, "_quality": quality_of(), "_path": F.upper("full_path"), **(carried or {})}
    narrow = rows.select("job_key", packed("content_key").alias("_content"), "library_rank", "ord", "id", "category", F.struct(*[c.alias(n) for n, c in read.items()]).alias("_read"))
    best = F.min(F.struct("library_rank", "ord", "id", "_read")).alias("_best")
    each = narrow.groupBy("job_key", "_content.hash", "_content.text").agg(F.count(F.lit(1)).alias("copies"), best, F.min(F.struct("ord", "id", "category")).alias("first_at"))
    set_at = F.struct(F.col("_best._read._unhashed").alias("unhashed"), "first_at.ord", "first_at.id")
    return each.select("job_key", "copies", "first_at", set_at.alias("set_at"), "_best.ord", "_best.id", "_best._read.*")


def job_kind(members: Column, contents: Column) -> Column:
    return F.when(members == 1, "Single").when(contents == 1, "ExactCopies").otherwise("Rivals")


def settle(candidates: DataFrame, library: Library, same_content: Column) -> DataFrame:
    """The built-in judgement over the candidates of each job; the only candidate of a job is kept.

    Every candidate must match the first one's content, the widest gap between measured lengths must be
    within the tolerance, and the best ranked candidate that is not corrupt is kept. ``same_content`` is a
    condition over structs ``f1`` (the first candidate) and ``f2``. The rows of a job move once: its first
    candidate comes down its rows by a window, and the aggregate over them needs no other exchange.
    """
    item = F.struct("id", "frames", "kind")
    down = Window.partitionBy("job_key").orderBy("set_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paired = candidates.withColumns({"f1": F.first(item).over(down), "f2": item})
    length = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank_order(F.col("_quality"), F.col("_path")))])
    sound = F.col("integrity") != "Corrupt"
    settled = paired.groupBy("job_key").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum("copies").alias("members"),
        F.every((F.col("f1.id") == F.col("id")) | same_content).alias("_same"),
        F.when(F.count(length) >= 2, F.max(length) - F.min(length)).alias("widest_gap"),
        F.min("first_at")["category"].alias("_category"),
        F.max(F.col("kind") == "Other").alias("_other"),
        F.min_by(F.when(sound, F.col("id")), F.when(sound, rank)).alias("_keeper"),
        F.min_by("id", "set_at").alias("_only"),
    )
    reason = (
        F.when(F.col("candidates") == 1, None)
        .when(F.col("_other"), "nothing built in can compare these files")
        .when(~F.col("_same"), "a copy does not match the first one")
        .when(F.col("widest_gap") > library.tolerance(F.col("_category")), "the copies differ too much in length")
        .when(F.col("_keeper").isNull(), "every copy is damaged")
    )
    keeper = F.when(F.col("candidates") == 1, F.col("_only")).when(F.col("reason").isNull(), F.col("_keeper"))
    return settled.withColumn("reason", reason).select(
        "job_key", job_kind(F.col("members"), F.col("candidates")).alias("job_kind"), keeper.alias("keeper_id"), "reason", "widest_gap", "candidates"
    )


def video_match(threshold: float = 0.88, shifts: int = 8) -> Column:
    return shifted_similarity(F.col("f1.frames"), F.col("f2.frames"), "Video", shifts) >= threshold


def settle_jobs(files: DataFrame, library: Library, same_content: Column | None = None) -> DataFrame:
    """Decision per job: (job_key, job_kind, keeper_id, reason).

    Needs category, frames, correctly_filed, under_root and planned_dir. Single files and identical copies
    settle themselves; rivals go through the category's pair rules, else its rule steps, else the built-in judgement.
    """
    rows = job_files(files, library).filter("reason IS NULL")
    rows = rows.withColumn("library_rank", library_preference(F.col("correctly_filed"), F.col("under_root"), F.col("planned_dir")))
    same = video_match() if same_content is None else same_content
    decision = ["job_key", "job_kind", "keeper_id", "reason"]
    ruled = {c.name.upper(): (c.pair_rules, c.steps) for c in library.categories if c.pair_rules or c.steps}
    if not ruled:
        return settle(job_candidates(rows), library, same).select(*decision)
    job = Window.partitionBy("job_key")
    known = {"_contents": F.count(F.lit(1)).over(job), "rule_category": F.upper(F.min("first_at").over(job)["category"])}
    # Three judgements read the candidates; they are few columns, and planning them once is worth a written copy.
    candidates = stored(job_candidates(rows, policy_columns(ruled)).withColumns(known))
    rivals, by_rules = candidates.filter("_contents > 1"), F.col("rule_category").isin(*ruled)
    alone = candidates.filter("_contents = 1").select(
        "job_key", job_kind(F.col("copies"), F.lit(1)).alias("job_kind"), F.col("id").alias("keeper_id"), F.lit(None).cast("string").alias("reason")
    )
    judged = settle(rivals.filter(~by_rules), library, same).select(*decision)
    chosen = choose_by_policies(rivals.filter(by_rules), ["job_key"], ruled, order=("set_at",))
    return alone.unionByName(judged).unionByName(chosen.select(
        "job_key", F.lit("Rivals").alias("job_kind"), F.col("winner_id").alias("keeper_id"), F.when(F.col("undecided"), "undecided_by_rules").alias("reason"),
    ))


def doomed_files(files: DataFrame, library: Library, decisions: DataFrame) -> DataFrame:
    """The other files of every settled job. ``files`` need their category, not where they are to go."""
    rows = job_files(files, library).filter("reason IS NULL").select("job_key", "id", "full_path")
    settled = decisions.filter("keeper_id IS NOT NULL").select("job_key", "keeper_id")
    return rows.join(settled, "job_key").filter(F.col("id") != F.col("keeper_id"))


def settle_title_duplicates(members: DataFrame, library: Library, same_content: Column | None = None) -> DataFrame:
    """The same judgement over claimed-identity groups with two contents or more; ``settled`` tells the two outcomes apart.

    ``members``: rows of files with title_group, category, frames and library_rank. Groups of one content are left out here.
    """
    content = F.when(has_hash(), F.upper("sha256")).otherwise(F.concat(F.lit("#"), "id"))
    rows = members.withColumn("job_key", F.col("title_group")).withColumn("content_key", content)
    judged = settle(job_candidates(rows), library, video_match() if same_content is None else same_content).filter("candidates >= 2")
    return judged.select(F.col("job_key").alias("title_group"), "keeper_id", "reason", F.col("keeper_id").isNotNull().alias("settled"))


def same_episode_in_library(files: DataFrame, carried: Column | None = None) -> DataFrame:
    """(id, twin_id): the first other library file with the same show, season, episode and run end.

    Needs ``category`` and ``under_root``. ``carried`` of a file and of its twin come along as ``f1`` and ``f2``;
    files that a column ``sought`` excludes are twins only. Rows move once, by episode: two windows over it find the
    first library file and the first on another path, which is all a file has to look at to find one that is not itself.
    """
    identifies = (F.col("category") == "TvShow") & F.col("season").isNotNull() & F.col("episode").isNotNull()
    sought = F.col("sought") if "sought" in files.columns else F.lit(True)
    named = files.filter(identifies).select(
        "id", "ord", "season", "episode", "under_root", title_key(effective_title()).alias("_show"), run_end().alias("_last"), path_key("full_path").alias("_path"),
        sought.alias("sought"), (F.lit(None).cast("string") if carried is None else carried).alias("f1"),
    )
    # Titles begin alike, so rows are sorted by a hash of the keys before the keys themselves.
    keys = ["_show", "season", "episode", "_last"]
    episode = Window.partitionBy("_hash", *keys)
    at = F.struct("ord", "id", F.col("f1").alias("f2"))
    rows = named.filter("_show <> ''").withColumn("_hash", F.xxhash64(*keys))
    rows = rows.withColumn("_one", F.min(F.when(F.col("under_root"), F.struct(at.alias("at"), F.col("_path").alias("path")))).over(episode))
    rows = rows.withColumn("_two", F.min(F.when(F.col("under_root") & (F.col("_path") != F.col("_one.path")), at)).over(episode))
    twin = F.when(F.col("_one.path") != F.col("_path"), F.col("_one.at")).otherwise(F.col("_two"))
    found = rows.filter("sought").select("id", "f1", twin.alias("_twin")).filter("_twin IS NOT NULL")
    return found.select("id", F.col("_twin.id").alias("twin_id"), *(() if carried is None else ("f1", "_twin.f2")))


def rival_fields() -> Column:
    """What the settlement of two rivals reads of a file, as a struct."""
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank_order())]).alias("rank")
    return F.struct("id", "size_bytes", F.when(has_hash(), packed(F.upper("sha256"))).alias("content"), "duration_seconds", "category", "kind", "frames", rank)


def settle_episode_rivals(pairs: DataFrame, library: Library, same_content: Column | None = None) -> DataFrame:
    """Attach ``choice`` to pairs of an incoming file ``f1`` and the library's ``f2`` (``rival_fields``).

    Two copies of the same content whose lengths agree go to the better one: incoming or existing. It is null
    where they do not look alike or differ too much in length, which is for the user to settle.
    """
    measured = (F.col("f1.duration_seconds") > 0) & (F.col("f2.duration_seconds") > 0)
    gap = F.when(measured, F.abs(F.col("f1.duration_seconds") - F.col("f2.duration_seconds")))
    agree = gap.isNull() | (gap <= library.tolerance(F.col("f1.category")))
    same = video_match() if same_content is None else same_content
    better = F.when(F.col("f1.rank") <= F.col("f2.rank"), "incoming").otherwise("existing")
    return pairs.withColumn("choice", F.when(same & agree, better))


def resolve_episode_conflicts(files: DataFrame, to_file: DataFrame, library: Library, same_content: Column | None = None) -> DataFrame:
    """(id, twin_id, outcome) for files to be filed that have a twin in the library.

    Identical content is settled at once; otherwise the rivals are settled, and what that leaves open is asked.
    ``to_file`` may be ``files`` itself: then all of them are to be filed.
    """
    if to_file is not files:
        due = to_file.select("id").distinct().withColumn("_due", F.lit(True))
        files = files.join(due, "id", "left").withColumn("sought", F.coalesce("_due", F.lit(False))).drop("_due")
    both = same_episode_in_library(files, rival_fields())
    identical = (F.col("f1.size_bytes") == F.col("f2.size_bytes")) & (F.col("f1.content") == F.col("f2.content"))
    settled = settle_episode_rivals(both, library, same_content)
    choice = F.when(F.col("choice") == "incoming", "keep incoming").when(F.col("choice") == "existing", "keep library copy")
    return settled.select("id", "twin_id", F.when(identical, "identical").otherwise(F.coalesce(choice, F.lit("ask"))).alias("outcome"))


# --- pair predicates -----------------------------------------------------------------------------------

#: The columns by which two rows are compared.
COMPARED = ("file_name", "sha256", "confirmed_title", "parsed_title", "year", "season", "episode")


def are_copies(pairs: DataFrame, a: str = "a", b: str = "b", mode: str = "content_or_title") -> DataFrame:
    """Attach ``copies`` to pairs of catalogue rows (structs): content, name, title, or content_or_title."""
    def same(key) -> Column:
        return F.coalesce(key(a) == key(b), F.lit(False))

    tests = {"content": same(_content_of), "name": same(lambda r: F.upper(F.col(r)["file_name"])), "title": same(_title_of)}
    return pairs.withColumn("copies", tests["content"] | tests["title"] if mode == "content_or_title" else tests[mode])


def _content_of(row: str) -> Column:
    return F.when(F.col(row)["sha256"] != "", F.upper(F.col(row)["sha256"]))


def _title_of(row: str) -> Column:
    field = F.col(row)
    title = F.when(F.trim(field["confirmed_title"]) != "", field["confirmed_title"]).otherwise(field["parsed_title"])
    number = lambda c: F.coalesce(field[c].cast("string"), F.lit("-"))
    return F.when(F.trim(title) != "", F.concat_ws("|", F.upper(title), number("year"), number("season"), number("episode")))


def copy_links(files: DataFrame) -> DataFrame:
    """(id, content_of, title_of): the first row in catalogue order with a row's content, and with its
    title; null if that is the row itself or nothing is known. A group of copies is a star, never all its pairs."""
    rows = files.select("id", "ord", F.struct("sha256", "confirmed_title", "parsed_title", "year", "season", "episode").alias("r"))
    keyed = rows.select("id", "ord", _content_of("r").alias("_content"), _title_of("r").alias("_title"))
    for key, name in (("_content", "content_of"), ("_title", "title_of")):
        first = keyed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("id", F.struct("ord", "id")).alias(name))
        keyed = keyed.join(first, key, "left").withColumn(name, F.when(F.col(name) != F.col("id"), F.col(name)))
    return keyed.select("id", "content_of", "title_of")


def length_gap(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Attach ``gap`` (null when a length is unmeasured) and ``agree`` to pairs with durations a and b."""
    gap = F.when((F.col("a") > 0) & (F.col("b") > 0), F.abs(F.col("a") - F.col("b")))
    return pairs.withColumn("gap", gap).withColumn("agree", F.col("gap").isNull() | (F.col("gap") <= tolerance))


def widest_gap(files: DataFrame, keys: list[str]) -> DataFrame:
    length = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    return files.groupBy(*keys).agg(F.when(F.count(length) >= 2, F.max(length) - F.min(length)).alias("widest_gap"))
