"""Where each file belongs: folders, names, whether it is there already, what is in the way."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import numbering_display, quality_display
from ..functions.paths import base_name, extension_of, is_under, parent_dir, path_key, slashed, stem_of, trim_slashes
from ..functions.staging import staged
from ..functions.text import INVALID_NAME_CHARS, digits_value, effective_title, is_blank, letter_bucket, not_blank, sanitize, sort_name, strip
from ..functions.wildcards import any_of
from ..operators.classify import SEASON_FOLDER
from ..operators.folders import ancestors_of, with_folder
from ..operators.skew import ranked
from ..session import stored

EXTRAS = "Extras"
TV, FILMS = ("TvShow", "TvExtra"), ("Movie", "MovieExtra")
MAIN_OF = {"TvExtra": "TvShow", "MovieExtra": "Movie"}


@dataclass(frozen=True)
class Category:
    """Filing policy of one category. Rivals are settled by its ``pair_rules`` if it has some, else by
    its ``steps``, else by the built-in judgement."""

    name: str
    folder: str = ""
    template: str = ""
    letter_folders: bool | None = None
    match: str = "content_or_title"
    tolerance: int = 0
    steps: tuple = ()
    pair_rules: tuple = ()


@dataclass(frozen=True)
class Library:
    """The filing policies; they are settings, so they are compiled into expressions."""

    categories: tuple[Category, ...] = field(default_factory=tuple)
    articles_last: bool = False

    def policy(self, name: str) -> Category | None:
        """A category's own policy, or the one an extra inherits."""
        own = next((c for c in self.categories if c.name.lower() == name.lower()), None)
        return own or (self.policy(MAIN_OF[name]) if name in MAIN_OF else None)

    def names(self) -> list[str]:
        known = [c.name for c in self.categories]
        return known + [extra for extra, main in MAIN_OF.items() if main in known and extra not in known]

    def value(self, category: Column, pick, default) -> Column:
        """``pick(policy)`` by category, else ``default``."""
        result = F.lit(default)
        for name in self.names():
            result = F.when(F.upper(category) == name.upper(), F.lit(pick(name))).otherwise(result)
        return result

    def _inherited(self, attribute: str):
        def pick(name: str) -> str:
            own = next((c for c in self.categories if c.name.lower() == name.lower()), None)
            text = getattr(own, attribute) if own else ""
            return text if text.strip() or name not in MAIN_OF else pick(MAIN_OF[name])

        return pick

    def folder(self, category: Column) -> Column:
        return self.value(category, self._inherited("folder"), "")

    def buckets(self, category: Column) -> Column:
        def pick(name: str) -> bool:
            policy = self.policy(name)
            chosen = policy.letter_folders if policy else None
            return name in (*TV, *FILMS) if chosen is None else chosen

        default = category.isin(*TV, *FILMS)
        result = default
        for name in self.names():
            result = F.when(F.upper(category) == name.upper(), F.lit(pick(name))).otherwise(result)
        return result

    def tolerance(self, category: Column) -> Column:
        return self.value(category, lambda n: max(0, self.policy(n).tolerance), 0)

    def match_mode(self, category: Column) -> Column:
        return self.value(category, lambda n: self.policy(n).match, "content_or_title")

    def template_of(self, name: str) -> str:
        return self._inherited("template")(name)

    def roots(self) -> list[str]:
        return [c.folder for c in self.categories if c.folder.strip()]


def two_digits(number: Column) -> Column:
    """At least two digits, as ``%02d`` writes them, without a formatter for each row."""
    return F.concat(F.when(number.between(0, 9), "0").otherwise(""), number.cast("string"))


def season_folder(season: Column) -> Column:
    return F.concat(F.lit("Season "), two_digits(season))


def _under(folder: Column, name: Column, buckets: Column) -> Column:
    return F.when(buckets, F.concat_ws("/", folder, letter_bucket(name))).otherwise(folder)


def show_folder_parts(library: Library, category: Column) -> dict[str, Column]:
    title = sort_name(effective_title(), library.articles_last)
    base = trim_slashes(library.folder(category))
    return {"_base": base, "_title": title, "_buckets": library.buckets(category)}


def plan_directory(files: DataFrame, library: Library, existing_dirs: DataFrame | None = None) -> DataFrame:
    """Attach ``planned_dir``; null without a folder for the category or without a title. Needs ``category``.

    ``existing_dirs`` (path) lets a show reuse a folder that is already there in another spelling.
    """
    category = F.col("category")
    df = files.withColumns(show_folder_parts(library, category))
    show = F.concat_ws("/", _under(F.col("_base"), F.col("_title"), F.col("_buckets")), sanitize("_title"))
    df = df.withColumn("_show", F.when(category.isin(*TV), show))
    if existing_dirs is not None:
        df = existing_show_folder(df, existing_dirs)
    season = F.col("season")
    tv = F.when(category == "TvShow", F.concat_ws("/", "_show", season_folder(F.coalesce(season, F.lit(1))))).when(
        season > 0, F.concat_ws("/", "_show", season_folder(season), F.lit(EXTRAS))
    ).otherwise(F.concat_ws("/", "_show", F.lit(EXTRAS)))
    dated = F.when(F.col("year").isNotNull(), F.concat(F.col("_title"), F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise(F.col("_title"))
    film = F.concat_ws("/", _under(F.col("_base"), F.col("_title"), F.col("_buckets")), sanitize(dated))
    film = F.when(category == "MovieExtra", F.concat_ws("/", film, F.lit(EXTRAS))).otherwise(film)
    sorts_on = F.when(is_blank("_title"), stem_of("file_name")).otherwise(F.col("_title"))
    other = _under(F.col("_base"), sorts_on, F.col("_buckets"))
    titled = not_blank("_title")
    planned = (
        F.when(is_blank("_base"), None)
        .when(category.isin(*TV), F.when(titled, tv))
        .when(category.isin(*FILMS), F.when(titled, film))
        .otherwise(other)
    )
    return staged(df, {"planned_dir": planned}).drop("_base", "_title", "_buckets", "_show")


def existing_show_folder(df: DataFrame, existing_dirs: DataFrame) -> DataFrame:
    """Replace ``_show`` by the spelling of an existing folder; the exact one is preferred."""
    known = existing_dirs.select(slashed(trim_slashes("path")).alias("_have")).distinct().withColumn("_key", F.upper("_have"))
    shows = df.select("_show").filter("_show IS NOT NULL").distinct().withColumn("_key", F.upper("_show"))
    found = shows.join(known, "_key").groupBy("_show").agg(
        F.min_by("_have", F.struct(F.col("_have") != F.col("_show"), F.col("_have"))).alias("_spelling")
    )
    return df.join(found, "_show", "left").withColumn("_show", F.coalesce("_spelling", "_show")).drop("_spelling")


# --- names -----------------------------------------------------------------------------------------

# Numbering at the start of a name.
LEADING_NUMBER = r"^\s*(\d{1,3})(?:\s*[-–—]\s*(\d{1,3}))?(?![0-9])"
DOUBLED = r"^\s*(\d{1,3}(?:\s*[-–—]\s*\d{1,3})?)\s*[-–—]\s+(?=\1\s*[-–—]\s+)"
EPISODE_PREFIX = r"^\d{2,3}(-\d{2,3})?\s*-\s+"


def starts_with_episode(name, episode) -> Column:
    number = digits_value(F.regexp_extract(stem_of(name), LEADING_NUMBER, 1))
    return F.coalesce(number == episode, F.lit(False))


def is_doubled(name) -> Column:
    return stem_of(name).rlike(DOUBLED)


def collapse_prefixes(name) -> Column:
    """``01 - 01 - Name`` -> ``01 - Name``, up to eight repetitions."""
    repeated = r"^\s*(\d{1,3}(?:\s*[-–—]\s*\d{1,3})?)\s*[-–—]\s+(?=\1\s*[-–—]\s+)(?:\1\s*[-–—]\s+(?=\1\s*[-–—]\s+)){0,7}"
    stem = F.regexp_replace(stem_of(name), repeated, "")
    text = F.col(name) if isinstance(name, str) else name
    return F.when(is_doubled(name), F.concat(stem, extension_of(text))).otherwise(text)


def doubled_names(files: DataFrame, folder: str) -> DataFrame:
    """Rename proposals for names with a repeated numbering prefix below a folder."""
    below = files.filter(is_under("full_path", F.lit(folder), or_equal=False) & is_doubled("file_name"))
    return below.select("id", "full_path", "file_name", collapse_prefixes("file_name").alias("proposed_name"))


TEMPLATE_FIELD = re.compile(r"\{([a-zA-Z]+)(?::([^}]*))?\}")


def _number(value: Column, format_: str | None) -> Column:
    if not format_:
        text = value.cast("string")
    elif re.fullmatch(r"0+", format_):
        text = F.format_string(f"%0{len(format_)}d", value)
    elif re.fullmatch(r"[dD]\d*", format_):
        text = F.format_string(f"%0{format_[1:] or 1}d", value)
    else:
        text = value.cast("string")
    return F.when(value.isNotNull(), text).otherwise("")


def filled_template(template: str) -> Column:
    """A template such as ``{title} - {season:00}x{episode:00}`` with its fields filled in, not yet tidied."""
    fields = {
        "title": lambda f: strip(effective_title()),
        "secondarytitle": lambda f: strip(F.coalesce("secondary_title", F.lit(""))),
        "year": lambda f: _number(F.col("year"), f),
        "season": lambda f: _number(F.col("season"), f),
        "episode": lambda f: _number(F.col("episode"), f),
        "episodeend": lambda f: _number(F.when(F.col("episode_end") > F.col("episode"), F.col("episode_end")), f),
        "numbering": lambda f: numbering_display(),
        "quality": lambda f: quality_display(),
        "name": lambda f: stem_of("file_name"),
    }
    parts, at = [], 0
    for found in TEMPLATE_FIELD.finditer(template):
        parts.append(F.lit(template[at:found.start()]))
        known = fields.get(found.group(1).lower())
        parts.append(known(found.group(2)) if known else F.lit(found.group(0).replace(found.group(1), found.group(1).lower(), 1)))
        at = found.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def tidied(name: Column) -> Column:
    """A filled template without what empty fields leave behind, as a file's stem."""
    stem = F.regexp_replace(name, INVALID_NAME_CHARS, " ")
    stem = F.regexp_replace(stem, r"[(\[{]\s*[)\]}]", " ")
    stem = F.trim(F.regexp_replace(stem, r"\s+", " "))
    stem = F.regexp_replace(stem, r"[-–—]\s*(?:[-–—]\s*)+", "- ")
    return F.regexp_replace(F.trim(F.regexp_replace(stem, r"\s+", " ")), r"^[-–—_. ]+|[-–—_. ]+$", "")


def name_template(files: DataFrame, template: Column, name: str = "templated") -> DataFrame:
    """Attach the name a filled ``template`` gives; empty if nothing is left of it, null without one.

    The steps are columns of their own: each is computed once, and no generated method holds them all.
    """
    df = staged(files, {"_filled": template})
    df = staged(df, {"_stem": tidied(F.col("_filled"))})
    whole = F.when(F.col("_stem") == "", "").otherwise(F.concat("_stem", F.lower("extension")))
    return staged(df, {name: whole}).drop("_filled", "_stem")


def plan_file_name(files: DataFrame, library: Library) -> DataFrame:
    """Attach ``planned_name``, the name a file is filed under. Needs ``category``."""
    category, episode, last = F.col("category"), F.col("episode"), F.col("episode_end")
    filled = F.lit(None).cast("string")
    for name in library.names():
        template = library.template_of(name)
        if template.strip():
            filled = F.when(F.upper(category) == name.upper(), filled_template(template)).otherwise(filled)
    df = name_template(files, filled, "_templated")
    prefix = F.concat(two_digits(episode), F.when(last > episode, F.concat(F.lit("-"), two_digits(last))).otherwise(""))
    numbered = F.col("file_name").rlike(EPISODE_PREFIX) | starts_with_episode("file_name", episode)
    plain = F.when((category != "TvShow") | episode.isNull() | (episode < 0) | numbered, F.col("file_name")).otherwise(
        F.concat(prefix, F.lit(" - "), "file_name")
    )
    return staged(df, {"planned_name": F.when(F.col("_templated") != "", collapse_prefixes("_templated")).otherwise(plain)}).drop("_templated")


def plan_paths(files: DataFrame, library: Library, existing_dirs: DataFrame | None = None) -> DataFrame:
    """Attach planned_dir, planned_name and planned_path."""
    placed = plan_file_name(plan_directory(files, library, existing_dirs), library)
    path = F.when(F.col("planned_dir").isNotNull(), F.concat_ws("/", "planned_dir", "planned_name"))
    return placed.withColumn("planned_path", path)


def under_library(roots: Sequence[str]) -> Column:
    return any_of(is_under("full_path", F.lit(root), or_equal=False) for root in roots)


def filing_state(planned: DataFrame, library: Library) -> DataFrame:
    """Attach under_root, at_planned_path and correctly_filed."""
    here, there = parent_dir(slashed("full_path")), F.col("planned_dir")
    owner = lambda d: F.when(base_name(parent_dir(d)).rlike(SEASON_FOLDER), parent_dir(parent_dir(d))).otherwise(parent_dir(d))
    beside = (
        F.col("category").isin("TvExtra", "MovieExtra")
        & (F.upper(base_name(here)) == EXTRAS.upper())
        & (F.upper(base_name("full_path")) == F.upper("planned_name"))
        & (F.upper(owner(here)) == F.upper(owner(there)))
    )
    at_planned = F.coalesce(path_key("full_path") == path_key("planned_path"), F.lit(False))
    filed = F.col("under_root") & (F.col("planned_path").isNull() | F.col("at_planned_path") | F.coalesce(beside, F.lit(False)))
    located = staged(planned, {"under_root": under_library(library.roots()), "at_planned_path": at_planned})
    return staged(located, {"correctly_filed": filed})


# --- collisions --------------------------------------------------------------------------------------

def destination_collisions(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Attach ``collision``: in place, duplicate, name taken, or free.

    ``existing``: full_path, size_bytes. Two listings of one path count once; any of equal size makes it a duplicate.
    """
    # Paths begin alike, so rows are sorted by a hash of the path before the path itself.
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("_at"))
    taken = hashed(existing.select(path_key("full_path").alias("_at"), "size_bytes")).groupBy("_hash", "_at").agg(F.min("size_bytes").alias("_size"))
    joined = hashed(planned.withColumn("_at", path_key("planned_path"))).join(taken, ["_hash", "_at"], "left")
    kind = (
        F.when(F.col("planned_path").isNull(), None)
        .when(F.col("_at") == path_key("full_path"), "in place")
        .when(F.col("_size") == F.col("size_bytes"), "duplicate")
        .when(F.col("_size").isNotNull(), "name taken")
        .otherwise("free")
    )
    return joined.withColumn("collision", kind).drop("_at", "_size", "_hash")


def collision_by_hash(planned: DataFrame, existing: DataFrame, skip_taken: bool = True) -> DataFrame:
    """The same by content: a different length is different content, an equal length is settled by hash."""
    taken = existing.groupBy(path_key("full_path").alias("_at")).agg(
        F.min_by(F.struct("size_bytes", "sha256"), F.struct("ord", "id")).alias("_there")
    )
    joined = planned.withColumn("_at", path_key("planned_path")).join(taken, "_at", "left")
    differs = (F.col("size_bytes") > 0) & (F.col("_there.size_bytes") != F.col("size_bytes"))
    same = ~differs & (F.length("_there.sha256") > 0) & (F.upper("_there.sha256") == F.upper("sha256"))
    action = (
        F.when(F.col("planned_path").isNull(), None)
        .when(F.col("_at") == path_key("full_path"), "in place")
        .when(F.col("_there").isNull(), "move")
        .when(same, "already present")
        .otherwise("name taken" if skip_taken else "rename")
    )
    return joined.withColumn("action", action).drop("_at", "_there")


def unique_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Give every wanted path (id, ord, planned_path) a free name: itself, else ``name (n).ext``.

    The first file in catalogue order that wants a path gets it, unless it exists. The others take
    the free numbers in turn; a number is free if no existing file and no other wanted path has
    that name. A numbered name belongs to one path only, so no two files get the same one.
    """
    # Both are read several times below, so each input runs once for them.
    rows = stored(wanted.filter("planned_path IS NOT NULL").withColumn("_key", path_key("planned_path")))
    have = stored(existing.select(path_key("full_path").alias("_path")).distinct())
    # Numbers of at most 18 digits; none above can be reached by counting.
    suffix = r"^([\s\S]*) \(([1-9]\d{0,17})\)(\.[^./]*)?$"
    named = have.unionByName(rows.select(F.col("_key").alias("_path"))).filter(F.col("_path").rlike(suffix)).distinct()
    numbered = named.select(
        F.concat(F.regexp_extract("_path", suffix, 1), F.coalesce(F.regexp_extract("_path", suffix, 3), F.lit(""))).alias("_key"),
        F.regexp_extract("_path", suffix, 2).cast("bigint").alias("n"),
    ).distinct()
    taken = ranked(numbered.join(rows.select("_key").distinct(), "_key", "left_semi"), ["_key"], ["n"], "_i")
    served = ranked(rows, ["_key"], ["ord", "id"], "_turn").join(have.select(F.col("_path").alias("_key"), F.lit(1).alias("_there")), "_key", "left")
    turns = served.withColumn("_k", F.col("_turn") - F.when(F.col("_there").isNull(), 1).otherwise(0))
    # A taken number n, the i-th of its path, has n - i free ones below it. Taken numbers and waiting
    # files in one row, each taken one in front of the file that would get it: a file's number is its place.
    waiting = turns.filter("_k > 0").select("_key", (F.col("_k") * 2).alias("_slot"), "ord", "id")
    line = waiting.unionByName(taken.select("_key", ((F.col("n") - F.col("_i")) * 2 + 1).alias("_slot"), F.col("n").cast(waiting.schema["ord"].dataType).alias("ord"), F.lit(None).cast(waiting.schema["id"].dataType).alias("id")))
    placed = ranked(line, ["_key"], ["_slot", "ord", "id"], "suffix").filter("id IS NOT NULL").select("id", "suffix")
    joined = turns.join(placed, "id", "left").withColumn("suffix", F.coalesce("suffix", F.lit(0).cast("bigint")))
    name = base_name("planned_path")
    fresh = F.concat(
        parent_dir("planned_path"), F.lit("/"), stem_of(name), F.lit(" ("), F.col("suffix").cast("string"), F.lit(")"), extension_of(name)
    )
    return joined.withColumn("final_path", F.when(F.col("suffix") == 0, F.col("planned_path")).otherwise(fresh)).drop("_key", "_turn", "_there", "_k")


# --- renaming ----------------------------------------------------------------------------------------

def scheme_name() -> Column:
    """Name by the category's scheme; empty when nothing reliable is known. Needs ``category``."""
    title = sanitize(effective_title())
    numbered = F.col("season").isNotNull() & F.col("episode").isNotNull()
    category = F.col("category")
    stem = (
        F.when((category == "TvShow") & numbered, F.concat(title, F.lit(" - "), numbering_display()))
        .when((category == "Movie") & F.col("year").isNotNull(), F.concat(title, F.lit(" ("), F.col("year").cast("string"), F.lit(")")))
        .when(category.isin("Movie", "Audio"), title)
        .otherwise("")
    )
    return F.when((title == "") | (stem == ""), "").otherwise(F.concat(stem, F.lower("extension")))


def _cut(text: Column, at: Column, length: Column, insert: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), insert, F.substring(text, at + length, F.length(text)))


def rename_proposals(files: DataFrame, previous_title: str | None = None) -> DataFrame:
    """One proposal per file that can be named: by scheme, else old title for new, else title in front.

    ``previous_title`` names a column with the title a file had before.
    """
    stem, extension = stem_of("file_name"), extension_of("file_name")
    current = strip(effective_title())
    by_scheme = F.nullif(scheme_name(), F.lit(""))
    title = sanitize(current)
    at = F.instr(F.upper(stem), F.upper(title))
    rest = F.when(at > 0, _cut(stem, at, F.length(title), F.lit(""))).otherwise(stem)
    rest = F.regexp_replace(rest, r"^[ \-–—_.]+|[ \-–—_.]+$", "")
    titled = F.concat(sanitize(F.when(rest == "", title).otherwise(F.concat(title, F.lit(" - "), rest))), extension)
    in_front = F.when((title != "") & ~F.startswith(F.upper(stem), F.upper(title)), titled)
    swapped = F.lit(None).cast("string")
    if previous_title:
        previous = strip(previous_title)
        found = F.instr(F.upper(stem), F.upper(previous))
        text = F.concat(sanitize(_cut(stem, found, F.length(previous), current)), extension)
        swapped = F.when((previous != "") & (current != "") & (previous != current) & (found > 0) & (F.length(text) > F.length(extension)), text)
    proposed = F.coalesce(by_scheme, swapped, in_front)
    return staged(files, {"proposed_name": proposed}).filter("proposed_name IS NOT NULL").select(
        "id", F.col("file_name").alias("current_name"), "proposed_name",
        F.concat(parent_dir("full_path"), F.lit("/"), F.col("proposed_name")).alias("proposed_path"),
        (F.col("file_name") != F.col("proposed_name")).alias("will_change"),
    )


# --- subtitles, folders ------------------------------------------------------------------------------

# Subtitle extensions.
SUBTITLES = (".srt", ".sub", ".idx", ".ssa", ".ass", ".vtt", ".smi", ".sami", ".sbv", ".usf", ".ttml", ".dfxp", ".lrc",
             ".mpl2", ".pjs", ".rt", ".stl")


def subtitle_companions(videos: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, subtitle_path, suffix): subtitles of the same folder whose name is the video's plus a language tag.

    A tag is a separator and a word of at most 32 characters in all, so the stems a subtitle can belong to
    are its own prefixes before a separator; they are joined by equality instead of pairing a folder's files.
    """
    subs = listing.withColumns({"_name": base_name("full_path")}).filter(F.lower(extension_of("_name")).isin(*SUBTITLES))
    subs = subs.select(F.col("full_path").alias("subtitle_path"), path_key(parent_dir("full_path")).alias("_dir"), stem_of("_name").alias("_stem"))
    # The end of the stem, cut in front of each tag it may hold; the first piece is never a tag, being the video's.
    # Staged, so that neither ``explode`` interprets them nor a filter inferred from it carries them down to the paths.
    pieces = F.regexp_extract_all(F.right("_stem", F.lit(33)), F.lit(r"(?s)(.(?:(?![.\-_ ]+\p{L}).)*)"), F.lit(1))
    count = F.greatest(F.size("_pieces"), F.lit(1))
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice("_pieces", k + 1, count), ""))
    cut = staged(staged(subs, {"_pieces": pieces}), {"_suffixes": suffixes})
    open_ends = cut.select("subtitle_path", "_dir", "_stem", F.explode("_suffixes").alias("suffix")).withColumn(
        "_key", F.upper(F.substring("_stem", F.lit(1), F.length("_stem") - F.length("suffix")))
    )
    owners = videos.select("id", path_key(parent_dir("full_path")).alias("_dir"), F.upper(stem_of(base_name("full_path"))).alias("_key"))
    # Folders begin alike, so rows are sorted by a hash of both keys before the keys themselves.
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("_dir", "_key"))
    return hashed(owners.filter("_key <> ''")).join(hashed(open_ends), ["_hash", "_dir", "_key"]).select("id", "subtitle_path", "suffix")


def subtitle_target(new_video_path, suffix="suffix", subtitle="subtitle_path") -> Column:
    """Path of a subtitle that travels with its video."""
    name = stem_of(base_name(new_video_path))
    return F.concat(parent_dir(new_video_path), F.lit("/"), name, F.col(suffix), extension_of(base_name(subtitle)))


def folder_moves(planned: DataFrame, existing_dirs: DataFrame | None = None) -> DataFrame:
    """(folder, destination, files): folders that move as a whole.

    All files in the folder are in the library and plan to one directory that is free and not this one, and
    every file below plans to the same relative place. ``planned`` has under_root and planned_dir.
    """
    rows = with_folder(planned).withColumn("_plan", path_key("planned_dir"))
    # Everything below is about folders, so the files are planned once.
    per_folder = stored(rows.groupBy("folder_key").agg(
        F.count(F.lit(1)).alias("files"),
        F.count("_plan").alias("_planned"),
        F.min("_plan").alias("_low"), F.max("_plan").alias("_high"),
        F.min_by("planned_dir", F.struct("ord", "id")).alias("destination"),
        F.every("under_root").alias("_inside"),
    ))
    climbed = ancestors_of(per_folder)
    agreed = (F.col("_planned") == F.col("files")) & (F.col("_low") == F.col("_high"))
    movable = per_folder.filter(agreed & F.col("_inside") & (F.col("_low") != F.col("folder_key")))
    occupied = climbed.select("above").distinct()
    if existing_dirs is not None:
        occupied = occupied.unionByName(existing_dirs.select(path_key(trim_slashes("path")).alias("above"))).distinct()
    movable = movable.join(occupied.withColumnRenamed("above", "_low"), "_low", "left_anti")
    # Folders below must agree too; they are compared as folders, each with its own single plan.
    below = climbed.filter("level > 0").join(
        movable.select(F.col("folder_key").alias("above"), F.col("_low").alias("_target")), "above"
    )
    children = below.join(per_folder.select("folder_key", "_low", "_high", F.col("_planned").alias("_p"), F.col("files").alias("_f")), "folder_key")
    expected = F.concat("_target", F.substring("folder_key", F.length("above") + 1, F.length("folder_key")))
    broken = children.filter(~F.coalesce((F.col("_p") == F.col("_f")) & (F.col("_low") == expected) & (F.col("_high") == expected), F.lit(False)))
    return movable.join(broken.select(F.col("above").alias("folder_key")).distinct(), "folder_key", "left_anti").select(
        F.col("folder_key").alias("folder"), "destination", "files"
    )
