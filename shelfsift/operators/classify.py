"""Season, episode, year, category and title read out of names and folders.

Each pattern runs once per row: its match is turned into one array (text before the match, then the
groups), and the ladder only looks at those arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder_names, stem_of
from ..functions.staging import staged
from ..functions.text import NUMBER, VALID_NUMBER, digits_value, is_blank, number_value, strip, title_case
from .categories import auto_category, keeps_numbering, media_kind

SEP = "\x01"
MASK, MASK_DIGIT = "\ue000", "\ue001"

# The patterns a name is read with.
DASHES = "\\-–—\ufffd"
SEASON_EPISODE = (
    r"(?iU)\b(?:s|se|season|series)\s*\.?\s*(\d{1,3})\s*"
    rf"(?:[._{DASHES}]?\s*(?:e|ep|eps|episode|episodes|pt|part)|[{DASHES}]\s*(?:e|ep|eps|episode|episodes)?)"
    r"\s*\.?\s*(\d{1,3})(?:\s*[._\-]?\s*(?:e|ep|episode)?\s*\.?\s*(\d{1,3}))?\b"
)
SEASON_EPISODE_WORDS = (
    rf"(?iU)\b(?:season|series)\s*[._\-]?\s*({NUMBER})\s*[._\-]?\s*(?:e|ep|eps|episode|episodes|part|pt)\s*[._\-]?\s*({NUMBER})\b()"
)
X_FORMAT = r"(?<![a-zA-Z0-9])(\d{1,2})x(\d{1,3})(?:\s*[-._]?\s*x?(\d{1,3}))?(?![a-zA-Z0-9])"
SPACED = r"(?U)[-–—]\s*(\d{1,2})\s*[\s._]\s*(\d{1,3})(?:\s*[\s._]\s*(\d{1,3}))?\s*[-–—]"
DASHED = rf"(?U)(?<=[^\s\d{MASK_DIGIT}][ ._])(\d{{1,2}})[{DASHES}](\d{{2}})(?=[ ._][^\s\d{MASK_DIGIT}])()"
BRACKETED = rf"(?U)[\[(]\s*(\d{{1,2}})\s*[{DASHES}]\s*(\d{{2,3}})\s*[\])]()"
EPISODE_ONLY = (
    r"(?iU)(?<![a-z0-9])(?:e|ep|episode|part|pt)\s*\.?\s*(\d{1,3})(?:\s*[-._]?\s*(?:e|ep|episode)?\s*\.?\s*(\d{1,3}))?(?![0-9])"
)
SEASON_WORD = rf"(?iU)\b(?:season|series)\s*[._\-]?\s*({NUMBER})\b"
YEAR_THEN_CODE = r"(?U)(?<![0-9])(?:19|20)\d{2}[ ._\-][1-9][0-9]?[0-9]{2}(?![0-9])"
THREE_DIGITS = r"(?<![0-9])[1-9][0-9]{2}(?![0-9])"
FOUR_DIGITS = r"(?<![0-9])[1-9][0-9]{3}(?![0-9])"
ANY_YEAR = r"(?<![0-9])((?:19|20)\d{2})(?![0-9])"
NOISE = (
    r"\b(?:1080p|720p|2160p|480p|4k|x\.?26[45]|h\.?26[45]|avc|hevc|vp9|av1|xvid|divx|10bit|8bit|\d{3,4}x\d{3,4}|"
    r"bluray|brrip|bdrip|dvdrip|webrip|web-?dl|hdtv|aac|ac3|dts|hdr|remux|proper|repack|internal|extended|uncut)\b"
)
SEASON_OF = rf"(?iU)^\s*(?:(?:season|series|s)|[\s\S]*?[\s,;:\-–—_]+(?:season|series))\s*[._\-]?\s*({VALID_NUMBER})\s*$"
SEASON_FOLDER = rf"(?iU)^(?:season|series|s)\s*[._\-]?\s*{NUMBER}$"
SEASON_SUFFIX = rf"(?iU)[\s,;:\-–—_]+(?:season|series)\s*[._\-]?\s*{NUMBER}\s*$"
# Numbers that are picture sizes and no episode codes, and the longest run of episodes in one file.
RESOLUTIONS = (240, 360, 480, 540, 576, 720)
RESOLUTIONS_4 = (1080, 1440, 2160, 4320, 1280, 1920, 2560, 3840, 7680)
MAX_RUN = 8

# Folders and names of extras.
EXTRA_FOLDERS = (
    "extra", "extras", "special", "specials", "featurette", "featurettes", "behind the scenes", "behind-the-scenes",
    "deleted scenes", "deleted", "bonus", "bonus features", "bonus disc", "interviews", "making of", "making-of",
    "outtakes", "bloopers", "shorts", "trailers", "bts",
)
EXTRA_SUFFIX = r"(?iU)-(?:behindthescenes|deleted|deletedscene|featurette|interview|scene|short|trailer|other|blooper|outtake|makingof)s?$"
EXTRA_WORDS = (
    r"(?iU)\b(?:behind[\s._-]?the[\s._-]?scenes|featurette|deleted[\s._-]scenes?|making[\s._-]of|bloopers?|outtakes?|"
    r"gag[\s._-]reel|bonus[\s._-]features?)\b"
)
SEASON_ZERO = r"(?iU)(?<![0-9])(?:s\s*0+\s*e\s*\d{1,3}|(?:season|series)\s*0+)(?![0-9])"


def matched(text: Column, pattern: str, groups: int) -> Column:
    """[text before the first match, group 1, ...]; one element when there is no match."""
    flags, body = (pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1:]) if pattern.startswith("(?i") or pattern.startswith("(?U") else ("", pattern)
    target = "".join(f"${i + 1}{SEP}" for i in range(groups)) + f"${groups + 1}"
    return F.split(F.regexp_replace(text, rf"{flags}^([\s\S]*?)(?:{body})[\s\S]*$", target), SEP)


def hit(match: Column) -> Column:
    return F.size(match) > 1


def mask_noise(name: Column) -> Column:
    """The name with every encoding token overwritten at equal length, so positions stay."""
    # Fencing the tokens makes every second piece of the split one of them.
    pieces = F.split(F.regexp_replace(name, rf"(?iU)({NOISE})", f"{SEP}$1{SEP}"), SEP)
    hidden = lambda t: F.regexp_replace(F.regexp_replace(t, r"[^0-9]", MASK), r"[0-9]", MASK_DIGIT)
    return F.array_join(F.transform(pieces, lambda t, i: F.when(i % 2 == 1, hidden(t)).otherwise(t)), "")


def plausible_year(latest: int) -> str:
    """Regex of the years from 1900 to ``latest``."""
    decade, digit = divmod(latest - 2000, 10)
    parts = [r"19\d{2}"] + ([rf"20[0-{decade - 1}]\d"] if decade > 0 else []) + [rf"20{decade}[0-{digit}]"]
    return rf"(?<![0-9])({'|'.join(parts)})(?![0-9])"


def clean_title(name: Column, cut: Column, capitalise: bool = True) -> Column:
    head = F.when(cut > 0, F.substring(name, F.lit(1), cut)).otherwise(name)
    text = F.regexp_replace(F.translate(head, "._-", "   "), rf"(?iU){NOISE}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[ ()\[\]]+|[ ()\[\]]+$", "")
    return title_case(text) if capitalise else text


def season_from_path(folders: Column) -> Column:
    """Season of the nearest folder that names one."""
    named = F.transform(folders, lambda n: F.regexp_extract(n, SEASON_OF, 1))
    return number_value(F.get(F.filter(named, lambda n: n != ""), 0))


def is_extra_folder(folder: Column) -> Column:
    return F.lower(folder).isin(*EXTRA_FOLDERS) | folder.rlike(SEASON_ZERO)


def title_from_path(folders: Column) -> Column:
    """Name of the nearest folder that says what the files are."""

    def cleaned(folder: Column) -> Column:
        bare = F.when(strip(folder).rlike(SEASON_FOLDER), F.lit("")).otherwise(
            F.regexp_replace(F.regexp_replace(strip(folder), SEASON_SUFFIX, ""), r"[\s,;:\-–—_]+$", "")
        )
        return strip(F.regexp_replace(F.translate(bare, "._", "  "), r"(?U)\s+", " "))

    telling = F.filter(folders, lambda n: (F.length(n) > 1) & ~is_extra_folder(n))
    return F.get(F.filter(F.transform(telling, cleaned), lambda n: F.length(n) > 0), 0)


def extra_category(name: Column, folders: Column, season: Column, category: Column) -> Column:
    """TvExtra or MovieExtra for specials and featurettes, else null."""
    extra = (
        F.coalesce(season == 0, F.lit(False))
        | name.rlike(SEASON_ZERO)
        | name.rlike(EXTRA_SUFFIX)
        | name.rlike(EXTRA_WORDS)
        | F.exists(folders, is_extra_folder)
    )
    tv = season.isNotNull() | (category == "TvShow") | F.exists(folders, lambda n: n.rlike(r"(?iU)^(season|series)\s*\d+$"))
    return F.when(extra, F.when(tv, "TvExtra").otherwise("MovieExtra"))


def detect_extra(files: DataFrame) -> DataFrame:
    staged = files.withColumns({"_name": stem_of("file_name"), "_folders": folder_names("full_path")})
    found = extra_category(F.col("_name"), F.col("_folders"), F.col("season"), F.col("video_category"))
    return staged.withColumn("extra_category", found).drop("_name", "_folders")


def _run(start: Column, end: Column) -> Column:
    """End of a double episode when it follows closely."""
    return F.when((end > start) & (end - start <= MAX_RUN), end)


def _code(text: Column) -> Column:
    """(season, episode) of a compact code."""
    season = F.substring(text, F.lit(1), F.length(text) - 2)
    return F.struct(season.cast("int").alias("s"), F.substring(text, -2, 2).cast("int").alias("e"))


def _first_code(masked: Column, pattern: str, tail: str, accept) -> Column:
    found = F.regexp_extract_all(masked, F.lit(f"({pattern})"), F.lit(1))
    return F.get(F.filter(found, lambda m: accept(F.regexp_extract(m, tail, 1))), 0)


def classify_files(files: DataFrame, as_of_year: int, capitalise: bool = True, plugin_extensions: tuple[str, ...] = (), future_years: bool = True) -> DataFrame:
    """Derive kind, category, numbering, year and title afresh; hand-typed numbering stays.

    A name that only has years still to come is dated by the first of them, unless ``future_years`` is
    off: then it has none. Where the title ends does not depend on it.
    """
    kept = files.columns
    df = files.withColumns({
        "kind": media_kind(plugin_extensions=plugin_extensions),
        "_name": stem_of("file_name"),
        "_folders": folder_names("full_path"),
    })
    df = staged(df, {"_masked": mask_noise(F.col("_name"))})
    name, masked, folders = F.col("_name"), F.col("_masked"), F.col("_folders")
    video = F.col("kind") == "Video"
    df = df.withColumns({
        "_se": matched(name, SEASON_EPISODE, 3),
        "_year": matched(masked, plausible_year(as_of_year + 1), 1),
        "_any_year": matched(masked, ANY_YEAR, 1),
        "_fseason": season_from_path(folders),
    })
    # Each later step of the ladder is only tried on names the earlier ones left open.
    no = lambda c: ~F.coalesce(hit(F.col(c)), F.lit(False))
    df = df.withColumns({
        "_year": F.when(hit(F.col("_year")), F.col("_year")).otherwise(F.col("_any_year")),
        "_sw": F.when(no("_se"), matched(name, SEASON_EPISODE_WORDS, 3)),
    })
    df = df.withColumn("_xf", F.when(no("_se") & no("_sw"), matched(name, X_FORMAT, 3)))
    left = video & no("_se") & no("_sw") & no("_xf")
    df = df.withColumn("_sp", F.when(left, matched(masked, SPACED, 3)))
    df = df.withColumn("_sp", F.when(left & no("_sp"), matched(masked, DASHED, 3)).otherwise(F.col("_sp")))
    df = df.withColumn("_sp", F.when(left & no("_sp"), matched(masked, BRACKETED, 3)).otherwise(F.col("_sp")))
    in_folder = left & no("_sp") & F.col("_fseason").isNotNull()
    df = df.withColumns({
        "_bare": F.when(in_folder, digits_value(F.regexp_extract(strip(name), r"(?U)^(\d{1,2})$", 1))),
        "_lead": F.when(in_folder, digits_value(F.regexp_extract(strip(name), r"(?U)^(\d{1,3})\s*[.\-–—_)]\s*\S", 1))),
        "_mark": F.when(in_folder, matched(name, EPISODE_ONLY, 2)),
        "_word": F.when(left & no("_sp"), matched(name, SEASON_WORD, 1)),
    })
    coded = left & no("_sp") & no("_word")
    df = df.withColumn(
        "_y4",
        F.when(coded & hit(F.col("_any_year")), _first_code(
            masked, YEAR_THEN_CODE, r"(\d+)$",
            lambda c: F.when(F.length(c) == 4, ~c.cast("int").isin(*RESOLUTIONS_4) & ~c.cast("int").between(1900, 2099))
            .otherwise(~c.cast("int").isin(*RESOLUTIONS)) & ~c.endswith("00"),
        )),
    )
    undated = coded & no("_year")
    df = df.withColumn("_c4", F.when(undated, _first_code(masked, FOUR_DIGITS, r"(\d+)$", lambda c: ~c.cast("int").isin(*RESOLUTIONS_4) & ~c.endswith("00"))))
    df = df.withColumn(
        "_c3",
        F.when(undated & F.col("_c4").isNull(), _first_code(masked, THREE_DIGITS, r"(\d+)$", lambda c: ~c.cast("int").isin(*RESOLUTIONS) & ~c.endswith("00"))),
    )
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    mark_episode = F.when(hit(F.col("_mark")), digits_value(F.get("_mark", 1)))
    df = df.withColumns({
        "_lead": positive("_lead"),
        "_mark_e": mark_episode,
    })
    df = df.withColumn("_fe", F.coalesce(positive("_bare"), F.col("_lead"), F.col("_mark_e")))

    def numbered(match: str, number=digits_value) -> Column:
        m = F.col(match)
        start = number(F.get(m, 2))
        return _found("TvShow", number(F.get(m, 1)), start, _run(start, digits_value(F.get(m, 3))), F.length(F.get(m, 0)))

    def _found(category, season, episode, end, cut, episode_name=None) -> Column:
        as_int = lambda v: (F.lit(None) if v is None else v).cast("int")
        return F.struct(
            F.lit(category).alias("category"), as_int(season).alias("season"), as_int(episode).alias("episode"), as_int(end).alias("end"),
            as_int(cut).alias("cut"), (F.lit(False) if episode_name is None else F.coalesce(episode_name, F.lit(False))).alias("episode_name"),
        )

    year_hit = hit(F.col("_year"))
    dated = F.lit(True) if future_years else F.get("_year", 1).cast("int") <= as_of_year + 1
    year_at = F.length(F.get("_year", 0))
    code_at = F.instr(masked, F.col("_y4")) - 1
    y4 = _code(F.regexp_extract("_y4", r"(\d+)$", 1))
    compact = F.coalesce("_c4", "_c3")
    compact_at = F.regexp_instr(masked, F.concat(F.lit("(?<![0-9])"), compact, F.lit("(?![0-9])"))) - 1
    folder_end = F.when(F.col("_mark_e") == F.col("_fe"), _run(F.col("_fe"), digits_value(F.get("_mark", 2))))
    by_name = (
        F.when(hit(F.col("_se")), numbered("_se")).when(hit(F.col("_sw")), numbered("_sw", number_value)).when(hit(F.col("_xf")), numbered("_xf"))
    )
    nothing = _found("Unknown", None, None, None, F.lit(-1))
    as_video = (
        by_name.when(hit(F.col("_sp")), numbered("_sp"))
        .when(F.col("_fe").isNotNull(), _found("TvShow", F.col("_fseason"), F.col("_fe"), folder_end, F.lit(-1), F.col("_lead") == F.col("_fe")))
        .when(hit(F.col("_word")), _found("TvShow", number_value(F.get("_word", 1)), None, None, F.length(F.get("_word", 0))))
        .when(F.col("_y4").isNotNull(), _found("TvShow", y4["s"], y4["e"], None, F.when(year_hit & (year_at <= code_at), year_at).otherwise(code_at)))
        .when(year_hit, _found("Movie", None, None, None, year_at))
        .when(compact.isNotNull(), _found("TvShow", _code(compact)["s"], _code(compact)["e"], None, compact_at))
        .otherwise(nothing)
    )
    as_other = by_name.otherwise(nothing)
    df = staged(df, {"_f": F.when(video, as_video).otherwise(as_other)})
    found = F.col("_f")
    fills = video & F.col("_fseason").isNotNull() & found["episode"].isNotNull() & found["season"].isNull()
    df = df.withColumns({
        "_season": F.when(fills, F.col("_fseason")).otherwise(found["season"]),
        "_category": F.when(fills, "TvShow").when(video, found["category"]).otherwise(F.col("video_category")),
        "_title": clean_title(name, found["cut"], capitalise),
    })
    df = staged(df, {"_extra": F.when(video, extra_category(name, folders, F.col("_season"), F.col("_category")))})
    useless = is_blank("_title") | F.col("_title").rlike(r"(?U)^[\d\s]*$")
    from_path = title_from_path(folders)
    path_title = title_case(from_path) if capitalise else from_path
    df = staged(df, {
        "year": F.when(year_hit & dated, F.get("_year", 1).cast("int")),
        "video_category": F.coalesce("_extra", "_category"),
        "parsed_title": F.when(video & (found["episode_name"] | useless), F.coalesce(path_title, F.col("_title"))).otherwise(F.col("_title")),
        "_old": F.struct("season", "episode", "episode_end"),
        "season": F.col("_season"),
        "episode": found["episode"],
        "episode_end": found["end"],
    })
    keeps = ~video | keeps_numbering(auto_category())
    typed = F.col("numbering_manual")
    return df.withColumn("_keeps", keeps).withColumns(
        {c: F.when(typed, F.col(f"_old.{c}")).when(F.col("_keeps"), F.col(c)) for c in ("season", "episode", "episode_end")}
    ).select(*kept)


def rederive_numbering(files: DataFrame, as_of_year: int, future_years: bool = True) -> DataFrame:
    """``files`` read again by the current rules, with ``was``, ``now`` and ``was_category``.

    A year that a verified title has is kept where the name gives none.
    """
    from ..functions.display import numbering_display
    from ..functions.text import title_verified

    before = files.withColumns({"was": numbering_display(), "was_category": F.col("video_category"), "known_year": F.when(title_verified(), F.col("year"))})
    after = classify_files(before, as_of_year, future_years=future_years).withColumn("year", F.coalesce("year", "known_year"))
    return after.withColumn("now", numbering_display()).drop("known_year")


def renumber(files: DataFrame, as_of_year: int, version: int, future_years: bool = True) -> tuple[DataFrame, DataFrame]:
    """(catalogue, changes): the rows read again, then numbers stripped off what is no programme and extras linked.

    ``changes`` (id, was, now, was_category, now_category) has the rows that the rules read differently,
    as they were read and before anything was stripped.
    """
    from ..session import stored
    from .categories import effective_category, strip_numbering
    from .folders import link_extras

    read = rederive_numbering(files, as_of_year, future_years).withColumn("feature_version", F.lit(version))
    # Linking reads its rows several times, and reading names is what costs most.
    stripped = stored(strip_numbering(read.select(*files.columns), effective_category()).drop("unnumbered"))
    return link_extras(stripped), _changes(read)


def _changes(read: DataFrame) -> DataFrame:
    differs = (F.col("was") != F.col("now")) | (F.col("was_category") != F.col("video_category"))
    return read.filter(differs).select("id", "was", "now", "was_category", F.col("video_category").alias("now_category"))


def renumber_diff(files: DataFrame, as_of_year: int) -> DataFrame:
    """(id, was, now) of rows the current rules read differently."""
    return _changes(rederive_numbering(files, as_of_year))
