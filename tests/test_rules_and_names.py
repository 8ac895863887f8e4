"""Small cases of filters, names, titles and plans."""

import pytest
from pyspark.sql import functions as F

from shelfsift.functions import display as D
from shelfsift.functions import text as X
from shelfsift.functions.wildcards import wildcard_match, wildcard_match_whole
from shelfsift.operators.filters import Exclusion, descent_block, path_exclusion, effective_exclusions
from shelfsift.operators.titles import GENERIC_EPISODE, TIMESTAMP_TITLE
from shelfsift.plans import destinations as P
from shelfsift.sources.fields import normal_extension


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,pattern,expected", [
    ("Movie.MKV", "*.mkv", True), ("Movie.mkv", "mkv", True), ("Movie.mkv", "m?vie*", True), ("a.mkv", "*.mk", False), ("a", "", True), (None, "*", True), ("a+b", "a+*", True),
])
def test_wildcards(spark, value, pattern, expected):
    assert one(spark, wildcard_match(F.lit(value).cast("string"), pattern)) is expected


def test_wildcards_whole(spark):
    assert one(spark, wildcard_match_whole(F.lit(".MKV"), ".mkv")) and not one(spark, wildcard_match_whole(F.lit(".mkv"), "mkv"))
    assert not one(spark, wildcard_match_whole(F.lit("x"), ""))


def test_system_folders_are_excluded(spark):
    paths = [r"C:\Windows\a.mkv", r"D:\Films\Windows\a.mkv", r"C:\Users\me\AppData\Local\Temp\x\a.mkv", r"C:\Program Files (x86)\a.mkv", r"E:\a.mkv", r"E:\Skip\b\a.mkv", r"E:\Top\a.mkv", r"E:\Top\in\a.mkv"]
    df = spark.createDataFrame([(p,) for p in paths], "full_path string")
    rules = effective_exclusions([Exclusion("E:\\Skip\\"), Exclusion("e:/top", False)])
    kept = [paths[1], paths[4], paths[7]]
    assert sorted(r[0] for r in path_exclusion(df, rules).collect()) == sorted(kept)
    assert sorted(r[0] for r in descent_block(df, rules).collect()) == sorted([*kept, paths[6]])


@pytest.mark.parametrize("name,episode,expected", [("01 Equal Opportunities.mkv", 1, True), ("1917 The Film.mkv", 1, False)])
def test_starts_with_episode(spark, name, episode, expected):
    assert one(spark, P.starts_with_episode(F.lit(name), F.lit(episode))) is expected


@pytest.mark.parametrize("name,expected", [
    ("01 - 01 - 01 - Wheel Of Fortune.mkv", "01 - Wheel Of Fortune.mkv"), ("05 - 01 - Wheel Of Fortune.mkv", "05 - 01 - Wheel Of Fortune.mkv"),
    ("11-12 - 11-12 - Two.mkv", "11-12 - Two.mkv"),
])
def test_collapse(spark, name, expected):
    assert one(spark, P.collapse_prefixes(F.lit(name))) == expected


@pytest.mark.parametrize("text,expected", [("number_of_pages", "NumberOfPages"), ("3D model", "DModel"), ("!!!", "")])
def test_identifier(spark, text, expected):
    assert one(spark, X.identifier(F.lit(text))) == expected


@pytest.mark.parametrize("text", ["epub", ".EPUB", "*.epub"])
def test_extension(text):
    assert normal_extension(text) == ".epub"


@pytest.mark.parametrize("text,expected", [("twenty one", 21), ("Three", 3), ("twelfth", 12), ("one twenty", None), ("07", 7), ("", None)])
def test_numbers(spark, text, expected):
    assert one(spark, X.number_value(F.lit(text))) == expected


def test_titles(spark):
    assert one(spark, X.title_case(F.lit("mcDonald's émile o'neil 3d"))) == "McDonald's Émile O'neil 3d"
    assert one(spark, X.title_key(F.lit("  The X-Files: (1993) "))) == "the x files 1993"
    assert one(spark, X.lookup_key(F.lit("Law & Order+"))) == "laworder"
    assert one(spark, X.sort_name(F.lit("The Matrix"), True)) == "Matrix (The)"
    assert [one(spark, X.letter_bucket(F.lit(t))) for t in ("émile", "9 Lives", " x")] == ["É", "#", "X"]
    for text, generic, stamp in (("Episode #1.2", 1, 0), ("Episode 12", 1, 0), ("Episode 12345", 0, 0), ("21. jan. 2015", 0, 1), ("kl. 17:00", 0, 1), ("17:00", 0, 1), ("Heat", 0, 0)):
        assert (one(spark, F.lit(text).rlike(GENERIC_EPISODE)), one(spark, F.lit(text).rlike(TIMESTAMP_TITLE))) == (bool(generic), bool(stamp)), text


def test_displays(spark):
    assert [one(spark, D.format_bytes(F.lit(n).cast("bigint"))) for n in (0, 1023, 1024, 1536, 5 * 1024 ** 3)] == ["0 B", "1023 B", "1 KB", "1.5 KB", "5 GB"]
    assert [one(spark, D.length_display(F.lit(s))) for s in (0.0, 59.5, 3661.0)] == ["", "1:00", "1:01:01"]
    assert [one(spark, D.describe_seconds(F.lit(s))) for s in (1.0, 59.0, 63.0, 3700.0)] == ["1 second", "59 seconds", "1:03", "1:01:40"]


def planned(spark, **values):
    base = {"id": "1", "ord": 1, "file_name": "pilot.MKV", "extension": ".MKV", "full_path": "/in/pilot.MKV", "parsed_title": "The Show", "confirmed_title": "", "season": 1, "episode": 2,
            "episode_end": None, "year": 1999, "kind": "Video", "quality": 1080, "secondary_title": "Pilot", "category": "TvShow"} | values
    ddl = ("id string, ord int, file_name string, extension string, full_path string, parsed_title string, confirmed_title string, season int, episode int, episode_end int, year int, "
           "kind string, quality int, secondary_title string, category string")
    return spark.createDataFrame([tuple(base.values())], ddl)


@pytest.mark.parametrize("values,library,expected", [
    ({}, P.Library((P.Category("TvShow", "/tv/"),)), "/tv/T/The Show/Season 01/02 - pilot.MKV"),
    ({}, P.Library((P.Category("TvShow", "/tv", letter_folders=False),), articles_last=True), "/tv/Show (The)/Season 01/02 - pilot.MKV"),
    ({}, P.Library((P.Category("TvShow", "/tv", template="{title} - {season:00}x{episode:00} - {secondarytitle} ({nothing})"),)), "/tv/T/The Show/Season 01/The Show - 01x02 - Pilot ({nothing}).mkv"),
    ({"category": "Movie"}, P.Library((P.Category("Movie", "/f"),)), "/f/T/The Show (1999)/pilot.MKV"),
    ({"category": "Movie", "year": None}, P.Library((P.Category("Movie", "/f", template="{title} ({year})"),)), "/f/T/The Show/The Show.mkv"),
    ({"category": "TvExtra", "season": 0}, P.Library((P.Category("TvShow", "/tv"),)), "/tv/T/The Show/Extras/pilot.MKV"),
    ({"category": "Other"}, P.Library((P.Category("TvShow", "/tv"),)), None),
])
def test_plans(spark, values, library, expected):
    assert P.plan_paths(planned(spark, **values), library).first().planned_path == expected


def test_unique_names(spark):
    wanted = spark.createDataFrame([(str(i), i, "/d/a.mkv") for i in range(4)] + [("x", 9, "/d/b.mkv")], "id string, ord int, planned_path string")
    existing = spark.createDataFrame([("/D/a.mkv",), ("/d/a (2).mkv",), ("/d/a (7).mkv",)], "full_path string")
    got = {r.id: r.final_path for r in P.unique_names(wanted, existing).collect()}
    assert got == {"0": "/d/a (1).mkv", "1": "/d/a (3).mkv", "2": "/d/a (4).mkv", "3": "/d/a (5).mkv", "x": "/d/b.mkv"}


def test_unique_names_where_families_meet(spark):
    """A numbered name that another file wants, or that exists, is never handed out."""
    wanted = spark.createDataFrame([("1", 1, "/x/a.mkv"), ("2", 2, "/x/a.mkv"), ("3", 3, "/x/a (1).mkv"), ("4", 4, "/x/A (1).mkv"), ("5", 5, "/x/b (1999).mkv"), ("6", 6, "/x/b (1999).mkv"), ("7", 7, "/x/a.mkv"), ("8", 8, None)], "id string, ord int, planned_path string")
    existing = spark.createDataFrame([("/x/a (3).mkv",), ("/X/c.mkv",)], "full_path string")
    got = {r.id: r.final_path for r in P.unique_names(wanted, existing).collect()}
    assert got == {"1": "/x/a.mkv", "2": "/x/a (2).mkv", "3": "/x/a (1).mkv", "4": "/x/A (1) (1).mkv", "5": "/x/b (1999).mkv", "6": "/x/b (1999) (1).mkv", "7": "/x/a (4).mkv"}


@pytest.mark.parametrize("limit", [None, 3])
def test_unique_names_are_unique(spark, limit):
    import random

    if limit:
        spark.conf.set("spark.shelfsift.hotRows", limit)
    rng = random.Random(6)
    name = lambda: "/d/" + rng.choice("ab") + rng.choice(["", " (1)", " (2)", " (1) (1)", " (12)"]) + rng.choice([".mkv", ""])
    wanted = spark.createDataFrame([(str(i), rng.randrange(40), name()) for i in range(120)], "id string, ord int, planned_path string")
    taken = {name() for _ in range(12)}
    paths = [r.final_path.lower() for r in P.unique_names(wanted, spark.createDataFrame([(t,) for t in taken], "full_path string")).collect()]
    spark.conf.unset("spark.shelfsift.hotRows")
    assert len(paths) == 120 == len(set(paths)) and not set(paths) & {t.lower() for t in taken}


def test_leftover_examples_send_few_names_to_a_top_folder(spark):
    """every folder's names met its ancestors, also the top ones, in one task."""
    from shelfsift.operators.folders import leftover_examples, leftover_folders

    names = [(f"f{d:03d}{k}", f"/top/d{d:03d}/n{k}.mkv", 1, False) for d in range(60) for k in range(8)]
    listing = spark.createDataFrame(names, "id string, full_path string, size_bytes bigint, unfinished boolean").repartition(4)
    limits = spark.createDataFrame([("/top", 1000), ("/top/d007", 100), ("/top/d008", 3), ("/top/none", 5)], "folder string, threshold bigint")
    left = leftover_folders(listing, limits, spark.createDataFrame([], "path string"))
    assert sorted((r.folder, r.bytes, r.files) for r in left.collect()) == [("/TOP", 480, 480), ("/TOP/D007", 8, 8), ("/TOP/NONE", 0, 0)]
    shown = leftover_examples(listing, left)
    expected = [("/TOP", k + 1, f"n{k}.mkv") for k in range(6)] + [("/TOP/D007", k + 1, f"n{k}.mkv") for k in range(6)]
    assert sorted(map(tuple, shown.collect())) == expected
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_write_catalog_sorts_no_rows_by_kind(spark, tmp_path):
    """rows of all columns were sorted by kind, and spilled, before they were written."""
    from shelfsift.schemas import FILES
    from shelfsift.sources import catalogue as C

    rows = spark.range(40).select(*[
        (F.concat(F.lit("K"), (F.col("id") % 11).cast("string")) if f.name == "kind" else F.col("id").cast("string") if f.name == "id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in FILES
    ]).repartition(2, "id")
    before = spark.conf.get(C.OPEN_FILES_CONF)
    C.write_catalog(rows, str(tmp_path / "held"))
    assert spark.conf.get(C.OPEN_FILES_CONF) == before
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    written = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and f"{tmp_path}/held/v-" in p]
    assert written and not any("Sort" in p for p in written)
    held = C.read_stored(spark, str(tmp_path / "held")).select("id", "kind").collect()
    assert sorted((int(r.id), r.kind) for r in held) == [(i, f"K{i % 11}") for i in range(40)]
