"""Names and folders: what each says about season, episode, year, title and category."""

from pyspark.sql import functions as F

from shelfsift.functions.paths import base_name, extension_of
from shelfsift.operators.classify import classify_files, detect_extra

NUMBERED = [
    (r"D:\x\Home Improvement 5-26 Games Flames And Automobiles.avi", 5, 26, None),
    (r"D:\x\The Dead Zone - 01 01 - Wheel Of Fortune.mkv", 1, 1, None),
    (r"D:\x\Show S01E02 Thing.mkv", 1, 2, None),
    (r"D:\x\Show 1x02 Thing.mkv", 1, 2, None),
    (r"D:\x\Sabrina, The Teenage Witch [01-01] Pilot [Dvdrip SAiNTS].avi", 1, 1, None),
    (r"D:\x\Some Show (02-14) Title.mkv", 2, 14, None),
    (r"D:\x\bull.2016.101.hdtv-lol[ettv].mkv", 1, 1, None),
    (r"D:\x\some.show.2012.1102.hdtv-lol.mkv", 11, 2, None),
    ("D:\\x\\Dexter (s8 – ep 3) Whats Eating Dexter Morgan.FLV", 8, 3, None),
    ("D:\\x\\Dexter (s8 \ufffd ep 3) Whats Eating Dexter Morgan.FLV", 8, 3, None),
    (r"D:\x\Show S06E11E12 Thing.mkv", 6, 11, 12),
    (r"D:\TV\K\King Of The Hill\Season 04\1.avi", 4, 1, None),
    (r"D:\TV\Yes Minister, Season Three\01. Equal Opportunities.mkv", 3, 1, None),
    (r"D:\x\Blade.Runner.2049.2017.1080p.BluRay.x264.mkv", None, None, None),
    (r"D:\x\The Matrix 1999.mkv", None, None, None),
    (r"D:\x\Some Film (2009-2012 remaster).mkv", None, None, None),
    (r"D:\x\Show Season Two Part Twenty One.mkv", 2, 21, None),
    (r"D:\TV\Show\Season 2\E07E08 Two.mkv", 2, 7, 8),
    (r"D:\x\show.1102.x264.mkv", 11, 2, None),
    (r"D:\x\show.100.mkv", None, None, None),
]


def table(spark, paths):
    rows = spark.createDataFrame([(str(i), p) for i, p in enumerate(paths)], "id string, full_path string")
    none = F.lit(None).cast("int")
    return rows.withColumns({
        "file_name": base_name("full_path"), "extension": extension_of(base_name("full_path")), "kind": F.lit("Unknown"),
        "video_category": F.lit("Unknown"), "season": none, "episode": none, "episode_end": none, "year": none,
        "parsed_title": F.lit(""), "numbering_manual": F.lit(False),
    })


def test_numbering(spark):
    rows = classify_files(table(spark, [c[0] for c in NUMBERED]), 2026).select("id", "season", "episode", "episode_end").collect()
    got = {int(r[0]): tuple(r[1:]) for r in rows}
    wrong = {NUMBERED[i][0]: (v, NUMBERED[i][1:]) for i, v in got.items() if v != NUMBERED[i][1:]}
    assert not wrong


def test_titles_years_and_categories(spark):
    cases = [
        (r"D:\x\Blade.Runner.2049.2017.1080p.BluRay.x264.mkv", "Blade Runner 2049", 2017, "Movie"),
        (r"D:\x\bull.2016.101.hdtv-lol[ettv].mkv", "Bull", 2016, "TvShow"),
        (r"D:\TV\Yes Minister, Season Three\01. Equal Opportunities.mkv", "Yes Minister", None, "TvShow"),
        (r"D:\TV\K\King Of The Hill\Season 04\1.avi", "King Of The Hill", None, "TvShow"),
        (r"D:\Films\heat (1995)\heat-trailer.mkv", "Heat Trailer", None, "MovieExtra"),
        (r"D:\TV\Show\Season 1\Extras\gag reel.mkv", "Gag Reel", None, "TvExtra"),
        (r"D:\music\mcDonald - song one.mp3", "McDonald Song One", None, "Unknown"),
        (r"D:\x\the.thing.1982.720p.web-dl.mkv", "The Thing", 1982, "Movie"),
    ]
    rows = classify_files(table(spark, [c[0] for c in cases]), 2026).select("id", "parsed_title", "year", "video_category").collect()
    got = {int(r[0]): tuple(r[1:]) for r in rows}
    wrong = {cases[i][0]: (v, cases[i][1:]) for i, v in got.items() if v != cases[i][1:]}
    assert not wrong


def test_hand_typed_numbering_stays(spark):
    rows = table(spark, [r"D:\x\Show S01E02 Thing.mkv"]).withColumns({"numbering_manual": F.lit(True), "season": F.lit(9), "episode": F.lit(8)})
    assert tuple(classify_files(rows, 2026).select("season", "episode", "episode_end").first()) == (9, 8, None)


def test_detect_extra(spark):
    rows = table(spark, [r"D:\Films\Heat\Heat-featurette.mkv", r"D:\TV\Show\Specials\One.mkv", r"D:\Films\Heat\Heat.mkv", r"D:\TV\Show\Season 0\One.mkv"])
    got = [r[0] for r in detect_extra(rows).orderBy(F.col("id").cast("int")).select("extra_category").collect()]
    assert got == ["MovieExtra", "MovieExtra", None, "TvExtra"]


def test_years_to_come(spark):
    paths = [r"D:\x\Blue Ring 2063 S01E02 480p.mkv", r"D:\x\Blue Ring 2063 1983 720p.mkv", r"D:\x\Blue Ring 2027 S01E02.mkv", r"D:\x\Blue Ring 2063.mkv"]
    read = lambda **how: [tuple(r) for r in classify_files(table(spark, paths), 2026, **how).orderBy("id").select("year", "parsed_title").collect()]
    titles = ["Blue Ring 2063", "Blue Ring 2063", "Blue Ring 2027", "Blue Ring"]
    assert read(future_years=False) == list(zip([None, 1983, 2027, None], titles))
    assert read() == list(zip([2063, 1983, 2027, 2063], titles))
