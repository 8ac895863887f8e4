"""Files on disk and streams in several batches."""

import gzip
import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from shelfsift.operators.filters import Exclusion
from shelfsift.sources import catalogue as C
from shelfsift.sources import fields as S
from shelfsift.sources import listing as L
from shelfsift.sources import titles as X
from shelfsift.streaming.watch import _batches, _whole_packs, new_file_notices, notice_text, open_bursts, read_watched, run_to_table, settled_files, use_state_store, watch_new_files

XML = """<?xml version="1.0"?><Catalog><Version>1</Version><Files>
<File><Id>a</Id><FullPath>C:\\x\\a.epub</FullPath><Kind>Other</Kind><SizeBytes>7</SizeBytes><Year>1999</Year>
<PluginFields><Field><Name>Pages</Name><Value>12</Value></Field><Field><Name>Author</Name><Value>A</Value></Field></PluginFields></File>
<File><Id>b</Id><FullPath>C:\\x\\b.epub</FullPath><PluginFields><Field><Name>Pages</Name><Value>3</Value></Field></PluginFields></File>
<File><Id>c</Id><FullPath>C:\\x\\c.mkv</FullPath><LastModifiedUtc>2024-05-01T10:00:00</LastModifiedUtc><PluginFields/></File>
</Files></Catalog>"""


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-"))


def test_catalogue_xml(spark):
    path = folder() / "catalog.xml"
    path.write_text(XML)
    rows = C.read_catalog(spark, str(path)).orderBy("ord").collect()
    assert [r.id for r in rows] == ["a", "b", "c"]
    assert [r.plugin_fields for r in rows] == [{"pages": "12", "author": "A"}, {"pages": "3"}, {}]
    assert (rows[0].year, rows[1].year, rows[1].size_bytes, rows[1].sha256, str(rows[2].last_modified_utc)) == (1999, None, 0, "", "2024-05-01 10:00:00")
    assert C.read_catalog(spark, str(folder() / "none.xml")).count() == 0


def test_stored_versions(spark):
    where = str(folder() / "store")
    assert C.read_stored(spark, where).count() == 0
    empty = C.empty_catalogue(spark)
    C.write_catalog(empty.unionByName(spark.createDataFrame([("1", "Video")], "id string, kind string"), allowMissingColumns=True), where)
    C.write_catalog(empty.unionByName(spark.createDataFrame([("2", "Audio")], "id string, kind string"), allowMissingColumns=True), where)
    assert [r.id for r in C.read_stored(spark, where).collect()] == ["2"]


def test_list_and_hash(spark):
    root = folder()
    for name, text in (("a b+c.mkv", "one"), ("deep/d.MP3", "two"), ("deep/e.part", "x"), ("skip/f.mkv", "three"), ("g.txt", "no"), ("h.mkv", "")):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    listed = L.list_files(spark, [str(root)], [Exclusion(str(root / "skip"))])
    assert sorted(r.file_name for r in listed.collect()) == ["a b+c.mkv", "d.MP3", "e.part", "h.mkv"]
    rows = listed.withColumns({"sha256": F.lit(""), "hash_failed": F.lit(False)})
    lost = rows.filter("file_name = 'd.MP3'").withColumn("full_path", F.concat("full_path", F.lit("gone.mp3")))
    got = {r.file_name + ("!" if "gone" in r.full_path else ""): (r.sha256, r.hash_failed) for r in L.hash_files(rows.unionByName(lost)).collect()}
    one, two = (hashlib.sha256(t).hexdigest() for t in (b"one", b"two"))
    assert got == {"a b+c.mkv": (one, False), "d.MP3": (two, False), "e.part": ("", False), "h.mkv": ("", False), "d.MP3!": ("", True)}
    # A path with a scheme goes through the same calls and sees empty files too.
    by_scheme = L.list_files(spark, [f"file://{root}"], [Exclusion(f"file://{root}/skip")])
    assert sorted(r.file_name for r in by_scheme.collect()) == ["a b+c.mkv", "d.MP3", "e.part", "h.mkv"]
    plain = by_scheme.filter("file_name = 'd.MP3'").withColumns({"sha256": F.lit(""), "hash_failed": F.lit(False)})
    assert L.hash_files(plain).first().sha256 == two
    # Files that have a hash are not opened: this one is not there.
    known = lost.withColumn("sha256", F.lit("ab"))
    assert L.hash_files(known).select("sha256", "hash_failed").first() == ("ab", False)


def test_gzip_titles(spark):
    path = folder() / "title.basics.tsv.gz"
    lines = ["tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres",
             'tt1\tmovie\t"Quoted\t"Quoted\t0\t1999\t\\N\t1\tDrama,Crime', "tt2\ttvSeries\tShow\tShow\t0\t\\N\t\\N\t1\t\\N", "short\tline", "tt3\t\\N\tX\tX\t0\t1500\t\\N\t1\t\\N"]
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    got = [tuple(r) for r in X.read_title_basics(spark, str(path)).orderBy("pos").select("tconst", "title_type", "primary_title", "start_year", "genres").collect()]
    assert got == [("tt1", "movie", '"Quoted', 1999, "Drama,Crime"), ("tt2", "tvSeries", "Show", None, None), ("tt3", None, "X", None, None)]


def test_epub_and_claims(spark):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o.opf"/></rootfiles></container>')
        z.writestr("o.opf", '<package xmlns:dc="d"><metadata><dc:title>Inside</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:date>1984-01-01</dc:date></metadata><spine><itemref/><itemref/></spine></package>')
    rows = spark.createDataFrame([("/b/Someone - Named (2001).epub", bytearray(book.getvalue())), ("/b/Someone_Else - My Book.mobi", bytearray(b"")), ("/b/broken.epub", bytearray(b"zzz"))], "full_path string, content binary")
    got = {r.full_path[3:7]: r.plugin_fields for r in S.read_document_fields(rows).collect()}
    assert got["Some"] in ({"bookname": "Inside", "author": "A, B", "yearpublished": "1984", "chapters": "2"}, {"bookname": "My Book", "author": "Someone Else"})
    assert got["brok"] == {"bookname": "broken"}
    sources = [S.FieldSource("one", ("epub", ".pdf"), {"Pages": "number", "size": "number"}, dict), S.FieldSource("two", ("*.EPUB",), {"pages": "text", "Ink": "text"}, dict)]
    assert {(r.extension, r.source, r.clash) for r in S.claims(spark, sources).collect()} == {(".epub", "one", False), (".pdf", "one", False), (".epub", "two", True)}
    assert S.field_registry(sources) == {"Pages": "number", "Ink": "text"}


# A stream's time starts at 1970, and what is not after that counts as late.
DAY = 86_400


def batches(spark, where, schema, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).selectExpr("event_id", f"timestamp_seconds(at + {DAY}) AS ts", "full_path", "size_bytes").coalesce(1).write.mode("append").parquet(where)
        yield i


STREAM = "event_id bigint, ts timestamp, full_path string, size_bytes bigint"
WRITTEN = "event_id bigint, at bigint, full_path string, size_bytes bigint"


def _held_keys(spark, checkpoint, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).count()


def test_settling_over_batches(spark):
    base, where = folder(), str(folder() / "in")
    parts = (
        [(1, 0, "a", 5), (2, 5, "a", 5), (3, 0, "b", 0), (4, 0, "c", 9)],
        [(5, 10, "a", 5), (6, 5, "b", 0), (7, 10, "b", 0), (8, 1900, "c", 9), (9, 1905, "c", 9), (10, 1910, "c", 9)],
    )
    for _ in batches(spark, where, WRITTEN, *parts):
        stream = spark.readStream.schema(STREAM).parquet(where)
        out = run_to_table(settled_files(stream, "60 minutes"), str(base / "out"), str(base / "state"))
    assert sorted((r.full_path, r.outcome, r.at_us // 1_000_000 - DAY) for r in out.collect()) == [("a", "settled", 10), ("c", "given up", 1800), ("c", "settled", 1910)]


def test_a_path_without_later_polls_is_given_up_and_no_state_stays(spark):
    """b never settles and z moves the stream's time on; a settles twice, the second watch being a new one."""
    base, where = folder(), str(folder() / "in")
    parts = (
        [(1, 0, "a", 5), (2, 5, "a", 5), (3, 10, "a", 5), (4, 3, "b", 1)],
        [(5, 100, "a", 6), (6, 105, "a", 6)],
        [(7, 110, "a", 6), (8, 4000, "z", 2), (9, 4005, "z", 2), (10, 4010, "z", 2)],
    )
    for _ in batches(spark, where, WRITTEN, *parts):
        stream = spark.readStream.schema(STREAM).parquet(where)
        out = run_to_table(settled_files(stream, "10 minutes"), str(base / "out"), str(base / "state"))
    got = sorted((r.full_path, r.outcome, r.size_bytes, r.at_us // 1_000_000 - DAY) for r in out.collect())
    assert got == [("a", "settled", 5, 10), ("a", "settled", 6, 110), ("b", "given up", None, 1803), ("z", "settled", 2, 4010)]
    assert _held_keys(spark, str(base / "state"), "watch") == 0


def _notices(spark, where, base, seconds, *parts):
    for _ in batches(spark, where, WRITTEN, *parts):
        stream = spark.readStream.schema(STREAM).parquet(where)
        arrivals = stream.select("event_id", "ts", F.lit("w").alias("watcher"), F.col("full_path").alias("file_name"))
        out = run_to_table(new_file_notices(arrivals, seconds), str(base / "out"), str(base / "state"))
    both = out.unionByName(open_bursts(spark, str(base / "state"))).withColumn("message", notice_text())
    return [sorted((r.opened_us // 1_000_000 - DAY, r.files, r.message) for r in rows.collect()) for rows in (out.withColumn("message", notice_text()), both)]


def test_notices_are_not_extended_and_the_last_one_is_not_lost(spark):
    base, where = folder(), str(folder() / "in")
    closed, both = _notices(spark, where, base, 20, [(1, 100, "a", 1), (2, 115, "b", 1)], [(3, 119, "c", 1), (4, 121, "d", 1), (5, 900, "e", 1)])
    assert closed == [(100, 3, "Added 3 new files, starting with a."), (121, 1, "Added new file: d")]
    assert both == [*closed, (900, 1, "Added new file: e")]


def test_a_long_burst_waits_for_late_arrivals(spark):
    """With bursts of 200 seconds an arrival may come 200 seconds late and still count."""
    base, where = folder(), str(folder() / "in")
    _, both = _notices(spark, where, base, 200, [(1, 100, "a", 1), (2, 290, "c", 1)], [(3, 150, "b", 1), (4, 301, "d", 1)])
    assert both == [(100, 3, "Added 3 new files, starting with a."), (301, 1, "Added new file: d")]


def test_watch_admits_each_path_once(spark):
    base, where = folder(), str(folder() / "in")
    store, state = str(base / "store"), str(base / "state")
    known = spark.createDataFrame([("/i/old.mkv",)], "full_path string")
    use_state_store(spark)
    parts = (
        [(1, 1, "/i/OLD.mkv", 1), (2, 2, "/i/new.mkv", 4), (3, 3, "/i/new.mkv", 6), (4, 3, "/i/x.txt", 6)],
        [(5, 9, "/i/NEW.mkv", 8), (6, 9, "/i/b.mp3", 0), (7, 9, "/i/c.mp3", 2)],
        [(8, 20, "/i/d.mp3", 3), (9, 19, "/i/d.mp3", 2)],
    )
    for _ in batches(spark, where, WRITTEN, *parts):
        stream = spark.readStream.schema(STREAM).parquet(where)
        query = watch_new_files(stream, known, store, state, pack_every=2).trigger(availableNow=True).start()
        query.awaitTermination()
    held = read_watched(spark, store)
    assert sorted((r.full_path, r.size_bytes, r.awaiting_download) for r in held.collect()) == [("/i/c.mp3", 2, True), ("/i/d.mp3", 2, True), ("/i/new.mkv", 4, True)]
    # Two batches lie in one pack; the third waits for the next one.
    assert [p[:2] for p in _whole_packs(spark, store)] == [(0, 1)] and [b for b, _ in _batches(spark, store)][-1] == 2
    assert read_watched(spark, str(base / "nothing")).count() == 0


def test_a_batch_that_runs_again_repeats_nothing(spark):
    """The last commit is taken back, as after a crash between writing and committing."""
    base, where = folder(), str(folder() / "in")
    store, state = str(base / "store"), base / "state"
    known = spark.createDataFrame([], "full_path string")
    use_state_store(spark)

    def run():
        watch_new_files(spark.readStream.schema(STREAM).parquet(where), known, store, str(state), pack_every=2).trigger(availableNow=True).start().awaitTermination()

    for _ in batches(spark, where, WRITTEN, [(1, 1, "/i/a.mkv", 1)], [(2, 2, "/i/b.mkv", 4), (3, 3, "/i/a.mkv", 6)]):
        run()
    before = sorted(map(tuple, read_watched(spark, store).collect()))
    for name in ("1", ".1.crc"):
        (state / "commits" / name).unlink(missing_ok=True)
    run()
    assert sorted(map(tuple, read_watched(spark, store).collect())) == before and len(before) == 2
