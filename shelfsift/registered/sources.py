"""Source queries: probe output, reported fields, documents, the compact extract, round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import titles as T
from ..session import ensure_checkpoint_dir
from ..sources import catalogue as C
from ..sources import fields as S
from ..sources import listing as L
from ..sources import titles as X
from ..testtables import files, guide, table
from .common import register
from .titles import RAW_EPISODES, TITLES, titles


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_KBPS = "CAST(round_even(CASE WHEN ord % 3 = 0 THEN 0 ELSE ord % 900 * 1000 END / 1000.0, 0) AS INT)"


@register(
    "integrity_from_probe",
    f"""WITH p AS (SELECT *, ord % 4 <> 0 AS probed, CASE WHEN ord % 5 = 0 THEN 0.0 ELSE ord % 5000 + 0.5 END AS sec, CASE WHEN ord % 2 = 0 THEN 720 ELSE 0 END AS height, {_KBPS} AS kbps FROM files),
    q AS (SELECT *, CASE WHEN kind = 'Audio' THEN kbps WHEN height > 0 THEN height ELSE kbps END AS q FROM p)
    SELECT id, CAST(CASE WHEN probed AND sec > 0 THEN sec ELSE duration_seconds END AS DOUBLE) AS duration_seconds, CASE WHEN probed THEN CASE WHEN sec > 0 THEN 'Ok' ELSE 'Corrupt' END ELSE integrity END AS integrity,
           CASE WHEN probed AND q > 0 THEN q ELSE quality END AS quality FROM q""",
)
def _(spark, sf):
    rows = files(spark, sf)
    seconds = F.when(F.col("ord") % 5 == 0, "0").otherwise(F.concat((F.col("ord") % 5000).cast("string"), F.lit(".5")))
    json = F.concat(
        F.lit('{"format": {"duration": "'), F.when(F.col("ord") % 7 == 0, "").otherwise(seconds),
        F.lit('"}, "streams": [{"codec_type": "Video", "height": '), F.when(F.col("ord") % 2 == 0, "720").otherwise("0"),
        F.lit(', "duration": "'), seconds, F.lit('"}, {"codec_type": "audio", "bit_rate": "'),
        F.when(F.col("ord") % 3 == 0, "none").otherwise((F.col("ord") % 900 * 1000).cast("string")), F.lit('"}]}'),
    )
    probes = rows.filter("ord % 4 <> 0").select("id", json.alias("probe_json"))
    return S.integrity_from_probe(rows, probes).select("id", "duration_seconds", "integrity", "quality")


@register(
    "plugin_field_parse",
    """SELECT doc_id, concat('L', lang) AS book_language, CAST(n_chars AS VARCHAR) AS pages, CASE WHEN doc_id % 2 = 0 THEN concat('a & <', source, '>') ELSE source END AS source FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    xml = F.concat(
        F.lit('<file><field name="book_language" value="L'), "lang", F.lit('"/>\n <number_of_pages> '), F.col("n_chars").cast("string"),
        F.lit(' </number_of_pages><attribute key="3 source" text="'), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a &amp; &lt;"), "source", F.lit("&gt;"))).otherwise(F.col("source")),
        F.lit('"></attribute><field name="!!!" value="x"/><field name="book language" value="later"/></file>'),
    )
    parsed = docs.select("doc_id", S.plugin_field_parse(xml).alias("m"))
    return parsed.select("doc_id", F.col("m.booklanguage").alias("book_language"), F.col("m.numberofpages").alias("pages"), F.col("m.source").alias("source"))


@register(
    "read_document_fields",
    """SELECT doc_id, doc_id % 7 = 2 AND doc_id % 3 = 0 AS failed, CASE WHEN doc_id % 7 = 2 AND doc_id % 3 = 0 THEN concat('Book ', lang, ' - Part') WHEN doc_id % 3 = 0 THEN concat('Inner ', doc_id) WHEN doc_id % 3 = 1 THEN concat('Book ', lang, ' - Part') ELSE concat('Plain ', lang) END AS book,
       CASE WHEN doc_id % 3 = 2 THEN NULL ELSE concat('Writer ', source) END AS author, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE CAST(1900 + doc_id % 100 AS VARCHAR) END AS year FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    year = (F.lit(1900) + F.col("doc_id") % 100).cast("string")
    named = F.concat(F.lit("/books/Writer "), "source", F.lit(" - Book "), "lang", F.lit(" - Part ("), year, F.lit(")"))
    path = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("/books/Plain_"), "lang", F.lit(".djvu"))).otherwise(F.concat(named, F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(".mobi")))
    # Some books say they are EPUB packages and are none: their reader fails, and their names still count.
    path = F.when((F.col("doc_id") % 7 == 2) & (F.col("doc_id") % 3 == 0), F.concat(named, F.lit(".epub"))).otherwise(path)
    content = F.concat(F.lit("%PDF /Title (Inner "), F.col("doc_id").cast("string"), F.lit(") /Type /Page "), F.col("text")).cast("binary")
    rows = docs.select(F.concat(F.col("doc_id").cast("string"), path).alias("full_path"), content.alias("content"))
    read = S.read_document_fields(rows)
    return read.select(
        F.regexp_extract("full_path", r"^(\d+)", 1).cast("bigint").alias("doc_id"), F.col("plugin_fields.bookname").alias("book"),
        F.col("plugin_fields.author").alias("author"), F.col("plugin_fields.yearpublished").alias("year"), F.col("failure").isNotNull().alias("failed"),
    )


@register(
    "read_page_fields",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
       regexp_extract(html, '(?is)<html[^>]*\slang\s*=\s*"([^"]*)"', 1) AS language, CAST(len(regexp_extract_all(html, '(?i)(<a\s)')) AS INT) AS links FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.html_fields("html").alias("f")).select("page_id", "f.*")


@register(
    "register_field_source",
    "SELECT doc_id, CAST(length(text) AS VARCHAR) AS letters FROM documents WHERE doc_id % 2 = 0",
)
def _(spark, sf):
    counts = S.FieldSource("letters", ("txt", "*.TXT"), {"Letters": "number"}, lambda path, content: {"letters": str(len(content.decode())), "secret": "x"})
    late = S.FieldSource("late", (".txt",), {"Letters": "text"}, lambda path, content: {"letters": "late"})
    docs = table(spark, sf, "documents")
    rows = docs.select(F.concat(F.lit("/d/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".bin")).alias("full_path"), F.col("text").cast("binary").alias("content"))
    read = S.read_fields(rows, [counts, late]).filter(F.size("plugin_fields") > 0)
    return read.select(F.regexp_extract("full_path", r"(\d+)", 1).cast("bigint").alias("doc_id"), F.col("plugin_fields.letters").alias("letters"))


@register(
    "read_title_extract",
    f"""WITH {TITLES} SELECT CASE WHEN pos % 5 = 0 THEN 0 ELSE id END AS id, CASE WHEN pos % 5 = 0 THEN -1 ELSE 3 END AS type_code, title, start_year, CASE WHEN pos % 5 <> 0 THEN end_year END AS end_year FROM titles""",
    "title_rows",
)
def _(spark, sf):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.when(F.col("pos") % 5 == 0, F.concat_ws("\t", "title", text("start_year"))).otherwise(
        F.concat_ws("\t", text("id"), F.lit("3"), "title", text("start_year"), text("end_year"), F.lit("1,x,2"))
    )
    lines = titles(spark, sf).select(F.explode(F.array(F.lit("#marker"), line, F.lit(""))).alias("value"), "pos")
    return X.parse_title_lines(lines).select("id", "type_code", "title", "start_year", "end_year")


@register("write_title_extract", f"WITH {TITLES} SELECT id, type, title, start_year FROM titles", "title_rows")
def _(spark, sf):
    folder, rows = _folder(spark, "extract"), titles(spark, sf)
    episodes = guide(spark, sf)
    X.write_title_extract(rows, episodes, T.title_codes(rows), folder)
    return X.read_title_extract(spark, folder)[0].select("id", "type", "title", "start_year")


def _write_with_headers(rows, header, folder, parts=8):
    """Lines in several files, as a large dataset is kept: each file has its header, then its lines in order."""
    numbered = rows.withColumn("_part", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int"))
    headers = rows.sparkSession.range(parts).select(F.lit(header).alias("value"), F.lit(-1).cast("bigint").alias("at"), F.col("id").cast("int").alias("_part"))
    lines = numbered.select("value", "at", "_part").unionByName(headers)
    lines.repartition(parts, "_part").sortWithinPartitions("_part", "at").select("value", "_part").write.partitionBy("_part").text(folder)


@register(
    "read_title_basics",
    "SELECT tconst, title_type, primary_title, CASE WHEN start_year > 1800 THEN start_year END AS start_year, genres FROM title_rows WHERE pos % 9 <> 4",
    "title_rows",
)
def _(spark, sf):
    from ..testtables import title_rows

    folder = _folder(spark, "basics")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\\N"))
    whole = F.concat_ws("\t", "tconst", text("title_type"), "primary_title", F.lit("o"), F.lit("0"), text("start_year"), text("end_year"), F.lit("30"), text("genres"))
    rows = title_rows(spark, sf).select(F.when(F.col("pos") % 9 == 4, "short\tline").otherwise(whole).alias("value"), (F.col("pos") + 1).alias("at"))
    _write_with_headers(rows, "tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres", folder)
    return X.read_title_basics(spark, folder).select("tconst", "title_type", "primary_title", "start_year", "genres")


@register(
    "read_title_episodes",
    f"WITH {RAW_EPISODES.format(part='part')} SELECT tconst, parent_tconst, season, episode FROM raw_episodes",
)
def _(spark, sf):
    folder = _folder(spark, "episodes")
    raw = spark.sql("WITH " + RAW_EPISODES.format(part=f"parquet.`{sf}/part.parquet`").replace("'\\N'", "'\\\\N'") + " SELECT * FROM raw_episodes")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\\N"))
    rows = raw.select(F.concat_ws("\t", text("season"), "tconst", "parent_tconst", text("episode")).alias("value"), (F.col("pos") + 1).alias("at"))
    _write_with_headers(rows, "seasonNumber\tTCONST\tparentTconst\tepisodeNumber", folder)
    return X.read_title_episodes(spark, folder).drop("pos")


@register("write_catalog", "SELECT id, kind, full_path, size_bytes FROM files")
def _(spark, sf):
    folder = _folder(spark, "catalogue")
    C.write_catalog(files(spark, sf), folder)
    return C.read_stored(spark, folder).select("id", "kind", "full_path", "size_bytes")


@register("scan_checkpoint", "SELECT full_path, size_bytes FROM files WHERE full_path NOT IN (SELECT full_path FROM files WHERE sha256 <> '')")
def _(spark, sf):
    listing, done = _folder(spark, "listing"), _folder(spark, "done")
    rows = files(spark, sf)
    rows.select("full_path", "size_bytes").write.parquet(listing)
    rows.filter("sha256 <> ''").select("full_path").write.mode("append").parquet(done)
    return L.scan_remaining(spark, listing, done)


@register("read_catalog", "SELECT id, full_path, size_bytes, kind, year, season, title_manual, quality, duration_seconds, last_modified_utc, parsed_title FROM files")
def _(spark, sf):
    folder = _folder(spark, "xml")
    rows = files(spark, sf).withColumn("last_modified_utc", F.date_format(F.col("last_modified_utc").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"))
    held = [F.col(c).alias(x) for c, x in C.XML_NAMES.items() if c in rows.columns]
    # Compressed, in files of bounded size, since a compressed one is read by one task.
    rows.select(*held).write.format("xml").option("compression", "gzip").option("maxRecordsPerFile", 250_000).option("rootTag", "Catalog").option("rowTag", "File").save(folder)
    return C.read_catalog(spark, folder).select(
        "id", "full_path", "size_bytes", "kind", "year", "season", "title_manual", "quality", "duration_seconds", "last_modified_utc", "parsed_title"
    )
