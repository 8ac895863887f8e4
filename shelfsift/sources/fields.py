"""Per-file fields: probe output, user-supplied readers, documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, col, stem_of
from ..functions.text import identifier
from ..operators.skew import first_by

# --- probe output ----------------------------------------------------------------------------------

PROBE = (
    "format struct<duration string, bit_rate string>, "
    "streams array<struct<codec_type string, height string, bit_rate string, duration string>>"
)


def read_probe(json) -> Column:
    """(seconds, height, kbps) out of a probe's JSON."""
    probe = F.from_json(col(json), PROBE)
    number = lambda text: F.coalesce(text.try_cast("double"), F.lit(0.0))
    streams = F.coalesce(probe["streams"], F.array())
    of = lambda kind: F.filter(streams, lambda s: F.lower(s["codec_type"]) == kind)
    own = number(probe["format"]["duration"])
    per_stream = F.get(F.filter(F.transform(streams, lambda s: number(s["duration"])), lambda d: d > 0), 0)
    height = F.coalesce(F.array_max(F.transform(of("video"), lambda s: number(s["height"]).cast("int"))), F.lit(0))
    audio = F.get(F.filter(F.transform(of("audio"), lambda s: number(s["bit_rate"]).cast("bigint")), lambda b: b != 0), 0)
    total = number(probe["format"]["bit_rate"]).cast("bigint")
    bits = F.when(total > 0, total).otherwise(F.coalesce(audio, F.lit(0)))
    seconds = F.when(own > 0, own).otherwise(F.coalesce(per_stream, F.lit(0.0)))
    return F.struct(seconds.alias("seconds"), F.greatest(height, F.lit(0)).alias("height"), F.bround(bits / 1000.0, 0).cast("int").alias("kbps"))


def integrity_from_probe(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Update length, quality and integrity of rows that have a probe (``id``, ``probe_json``)."""
    read = probes.select("id", read_probe("probe_json").alias("_p"))
    joined = files.join(read, "id", "left")
    probed = F.col("_p").isNotNull()
    picture = F.when(F.col("_p.height") > 0, F.col("_p.height")).otherwise(F.col("_p.kbps"))
    quality = F.when(F.col("kind") == "Audio", F.col("_p.kbps")).otherwise(picture)
    return joined.withColumns({
        "duration_seconds": F.when(probed & (F.col("_p.seconds") > 0), F.col("_p.seconds")).otherwise(F.col("duration_seconds")),
        "integrity": F.when(probed, F.when(F.col("_p.seconds") > 0, "Ok").otherwise("Corrupt")).otherwise(F.col("integrity")),
        "quality": F.when(probed & (quality > 0), quality).otherwise(F.col("quality")),
    }).drop("_p")


# --- fields a reader reports as XML ------------------------------------------------------------------

def plugin_field_parse(xml) -> Column:
    """(name, value) XML of a file as a map with lower-cased identifiers; element and attribute forms.

    ``<field name=".." value=".."/>`` and ``<Pages>12</Pages>`` may be mixed; the first value of a name stays.
    """
    text = F.trim(F.coalesce(col(xml), F.lit("")))
    element = r"(?s)<([A-Za-z_][\w.\-]*)((?:\s+[\w.\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?:/>|>([^<]*)</\1\s*>)"
    found = F.regexp_extract_all(text, F.lit(f"({element.replace(chr(92) + '1', chr(92) + '2')})"), F.lit(1))

    def attribute(e: Column, names: str) -> Column:
        return F.nullif(F.regexp_extract(e, rf"(?is)^<[^>]*?\s(?:{names})\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))

    def entry(e: Column) -> Column:
        tag = F.regexp_extract(e, r"^<([A-Za-z_][\w.\-]*)", 1)
        named = F.lower(tag).isin("field", "attribute", "value")
        name = F.when(named, F.coalesce(attribute(e, "name|field|key"), F.lit(""))).otherwise(tag)
        value = F.coalesce(attribute(e, "value|text"), F.regexp_extract(e, r"(?s)>([^<]*)</", 1))
        return F.struct(F.lower(identifier(name)).alias("key"), _unescape(F.trim(value)).alias("value"))

    entries = F.filter(F.transform(found, entry), lambda e: F.length(e["key"]) > 0)
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


# --- user-supplied readers ---------------------------------------------------------------------------

@dataclass(frozen=True)
class FieldSource:
    """A reader of extra fields: the extensions it claims, its typed fields, and a function of (path, content)."""

    name: str
    extensions: tuple[str, ...]
    fields: dict[str, str]
    read: Callable[[str, bytes], dict[str, str]]
    category: str = "Other"


# Names rules already use.
BUILT_IN_PROPERTIES = ("Length", "Quality", "Size", "Modified", "Integrity", "Name", "Path", "Extension", "Filed", "HasFingerprint")


def normal_extension(text: str) -> str:
    bare = text.strip().lstrip("*").lstrip(".").lower()
    return f".{bare}" if bare else ""


def claims(spark: SparkSession, sources: Sequence[FieldSource]) -> DataFrame:
    """(extension, source, owner, clash): the first claimant of an extension owns it."""
    rows = [(normal_extension(e), s.name, i) for i, s in enumerate(sources) for e in s.extensions if normal_extension(e)]
    table = spark.createDataFrame(rows, "extension string, source string, pos int")
    owners = first_by(table, ["extension"], ["pos"]).select("extension", F.col("source").alias("owner"))
    return table.join(owners, "extension").select("extension", "source", "owner", (F.col("source") != F.col("owner")).alias("clash"))


def field_registry(sources: Sequence[FieldSource]) -> dict[str, str]:
    """Accepted field -> type: unique ignoring case, never a built-in name."""
    taken, accepted = {p.lower() for p in BUILT_IN_PROPERTIES}, {}
    for source in sources:
        for name, kind in source.fields.items():
            if name.lower() not in taken:
                taken.add(name.lower())
                accepted[name] = kind
    return accepted


def read_fields(contents: DataFrame, sources: Sequence[FieldSource]) -> DataFrame:
    """(full_path, plugin_fields, failure) from rows of (full_path, content), each file read by the owner of its extension.

    A reader that fails gives no fields, and ``failure`` says what it raised; one bad file does not end the
    job. Undeclared fields are left out.
    """
    owner: dict[str, FieldSource] = {}
    for source in sources:
        for extension in source.extensions:
            owner.setdefault(normal_extension(extension), source)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, failures = [], []
            for path, content in zip(batch["full_path"], batch["content"]):
                source = owner.get("." + path.rsplit(".", 1)[-1].lower())
                found, failure = {}, None
                try:
                    found = source.read(path, content) if source else {}
                except Exception as error:  # noqa: BLE001 - reported in the row
                    failure = f"{type(error).__name__}: {error}"
                failures.append(failure)
                declared = {n.lower() for n in source.fields} if source else set()
                values.append([(k.lower(), v) for k, v in found.items() if k.lower() in declared and v])
            yield pd.DataFrame({"full_path": batch["full_path"], "entries": values, "failure": failures})

    entries = "array<struct<name:string,value:string>>"
    rows = contents.select("full_path", "content").mapInPandas(read, f"full_path string, entries {entries}, failure string")
    return rows.select("full_path", F.map_from_entries("entries").alias("plugin_fields"), "failure")


# --- documents ---------------------------------------------------------------------------------------

# Fields of a document and their types.
DOCUMENT_FIELDS = {"BookName": "text", "Author": "text", "Publisher": "text", "Language": "text", "BookGenre": "text",
                   "YearPublished": "number", "Chapters": "number", "Pages": "number"}
DOCUMENT_EXTENSIONS = (".epub", ".mobi", ".azw", ".azw3", ".fb2", ".djvu", ".pdf")
# Fixed value: years a book may be from.
YEAR = r"\b(1[5-9]\d{2}|20\d{2})\b"

# Name spaces of the EPUB formats, and where a container names its package.
OCF = "{urn:oasis:names:tc:opendocument:xmlns:container}"
OPF = "{http://www.idpf.org/2007/opf}"
DC = "{http://purl.org/dc/elements/1.1/}"
CONTAINER = "META-INF/container.xml"


def _epub(content: bytes) -> dict[str, str]:
    """Dublin Core metadata and the number of spine entries of the first package of a book."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        files = ElementTree.fromstring(book.read(CONTAINER)).findall(f"{OCF}rootfiles/{OCF}rootfile[@full-path]")
        if not files:
            return {}
        wanted = files[0].attrib["full-path"]
        member = wanted if wanted in book.NameToInfo else next(n for n in book.NameToInfo if n.casefold() == wanted.casefold())
        package = ElementTree.fromstring(book.read(member))
    metadata, spine = package.find(f"{OPF}metadata"), package.findall(f"{OPF}spine/{OPF}itemref")
    terms: dict[str, list[str]] = {}
    for element in metadata if metadata is not None else ():
        value = " ".join(" ".join(element.itertext()).split())
        own = terms.setdefault(str(element.tag).removeprefix(DC), [])
        if value and value.casefold() not in map(str.casefold, own):
            own.append(value)
    first = {name: values[0] for name, values in terms.items() if values}
    found = {"BookName": first.get("title"), "Publisher": first.get("publisher"), "Language": first.get("language"),
             "Author": ", ".join(terms.get("creator", [])), "BookGenre": ", ".join(terms.get("subject", []))}
    if dated := re.search(YEAR, first.get("date", "")):
        found["YearPublished"] = dated[1]
    if spine:
        found["Chapters"] = str(len(spine))
    return {name: value for name, value in found.items() if value}


# A name or a literal string of a PDF object, in the file's own syntax.
_PDF_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z0-9])")
_PDF_ENTRY = re.compile(rb"/(Title|Author)\s*\(")
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(content: bytes, at: int) -> str:
    """The literal string that opens in front of ``at``: balanced brackets, backslash escapes."""
    out, depth = bytearray(), 1
    while at < len(content):
        byte = content[at : at + 1]
        if byte == b"\\":
            at += 1
            byte = content[at : at + 1]
            out += _PDF_ESCAPES.get(byte, byte)
        else:
            depth += (byte == b"(") - (byte == b")")
            if not depth:
                break
            out += byte
        at += 1
    return out.decode("utf-16" if out[:2] in (b"\xfe\xff", b"\xff\xfe") else "latin-1")


def _pdf(content: bytes) -> dict[str, str]:
    """Pages, title and author of the plain objects of a file; compressed ones are not opened."""
    found: dict[str, str] = {}
    for entry in _PDF_ENTRY.finditer(content):
        found.setdefault({b"Title": "BookName", b"Author": "Author"}[entry[1]], _pdf_string(content, entry.end()))
    if pages := sum(1 for _ in _PDF_PAGE.finditer(content)):
        found["Pages"] = str(pages)
    return found


def document_content_fields(path: str, content: bytes) -> dict[str, str]:
    lowered = path.lower()
    found = _epub(content) if lowered.endswith(".epub") else _pdf(content) if lowered.endswith(".pdf") else {}
    return {k: v.strip() for k, v in found.items() if v.strip()}


DOCUMENTS = FieldSource("documents", DOCUMENT_EXTENSIONS, DOCUMENT_FIELDS, document_content_fields, "Book")


def name_fields(path) -> Column:
    """Map of what a file name says: ``Author - Book (Year)``."""
    name = stem_of(base_name(path))
    year_token = rf"[(\[]?{YEAR}[)\]]?"
    year = F.regexp_extract(name, year_token, 1)
    rest = F.regexp_replace(name, rf"^([\s\S]*?){year_token}([\s\S]*)$", "$1$3")
    parts = F.filter(F.split(rest, " - "), lambda p: F.length(p) > 0)
    tidy = lambda t: F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("_"), F.lit(" ")), r"\s{2,}", " "), r"^[ \-.()\[\]]+|[ \-.()\[\]]+$", "")
    split = F.size(parts) >= 2
    title = F.when(split, F.array_join(F.slice(parts, 2, F.size(parts)), " - ")).otherwise(rest)
    pairs = F.array(
        F.struct(F.lit("yearpublished").alias("k"), year.alias("v")),
        F.struct(F.lit("author").alias("k"), F.when(split, tidy(F.get(parts, 0))).otherwise("").alias("v")),
        F.struct(F.lit("bookname").alias("k"), tidy(title).alias("v")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: F.length(p["v"]) > 0))


def read_document_fields(contents: DataFrame) -> DataFrame:
    """(full_path, plugin_fields, failure) of documents: what the content says first, then the file name, field by field."""
    inside = read_fields(contents, [DOCUMENTS]).withColumn("_name", name_fields("full_path"))
    missing = F.map_filter("_name", lambda k, v: ~F.map_contains_key("plugin_fields", k))
    return inside.select("full_path", F.map_concat("plugin_fields", missing).alias("plugin_fields"), "failure")


def html_fields(html) -> Column:
    """(title, language, links) of a web page, by the same job shape."""
    text = col(html)
    title = F.trim(F.regexp_replace(_unescape(F.regexp_extract(text, r"(?is)<title[^>]*>([^<]*)</title>", 1)), r"\s+", " "))
    language = F.regexp_extract(text, r"(?is)<html[^>]*\slang\s*=\s*\"([^\"]*)\"", 1)
    links = F.size(F.regexp_extract_all(text, F.lit(r"(?i)(<a\s)"), F.lit(1)))
    return F.struct(title.alias("title"), language.alias("language"), links.alias("links"))
