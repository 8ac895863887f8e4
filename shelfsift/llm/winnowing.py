"""Document fingerprints by winnowing.

The rolling hashes run over ``K`` neighbouring words; of every ``W`` neighbouring hashes the least
is chosen, the rightmost one where several are least, and its position is kept. Two texts that
share K + W - 1 words in a row therefore choose a common hash there, at positions that tell where.
A text with fewer words than K has one hash over all of them; a text without words has none. With
fewer hashes than W, the least of all is chosen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import split_long

K, W = 3, 8
#: Runs of other characters than white space count as words, in pieces of so many characters.
PIECE = r"[^\x20\x09-\x0D]{1,12}"


def with_fingerprint(df: DataFrame, text: str, prefix: str, k: int = K, w: int = W) -> DataFrame:
    """Adds ``<prefix>_hashes`` (array<bigint>) and ``<prefix>_positions`` (array<int>, by word)."""
    words = split_long(df, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0)).alias("_w"))
    grams = ", ".join(f"_w[i + {j}]" for j in range(k))
    hashes = F.expr(
        f"CASE WHEN size(_w) = 0 THEN array() WHEN size(_w) < {k} THEN array(named_struct('h', xxhash64(array_join(_w, ' ')), 'p', 0)) "
        f"ELSE transform(sequence(0, size(_w) - {k}), i -> named_struct('h', xxhash64({grams}), 'p', -i)) END"
    )
    rolled = split_long(words, hashes.alias("_h")).drop("_w")
    # Positions are held negative, so that the least (hash, position) is the rightmost one.
    least = F.expr(f"CASE WHEN size(_h) = 0 THEN array() ELSE transform(sequence(1, greatest(size(_h) - {w - 1}, 1)), i -> array_min(slice(_h, i, {w}))) END")
    minima = split_long(rolled, least.alias("_m")).drop("_h")
    # A window's choice never lies in front of the one before it.
    chosen = split_long(minima, F.expr("filter(_m, (x, i) -> i = 0 OR x.p <> _m[i - 1].p)").alias("_c")).drop("_m")
    return chosen.withColumns(
        {f"{prefix}_hashes": F.transform("_c", lambda x: x.h), f"{prefix}_positions": F.transform("_c", lambda x: -x.p)}
    ).drop("_c")


def as_text(prefix: str) -> Column:
    """``position:hash`` of each choice, in order."""
    return F.expr(f"array_join(transform({prefix}_hashes, (h, i) -> concat({prefix}_positions[i], ':', lower(hex(h)))), ' ')")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of hashes; 1 for two empty ones."""
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1.0D ELSE size(array_intersect({a}, {b})) / size(array_union({a}, {b})) END")


def with_next(
    df: DataFrame, doc_id: str, columns: list[str], enrich: Callable[[DataFrame], DataFrame] = lambda d: d, derived: list[str] | None = None, prefix: str = "next_",
) -> DataFrame:
    """``enrich(df)`` with ``columns`` and ``derived`` (columns that ``enrich`` adds) of the document
    that follows in descending id (null id last), the first one after the last.

    Ids are cut into ranges at approximate quantiles. A window looks inside a range; the last
    document of a range takes the first one of the next range from a table of one row a range.
    Rows are moved before ``enrich`` works on them, and the window needs no further move.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(F.col(doc_id).cast("double").alias("x")).filter("x IS NOT NULL")
    cuts = sorted({int(x) for x in ids.approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    at = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(doc_id))), F.lit(0)) if cuts else F.lit(0)
    ranged = df.withColumn("_range", F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(at))
    whole = F.struct(*columns, *(derived or []))
    order = [F.col(doc_id).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in columns]]
    inside = Window.partitionBy("_range").orderBy(*order)
    # One row a range: its first document, found by its id alone and then by its columns.
    tops = ranged.groupBy("_range").agg(F.max(doc_id).alias("_top"))
    around = Window.orderBy(F.col("_range").desc())
    ring = tops.withColumn("_from", F.coalesce(F.lag("_range").over(around), F.min("_range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    first = ranged.join(F.broadcast(ring), ranged["_range"].eqNullSafe(ring["_range"]) & ranged[doc_id].eqNullSafe(ring["_top"]))
    heads = enrich(first.groupBy("_from").agg(F.max(F.struct(*columns)).alias("_head")).select("_from", "_head.*")).select("_from", whole.alias("_first"))
    joined = enrich(ranged.repartition("_range")).withColumn("_next", F.lead(whole).over(inside)).join(heads, F.col("_range") == F.col("_from"), "left")
    chosen = F.coalesce("_next", "_first")
    return joined.withColumns({prefix + c: chosen[c] for c in [*columns, *(derived or [])]}).drop("_range", "_next", "_from", "_first")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """doc_id, text, own hashes and positions, and the text and hashes of the next document.

    Null text is empty. Repeated rows each have a place in the order; equal ids follow each other
    by text. A lone document is its own next one. Other columns are not read.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_next(base, "doc_id", ["text"], lambda d: with_fingerprint(d, "text", "own", k, w), ["own_hashes"])


def edited(docs: DataFrame, share: int = 3, k: int = K, w: int = W) -> DataFrame:
    """Of ``fingerprints()``: ``edited_text`` has the last n / ``share`` code points replaced by as
    many from the start of the next text, and its fingerprint is beside it."""
    cut = F.floor(F.length("text") / share).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    return with_fingerprint(docs.withColumn("edited_text", text).drop("next_text"), "edited_text", "edited", k, w)
