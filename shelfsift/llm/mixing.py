"""Temperature mixing of sources to target weights.

A source's weight is its share of all tokens to the power ``t``, made to sum to one. The exponent
is found by bisection (many points a pass) so that the mixture has a wanted entropy, or so that
no source is repeated more than a limit. The weights are then realised exactly: a source's
documents lie in blocks by hash, each epoch takes the blocks in a rotation of its own, whole
epochs come whole, and the last one stops at the source's token budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, written

#: Documents of a block, on average.
BLOCK_DOCS = 512
POINTS, PASSES = 32, 7
CHUNK = 1024


def word_count(text: Column) -> Column:
    """Words of a text, as the token measure of the registered queries."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != "")).cast("long")


@dataclass(frozen=True)
class Target:
    """Exactly one of ``entropy`` (bits) and ``max_repeats``. ``budget`` is the number of tokens
    as a share of all tokens; None keeps every document: the least repeated source comes once."""

    entropy: float | None = None
    max_repeats: float | None = None
    budget: float | None = 1.0


def source_tokens(docs: DataFrame, source: str, tokens: Column) -> DataFrame:
    """(source, tokens, docs) of each source; a null source counts under the empty name. Summed
    within tasks first, so a hot source costs nothing extra."""
    return (
        docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), tokens.alias("tokens"))
        .groupBy("source")
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    )


def solve_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent in [0, 1] that meets the target. Repeats and entropy both fall as it rises, so
    each pass keeps the one gap between neighbouring points in which the target lies: one small
    aggregate a pass, whatever the number of sources. A target out of reach gives the nearer end.
    """
    if (target.entropy is None) == (target.max_repeats is None):
        raise ValueError("give an entropy or a limit of repeats")
    filled = sources.filter("tokens > 0")
    ends = filled.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not ends[0]:
        return 1.0
    total, least, most = float(ends[0]), ends[1] / ends[0], ends[2] / ends[0]
    p = F.col("tokens") / F.lit(total)

    def too_much(t: float, z: float, s: float) -> bool:
        """The exponent must be larger."""
        if target.entropy is not None:
            return (math.log(z) - t * s / z) / math.log(2) > target.entropy
        budget = target.budget if target.budget is not None else z * most ** (1 - t)
        return budget * least ** (t - 1) / z > target.max_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        sums = filled.agg(*[F.sum(F.pow(p, F.lit(t))) for t in points], *[F.sum(F.pow(p, F.lit(t)) * F.ln(p)) for t in points]).first()
        over = [too_much(t, sums[i], sums[i + POINTS + 1]) for i, t in enumerate(points)]
        if not any(over):
            return points[0]
        last = max(i for i, x in enumerate(over) if x)
        if last == POINTS:
            return points[-1]
        low, high = points[last], points[last + 1]
    return high


def source_weights(sources: DataFrame, exponent: float, target: Target) -> DataFrame:
    """Adds ``weight``, ``repeats`` (epochs, with a fraction) and ``budget`` (tokens of the last,
    partial epoch). A source without tokens weighs nothing and, if all are kept, comes once."""
    filled = sources.filter("tokens > 0")
    row = filled.agg(F.sum("tokens"), F.max("tokens")).first()
    total, most = float(row[0] or 1), float(row[1] or 1)
    p = F.col("tokens") / F.lit(total)
    z = filled.agg(F.sum(F.pow(p, F.lit(exponent)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    if target.budget is None:
        repeats = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(most), F.lit(exponent - 1))).otherwise(1.0)
    else:
        repeats = F.when(F.col("tokens") > 0, F.lit(target.budget) * weight / p).otherwise(0.0)
    # A hair below a whole number of epochs is that number.
    repeats = F.when(F.abs(repeats - F.round(repeats)) < 1e-9, F.round(repeats)).otherwise(repeats)
    return sources.withColumn("weight", weight).withColumn("repeats", repeats).withColumn(
        "part_budget", F.floor((F.col("repeats") - F.floor("repeats")) * F.col("tokens"))
    )


def _running(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the key in front, by a whole-number ``order``: inside
    chunks of CHUNK places, and over chunks, so that no task sorts all rows of a hot key."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum")).withColumn("_front", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    placed = chunked.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return placed.join(chunks.drop("_sum"), [*keys, "_chunk"]).withColumn(name, F.col("_front") + F.col("_inner")).drop("_chunk", "_front", "_inner")


def mix(
    docs: DataFrame, target: Target, tokens: Column, source: str = "source", seed: int = 7,
    output_block_tokens: int = 1 << 22,
) -> DataFrame:
    """The mixture: every copy of a document with all its columns in ``doc``, and mix_source,
    epoch, tokens, weight, repeats, mix_block and mix_order.

    Reading blocks of the output by mix_block and mix_order gives each source its weight in every
    block. A document is in the last epoch if its source's budget is not yet used up in front of
    it, so a source's tokens exceed its budget by less than one document. Repeated rows are
    documents of their own. An empty table gives an empty mixture.
    """
    sources = written(source_tokens(docs, source, tokens), "sources")
    exponent = solve_exponent(sources, target)
    weighted = source_weights(sources, exponent, target).select(
        F.col("source").alias("mix_source"), F.col("tokens").alias("source_tokens"), "weight", "repeats", "part_budget",
        F.greatest(F.floor(F.col("docs") / BLOCK_DOCS), F.lit(1)).alias("n_blocks"),
    )
    out_blocks = weighted.agg(F.greatest(F.ceil(F.sum(F.col("repeats") * F.col("source_tokens")) / output_block_tokens), F.lit(1))).first()[0] or 1
    # Plain columns all go into the hash, so rows with equal ids still spread over blocks.
    plain = [F.col(c).cast("string") for c, kind in docs.dtypes if kind in ("string", "bigint", "int")]
    key = [F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source"), tokens.alias("tokens"), F.xxhash64(F.lit(seed), *plain).alias("_hash")]
    blocked = docs.select(F.struct("*").alias("doc"), *key).join(weighted, "mix_source").withColumn("block", F.pmod("_hash", "n_blocks"))
    inside = Window.partitionBy("mix_source", "block").orderBy(F.xxhash64("_hash"), "_hash", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    blocks = blocked.groupBy("mix_source", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("n_blocks").alias("n_blocks"), F.first("repeats").alias("repeats"))
    epochs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("repeats").cast("int") - 1))).filter("epoch >= 0 AND epoch < repeats")
    turned = epochs.withColumn("place", F.pmod(F.col("block") + F.pmod(F.xxhash64(F.lit(seed), "mix_source", "epoch"), "n_blocks"), "n_blocks"))
    fronts = _running(turned, ["mix_source", "epoch"], "place", "block_tokens", "front").select("mix_source", "block", "epoch", "front")
    copies = placed.join(fronts, ["mix_source", "block"]).withColumn("_before", F.col("front") + F.col("_inside"))
    kept = copies.filter((F.col("epoch") < F.floor("repeats")) | (F.col("_before") < F.col("part_budget")))
    along = (F.col("epoch") * F.col("source_tokens") + F.col("_before")) / F.greatest(F.col("repeats") * F.col("source_tokens"), F.lit(1.0))
    block = F.least(F.floor(along * out_blocks), F.lit(out_blocks - 1)).cast("long")
    return kept.select(
        "doc", "mix_source", F.col("epoch").cast("int").alias("epoch"), "tokens", "weight", "repeats", block.alias("mix_block"),
        F.xxhash64(F.lit(seed), block, "_hash", "epoch").alias("mix_order"),
    )
