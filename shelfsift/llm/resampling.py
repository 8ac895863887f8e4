"""Importance resampling towards a target distribution.

A document's features are its runs of one to three words, hashed into a fixed number of buckets.
Two arrays of counts, of all documents and of the target texts, give each bucket a gain, and a
document's weight is the sum of the gains of its features: an array read once a feature. Weights
get Gumbel noise from a hash of the document's id, and the highest scores are drawn, which is
sampling without replacement in proportion to exp(weight).

The cutoff is found by bracketing: a mergeable quantile sketch names two scores that should lie
around it, exact counts of what is above and inside show whether they do, and a bracket that does
not hold is widened and counted again. Only rows inside the bracket are sorted to find the cutoff.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, written

BUCKETS = 10_000
#: Features are runs of up to so many words.
RUN = 3
#: Gains and noise are whole thousandths.
UNIT = 1000
#: Bytes of text that a task turns into features at once.
SLICE_BYTES = 4_000_000
#: 1 / rank error of the sketch, and by how many such errors the first bracket reaches each way.
SKETCH_ACCURACY = 10_000
REACH = 2.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all bytes of characters beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

#: CRC-32 of one byte (reflected polynomial), from which all tables below are built.
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_CRC = _byte_table()
#: Words up to this length have their checksums computed side by side.
SHORT = 64


def _move_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What n zero bytes behind it do to a checksum, which is linear in its four bytes: one table
    for each n below SHORT, and one for each power of two from SHORT on."""
    bytes_at = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    short = np.zeros((SHORT + 1, 4, 256), np.uint32)
    short[0] = bytes_at
    for n in range(1, SHORT + 1):
        short[n] = _CRC[short[n - 1] & 255] ^ (short[n - 1] >> 8)
    powers = [short[SHORT]]
    while len(powers) < 40 - int(math.log2(SHORT)):
        powers.append(_apply(powers[-1], powers[-1]))
    return short, powers


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0, x & 255] ^ table[1, (x >> 8) & 255] ^ table[2, (x >> 16) & 255] ^ table[3, x >> 24]


_SHORT_MOVES, _POWER_MOVES = _move_tables()
_FLAT_MOVES = [np.ascontiguousarray(_SHORT_MOVES[:SHORT, k, :]).ravel() for k in range(4)]


def moved(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums ``x`` moved over ``n`` bytes: crc(a + b) = moved(crc(a), len(b)) ^ crc(b)."""
    at = (n % SHORT).astype(np.int64) << 8
    out = _FLAT_MOVES[0][at + (x & 255)] ^ _FLAT_MOVES[1][at + ((x >> 8) & 255)] ^ _FLAT_MOVES[2][at + ((x >> 16) & 255)] ^ _FLAT_MOVES[3][at + (x >> 24)]
    left = n // SHORT
    for k, table in enumerate(_POWER_MOVES):
        if not left.any():
            break
        own = np.flatnonzero(left & 1)
        out[own] = _apply(table, out[own])
        left >>= 1
    return out


def word_checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each word, byte by byte over all words that are long enough."""
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    order = np.argsort(-np.where(lengths > SHORT, 0, lengths), kind="stable")
    at, own = starts[order], np.where(lengths > SHORT, 0, lengths)[order]
    many = len(own) - np.cumsum(np.bincount(own, minlength=SHORT + 1))
    value = np.full(len(own), 0xFFFFFFFF, np.uint32)
    for k in range(int(own[0]) if len(own) else 0):
        n = many[k]
        value[:n] = _CRC[(value[:n] ^ data[at[:n] + k]) & 255] ^ (value[:n] >> 8)
    short = own > 0
    out[order[short]] = ~value[short]
    return out


def features_of(data: np.ndarray, edges: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words of each text, [buckets of runs of 1, 2 and 3 words]), for texts that lie end to end in
    ``data`` between ``edges``. The k-th array has an entry for each word that such a run starts at,
    and -1 where the text ends before."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _IN_WORD[data]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    heads = edges[:-1][edges[:-1] < edges[1:]]
    first[heads] = inside[heads]
    last = inside[:-1] & ~inside[1:]
    tails = edges[1:][edges[:-1] < edges[1:]] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    owner = np.searchsorted(edges, starts, side="right") - 1
    single = word_checksums(data, starts, lengths)
    spaced = moved(np.full(len(single), zlib.crc32(b" "), np.uint32), lengths) ^ single
    found, run = [(single % buckets).astype(np.int64)], single
    for k in range(1, RUN):
        run = moved(run[: max(len(single) - k, 0)], lengths[k:] + 1) ^ spaced[k:]
        whole = np.full(len(single), -1, np.int64)
        whole[: len(run)] = np.where(owner[: len(run)] == owner[k:], (run % buckets).astype(np.int64), -1)
        found.append(whole)
    return np.bincount(owner, minlength=len(edges) - 1), found


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of a binary column; null texts have no bytes."""
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, edges = _texts(column)
    for start, end in slices(np.diff(edges).tolist(), SLICE_BYTES):
        yield start, end, data[edges[start] : edges[end]], edges[start : end + 1] - edges[start]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket. Each task adds up its own
    texts in one array, so what is shuffled does not grow with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, edges in _pieces(batch.column(0)):
                for found in features_of(data, edges, buckets)[1]:
                    total += np.bincount(found + 1, minlength=buckets + 1)[1:]
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["bucket", "n"])

    counted = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The thousandfold log ratio of a bucket's smoothed shares of target and own features, floored."""
    total, wanted, b = float(own.sum()), float(target.sum()), float(len(own))
    return np.array([math.floor(UNIT * math.log((float(t) + 1) * (total + b) / ((float(s) + 1) * (wanted + b)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def learn_gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gains by bucket. The driver gets two rows a bucket, however large the tables are."""

    def array(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(texts, text, buckets).collect():
            out[bucket] = n
        return out

    return gains(array(docs), array(target))


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandfold standard Gumbel noise from a hash of the id, floored; a null id counts as empty text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """``doc`` (the columns of ``carry``; all of them if None) with n_words, n_features, weight and score."""
    kept = F.struct(*[F.col(c) for c in (docs.columns if carry is None else carry)]).alias("doc")
    rows = docs.select(F.col(text).cast("binary").alias("text"), kept, noise(F.col(doc_id), seed).alias("noise"))
    padded = np.concatenate([[0], gain])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for start, end, data, edges in _pieces(batch.column(0)):
                words[start:end], found = features_of(data, edges, len(gain))
                upto = np.concatenate([[0], np.cumsum(sum(padded[f + 1] for f in found))])
                ends = np.cumsum(words[start:end])
                weight[start:end] = upto[ends] - upto[ends - words[start:end]]
            features = sum(np.maximum(words - k, 0) for k in range(RUN))
            score = pa.array(weight + batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words), pa.array(features), pa.array(weight), score], names=["doc", "n_words", "n_features", "weight", "score"])

    schema = rows.select("doc").schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {schema}, n_words bigint, n_features bigint, weight bigint, score bigint")


@dataclass(frozen=True)
class Bracket:
    """Scores around the cutoff: ``above`` rows lie over ``high`` and ``within`` from ``low`` to ``high``."""

    low: int | None
    high: int | None
    above: int
    within: int
    rounds: int


def bracket(rows: DataFrame, wanted: int, share: float, score: str = "score", accuracy: int = SKETCH_ACCURACY) -> Bracket:
    """Two scores with the ``wanted``-th highest between them, proven by exact counts. ``share`` is
    about ``wanted`` over all rows. A bracket that fails is widened four times on the side that
    failed; in the end it is open."""
    below = above = REACH / accuracy
    rounds = 0
    while True:
        rounds += 1
        lowest, highest = 1 - share - below, 1 - share + above
        asked = [max(lowest, 0.0), min(highest, 1.0)]
        low, high = rows.agg(F.percentile_approx(score, asked, accuracy)).first()[0] or (None, None)
        low, high = (None if lowest <= 0 else low), (None if highest >= 1 else high)
        over = F.lit(False) if high is None else F.col(score) > high
        under = F.lit(False) if low is None else F.col(score) < low
        counts = rows.agg(F.count_if(over), F.count_if(~over & ~under)).first()
        if counts[0] < wanted <= counts[0] + counts[1]:
            return Bracket(low, high, counts[0], counts[1], rounds)
        if high is None and low is None:
            raise ValueError(f"{wanted} rows wanted of {counts[1]}")
        above, below = (4 * above, below) if counts[0] >= wanted else (above, 4 * below)


def _placed(rows: DataFrame, order: Sequence[Column], spark: SparkSession, name: str) -> DataFrame:
    """``rows`` with ``place``, 1 for the first in ``order``: a range-partitioned sort, written once,
    and offsets from the number of rows of each sorted partition."""
    at = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = written(at.withColumn("_part", F.shiftright("_at", 33)), name)
    # One row a partition of the sort.
    parts = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return sorted_rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, doc_id: str = "doc_id", text: str = "text",
    carry: Sequence[str] | None = None, seed: int = 42, accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Every row of ``docs`` with its n_words, n_features, weight, score and ``rank`` among the drawn
    ones (null: not drawn). Of the N rows with ``least_words`` or more, the floor(percent * N / 100)
    highest scores are drawn, ties to the smaller id.

    Null and empty texts have no features and the weight 0. Null ids come after all others among
    ties; rows alike in score, id, features and weight are interchangeable, and as many of them are
    drawn as fit. Empty tables draw nothing. ``carry`` names the columns kept under ``doc`` (all by
    default); they may have any names.
    """
    spark = docs.sparkSession
    scored = weigh(docs, learn_gains(docs, target, text), doc_id, text, list(dict.fromkeys([*(docs.columns if carry is None else carry), doc_id])), seed)
    # The order of rows that are alike in every column is settled by their place in this table.
    rows = written(scored.withColumn("_row", F.monotonically_increasing_id()), "weighed")
    eligible = rows.filter(F.col("n_words") >= least_words)
    wanted = eligible.count() * percent // 100
    own = F.col("doc")[doc_id]
    order = [-F.col("score"), own.isNull(), own, F.col("n_features"), F.col("weight"), F.col("_row")]
    kept = rows.withColumn("rank", F.lit(None).cast("bigint"))
    if not wanted:
        return kept.drop("_row")
    around = bracket(eligible, wanted, percent / 100, accuracy=accuracy)
    inside = eligible
    over = F.lit(False) if around.high is None else F.col("score") > around.high
    if around.high is not None:
        inside = inside.filter(~over)
    if around.low is not None:
        inside = inside.filter(F.col("score") >= around.low)
    narrow = inside.select("score", own.alias("id"), "n_features", "weight", "_row")
    order_in = [-F.col("score"), F.col("id").isNull(), F.col("id"), F.col("n_features"), F.col("weight"), F.col("_row")]
    last = _placed(narrow, order_in, spark, "bracket").filter(F.col("place") == wanted - around.above).first()
    # The cutoff, column by column as in the order; a row is drawn if it comes no later.
    is_null = last["id"] is None
    stops = [(order[0], F.lit(-last["score"])), (order[1], F.lit(is_null)), *([] if is_null else [(own, F.lit(last["id"]))]), *((F.col(c), F.lit(last[c])) for c in ("n_features", "weight", "_row"))]
    upto = F.lit(True)
    for column, stop in reversed(stops):
        upto = (column < stop) | ((column == stop) & upto)
    drawn = (F.col("n_words") >= F.lit(least_words)) & F.coalesce(upto, F.lit(False))
    ranked = _placed(rows.filter(drawn), order, spark, "drawn").withColumnRenamed("place", "rank")
    return kept.filter(~drawn).unionByName(ranked).drop("_row")
