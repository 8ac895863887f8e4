"""Harmonic packing of token sequences.

A bin holds ``capacity`` ids. Class j takes pieces of at most capacity / j ids and puts exactly j
of them into each bin, so a bin is filled by counting alone and classes never wait for each other:
a piece's bin and place follow from its number within its class. Documents are cut first, so that
every piece comes close to its class's largest length. Pieces of bins that stay short of their
count, less than one bin a class, are joined end to end and cut at bin edges; the rest of the last
bin is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices, written
from .tokens import encoder, forget_rare

CAPACITY = 2048
#: Texts are encoded in groups of about so many characters, whose pieces a worker holds as objects.
GROUP_CHARS = 400_000
#: Ids a full bin may leave empty, as a share of the capacity.
SLACK = 1 / 128

PIECES = "part long, kind long, rank long, doc_id long, start long, length long, doc_tokens long, ids binary"


def cut_lengths(tokens: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a remainder below ``capacity``.

    Each piece has the largest length, of those no longer than the rest, of which a whole number
    fills a bin up to the slack; that number is its class.
    """
    pieces, allowed = [], int(capacity * slack)
    while tokens:
        length = next(n for n in range(tokens, 0, -1) if capacity % n <= allowed)
        pieces.append((capacity // length, length))
        tokens -= length
    return pieces


def _cut_partition(vocabulary: str, end_id: int, capacity: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        table = [cut_lengths(n, capacity, slack) for n in range(capacity)]
        tail_lengths = [np.array([n for _, n in t], np.int64) for t in table]
        tail_kinds = [np.array([j for j, _ in t], np.int64) for t in table]
        counters = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for low, high in slices(pa.compute.utf8_length(texts).to_numpy(), GROUP_CHARS):
                flat, n = encode(texts[low:high].to_pylist())
                ids, n = np.insert(flat, np.cumsum(n), end_id).astype("<u4"), n + 1
                full, rest = n // capacity, n % capacity
                many = full + np.array([len(tail_lengths[r]) for r in rest])
                doc = np.repeat(np.arange(len(n)), many)
                lengths = np.concatenate([x for f, r in zip(full, rest, strict=True) for x in (np.full(f, capacity), tail_lengths[r])])
                kinds = np.concatenate([x for f, r in zip(full, rest, strict=True) for x in (np.ones(f, np.int64), tail_kinds[r])])
                ends = np.cumsum(lengths)
                starts = ends - lengths - (np.cumsum(n) - n)[doc]
                # The number of a piece among those of its class in this part.
                order = np.argsort(kinds, kind="stable")
                sorted_kinds = kinds[order]
                first = np.searchsorted(sorted_kinds, sorted_kinds, side="left")
                ranks = np.empty(len(kinds), np.int64)
                ranks[order] = np.arange(len(kinds)) - first + counters[sorted_kinds]
                counters += np.bincount(kinds, minlength=capacity + 1)
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype("<i4").tobytes())
                cells = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(ids.tobytes())])
                owners = doc_ids[low:high].take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), part)), pa.array(kinds), pa.array(ranks), owners, pa.array(starts), pa.array(lengths), pa.array(n[doc]), cells],
                    names=[c.split()[0] for c in PIECES.split(", ")],
                )
            give_back()
        forget_rare()
        give_back()

    return run


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, slack: float = SLACK,
    doc_id: str = "doc_id", text: str = "text", keep: Callable[[Column], Column] = lambda ids: ids.alias("ids"),
) -> DataFrame:
    """Pieces with their place: doc_id, start, length, doc_tokens, what ``keep`` makes of the
    piece's ids (little-endian uint32; by default the ids), sequence_id, offset.

    Every whole text is encoded (null: empty) and ends with ``end_id``. Each row is a document of
    its own, so repeated rows and ids, and a null id, are packed like any other. An empty table
    gives no piece. Other columns are not read.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Written once: numbers within a class stay as they are, and encoding is not repeated.
    pieces = written(rows.mapInArrow(_cut_partition(vocabulary, end_id, capacity, slack), PIECES), "pieces")
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("front", F.coalesce(F.sum("n").over(before), F.lit(0)))
    classes = parts.groupBy("kind").agg(F.sum("n").alias("all")).withColumn("bins", F.floor(F.col("all") / F.col("kind")))
    # At most ``capacity`` classes, each with the bins of all smaller ones in front.
    earlier, every = Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = classes.withColumn("first_bin", F.coalesce(F.sum("bins").over(earlier), F.lit(0))).withColumn("base", F.sum("bins").over(every))
    places = parts.select("part", "kind", "front").join(kinds.select("kind", "bins", "first_bin", "base"), "kind")
    at, whole = F.col("rank") + F.col("front"), F.col("bins") * F.col("kind")
    # What is kept of the ids is taken in front of the join and the window, which move the rows.
    narrow = pieces.select("part", "kind", "rank", "doc_id", "start", "length", "doc_tokens", keep(F.col("ids")))
    filled = narrow.join(places, ["part", "kind"]).withColumn("at", at).filter(F.col("at") < whole)
    numbered = filled.withColumn("sequence_id", F.col("first_bin") + F.floor(F.col("at") / F.col("kind"))).drop("part", "kind", "rank", "front", "bins", "first_bin", "base")
    # Offsets add up real lengths, so a bin has no gap between its pieces.
    in_bin = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    set_down = numbered.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0))).drop("at")
    # Fewer than j pieces of class j are left: their keys are bounded by the capacity alone.
    left = pieces.select("part", "kind", "rank").join(places, ["part", "kind"]).withColumn("at", at).filter(F.col("at") >= whole)
    ids = pieces.join(F.broadcast(left.select("part", "kind", "rank", "at", "base")), ["part", "kind", "rank"])
    return set_down.unionByName(_leftovers(ids, capacity, keep))


def _leftovers(left: DataFrame, capacity: int, keep: Callable[[Column], Column]) -> DataFrame:
    """Join the pieces of unfilled bins end to end, cut at bin edges, and cut the rest of the last
    bin at powers of two. Fewer than j pieces of class j are left, whatever the table's size: at
    most ``capacity`` ids a class."""
    along = Window.orderBy("kind", "at").rowsBetween(Window.unboundedPreceding, -1)
    lined = left.withColumn("from", F.coalesce(F.sum("length").over(along), F.lit(0))).withColumn("to", F.col("from") + F.col("length"))
    total = left.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total"), F.max("base").alias("base"))
    full, rest = F.floor(F.col("total") / capacity), F.col("total") % capacity
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    # (low, high) of each sequence: whole bins, then one for each set bit of the rest.
    whole = F.transform(F.sequence(F.lit(1), F.greatest(full, F.lit(1))), lambda i: span((i - 1) * capacity, i * capacity))
    bits = [capacity >> (b + 1) for b in range(capacity.bit_length() - 1)]
    tail = F.array(*[span(F.col("total") - rest % (2 * b), F.col("total") - rest % b) for b in bits])
    spans = F.concat(F.filter(whole, lambda s: s.high <= F.col("total")), F.filter(tail, lambda s: s.high > s.low))
    edges = total.select("base", F.posexplode(spans).alias("nr", "edge")).select("base", "nr", "edge.low", "edge.high")
    # A piece is no longer than a bin and a sequence lies within one, so they meet by bin number.
    number = lambda x: F.floor(x / capacity)
    pieces = lined.drop("base").withColumn("cell", F.explode(F.array_distinct(F.array(number(F.col("from")), number(F.col("to") - 1)))))
    met = pieces.join(edges.withColumn("cell", number(F.col("low"))), "cell").filter((F.col("from") < F.col("high")) & (F.col("to") > F.col("low")))
    cut = met.withColumn("skip", F.greatest("from", "low") - F.col("from")).withColumn("size", F.least("to", "high") - F.greatest("from", "low"))
    ids = F.substring("ids", (F.col("skip") * 4 + 1).cast("int"), (F.col("size") * 4).cast("int"))
    return cut.withColumn("ids", ids).select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("size").alias("length"), "doc_tokens", keep(F.col("ids")),
        (F.col("base") + F.col("nr")).alias("sequence_id"), (F.col("from") + F.col("skip") - F.col("low")).alias("offset"),
    )
