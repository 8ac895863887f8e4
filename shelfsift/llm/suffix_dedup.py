"""Removal of repeated passages with a sparse suffix array over all texts.

Of every ``LENGTH``-byte string one suffix is chosen by content alone: the one that starts at the
least hash of ``LEAD`` bytes within the string (the leftmost, if several are least). Equal strings
choose the same suffix at the same distance, so it is enough to sort the chosen suffixes, about
one in eighteen. The array is built twice over the same sampled splitters:

1. Suffixes carry their leading bytes only. Buckets sort them by multikey quicksort, a word of
   eight bytes at a time, and report those whose leading bytes occur in two documents or reach a
   bucket's edge.
2. The reported suffixes carry the bytes around them. A bucket compares every string through a
   suffix with the equal ones of its range and keeps the smallest document.

Splitters are (leading bytes, document), so suffixes that a third of all documents share lie in
many buckets. Only the first and the last range of a bucket can go on in another one: their
strings are compared across boundaries, in buckets by their hash, all others in place.

Strings are compared by 128 bits of two multilinear hashes in step 2; the chance that any
two of 10^12 different strings are taken as equal is below 10^-13.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean

LENGTH = 50
LEAD = 16
REACH = LENGTH - LEAD  # the farthest a chosen suffix starts behind its string's start
#: Suffixes of a bucket, and text bytes of a block of documents, on average.
BUCKET_SUFFIXES = 1 << 19
BLOCK_BYTES = 6 << 20
#: Suffixes that are dealt, compared or looked around at once; bounds a task's memory.
AT_ONCE = 1 << 15
#: Sampled suffixes for each bucket that the splitters are taken from.
SAMPLES_PER_BUCKET = 48
CHUNK_BYTES = 1 << 19

_BASE = np.array(0x9E3779B97F4A7C15, np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WIDTH = REACH + LENGTH
_WEIGHTS = np.random.default_rng(20240917).integers(1, 1 << 63, (2, _WIDTH), np.uint64) * np.uint64(2) + np.uint64(1)
LAST_ID = (1 << 63) - 1

CANDIDATES = "block long, blob binary"


def chosen_suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, nearest, farthest) of the chosen suffixes of texts that lie one after another in
    ``data``: the strings that chose it start ``nearest`` to ``farthest`` bytes in front of it."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    long = ends - starts >= LENGTH
    if not long.any():
        return none
    value, power, width = data.astype(np.uint64) + np.uint64(1), _BASE.reshape(1), 1
    while width < LEAD:
        value = value[:-width] * power + value[width:]
        power, width = power * power, width * 2
    value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    shift, span = np.zeros(len(value), np.uint8), 1
    while span < REACH + 1:
        step = min(span, REACH + 1 - span)
        later = value[step:] < value[:-step]
        shift = np.where(later, shift[step:] + np.uint8(step), shift[:-step])
        value = np.where(later, value[step:], value[:-step])
        span += step
    edge = np.zeros(len(value) + 1, np.int8)
    edge[starts[long]] += 1
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    at = np.arange(len(value)) + shift
    changed = np.concatenate([[True], at[1:] != at[:-1]])
    first = np.flatnonzero(valid & (changed | np.concatenate([[True], ~valid[:-1]])))
    last = np.flatnonzero(valid & (np.concatenate([changed[1:], [True]]) | np.concatenate([~valid[1:], [True]])))
    return at[first], shift[last], shift[first]


def _words(lead: np.ndarray) -> list[np.ndarray]:
    """Leading bytes as big-endian words of eight."""
    flat = np.ascontiguousarray(lead)
    return [flat[:, i : i + 8].copy().view(">u8").ravel().astype(np.uint64) for i in range(0, LEAD, 8)]


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by words of leading bytes, and where each range of equal ones begins: sorted
    by the first word, and only ranges that are still equal go on with the next."""
    order = np.argsort(words[0], kind="stable")
    new = np.concatenate([[True], np.diff(words[0][order]) != 0]) if len(order) else np.zeros(0, bool)
    for word in words[1:]:
        ranges = np.cumsum(new)
        sizes = np.bincount(ranges)
        open_ = np.flatnonzero(sizes[ranges] > 1)
        inner = np.lexsort((word[order[open_]], ranges[open_]))
        order[open_] = order[open_][inner]
        new[open_[1:]] |= word[order[open_[1:]]] != word[order[open_[:-1]]]
    return order, np.flatnonzero(new)


def _planes(column: np.ndarray) -> bytes:
    """Bytes of the same weight side by side, which compresses better."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def _write(*columns: np.ndarray) -> bytes:
    raw = b"".join(c.tobytes() if c.ndim == 2 else _planes(c) for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(len(columns[0]).to_bytes(8, "little") + raw)


def _read(blobs: list[bytes], *kinds: tuple) -> list[np.ndarray]:
    """The columns of all blobs; a kind is (dtype, None) or (uint8, width)."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    tool = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = tool.decompress(blob)
        n, at = int.from_bytes(raw[:8], "little"), 8
        for out, (kind, width) in zip(parts, kinds, strict=True):
            size = n * (width or np.dtype(kind).itemsize)
            flat = np.frombuffer(raw, np.uint8, size, at)
            out.append(flat.reshape(n, width) if width else flat.reshape(-1, n).T.copy().view(kind).ravel())
            at += size
    return [np.concatenate(p) if p else np.zeros((0, w) if w else 0, k) for p, (k, w) in zip(parts, kinds, strict=True)]


_SUFFIX = ((np.uint8, LEAD), ("<i8", None), ("<u4", None))
_SEEN = ((np.uint8, _WIDTH), ("<i8", None), ("<u4", None), ("<u4", None), (np.uint8, None), (np.uint8, None))
_FOUND = (("<i8", None), ("<u4", None))
_EDGE = ((np.uint8, None), ("<i8", None), ("<i8", None), ("<i8", None), ("<u4", None), ("<u4", None))
_SPANS = (("<i8", None), ("<u4", None), ("<u4", None), ("<u4", None))


def _block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (doc ^ (doc >> 13) ^ (doc >> 29)) % blocks


def _block_column(doc, blocks: int):
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 13)).bitwiseXOR(F.shiftright(doc, 29)), F.lit(blocks))


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, size in enumerate(sizes):
        held += int(size)
        if held >= CHUNK_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the n + 1 offsets of its cells."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _texts(table: pa.Table, text: str) -> pa.Array:
    """The text cells of the rows carried in ``doc``."""
    column = table.column("doc")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return pa.compute.fill_null(column.field(text).cast(pa.large_binary()), b"")


def _suffixes_of(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(leading bytes, row, position, nearest, farthest) of each chunk of texts."""
    data, offsets = _bytes_of(column)
    for low, high in _chunks(np.diff(offsets)):
        part, ends = data[offsets[low] : offsets[high]], offsets[low + 1 : high + 1] - offsets[low]
        starts = offsets[low:high] - offsets[low]
        at, near, far = chosen_suffixes(part, starts, ends)
        owner = np.searchsorted(starts, at, side="right") - 1
        # Empty texts share their start with the next one; the last of equal starts owns the bytes.
        yield part[at[:, None] + np.arange(LEAD)], owner + low, (at - starts[owner]).astype("<u4"), near, far


def _sort_keys(lead: np.ndarray, doc: np.ndarray) -> np.ndarray:
    flipped = (doc.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.concatenate([lead, flipped], axis=1)).view(f"S{LEAD + 8}").ravel()


def _dealt(splitters: np.ndarray, lead: np.ndarray, columns: list[np.ndarray], doc: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of suffixes, in suffix order within a blob."""
    bucket = np.searchsorted(splitters, _sort_keys(lead, doc), side="right")
    order = np.lexsort((_words(lead)[0], bucket))
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])) if len(bucket) else [0]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[low]), _write(*[c[order[low:high]] for c in columns])


def _by_block(doc: np.ndarray, columns: list[np.ndarray], blocks: int) -> pa.Table:
    block = _block_of(doc, blocks)
    order = np.argsort(block, kind="stable")
    block = block[order]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0, [True]])) if len(block) else [0]
    cut = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.table({"block": pa.array([int(block[a]) for a, _ in cut], pa.int64()), "blob": pa.array([_write(*[c[order[a:b]] for c in columns]) for a, b in cut], pa.binary())})


def _spread(splitters: np.ndarray):
    """Texts to suffix blobs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            ids = batch.column(0).to_numpy()
            # Chunks are dealt out some hundred thousand suffixes at once.
            for part in chain(_suffixes_of(batch.column(1)), [None]):
                if part is not None:
                    held.append(part[:3])
                    if sum(len(x[1]) for x in held) < 8 * AT_ONCE:
                        continue
                if held:
                    lead, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
                    held, doc = [], ids[row]
                    rows = list(_dealt(splitters, lead, [lead, doc.astype("<i8"), at], doc))
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])
        give_back()

    return run


def _shared(blocks: int):
    """A bucket's suffixes whose leading bytes occur in two documents or may go on next door."""

    def run(table: pa.Table) -> pa.Table:
        lead, doc, at = _read(table.column("blob").to_pylist(), *_SUFFIX)
        order, begins = multikey_order(_words(lead))
        sizes, ordered = np.diff(np.append(begins, len(order))), doc[order]
        keep = np.minimum.reduceat(ordered, begins) != np.maximum.reduceat(ordered, begins)
        keep[[0, -1]] = True
        found = order[np.repeat(keep, sizes)]
        return _by_block(doc[found], [doc[found], at[found]], blocks)

    return run


def _seen(data: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The bytes around each suffix; those of none of its strings are 0. Places are eight bytes for
    each byte, so they are made for some thousand suffixes at once."""
    seen, reach = np.empty((len(at), _WIDTH), np.uint8), np.arange(-REACH, LENGTH)
    for a in range(0, len(at), AT_ONCE // 8):
        cut = slice(a, a + AT_ONCE // 8)
        own = data[np.clip(at[cut][:, None] + reach, 0, len(data) - 1)]
        own[(reach < -far[cut][:, None]) | (reach >= LENGTH - near[cut][:, None])] = 0
        seen[cut] = own
    return seen


def _surroundings(splitters: np.ndarray, text: str):
    """Texts of a block and its reported suffixes to blobs with the bytes around, by bucket."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc, at = _read(found.column("blob").to_pylist(), *_FOUND)
        column = _texts(texts, text)
        owner, tags, (data, offsets) = texts.column("id").to_numpy(), texts.column("tag").to_numpy(), _bytes_of(column)
        # Suffixes are chosen again and kept if they were reported for the row's id: by number of
        # the id and position, in one sorted list.
        ids, number = np.unique(owner, return_inverse=True)
        place = np.searchsorted(ids, doc)
        known = place < len(ids)
        known[known] = ids[place[known]] == doc[known]
        wanted = np.unique(place[known].astype(np.uint64) << np.uint64(32) | at[known].astype(np.uint64))
        parts = []
        for _, row, at, near, far in _suffixes_of(column):
            keys = number[row].astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)
            slot = np.searchsorted(wanted, keys)
            hit = slot < len(wanted)
            hit[hit] = wanted[slot[hit]] == keys[hit]
            parts.append((row[hit], at[hit].astype(np.int64), near[hit], far[hit]))
        none = np.zeros(0, np.int64)
        row, at, near, far = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none, none)
        rows: list[tuple[int, bytes]] = []
        for a in range(0, len(row), 2 * AT_ONCE):
            cut = slice(a, a + 2 * AT_ONCE)
            seen = _seen(data, offsets[row[cut]] + at[cut], near[cut].astype(int), far[cut].astype(int))
            own = owner[row[cut]]
            rows += _dealt(splitters, seen[:, REACH : REACH + LEAD], [seen, own.astype("<i8"), tags[row[cut]].astype("<u4"), at[cut].astype("<u4"), near[cut], far[cut]], own)
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def _sorted_ranges(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns in (suffix, document) order, and the bounds of the ranges of equal leading bytes."""
    columns = _read(table.column("blob").to_pylist(), *_SEEN)
    by_doc = np.argsort(columns[1], kind="stable")
    order, begins = multikey_order(_words(columns[0][by_doc, REACH : REACH + LEAD]))
    return [c[by_doc[order]] for c in columns], np.append(begins, len(order))


def _hashes(seen: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each distance from the suffix: both hashes of the strings that start so far in front of
    it, sums of weighted bytes. They roll from one distance to the next, so no row holds more than
    its two sums. Only strings at one distance are compared."""
    sums = [np.zeros(len(seen), np.uint64) for _ in _WEIGHTS]
    for column in range(REACH, _WIDTH):
        own = seen[:, column].astype(np.uint64)
        for total, w in zip(sums, _WEIGHTS, strict=True):
            total += own * w[column]
    yield 0, sums
    for shift in range(1, REACH + 1):
        first, gone = (seen[:, c].astype(np.uint64) for c in (REACH - shift, REACH - shift + LENGTH))
        for total, w in zip(sums, _WEIGHTS, strict=True):
            total += first * w[REACH - shift]
            total -= gone * w[REACH - shift + LENGTH]
        yield shift, sums


def _strings(seen: np.ndarray, docs: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each distance: the rows with a string so far in front of their suffix, the first
    document of each one's string among them, and its two hashes. Rows are in order of documents
    within their ranges."""
    for shift, sums in _hashes(seen):
        rows = np.flatnonzero((near <= shift) & (far >= shift))
        if len(rows):
            k1, k2 = (s[rows] for s in sums)
            order = np.lexsort((docs[rows], k2, k1))
            new = np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)])
            first = docs[rows[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
            yield shift, rows[order], first, [k1[order].view(np.int64), k2[order].view(np.int64)]


def _settled(blocks: int):
    """Spans of strings that an earlier document of the bucket also holds."""

    def run(table: pa.Table) -> pa.Table:
        (seen, doc, tag, at, near, far), bounds = _sorted_ranges(table)
        out: list[list[np.ndarray]] = [[], [], [], []]
        low = 0
        while low + 1 < len(bounds):
            # Whole ranges; a longer one is compared on its own.
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + AT_ONCE, side="right")) - 1)
            cut = slice(bounds[low], bounds[high])
            low = high
            docs = doc[cut]
            marked = np.zeros((len(docs), REACH + 3), bool)
            for shift, rows, firsts, _ in _strings(seen[cut], docs, near[cut], far[cut]):
                marked[rows, shift + 1] = docs[rows] > firsts
            step = np.diff(marked.astype(np.int8), axis=1)
            row, nearest = np.nonzero(step == 1)
            farthest = np.nonzero(step == -1)[1] - 1
            place = at[cut][row].astype(np.int64)
            for held, x in zip(out, (docs[row], tag[cut][row], place - farthest, place - nearest + LENGTH), strict=True):
                held.append(x)
        if not out[0]:
            return _by_block(np.zeros(0, np.int64), [], blocks)
        doc, tag, begin, end = (np.concatenate(x) for x in out)
        return _by_block(doc, [doc.astype("<i8"), tag.astype("<u4"), begin.astype("<u4"), end.astype("<u4")], blocks)

    return run


def _edge_strings(buckets: int):
    """The strings of a bucket's first and last range, where its first document holds them: only
    there an earlier bucket matters, later documents of the bucket are settled already. Dealt out
    by hash, so a string meets itself with one record a bucket at most."""

    def run(table: pa.Table) -> pa.Table:
        (seen, doc, tag, at, near, far), bounds = _sorted_ranges(table)
        parts = []
        for low, high in sorted({(int(bounds[0]), int(bounds[1])), (int(bounds[-2]), int(bounds[-1]))}) if len(doc) else []:
            for begin in range(low, high, AT_ONCE):
                cut = slice(begin, min(begin + AT_ONCE, high))
                for shift, rows, firsts, (k1, k2) in _strings(seen[cut], doc[cut], near[cut], far[cut]):
                    open_ = doc[cut][rows] == firsts
                    own = rows[open_] + begin
                    parts.append((np.full(len(own), shift, np.uint8), k1[open_], k2[open_], doc[own].astype("<i8"), tag[own].astype("<u4"), (at[own] - shift).astype("<u4")))
        rows = []
        if parts:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            to = ((columns[1].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0, [True]]))
            rows = [(int(to[order[x]]), _write(*[c[order[x:y]] for c in columns])) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def _compared(blocks: int):
    """Spans of edge strings that an earlier document of another bucket holds."""

    def run(table: pa.Table) -> pa.Table:
        shift, k1, k2, doc, tag, at = _read(table.column("blob").to_pylist(), *_EDGE)
        order = np.lexsort((doc, k2, k1, shift))
        new = np.concatenate([[True], (np.diff(shift[order]) != 0) | (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)])
        first = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        late = order[doc[order] > first]
        return _by_block(doc[late], [doc[late], tag[late], at[late], (at[late] + LENGTH).astype("<u4")], blocks)

    return run


def _cut_out(text: str):
    return lambda texts, spans: _without(texts, spans, text)


def _without(texts: pa.Table, spans: pa.Table, text: str) -> pa.Table:
    doc, tag, begin, end = _read(spans.column("blob").to_pylist(), *_SPANS)
    order = np.lexsort((tag, doc))
    doc, tag, begin, end = doc[order], tag[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    data, offsets = _bytes_of(_texts(texts, text))
    owner, tags = texts.column("id").to_numpy(), texts.column("tag").to_numpy()
    low, high = np.searchsorted(doc, owner, side="left"), np.searchsorted(doc, owner, side="right")
    kept, starts, ends = [], [], []
    for i in range(len(owner)):
        own = data[offsets[i] : offsets[i + 1]]
        mine = slice(low[i] + np.searchsorted(tag[low[i] : high[i]], tags[i], side="left"), low[i] + np.searchsorted(tag[low[i] : high[i]], tags[i], side="right"))
        edge = np.zeros(len(own) + 1, np.int64)
        np.add.at(edge, begin[mine], 1)
        np.add.at(edge, end[mine], -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept.append(own[~gone].tobytes())
        turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        starts.append(np.flatnonzero(turn == 1))
        ends.append(np.flatnonzero(turn == -1))
    return pa.table({
        "doc": texts.column("doc"), "n_bytes": pa.array(np.diff(offsets)), "kept": pa.array(kept, pa.binary()),
        "removed_starts": pa.array(starts, pa.list_(pa.int64())), "removed_ends": pa.array(ends, pa.list_(pa.int64())),
    })


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` (the whole input row), ``n_bytes``, ``kept`` (bytes that stay), ``removed_starts``
    and ``removed_ends`` (byte offsets of the maximal removed runs).

    A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id;
    strings never cross documents and are judged on the input. Null text is empty and loses
    nothing, as do texts shorter than LENGTH. Rows with one id never take from each other. A null
    id counts as larger than any. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.struct("*").alias("doc"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"),
    )
    total = own.agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, total // ((REACH + 2) // 2 * BUCKET_SUFFIXES) + 1)
    blocks = max(parts, total // BLOCK_BYTES + 1) | 1
    wanted = buckets * SAMPLES_PER_BUCKET * (REACH + 2) // 2
    splitters = _splitters(own.select("id", "bytes"), min(1.0, wanted / max(total, 1)), buckets)

    blocked = own.select("doc", "id", F.crc32("bytes").alias("tag"), _block_column(F.col("id"), blocks).alias("block")).repartition(blocks, "block")
    suffixes = own.select("id", "bytes").mapInArrow(_spread(splitters), "bucket long, blob binary")
    shared = suffixes.groupBy("bucket").applyInArrow(lean(_shared(blocks)), CANDIDATES)
    around = blocked.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lean(_surroundings(splitters, text)), "bucket long, blob binary")
    spread = around.repartition(buckets, "bucket")
    settled = spread.groupBy("bucket").applyInArrow(lean(_settled(blocks)), CANDIDATES)
    edges = spread.groupBy("bucket").applyInArrow(lean(_edge_strings(buckets)), "bucket long, blob binary")
    spans = settled.unionByName(edges.groupBy("bucket").applyInArrow(lean(_compared(blocks)), CANDIDATES))
    kind = docs.schema.simpleString()
    return blocked.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(
        lean(_cut_out(text)), f"doc {kind}, n_bytes long, kept binary, removed_starts array<long>, removed_ends array<long>"
    )


def _splitters(texts: DataFrame, fraction: float, buckets: int) -> np.ndarray:
    """Sort keys that cut a sample of suffixes into equal parts; less than ``buckets`` of them.
    They only balance the work, any choice gives the same result."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lead, row, *_ in _suffixes_of(batch.column(1)):
                doc = batch.column(0).to_numpy()[row]
                pick = np.random.default_rng(len(doc)).random(len(doc)) < 0.25
                yield pa.RecordBatch.from_arrays([pa.array([k.ljust(LEAD + 8, b"\0") for k in _sort_keys(lead[pick], doc[pick]).tolist()], pa.binary())], names=["key"])

    rows = texts.sample(min(1.0, fraction * 4), seed=11).mapInArrow(keys, "key binary").toArrow().column("key").to_pylist()
    ordered = np.sort(np.array(rows, f"S{LEAD + 8}")) if rows else np.zeros(0, f"S{LEAD + 8}")
    at = np.linspace(0, len(ordered), buckets + 1)[1:-1].astype(int)
    return np.unique(ordered[at]) if len(ordered) else ordered
