"""Near duplicates by Jaccard similarity of word shingles, found with signature trees.

Documents with equal shingle sets are one class; from there on classes are compared.

A node of a signature tree holds the OR of its members' shingle bitmaps, the range of their set
sizes and the largest number of shingles that share a bit with another one. Two nodes can hold a
linked pair only if the sizes can meet and

    min(common bits + shared shingles, sizes) >= t / (1 + t) * (sum of the least sizes)

so a dual traversal, level by level, leaves out all other pairs of nodes; at the leaves the bound
uses the bits that one side has and the other lacks. What is left is checked exactly.

One tree over all classes would put them in one task. So classes are routed to trees first: tree i
and the shingle that is least under hash function i. Two sets of similarity s meet in a tree of
function i with chance s; there are so many functions that a linked pair meets in none of its trees
with a chance below MISS at most: 12 for s >= 0.85, 14 for s >= 0.8.

A tree with more than TREE_ROWS classes is cut into slices, and every two slices meet in one cell, so a
task holds two slices. It gives a spanning forest of the pairs that the bounds leave, never the pairs. The forests
of all trees make loose groups: no link leads out of one. A group with more than TREE_ROWS classes or
GROUP_SHINGLES shingles is cut into slices, and every two slices meet in one cell. A cell has the sets
of its classes, counts the shingles that every two have in common, and gives each class's links there
and a spanning forest of them. So each pair of classes is checked exactly, once, and is never a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fingerprints import connected_components
from .common import give_back, slices, written

WORDS = 4
SIMILARITY = (85, 100)
MISS = 2e-10
TREE_ROWS = 1024
LEAF, FAN = 16, 8
#: Shingles of a slice of a loose group, about; and columns of its matrix that are held at once.
GROUP_SHINGLES = 1 << 20
COLUMNS = 2048
#: Pairs of a tree's nodes that are opened at once.
HELD = 1 << 16
#: Text bytes whose shingles a task holds at once.
SLICE_BYTES = 2 << 20
#: A class's bitmap has at least four bits a shingle, and a power of two: most shingles that one of two
#: sets lacks then show, and pairs a little below the similarity are left out without their sets.
LEAST_BITS = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _seeds(similarity: tuple[int, int]) -> np.ndarray:
    """One for each hash function that routes classes to trees."""
    part, whole = similarity
    routes = int(np.ceil(np.log(MISS) / np.log1p(-part / whole))) if part < whole else 1
    return np.random.default_rng(4242).integers(1, 1 << 63, routes, np.uint64) * np.uint64(2) + np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of all texts, sorted within each, and the size of each set. A text
    with fewer words is one shingle, one without words none."""
    split = [t.lower().split() for t in texts]  # bytes: lowers A-Z alone, splits at ASCII white space
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for s in split for w in s]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    own = hashes[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))] if flat else np.zeros(0, np.uint64)
    code = np.zeros(max(len(own) - words + 1, 0), np.uint64)
    for k in range(words):
        code = _stir(code * _MIX + own[k : len(own) - words + 1 + k]) if len(code) else code
    starts = np.cumsum(lengths) - lengths
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, (at, n) in enumerate(zip(starts, lengths, strict=True)):
        if n >= words:
            part = np.unique(code[at : at + n - words + 1])
        elif n:
            part = np.array([n], np.uint64)
            for k in range(n):
                part = _stir(part * _MIX + own[at + k])
        else:
            continue
        parts.append(part)
        sizes[i] = len(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def bitmap_bits(size: int) -> int:
    return max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(size * 4, 1)))))


def _sums(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    return np.add.reduceat(_stir(sets * _MIX), starts).view(np.int64), np.add.reduceat(_stir(sets + _MIX), starts).view(np.int64)


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices([len(x.as_buffer() or b"") for x in batch.column(1)], SLICE_BYTES):
            yield batch.slice(low, high - low)


def _signatures(words: int, seeds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_slices(batches):
            sets, sizes = shingle_sets([x.as_py() for x in batch.column(1)], words)
            starts = np.cumsum(sizes) - sizes
            some = sizes > 0
            at = starts[some]
            one, two = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            least: list = [None] * len(sizes)
            maps: list = [None] * len(sizes)
            if len(at):
                one[some], two[some] = _sums(sets, at)
                routes = np.stack([np.minimum.reduceat(_stir(sets * seed), at) for seed in seeds]).view(np.int64)
                for k, i in enumerate(np.flatnonzero(some)):
                    own = sets[starts[i] : starts[i] + sizes[i]]
                    bits = np.zeros(bitmap_bits(sizes[i]), bool)
                    bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)] = True
                    least[i], maps[i] = routes[:, k].tolist(), np.packbits(bits, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(one), pa.array(two), pa.array(least, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                names=["doc_id", "n_shingles", "one", "two", "least", "bits"],
            )
        give_back()

    return run


def _fold(bitmap: np.ndarray, width: int) -> np.ndarray:
    while len(bitmap) > width:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


def tree_pairs(sizes: np.ndarray, bitmaps: list[bytes], similarity: tuple[int, int] = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (the smaller set first) that the bounds of a signature tree leave. The sets of one
    width of bitmap are taken with the wider ones that they can meet, folded to that width, which
    keeps every bound valid."""
    part, whole = similarity
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order].astype(np.int64)
    widths = np.fromiter((len(bitmaps[i]) for i in order), np.int64, len(order))
    for width in np.unique(widths):
        low, wider = np.searchsorted(widths, width), np.searchsorted(widths, width, "right")
        high = np.searchsorted(part * ranked, whole * ranked[wider - 1], "right")
        if high - low < 2:
            continue
        own, n = order[low:high], ranked[low:high]
        bits = np.stack([_fold(np.frombuffer(bitmaps[i], np.uint8), width) for i in own]).view(np.uint64)
        for a, b in _traverse(n, bits, part, whole):
            new = a < wider - low
            yield own[a[new]], own[b[new]]


def _traverse(n: np.ndarray, bits: np.ndarray, part: int, whole: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = [(n, n, n - ones, bits)]
    fan = LEAF
    while len(levels[-1][0]) > 1:
        least, most, shared, held = levels[-1]
        cut = np.arange(0, len(least), fan)
        levels.append((np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(shared, cut), np.bitwise_or.reduceat(held, cut, axis=0)))
        fan = FAN
    # A stack of node pairs, deepest first, so that few of them are held at once.
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, a, b = stack.pop()
        if depth == 0:
            differ = a < b
            i, j = a[differ], b[differ]
            meet = whole * n[i] >= part * n[j]
            i, j = i[meet], j[meet]
            common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64)
            most = np.minimum(n[i] - ones[i] + common, n[j] - ones[j] + common)
            fits = (whole + part) * most >= part * (n[i] + n[j])
            yield i[fits], j[fits]
            continue
        a, b = _open(levels[depth], a, b, part, whole)
        fan = LEAF if depth == 1 else FAN
        below = len(levels[depth - 1][0])
        child = np.arange(fan)
        some = max(1, HELD // fan**2)
        for at in range(0, len(a), some):
            p, q = a[at : at + some], b[at : at + some]
            x, y = np.repeat(p * fan, fan * fan) + np.tile(np.repeat(child, fan), len(p)), np.repeat(q * fan, fan * fan) + np.tile(np.tile(child, fan), len(q))
            keep = (x < below) & (y < below) & (x <= y)
            stack.append((depth - 1, x[keep], y[keep]))


def _open(level: tuple, a: np.ndarray, b: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """The node pairs that may hold a linked pair."""
    least, most, shared, bits = level
    out: list[np.ndarray] = []
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64)
        overlap = np.minimum(common + np.minimum(shared[i], shared[j]), np.minimum(most[i], most[j]))
        meet = (whole * most[i] >= part * least[j]) & (whole * most[j] >= part * least[i])
        out.append(meet & ((whole + part) * overlap >= part * (least[i] + least[j])))
    keep = np.concatenate(out) if out else np.zeros(0, bool)
    return a[keep], b[keep]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs that join two groups; ``label`` has the group of each index and is brought up to date."""
    for at in range(0, len(i), 1 << 12):
        x, y = i[at : at + (1 << 12)], j[at : at + (1 << 12)]
        differ = label[x] != label[y]
        for k, m in zip(x[differ].tolist(), y[differ].tolist(), strict=True):
            if label[k] != label[m]:
                label[label == label[m]] = label[k]
                yield k, m


def _grouped(names: list[str], key: list[str], work) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on the rows of each key, which follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        last = None
        for batch in batches:
            columns = batch.to_pydict()
            keys = list(zip(*(columns[k] for k in key), strict=True))
            at = 0
            while at < len(keys):
                if keys[at] != last:
                    if len(held["id"]) > 1:
                        yield from work(held)
                    held, last = {c: [] for c in names}, keys[at]
                end = at + 1
                while end < len(keys) and keys[end] == last:
                    end += 1
                for c in names:
                    held[c] += columns[c][at:end]
                at = end
        if len(held["id"]) > 1:
            yield from work(held)
        held.clear()
        give_back()

    return run


def _forest(similarity: tuple[int, int]):
    """Rows of a tree to the pairs of classes that span what its bounds leave."""

    def forest(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        ids = np.array(rows["id"], np.int64)
        label = np.arange(len(ids))
        edges = [e for i, j in tree_pairs(np.array(rows["n"], np.int64), rows["bits"], similarity) for e in _joined(label, i, j)]
        if edges:
            ends = ids[np.array(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])

    return forest


def _candidates(trees: DataFrame, bitmaps: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs that span what the trees leave. ``trees`` has tree and id; ``bitmaps`` id, n and bits,
    which join last, so that they move once to each cell of their tree."""
    large = trees.groupBy("tree").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > TREE_ROWS)
    parts = trees.join(large.select("tree", F.ceil(F.col("rows") / TREE_ROWS).alias("parts")), "tree", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cell = ["tree", "low", "high"]
    filled = _sliced(parts, "tree", F.col("parts")).join(bitmaps, "id").select(*cell, "id", "n", "bits")
    placed = filled.repartition(*cell).sortWithinPartitions(*cell, "id")
    return placed.mapInArrow(_grouped([*cell, "id", "n", "bits"], cell, _forest(similarity)), "a long, b long").distinct()


def _wide(record: bytes) -> np.ndarray:
    own = np.zeros((len(record) // 6, 8), np.uint8)
    own[:, :6] = np.frombuffer(record, np.uint8).reshape(-1, 6)
    return own.view("<u8").ravel()


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each of the ``left`` sets has in common with each of the ``right`` ones."""
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    several = counts[place] > 1
    column, row = (np.cumsum(counts > 1) - 1)[place[several]], row[several]
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    out = np.zeros((len(left), len(right)))
    starts = np.arange(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS)
    for start, low, high in zip(starts, np.searchsorted(column, starts), np.searchsorted(column, starts + COLUMNS), strict=True):
        has = np.zeros((len(sets), int(column[high - 1]) + 1 - start), np.float32)
        has[row[low:high], column[low:high] - start] = 1
        out += has[left] @ has[right].T
    return out


def _cell(similarity: tuple[int, int]):
    """Rows of two slices of a loose group, or of one, to (id, a class it hangs together with, links)."""
    part, whole = similarity

    def cell(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        # A class may come from several documents.
        ids, first = np.unique(np.array(rows["id"], np.int64), return_index=True)
        own = np.array(rows["own"])[first]
        alone = rows["low"][0] == rows["high"][0]
        left, right = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(own == rows[k][0]) for k in ("low", "high"))
        sets = [_wide(rows["set"][i]) for i in first]
        n = np.array([len(x) for x in sets])
        common = _common(sets, left, right)
        linked = whole * common >= part * (n[left][:, None] + n[right] - common)
        if alone:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), np.int64)
        links[left] = linked.sum(axis=1)
        links[right] = linked.sum(axis=0)
        label = np.arange(len(ids))
        i, j = np.nonzero(linked)
        for _ in _joined(label, left[i], right[j]):
            pass
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(links[some])], names=["id", "root", "links"])

    return cell


def _sliced(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """Rows with own (a slice), low and high (the slices of a cell), once for each cell of ``key`` with the slice."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("id", key), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    return own.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")


def _set_rows(words: int):
    """(id, bytes, wanted columns) to (id, set, wanted columns), where the text has the class's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices([len(x.as_buffer() or b"") for x in batch.column("bytes")], SLICE_BYTES):
                some = batch.slice(low, high - low)
                sets, sizes = shingle_sets([x.as_py() for x in some.column("bytes")], words)
                ends = np.cumsum(sizes)
                # Six bytes of a shingle tell the ones of two sets apart.
                six = sets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                one, two = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                if len(sets):
                    one[sizes > 0], two[sizes > 0] = _sums(sets, (ends - sizes)[sizes > 0])
                kept = {"n_shingles": pa.array(sizes), "one": pa.array(one), "two": pa.array(two), "set": pa.array([six[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())}
                yield pa.RecordBatch.from_pydict(kept | {c: some.column(c) for c in ("id", "component", "parts")})
        give_back()

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(doc_id, class_id, n_shingles, links, component_id), a row a document.

    Documents link if 100 * intersection >= 85 * union of their sets of shingles of ``words`` words. ``class_id`` is the
    same for equal sets, ``links`` is the number of other classes that link with the document's
    one, ``component_id`` the smallest document id reachable by links, itself included (null ids
    are passed over). Null text and texts without words have an empty set, no class and link with
    nothing. Repeated rows are in one class. An empty table gives an empty result.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    signed = written(
        plain.mapInArrow(_signatures(words, _seeds(similarity)), "doc_id long, n_shingles long, one long, two long, least array<long>, bits binary"), "shingles"
    ).withColumn("id", F.when(F.col("n_shingles") > 0, F.xxhash64("n_shingles", "one", "two")))
    members = signed.filter("id IS NOT NULL")
    classes = members.groupBy("id").agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("n"), F.min(F.struct("doc_id", "one", "least", "bits")).alias("x"))
    classes = written(classes.select("id", "label", "n", "x.least", "x.bits"), "classes")
    routed = classes.select("id", F.posexplode("least").alias("i", "shingle")).withColumn("tree", F.xxhash64("i", "shingle"))
    # Most trees have one class and nothing to compare.
    several = routed.groupBy("tree").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("tree")
    trees = written(routed.select("tree", "id").join(several, "tree"), "trees")

    bitmaps = classes.select("id", "n", "bits")
    forest = written(_candidates(trees, bitmaps, similarity), "forest")
    loose = connected_components(forest.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    loose = written(loose.join(classes.select("id", "n"), "id"), "loose")
    # Sets of the classes that any tree leaves a pair of, from one document of each.
    parts = F.least(F.count(F.lit(1)), F.greatest(F.ceil(F.count(F.lit(1)) / TREE_ROWS), F.ceil(F.sum("n") / GROUP_SHINGLES)))
    wanted = loose.join(loose.groupBy("component").agg(parts.alias("parts")), "component").select("id", "component", "parts")
    sources = members.groupBy("id").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-1))).alias("source")).join(wanted, "id")
    texts = plain.withColumn("source", F.coalesce(F.col("doc_id"), F.lit(-1))).select("source", "bytes")
    found = texts.join(sources, "source").select("id", "bytes", "component", "parts")
    found = found.mapInArrow(_set_rows(words), "n_shingles long, one long, two long, set binary, id long, component long, parts long")
    # Rows with one document id may have different texts: only those of the class are its set.
    sets = found.filter(F.col("id") == F.xxhash64("n_shingles", "one", "two")).select("id", "component", "parts", "set")
    cell = ["component", "low", "high"]
    dealt = _sliced(sets, "component", F.col("parts")).select(*cell, "own", "id", "set").repartition(*cell).sortWithinPartitions(*cell, "id")
    linked = written(dealt.mapInArrow(_grouped([*cell, "own", "id", "set"], cell, _cell(similarity)), "id long, root long, links long"), "links")
    reach = connected_components(linked.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    counted = linked.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("id", "label").join(reach, "id", "left").select("id", "label", F.coalesce("component", "id").alias("component"))
    smallest = named.groupBy("component").agg(F.min("label").alias("component_id"))
    facts = named.select("id", "component").join(smallest, "component").join(counted, "id", "left").select("id", "component_id", "links")
    return signed.join(facts, "id", "left").select(
        "doc_id", F.col("id").alias("class_id"), "n_shingles", F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
