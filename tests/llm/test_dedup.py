"""Suffix-array removal and the Jaccard join against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfsift.llm import jaccard_join, suffix_dedup
from shelfsift.llm.jaccard_join import near_duplicates
from shelfsift.llm.suffix_dedup import LAST_ID, LENGTH, remove_repeats


def removal(rows):
    """(id, kept bytes) of each row by looking up every string."""
    key = lambda r: LAST_ID if r[0] is None else r[0]
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - LENGTH + 1):
            s = b[i : i + LENGTH]
            first[s] = min(first.get(s, LAST_ID), key(r))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - LENGTH + 1):
            if first[b[i : i + LENGTH]] < key(r):
                gone[i : i + LENGTH] = True
        turns = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(b), np.frombuffer(b, np.uint8)[~gone].tobytes(), turns))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r.doc.doc_id, r.n_bytes, bytes(r.kept), len(r.removed_starts)) for r in remove_repeats(df).collect()), key=repr)


def test_a_long_range_of_equal_suffixes_is_compared_in_little_memory():
    """Pipeline of round 3: prefix sums took some 2 KB a suffix, and a range is compared as a whole."""
    n = 40_000
    rng = np.random.default_rng(3)
    seen = np.tile(rng.integers(1, 200, suffix_dedup._WIDTH, np.uint8), (n, 1))
    seen[1::2, :3] += 1  # every other one differs where only the farthest strings reach
    blob = suffix_dedup._write(seen, np.arange(n, dtype="<i8"), np.zeros(n, "<u4"), np.full(n, 40, "<u4"), np.zeros(n, np.uint8), np.full(n, suffix_dedup.REACH, np.uint8))
    table = pa.table({"bucket": pa.array([0]), "blob": pa.array([blob], pa.binary())})
    tracemalloc.start()
    made = suffix_dedup._settled(3)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    doc, _, begin, end = suffix_dedup._read(made.column("blob").to_pylist(), *suffix_dedup._SPANS)
    found = sorted(zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True))
    # The first document of all is nobody's copy, the second only as far as it equals the first.
    assert found[0] == (1, 40 - suffix_dedup.REACH + 3, 40 + LENGTH)
    assert found[1:] == [(d, 40 - suffix_dedup.REACH, 40 + LENGTH) for d in range(2, n)]
    assert peak < 700 * n


def test_removal_equals_brute_force(edge, edge_rows):
    assert removed(edge) == removal(edge_rows)


def test_removal_with_ranges_over_many_buckets(make, monkeypatch):
    """Small buckets: hot strings go over several of them and meet at their edges."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", 40)
    passage = "The passage that every document of this table holds somewhere, in one place or another. "
    rows = [(i, f"{i} unlike beginnings {i * i} " * (1 + i % 3) + passage + f"{i % 7} end", "en", "a") for i in range(120)]
    assert removed(make(rows)) == removal(rows)


def test_removal_of_nothing(empty):
    assert removed(empty) == []


def test_removal_keeps_whole_rows(edge):
    assert set(remove_repeats(edge).select("doc.*").columns) == set(edge.columns)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=220).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=6))
def test_every_string_chooses_one_suffix_by_content(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    at, near, far = suffix_dedup.chosen_suffixes(data, ends - [len(t) for t in texts], ends)
    chosen = {}
    for p, low, high in zip(at.tolist(), near.tolist(), far.tolist(), strict=True):
        for shift in range(low, high + 1):
            assert p - shift not in chosen
            chosen[p - shift] = shift
    strings = {}
    for end, t in zip(ends.tolist(), texts, strict=True):
        for i in range(len(t) - LENGTH + 1):
            s = end - len(t) + i
            assert chosen[s] == strings.setdefault(t[i : i + LENGTH], chosen[s])
    assert len(chosen) == sum(max(0, len(t) - LENGTH + 1) for t in texts)


def test_multikey_order_sorts_by_all_words():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(2)]
    order, begins = suffix_dedup.multikey_order(words)
    pairs = [(int(words[0][i]), int(words[1][i])) for i in order]
    assert pairs == sorted(pairs)
    assert [pairs[b] for b in begins] == sorted(set(pairs))


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]))
    return sorted(out, key=repr)


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=repr)


def test_join_equals_brute_force(edge, edge_rows):
    assert joined(edge) == components(edge_rows)


def chain_rows():
    """Copies that each differ from the one before: a chain with ends that do not link."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        words[3 * k % 120] = f"new{k}"
        rows.append((k, " ".join(words), "en", "a"))
    return rows + [(100 + k, " ".join(words[:60] + [f"other{k}"] + words[61:]), "en", "a") for k in range(30)]


@pytest.mark.parametrize("tree_rows", [4096, 8])
def test_join_of_a_large_group(make, monkeypatch, tree_rows):
    monkeypatch.setattr(jaccard_join, "TREE_ROWS", tree_rows)
    rows = chain_rows()
    assert joined(make(rows)) == components(rows)


def test_join_of_nothing(empty):
    assert joined(empty) == []


def counted(rows):
    """(id, size, links) of each row: the other sets that are similar enough."""
    sets = [frozenset(shingles(r[1])) for r in rows]
    kinds = {s for s in sets if s}
    count = {s: sum(s != t and 100 * len(s & t) >= 85 * len(s | t) for t in kinds) for s in kinds}
    return sorted(((r[0], len(s), count.get(s, 0)) for r, s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize(("tree_rows", "shingles_each"), [(4096, 1 << 20), (8, 1 << 20), (4096, 700)])
def test_links_inside_a_group_are_counted(make, edge_rows, monkeypatch, tree_rows, shingles_each):
    monkeypatch.setattr(jaccard_join, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", shingles_each, raising=False)
    rows = chain_rows() + [(1000 + (r[0] or 0), *r[1:]) for r in edge_rows]
    found = near_duplicates(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.links) for r in found), key=repr) == counted(rows)
    assert max(r.links for r in found) > 25


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 90), min_size=1, max_size=60), min_size=2, max_size=60))
def test_trees_leave_every_linked_pair(sets):
    sizes, maps = np.array([len(s) for s in sets]), []
    for s in sets:
        bits = np.zeros(jaccard_join.bitmap_bits(len(s)), bool)
        bits[[hash((x, 7)) % len(bits) for x in s]] = True
        maps.append(np.packbits(bits, bitorder="little").tobytes())
    left = {frozenset(p) for i, j in jaccard_join.tree_pairs(sizes, maps) for p in zip(i.tolist(), j.tolist(), strict=True)}
    linked = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert linked <= left


def test_a_hot_tree_is_dealt_in_slices(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TREE_ROWS", 16)
    seen = spark.sparkContext.accumulator(0)
    rows = [(7, i, 40, bytes([i % 256, 255]) + bytes(30)) for i in range(100)]
    cells = jaccard_join._grouped

    def watched(names, key, work):
        def held(rows):
            seen.add(len(rows["id"]) > 60)
            return work(rows)

        return cells(names, key, held)

    monkeypatch.setattr(jaccard_join, "_grouped", watched)
    trees = spark.createDataFrame([r[:2] for r in rows], "tree long, id long")
    bitmaps = spark.createDataFrame([r[1:] for r in rows], "id long, n long, bits binary")
    found = jaccard_join._candidates(trees, bitmaps, (85, 100)).collect()
    # All are in reach of each other, and still no task has the tree and the result is no list of all pairs.
    assert seen.value == 0 and len(found) < 1000
    near = {i: {i} for i in range(100)}
    for a, b in found:
        whole = near[a] | near[b]
        for k in whole:
            near[k] = whole
    assert len(near[0]) == 100


def test_a_short_set_does_not_blunt_the_bitmaps_of_long_ones():
    rng = np.random.default_rng(3)
    sizes = np.array([4 * 1.1**k for k in range(60)], np.int64)
    maps = []
    for n in sizes:
        bits = np.zeros(jaccard_join.bitmap_bits(n), bool)
        bits[rng.integers(0, len(bits), n)] = True
        maps.append(np.packbits(bits, bitorder="little").tobytes())
    assert sum(len(i) for i, _ in jaccard_join.tree_pairs(sizes, maps)) < 10
