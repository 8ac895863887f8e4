"""Merging a listing and verifying titles, against plain Python."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from shelfsift.operators.ingest import detect_moves, merge_listing
from shelfsift.operators.titles import name_variants, store_title_index, title_index, verify_titles

FILES = "id string, full_path string, file_name string, extension string, size_bytes bigint, last_modified_utc bigint, sha256 string, hash_failed boolean, note string"
LISTING = "full_path string, size_bytes bigint, last_modified_utc bigint, pos bigint"


def _tables(seed):
    rng = random.Random(seed)
    path = lambda: f"/{rng.choice('abAB')}/{rng.choice('xyz')}{rng.randrange(6)}.mkv"
    files = []
    for k in range(25):
        p = path()
        files.append((f"f{k:02d}", p, p.rsplit("/", 1)[1], ".mkv", rng.randrange(3), rng.choice([None, 1, 2]), rng.choice(["", "aa"]), True, f"n{k}"))
    listing = [(path(), rng.randrange(3), rng.choice([None, 1, 2]), pos) for pos in rng.sample(range(100), 18)]
    return files, listing


def _plain(files, listing):
    once = {}
    for row in sorted(listing, key=lambda r: (r[3], r[0])):
        once.setdefault(row[0].upper(), row)
    held = {f[1].upper() for f in files}
    gone, came = defaultdict(list), defaultdict(list)
    for f in files:
        if f[1].upper() not in once and f[6] and f[5] is not None:
            gone[f[4], f[5]].append(f)
    for key, row in once.items():
        if key not in held and row[2] is not None:
            came[row[1], row[2]].append(row)
    moves = {v[0][0]: min(came[k], key=lambda r: (r[3], r[0])) for k, v in gone.items() if len(v) == 1 and came[k]}
    out, taken = [], {r[0].upper() for r in moves.values()}
    for f in files:
        row = moves.get(f[0]) or once.get(f[1].upper())
        if row is None:
            out.append((f[0], f[1], f[4], f[5], f[6], "unlisted", f[8]))
            continue
        status = "moved" if f[0] in moves else "kept" if (f[4], f[5]) == (row[1], row[2]) else "changed"
        out.append((f[0], row[0], row[1], row[2], "" if status == "changed" else f[6], status, f[8]))
    out += [(None, r[0], r[1], r[2], "", "added", None) for key, r in once.items() if key not in held and key not in taken]
    return sorted(out, key=repr), sorted((i, next(f[1] for f in files if f[0] == i), r[0]) for i, r in moves.items())


def test_merging_is_the_plain_one(spark):
    for seed in range(6):
        files, listing = _tables(seed)
        have, seen = spark.createDataFrame(files, FILES), spark.createDataFrame(listing, LISTING)
        rows, moves = _plain(files, listing)
        merged = merge_listing(have, seen).select("id", "full_path", "size_bytes", "last_modified_utc", "sha256", "status", "note").collect()
        assert sorted(map(tuple, merged), key=repr) == rows
        assert sorted(map(tuple, detect_moves(have, seen).collect())) == moves


def test_merging_empty_tables(spark):
    files, listing = _tables(1)
    none_held, none_listed = spark.createDataFrame([], FILES), spark.createDataFrame([], LISTING)
    assert merge_listing(none_held, none_listed).count() == 0
    assert {r.status for r in merge_listing(none_held, spark.createDataFrame(listing, LISTING)).collect()} == {"added"}
    assert {r.status for r in merge_listing(spark.createDataFrame(files, FILES), none_listed).collect()} == {"unlisted"}


def test_wide_rows_move_by_path_once(spark):
    """Of the exchanges that carry the catalogue's columns, one is by path key; the other moves only rows that met nothing."""
    files, listing = _tables(2)
    plan = merge_listing(spark.createDataFrame(files, FILES), spark.createDataFrame(listing, LISTING))._jdf.queryExecution().optimizedPlan().toString()
    # The join appears once for the rows that met and once for each side of the moves; Spark reuses its exchanges.
    assert "FullOuter" in plan and not re.search(r"Join (LeftAnti|LeftSemi|Cross)", plan)


TARGETS = "id string, full_path string, parsed_title string, confirmed_title string, kind string, video_category string, genres string, from_dataset boolean, from_online boolean, title_manual boolean"
TITLES = "id int, type string, title string, start_year int, end_year int, genres array<string>, pos bigint"


def _catalogue():
    rng = random.Random(8)
    names = ["Alpha", "Beta (2001)", "Gamma.Ray 1999", "Delta [x]", "Season 2", "B", "Nothing known", "lib"]
    rows = []
    for k in range(120):
        folders = "/".join(rng.choice(names) for _ in range(rng.randrange(0, 4)))
        rows.append((f"f{k:03d}", f"/lib/{folders}/{k}.mkv", rng.choice([*names, None, ""]), "", rng.choice(["Video", "Video", "Audio"]),
                     rng.choice(["Movie", "TvShow", "MovieExtra", "Unknown"]), rng.choice(["", "own"]), rng.random() < 0.1, False, False))
    titles = [(1, "movie", "Alpha", 1990, None, ["A"], 1), (2, "tvSeries", "alpha", 2000, None, [], 2), (3, "movie", "Beta", 2001, None, ["B", "C"], 3), (4, "movie", "gamma ray", None, None, [], 4)]
    cache = [("movie", " delta ", True, "Delta Found", 1), ("tv", "Delta", False, None, 2), (None, "B", True, "Old B", 3), ("tv", "season 2", True, "Second", 4)]
    return rows, titles, cache


def _variants(name):
    whole = re.sub(r"[._]", " ", name).strip(" ")
    stripped = re.sub(r"[(\[{][^)\]}]*[)\]}]\s*$", "", whole).strip(" ")
    undated = re.sub(r"[\s._-]+(?:19|20)\d{2}\s*$", "", stripped or whole).strip(" ")
    return [n for n in (whole, stripped, undated) if n]


def _verified(row, titles, cache):
    key = lambda t: re.sub(r"[^0-9a-z]", "", t.lower())
    index = {}
    for t in titles:
        index.setdefault(key(t[2]), t[2])
    if row[4] != "Video" or row[5] == "Unknown" or row[7]:
        return None, row[3]
    folders = [n for n in reversed(row[1].split("/")[:-1]) if n]
    late = [n for n in folders if len(n) <= 1 or re.match(r"(?i)^(season|series)\s*\d+$", n)]
    tried = [v for n in [row[2] or "", *[n for n in folders if n not in late], *late] for v in _variants(n)]
    for name in tried:
        if key(name) in index:
            return "dataset", index[key(name)]
    for name in tried:
        kinds = ["movie"] if row[5] in ("Movie", "MovieExtra") else ["tv", None]
        hit = next((c for k in kinds for c in cache if c[0] == k and c[1].strip().upper() == name.upper()), None)
        if hit is not None and hit[2]:
            return "online", hit[3]
    return "unresolved", row[3]


def test_verification_is_the_plain_one(spark):
    rows, titles, cache = _catalogue()
    files = spark.createDataFrame(rows, TARGETS)
    held = spark.createDataFrame(cache, "kind string, query string, found boolean, canonical_name string, pos bigint")
    expected = {r[0]: _verified(r, titles, cache) for r in rows}
    found = verify_titles(files, spark.createDataFrame(titles, TITLES), held).select("id", "outcome", "confirmed_title").collect()
    assert {r[0]: (r[1], r[2]) for r in found} == expected and len(found) == len(rows)
    without = verify_titles(files, spark.createDataFrame(titles, TITLES)).collect()
    assert {r.id: r.outcome for r in without} == {i: "unresolved" if o == "online" else o for i, (o, _) in expected.items()}


def test_variants_of_a_name(spark):
    for name in ("Alpha (2001)", "(2001)", "a_b.c 1999", "x [y] ", "  "):
        assert spark.range(1).select(name_variants(F.lit(name))).first()[0] == _variants(name)


def _below_joins(node, trail):
    """Of each bucketed scan, the operators between it and the join above."""
    name, children = node.nodeName(), node.children()
    if "Scan" in name and "Bucketed: true" in node.toString().split("\n")[0]:
        return [trail]
    below = [] if "SortMergeJoin" in name else [*trail, name]
    return [t for i in range(children.size()) for t in _below_joins(children.apply(i), below)]


def test_a_stored_index_stays_where_it_is(spark):
    """The bucketed index takes the titles' place, and no exchange moves it."""
    rows, titles, cache = _catalogue()
    index = store_title_index(spark.createDataFrame(titles, TITLES), "title_index_kept", 4)
    try:
        assert {tuple(r) for r in index.collect()} == {tuple(r) for r in title_index(spark.createDataFrame(titles, TITLES)).select(*index.columns).collect()}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = verify_titles(spark.createDataFrame(rows, TARGETS), None, index=index)
        assert {r.id: r.outcome for r in found.collect()} == {r[0]: _verified(r, titles, [])[0] for r in rows}
        trails = _below_joins(found._jdf.queryExecution().executedPlan(), [])
        assert trails and not any("Exchange" in name for trail in trails for name in trail), trails
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE title_index_kept")


def test_catalogue_queries_move_only_what_they_read(spark):
    """F27, F29, F30, F32, F34: one row a path was an aggregate of whole rows, which no query could narrow."""
    from __spark_entry__ import SMOKE_DIR, queries

    for name in ("detect_moves", "prune_missing", "adopt_listing", "scan_report", "merge_listing"):
        plan = queries()[name](spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "secondary_title" not in plan and "alternative_year" not in plan, name


def test_merge_listing_moves_the_catalogue_once(spark):
    """the search for moves read fewer columns, and so had the catalogue and the listing moved by path once more."""
    files, listing = _tables(3)
    rows = spark.createDataFrame(files, FILES).repartition(3), spark.createDataFrame(listing, LISTING).repartition(3)
    plan = merge_listing(*rows)._jdf.queryExecution().optimizedPlan()
    sides = {str(n.canonicalized()) for n in _nodes(plan) if "Join FullOuter" in n.toString().splitlines()[0]}
    assert len(sides) == 1


def _nodes(plan):
    inner = plan.children()
    return [plan, *[n for i in range(inner.size()) for n in _nodes(inner.apply(i))]]
