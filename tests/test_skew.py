"""Hot keys: split plans must give what the plain plan gives."""

import random

from pyspark.sql import functions as F

from shelfsift.operators.duplicates import exact_duplicates
from shelfsift.operators.skew import _fold_hot, first_by, fold, ranked
from shelfsift.operators.survivorship import RuleStep, choose_by_rules

VERDICT = "CASE WHEN f1.v - f2.v > 2 THEN 1 WHEN f2.v - f1.v > 2 THEN 2 WHEN f1.w > f2.w THEN 1 WHEN f2.w > f1.w THEN 2 ELSE 0 END"


def rows(seed, n=400, ties=True):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", i, f"id{i}", rng.randrange(60), rng.randrange(30 if ties else 10 ** 6)) for i in range(n)]


def brute(data):
    groups = {}
    for key, at, ident, v, w in sorted(data, key=lambda r: r[1]):
        groups.setdefault(key, []).append((ident, v, w))
    out = {}
    for key, items in groups.items():
        best, undecided = items[0], False
        for nxt in items[1:]:
            if abs(best[1] - nxt[1]) > 2:
                best = best if best[1] > nxt[1] else nxt
            elif best[2] != nxt[2]:
                best = best if best[2] > nxt[2] else nxt
            else:
                undecided = True
                break
        out[key] = (best[0], undecided, len(items))
    return out


def test_ranked_hot_equals_plain(spark):
    df = spark.createDataFrame(rows(1), "k string, at int, id string, v int, w int")
    plain = {(r.k, r.id): r.n for r in ranked(df, ["k"], ["v", "id"], "n", limit=10 ** 6).collect()}
    split = {(r.k, r.id): r.n for r in ranked(df, ["k"], ["v", "id"], "n", limit=5).collect()}
    assert split == plain and len(plain) == 400


def test_ranked_takes_null_keys_as_one_key(spark):
    data = [(None if i % 3 else "a", i % 2 or None, i) for i in range(120)]
    df = spark.createDataFrame(data, "k string, j int, v int")
    want = {}
    for k, j, v in data:
        want[v] = sum((a, b) == (k, j) and x <= v for a, b, x in data)
    for limit in (5, 10 ** 6):
        got = ranked(df, ["k", "j"], ["v"], "n", limit=limit)
        assert got.columns == ["k", "j", "v", "n"] and {r.v: r.n for r in got.collect()} == want


def test_ranked_runs_its_input_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    df = spark.range(200, numPartitions=4).withColumn("k", F.col("id") % 3).mapInPandas(count, "id long, k long")
    for limit in (5, 10 ** 6):
        before = runs.value
        assert ranked(df, ["k"], ["id"], "n", limit=limit).count() == 200
        assert runs.value - before == 200


def test_fold_hot_equals_brute_force(spark):
    for seed, ties in ((2, True), (3, False), (4, False)):
        data = rows(seed, ties=ties)
        df = spark.createDataFrame(data, "k string, at int, id string, v int, w int")
        expected = brute(data)
        for limit, chunk in ((10 ** 6, 10 ** 6), (20, 7)):
            got = {r.k: (r.winner.id, r.undecided, r.copies) for r in fold(df, ["k"], ["at"], ["id", "v", "w"], VERDICT, limit=limit, chunk=chunk).collect()}
            assert {k: (v if not v[1] else (v[1], v[2])) for k, v in got.items()} == {k: (v if not v[1] else (v[1], v[2])) for k, v in expected.items()}


def test_fold_of_a_rising_hot_key(spark):
    df = spark.range(300).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.col("id").cast("string").alias("id"), (F.col("id") * 10).alias("v"), F.lit(0).alias("w"))
    row = fold(df, ["k"], ["at"], ["id", "v", "w"], VERDICT, limit=20, chunk=50).first()
    assert (row.winner.id, row.undecided, row.copies) == ("299", False, 300)


def _one_key(spark, values):
    rows = spark.createDataFrame([("hot", i, v, 0) for i, v in enumerate(values)], "k string, at int, v bigint, w int")
    return rows.select("k", F.struct("at").alias("_order"), F.struct(F.col("at").cast("string").alias("id"), "v", "w").alias("_item"))


def test_passes_over_a_hot_key_do_not_grow_with_it(spark):
    """Rising: every segment hands on by its summary. Falling: one pass finds that the first row stands.
    One peak in the middle of a segment: found, folded from there, and it stands."""
    for n in (400, 4000):
        rising = [10 * i for i in range(n)]
        falling = rising[::-1]
        peak = [0] + [10 + 3 * (i % 2) for i in range(n - 1)]
        peak[n // 2 + 3] = 10 ** 6
        for values, winner, passes in ((rising, n - 1, 1), (falling, 0, 2), (peak, n // 2 + 3, 3)):
            folded, done = _fold_hot(_one_key(spark, values), ["k"], "CASE WHEN f1.v - f2.v > 2 THEN 1 WHEN f2.v - f1.v > 2 THEN 2 ELSE 1 END", 40)
            row = folded.first()
            assert (row.winner.id, row.undecided, row.copies) == (str(winner), False, n) and done <= passes, (n, done)


def test_first_by_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, n int, t string")
    assert {r.k: (r.n, r.t) for r in first_by(df, ["k"], ["n"]).collect()} == {"a": (1, "y"), "b": (1, None)}


def copies(spark, items):
    base = [("c", i, f"f{i}", f"/x/f{i}.mkv", "Video", q, d, s, integrity) for i, (q, d, s, integrity) in enumerate(items)]
    return spark.createDataFrame(base, "k string, ord int, id string, full_path string, kind string, quality int, duration_seconds double, size_bytes bigint, integrity string").withColumn(
        "file_name", F.lit("f.mkv"))


def test_rule_steps(spark):
    from shelfsift.operators.survivorship import BUILT_IN_STEPS

    cases = [
        ([(720, 6000.0, 1000, "Ok"), (1080, 6000.0, 1000, "Ok")], BUILT_IN_STEPS, "f1"),
        ([(1080, 6000.0, 1000, "Ok"), (1080, 6030.0, 1000, "Ok")], BUILT_IN_STEPS, "f1"),
        ([(1080, 6000.0, 1000, "Ok"), (1080, 6000.3, 900, "Ok")], BUILT_IN_STEPS, "f1"),
        ([(2160, 6000.0, 1000, "Corrupt"), (480, 6000.0, 1000, "Ok")], BUILT_IN_STEPS, "f1"),
        ([(1080, 6000.0, 1000, "Ok"), (1080, 6000.0, 1000, "Ok")], BUILT_IN_STEPS, None),
        ([(0, 6000.0, 1000, "Ok"), (1080, 6000.0, 1000, "Ok")], (RuleStep("Quality"),), None),
        ([(1080, 6000.0, 1000, "Ok")], (RuleStep("Quality"),), "f0"),
        ([(1080, 6000.0, 1000, "Ok"), (720, 0.0, 1, "Ok")], (), None),
    ]
    for items, steps, expected in cases:
        assert choose_by_rules(copies(spark, items), ["k"], steps).first().winner_id == expected, (items, steps)


def test_exact_duplicates_takes_first_member_by_path(spark):
    df = spark.createDataFrame([("a", "/b", "AB", 5), ("b", "/a", "ab", 7), ("c", "/c", "", 9), ("d", "/d", "ff", 1)], "id string, full_path string, sha256 string, size_bytes bigint")
    assert [tuple(r) for r in exact_duplicates(df).select("hash_key", "copies", "reclaimable", "first_path").collect()] == [("AB", 2, 7, "/a")]


def test_first_by_carries_columns_of_its_order_once(spark):
    """order and row were two structs, and both held the order's columns."""
    from shelfsift.operators.skew import first_by
    from shelfsift.operators.survivorship import prefer_library_copy

    rows = spark.createDataFrame(
        [("k", 2, 7, "b", "x", None), ("k", 1, 9, "c", None, 5), ("k", 1, 9, "a", "z", 6), (None, 3, None, "d", "y", 7), (None, 3, 1, "e", "y", 8)],
        "key string, library_rank int, ord bigint, id string, note string, n int",
    )
    whole = first_by(rows, ["key"], ["library_rank", "ord", "id"])
    assert whole.columns == ["key", "library_rank", "ord", "id", "note", "n"]
    assert sorted(map(tuple, whole.collect()), key=str) == [("k", 1, 9, "a", "z", 6), (None, 3, None, "d", "y", 7)]
    few = prefer_library_copy(rows, ["key"], columns=["id", "library_rank"])
    assert sorted(map(tuple, few.collect()), key=str) == [("k", "a", 1), (None, "d", 3)]
    moved = [line for line in few._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_min" in line]
    assert moved and not any("note" in line or "min_by" in line for line in moved)
    by_column = first_by(rows, ["key"], [-F.col("library_rank"), "ord", "id"])
    assert sorted((r.key or "", r.id) for r in by_column.collect()) == [("", "d"), ("k", "b")]
    mapped = rows.withColumn("m", F.create_map("id", "n"))
    assert sorted((r.key or "", r.m["a"] if r.key else r.m["d"]) for r in first_by(mapped, ["key"], ["library_rank", "ord", "id"]).collect()) == [("", 7), ("k", 6)]
