"""How often rows move, and what of them."""

import pytest
from pyspark.sql import functions as F

from shelfsift.functions.text import packed
from shelfsift.operators.survivorship import PairRule, RuleStep, policy_columns

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan_of(spark):
    from shelfsift.registered import load_all

    queries = load_all()[0]
    return lambda name: queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def moves(plan: str, key: str) -> int:
    return plan.count(f"Exchange hashpartitioning({key}")


def test_packed_keys_are_equal_where_keys_are(spark):
    keys = ["AB12", "ab12", "AB1", "#AB12", "", "AB12\n", None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", packed("k").alias("p")).collect()
    assert bytes(rows[0].p.hash) == b"\xab\x12" and rows[0].p.text is None
    assert [r.p.text for r in rows[1:]] == keys[1:] and not any(r.p.hash for r in rows[1:])


def test_settled_jobs_move_by_content_and_by_job(plan_of):
    assert moves(plan_of("settle_jobs"), "job_key") == 2


def test_rules_carry_what_they_name():
    steps = {"A": ((), (RuleStep("Size"), RuleStep("Length"))), "B": ((PairRule("f1.sound AND f1.`file_name` < f2.file_name", "keep1"),), ())}
    assert sorted(policy_columns(steps)) == ["file_name", "sound", "v0_0", "v0_1"]
    assert {"full_path", "frames", "size"} <= set(policy_columns({"B": ((PairRule("f1 = f2", "keep1"),), ())}))


def test_doomed_files_are_planned_once(plan_of):
    assert plan_of("doomed_files").count("planned_dir") == plan_of("settle_jobs").count("planned_dir") > 0


def test_title_duplicates_are_settled_without_stored_rows(plan_of):
    plan = plan_of("settle_title_duplicates")
    assert moves(plan, "title_group") + moves(plan, "job_key") == 2


def test_twins_move_by_episode_alone(plan_of):
    for name in ("resolve_episode_conflicts", "settle_episode_rivals"):
        plan = plan_of(name)
        assert moves(plan, "_hash") == 1 and not moves(plan, "id") and "planned" not in plan


def test_conflicts_of_some_files(spark):
    from shelfsift.plans import jobs as J
    from shelfsift.registered.planning import LIBRARY, P, _fingerprinted

    rows = _fingerprinted(spark, SF).withColumn("under_root", P.under_library(LIBRARY.roots()))
    some = rows.filter("ord % 4 = 1")
    due = {r.id for r in some.select("id").collect()}
    every = {tuple(r) for r in J.resolve_episode_conflicts(rows, rows, LIBRARY).collect()}
    # Listed twice, a file is still to be filed once.
    assert sorted(map(tuple, J.resolve_episode_conflicts(rows, some.union(some), LIBRARY).collect())) == sorted(r for r in every if r[0] in due)


def test_neighbours_move_by_title(plan_of):
    plan = plan_of("are_copies_by_mode")
    assert moves(plan, "parsed_title") == 1 and "rangepartitioning" not in plan


def test_copies_that_lie_by_content_stay_there(spark):
    from shelfsift.operators.edits import CONTENT, content_place, propagate_duplicate_metadata
    from shelfsift.testtables import files

    rows = files(spark, SF)
    placed = propagate_duplicate_metadata(rows.withColumn(CONTENT, content_place()))
    assert moves(placed._jdf.queryExecution().executedPlan().toString(), CONTENT) == 1
    assert sorted(map(repr, placed.collect())) == sorted(map(repr, propagate_duplicate_metadata(rows).collect()))


def test_names_are_read_once(plan_of):
    assert "_masked" not in plan_of("renumber_catalogue")


def test_refresh_writes_rows_once_before_titles(spark, monkeypatch):
    from shelfsift.plans import refresh
    from shelfsift.registered.folders import rules
    from shelfsift.testtables import files

    written = []
    monkeypatch.setattr(refresh, "stored", lambda df: written.append(df) or df)
    refresh.refresh_catalog(files(spark, SF), [], [], rules(spark, SF), rules(spark, SF), 2026)
    assert len(written) == 1


def test_years_and_genres_ask_once(spark):
    from shelfsift.operators import titles as T
    from shelfsift.registered.titles import titles
    from shelfsift.testtables import files

    rows, known = files(spark, SF).withColumn("year", F.when(F.col("ord") % 3 > 0, F.col("year"))), titles(spark, SF)
    both = T.fill_years_and_genres(rows, known)
    assert sorted(map(repr, both.collect())) == sorted(map(repr, T.fill_genres(T.fill_years(rows, known), known).collect()))


def test_flags_move_digests(spark):
    from shelfsift.operators.categories import effective_category
    from shelfsift.operators.duplicates import duplicate_flags
    from shelfsift.testtables import files

    rows = files(spark, SF)
    plan = duplicate_flags(rows, rows.filter("ord % 5 = 0"), effective_category())._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join LeftOuter" in line and "_content" in line]
    # What comes out of the join by content stands above it.
    assert len(joins) == 1 and not any("sha256" in line or "title_group" in line for line in plan[:joins[0] + 1])
