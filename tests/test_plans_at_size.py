"""Planning steps whose cost has to stay in proportion to the rows."""

import pytest
from pyspark.sql import functions as F

from shelfsift.functions.staging import staged
from shelfsift.functions.text import digits_value, is_blank, sanitize
from shelfsift.functions.paths import base_name, slashed
from shelfsift.operators.categories import effective_category
from shelfsift.plans import destinations as P
from shelfsift.plans.suggestions import suggest_consolidation
from shelfsift.testtables import files

SF = "/root/testdata/sf0.001"
LIBRARY = P.Library((P.Category("TvShow", "/lib"), P.Category("Movie", "/lib/films/")))


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_staged_values_are_computed_below_the_generator(spark):
    df = staged(spark.range(3).withColumn("x", F.col("id") + 1), {"y": F.col("x") * 2})
    assert "inline(array(_staged" in plan_of(df)
    assert sorted(map(tuple, df.collect())) == [(0, 1, 2), (1, 2, 4), (2, 3, 6)]


def test_suggestions_are_planned_before_they_move(spark):
    rows = files(spark, SF).withColumn("category", effective_category())
    plan = plan_of(suggest_consolidation(rows, LIBRARY, files(spark, SF)))
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join Inner" in line and "_identity" in line]
    planned = [i for i, line in enumerate(plan.splitlines()) if "planned_name" in line and "inline" in line]
    # Lines further down run earlier.
    assert joins and planned and min(planned) > joins[0]


@pytest.mark.parametrize("number, text", [(-12, "-12"), (-5, "-5"), (0, "00"), (9, "09"), (10, "10"), (123, "123"), (None, None)])
def test_two_digits(spark, number, text):
    assert spark.range(1).select(P.two_digits(F.lit(number).cast("int"))).first()[0] == text


def test_texts_are_read_as_before(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for text, blank in (("", True), (None, True), (" \t\u2003\n", True), (" a ", False)):
        assert one(is_blank(F.lit(text).cast("string"))) is blank
    for text, value in (("", None), ("07", 7), (None, None)):
        assert one(digits_value(F.lit(text).cast("string"))) == value
    for text, name in (("a\\b/c.mkv", "c.mkv"), ("a/b\\", ""), ("plain", "plain"), ("", ""), ("x/\u00e9\U0001f600 y", "\u00e9\U0001f600 y")):
        assert one(base_name(F.lit(text))) == name
    assert one(slashed(F.lit("a\\b/c"))) == "a/b/c"
    for text, name in (("a  b", "a b"), ("a\tb", "a b"), ("a \t b. .", "a b"), (" a: b ", "a b")):
        assert one(sanitize(F.lit(text))) == name


def test_subtitle_tags(spark):
    stem = "Show S01E02"
    tags = {".en": True, "": True, " 2": False, "_forced-nl": True, "." + "x" * 31: True, "." + "x" * 32: False, "..en": True, ".2.en": False}
    subs = spark.createDataFrame([(f"/d/{stem}{tag}.srt",) for tag in tags], "full_path string")
    videos = spark.createDataFrame([("v", f"/D/{stem}.mkv"), ("w", "/d/Show.mkv"), ("z", "/d/.mkv")], "id string, full_path string")
    found = {(r.id, r.suffix) for r in P.subtitle_companions(videos, subs).collect()}
    assert {s for i, s in found if i == "v"} == {tag for tag, known in tags.items() if known}
    assert {s for i, s in found if i == "w"} == {" S01E02" + tag for tag in tags if len(tag) < 26}
