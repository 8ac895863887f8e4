"""Joins that must neither send a growing side whole to every task nor give one task all rows."""

from pyspark.sql import functions as F

from shelfsift.operators.gaps import missing_episodes
from shelfsift.operators.titles import _ask


def test_guide_is_not_broadcast(spark):
    held = spark.createDataFrame([("a", 1, 2)], "show_key string, season int, number int")
    shows = spark.createDataFrame([("a", "A", 7)], "show_key string, show_name string, series_id int")
    guide = spark.createDataFrame([(7, 1, 3, 70)], "series_id int, season int, episode int, id int")
    titles = spark.createDataFrame([(70, "Three", 0)], "id int, title string, pos int")
    missing = missing_episodes(held, shows, guide, titles)
    plan = missing._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2
    assert [tuple(r)[:4] for r in missing.orderBy("number").collect()] == [("A", 1, 1, ""), ("A", 1, 3, "Three")]


def test_rows_that_ask_nothing_are_spread(spark):
    files = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 5, "The Title").alias("asked"))
    titles = spark.createDataFrame([(1, "The Title", "movie", 1999, ["Drama"], 0)], "id int, title string, type string, start_year int, genres array<string>, pos int")
    rows = _ask(files, F.col("asked"), titles)
    assert [r.id for r in rows.filter("_hit IS NOT NULL").collect()] == ["5"] and rows.count() == 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = _ask(files, F.col("asked"), titles).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in parts) < 500
