"""Building blocks that stay whole when one key holds a large share of the rows.

* ``first_by`` / ``last_by`` pick one row per key by aggregation, so a hot key is combined on the
  map side instead of being sorted in one task.
* ``ranked`` numbers the rows of each key. The input runs once, into a checkpoint. Ordinary keys go
  through a window; a hot key, null ones too, is range partitioned on (key, order), which spreads it
  over tasks, and numbered by offsets.
* ``fold`` runs a left fold over the rows of each key in order. The input runs once, into a
  checkpoint of the few columns a fold needs. Ordinary keys are folded in one array; a hot key is cut
  into segments that are folded side by side, each from its own first row, and the state is handed
  on from segment to segment over these summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, hot_rows, stored

FOLD_CHUNK = 10_000


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the smallest ``order`` per key. Columns of the order are carried once, not as order and as row."""
    kept = [c for c in (columns or df.columns) if c not in keys]
    named = {c: i for i, c in enumerate(order) if isinstance(c, str)}
    rest = [c for c in kept if c not in named]
    placed = [F.col(c).alias(f"_at{i}") if isinstance(c, str) else c.alias(f"_at{i}") for i, c in enumerate(order)]
    back = [F.col(f"_row._at{named[c]}").alias(c) if c in named else F.col("_row._rest")[c].alias(c) for c in kept]
    if not rest:
        chosen = F.min(F.struct(*placed))
    elif any(_holds_map(df.schema[c].dataType) for c in rest):  # maps cannot be compared, not even behind the order
        return df.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    else:
        chosen = F.min(F.struct(*placed, F.struct(*rest).alias("_rest")))
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, *back)


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; at most rows/limit of them exist."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)


def _same(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``other`` with its keys renamed, and the condition that they equal those of ``rows``, nulls too."""
    renamed = other.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return renamed, reduce(and_, [rows[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])


def split_hot(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary rows, hot rows or None). The hot key list is checked first, so the usual plan stays one shuffle."""
    hot = hot_keys(df, keys, limit)
    if hot.isEmpty():
        return df, None
    listed, same = _same(df, hot, keys)
    return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, limit: int | None = None) -> DataFrame:
    """``row_number`` per key; rows without a key are rows of one key. ``order`` must be total within a key."""
    limit = limit or hot_rows(df.sparkSession)
    usual, hot = split_hot(stored(df), keys, limit)
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = usual.withColumn(name, F.row_number().over(window).cast("bigint"))
    return numbered if hot is None else numbered.unionByName(_ranked_hot(hot, keys, order, name))


def _ranked_hot(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    # The global sort range-partitions on (key, order): one key is cut over many partitions and the
    # generated id grows along the order. The checkpoint fixes the ids for both uses below.
    placed = (
        df.orderBy(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .checkpoint()
    )
    parts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    listed, same = _same(placed, offsets, [*keys, "_part"])
    return placed.join(listed, same).select(*df.columns, (F.col("_at") - F.col("_start") + F.col("_before") + 1).cast("bigint").alias(name))


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    verdict: str,
    limit: int | None = None,
    chunk: int = FOLD_CHUNK,
) -> DataFrame:
    """Left fold per key over the rows in ``order``.

    ``verdict`` is a Spark SQL expression over the structs ``f1`` (best so far) and ``f2`` (next):
    1 keeps f1, 2 takes f2, anything else leaves the key undecided for good. Gives the keys,
    ``winner`` (a struct of ``payload``), ``undecided`` and ``copies``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = stored(df.select(*keys, F.struct(*order).alias("_order"), F.struct(*payload).alias("_item")))
    usual, hot = split_hot(rows, keys, limit or chunk)
    grouped = usual.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_order", "_item"))).alias("_all"), F.count(F.lit(1)).alias("copies")
    )
    state = F.expr(_fold_sql("slice(_all, 2, size(_all))", "_all[0]._item", verdict))
    folded = grouped.withColumn("_state", state).select(
        *keys, F.col("_state.best").alias("winner"), F.col("_state.undecided").alias("undecided"), "copies"
    )
    return folded if hot is None else folded.unionByName(_fold_hot(hot, keys, verdict, chunk)[0])


def _fold_sql(items: str, best: str, verdict: str) -> str:
    """An ``aggregate`` whose body sees the two rows under the names f1 and f2."""
    step = (
        f"CASE ({verdict}) WHEN 1 THEN acc "
        "WHEN 2 THEN named_struct('best', f2, 'undecided', false) "
        "ELSE named_struct('best', f1, 'undecided', true) END"
    )
    bound = f"transform(array(acc.best), f1 -> transform(array(entry._item), f2 -> {step})[0])[0]"
    return (
        f"aggregate({items}, named_struct('best', {best}, 'undecided', false), "
        f"(acc, entry) -> CASE WHEN acc.undecided THEN acc ELSE {bound} END)"
    )


def _fold_hot(df: DataFrame, keys: Sequence[str], verdict: str, chunk: int) -> tuple[DataFrame, int]:
    """(folded keys, passes over their rows).

    A fold only ever stands at one of its rows, so what a segment makes of a state is known in
    advance from the point on where one of its rows takes over. If its first row does, the result is
    that of folding the segment from there, which is in its summary: a rising key is settled by the
    summaries alone. If the state outlasts the first row, one pass over the rows ahead finds the first
    that the state does not outlast, and only that row's segment is folded again, from this state.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(keys)
    numbered = ranked(df, keys, ["_order"], "_rank", limit=1)
    rows = numbered.withColumn("_segment", F.floor((F.col("_rank") - 1) / chunk)).checkpoint()
    gathered = rows.groupBy(*keys, "_segment").agg(F.array_sort(F.collect_list(F.struct("_order", "_item"))).alias("_all"), F.count(F.lit(1)).alias("_n"))
    alone = F.expr(_fold_sql("slice(_all, 2, size(_all))", "_all[0]._item", verdict))
    summaries = gathered.withColumn("_state", alone).select(
        *keys, "_n", F.struct("_segment", F.col("_all")[0]["_item"].alias("first"), F.col("_state.best").alias("best"), F.col("_state.undecided").alias("undecided")).alias("_s")
    )
    # A row a key: its segments' summaries in order, one for each ``chunk`` rows.
    chains = summaries.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_chain"), F.sum("_n").alias("copies")).checkpoint()
    state = chains.select(*keys, F.col("_chain")[0]["best"].alias("f1"), F.lit(1).cast("bigint").alias("next"), F.col("_chain")[0]["undecided"].alias("undecided"))
    passes = 1
    while True:
        handed = chains.join(state, keys).withColumn("_state", F.expr(_hand_on_sql(verdict)))
        state = handed.select(
            *keys, F.col("_state.best").alias("f1"), F.col("_state.next").alias("next"), F.col("_state.undecided").alias("undecided"),
            (~F.col("_state.undecided") & (F.col("_state.next") < F.size("_chain"))).alias("waits"),
        ).checkpoint()
        waiting = state.filter("waits")
        if waiting.isEmpty():
            break
        passes += 1
        ahead = rows.withColumnRenamed("_item", "f2").join(waiting.select(*keys, "f1", "next"), keys).filter(F.col("_segment") >= F.col("next"))
        outlasted = F.coalesce(F.expr(verdict), F.lit(0)) == 1
        turns = ahead.filter(~outlasted).groupBy(*keys).agg(F.min("_rank").alias("_turn"))
        found = (
            ahead.join(turns.withColumn("_at", F.floor((F.col("_turn") - 1) / chunk)), keys)
            .filter((F.col("_segment") == F.col("_at")) & (F.col("_rank") >= F.col("_turn")))
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_order", F.col("f2").alias("_item")))).alias("_all"), F.first("f1").alias("_best"), F.first("_at").alias("_at"))
            .withColumn("_state", F.expr(_fold_sql("_all", "_best", verdict)))
            .select(*keys, F.struct("_state.best", "_state.undecided", (F.col("_at") + 1).alias("next")).alias("_new"))
        )
        last = chains.select(*keys, F.size("_chain").cast("bigint").alias("_end"))
        # Without such a row the state outlasts everything and is the winner.
        stands = F.when(F.col("waits"), F.struct(F.col("f1").alias("best"), F.col("undecided"), F.col("_end").alias("next"))).otherwise(
            F.struct(F.col("f1").alias("best"), F.col("undecided"), F.col("next"))
        )
        merged = state.join(last, keys).join(found, keys, "left").withColumn("_to", F.coalesce(F.when(F.col("waits"), F.col("_new")), stands))
        state = merged.select(*keys, F.col("_to.best").alias("f1"), F.col("_to.next").alias("next"), F.col("_to.undecided").alias("undecided")).checkpoint()
    return state.join(chains.select(*keys, "copies"), keys).select(*keys, F.col("f1").alias("winner"), "undecided", "copies"), passes


def _hand_on_sql(verdict: str) -> str:
    """The state after the summaries from ``next`` on, up to the first whose first row it outlasts."""
    step = (
        f"CASE ({verdict}) WHEN 1 THEN named_struct('best', f1, 'undecided', false, 'next', acc.next, 'stands', true) "
        "WHEN 2 THEN named_struct('best', entry.best, 'undecided', entry.undecided, 'next', acc.next + 1L, 'stands', false) "
        "ELSE named_struct('best', f1, 'undecided', true, 'next', acc.next, 'stands', true) END"
    )
    bound = f"transform(array(acc.best), f1 -> transform(array(entry.first), f2 -> {step})[0])[0]"
    return (
        "aggregate(slice(_chain, CAST(next AS INT) + 1, size(_chain)), named_struct('best', f1, 'undecided', undecided, 'next', next, 'stands', false), "
        f"(acc, entry) -> CASE WHEN acc.undecided OR acc.stands THEN acc ELSE {bound} END)"
    )
