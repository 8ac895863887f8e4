"""Columns that are computed exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for wide expressions that later steps filter, group or branch on.

    A plain projection is folded into every use of its columns, so a filter on a planned path would
    carry (and evaluate) the whole planning expression again, and stacked plans grow with the power of
    their depth. A one-row ``inline`` is a boundary the optimizer does not copy expressions across; it
    moves no data. The values are computed in the projection below it: a generator outside generated code
    interprets its expressions, row by row and each common part anew, while a projection is always compiled.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", values.alias("_staged")).select(*kept, F.inline(F.array("_staged")))
