"""Consolidation suggestions: one row per file that has a place to go, with notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..functions.text import effective_title, is_blank, title_verified
from ..operators.survivorship import quality_from_name
from .destinations import Library, destination_collisions, plan_paths


def suggest_consolidation(files: DataFrame, library: Library, existing: DataFrame) -> DataFrame:
    """(id, current_path, proposed_path, category, recommended, note). Needs ``category``.

    Paths are planned where the rows are read, and rows then move with what the notes need. The preferred copy
    of an identity is an aggregate per identity, joined back; notes come in a fixed order.
    """
    rows = files.filter(~is_blank(library.folder(F.col("category"))))
    category = F.col("category")
    title = F.lower(F.trim(effective_title()))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    identity = (
        F.when(category == "TvShow", F.concat_ws("|", F.lit("tv"), title, text("season"), text("episode")))
        .when(category == "Movie", F.concat_ws("|", F.lit("mv"), title, text("year")))
        .otherwise(F.concat(F.lit("id|"), "id"))
    )
    # Identities begin alike, so rows are sorted by a hash of the identity before the identity itself.
    keys = ["_hash", "_identity"]
    keyed = staged(rows, {"_identity": identity}).withColumn("_hash", F.xxhash64("_identity"))
    order = F.struct((-quality_from_name()).alias("quality"), (-F.col("size_bytes")).alias("size"), "ord", "id")
    best = keyed.groupBy(*keys).agg(F.min(order).alias("_first")).select(*keys, F.col("_first.id").alias("_best"))
    extra = category.isin("TvExtra", "MovieExtra")
    tv = category == "TvShow"
    placed = plan_paths(keyed, library).filter("planned_dir IS NOT NULL").select(
        "id", "full_path", "planned_path", "category", "size_bytes", *keys,
        (tv & ~title_verified()).alias("_unconfirmed"), (tv & (F.col("season").isNull() | F.col("episode").isNull())).alias("_unnumbered"),
        extra.alias("_extra"), (~is_blank("linked_file_id")).alias("_linked"),
    )
    # The only copy of an identity is its best one.
    judged = placed.join(best, keys).withColumn("_better", F.col("id") != F.col("_best")).drop(*keys, "_best")
    planned = destination_collisions(judged, existing)
    against = [
        F.when(F.col("_better"), "better_copy"),
        F.when(F.col("_unconfirmed"), "title_unconfirmed"),
        F.when(F.col("_unnumbered"), "no_number"),
        F.when(F.col("_extra") & ~F.col("_linked"), "extra_unlinked"),
        F.when(F.col("collision") == "duplicate", "already_there").when(F.col("collision") == "name taken", "name_taken"),
        F.when(F.col("collision") == "in place", "in_place"),
    ]
    travels = F.when(F.col("_extra") & F.col("_linked"), "extra_travels")
    notes = F.array_compact(F.array(*against[:4], travels, *against[4:]))
    objections = F.array_compact(F.array(*against))
    return planned.select(
        "id", F.col("full_path").alias("current_path"), F.col("planned_path").alias("proposed_path"), "category",
        (F.size(objections) == 0).alias("recommended"), F.array_join(notes, "; ").alias("note"),
    )
