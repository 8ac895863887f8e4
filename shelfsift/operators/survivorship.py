"""Which copy is kept: ranking, rule steps, pair rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import UNITS, format_bytes
from ..functions.text import has_hash
from ..functions.paths import same_volume
from .skew import first_by, fold, ranked

POSITION = ("ord", "id")


# Picture heights a name may mention, and the names of the largest.
HEIGHTS = r"(?i)(?<![0-9])(2160|1440|1080|720|576|480|360|240)\s*[pi]?(?![0-9])"
FOUR_K = r"(?i)\b(4k|uhd|2160p)\b"


def quality_from_name(name="file_name") -> Column:
    """The largest picture height a name mentions, else 0."""
    heights = F.transform(F.regexp_extract_all(F.col(name), F.lit(HEIGHTS), F.lit(1)), lambda t: t.cast("int"))
    named = F.when(F.col(name).rlike(FOUR_K), 2160).otherwise(0)
    return F.greatest(named, F.coalesce(F.array_max(heights), F.lit(0)))


def quality_of() -> Column:
    return F.when(F.col("quality") > 0, F.col("quality")).otherwise(quality_from_name())


def length_rank() -> Column:
    seconds = F.col("duration_seconds")
    return F.when(seconds > 0, F.bround(seconds, 0).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def rank_order(quality: Column | None = None, path: Column | None = None) -> list[Column]:
    """Ascending keys of the preference: sound, better picture, longer, smaller, path, position."""
    return [
        F.when(F.col("integrity") == "Corrupt", 1).otherwise(0),
        -(quality_of() if quality is None else quality),
        -length_rank(),
        F.col("size_bytes"),
        F.upper("full_path") if path is None else path,
        F.col("ord"),
        F.col("id"),
    ]


def rank_candidates(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ranked(files, keys, rank_order(), "rank")


def best_by_name_quality(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_by(files, keys, [-quality_from_name(), -F.col("size_bytes"), "ord", "id"])


@dataclass(frozen=True)
class RuleStep:
    """One step: prefer the greater or lesser value of a field when it differs by more than the tolerance.

    ``field`` is Length, Quality, Size, Modified, Integrity, AlreadyFiled, NameLength, or the name of
    a plugin field together with its ``plugin_type`` (text, number, date, truth).
    """

    field: str
    prefer: str = "greater"
    tolerance: float = 0.0
    plugin_type: str | None = None


# The judgement used when a category has no rules of its own.
BUILT_IN_STEPS = (
    RuleStep("Integrity"),
    RuleStep("Quality"),
    RuleStep("Length", tolerance=0.5),
    RuleStep("Size", prefer="lesser"),
)

# 100 ns ticks between year 1 and 1970.
EPOCH_TICKS = 621355968000000000

# Names of the fields as a user sees them.
LABELS = {
    "Length": "Length", "Quality": "Quality", "Size": "Size", "Modified": "Date modified", "Integrity": "Integrity",
    "AlreadyFiled": "Already in the library", "NameLength": "Length of the name",
}


def rule_value(step: RuleStep) -> Column:
    """A step's value of a row; null when it was never measured."""
    if step.plugin_type:
        return typed_plugin_value(step.field, step.plugin_type, missing_is_null=True)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    values = {
        "Length": lambda: positive("duration_seconds"),
        "Quality": lambda: positive("quality"),
        "Size": lambda: positive("size_bytes"),
        "Modified": lambda: (F.unix_micros(F.col("last_modified_utc").cast("timestamp")) * 10 + F.lit(EPOCH_TICKS)).cast("double"),
        "Integrity": lambda: F.when(F.col("integrity") == "Ok", 2.0).when(F.col("integrity") == "NotChecked", 1.0).otherwise(0.0),
        "AlreadyFiled": lambda: F.when(F.col("consolidated"), 1.0).otherwise(0.0),
        "NameLength": lambda: F.length("file_name").cast("double"),
    }
    return values[step.field]()


def typed_plugin_value(field: str, kind: str, missing_is_null: bool = False) -> Column:
    """A plugin field by its declared type. In filters a bad number or date is 0; in steps it stands aside."""
    raw = F.try_element_at(F.col("plugin_fields"), F.lit(field.lower()))
    text = F.when(F.length(raw) > 0, raw)
    if kind == "text":
        return text if missing_is_null else F.coalesce(text, F.lit(""))
    if kind == "truth":
        value = F.when(F.lower(F.trim(text)).isin("true", "yes", "1"), 1.0).when(text.isNotNull(), 0.0)
    elif kind == "date":
        stamp = F.try_to_timestamp(text)
        value = (F.unix_seconds(stamp) - F.lit(946684800)).cast("double")
    else:
        value = F.trim(text).try_cast("double")
    return value if missing_is_null else F.coalesce(value, F.lit(0.0))


def steps_verdict(steps: Sequence[RuleStep], prefix: str = "v") -> str:
    """The SQL verdict of a list of steps over payload columns v0, v1, ... (or another ``prefix``)."""
    branches = []
    for i, step in enumerate(steps):
        first, second = ("1", "2") if step.prefer == "greater" else ("2", "1")
        a, b = f"f1.{prefix}{i}", f"f2.{prefix}{i}"
        if step.plugin_type == "text":
            branches.append(
                f"WHEN upper({a}) <> upper({b}) THEN IF(upper({a}) > upper({b}), {first}, {second})"
            )
        else:
            margin = max(0.0, step.tolerance)
            branches.append(f"WHEN abs({a} - {b}) > {margin}D THEN IF({a} > {b}, {first}, {second})")
    return f"CASE {' '.join(branches)} ELSE 0 END" if branches else "0"


def choose_by_rules(
    files: DataFrame, keys: Sequence[str], steps: Sequence[RuleStep], order: Sequence[str] = POSITION, **fold_options
) -> DataFrame:
    """Fold the copies of each key through the steps in catalogue order; an undecided pair settles nothing."""
    values = {f"v{i}": rule_value(step) for i, step in enumerate(steps)}
    rows = files.withColumns(values) if values else files
    names = ["id", "full_path", *values]
    result = fold(rows, keys, order, names, steps_verdict(steps), **fold_options)
    kept = ~F.col("undecided") | (F.col("copies") == 1)
    return result.select(
        *keys, "copies", F.when(kept, F.col("winner.id")).alias("winner_id"), (~kept).alias("undecided"),
    )


def explain_step(step: RuleStep, label: str | None = None) -> str:
    """Caption of a step."""
    sign = "max" if step.prefer == "greater" else "min"
    margin = f" ± {step.tolerance:g}" if step.tolerance > 0 else ""
    return f"{sign} {label or LABELS.get(step.field, step.field)}{margin}"


def show_value(step: RuleStep, value: Column) -> Column:
    """A step's value as text."""
    whole = value.cast("bigint")
    if step.field == "Length":
        return F.format_string("%d:%02d:%02d", F.floor(value / 3600), F.floor(value % 3600 / 60), F.floor(value % 60))
    if step.field == "Size":
        return format_bytes(whole, 1)
    if step.field == "Modified":
        return F.date_format(F.timestamp_micros(((value - F.lit(float(EPOCH_TICKS))) / 10).cast("bigint")), "yyyy-MM-dd")
    if step.field == "Integrity":
        return F.when(value >= 2, "sound").when(value >= 1, "not checked").otherwise("corrupt")
    if step.field == "AlreadyFiled":
        return F.when(value >= 1, "in the library").otherwise("not filed")
    return whole.cast("string")


def explain_pairs(pairs: DataFrame, steps: Sequence[RuleStep]) -> DataFrame:
    """For pairs with struct columns ``a`` and ``b`` holding v0.., the deciding step in words."""
    why = F.lit("all_equal")
    for i, step in reversed(list(enumerate(steps))):
        x, y = F.col(f"a.v{i}"), F.col(f"b.v{i}")
        text = F.concat(F.lit(f"{explain_step(step)} — "), show_value(step, x), F.lit(" against "), show_value(step, y))
        why = F.when(F.abs(x - y) > max(0.0, step.tolerance), text).otherwise(why)
    return pairs.withColumn("why", why)


@dataclass(frozen=True)
class PairRule:
    """``condition`` is a Spark SQL boolean over f1 and f2 (empty: always); ``action`` keep1, keep2 or undecided."""

    condition: str
    action: str


ACTIONS = {"keep1": 1, "keep2": 2, "undecided": 0}


def pair_verdict(rules: Sequence[PairRule]) -> str:
    branches = " ".join(f"WHEN {rule.condition or 'true'} THEN {ACTIONS[rule.action]}" for rule in rules)
    return f"CASE {branches} ELSE 0 END" if rules else "0"


def default_pair_rules(tolerance: float) -> list[PairRule]:
    """The built-in judgement written as pair rules, over ``same_content`` and ``sound`` measures."""
    return [
        PairRule("f1.content_key <> f2.content_key", "undecided"),
        PairRule(f"f1.length > 0 AND f2.length > 0 AND abs(f1.length - f2.length) > {float(tolerance)}", "undecided"),
        PairRule("f1.quality > f2.quality AND f1.sound", "keep1"),
        PairRule("f2.quality > f1.quality AND f2.sound", "keep2"),
        PairRule("f1.length > f2.length AND f1.sound", "keep1"),
        PairRule("f2.length > f1.length AND f2.sound", "keep2"),
        PairRule("f1.size <= f2.size AND f1.sound", "keep1"),
        PairRule("f2.sound", "keep2"),
    ]


def needs_measure(spark, rules: Sequence[PairRule], known: str, measures: dict[str, str]) -> list[str]:
    """Which measures a rule list needs, so only their tables are joined.

    ``known`` is the DDL of the columns always there and ``measures`` maps a measure to the DDL of
    its columns. A measure is needed when the conditions no longer analyse without its columns.
    """
    conditions = [rule.condition for rule in rules if rule.condition]

    def analyses(ddl: str) -> bool:
        empty = spark.createDataFrame([], f"f1 struct<{ddl}>, f2 struct<{ddl}>")
        try:
            empty.select(*[F.expr(c) for c in conditions]).schema
            return True
        except AnalysisException:
            return False

    return [
        name for name in measures
        if not analyses(", ".join([known, *[ddl for other, ddl in measures.items() if other != name]]))
    ]


def choose_by_pair_rules(
    files: DataFrame,
    keys: Sequence[str],
    rules: Sequence[PairRule],
    columns: Sequence[str],
    order: Sequence[str] = POSITION,
    **fold_options,
) -> DataFrame:
    """Fold the copies through user-written pair rules; running out of rules is undecided."""
    names = ["id", *[c for c in columns if c != "id"]]
    result = fold(files, keys, order, names, pair_verdict(rules), **fold_options)
    kept = ~F.col("undecided") | (F.col("copies") == 1)
    return result.select(*keys, "copies", F.when(kept, F.col("winner.id")).alias("winner_id"), (~kept).alias("undecided"))


#: What pair rules may ask of a copy, besides its id, full_path, file_name, kind and frames.
PAIR_MEASURES = {
    "length": lambda: F.col("duration_seconds"),
    "quality": lambda: F.col("quality"),
    "size": lambda: F.col("size_bytes"),
    "sound": lambda: F.col("integrity") != "Corrupt",
    "filed": lambda: F.col("consolidated"),
}


def policy_columns(policies: dict[str, tuple[Sequence[PairRule], Sequence[RuleStep]]]) -> dict[str, Column]:
    """What the verdicts of ``policies`` read of a copy: the values of steps, and the columns and measures that pair rules name."""
    values = {f"v{n}_{i}": rule_value(step) for n, (rules, steps) in enumerate(policies.values()) if not rules for i, step in enumerate(steps)}
    asked = " ".join(rule.condition for rules, _ in policies.values() for rule in rules)
    # A condition may also take f1 or f2 as a whole.
    whole = re.search(r"\bf[12]\b(?!`?\s*\.)", asked, re.IGNORECASE) or "*" in asked
    known = {**{c: F.col(c) for c in ("full_path", "file_name", "kind", "frames")}, **{c: make() for c, make in PAIR_MEASURES.items()}}
    return values | {c: value for c, value in known.items() if whole or re.search(rf"\b{c}\b", asked, re.IGNORECASE)}


def choose_by_policies(files: DataFrame, keys: Sequence[str], policies: dict[str, tuple[Sequence[PairRule], Sequence[RuleStep]]], order: Sequence[str], **fold_options) -> DataFrame:
    """Fold the copies of each key by the rules of its category: pair rules where there are some, else steps.

    ``files`` carries ``rule_category``, one of the names of ``policies``. All categories are folded
    together: the verdict of a pair is that of its category. ``policy_columns`` that are there already are taken as they are.
    """
    branches = [f"WHEN {n} THEN {pair_verdict(rules) if rules else steps_verdict(steps, f'v{n}_')}" for n, (rules, steps) in enumerate(policies.values())]
    number = F.lit(None).cast("int")
    for n, name in enumerate(policies):
        number = F.when(F.col("rule_category") == name, n).otherwise(number)
    read = policy_columns(policies)
    rows = files.withColumns({"rule_number": number, **{c: value for c, value in read.items() if c not in files.columns}})
    names = ["id", "rule_number", *read]
    result = fold(rows, keys, order, names, f"CASE f1.rule_number {' '.join(branches)} ELSE 0 END", **fold_options)
    kept = ~F.col("undecided") | (F.col("copies") == 1)
    return result.select(*keys, "copies", F.when(kept, F.col("winner.id")).alias("winner_id"), (~kept).alias("undecided"))


def library_preference(filed: Column, under_root: Column, destination: Column) -> Column:
    """0 correctly filed, 1 under a library root, 2 on the destination's volume, 3 neither."""
    return (
        F.when(filed, 0)
        .when(under_root, 1)
        .when(F.coalesce(F.length(destination), F.lit(0)) > 0, F.when(same_volume("full_path", destination), 2).otherwise(3))
        .otherwise(3)
    )


def prefer_library_copy(files: DataFrame, keys: Sequence[str], order: Sequence[str] = POSITION, columns: Sequence[str] | None = None) -> DataFrame:
    """Per key, the copy with the lowest ``library_rank``; first in order on ties. Only ``columns`` of it are moved."""
    return first_by(files, keys, ["library_rank", *order], columns)


def duplicates_of_consolidated(files: DataFrame) -> DataFrame:
    """In content groups with a filed member: everything but the first filed one (by path)."""
    keyed = files.filter(has_hash()).withColumn("hash_key", F.upper("sha256"))
    keepers = (
        keyed.groupBy("hash_key")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.when(F.col("consolidated"), F.struct("full_path", "id"))).alias("keeper"),
        )
        .filter("copies > 1 AND keeper IS NOT NULL")
        .select("hash_key", F.col("keeper.id").alias("keeper_id"))
    )
    return keyed.join(keepers, "hash_key").filter(F.col("id") != F.col("keeper_id")).select("id", "full_path", "hash_key", "keeper_id")


def redundant_copies(files: DataFrame) -> DataFrame:
    """Copies of filed files that are not filed themselves."""
    keyed = files.filter(has_hash()).withColumn("hash_key", F.upper("sha256"))
    filed = keyed.filter("consolidated").select("hash_key").distinct()
    return keyed.filter(~F.col("consolidated")).join(filed, "hash_key", "left_semi").select("id", "full_path", "hash_key")
