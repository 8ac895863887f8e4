"""Quality rules kept in a bitmask ledger.

Each rule is evaluated once. The ledger keeps its failure as one bit of ``failed_bits`` next to
the measurements, so a policy is a mask over bits, a new policy version needs no text, and the
effect of leaving a rule out follows from the counts of the bit patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, split_long, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 4 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 34 * n_lines"),
    Rule("few_letters", "100 * n_letters < 60 * word_chars"),
    Rule("mostly_capitals", "100 * n_capitals > 50 * n_letters"),
    Rule("long_words", "word_chars > 14 * n_words"),
)

#: Policies by version: the rules that reject. A version is never changed, only followed.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "many_symbols", "repeated_lines", "mostly_capitals", "few_letters", "long_words"),
}
LATEST = "v1"


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def _window_hashes(words: str) -> Column:
    """(hash, position) of every window of three words, by hash."""
    start = f"named_struct('h', xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), 'i', i)"
    return F.expr(f"CASE WHEN size({words}) >= 3 THEN array_sort(transform(sequence(0, size({words}) - 3), i -> {start})) ELSE array() END")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with its measurements (long); null text measures as empty.

    Words are told apart by 64-bit hashes of three neighbours, within one document only. Rows are
    measured on their own: repeated rows give repeated measurements. Other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = split_long(base, words_of(F.col("_text")).alias("_words"), lines.alias("_lines"), F.regexp_replace("_text", r"[^\p{L}]+", "").alias("_letters"))
    windows = split_long(split, _window_hashes("_words").alias("_at"))
    repeats = F.expr(
        "array_sort(transform(filter(_at, (x, k) -> (k > 0 AND x.h = _at[k - 1].h) OR (k + 1 < size(_at) AND x.h = _at[k + 1].h)), x -> x.i))"
    )
    marked = split_long(windows, repeats.alias("_repeats"))
    # Each repeated window covers the words that the one in front of it does not.
    covered = F.expr(
        "aggregate(_repeats, named_struct('upto', 0, 'n', 0L), "
        "(a, i) -> named_struct('upto', i + 3, 'n', a.n + i + 3 - greatest(i, a.upto)), a -> a.n)"
    )
    plain = F.col("_text")
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    long = lambda c: c.cast("long")
    return marked.select(
        "doc_id", long(F.size("_words")).alias("n_words"), long(F.length(F.regexp_replace("_text", SPACE_CLASS + "+", ""))).alias("word_chars"),
        long(F.length("_text") - F.length(plain)).alias("n_symbols"), long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), long(covered).alias("n_repeat_words"),
        long(F.length("_letters")).alias("n_letters"), long(F.length(F.regexp_replace("_letters", r"[^\p{Lu}]+", ""))).alias("n_capitals"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and ``failed_bits``: bit k is set if rule k fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, doc_id, text).withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: str = LATEST, rules: tuple[Rule, ...] = RULES, name: str = "kept") -> DataFrame:
    """``name``: no rule of the policy failed. Reads the ledger alone."""
    return entries.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0)


def ablations(entries: DataFrame, policy: str = LATEST, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (kept if it is left
    out), and those kept with and without it. From the counts of the bit patterns, at most
    2^rules rows."""
    all_bits = mask(policy, rules)
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(all_bits)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if 1 << k & all_bits]))
    counts = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return counts.groupBy("rule").agg(
        sum_if(fails).alias("failing"), sum_if(F.col("bits") == F.col("bit")).alias("failing_alone"), sum_if(F.col("bits") == 0).alias("kept"),
        sum_if((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without"),
    )
