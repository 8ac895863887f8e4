"""The registered queries of this package, one for each operator, with DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remainder, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_store")
def token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_tokens, write_tokens

    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=1, keep=lambda ids: F.crc32(ids).alias("ids_crc32"))


_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, sum(n) AS n FROM (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS n FROM repeated) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_capitals
      FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 4 * word_chars)::INT + 8 * (100 * n_dup_lines > 34 * n_lines)::INT
      + 16 * (100 * n_letters < 60 * word_chars)::INT + 32 * (100 * n_capitals > 50 * n_letters)::INT + 64 * (word_chars > 14 * n_words)::INT AS BIGINT) AS failed_bits FROM m)
SELECT *, failed_bits = 0 AS kept, failed_bits & 3 <> 0 AS base_failed FROM b"""


@query("op2_quality_rules", _RULES_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_policy, ledger

    entries = apply_policy(ledger(documents(spark, sf_dir)), "base", name="base_kept")
    return apply_policy(entries).withColumn("base_failed", ~F.col("base_kept")).drop("base_kept")


@query("op9_winnowing")
def winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import as_text, edited, fingerprints, likeness

    return edited(fingerprints(documents(spark, sf_dir))).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"), as_text("edited").alias("edited_fingerprint"),
        likeness("own_hashes", "edited_hashes").alias("near_edited"), likeness("own_hashes", "next_own_hashes").alias("near_next"),
    )


@query("op10_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Target, mix, word_count

    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"), Target(max_repeats=1.4), word_count(F.col("text")))
    return mixed.select("doc.doc_id", F.col("mix_source").alias("source"), "epoch", "tokens", "weight", "repeats", "mix_block", "mix_order")


@query("op1_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    found = remove_repeats(documents(spark, sf_dir))
    return found.select(
        "doc.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed_starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train

    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    models = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text"), models).select(
        "doc.doc_id", (remainder(F.col("doc.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits", "rejected"
    )


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import grade, train

    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade(docs.select("doc_id", "text"), model).select("doc.doc_id", "severity", "grade", "toxic")


@query("op8_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    held_out = remainder(F.col("doc_id"), 5) == 1
    scored = score(documents(spark, sf_dir).select("doc_id", "text"), ~held_out)
    return scored.select("doc.doc_id", (remainder(F.col("doc.doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


_RESAMPLING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
own AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM d) GROUP BY r, f),
aim AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM q) GROUP BY f),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM own UNION SELECT f FROM aim)),
bytes AS (SELECT f, list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ((instr('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1)::BIGINT)) AS b FROM h),
-- A nibble at a time, low one first: the table of four shifts of the reflected polynomial.
t AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS t),
sums AS (SELECT f, xor(list_reduce(b, lambda c, v: xor(t[((xor(xor(t[(xor(c, v) & 15) + 1], c >> 4), v >> 4)) & 15) + 1], xor(t[(xor(c, v) & 15) + 1], c >> 4) >> 4)), 4294967295) % 10000 AS bucket FROM bytes, t),
s AS (SELECT bucket, sum(n) AS s FROM own JOIN sums USING (f) GROUP BY bucket),
g AS (SELECT bucket, sum(n) AS t FROM aim JOIN sums USING (f) GROUP BY bucket),
every AS (SELECT unnest(range(0, 10000)) AS bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS a, coalesce((SELECT sum(t) FROM g), 0)::DOUBLE AS b),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (a + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (b + 10000))))::BIGINT AS gain FROM every LEFT JOIN s USING (bucket) LEFT JOIN g USING (bucket), totals),
weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM own JOIN sums USING (f) JOIN gain USING (bucket) GROUP BY r),
z AS (SELECT r, doc_id, len(w) >= 20 AS fits, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), i, 1)) - 1)::BIGINT)), lambda c, v: c * 16 + v) AS h
      FROM d LEFT JOIN weights USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM z),
ranks AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY fits) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= n * 5 // 100 THEN place END AS rank FROM ranks"""


@query("op11_importance_resampling", _RESAMPLING_SQL)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select("doc.doc_id", "n_features", "weight", "score", "rank")


@query("op12_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import cross_align

    found = cross_align(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), carry=["doc_id"])
    return found.select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_quality_ranking")
def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ranking import rank_quality, train

    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(F.col("doc_id"), 3) != 1))
    return rank_quality(docs, model, carry=["doc_id"]).select("doc.doc_id", (remainder(F.col("doc.doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
