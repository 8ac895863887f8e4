"""Documents to training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm.common import documents, written
from shelfsift.llm.jaccard_join import near_duplicates
from shelfsift.llm.mixing import Target, mix, word_count
from shelfsift.llm.packing import pack
from shelfsift.llm.queries import vocabulary
from shelfsift.llm.suffix_dedup import remove_repeats
from shelfsift.llm.toxicity import grade, train

#: A source of few tokens comes at most so often; the largest one comes once, so none is cut.
MAX_REPEATS = 1.25
#: Near duplicates of the stage: words a shingle, and the least similarity.
WORDS, SIMILARITY = 5, (80, 100)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, by the expected severity; those without text stay."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade(docs, model).filter(~F.col("toxic")).select("doc.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (0.8 or more of their five-word shingles in common) one row
    stays: the one with the smallest id, null ids last, and of several such rows the first. Documents
    without words stay. Rows are judged by themselves, also where they share an id or have none."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    groups = near_duplicates(rows.select("_row", "text"), doc_id="_row", similarity=SIMILARITY, words=WORDS)
    known = rows.select("_row", F.col("doc_id").alias("_id")).join(groups.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"), "_row")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_row"))
    stay = known.groupBy(own.alias("_group")).agg(F.min(F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_row").alias("row"))).alias("_first"))
    return rows.join(stay.select(F.col("_first.row").alias("_row")), "_row", "left_semi").select(*docs.columns)


#: Ends of a piece of UTF-8, a byte as a character: the rest of a character cut in front, the beginning of one cut behind.
CUT_IN_FRONT = r"^[\u0080-\u00bf]{1,3}"
CUT_BEHIND = r"(?:[\u00c0-\u00ff]|[\u00e0-\u00ff][\u0080-\u00bf]|[\u00f0-\u00ff][\u0080-\u00bf]{2})$"


def kept_text(text: Column, starts: Column, ends: Column) -> Column:
    """What stays of a text without the bytes from each start to its end. A character of which only
    a part would stay goes too; all others stay as they are."""
    data = text.cast("binary")
    pieces = F.arrays_zip(F.concat(F.array(F.lit(0).cast("bigint")), ends).alias("a"), F.concat(starts, F.array(F.octet_length(data).cast("bigint"))).alias("b"))

    def piece(span: Column) -> Column:
        own = F.decode(F.substring(data, (span["a"] + 1).cast("int"), (span["b"] - span["a"]).cast("int")), "ISO-8859-1")
        whole = F.regexp_replace(F.regexp_replace(own, CUT_IN_FRONT, ""), CUT_BEHIND, "")
        return F.encode(whole, "ISO-8859-1").cast("string")

    return F.array_join(F.transform(pieces, piece), "")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document they make up wholly goes."""
    cut = F.size("removed_starts") > 0
    found = remove_repeats(docs)
    text = F.when(cut, kept_text(F.col("doc.text"), F.col("removed_starts"), F.col("removed_ends"))).otherwise(F.col("doc.text"))
    left = found.withColumn("_text", text).filter(~cut | (F.length("_text") > 0))
    columns = {"text": F.col("_text"), "n_chars": F.when(cut, F.length("_text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return left.select(*[columns[c].alias(c) if c in columns else F.col("doc")[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every document once, those of smaller sources more often."""
    return mix(docs, Target(max_repeats=MAX_REPEATS, budget=None), word_count(F.col("text"))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1, keep=lambda ids: F.crc32(ids).alias("ids_crc32"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: Learned models, connected components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
