"""A corpus pipeline of five stages over ``documents``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which run() writes as Parquet and rereads as the next one's docs. All
but the last return the columns of documents.

* quality_classifier drops the documents that the language model rejects.
* ngram_join keeps the smallest document of each near-duplicate group, and of
  repeated rows one. Rows are told apart by key and text, not by doc_id alone.
* suffix_dedup cuts repeated 200-byte strings out of the texts; no row goes.
* mixing orders the rows by their slots, so the files hold the mixed sequence; no
  row goes.
* byte_bpe gives each document's token ids, their digest and that of their decoding.

Empty tables pass through as empty ones; null texts are kept as such up to the last
stage, where they have no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, mixing, ngram_join, quality_lm, suffix_dedup
from brindle.llm.common import Workspace, load

#: SQL can't express the language model, so the stages are tested against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by key, text and language, so a rejected one takes no other with it."""
    judged = quality_lm.judged(docs, load(spark, sf_dir, "labels"), with_rows=True)
    gone = judged.where("rejected").select(F.col("row_id").alias("_row")).distinct()
    return docs.withColumn("_row", quality_lm.row_id()).join(gone, "_row", "left_anti").select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by key and text, so documents that merely share a doc_id stay."""
    rows = ngram_join.join(docs, with_rows=True)
    own = docs.withColumn("_row", ngram_join.row_id("doc_id", "text"))
    gone = rows.where("row_id <> first_row").select(F.col("row_id").alias("_row")).distinct()
    kept = own.join(gone, "_row", "left_anti")
    repeated = rows.where("row_id = first_row and n_shingles > 0").groupBy(F.col("row_id").alias("_row")).agg(F.count("*").alias("_n")).where("_n > 1").select("_row")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "_row", "left_anti").unionByName(kept.join(repeated, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.select(*docs.columns)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(docs, keep_text=True).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "mixing")
    places = mixing.scheduled(docs).groupBy("doc_id").agg(F.min("position").alias("_position"))
    places = space.table(places, "places")
    placed = docs.join(places, docs["doc_id"].eqNullSafe(places["doc_id"])).drop(places["doc_id"])
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = max(1, -(-docs.count() // parts))
    number = F.least(F.floor(F.col("_position") / ends), F.lit(parts - 1)).cast("int")
    return placed.repartitionById(parts, number).sortWithinPartitions("_position").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_join", ngram_join_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = space.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            space.drop(before)  # the next stage has read it
        before = name
    return docs
