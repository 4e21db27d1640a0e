"""A training corpus from raw documents in five stages, each one operator over all that is left.

Each stage takes (spark, docs, sf_dir), gets its predecessor's rows as Parquet and
returns documents (doc_id, text, lang, source, n_chars); the last returns the token
ids of every row.  ``n_chars`` follows the text.  Stages that run Python bound the
session's Arrow batches by bytes (``bounded_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolink.llm import line_dedup, mixing, ngram_join, quality_classifier, sentencepiece_codec
from geolink.llm.common import Scratch, bounded_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go."""
    bounded_batches(spark)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model, keep=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so does a document of which nothing is left by that."""
    out = line_dedup.remove_lines(docs, Scratch(spark, "pipeline-lines"), keep=("lang", "source", "n_chars"))
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.select("doc_id", "text", "lang", "source", chars.alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (word 5-grams, Jaccard 0.75 or more) the smallest id stays, once.

    Of several rows of one id the one of fewest characters stays (ties: the smallest hash of the row).
    A document without an id belongs to no group and stays.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    groups, _ = ngram_join.join(docs, Scratch(spark, "pipeline-near"))
    leaders = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_leader")).distinct()
    # one row an id before the join: partial aggregation leaves a frequent id one row a task
    rest = COLUMNS[1:]
    rows = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct("n_chars", F.xxhash64(*rest))).alias("r"))
    once = rows.join(leaders, F.col("doc_id") == F.col("_leader")).select("doc_id", *[f"r.{c}" for c in rest])
    return once.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows."""
    out = mixing.mix(docs, Scratch(spark, "pipeline-mix"), keep=("text", "lang", "n_chars"))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with begin and end ids, checked, with digests of ids and decoded text."""
    bounded_batches(spark)
    return sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), keep=("source",)).drop("decoded")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: The classifier's and the tokenizer's decisions have no SQL form; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, str(k))
            scratch.drop(str(k - 1))  # read for the last time
    return docs
