"""From raw documents to sampled token sequences: each stage works on what the last one kept.

All stages but the last return the columns of documents (COLUMNS); others are dropped at the first
stage. Null and empty texts, null ids, ties, repeated rows and empty tables are treated as the
operators say; texts are whole, whatever their length. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize
from corvane.llm.line_dedup import line_dedup
from corvane.llm.mixing import mix_sources
from corvane.llm.near_dedup import drop_near_duplicates
from corvane.llm.quality import fit_quality, score_quality
from corvane.llm.subword import encode_samples, vocabulary_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labels' training rows."""
    forest = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, forest).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a document of smaller id holds."""
    out = line_dedup(docs)
    changed = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five words, similarity 0.8 or more."""
    return drop_near_duplicates(docs, words=5, percent=80).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    dealt = mix_sources(docs.select(*COLUMNS), carry=True).where("copies > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of each text: doc_id, sample, ids, logp, inclusion, exact."""
    out = encode_samples(docs.select("doc_id", "text"), vocabulary_of(spark), samples=2)
    one = out.select("doc_id", F.posexplode("samples").alias("sample", "s"))
    return one.select("doc_id", "sample", "s.ids", "s.logp", "s.inclusion", "s.exact")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokens),
]
#: SQL expresses neither the classifier nor the sampler.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
