"""Queries over the driver's tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.conversation_trie import prefix_trie
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.filter_audit import audit_filters
from corvane.llm.html_text import extract_main_text
from corvane.llm.line_dedup import line_dedup
from corvane.llm.metric_join import jaccard_join
from corvane.llm.mixing import mix_sources
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.quality import fit_quality, score_quality
from corvane.llm.secret_scan import fit_secret_model, scan_secrets
from corvane.llm.subword import encode_samples, vocabulary_of
from corvane.llm.topk import top_k_search
from corvane.llm.warc import archive_and_read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines and the hash of the kept text of every document; nulls, ties and repeats as in line_dedup."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of two-word shingle sets at 80 percent; nulls, empty texts and repeated ids as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after writing and reading the archives; null html is an empty payload, as in archive_and_read."""
    captures = archive_and_read(table(spark, sf_dir, "pages"))
    r = F.col("response")
    return captures.select("page_id", r.payload_bytes.alias("payload_bytes"), r.payload_digest.alias("payload_digest"), r.kind.alias("record_type"), "refers_to")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, dropped ones too; null texts, null ids and repeated rows as in exact_dedup."""
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents by a forest fitted on generated findings; a null text has none, as in scan_secrets."""
    return scan_secrets(table(spark, sf_dir, "documents"), fit_secret_model())


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth; broken vectors take no part, ties by id, as in top_k_search."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct samples of every text; a null or empty text has one sample without ids, as in encode_samples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_samples(docs, vocabulary_of(spark), samples=2).select("doc_id", F.posexplode("samples").alias("sample", "s"))
    s = F.col("s")
    return out.select("doc_id", "sample", F.size(s.ids).alias("n_pieces"), F.xxhash64(s.ids).alias("ids_hash"), s.logp.alias("logp"), s.inclusion.alias("inclusion"), s.exact.alias("exact"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document; null sources come last, null texts have size 0, as in mix_sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html is empty, null urls share one host, as in extract_main_text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars", "fits_wrapper")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, fitted on training rows of labels; null texts count as empty, null ids are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_quality(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return score_quality(docs, forest).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the conversations' prefix trie; nulls, ties and repeats as in prefix_trie."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of five-word shingle sets at 80 percent; nulls, empty texts and repeated ids as in jaccard_join."""
    return jaccard_join(table(spark, sf_dir, "documents"), words=5, percent=80)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every order of five filters by part; null texts, sources, ids and labels as in audit_filters."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_warc": op3_warc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_exact_topk": op6_exact_topk,
    "op7_sentencepiece": op7_sentencepiece,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
    "op8_mixing_sources": op8_mixing_sources,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_filter_audit": op13_filter_audit,
}
