"""The texts of a project as one prompt within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import udfs as U

# Headings of the parts, the least share of a paper, the default budget.
NOTES, PAPER = "[研究筆記 / Study Notes]\n", "[論文全文 / Paper Full Text: "
LEAST_SHARE, BUDGET = 100, 16_000


def assemble_corpus(papers: DataFrame, notes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(pid, corpus, skipped, sources, estimated_tokens): a project's notes, then each paper cut to
    an equal share of what the notes leave, 100 tokens at least (B13, I21).

    papers: pid, name, text; notes: pid, text, one row a project. Papers go by name; those without
    text are skipped and take no share. Projects with neither notes nor papers are not put out.
    Texts are cut before they are gathered; repeated names stay, the smaller text first."""
    named = papers.select("pid", F.coalesce("name", F.lit("")).alias("name"), F.trim(T.sanitize(F.col("text"))).alias("text"))
    told = notes.select("pid", F.trim(T.sanitize(F.col("text"))).alias("n")).where("n <> ''").select("pid", F.concat(F.lit(NOTES), "n").alias("note"))
    told = told.withColumn("note_tokens", T.estimate_exact(F.col("note")))
    many = named.groupBy("pid").agg(F.count(F.when(F.col("text") != "", 1)).alias("papers"))
    share = many.join(told, "pid", "full").select("pid", "note", F.greatest(F.lit(LEAST_SHARE), F.floor(F.greatest(F.lit(0), F.lit(budget) - F.coalesce("note_tokens", F.lit(0))) / F.greatest(F.lit(1), F.coalesce("papers", F.lit(0))))).cast("int").alias("share"))
    cut = named.join(share.select("pid", "share"), "pid").withColumn("cut", F.when(F.col("text") == "", "").otherwise(U.truncate_to_exact_budget(F.col("text"), F.col("share"))))
    head = F.concat(F.lit(PAPER), F.substring(F.trim(T.sanitize(F.col("name"))), 1, 200), F.lit("]\n"))
    parts = cut.groupBy("pid").agg(
        F.array_sort(F.collect_list(F.when(F.col("cut") != "", F.struct("name", F.concat(head, F.col("cut")).alias("part"))))).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("text") == "", F.col("name")))).alias("skipped"))
    none = F.array().cast("array<string>")
    out = share.join(parts, "pid", "left")
    first = F.when(F.col("note").isNotNull(), F.array("note")).otherwise(none)
    corpus = F.array_join(F.concat(first, F.coalesce(F.col("parts.part"), none)), "\n\n")
    named_parts = F.transform(F.coalesce(F.col("parts.name"), none), lambda n: F.concat(F.lit("paper:"), n))
    sources = F.concat(F.when(F.col("note").isNotNull(), F.array(F.lit("study_notes"))).otherwise(none), named_parts)
    out = out.select("pid", corpus.alias("corpus"), F.coalesce("skipped", none).alias("skipped"), sources.alias("sources"))
    return out.withColumn("estimated_tokens", T.estimate_exact(F.col("corpus")))
