"""Evidence of whole projects from landed JSON: what fails becomes rows, the rest goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import layout as L
from corvane.operators import library as Y

SECTIONS = "struct<sections:array<struct<section_label:string,content_en:string,content_zh:string>>>"
FUSED = "struct<content:array<struct<page:int,blocks:array<struct<type:string,content:string>>>>>"
SUMMARY = "struct<abstract_zh:string,key_findings:array<string>,conclusion:string>"
#: Of each stage the list that its artifact must hold, if any; fixed values.
LISTS = {"semantic": "sections", "fused": "content", "summary": ""}
_MARK = "\u0001"


def artifact_error(stage: Column, raw: Column) -> Column:
    """Why an artifact can't be used; null if it can."""
    none = F.lit(None).cast("string")
    of = {s: F.when(F.coalesce(F.get_json_object(raw, f"$.{name}"), F.lit("[]")).startswith("["), none).otherwise(f"{name} is no list") if name else none for s, name in LISTS.items()}
    by_stage = none
    for s, c in of.items():
        by_stage = F.when(stage == s, c).otherwise(by_stage)
    return F.when(F.try_parse_json(raw).isNull(), "not JSON").when(F.json_object_keys(raw).isNull(), "not an object").when(~stage.isin(list(LISTS)), F.concat(F.lit("unknown stage "), stage)).otherwise(by_stage)


def rebuild_project(artifacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, errors and a report of all papers of all projects in one job.

    artifacts: pid, paper_id, stage (semantic, fused, summary), raw (JSON), one row for each that
    has landed; a null raw is an artifact that hasn't. A paper with an artifact that can't be read
    gives no segments, only errors (pid, paper_id, stage, error). Of others the first of semantic
    sections, sections by title and pages counts, and the summary beside it. Report: for each
    project papers_indexed, papers_skipped (readable, nothing to index) and papers_failed."""
    a = artifacts.where("raw IS NOT NULL").withColumn("error", artifact_error(F.col("stage"), F.col("raw")))
    errors = a.where("error IS NOT NULL").select("pid", "paper_id", "stage", "error")
    failed = errors.select("pid", "paper_id").distinct()
    good = a.where("error IS NULL").join(failed, ["pid", "paper_id"], "left_anti").select(F.concat("pid", F.lit(_MARK), "paper_id").alias("paper_id"), "stage", "raw")

    def parsed(stage: str, kind: str) -> DataFrame:
        return good.where(F.col("stage") == stage).select("paper_id", F.from_json("raw", kind).alias("j"))

    sections = parsed("semantic", SECTIONS).select("paper_id", F.posexplode("j.sections").alias("n", "s")).select("paper_id", (F.col("n") + 1).alias("n"), "s.*")
    pages = parsed("fused", FUSED).select("paper_id", F.posexplode("j.content").alias("at", "p")).select("paper_id", "at", F.coalesce("p.page", F.col("at") + 1).alias("page"), "p.blocks")
    blocks = pages.select("paper_id", "at", "page", F.posexplode("blocks").alias("k", "b")).select("paper_id", "page", F.struct("at", "k").alias("o"), F.lower(F.coalesce("b.type", F.lit(""))).alias("type"), F.trim(F.coalesce("b.content", F.lit(""))).alias("text")).where("text <> ''")
    titled = L.title_segments(blocks, "paper_id", "o", F.col("type").isin(T.HEADING_TYPES), F.col("text"))
    titled = titled.select("paper_id", F.concat(F.lit("fsec-"), "segment").alias("segment_id"), "title", "text", F.lit("titles").alias("stage"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"])
    by_page = blocks.groupBy("paper_id", "page").agg(F.array_join(lines, "\n").alias("text"))
    by_page = by_page.select("paper_id", F.concat(F.lit("page-"), "page").alias("segment_id"), F.concat(F.lit("Page "), "page").alias("title"), "text", F.lit("pages").alias("stage"))
    summaries = Y.summary_segments(parsed("summary", SUMMARY).select("paper_id", "j.*"))
    found = Y.rebuild_evidence(Y.semantic_segments(sections), titled, by_page, summaries)
    own = F.split("paper_id", _MARK)
    segments = found.select(own[0].alias("pid"), own[1].alias("paper_id"), "segment_id", "title", "text", "stage")

    all_papers = artifacts.select("pid", "paper_id").distinct()
    told = all_papers.join(failed.withColumn("failed", F.lit(True)), ["pid", "paper_id"], "left").join(segments.select("pid", "paper_id").distinct().withColumn("indexed", F.lit(True)), ["pid", "paper_id"], "left")
    report = told.groupBy("pid").agg(F.count("indexed").alias("papers_indexed"), F.count(F.when(F.col("failed").isNull() & F.col("indexed").isNull(), 1)).alias("papers_skipped"), F.count("failed").alias("papers_failed"))
    return segments, errors, report
