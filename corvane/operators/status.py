"""Where a paper stands, from its artifacts, its summary, its reflow and its stored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.sections import is_ready_mode

# Modes of summaries that are less than they should be, stored states, ages in seconds.
DEGRADED = ["fallback_synthetic", "fallback_empty", "fallback_partial", "fallback_partial_parse", "fallback_llm_parse_error", "degraded", "normalized_extract"]
HARD_ERRORS = ["quota_error", "general_error", "parse_error"]
QUEUED, RUNNING = "t5_queued", "t5_running"
FLOW_B_BUSY = ["processing_b", "translating_local", "judging_llm"]
STALE_FLOW_B, STALE_ANALYSIS, LOCK_SECONDS = 7500, 600, 3600
FLAGS = "has_origin has_stack_a has_stack_b has_raw has_fixed has_fusion has_guide has_nllb has_judge has_trans".split()


def summary_state(raw: Column) -> Column:
    """struct(has, error) of a summary's JSON; null: no summary."""
    low = F.lower(raw)
    is_object = F.json_object_keys(raw).isNotNull()
    mode = F.lower(F.trim(F.coalesce(F.get_json_object(raw, "$.mode"), F.lit(""))))
    says = F.coalesce(F.get_json_object(raw, "$.abstract_zh"), F.lit("")) != ""
    has_error = F.coalesce(F.array_contains(F.json_object_keys(raw), "error"), F.lit(False))
    error = (
        F.when(raw.isNull(), None).when(F.try_parse_json(raw).isNull(), "parse_error").when(is_object & mode.isin(DEGRADED), "degraded_summary")
        .when(is_object & (mode == "error_fallback"), F.when(says, "degraded_summary").otherwise("general_error"))
        .when(F.contains(low, F.lit("429")) | F.contains(low, F.lit("quota")) | F.contains(low, F.lit("resource_exhausted")), "quota_error")
        .when(has_error & ~says, "general_error").when(F.contains(low, F.lit("failed")), "general_error"))
    return F.struct((raw.isNotNull() & F.coalesce(error == "degraded_summary", F.lit(True))).alias("has"), error.alias("error"))


def reflow_mode(mode: Column, note: Column) -> Column:
    """The mode that made the sections, else what the note of an error names."""
    own, n = F.lower(F.trim(F.coalesce(mode, F.lit("")))), F.lower(F.trim(F.coalesce(note, F.lit(""))))
    return F.when(own != "", own).when(n.startswith("used=task_5interpret"), "task_5interpret").when(n.contains("used=task_5b_reflow"), "task_5b_reflow").otherwise("")


def paper_status(artifacts: DataFrame, summaries: DataFrame, reflows: DataFrame, rows: DataFrame, locks: DataFrame, now: Column) -> DataFrame:
    """One row for each paper with artifacts: its state, flow, error, three steps and 12 stages.

    artifacts: pid, paper_id and FLAGS; summaries: raw (JSON); reflows: sections (their number),
    mode, note; rows: title, status, updated_at; all by pid and paper_id, one row a paper. locks: pid,
    locked_at. Null flags are false; papers without a row have no stored state; states are compared
    in lower case. An age is unknown, and so old, without updated_at. heal marks papers whose row
    says that it is still busy though all is there: corrections() makes their new rows."""
    key = ["pid", "paper_id"]
    p = artifacts.select(*key, *[F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS])
    p = p.join(summaries.select(*key, "raw"), key, "left").join(reflows.select(*key, "sections", "mode", "note", F.lit(True).alias("has_reflow")), key, "left").join(rows.select(*key, "title", "status", "updated_at"), key, "left")
    p = p.join(locks.groupBy("pid").agg(F.max("locked_at").alias("locked_at")), "pid", "left")
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp"))
    stale = lambda seconds: F.coalesce(age >= seconds, F.lit(True))
    active = F.coalesce(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("locked_at").cast("timestamp")) <= LOCK_SECONDS, F.lit(False))
    p = p.withColumn("s", summary_state(F.col("raw"))).withColumn("has_summary", F.col("s.has")).withColumn("made_by", reflow_mode(F.col("mode"), F.col("note"))).withColumn("db", F.lower(F.coalesce("status", F.lit(""))))
    has_sections = F.coalesce(F.col("sections") > 0, F.lit(False))
    p = p.withColumn("ready_b", F.col("has_trans") & has_sections & is_ready_mode(F.col("made_by")))
    issue = F.when(F.col("has_trans") & ~F.col("ready_b"), F.when(F.col("has_reflow").isNull(), "flowb_reflow_missing").when(~has_sections, "flowb_reflow_empty").when(F.col("made_by") == "heuristic_fallback", "flowb_reflow_fallback").when(F.col("made_by") != "", F.concat(F.lit("flowb_reflow_"), "made_by")).otherwise("flowb_reflow_unknown_mode"))
    p = p.withColumn("hard", F.coalesce(F.col("s.error").isin(HARD_ERRORS), F.lit(False))).withColumn("busy_b", F.col("db").isin(FLOW_B_BUSY))
    db, done = F.col("db"), F.col("has_summary")
    old_b, old_analysis = ~F.col("ready_b") & ~F.col("has_trans") & F.col("busy_b") & stale(STALE_FLOW_B), (db == "analyzing") & ~done & stale(STALE_ANALYSIS) & ~active
    state = (
        F.when(F.col("ready_b"), "ready_B").when(F.col("has_trans") & F.col("busy_b"), "processing_B").when(db.isin("ready_b", "bilingual_ready"), "need_retry")
        .when(F.col("busy_b"), F.when(stale(STALE_FLOW_B), "need_retry").otherwise("processing_B"))
        .when(db.isin(QUEUED, RUNNING), F.when(done, "gold_ready").otherwise(db)).when(db == "gold_ready", F.when(done, "gold_ready").otherwise("need_retry"))
        .when((db == "analyzing") & done, "gold_ready").when(db.isin("ready_a", "rules_ready", "ocr_ready"), "gold_ready").when(db == "failed", "need_retry")
        .when(db == "analyzing", F.when(old_analysis, "need_retry").otherwise("analyzing")).when(db == "pending", "pending")
        .when(done, "gold_ready").when(F.col("hard"), "need_retry").when(F.col("has_fixed") | F.col("has_raw"), "analyzing").otherwise("pending"))
    p = p.withColumn("state", state)
    error = F.coalesce("s.error", F.when(~F.col("ready_b") & db.isin("ready_b", "bilingual_ready"), F.coalesce(issue, F.lit("flowb_artifact_missing"))).when(old_b, "stale_flowb").when(~F.col("ready_b") & old_analysis, "stale_analyzing"))
    summary = F.when(done, "done").when(db.isin(QUEUED, RUNNING), "processing").when(F.col("hard"), "error").when(F.col("has_fixed"), "processing").otherwise("pending")
    summary = F.when(F.col("state").isin(QUEUED, RUNNING) & (summary != "done"), "processing").otherwise(summary)
    lost = (F.col("state") == "need_retry") & (summary != "done")
    flow = F.when(F.col("state").isin("ready_B", "processing_B"), F.col("state")).when(F.col("state") == "gold_ready", "ready_A").when(F.col("state").isin("analyzing", QUEUED, RUNNING), "processing_A").when(F.col("state") == "need_retry", "failed").otherwise("pending")
    p = p.withColumn("summary_error", F.coalesce(error, F.when(lost, "missing_summary"))).withColumn("step_summary", F.when(lost, "error").otherwise(summary)).withColumn("flow", flow)

    in_a, in_b = F.col("flow") == "processing_A", F.col("flow") == "processing_B"
    titled = F.coalesce(~F.col("title").isin("") & (F.col("title") != F.col("paper_id")) & (F.col("title") != F.concat("paper_id", F.lit(".pdf"))), F.lit(False))

    def stage(ok: Column, going: Column) -> Column:
        return F.when(ok, "done").when(going, "processing").otherwise("pending")

    c = F.col
    stages = [
        F.when(c("has_origin"), "done").otherwise("pending"), stage(c("has_stack_a"), in_a & c("has_origin")), stage(c("has_stack_b"), in_a & c("has_origin")), stage(c("has_raw"), in_a & (c("has_stack_a") | c("has_stack_b"))),
        stage(titled, in_a & c("has_raw")), stage(c("has_guide"), in_a & c("has_raw")), stage(c("has_fixed"), in_a & c("has_raw")), stage(c("has_fusion"), in_a & c("has_fixed")),
        F.when(done, "done").when(c("hard"), "error").when(in_a & c("has_fixed"), "processing").otherwise("pending"), stage(c("has_nllb") | c("has_trans"), in_b), stage(c("has_judge") | c("has_trans"), in_b),
        F.when(c("ready_b"), "done").when(c("has_trans") & ~in_b, "error").when(in_b, "processing").otherwise("pending"),
    ]
    fixing = F.when(c("has_fixed"), "done").when(c("has_raw"), "processing").otherwise("pending")
    return p.select(*key, "state", "flow", "summary_error", F.when(c("has_raw"), "done").otherwise("pending").alias("step_read"), fixing.alias("step_fix"), "step_summary", *[s.alias(f"s{i}") for i, s in enumerate(stages, 1)], (c("ready_b") & c("busy_b")).alias("heal"))


def corrections(status: DataFrame) -> DataFrame:
    """Rows to write back: pid, paper_id, status, message."""
    return status.where("heal").select("pid", "paper_id", F.lit("ready_B").alias("status"), F.lit("Auto-healed: bilingual + LLM reflow artifacts detected").alias("message"))
