"""The literature library, evidence segments of papers, and accounts' addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Characters from which on a segment is kept.
LEAST_SEGMENT = 20


def list_entries(entries: DataFrame, *, screening: str = "", reading: str = "", query: str = "") -> DataFrame:
    """Entries (title, authors, venue, year, screening_status, reading_status) of the given states
    whose title, authors or venue hold the query, by state, newest year and title (C06, G07).
    A total order of a whole library is Spark's range-partitioned sort."""
    out = entries
    if screening:
        out = out.where(F.col("screening_status") == screening)
    if reading:
        out = out.where(F.col("reading_status") == reading)
    if needle := query.strip().lower():
        hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.concat_ws(" ", "authors"), F.coalesce("venue", F.lit("")))
        out = out.where(F.lower(hay).contains(F.lit(needle)))
    return out.orderBy("screening_status", F.coalesce("year", F.lit(0)).desc(), F.coalesce("title", F.lit("")))


def with_paper_titles(evidence: DataFrame, papers: DataFrame, project: str) -> DataFrame:
    """Adds paper_title to evidence from papers (pid, paper_id, id, title) of a project and its
    companion; of rows that repeat a paper the last id counts (D03)."""
    base = project.removesuffix("-p")
    last = papers.where(F.col("pid").isin(base, f"{base}-p")).groupBy(F.col("paper_id").alias("p")).agg(F.max_by(F.coalesce("title", F.lit("")), "id").alias("paper_title"))
    return evidence.join(last, F.col("paper_id") == F.col("p"), "left").drop("p").withColumn("paper_title", F.coalesce("paper_title", F.lit("")))


def _segment(segment: Column, title: Column, text: Column, stage: str, *also: Column) -> list[Column]:
    return ["paper_id", segment.alias("segment_id"), title.alias("title"), text.alias("text"), F.lit(stage).alias("stage"), *also]


def semantic_segments(sections: DataFrame) -> DataFrame:
    """One segment for each section (paper_id, n from 1, section_label, content_en, content_zh) of
    20 characters or more, both languages joined (K13)."""
    en, zh = (F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("content_en", "content_zh"))
    label = F.coalesce(F.nullif(F.trim(F.coalesce("section_label", F.lit(""))), F.lit("")), F.concat(F.lit("Section "), "n"))
    out = sections.select(*_segment(F.concat(F.lit("sec-"), "n"), label, F.concat_ws("\n\n", en, zh), "flow_b"))
    return out.where(F.length("text") >= LEAST_SEGMENT)


def summary_segments(summaries: DataFrame) -> DataFrame:
    """Abstract, findings and conclusion of (paper_id, abstract_zh, key_findings, conclusion) as
    one segment of 20 characters or more (K14)."""
    one = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    found = F.filter(F.transform(F.coalesce("key_findings", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    text = F.concat_ws("\n", one(F.col("abstract_zh")), F.when(F.size(found) > 0, F.array_join(found, "\n")), one(F.col("conclusion")))
    return summaries.select(*_segment(F.lit("summary"), F.lit("Summary"), text, "summary")).where(F.length("text") >= LEAST_SEGMENT)


def rebuild_evidence(semantic: DataFrame, titled: DataFrame, pages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Segments of each paper from its first stage that has any: semantic sections, title
    sections, pages; and its summary where one has. All papers at once (K11, K15). Each table:
    paper_id, segment_id, title, text, stage."""
    ranked = semantic.withColumn("r", F.lit(0)).unionByName(titled.withColumn("r", F.lit(1))).unionByName(pages.withColumn("r", F.lit(2)))
    # Papers' best stages are one row each; AQE broadcasts them only where they are few.
    best = ranked.groupBy(F.col("paper_id").alias("p")).agg(F.min("r").alias("best"))
    main = ranked.join(best, (F.col("paper_id") == F.col("p")) & (F.col("r") == F.col("best"))).drop("p", "r", "best")
    return main.unionByName(summaries.join(best.select(F.col("p").alias("paper_id")), "paper_id", "left_semi"))


def extractive_summary(blocks: DataFrame, group: str, *, most_chars: int = 520) -> DataFrame:
    """Up to three lines of the best blocks (group, page, pos, text) within a budget (F22): early
    pages, words of a summary and length count; code, references and noise are left out."""
    t = T.squash(F.col("text"))
    cites = F.regexp_count(t, F.lit(r"\[[0-9,\s]{1,20}\]"))
    noise = F.regexp_like(t, F.lit(r"(?i)\b(?:import|numpy|pandas|yfinance|pip install|<TASK>|<ASSISTANT|<USER_)\b")) | (cites >= 3) | F.regexp_like(t, F.lit(r"(?i)\b(?:et al\.|arXiv|Proceedings|ISBN|doi)\b"))
    odd = (F.regexp_count(t, F.lit(f"[{T.CJK}]")) <= 2) & (F.regexp_count(t, F.lit(r"[~`|_{}<>\\]")) >= 4)
    hits = F.regexp_count(t, F.lit(r"(?i)\b(?:abstract|introduction|we propose|contribution|method|results?|conclusion|framework|experiment|evaluation)\b|摘要|提出|方法|結果|結論|貢獻|實驗|評估"))
    score = F.when(F.col("page").isin(1, 2, 3), 3).otherwise(0) + 2 * hits + F.least(F.floor(F.length(t) / 120), F.lit(4))
    rows = blocks.select(group, "page", "pos", t.alias("t"), score.alias("score"), (noise | odd).alias("out")).where((F.length("t") >= 40) & ~F.col("out"))
    by = [F.col("score").desc(), F.col("page"), F.col("pos")]
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(group, F.substring("t", 1, 80)).orderBy(*by))).where("k = 1")
    w = Window.partitionBy(group).orderBy(*by)
    line = F.concat(F.rtrim(F.substring("t", 1, 180)), F.when(F.length("t") > 180, "...").otherwise(""))
    top = first.withColumn("n", F.row_number().over(w)).where("n <= 3").withColumn("line", line)
    top = top.withColumn("total", F.sum(F.length("line")).over(Window.partitionBy(group).orderBy("n"))).where(F.col("total") <= most_chars)
    return top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("picked")).select(group, F.col("picked.line").alias("key_findings"), F.array_join("picked.line", "\n").alias("abstract_zh"))


def resolve_emails(users: DataFrame) -> DataFrame:
    """Users (id, username, email) with unique lower-cased addresses (H11): of equal ones a given
    address comes before a placeholder, then the smallest id keeps it; others become dup{id}."""
    own = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    name = F.lower(F.trim(F.coalesce("username", F.lit(""))))
    stand_in = F.concat(F.when(name != "", name).otherwise(F.concat(F.lit("user"), "id")), F.lit("@invalid.local"))
    u = users.withColumn("given", own != "").withColumn("norm", F.when(own != "", own).otherwise(stand_in))
    first = F.row_number().over(Window.partitionBy("norm").orderBy(F.col("given").desc(), "id"))
    return u.withColumn("first", first).withColumn("email", F.when(F.col("first") == 1, F.col("norm")).otherwise(F.concat(F.lit("dup"), "id", F.lit("."), "norm"))).drop("given", "norm", "first")


def copy_members(members: DataFrame, old: str, new: str) -> DataFrame:
    """members (user_id, pid, role) with those of project old in new, where they are not yet."""
    there = members.where(F.col("pid") == new).select("user_id").distinct()
    copied = members.where(F.col("pid") == old).join(there, "user_id", "left_anti").select("user_id", F.lit(new).alias("pid"), "role").dropDuplicates(["user_id"])
    return members.unionByName(copied)


def pack_metadata(items: DataFrame, group: str, order: str) -> DataFrame:
    """Estimated tokens of a context pack and the fingerprint of its items in order: SHA-256 of
    their JSON with sorted keys (E12, I13). Nulls are written as null."""
    keys = ["fingerprint", "paper_id", "segment_id", "snippet", "source_id", "source_type"]
    one = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    g = items.groupBy(group).agg(F.sum(F.coalesce("estimated_tokens", F.lit(0))).alias("total_estimated_tokens"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("j")))).alias("a"))
    return g.select(group, "total_estimated_tokens", F.sha2(F.concat(F.lit("["), F.array_join("a.j", ","), F.lit("]")), 256).alias("context_pack_fingerprint"))


def upgrade_chain(version: Column, current: int = 1) -> Column:
    """The schema version after an upgrade; a newer one than current is an error."""
    v = F.coalesce(version.try_cast("int"), F.lit(0))
    return F.when(v > current, F.raise_error(F.concat(F.lit("Unsupported context_chain schema_version="), v.cast("string"))).cast("int")).otherwise(F.lit(current))


def verified_ranking(ranked: DataFrame, group: str, position: str, *, checked: int = 20) -> DataFrame:
    """Re-ranks (group, position, confidence, link_ok): the first so many are checked, those that
    fail lose 0.15; by confidence, then checked ones that hold, then position (G05). Only links of
    the first `checked` positions count."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(position))
    r = ranked.withColumn("n", n).withColumn("is_verified", (F.col("n") <= checked) & F.coalesce("link_ok", F.lit(False)))
    less = F.greatest(F.lit(0.0), F.round(F.coalesce("confidence", F.lit(0.0)) - 0.15, 4))
    r = r.withColumn("confidence", F.when((F.col("n") <= checked) & ~F.col("is_verified"), less).otherwise(F.coalesce("confidence", F.lit(0.0))))
    order = Window.partitionBy(group).orderBy(F.col("confidence").desc(), F.col("is_verified").desc(), "n")
    return r.withColumn("rank", F.row_number().over(order)).drop("n")
