"""Sections of papers from blocks and batches, equations put back, members by e-mail, and small
rules about assets, summaries and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import cleaning as C
from corvane.functions import text as T
from corvane.functions import udfs as U

# Limits of a section, the label of none, roles by rank, names of leads, kinds that
# ground an answer, modes of finished sections.
SECTION_CHARS, SECTION_LINES, SECTION_REFS, DROPPED_REFS, MOST_SECTIONS = 12000, 40, 128, 256, 24
UNSORTED = "未分類段落"
ROLES = ["viewer", "coauthor", "editor", "owner"]
LEADS = r"^(?:主持人|共同主持人)|(?i)co-pi"
GROUNDS = "current_draft manuscript_history study_note project_background paq_note paper_segment context_chain_item manuscript_note".split()
READY_MODES = ["task_5b_reflow", "task_5interpret", "heuristic_fallback"]


def _cleaned(text: Column) -> Column:
    return C.extractive(T.clip(text, SECTION_CHARS), SECTION_LINES, SECTION_CHARS)


def _in_order(keep: Column, order: Column, value: Column) -> Column:
    """The values of kept rows in order, as an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])


def section_buckets(blocks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sections of papers from blocks (paper_id, page, pages, block, type, content, content_zh):
    each block belongs to the last heading with a known label, before any by its page's share of
    the paper (E19). Blocks that say little are left out, headings of under 24 characters too; so are longer
    headings up to 100, once they have named what follows. A Chinese summary
    (paper_id, abstract_zh, key_findings), or where it is empty the first three findings, fills an
    abstract that has no Chinese. Confidence is 0.86 below a
    heading, 0.62 by position, 0.58 for the summary, averaged; a section is inferred where no
    heading names it. Texts beyond the limit of a section are dropped before they are gathered."""
    b = blocks.select("paper_id", "page", "pages", "block", "type", T.squash(F.col("content")).alias("en"), T.squash(F.col("content_zh")).alias("zh"))
    # The windows need this partitioning anyway; the exchange also parts the long expressions.
    b = b.repartition("paper_id").withColumn("low_en", T.is_low_information(F.col("en"))).withColumn("low_zh", T.is_low_information(F.col("zh")))
    # The best text of a block says little only where both languages do; else Chinese comes first.
    b = b.where("NOT (low_en AND low_zh)").withColumn("source", F.when(~F.col("low_zh"), F.col("zh")).otherwise(F.col("en")))
    source = F.col("source")
    b = b.withColumn("title", F.when(T.is_heading_like(source, F.col("type")), F.nullif(T.section_label(source), F.lit("")))).withColumn("size", F.length(source))
    upto = Window.partitionBy("paper_id").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("named", F.last_value("title", ignoreNulls=True).over(upto)).where("title IS NULL OR size > 100")
    b = b.withColumn("label", F.coalesce("named", T.label_by_position(F.col("page"), F.greatest(F.lit(1), F.col("pages")))))
    before = Window.partitionBy("paper_id", "label").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, -1)
    for c in ("en", "zh"):
        said = F.when(~F.col(f"low_{c}"), F.col(c))
        b = b.withColumn(c, said).withColumn("used", F.sum(F.length(c) + 2).over(before))
        b = b.withColumn(c, F.when(F.coalesce("used", F.lit(0)) <= SECTION_CHARS + 2, F.col(c)))
    b = b.withColumn("n", F.row_number().over(Window.partitionBy("paper_id", "label").orderBy("page", "block")))
    b = b.select("paper_id", "label", "page", "block", "en", "zh", "n", F.col("named").isNotNull().alias("named"), F.lit(None).cast("string").alias("summary"))
    none = lambda kind: F.lit(None).cast(kind)
    said = F.filter(F.transform(F.slice(F.coalesce("key_findings", F.array().cast("array<string>")), 1, 3), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    given = F.trim(F.coalesce("abstract_zh", F.lit("")))
    summaries = summaries.select("paper_id", F.when(given != "", given).otherwise(F.array_join(said, "\n")).alias("summary_zh"))
    s = summaries.where("summary_zh <> ''").join(blocks.select("paper_id").distinct(), "paper_id", "left_semi")
    s = s.select("paper_id", F.lit("Abstract").alias("label"), none("int").alias("page"), none("int").alias("block"), none("string").alias("en"), none("string").alias("zh"), none("int").alias("n"), F.lit(False).alias("named"), F.col("summary_zh").alias("summary"))
    at, is_block = F.struct("page", "block"), F.col("page").isNotNull()
    g = b.unionByName(s).groupBy("paper_id", "label").agg(
        F.min(F.when(is_block, at)).alias("first"), F.max("summary").alias("summary"), F.max("named").alias("named"), F.count("page").alias("blocks"), F.sum(F.when(is_block, F.when(F.col("named"), 0.86).otherwise(0.62)).otherwise(0.0)).alias("sure"),
        _in_order(F.col("n") <= SECTION_REFS, at, F.format_string("p%d-b%d", "page", "block")).alias("refs"), _in_order(F.col("en").isNotNull(), at, F.col("en")).alias("en"), _in_order(F.col("zh").isNotNull(), at, F.col("zh")).alias("zh"))
    g = g.withColumn("filled", F.col("summary").isNotNull() & (F.size("zh") == 0)).withColumn("zh", F.when(F.col("filled"), F.array("summary")).otherwise(F.col("zh")))
    count = F.col("blocks") + F.col("filled").cast("int")
    out = g.where("blocks > 0 OR filled").select(
        "paper_id", F.col("label").alias("section_label"), "first", F.round((F.col("sure") + F.when(F.col("filled"), 0.58).otherwise(0.0)) / count, 3).alias("confidence"), (~F.col("named")).alias("inferred_label"),
        F.slice(F.concat("refs", F.when(F.col("filled"), F.array(F.lit("summary.json"))).otherwise(F.array().cast("array<string>"))), 1, SECTION_REFS).alias("source_block_refs"), _cleaned(F.array_join("en", "\n\n")).alias("content_en"), _cleaned(F.array_join("zh", "\n\n")).alias("content_zh"))
    out = out.where("content_en <> '' OR content_zh <> ''")
    return out.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("first").asc_nulls_last()))).drop("first")


def merge_sections(batches: DataFrame, group: str) -> DataFrame:
    """Sections (group, batch, pos, section_label, confidence, inferred_label, source_block_refs,
    dropped_refs, content_en, content_zh) of several batches by lower-cased label, in order of
    first appearance, 24 at most (H07). Refs stay distinct in order; confidence is the mean of
    values within 0 and 1; a section is inferred if all its parts are. A group is one paper."""
    label = F.coalesce(F.nullif(F.trim(F.coalesce("section_label", F.lit(""))), F.lit("")), F.lit(UNSORTED))
    at = F.struct("batch", "pos")
    b = batches.withColumn("label", label).withColumn("key", F.lower("label")).withColumn("en", T.squash(F.col("content_en"))).withColumn("zh", T.squash(F.col("content_zh")))
    refs = lambda c: F.array_distinct(F.flatten(_in_order(F.lit(True), at, F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != ""))))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.65))))
    g = b.groupBy(group, "key").agg(
        F.min(at).alias("first"), F.min_by("label", at).alias("section_label"), F.round(F.avg(sure), 3).alias("confidence"), F.bool_and(F.coalesce("inferred_label", F.lit(False))).alias("inferred_label"),
        F.slice(refs("source_block_refs"), 1, SECTION_REFS).alias("source_block_refs"), F.slice(refs("dropped_refs"), 1, DROPPED_REFS).alias("dropped_refs"),
        F.array_join(_in_order(F.col("en") != "", at, F.col("en")), "\n\n").alias("en"), F.array_join(_in_order(F.col("zh") != "", at, F.col("zh")), "\n\n").alias("zh"))
    g = g.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("first"))).where(F.col("n") <= MOST_SECTIONS)
    out = g.select(group, "n", "section_label", "confidence", "inferred_label", "source_block_refs", F.filter("dropped_refs", lambda r: r != "summary.json").alias("dropped_refs"), _cleaned(F.col("en")).alias("content_en"), _cleaned(F.col("zh")).alias("content_zh"))
    return out.where("content_en <> '' OR content_zh <> ''")


def inject_equations(blocks: DataFrame, equations: DataFrame) -> DataFrame:
    """Blocks (paper_id, page, seq_id, type, is_equation, ...) and, for papers that have no
    equation at all, the segmented equations of the same columns whose seq_id their page does not
    have; of repeated ones the first by content stays (D17). injected marks the added rows."""
    is_equation = (F.lower(F.trim(F.coalesce("type", F.lit("")))) == "equation") | F.coalesce("is_equation", F.lit(False))
    state = blocks.groupBy("paper_id").agg(F.max(is_equation).alias("has")).where("NOT has").select("paper_id")
    seq = F.trim(F.coalesce(F.col("seq_id").cast("string"), F.lit("")))
    new = equations.join(state, "paper_id", "left_semi").withColumn("c_seq", seq)
    there = blocks.select("paper_id", "page", seq.alias("c_seq")).where("c_seq <> ''").distinct()
    new = new.join(there, ["paper_id", "page", "c_seq"], "left_anti")
    twice = F.row_number().over(Window.partitionBy("paper_id", "page", "c_seq").orderBy(*[c for c in equations.columns if c not in ("paper_id", "page")]))
    new = new.where("c_seq = ''").unionByName(new.where("c_seq <> ''").withColumn("k", twice).where("k = 1").drop("k"))
    return blocks.withColumn("injected", F.lit(False)).unionByName(new.select(*blocks.columns, F.lit(True).alias("injected")))


def sync_members(members: DataFrame, people: DataFrame, users: DataFrame) -> DataFrame:
    """members (user_id, pid, role) after people (pid, pos, role, access_role, emails) took effect
    (D26): the first address that is not blank finds the user (id, email); leads get editor at
    least and never lose a higher role; of several rows of a person the later ones follow the
    earlier. Unknown roles and addresses change nothing; nobody is removed."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ROLES)), c)
    asked = F.lower(F.trim(F.coalesce("access_role", F.lit(""))))
    known = F.when(asked.isin(ROLES), asked).otherwise("")
    lead = F.regexp_like(F.trim(F.coalesce("role", F.lit(""))), F.lit(LEADS))
    mails = F.filter(F.transform("emails", lambda e: F.lower(F.trim(e))), lambda e: e != "")
    p = people.select("pid", "pos", lead.alias("lead"), F.when(lead & (rank(known) < rank(F.lit("editor"))), "editor").otherwise(known).alias("wanted"), F.try_element_at(mails, F.lit(1)).alias("mail")).where("wanted <> '' AND mail IS NOT NULL")
    u = users.select(F.col("id").alias("user_id"), F.lower(F.trim("email")).alias("mail")).groupBy("mail").agg(F.min("user_id").alias("user_id"))
    steps = p.join(u, "mail").groupBy("user_id", "pid").agg(F.array_sort(F.collect_list(F.struct("pos", "wanted", "lead"))).alias("steps"))
    both = members.join(steps, ["user_id", "pid"], "full")
    step = lambda now, s: F.when(s["lead"] & (rank(F.coalesce(now, F.lit(""))) > rank(s["wanted"])), now).otherwise(s["wanted"])
    return both.select("user_id", "pid", F.coalesce(F.aggregate("steps", F.col("role").cast("string"), step), "role").alias("role"))


def asset_counts(pages: DataFrame) -> DataFrame:
    """Expected and present pages of papers (paper_id, page, stage: origin or raw): origin pages
    and those that are read too, or 0 and all read ones where no origin is kept (E21)."""
    is_stage = lambda s: F.max((F.col("stage") == s).cast("int"))
    p = pages.groupBy("paper_id", "page").agg(is_stage("origin").alias("o"), is_stage("raw").alias("r"))
    g = p.groupBy("paper_id").agg(F.sum("o").alias("expected"), F.sum(F.col("o") * F.col("r")).alias("both"), F.sum("r").alias("read"))
    return g.select("paper_id", "expected", F.when(F.col("expected") > 0, F.col("both")).otherwise(F.col("read")).alias("present"))


def fallback_summary(text: Column) -> Column:
    """(key_findings, conclusion): the three longest sentences, earlier ones first among equals,
    and the last (E22)."""
    s = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    ranked = F.array_sort(F.transform(s, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("x"))))
    return F.struct(F.slice(F.transform(ranked, lambda r: r["x"]), 1, 3).alias("key_findings"), F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")).alias("conclusion"))


def is_quota_summary(raw: Column) -> Column:
    """Whether a summary (JSON object) tells of an exhausted quota."""
    r = F.lower(F.coalesce(raw, F.lit("")))
    return r.startswith("{") & (r.contains("429") | r.contains("quota") | r.contains("resource_exhausted"))


def is_ready_mode(mode: Column, modes: list[str] | None = None) -> Column:
    """Whether a section's generation mode counts as finished."""
    return F.lower(F.trim(F.coalesce(mode, F.lit("")))).isin([m.lower() for m in modes or READY_MODES])


def grounded(sources: DataFrame, group: str, attached: Column) -> DataFrame:
    """Whether each group of sources (group, source_type) has an attachment or any kind that can
    ground an answer (C50)."""
    return sources.groupBy(group).agg(F.bool_or(F.coalesce(attached, F.lit(False)) | F.coalesce(F.col("source_type").isin(GROUNDS), F.lit(False))).alias("grounded"))


def matrix_file(criteria: Column, ids: Column) -> Column:
    """The file name of a comparison: criteria and sorted ids, digests where they are long."""
    plain = F.regexp_replace(criteria, r"[^\p{L}\p{N} _-]", "_")
    plain = F.when(F.length(plain) > 30, F.concat(F.substring(plain, 1, 30), F.lit("_"), F.substring(F.md5(criteria.cast("binary")), 1, 6))).otherwise(plain)
    ordered = F.array_sort(ids)
    joined = F.array_join(ordered, "+")
    name = F.concat(plain, F.lit("_"), joined)
    short = F.concat(plain, F.lit("_"), F.substring(F.array_join(F.slice(ordered, 1, 2), "+"), 1, 50), F.lit("_etc_"), F.substring(F.md5(joined.cast("binary")), 1, 12))
    return F.concat(F.when(F.length(name) > 100, short).otherwise(name), F.lit(".json"))


def without_papers(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of any table (pid, paper_id, ...) without those of deleted papers (pid, paper_id): a
    rewrite by anti-join (K20). Rows without an id stay."""
    return rows.join(deleted.select("pid", "paper_id").distinct(), ["pid", "paper_id"], "left_anti").select(*rows.columns)


def attachment_text(content: Column) -> Column:
    """An attachment's text (I77): images and pure base64 of over 512 characters give none, data
    URLs are decoded, all else stays."""
    c = F.coalesce(content, F.lit(""))
    bare = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    coded = (F.length(bare) > 512) & F.regexp_like(bare, F.lit(r"^[A-Za-z0-9+/=\r\n]+$"))
    url = F.coalesce(U.decode_data_url(F.when(c.startswith("data:") & ~c.startswith("data:image"), c)), F.lit(""))
    return F.when(c.startswith("data:image"), "").when(c.startswith("data:"), url).when(coded, "").otherwise(c)
