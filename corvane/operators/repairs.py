"""Sections refilled in the language they lack, first usable sources, maps and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import cleaning as C
from corvane.functions import text as T

# Limits of refilled texts, dimensions of a comparison and what stands for none.
REFILL_CHARS, SUMMARY_CHARS, GUESS_BLOCKS, GUESS_LINES, GUESS_LEAST = 4200, 900, 8, 3, 24
DIMENSIONS = ["研究問題與目標", "方法與系統設計", "資料與實驗設定", "結果與證據強度", "限制與風險"]
NO_VIEW, NO_SYNTHESIS = "N/A", "資料不足，待補充比較證據。"


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def refill_languages(sections: DataFrame, blocks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sections whose English or Chinese text is empty get it from the blocks they refer to.

    sections: paper_id, n, section_label, source_block_refs, content_en, content_zh and others;
    blocks: paper_id, page, block, content, content_zh; summaries: paper_id, abstract_en,
    abstract_zh, one row a paper. Texts of refs go in order of the refs, repeats (120 characters)
    once, cut at 4,200 characters and cleaned. An abstract that stays empty takes the summary's,
    in English else what the first blocks of the first page say. Only sections that lack a text
    look their refs up. Adds repaired: how many of the two were filled. Repeated (paper_id, n) rows
    share their refills."""
    lacks = {c: T.squash(F.col(c)) == "" for c in ("content_en", "content_zh")}
    open_refs = sections.where(lacks["content_en"] | lacks["content_zh"]).select("paper_id", "n", F.posexplode("source_block_refs").alias("at", "ref"))
    texts = blocks.select("paper_id", F.format_string("p%d-b%d", "page", "block").alias("ref"), T.squash(F.col("content")).alias("content_en"), T.squash(F.col("content_zh")).alias("content_zh"))
    told = open_refs.withColumn("ref", _strip(F.col("ref"))).join(texts, ["paper_id", "ref"])
    lines = reduce(DataFrame.unionByName, [told.select("paper_id", "n", "at", F.lit(c).alias("side"), F.col(c).alias("text")).where("text <> ''") for c in lacks])
    once = lines.groupBy("paper_id", "n", "side", F.substring("text", 1, 120).alias("key")).agg(F.min(F.struct("at", "text")).alias("x"))
    def joined(side: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("x"))))
        return T.clip(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n"), REFILL_CHARS)
    found = once.groupBy("paper_id", "n").agg(joined("content_en").alias("en"), joined("content_zh").alias("zh"))
    found = found.select("paper_id", "n", C.relaxed(F.col("en"), 8, 1600).alias("ref_en"), C.extractive(F.col("zh"), 20, REFILL_CHARS).alias("ref_zh"))

    first = blocks.groupBy("paper_id").agg(F.min("page").alias("page"))
    line = T.squash(F.col("content"))
    start = blocks.join(first, ["paper_id", "page"]).where(F.col("block") <= GUESS_BLOCKS).where((F.length(line) >= GUESS_LEAST) & ~T.is_meta_noise(line))
    start = start.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("block", line.alias("t")))).alias("a"))
    guess = start.select("paper_id", C.relaxed(F.array_join(F.slice(F.transform("a", lambda x: x["t"]), 1, GUESS_LINES), "\n\n"), 4, SUMMARY_CHARS).alias("guess_en"))
    said = summaries.select("paper_id", *[C.strict(T.clip(_strip(F.col(f"abstract_{k}")), SUMMARY_CHARS), 4, SUMMARY_CHARS).alias(f"said_{k}") for k in ("en", "zh")])

    out = sections.join(found, ["paper_id", "n"], "left").join(said, "paper_id", "left").join(guess, "paper_id", "left")
    is_abstract = F.lower(_strip(F.col("section_label"))) == "abstract"

    def some(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])

    abstract = lambda c: F.when(is_abstract, F.col(c))
    new = {"content_en": some(F.col("ref_en"), abstract("said_en"), abstract("guess_en")), "content_zh": some(F.col("ref_zh"), abstract("said_zh"))}
    filled = {c: lacks[c] & new[c].isNotNull() for c in lacks}
    out = out.withColumn("repaired", sum((f.cast("int") for f in filled.values()), F.lit(0)))
    columns = [F.when(filled[c], new[c]).otherwise(F.col(c)).alias(c) if c in filled else F.col(c) for c in sections.columns]
    return out.select(*columns, "repaired")


def first_usable(projects: DataFrame, sources: list[tuple[str, DataFrame, Column]], columns: list[str]) -> DataFrame:
    """For each project the columns of the first source that has something usable, and its origin
    (A31, A32). projects: pid; sources, in order: origin, rows of pid and columns, and whether a row
    is usable. In one source the project's own row, usable or not, hides that of its base id (the
    id without -p); of several own rows the largest counts. Projects without any: nulls and ''.
    One union and two picks for all projects, no look-up by project."""
    base = F.regexp_replace("pid", "-p$", "")
    asked = projects.select("pid").distinct()
    names = asked.select("pid", F.col("pid").alias("of"), F.lit(0).alias("k")).unionAll(asked.select("pid", base.alias("of"), F.lit(1).alias("k")).where("pid <> of"))
    rows = reduce(DataFrame.unionByName, [d.select(F.col("pid").alias("of"), *columns, F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(i).alias("rank"), F.lit(origin).alias("origin")) for i, (origin, d, ok) in enumerate(sources)])
    held = F.struct("ok", *columns, "origin")
    own = names.join(rows, "of").groupBy("pid", "rank").agg(F.max_by(held, F.struct(-F.col("k"), F.to_json(held))).alias("b"))
    best = own.where("b.ok").groupBy("pid").agg(F.min_by("b", "rank").alias("b"))
    return asked.join(best, "pid", "left").select("pid", *[F.col(f"b.{c}").alias(c) for c in columns], F.coalesce("b.origin", F.lit("")).alias("origin"))


def project_map(papers: DataFrame) -> DataFrame:
    """(pid, count, papers): what each project holds, as a map of paper ids to title, year and
    whether there is a summary (E17). papers: pid, pos, paper_id, title, year, summary; of papers
    that repeat an id the last pos counts, and count counts them all. Null ids are not mapped."""
    item = F.struct(F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce(F.col("year").cast("string"), F.lit("Unknown")).alias("year"), (F.coalesce("summary", F.lit("")) != "").alias("has_summary"))
    one = papers.groupBy("pid", "paper_id").agg(F.max_by(item, "pos").alias("item"), F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.when(F.col("paper_id").isNotNull(), F.struct("paper_id", "item"))))
    return one.groupBy("pid").agg(F.sum("n").alias("count"), F.map_from_entries(entries).alias("papers"))


def comparison_points(points: Column) -> Column:
    """The five points of a comparison from what a model gave (I72): array of structs of dimension,
    baseline_view, target_view, synthesis, significance. A dimension is found by its name, of equal
    names the last; else the first name that shares two leading characters with it. Missing ones
    say so."""
    given = F.filter(F.coalesce(points, F.array().cast("array<struct<dimension:string,baseline_view:string,target_view:string,synthesis:string,significance:string>>")), lambda p: _strip(p["dimension"]) != "")
    names = F.array_distinct(F.transform(given, lambda p: _strip(p["dimension"])))

    def view(p: Column, name: str, default: str, most: int) -> Column:
        value = _strip(F.coalesce(F.nullif(p[name], F.lit("")), F.lit(default)))
        return F.substring(value, 1, most) if most else value

    def of(dim: str) -> Column:
        near = F.filter(names, lambda k: F.contains(k, F.lit(dim[:2])) | F.contains(F.lit(dim), F.substring(k, 1, 2)))
        name = F.when(F.array_contains(names, dim), F.lit(dim)).otherwise(F.try_element_at(near, F.lit(1)))
        p = F.try_element_at(F.filter(given, lambda x: _strip(x["dimension"]) == name), F.lit(-1))
        none = F.struct(F.lit(dim).alias("dimension"), F.lit(NO_VIEW).alias("baseline_view"), F.lit(NO_VIEW).alias("target_view"), F.lit(NO_SYNTHESIS).alias("synthesis"), F.lit("Low").alias("significance"))
        some = F.struct(F.lit(dim).alias("dimension"), view(p, "baseline_view", NO_VIEW, 220).alias("baseline_view"), view(p, "target_view", NO_VIEW, 220).alias("target_view"), view(p, "synthesis", NO_VIEW, 260).alias("synthesis"), view(p, "significance", "Medium", 0).alias("significance"))
        return F.when(p.isNull(), none).otherwise(some)

    return F.array(*map(of, DIMENSIONS))


def comparison_text(points: Column) -> Column:
    """Points as one text, a paragraph each."""
    line = lambda p: F.concat(F.lit("【"), p["dimension"], F.lit("】\n基準: "), p["baseline_view"], F.lit("\n對照: "), p["target_view"], F.lit("\n評析: "), p["synthesis"])
    return F.array_join(F.transform(points, line), "\n\n")
