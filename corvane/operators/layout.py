"""Blocks of page layouts: order, links, labels, sections, matching readers, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.functions import text as T

MISSING_ORDER = 1_000_000_000


def reading_order(blocks: DataFrame, page: list[str], page_h: Column, tie: str = "seq_id") -> DataFrame:
    """Dense order 1..n on each page (F01). blocks: x0, y0, column (left, right, span, full, others)
    and two_columns; columns named zone and reading_order are replaced. One column: by y, x. Two,
    told or seen (two blocks or more on each side, a third of the page in all): full-width blocks
    down to 0.6 of a band below the top of the columns, left, right, other full-width blocks, the
    rest. A band is 8 % of the page, 120 at least."""
    w = Window.partitionBy(*page)
    side = F.col("column").isin("left", "right")
    left, right = F.count(F.when(F.col("column") == "left", 1)).over(w), F.count(F.when(F.col("column") == "right", 1)).over(w)
    seen = (left >= 2) & (right >= 2) & (left + right >= F.greatest(F.lit(4), F.floor(F.count(F.lit(1)).over(w) * 0.35)))
    top = F.coalesce(F.min(F.when(side, F.floor("y0"))).over(w), F.lit(0))
    limit = top + F.floor(F.greatest(F.lit(120), F.floor(page_h * 0.08)) * 0.6)
    wide = F.col("column").isin("full", "span")
    zone = F.when(~(F.coalesce("two_columns", F.lit(False)) | seen), 0).when(wide & (F.floor("y0") <= limit), 0).when(F.col("column") == "left", 1).when(F.col("column") == "right", 2).when(wide, 3).otherwise(4)
    b = blocks.withColumn("zone", zone)
    return b.withColumn("reading_order", F.row_number().over(w.orderBy("zone", F.floor("y0"), F.floor("x0"), tie)))


def neighbour_links(blocks: DataFrame, page: list[str], order: str = "reading_order") -> DataFrame:
    """Previous and next text block, and a shared key of an equation and its neighbours.
    Of two equations beside a block the later gives the key."""
    w = Window.partitionBy(*page).orderBy(order)
    b = blocks.withColumn("prev_id", F.lag("seq_id").over(w)).withColumn("next_id", F.lead("seq_id").over(w))
    is_eq = F.col("type") == "Equation"
    near = F.when(F.lead("type").over(w) == "Equation", F.lead("seq_id").over(w)).when(F.lag("type").over(w) == "Equation", F.lag("seq_id").over(w))
    return b.withColumn("affinity", F.concat(F.lit("eq:"), F.when(is_eq, F.col("seq_id")).otherwise(near)))


def label_counters(blocks: DataFrame, paper: str, order: list[str]) -> DataFrame:
    """Running figure, table and equation numbers across pages."""
    w = Window.partitionBy(paper).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for kind, short in (("Figure", "fig"), ("Table", "table"), ("Equation", "eq")):
        out = out.withColumn(f"__{short}", F.sum(F.when(F.col("type") == kind, 1).otherwise(0)).over(w))
    label = F.when(F.col("type") == "Figure", F.concat(F.lit("fig."), F.col("__fig"))).when(F.col("type") == "Table", F.concat(F.lit("table."), F.col("__table"))).when(F.col("type") == "Equation", F.concat(F.lit("eq."), F.col("__eq")))
    return out.withColumn("label", label).drop("__fig", "__table", "__eq")


def section_fill(blocks: DataFrame, paper: str, order: list[str], title: Column) -> DataFrame:
    """The latest non-empty title carried to each block."""
    w = Window.partitionBy(paper).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last_value(F.when(title != "", title), ignoreNulls=True).over(w))


def title_segments(blocks: DataFrame, paper: str, order: str, is_title: Column, text: Column, least: int = 20) -> DataFrame:
    """A segment from each title to the next; short ones dropped, the rest numbered; none for a
    paper without titles (F05)."""
    w = Window.partitionBy(paper).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("t", is_title).withColumn("x", text).withColumn("island", F.sum(F.col("t").cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.when(~F.col("t"), F.struct(F.col(order).alias("o"), "x"))))
    seg = b.groupBy(paper, "island").agg(F.coalesce(F.max(F.when(F.col("t"), F.col("x"))), F.lit("Front Matter")).alias("title"), F.array_join(F.transform(parts, lambda p: p["x"]), "\n").alias("text"))
    titled = Window.partitionBy(paper)
    seg = seg.withColumn("titles", F.max("island").over(titled)).where((F.col("titles") > 0) & (F.length("text") >= least))
    return seg.withColumn("segment", F.row_number().over(Window.partitionBy(paper).orderBy("island"))).select(paper, "segment", "title", "text")


def _norm(text: str, most_chars: int) -> Column:
    """The squashed text in lower case; null where its beginning alone is too long for a header."""
    start = T.squash(F.substring(text, 1, 2 * most_chars))
    may = (F.length(text) <= 2 * most_chars) | (F.length(start) < most_chars)
    return F.lower(F.when(may, T.squash(F.col(text))))


def _fits(norm: str, most_chars: int) -> Column:
    """Whether a text has 1 character at least and fewer than most_chars; names norm only once, as
    Spark works it out anew for each name in a filter."""
    return F.pmod(F.length(norm) - 1, F.lit(1 << 30)) < most_chars - 1


def running_headers(rows: DataFrame, group: str, page: str, text: str, least_pages: int = 3, most_chars: int = 90) -> DataFrame:
    """Short texts that repeat on three pages of a group or more (C17)."""
    r = rows.select(group, page, _norm(text, most_chars).alias("norm")).where(_fits("norm", most_chars))
    return r.groupBy(group, "norm").agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least_pages)


def without_running_headers(rows: DataFrame, group: str, page: str, text: str, least_pages: int = 3, most_chars: int = 90) -> DataFrame:
    """rows whose text is no running header. The others' keys are a column, so that no text moves
    for its key alone; texts that can be none meet nothing, each page's on its own."""
    heads = running_headers(rows, group, page, text, least_pages, most_chars).select(F.col(group).alias("g"), "norm")
    own = F.concat(F.lit("\n"), F.coalesce(F.col(page).cast("string"), F.lit("")))
    keyed = rows.withColumn("__norm", _norm(text, most_chars)).withColumn("__key", F.when(_fits("__norm", most_chars), F.col("__norm")).otherwise(own))
    return keyed.join(heads, (F.col(group) == F.col("g")) & (F.col("__key") == F.col("norm")), "left_anti").drop("__norm", "__key")


def match_readers(a: DataFrame, b: DataFrame, page: list[str]) -> DataFrame:
    """Blocks of reader B for each of reader A: by seq_id, else by place on the same page.
    Both have page columns, seq_id, bbox, content, score, type."""
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in (*page, "seq_id", "bbox", "content", "score")])
    same_page = None
    for c in page:
        cond = F.col(c) == F.col(f"b_{c}")
        same_page = cond if same_page is None else same_page & cond
    by_id = a.join(right, same_page & (F.col("seq_id") == F.col("b_seq_id"))).withColumn("by_id", F.lit(True))
    rest = a.join(b.select(*page, "seq_id").distinct(), [*page, "seq_id"], "left_anti")
    place = (G.iou(F.col("bbox"), F.col("b_bbox")) > 0.1) | G.center_inside(F.col("b_bbox"), F.col("bbox"))
    return by_id.unionByName(rest.join(right, same_page & place).withColumn("by_id", F.lit(False)))


def arbitrate(a: DataFrame, b: DataFrame, page: list[str], margin: float = 0.10) -> DataFrame:
    """One block for each of reader A with the chosen content and scores (D08 without rescue)."""
    key = [*page, "seq_id"]
    found = match_readers(a, b, page).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_seq_id", F.trim("b_content").alias("c")))), lambda x: x["c"]), " ").alias("b_text"), F.avg("b_score").alias("b_mean"))
    j = a.join(found, key, "left").withColumn("b_text", F.trim(F.coalesce("b_text", F.lit("")))).withColumn("b_mean", F.coalesce("b_mean", F.lit(0.0)))
    j = j.withColumn("pick", G.decide_content(F.col("type"), F.trim("content"), F.col("score"), F.col("b_text"), F.col("b_mean"), margin))
    final = F.when(F.col("pick.source") == "stack_b_override", F.col("b_mean")).otherwise(F.when(F.col("score") > 0, F.col("score")).otherwise(F.col("b_mean")))
    return j.select(*key, "type", F.col("pick.content").alias("content"), F.col("pick.source").alias("source"), F.round(F.greatest(F.lit(0.0), final), 4).alias("score"), F.round(F.greatest("score", "b_mean"), 4).alias("arbiter_score"))


def nearest_section(refs: DataFrame, sections: DataFrame, group: str) -> DataFrame:
    """The section whose span holds a position, else the last that ends before it.
    refs: (group, ref, pos); sections: (group, section, first, last)."""
    s = sections.select(F.col(group).alias("g"), "section", "first", "last")
    j = refs.join(s, (F.col(group) == F.col("g")) & ((F.col("first") <= F.col("pos")) & (F.col("pos") <= F.col("last")) | (F.col("last") <= F.col("pos"))))
    inside = (F.col("first") <= F.col("pos")) & (F.col("pos") <= F.col("last"))
    return j.groupBy(group, "ref", "pos").agg(F.max_by("section", F.struct(inside.cast("int"), "last", "section")).alias("section"))


def first_claim(sections: DataFrame, group: str) -> DataFrame:
    """The first section that claims a ref (D16). sections: (group, section, refs)."""
    r = sections.select(group, "section", F.posexplode("refs").alias("p", "ref"))
    return r.groupBy(group, "ref").agg(F.min_by("section", F.struct("section", "p")).alias("section"))


def uncovered(refs: DataFrame, used: DataFrame, group: str, most: int = 180) -> DataFrame:
    """Refs that no section uses, in order, at most 180 a group."""
    left = refs.join(used.select(group, "ref").distinct(), [group, "ref"], "left_anti")
    n = F.row_number().over(Window.partitionBy(group).orderBy("pos"))
    return left.withColumn("n", n).where(F.col("n") <= most)


def coverage(rows: DataFrame, group: str) -> DataFrame:
    """Characters and refs that are assigned or dropped (E06, E07). rows: (group, ref, text,
    assigned, dropped)."""
    on = F.col("assigned") | F.col("dropped")
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("refs"), F.sum(on.cast("int")).alias("covered"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("assigned"), F.length("text")).otherwise(0)).alias("kept_chars"))
    return g.withColumn("ref_ratio", F.round(F.col("covered") / F.col("refs"), 4)).withColumn("char_ratio", F.round(F.least(F.lit(2.0), F.col("kept_chars") / F.greatest(F.lit(1), F.col("chars"))), 4))


def quality_metrics(blocks: DataFrame, group: str, *, min_blocks: int = 16, min_avg: float = 4.0, max_b: float = 0.92, min_avg_high_b: float | None = None) -> DataFrame:
    """Blocks with text, their word runs, shares by reader and reasons for low quality.
    blocks: (group, text, source); readers are told by the beginning of source."""
    high = max(min_avg, 2 * min_avg) if min_avg_high_b is None else min_avg_high_b
    text, reader = T.squash(F.col("text")), F.lower(F.trim(F.coalesce("source", F.lit(""))))
    runs = F.regexp_count(text, F.lit(f"[A-Za-z0-9{T.CJK}]+"))
    g = blocks.where(text != "").groupBy(group).agg(F.count(F.lit(1)).alias("block_count"), F.sum(runs).cast("long").alias("token_total"), F.count(F.when(reader.startswith("stack_a"), 1)).alias("stack_a_count"), F.count(F.when(reader.startswith("stack_b"), 1)).alias("stack_b_count"))
    avg, share = F.col("token_total") / F.col("block_count"), F.col("stack_b_count") / F.col("block_count")
    enough = F.col("block_count") >= min_blocks
    few = F.when(enough & (avg < min_avg), F.format_string(f"avg_tokens_per_block=%.2f<{min_avg:.2f}", avg))
    one = F.when(enough & (share > max_b) & (avg < high), F.format_string(f"stack_b_ratio=%.3f>{max_b:.3f} with avg_tokens=%.2f<{high:.2f}", share, avg))
    g = g.withColumn("avg_tokens_per_block", F.round(avg, 4)).withColumn("stack_a_ratio", F.round(F.col("stack_a_count") / F.col("block_count"), 4)).withColumn("stack_b_ratio", F.round(share, 4))
    return g.withColumn("reasons", F.array_compact(F.array(few, one))).withColumn("low_quality", F.size("reasons") > 0)


def page_audit(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Counts by type and whether an order number repeats."""
    return blocks.groupBy(*page).agg(*[F.sum((F.col("type") == t).cast("int")).alias(t.lower()) for t in ("Body", "Figure", "Table", "Equation")], F.count(F.lit(1)).alias("blocks"), (F.count("reading_order") != F.count_distinct("reading_order")).alias("order_repeats"))


def longest_as_abstract(rows: DataFrame, group: str, least: int = 300) -> DataFrame:
    """The longest row of the first page, of 300 characters or more, for papers without an
    abstract (F23). rows: (group, page, ref, text, label)."""
    has = rows.where("label = 'Abstract'").select(group).distinct()
    r = rows.join(has, group, "left_anti").where((F.col("page") == 1) & (F.length("text") >= least))
    return r.groupBy(group).agg(F.max_by("ref", F.struct(F.length("text"), F.col("ref"))).alias("ref"), F.max(F.length("text")).alias("chars")).withColumn("label", F.lit("Abstract"))


def batches(rows: DataFrame, group: str, order: str, size: int = 5) -> DataFrame:
    """Numbers of fixed-size batches in order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("long"))
