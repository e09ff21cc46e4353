"""Figures and tables of a page and their captions: which region may caption which, and who gets it.

Pairs are judged side by side, each with a reason; only the assignment goes region by region, as a
fold over the figures and tables of a page that runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.regions import Region

# Limits of pairs and of captions that results depend on.
LEAST_OVERLAP, GAP_BELOW, GAP_ABOVE, LEAST_SCORE, SAME_KIND, EMBEDDED_SCORE = 0.18, 0.10, 0.07, 0.58, 0.10, 0.60
KINDS = ("Figure", "Table")


def is_caption_candidate(r: Region, hinted: Column, target: Column) -> Column:
    """A flat block of text away from the page's edges, or one that is known to be a caption."""
    flat = (r.h <= F.greatest(F.lit(260), F.floor(r.page_h * 0.16))) & (r.h >= F.greatest(F.lit(18), F.floor(r.page_h * 0.012)))
    wide = (r.w >= F.floor(r.page_w * 0.10)) & (r.w <= F.floor(r.page_w * 0.92))
    placed = (r.y1 >= F.floor(r.page_h * 0.06)) & (r.y1 <= F.floor(r.page_h * 0.96))
    return (flat & wide & placed & (r.density >= 0.35) & (r.parts >= 3) & (r.grid <= 0.070)) | F.coalesce(hinted, F.lit(False)) | F.coalesce(target.isin(*KINDS), F.lit(False))


class _Pair:
    """Two boxes as whole numbers, and how they lie."""

    def __init__(self, main: Column, cap: Column) -> None:
        self.a = [F.try_element_at(main, F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
        self.c = [F.try_element_at(cap, F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
        self.w, self.h, self.cw, self.ch = self.a[2] - self.a[0], self.a[3] - self.a[1], self.c[2] - self.c[0], self.c[3] - self.c[1]
        shared = F.greatest(F.lit(0), F.least(self.a[2], self.c[2]) - F.greatest(self.a[0], self.c[0]))
        self.overlap = shared / F.greatest(F.lit(1), F.least(self.w, self.cw))
        self.below, self.above = self.c[1] - self.a[3], self.a[1] - self.c[3]

    def whole(self) -> Column:
        return self.a[3].isNotNull() & self.c[3].isNotNull()

    def solid(self) -> Column:
        return (self.w > 0) & (self.h > 0) & (self.cw > 0) & (self.ch > 0)


def pair_reason(main: Column, cap: Column, main_column: Column, cap_column: Column, page_h: Column, expected: Column, target: Column) -> Column:
    """OK, or the first rule that a figure or table and a caption break."""
    p = _Pair(main, cap)
    m, c = F.coalesce(F.nullif(main_column, F.lit("")), F.lit("full")), F.coalesce(F.nullif(cap_column, F.lit("")), F.lit("full"))
    whole_width = m.isin("full", "span") & c.isin("full", "span")
    far = p.below > F.greatest(F.lit(6), F.floor(page_h * GAP_BELOW))
    far_top = p.above > F.greatest(F.lit(4), F.floor(page_h * GAP_ABOVE))
    tall = p.ch > F.greatest(F.floor(page_h * 0.20), F.floor(p.h * 0.95))
    return (
        F.when(~p.whole(), "BAD_BBOX").when(~p.solid(), "BAD_GEOMETRY").when((m != c) & ~whole_width, "CAPTION_NOT_SAME_COLUMN")
        .when(p.overlap < LEAST_OVERLAP, "CAPTION_X_OVERLAP_LOW").when((p.below < 0) & (p.above < 0), "CAPTION_NOT_ABOVE_OR_BELOW")
        .when((p.below >= 0) & far, "CAPTION_GAP_TOO_FAR").when((p.below < 0) & far_top, "CAPTION_GAP_TOO_FAR_TOP")
        .when(~F.coalesce(target.isin(*KINDS), F.lit(False)), "CAPTION_TYPE_UNKNOWN").when(~F.coalesce(expected.isin(*KINDS), F.lit(False)), "MAIN_TYPE_INVALID")
        .when(target != expected, "CAPTION_TYPE_MISMATCH").when(tall, "CAPTION_TOO_TALL").otherwise("OK")
    )


def pair_score(main: Column, cap: Column, main_column: Column, cap_column: Column, page_h: Column) -> Column:
    """Overlap, gap, width and column of a figure or table and a caption (I32): nothing without
    18 % of overlap, or unless the caption lies close below or, closer, above."""
    p = _Pair(main, cap)
    near = F.when(p.below >= 0, F.greatest(F.lit(0.0), 1 - p.below / F.greatest(F.lit(1), F.floor(page_h * 0.09)))).otherwise(0.0)
    over = F.when(p.above >= 0, 0.85 * F.greatest(F.lit(0.0), 1 - p.above / F.greatest(F.lit(1), F.floor(page_h * 0.03)))).otherwise(0.0)
    gap = F.greatest(near, over)
    alike = 1 - F.least(F.lit(1.0), F.abs(p.w - p.cw) / F.greatest(p.w, p.cw))
    column = F.when((main_column == cap_column) | (main_column == "span") | (cap_column == "span"), 1.0).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.55 * p.overlap + 0.25 * gap + 0.12 * alike + 0.08 * column))
    return F.when(p.whole() & p.solid() & (p.overlap >= LEAST_OVERLAP) & (gap > 0), score).otherwise(0.0)


def assign_captions(regions: DataFrame, page: list[str]) -> DataFrame:
    """Figures and tables of each page with the captions they get, from top to bottom.

    regions: page columns, pos (order of detection), bbox, column, page_w, page_h, is_major,
    is_caption, pred, figure_score, table_score, can_figure, can_table (structure allows it),
    target (kind that a caption names, else what its text is read as), embedded (kind of a caption
    inside the box), embedded_by (ocr, hint or another source, which is not trusted), read_target
    (kind read in the box itself), reasons.
    A major region takes the best pair that breaks no rule and is still free, of equal ones the
    earlier caption; without one, a trusted caption inside it counts 0.60 where the structure
    allows its kind. Under 0.58, or with neither, it is rejected. Returns page columns, pos,
    accepted, caption_pos (null: embedded), node_type, score, bbox with the caption, pair_id and
    sorted reasons. The widening of embedded figures to their neighbours is not done here."""
    none = F.lit("")
    r = regions.withColumn("kind", F.when(F.col("pred").isin(*KINDS), F.col("pred")).when(F.coalesce("table_score", F.lit(0.0)) >= F.coalesce("figure_score", F.lit(0.0)), "Table").otherwise("Figure"))
    mains = r.where("is_major").withColumn("m", F.struct("pos", "bbox", "column", "kind", "can_figure", "can_table"))
    caps = r.where("is_caption AND NOT is_major").select(*page, F.struct("pos", "bbox", "column", F.coalesce("target", none).alias("target")).alias("c"))
    allowed = F.when(F.col("c.target") == "Table", F.col("m.can_table")).when(F.col("c.target") == "Figure", F.col("m.can_figure")).otherwise(False)
    score = pair_score(F.col("m.bbox"), F.col("c.bbox"), F.col("m.column"), F.col("c.column"), F.col("page_h"))
    score = F.least(F.lit(1.0), score + F.when(F.col("c.target") == F.col("m.kind"), SAME_KIND).otherwise(0.0))
    ok = pair_reason(F.col("m.bbox"), F.col("c.bbox"), F.col("m.column"), F.col("c.column"), F.col("page_h"), F.col("c.target"), F.col("c.target")) == "OK"
    pairs = mains.select(*page, "page_h", "m").join(caps, page).where(allowed & ok).withColumn("score", score).where("score > 0")
    offers = pairs.groupBy(*page, F.col("m.pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("c.pos").alias("at"), F.col("c.target").alias("target"), F.col("c.bbox").alias("bbox")))).alias("offers"))

    inside = F.when(F.col("embedded").isin(*KINDS), F.col("embedded")).otherwise(F.coalesce("read_target", none))
    trusted = F.when(F.col("embedded").isin(*KINDS), F.col("embedded_by").isin("ocr", "hint")).otherwise(F.lit(True))
    w, h = F.col("bbox")[2].cast("long") - F.col("bbox")[0].cast("long"), F.col("bbox")[3].cast("long") - F.col("bbox")[1].cast("long")
    large = (w * h / F.greatest(F.lit(1), F.col("page_w") * F.col("page_h")) >= 0.012) & (w >= F.floor(F.col("page_w") * 0.16)) & (h >= F.floor(F.col("page_h") * 0.030))
    relaxed = (inside == "Figure") & ~F.col("can_figure") & F.coalesce(F.col("embedded_by") == "ocr", F.lit(False)) & F.coalesce(F.col("read_target") == "Figure", F.lit(False)) & large
    fits = F.when(inside == "Table", F.col("can_table")).when(inside == "Figure", F.col("can_figure") | relaxed).otherwise(False)
    rows = mains.join(offers, [*page, "pos"], "left")
    rows = rows.withColumn("offers", F.coalesce("offers", F.array().cast(offers.schema["offers"].dataType)))
    rows = rows.withColumn("inside", inside).withColumn("trusted", F.coalesce(trusted, F.lit(False))).withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("relaxed", relaxed)
    one = F.struct(F.col("bbox")[1].cast("long").alias("y"), F.col("bbox")[0].cast("long").alias("x"), "pos", "offers")
    lists = rows.groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("mains"))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<pos:bigint,offer:struct<less:double,at:bigint,target:string,bbox:array<bigint>>>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        free = F.filter(m["offers"], lambda o: ~F.array_contains(acc["used"], o["at"].cast("bigint")))
        best = F.try_element_at(free, F.lit(1))
        offer = F.when(best.isNotNull(), F.struct(best["less"].alias("less"), best["at"].cast("bigint").alias("at"), best["target"].alias("target"), best["bbox"].cast("array<bigint>").alias("bbox")))
        strong = F.coalesce(-best["less"] >= LEAST_SCORE, F.lit(False))
        used = F.when(strong, F.concat(acc["used"], F.array(best["at"].cast("bigint")))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(m["pos"].cast("bigint").alias("pos"), offer.alias("offer")))).alias("out"))

    got = lists.select(*page, F.explode(F.aggregate("mains", start, step)["out"]).alias("g")).select(*page, F.col("g.pos").alias("pos"), F.col("g.offer").alias("offer"))
    rows = rows.withColumn("pos", F.col("pos").cast("long")).join(got, [*page, "pos"])
    inner = F.col("offer").isNull() & F.col("inside").isin(*KINDS) & F.col("trusted") & F.col("fits")
    found = F.coalesce(-F.col("offer.less"), F.when(inner, EMBEDDED_SCORE))
    node = F.coalesce(F.col("offer.target"), F.when(inner, F.col("inside")))
    accepted = F.coalesce(found >= LEAST_SCORE, F.lit(False))
    box = F.when(F.col("offer").isNotNull() & accepted, F.array(*[(F.least if i < 2 else F.greatest)(F.col("bbox")[i].cast("long"), F.col("offer.bbox")[i]) for i in range(4)])).otherwise(F.transform("bbox", lambda v: v.cast("long")))
    reasons = F.array_compact(F.array(
        F.when(accepted, "CAPTION_MATCHED"), F.when(accepted, "CAPTION_REQUIRED_PASS"), F.when(accepted, F.concat(F.lit("CAPTION_TYPE_"), F.upper(node))), F.when(accepted & inner, "CAPTION_EMBEDDED"),
        F.when(accepted & (node != F.col("kind")), "CAPTION_TYPE_OVERRIDE"), F.when(found.isNull(), "CAPTION_REQUIRED_MISSING"), F.when(found < LEAST_SCORE, "CAPTION_PAIR_WEAK"),
        F.when(F.col("offer").isNull() & F.col("inside").isin(*KINDS) & ~F.col("trusted"), "EMBEDDED_CAPTION_UNTRUSTED"), F.when(inner & F.col("relaxed"), "EMBEDDED_FIGURE_OCR_HEAD_RELAX")))
    out = rows.select(*page, "pos", accepted.alias("accepted"), F.when(accepted, F.col("offer.at")).alias("caption_pos"), F.when(accepted, node).alias("node_type"), F.when(accepted, F.round(found, 4)).alias("score"), box.alias("bbox"), F.col("bbox")[1].cast("long").alias("y"), F.col("bbox")[0].cast("long").alias("x"), F.array_sort(F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), reasons))).alias("reasons"))
    n = F.count(F.when(F.col("accepted"), 1)).over(Window.partitionBy(*page, "node_type").orderBy("y", "x", "pos"))
    name = F.when(F.col("node_type") == "Figure", "fig.").when(F.col("node_type") == "Table", "table.")
    return out.withColumn("pair_id", F.concat(name, n)).drop("y", "x")
