"""Queries of pages as two readers see them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.body import body_phase
from corvane.functions.regions import Region
from corvane.operators import arbitration as X
from corvane.operators import captions as Y
from corvane.operators import layout as L
from corvane.operators import media as M
from corvane.operators import pages as P
from corvane.plans.catalog import _BLOCKS, blocks, query, t

# Two readers of documents' lines: reader B sees boxes 15 lower, other words in every third block,
# and shares only every fourth block's id.
_A = f"(SELECT doc_id, page, pos, seq_id, type, text AS content, (doc_id * 7 + pos * 3) % 100 / 100.0 AS score, x0 % 90 AS x, y0 % 150 AS y FROM {_BLOCKS} WHERE pos % 5 <> 4)"
_B = f"(SELECT doc_id, page, pos, CASE WHEN pos % 4 = 0 THEN seq_id ELSE 'b' || seq_id END AS seq_id, type, CASE WHEN pos % 3 = 0 THEN reverse(text) ELSE text END AS content, (doc_id * 7 + pos * 3 + 8) % 100 / 100.0 AS score, x0 % 90 AS x, y0 % 150 + 15 AS y FROM {_BLOCKS})"


def readers(spark, sf):
    b = blocks(spark, sf)

    def see(rows, seq, content, down, shift):
        x, y = F.col("x0") % 90, F.col("y0") % 150 + down
        return rows.select("doc_id", "page", "pos", seq.alias("seq_id"), "type", content.alias("content"), ((F.col("doc_id") * 7 + F.col("pos") * 3 + shift) % 100 / 100.0).alias("score"), F.array(x, y, x + 120, y + 60).alias("bbox"))

    other = F.when(F.col("pos") % 4 == 0, F.col("seq_id")).otherwise(F.concat(F.lit("b"), "seq_id"))
    words = F.when(F.col("pos") % 3 == 0, F.reverse("text")).otherwise(F.col("text"))
    return see(b.where("pos % 5 <> 4"), F.col("seq_id"), F.col("text"), 0, 0), see(b, other, words, 15, 8)


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '^\s+', ''), '\s+$', '')"


def _inter(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x, {b}.x) + 120 - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y, {b}.y) + 60 - greatest({a}.y, {b}.y))"


def _center(s: str, b: str) -> str:
    return f"({s}.x + 60 BETWEEN {b}.x AND {b}.x + 120 AND {s}.y + 30 BETWEEN {b}.y AND {b}.y + 60)"


_FAILED = "({0} = '' OR {0} = '[Equation]' OR contains({0}, 'Failed to OCR Equation'))"
_TEX = r"(NOT {0} AND (regexp_matches({1}, '[\\^_{{}}]') OR (regexp_matches({1}, '[=+\-*/<>]') AND regexp_matches({1}, '[A-Za-z0-9]')) OR regexp_matches({1}, '(?i)\b(sum|prod|frac|sqrt|alpha|beta|gamma|theta|lambda)\b')))"
_FA, _FB = _FAILED.format("ta"), _FAILED.format("tb")
_LA, _LB = _TEX.format(_FA, "ta"), _TEX.format(_FB, "tb")


@query(rf"""WITH a AS (SELECT *, {_strip("content")} AS ta FROM {_A}), b AS (SELECT *, {_strip("content")} AS tb FROM {_B}),
c AS (
  SELECT a.doc_id, a.page, a.pos AS ap, b.pos AS bp, a.seq_id = b.seq_id AS by_id FROM a JOIN b USING (doc_id, page)
  WHERE a.seq_id = b.seq_id OR (NOT EXISTS (SELECT 1 FROM b d WHERE d.doc_id = a.doc_id AND d.page = a.page AND d.seq_id = a.seq_id) AND ({_inter("a", "b")} / (14400.0 - {_inter("a", "b")}) > 0.1 OR {_center("b", "a")}))),
m AS (SELECT c.doc_id, c.page, ap, bool_or(by_id) AS by_id, coalesce(string_agg(tb, ' ' ORDER BY bp) FILTER (WHERE tb <> ''), '') AS tb, avg(b.score) AS sb FROM c JOIN b ON b.doc_id = c.doc_id AND b.pos = c.bp GROUP BY ALL),
p AS (SELECT a.*, coalesce(m.by_id, false) AS by_id, coalesce(m.tb, '') AS tb, coalesce(m.sb, 0) AS sb FROM a LEFT JOIN m ON m.doc_id = a.doc_id AND m.ap = a.pos),
d AS (
  SELECT *, CASE WHEN type = 'Equation' THEN
      CASE WHEN {_FA} AND NOT {_FB} THEN 'stack_b_override' WHEN {_FB} AND NOT {_FA} THEN 'stack_a' WHEN {_FA} THEN 'equation_failed'
           WHEN {_LA} AND {_LB} THEN CASE WHEN sb > score + 0.1 THEN 'stack_b_override' ELSE 'stack_a' END
           WHEN {_LB} THEN 'stack_b_override' WHEN {_LA} THEN 'stack_a' WHEN length(tb) > length(ta) AND sb > score + 0.2 THEN 'stack_b_override' ELSE 'stack_a' END
    WHEN (length(ta) < 3 AND length(tb) > 3) OR (sb > score + 0.1 AND length(tb) >= greatest(3, floor(length(ta) * 0.85))) OR (type IN ('Figure', 'Table') AND length(tb) > length(ta)) THEN 'stack_b_override' ELSE 'stack_a' END AS source FROM p),
f AS (SELECT *, CASE source WHEN 'stack_a' THEN ta WHEN 'stack_b_override' THEN tb ELSE '<Failed to OCR Equation>' END AS final FROM d),
o AS (
  SELECT c.doc_id, c.bp, c.ap, f.source <> 'stack_b_override' AND NOT f.by_id AND b.tb <> '' AND NOT coalesce(f.final <> '' AND (contains(lower(u), lower(v)) OR contains(lower(v), lower(u))
      OR len(list_intersect(string_split(lower(u), ' '), string_split(lower(v), ' '))) >= 0.6 * len(list_distinct(string_split(lower(u) || ' ' || lower(v), ' ')))), false) AS back
  FROM c JOIN f ON f.doc_id = c.doc_id AND f.pos = c.ap JOIN b ON b.doc_id = c.doc_id AND b.pos = c.bp, LATERAL (SELECT trim(regexp_replace(b.tb, '\s+', ' ', 'g')) AS u, trim(regexp_replace(f.final, '\s+', ' ', 'g')) AS v)),
u AS (SELECT b.doc_id, b.page, b.pos, b.x, b.y FROM b LEFT JOIN (SELECT doc_id, bp, arg_max(back, ap) AS back FROM o GROUP BY ALL) l ON l.doc_id = b.doc_id AND l.bp = b.pos WHERE coalesce(back, true)),
g AS (
  SELECT doc_id, page, list_reduce(list_prepend(coalesce((SELECT list({{'pos': -1, 'x': x, 'y': y}}) FROM a WHERE a.doc_id = u.doc_id AND a.page = u.page), []), list([{{'pos': pos, 'x': x, 'y': y}}] ORDER BY pos)),
    lambda acc, n: CASE WHEN len(list_filter(acc, lambda o: {_inter("o", "n[1]")} / (14400.0 - {_inter("o", "n[1]")}) > 0.2 OR {_center("n[1]", "o")})) > 0 THEN acc ELSE list_concat(acc, n) END) AS kept
  FROM u GROUP BY doc_id, page),
r AS (SELECT doc_id, page, unnest(kept).pos AS pos FROM g),
z AS (
  SELECT doc_id, page, 'a' AS reader, pos, source, CASE WHEN type = 'Equation' AND {_FAILED.format("final")} THEN '<Failed to OCR Equation>' ELSE final END AS content, round(CASE WHEN source = 'stack_b_override' THEN sb WHEN score > 0 THEN score ELSE sb END, 4) AS score, x, y FROM f
  UNION ALL SELECT b.doc_id, b.page, 'b', b.pos, 'stack_b_rescue', b.tb, round(b.score, 4), b.x, b.y FROM r JOIN b ON b.doc_id = r.doc_id AND b.pos = r.pos)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, reader, pos)::INT AS n, reader, pos, source, md5(content) AS content_md5, score FROM z""")
def arbitrated_pages(spark, sf):
    """Matching, choice, release, rescue, order."""
    a, b = readers(spark, sf)
    return X.arbitrate_pages(a, b, ["doc_id", "page"]).select("doc_id", "page", "n", "reader", "pos", "source", F.md5("content").alias("content_md5"), "score")


@query()
def reader_rescue(spark, sf):
    """Blocks of other kinds that no body covers, in order of their lines."""
    b = blocks(spark, sf)
    box = F.array("x0", "y0", F.col("x0") + 120, F.col("y0") + 60).alias("bbox")
    free = b.where("type <> 'Body'").select("doc_id", "page", "pos", F.struct("pos", "seq_id", box).alias("block"))
    return X.rescued(b.where("type = 'Body'").select("doc_id", "page", box), free, ["doc_id", "page"]).select("doc_id", "page", "block.seq_id")


# Layout: a third of the documents on pages that are told to have two columns.
@query(f"""WITH b AS (SELECT *, CASE pos % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'full' WHEN 3 THEN CASE doc_id % 2 WHEN 0 THEN 'left' ELSE 'span' END ELSE CASE doc_id % 5 WHEN 0 THEN 'other' ELSE 'right' END END AS col, pos // 11 AS sheet FROM {_BLOCKS}),
c AS (SELECT *, count(*) FILTER (col = 'left') OVER w AS l, count(*) FILTER (col = 'right') OVER w AS r, count(*) OVER w AS n, coalesce(min(y0) FILTER (col IN ('left', 'right')) OVER w, 0) AS top FROM b WINDOW w AS (PARTITION BY doc_id, sheet)),
z AS (SELECT *, CASE WHEN NOT (doc_id % 3 = 0 OR (l >= 2 AND r >= 2 AND l + r >= greatest(4, floor(n * 0.35)))) THEN 0 WHEN col IN ('full', 'span') AND y0 <= top + 72 THEN 0 WHEN col = 'left' THEN 1 WHEN col = 'right' THEN 2 WHEN col IN ('full', 'span') THEN 3 ELSE 4 END AS zone FROM c)
SELECT doc_id, sheet::BIGINT AS sheet, seq_id, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY zone, y0, x0, seq_id)::INT AS reading_order FROM z""")
def reading_order(spark, sf):
    """F01, G08, G09."""
    p, d = F.col("pos"), F.col("doc_id")
    column = F.when(p % 5 == 0, "left").when(p % 5 == 1, "right").when(p % 5 == 2, "full").when(p % 5 == 3, F.when(d % 2 == 0, "left").otherwise("span")).otherwise(F.when(d % 5 == 0, "other").otherwise("right"))
    b = blocks(spark, sf).withColumn("sheet", F.floor(p / 11)).withColumn("column", column).withColumn("two_columns", d % 3 == 0)
    return L.reading_order(b, ["doc_id", "sheet"], F.lit(760)).select("doc_id", "sheet", "seq_id", "reading_order")


_BOX = "[x0, y0 % 260, 6 + (x0 * 7 + pos) % 190, 4 + (y0 * 3 + pos) % 70]"


@query(f"""WITH b AS (SELECT doc_id, pos // 12 AS sheet, list([{_BOX}] ORDER BY pos) AS l FROM {_BLOCKS} WHERE 6 + (x0 * 7 + pos) % 190 >= 10 AND 4 + (y0 * 3 + pos) % 70 >= 10 GROUP BY ALL),
m AS (SELECT doc_id, sheet, list_reduce(list_prepend([]::BIGINT[][], l), lambda acc, e: CASE WHEN list_position(list_transform(acc, lambda m: greatest(m[2], e[1][2]) - least(m[2] + m[4], e[1][2] + e[1][4]) <= 16 AND greatest(m[1], e[1][1]) - least(m[1] + m[3], e[1][1] + e[1][3]) <= 24
    AND NOT (greatest(m[1] + m[3], e[1][1] + e[1][3]) - least(m[1], e[1][1]) > 600 * 0.62 AND greatest(m[3], e[1][3]) < 600 * 0.46)), true) IS NULL THEN list_concat(acc, e)
  ELSE list_transform(acc, lambda m, i: CASE WHEN i = list_position(list_transform(acc, lambda m: greatest(m[2], e[1][2]) - least(m[2] + m[4], e[1][2] + e[1][4]) <= 16 AND greatest(m[1], e[1][1]) - least(m[1] + m[3], e[1][1] + e[1][3]) <= 24
    AND NOT (greatest(m[1] + m[3], e[1][1] + e[1][3]) - least(m[1], e[1][1]) > 600 * 0.62 AND greatest(m[3], e[1][3]) < 600 * 0.46)), true)
    THEN [least(m[1], e[1][1]), least(m[2], e[1][2]), greatest(m[1] + m[3], e[1][1] + e[1][3]) - least(m[1], e[1][1]), greatest(m[2] + m[4], e[1][2] + e[1][4]) - least(m[2], e[1][2])] ELSE m END) END) AS b FROM b)
SELECT doc_id, sheet::BIGINT AS sheet, n::INT AS n, array_to_string(b[n + 1], ',') AS box FROM (SELECT *, unnest(range(len(b))) AS n FROM m)""")
def merged_boxes(spark, sf):
    """twelve lines a page, 600 wide."""
    p, x, y = F.col("pos"), F.col("x0"), F.col("y0")
    b = blocks(spark, sf).select("doc_id", F.floor(p / 12).alias("sheet"), "pos", F.array(x, y % 260, 6 + (x * 7 + p) % 190, 4 + (y * 3 + p) % 70).alias("bbox"))
    return P.merge_boxes(b, ["doc_id", "sheet"], "pos", F.lit(600)).select("doc_id", "sheet", "n", F.array_join(F.transform("bbox", lambda v: v.cast("string")), ",").alias("box"))


# Regions: line items of an order as a page of 700 by 1000, captions on odd lines.
_R = """SELECT l_orderkey, l_linenumber, (l_partkey % 3) * 220 AS x, 60 + l_linenumber * 110 + l_partkey % 45 AS y, CASE WHEN l_suppkey % 37 = 0 THEN 0 ELSE 90 + l_suppkey % 160 END AS w, CASE WHEN l_linenumber % 2 = 1 THEN 22 + l_suppkey % 60 ELSE 60 + l_orderkey % 50 END AS h,
  ['left', 'right', 'full', 'span', ''][l_partkey % 5 + 1] AS col, ['Figure', 'Table', 'Figure', 'Body'][l_suppkey % 4 + 1] AS kind FROM lineitem"""


def caption_regions(spark, sf):
    i = t(spark, sf, "lineitem")
    k, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    x, y = (p % 3) * 220, 60 + n * 110 + p % 45
    w, h = F.when(s % 37 == 0, 0).otherwise(90 + s % 160), F.when(n % 2 == 1, 22 + s % 60).otherwise(60 + k % 50)
    kind = pick(["Figure", "Table", "Figure", "Body"], s % 4)
    return i.select("l_orderkey", n.alias("pos"), F.array(x, y, x + w, y + h).alias("bbox"), pick(["left", "right", "full", "span", ""], p % 5).alias("column"), kind.alias("kind"), F.lit(700).alias("page_w"), F.lit(1000).alias("page_h"), s, p)


@query(f"""WITH r AS ({_R}), p AS (
  SELECT a.l_orderkey, a.l_linenumber AS pos, c.l_linenumber AS cap, a.h AS ah, c.h AS ch, a.w AS aw, c.w AS cw, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) / greatest(1, least(a.w, c.w)) AS o, c.y - a.y - a.h AS below, a.y - c.y - c.h AS above,
    CASE a.col WHEN '' THEN 'full' ELSE a.col END AS m, CASE c.col WHEN '' THEN 'full' ELSE c.col END AS n, a.col AS mc, c.col AS cc, a.kind AS ak, c.kind AS ck FROM r a JOIN r c ON a.l_orderkey = c.l_orderkey AND a.l_linenumber % 2 = 0 AND c.l_linenumber % 2 = 1),
g AS (SELECT *, greatest(CASE WHEN below >= 0 THEN greatest(0, 1 - below / 90) ELSE 0 END, CASE WHEN above >= 0 THEN 0.85 * greatest(0, 1 - above / 30) ELSE 0 END) AS gap FROM p)
SELECT l_orderkey, pos, cap, CASE WHEN aw = 0 OR cw = 0 THEN 'BAD_GEOMETRY' WHEN m <> n AND NOT (m IN ('full', 'span') AND n IN ('full', 'span')) THEN 'CAPTION_NOT_SAME_COLUMN' WHEN o < 0.18 THEN 'CAPTION_X_OVERLAP_LOW' WHEN below < 0 AND above < 0 THEN 'CAPTION_NOT_ABOVE_OR_BELOW'
  WHEN below >= 0 AND below > 100 THEN 'CAPTION_GAP_TOO_FAR' WHEN below < 0 AND above > 70 THEN 'CAPTION_GAP_TOO_FAR_TOP' WHEN ck = 'Body' THEN 'CAPTION_TYPE_UNKNOWN' WHEN ak = 'Body' THEN 'MAIN_TYPE_INVALID' WHEN ak <> ck THEN 'CAPTION_TYPE_MISMATCH'
  WHEN ch > greatest(200, floor(ah * 0.95)) THEN 'CAPTION_TOO_TALL' ELSE 'OK' END AS reason,
  round(CASE WHEN aw = 0 OR cw = 0 OR o < 0.18 OR gap <= 0 THEN 0 ELSE least(1, 0.55 * o + 0.25 * gap + 0.12 * (1 - abs(aw - cw) / greatest(aw, cw)) + 0.08 * (mc = cc OR mc = 'span' OR cc = 'span')::INT) END, 6)::DOUBLE AS score FROM g""")
def caption_pair_rules(spark, sf):
    """All pairs of a figure or table and a caption of an order."""
    r = caption_regions(spark, sf)
    a = r.where("pos % 2 = 0").select("l_orderkey", "pos", F.struct("bbox", "column", "kind").alias("a"), "page_h")
    c = r.where("pos % 2 = 1").select("l_orderkey", F.col("pos").alias("cap"), F.struct("bbox", "column", "kind").alias("c"))
    box = (F.col("a.bbox"), F.col("c.bbox"), F.col("a.column"), F.col("c.column"), F.col("page_h"))
    return a.join(c, "l_orderkey").select("l_orderkey", "pos", "cap", Y.pair_reason(*box, F.col("a.kind"), F.col("c.kind")).alias("reason"), F.round(Y.pair_score(*box), 6).alias("score"))


@query()
def caption_pairs(spark, sf):
    """Captions of orders assigned to figures and tables, some with one inside."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    r = caption_regions(spark, sf).withColumn("is_major", F.col("pos") % 2 == 0).withColumn("is_caption", F.col("pos") % 2 == 1)
    r = r.select("l_orderkey", "pos", "bbox", "column", "page_w", "page_h", "is_major", "is_caption", F.col("kind").alias("pred"), (s % 10 / 10.0).alias("figure_score"), (p % 10 / 10.0).alias("table_score"), (s % 7 != 0).alias("can_figure"), (p % 7 != 0).alias("can_table"), F.when(F.col("kind") != "Body", F.col("kind")).otherwise("").alias("target"),
        F.when(p % 4 == 1, "Figure").when(p % 4 == 2, "Table").otherwise("").alias("embedded"), F.when(s % 3 == 0, "ocr").when(s % 3 == 1, "hint").otherwise("geom").alias("embedded_by"), F.when(s % 5 == 0, "Figure").otherwise("").alias("read_target"), F.array().cast("array<string>").alias("reasons"))
    return Y.assign_captions(r, ["l_orderkey"])


# Body regions: line items on pages of 1000 by 1400, scores and labels by arithmetic.
_BODY = {
    "x1": "l_suppkey % 640", "y1": "(l_partkey * 7) % 1200", "w": "20 + (l_orderkey * 7 + l_linenumber * 31) % 620", "h": "8 + (l_partkey * 13 + l_orderkey) % 90", "text_density": "(l_partkey % 26) / 10.0", "small_cc_count": "l_suppkey % 110", "table_grid_score": "(l_orderkey % 30) / 1000.0",
    "grid_intersection_ratio": "((l_orderkey + l_partkey) % 12) / 10000.0", "t": "(l_partkey % 90) / 100.0", "f": "(l_suppkey % 90) / 100.0", "b": "(l_orderkey % 95) / 100.0", "e": "((l_orderkey + l_suppkey) % 92) / 100.0", "c": "(l_linenumber * 17 % 100) / 100.0",
}
_BODY_SQL = f"""(SELECT l_orderkey, l_linenumber, {', '.join(f'cast({v} AS DOUBLE) AS {k}' for k, v in _BODY.items())}, l_orderkey % 3 AS page, l_suppkey % 4 = 0 AS lost, l_partkey % 9 = 0 AS eq, CASE l_partkey % 11 WHEN 0 THEN 'MainTitle' WHEN 1 THEN 'SubSubtitle' WHEN 2 THEN 'Other' ELSE '' END AS hint, CASE l_suppkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'left' ELSE 'span' END AS col FROM lineitem)"""


@query(f"""WITH r AS (SELECT *, x1 + w AS x2, eq AND c >= 0.70 AND w >= 100 AND h >= 19 AS forced FROM {_BODY_SQL}),
k AS (SELECT *, CASE WHEN forced OR (e >= greatest(0.68, b - 0.04) AND table_grid_score <= 0.022 AND grid_intersection_ratio <= 0.00065 AND w >= 140 AND h >= 22) THEN 1 WHEN page >= 2 AND y1 <= 84 AND h <= 49 AND w <= 700 THEN 2 WHEN hint IN ('MainTitle', 'Subtitle', 'SubSubtitle') AND c >= 0.70 THEN 3
  WHEN h >= 18 AND h <= 44 AND w BETWEEN 40 AND 260 AND y1 <= 840 AND x1 >= 50 AND x2 <= 950 AND text_density <= 1.95 AND small_cc_count <= 78 AND t < greatest(0.68, b + 0.03) AND f < greatest(0.68, b + 0.03) THEN 4 WHEN lost AND greatest(t, f) >= greatest(0.72, b + 0.04) THEN 5
  WHEN col IN ('full', 'span') AND y1 <= 252 AND h <= 140 AND h >= 35 AND w >= 520 AND text_density <= 2.40 AND t < greatest(0.70, b + 0.02) AND f < greatest(0.70, b + 0.02) THEN 6
  WHEN h >= 22 AND h <= 63 AND w BETWEEN 160 AND 420 AND x1 <= 620 AND y1 <= 1120 AND text_density <= 1.95 AND small_cc_count <= 95 AND t < greatest(0.70, b + 0.03) AND f < greatest(0.70, b + 0.03) THEN 7 ELSE 0 END AS rule FROM r)
SELECT l_orderkey, l_linenumber, CASE rule WHEN 1 THEN 'Equation' WHEN 2 THEN 'Header' WHEN 3 THEN hint WHEN 4 THEN 'Subtitle' WHEN 5 THEN 'Unknown' WHEN 6 THEN 'MainTitle' WHEN 7 THEN CASE WHEN h >= 30 THEN 'Subtitle' ELSE 'SubSubtitle' END ELSE 'Body' END AS type,
  round(CASE rule WHEN 1 THEN greatest(b, e, c * 0.95, 0.7) WHEN 2 THEN greatest(b, 0.7) WHEN 3 THEN greatest(b, c * 0.95, 0.72) WHEN 4 THEN greatest(b, 0.73) WHEN 5 THEN greatest(0.52, least(0.78, greatest(t, f) * 0.82)) WHEN 6 THEN greatest(b, 0.78) WHEN 7 THEN greatest(b, 0.7) ELSE b END, 4)::DOUBLE AS confidence,
  array_to_string(list_sort(list_filter(['S', CASE WHEN lost THEN 'CAPTION_REQUIRED_FAIL_DEMOTE' END, CASE rule WHEN 1 THEN 'EQUATION_FALLBACK_PROMOTE' WHEN 2 THEN 'RUNNING_HEADER_ZONE' WHEN 3 THEN 'LLM_HEADING_PROMOTE' WHEN 4 THEN 'SMALL_HEADING_ZONE' WHEN 5 THEN 'DEMOTE_TO_UNKNOWN_NO_CAPTION' WHEN 6 THEN 'HEADER_ZONE' WHEN 7 THEN 'SECTION_HEADING' END, CASE WHEN rule = 1 AND forced THEN 'LLM_FORCE_EQUATION' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM k""")
def body_regions(spark, sf):
    """All line items as regions."""
    i = t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(f"cast({v} AS DOUBLE) AS {k}" for k, v in _BODY.items()))
    zero = F.lit(0.0)
    r = i.withColumns({"x2": F.col("x1") + F.col("w"), "page_w": F.lit(1000.0), "page_h": F.lit(1400.0), "area_ratio": zero, "line_h_ratio": zero, "line_v_ratio": zero, "fg_ratio": zero})
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    hint = F.when(p % 11 == 0, "MainTitle").when(p % 11 == 1, "SubSubtitle").when(p % 11 == 2, "Other").otherwise("")
    column = F.when(s % 3 == 0, "full").when(s % 3 == 1, "left").otherwise("span")
    b = body_phase(Region.of_columns(), F.col("t"), F.col("f"), F.col("b"), F.col("e"), column, F.col("l_orderkey") % 3, s % 4 == 0, F.when(p % 9 == 0, "Equation"), F.col("c"), hint, F.array(F.lit("S"), F.lit(" ")))
    return r.withColumn("k", b).select("l_orderkey", "l_linenumber", "k.type", F.col("k.type_confidence").alias("confidence"), F.array_join("k.reasons", ",").alias("reasons"))


@query()
def media_galleries(spark, sf):
    """Figures of documents, half with a sidecar, two thirds with a picture."""
    b = blocks(spark, sf)
    d, p = F.col("doc_id"), F.col("pos")
    seq = F.format_string("p%d_figure_%d", F.col("page").cast("int"), p.cast("int"))
    pid = F.concat(F.lit("p"), F.floor(d / 20))
    none = F.lit(None).cast("string")
    box = F.array("x0", "y0", F.col("x0") + 120, F.col("y0") + 60)
    png = F.concat(F.lit("/x/"), d, F.lit("_"), seq, F.lit(".png"))
    fields = [F.col("type"), F.col("page").cast("int").alias("page"), none.alias("pair_id"), box.alias("bbox"), F.when(p % 3 == 0, png).alias("png_path"), none.alias("caption_text"), (p % 2 == 0).alias("has_caption"), F.when(p % 5 == 0, box).alias("caption_bbox")]
    f = b.where("type = 'Figure'")
    seq = F.concat(seq, F.lit("_"), d)
    records = f.where(d % 4 != 3).select(pid.alias("pid"), d.alias("paper_id"), p.alias("pos"), seq.alias("seq_id"), F.concat(F.lit("Figure 1. "), "text").alias("caption"), *fields)
    ocr = F.struct(F.col("text").alias("b_text"), F.lit(0.4).alias("b_score"), F.reverse("text").alias("a_text"), (p % 10 / 10.0).alias("a_score"))
    sidecars = f.where((p % 2 == 1) | (d % 4 == 3)).select(pid.alias("pid"), F.concat(seq, F.lit(".json")).alias("name"), d.cast("string").alias("paper_id"), seq.alias("seq_id"), *fields, ocr.alias("ocr"))
    images = f.where(p % 3 != 1).select(pid.alias("pid"), F.concat(seq, F.lit(".png")).alias("name"), png.alias("path"))
    g = M.media_gallery(records.withColumn("paper_id", F.col("paper_id").cast("string")), sidecars, images, "figure")
    return g.select("pid", "paper_id", "n", "seq_id", "page", "picture", F.md5("caption_text").alias("caption_md5"), "ocr_source", "ocr_score")
