"""Queries of regions, chains of context, prompts, sections and members, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corvane.functions import regions as Q
from corvane.operators import chain as C
from corvane.plans.catalog import query, t

# Regions: line items as boxes on a page of 1000 by 1400, features by arithmetic.
_FEATURES = {
    "x1": "l_suppkey % 700", "y1": "l_partkey % 1300", "w": "20 + (l_orderkey * 7 + l_linenumber * 31) % 900", "h": "10 + (l_partkey * 13 + l_orderkey) % 600",
    "text_density": "(l_partkey % 60) / 10.0", "small_cc_count": "l_suppkey % 130", "table_grid_score": "(l_orderkey % 30) / 1000.0", "line_h_ratio": "(l_partkey % 25) / 1000.0",
    "line_v_ratio": "(l_orderkey % 23) / 1000.0", "grid_intersection_ratio": "((l_orderkey + l_partkey) % 16) / 10000.0", "fg_ratio": "(l_partkey % 50) / 100.0",
}
_REGION = ", ".join(f"cast({v} AS DOUBLE) AS {k}" for k, v in _FEATURES.items())
_WHOLE = "x1 + w AS x2, w * h / 1400000.0 AS area_ratio, 1000.0 AS page_w, 1400.0 AS page_h"
_REGIONS = f"SELECT *, {_WHOLE} FROM (SELECT l_orderkey, l_linenumber, {_REGION} FROM lineitem) f"


def regions(spark, sf):
    double = {k: re.sub(r"\d\.0", r"\g<0>D", v) for k, v in _FEATURES.items()}  # Spark reads 10.0 as a decimal
    r = t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(f"cast({v} AS DOUBLE) AS {k}" for k, v in double.items()))
    return r.selectExpr("*", *_WHOLE.split(", "))


@query(f"""SELECT l_orderkey, l_linenumber,
 area_ratio <= 0.028 AND h <= 112 AND w >= 200 AND text_density >= 1.0 AND (table_grid_score <= 0.070 OR least(line_h_ratio, line_v_ratio) <= 0.0012) AS caption,
 area_ratio >= 0.007 AND w >= 140 AND h >= 33 AND (grid_intersection_ratio >= 0.0010 OR (grid_intersection_ratio >= 0.00045 AND table_grid_score >= 0.011) OR (table_grid_score >= 0.011 AND least(line_h_ratio, line_v_ratio) >= 0.0032 AND grid_intersection_ratio >= 0.00035))
   AND NOT (text_density <= 0.28 AND area_ratio >= 0.06 AND grid_intersection_ratio < 0.0012) AS strict_table,
 area_ratio >= 0.010 AND w >= 180 AND h >= 49 AND table_grid_score >= 0.020 AND (least(line_h_ratio, line_v_ratio) >= 0.0025 OR greatest(line_h_ratio, line_v_ratio) >= 0.020) AS soft_table,
 NOT (text_density >= 2.05 AND small_cc_count >= 70 AND table_grid_score <= 0.010 AND grid_intersection_ratio <= 0.00045) AND ((area_ratio >= 0.026 AND w >= 250 AND h >= 105) OR (area_ratio >= 0.020 AND w >= 300 AND h >= 84)) AND table_grid_score <= 0.020
   AND (text_density <= 1.95 OR small_cc_count <= 64 OR (area_ratio >= 0.060 AND table_grid_score <= 0.005 AND text_density <= 1.75)) AS figure
FROM ({_REGIONS}) r""")
def region_kinds(spark, sf):
    """All line items as regions."""
    r = Q.Region.of_columns()
    return regions(spark, sf).select("l_orderkey", "l_linenumber", Q.is_caption_like(r).alias("caption"), Q.is_table_like(r).alias("strict_table"), Q.is_table_like_soft(r).alias("soft_table"), Q.is_figure_like(r).alias("figure"))


@query()
def region_scores(spark, sf):
    """Scores of all regions, odd orders on pages of two columns."""
    from corvane.functions.geometry import column_id

    r = Q.Region.of_columns()
    split = F.when(F.col("l_orderkey") % 2 == 1, 500)
    column = F.when(split.isNotNull(), column_id(F.array("x1", "y1", "x2", F.col("y1") + F.col("h")), F.col("page_w"), split, F.lit(25)))
    s = Q.with_types(regions(spark, sf), column, "s")
    return s.select("l_orderkey", "l_linenumber", "s.*", Q.needs_review(r, F.col("s")).alias("review")).withColumn("reasons", F.array_join("reasons", ","))


def _chain(spark, sf):
    """Conversations as projects: turns as packets, their neighbours as triples."""
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("pid"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 0, "t1").otherwise("").alias("tenant_id"), F.when(F.col("turn") % 4 == 1, "secret").otherwise("internal").alias("access_level"), "text", "role")
    triples = c.select("pid", "pos", "tenant_id", "access_level", F.col("role").alias("subject"), F.lit("says").alias("predicate"), F.substring("text", 1, 60).alias("object"), (F.col("pos") % 10 / 10.0).alias("confidence"))
    asked = c.where("pos = 0").groupBy("pid").agg(F.min("text").alias("query")).select(F.col("pid").alias("query_id"), "pid", "query", F.lit("t1").alias("tenant_id"), F.lit("internal").alias("access_level"))
    return asked, c, triples


@query()
def hybrid_context(spark, sf):
    """Each conversation is asked for its own first turn."""
    h = C.hybrid_topk(*_chain(spark, sf))
    block = C.format_context(F.col("query"), F.col("vector_facts.text"), F.col("kg_relations"))
    return h.select("query_id", F.size("vector_facts").alias("facts"), F.size("kg_relations").alias("relations"), F.sha2(block, 256).alias("block_sha256"))


@query("""WITH c AS (SELECT conv_id AS pid, turn, CASE turn % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS layer FROM conversations)
SELECT pid, turn, layer FROM c WHERE layer = 'L1' OR NOT (layer = 'L2' AND pid % 2 = 0 OR layer = 'L3' AND pid % 5 = 0)""")
def fresh_packets(spark, sf):
    """Turns as packets of three layers, stale by the conversation's id."""
    n = F.col("turn") % 3
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("pid"), "turn", F.when(n == 0, "L1").when(n == 1, "L2").otherwise("L3").alias("layer"))
    stale = F.when(F.col("layer") == "L3", F.col("pid") % 5 == 0).otherwise(F.col("pid") % 2 == 0)
    return C.usable_packets(c, c.select("pid", "layer", stale.alias("stale")).distinct())


@query("""WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 't1' ELSE '' END AS tn, CASE o_orderkey % 5 WHEN 0 THEN 'secret' ELSE 'internal' END AS lv, o_orderstatus AS st FROM orders)
SELECT k AS claim_id, CASE WHEN k % 3 <> 0 THEN 'kept' WHEN tn = 't1' AND k % 6 = 0 THEN 'tenant_mismatch' WHEN lv = 'secret' THEN 'access_denied' ELSE 'patched' END AS status,
 CASE WHEN k % 3 = 0 AND NOT (tn = 't1' AND k % 6 = 0) AND lv <> 'secret' THEN 'new' || k ELSE st END AS title FROM s""")
def overridden_claims(spark, sf):
    """Orders as claims, every third patched twice, the second time to stay."""
    k = F.col("claim_id")
    claims = t(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 4 == 0, "t1").otherwise("").alias("tenant_id"), F.when(F.col("o_orderkey") % 5 == 0, "secret").otherwise("internal").alias("access_level"), F.col("o_orderstatus").alias("title"))
    third = claims.where(k % 3 == 0)
    of = lambda seq, text: third.select("pid", "claim_id", F.lit(seq).alias("seq"), F.create_map(F.lit("title"), text).alias("patch"), F.when(k % 6 == 0, "t2").otherwise("t1").alias("tenant_id"), F.lit("internal").alias("access_level"))
    return C.override_claims(claims, of(1, F.lit("old")).unionByName(of(2, F.concat(F.lit("new"), k.cast("string"))))).select("claim_id", "status", "title")


@query()
def prompt_packs(spark, sf):
    """Turns of a conversation as sections of a manuscript, its first as the draft."""
    c = t(spark, sf, "conversations")
    other = C.pack_sections(c.where("turn > 0").select("conv_id", F.col("turn").alias("pos"), "text"), "conv_id", 2000)
    bundle = other.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "packed"))).alias("a"))
    blocks = F.transform(F.coalesce("a", F.array().cast("array<struct<pos:long,packed:string>>")), lambda x: F.struct(F.lit("other_section").alias("tier"), x["packed"].alias("text")))
    first = c.where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("saved"))
    current = F.array(F.struct(F.lit("current_section").alias("tier"), F.col("saved").alias("text")))
    p = first.join(bundle, "conv_id", "left").select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.upper("saved")).otherwise(F.concat("saved", F.lit(" more"))).alias("draft"), "saved", F.concat(current, blocks).alias("bundle"))
    return C.pack_prompt(p, 300).select("conv_id", F.sha2("packed", 256).alias("packed_sha256"), F.length("packed").alias("n_chars"), "remaining")


@query()
def rendered_packs(spark, sf):
    """Turns as items of a pack."""
    kinds = {"paper_id": F.lit(None).cast("string"), "source_type": F.lit("chat"), "source_id": F.col("role"), "segment_id": F.col("turn").cast("string"), "snippet": F.col("text"), "paper_title": F.lit(""), "title": F.col("role"), "score": F.col("turn") / 2.0}
    c = t(spark, sf, "conversations").select("conv_id", "turn", *[v.alias(k) for k, v in kinds.items()], F.length("text").alias("estimated_tokens"))
    c = c.withColumn("fingerprint", C.fingerprint({"role": F.col("title"), "text": F.col("snippet")}))
    key = C.cache_key(F.lit("chat"), F.col("block"), F.lit(""), F.lit("m"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.lit(""))
    return C.render_pack(c, "conv_id", "turn").select("conv_id", F.sha2("block", 256).alias("block_sha256"), key.alias("cache_key"))
