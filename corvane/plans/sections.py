"""Queries of sections, equations, members and small rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import sections as S
from corvane.plans.catalog import _BLOCKS, blocks, query, t


@query()
def section_buckets(spark, sf):
    """Blocks of documents, every ninth line of a document a heading."""
    b = blocks(spark, sf)
    headings = F.array(*map(F.lit, ["1. Introduction and Background", "Materials and Methods of the Work", "Results of the Experiments", "4 Discussion of what was found"]))
    text = F.when(F.col("pos") % 9 == 4, F.element_at(headings, F.floor(F.col("pos") / 9).cast("int") % 4 + 1)).otherwise(F.col("text"))
    pages = b.groupBy(F.col("doc_id").alias("d")).agg(F.max("page").alias("pages"))
    b = b.join(pages, F.col("doc_id") == F.col("d")).select(F.col("doc_id").alias("paper_id"), F.col("page").cast("int").alias("page"), F.col("pages").cast("int").alias("pages"), F.col("pos").cast("int").alias("block"), "type", text.alias("content"), F.lit("").alias("content_zh"))
    s = S.section_buckets(b, t(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("摘要 "), "source")).alias("abstract_zh"), F.array(F.lit(" "), F.concat(F.lit("發現 "), "lang")).alias("key_findings")))
    return s.select("paper_id", "n", "section_label", "confidence", "inferred_label", F.array_join("source_block_refs", ",").alias("refs"), F.md5("content_en").alias("en_md5"), "content_zh")


@query()
def merged_sections(spark, sf):
    """Pages as batches, kinds of blocks as labels."""
    b = blocks(spark, sf).select("doc_id", F.col("page").alias("batch"), "pos", F.when(F.col("pos") % 2 == 0, F.upper("type")).otherwise(F.col("type")).alias("section_label"), (F.col("pos") % 5 / 4.0).alias("confidence"), (F.col("pos") % 3 != 0).alias("inferred_label"), F.array(F.concat(F.lit("p"), "page")).alias("source_block_refs"), F.array(F.lit("summary.json"), F.col("seq_id")).alias("dropped_refs"), F.col("text").alias("content_en"), F.lit(None).cast("string").alias("content_zh"))
    m = S.merge_sections(b, "doc_id")
    return m.select("doc_id", "n", "section_label", "confidence", "inferred_label", F.array_join("source_block_refs", ",").alias("refs"), F.array_join("dropped_refs", ",").alias("dropped"), F.md5("content_en").alias("en_md5"))


@query(f"""WITH b AS (SELECT doc_id AS paper_id, page, seq_id, CASE WHEN type = 'Equation' AND doc_id % 2 = 0 THEN 'Body' ELSE type END AS type, pos FROM {_BLOCKS}),
e AS (SELECT paper_id, page, CASE WHEN pos % 4 = 0 THEN seq_id ELSE 'e' || (pos // 4) END AS seq_id FROM b WHERE pos % 2 = 0),
n AS (SELECT DISTINCT e.* FROM e WHERE paper_id NOT IN (SELECT paper_id FROM b WHERE type = 'Equation') AND NOT EXISTS (SELECT 1 FROM b WHERE b.paper_id = e.paper_id AND b.page = e.page AND b.seq_id = e.seq_id))
SELECT paper_id, page, seq_id, type, false AS injected FROM b UNION ALL SELECT paper_id, page, seq_id, 'Equation', true FROM n""")
def injected_equations(spark, sf):
    """Documents with even ids have no equations of their own."""
    b = blocks(spark, sf)
    kind = F.when((F.col("type") == "Equation") & (F.col("doc_id") % 2 == 0), "Body").otherwise(F.col("type"))
    own = b.select(F.col("doc_id").alias("paper_id"), "page", "seq_id", kind.alias("type"), F.lit(False).alias("is_equation"))
    seq = F.when(F.col("pos") % 4 == 0, F.col("seq_id")).otherwise(F.concat(F.lit("e"), F.floor(F.col("pos") / 4)))
    more = b.where("pos % 2 = 0").select(F.col("doc_id").alias("paper_id"), "page", seq.alias("seq_id"), F.lit("Equation").alias("type"), F.lit(True).alias("is_equation"))
    return S.inject_equations(own, more).drop("is_equation")


@query("""WITH u AS (SELECT c_custkey AS user_id FROM customer),
m AS (SELECT c_custkey AS user_id, 'p' || c_nationkey AS pid, CASE c_custkey % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'viewer' ELSE 'coauthor' END AS role FROM customer WHERE c_custkey % 2 = 0),
p AS (SELECT c_custkey AS user_id, 'p' || c_nationkey AS pid, c_custkey % 4 = 0 AS lead, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'viewer' WHEN 2 THEN 'editor' WHEN 3 THEN 'boss' ELSE 'owner' END AS asked FROM customer WHERE c_custkey % 7 <> 0),
w AS (SELECT user_id, pid, lead, CASE WHEN lead AND asked <> 'owner' THEN 'editor' WHEN asked = 'boss' THEN '' ELSE asked END AS wanted FROM p)
SELECT coalesce(m.user_id, w.user_id) AS user_id, coalesce(m.pid, w.pid) AS pid, CASE WHEN wanted IS NULL OR lead AND m.role = 'owner' THEN m.role ELSE wanted END AS role FROM m FULL JOIN (SELECT * FROM w WHERE wanted <> '') w USING (user_id, pid)""")
def synced_members(spark, sf):
    """Customers as users, members and people of their nation's project."""
    c = t(spark, sf, "customer")
    k, pid = F.col("c_custkey"), F.concat(F.lit("p"), "c_nationkey").alias("pid")
    role = F.when(k % 3 == 0, "owner").when(k % 3 == 1, "viewer").otherwise("coauthor")
    asked = F.when(k % 5 == 1, " Viewer").when(k % 5 == 2, "editor").when(k % 5 == 3, "boss").when(k % 5 == 4, "owner")
    people = c.where(k % 7 != 0).select(pid, k.alias("pos"), F.when(k % 4 == 0, "Co-PI").otherwise("member").alias("role"), asked.alias("access_role"), F.array(F.lit(" "), F.concat(F.lit(" "), F.upper("c_name"), F.lit("@x.org"))).alias("emails"))
    return S.sync_members(c.where(k % 2 == 0).select(k.alias("user_id"), pid, role.alias("role")), people, c.select(k.alias("id"), F.concat("c_name", F.lit("@X.org")).alias("email")))


@query("""WITH p AS (SELECT l_orderkey AS paper_id, l_linenumber AS page, l_suppkey % 3 <> 0 AND l_orderkey % 4 <> 0 AS o, l_partkey % 2 = 0 AS r FROM lineitem),
g AS (SELECT paper_id, page, bool_or(o) AS o, bool_or(r) AS r FROM p WHERE o OR r GROUP BY paper_id, page)
SELECT paper_id, count(*) FILTER (o) AS expected, CASE WHEN count(*) FILTER (o) > 0 THEN count(*) FILTER (o AND r) ELSE count(*) FILTER (r) END AS present FROM g GROUP BY paper_id""")
def asset_counts(spark, sf):
    """Line items as pages of orders."""
    i = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("page"), F.array_compact(F.array(F.when((F.col("l_suppkey") % 3 != 0) & (F.col("l_orderkey") % 4 != 0), "origin"), F.when(F.col("l_partkey") % 2 == 0, "raw"))).alias("stages"))
    return S.asset_counts(i.select("paper_id", "page", F.explode("stages").alias("stage")))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS s FROM documents),
r AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM s)
SELECT doc_id, coalesce((SELECT string_agg(x, '|' ORDER BY length(x) DESC, i) FROM (SELECT x, i FROM r WHERE r.doc_id = s.doc_id ORDER BY length(x) DESC, i LIMIT 3)), '') AS findings, coalesce(s[len(s)], '') AS conclusion FROM s""")
def fallback_summaries(spark, sf):
    """E22."""
    r = t(spark, sf, "documents").select("doc_id", S.fallback_summary(F.col("text")).alias("r"))
    return r.select("doc_id", F.array_join("r.key_findings", "|").alias("findings"), "r.conclusion")


@query(r"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' / ' || p_type || ' by ' || p_name ELSE p_brand END AS c, CASE WHEN p_partkey % 3 = 0 THEN ['z' || p_name || p_type || p_name, p_type || p_brand, 'a' || p_partkey, p_name || p_type || p_type] ELSE ['b', 'a' || p_partkey] END AS ids FROM part),
s AS (SELECT p_partkey, list_sort(ids) AS ids, array_to_string(list_sort(ids), '+') AS j, regexp_replace(c, '[^\p{L}\p{N} _-]', '_', 'g') AS r, c FROM c),
k AS (SELECT *, CASE WHEN length(r) > 30 THEN left(r, 30) || '_' || left(md5(c), 6) ELSE r END AS p FROM s)
SELECT p_partkey, CASE WHEN length(p || '_' || j) > 100 THEN p || '_' || left(array_to_string(ids[1:2], '+'), 50) || '_etc_' || left(md5(j), 12) ELSE p || '_' || j END || '.json' AS file FROM k""")
def matrix_files(spark, sf):
    """Parts as comparisons."""
    k = F.col("p_partkey")
    crit = F.when(k % 2 == 0, F.concat("p_name", F.lit(" / "), "p_type", F.lit(" by "), "p_name")).otherwise(F.col("p_brand"))
    short = F.concat(F.lit("a"), k.cast("string"))
    ids = F.when(k % 3 == 0, F.array(F.concat(F.lit("z"), "p_name", "p_type", "p_name"), F.concat("p_type", "p_brand"), short, F.concat("p_name", "p_type", "p_type"))).otherwise(F.array(F.lit("b"), short))
    return t(spark, sf, "part").select("p_partkey", S.matrix_file(crit, ids).alias("file"))


@query("""SELECT source AS grp, bool_or(doc_id % 50 = 7 OR lang IN ('fr')) AS grounded FROM documents GROUP BY source""")
def grounded_groups(spark, sf):
    """Documents as sources of an answer, French ones as notes."""
    d = t(spark, sf, "documents").select(F.col("source").alias("grp"), F.when(F.col("lang") == "fr", "study_note").otherwise("title_hint").alias("source_type"), (F.col("doc_id") % 50 == 7).alias("a"))
    return S.grounded(d, "grp", F.col("a"))


@query("""SELECT doc_id, source, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id AND 'p' || (l.doc_id % 2) = 'p' || (d.doc_id % 3))""")
def kept_papers(spark, sf):
    """Toxic documents deleted from the projects they are named in."""
    d = t(spark, sf, "documents").select(F.concat(F.lit("p"), F.col("doc_id") % 3).alias("pid"), F.col("doc_id").alias("paper_id"), "source", "lang")
    gone = t(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("p"), F.col("doc_id") % 2).alias("pid"), F.col("doc_id").alias("paper_id"))
    return S.without_papers(d, gone).select(F.col("paper_id").alias("doc_id"), "source", "lang")
