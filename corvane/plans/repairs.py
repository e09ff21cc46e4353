"""Queries of refilled sections, first usable sources, project maps and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import ledger as K
from corvane.operators import rebuild as B
from corvane.operators import repairs as Y
from corvane.operators import status as S
from corvane.plans.catalog import blocks, query, t


@query()
def refilled_sections(spark, sf):
    """Nine lines of a document a section, some without a language."""
    b = blocks(spark, sf)
    p = F.col("pos")
    own = b.select(F.col("doc_id").alias("paper_id"), F.col("page").cast("int").alias("page"), (p % 5 + 1).cast("int").alias("block"), F.col("text").alias("content"), F.when(p % 4 == 0, F.concat(F.lit("中文 "), "text")).alias("content_zh"))
    n = F.floor(p / 9)
    sections = b.groupBy(F.col("doc_id").alias("paper_id"), n.alias("n")).agg(F.array_sort(F.collect_list(F.struct("pos", F.format_string("p%d-b%d", F.col("page").cast("int"), (p % 5 + 1).cast("int")).alias("r")))).alias("r"), F.max("text").alias("x"))
    k = F.col("n") % 3
    sections = sections.select("paper_id", "n", F.when(F.col("n") == 0, " Abstract").otherwise("Results").alias("section_label"), F.when(F.col("n") == 0, F.array().cast("array<string>")).otherwise(F.col("r.r")).alias("source_block_refs"), F.when(k == 1, F.col("x")).otherwise(" ").alias("content_en"), F.when(k == 2, F.col("x")).alias("content_zh"))
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("abstract_en"), F.lit("").alias("abstract_zh"))
    out = Y.refill_languages(sections, own, d)
    return out.select("paper_id", "n", "repaired", F.md5(F.coalesce("content_en", F.lit(""))).alias("en_md5"), F.md5(F.coalesce("content_zh", F.lit(""))).alias("zh_md5"))


@query("""WITH p AS (SELECT DISTINCT 'c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '-p' ELSE '' END AS pid FROM customer),
n AS (SELECT pid, pid AS o, 0 AS k FROM p UNION ALL SELECT pid, regexp_replace(pid, '-p$', ''), 1 FROM p WHERE pid LIKE '%-p'),
s AS (SELECT 'c' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '-p' ELSE '' END AS o, o_orderkey % 4 AS rank, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '' END AS labels, o_orderkey FROM orders WHERE o_orderkey % 4 < 3),
l AS (SELECT o, rank, arg_max(labels, o_orderkey) AS labels FROM s GROUP BY ALL),
m AS (SELECT pid, rank, arg_min(labels, k) AS labels FROM n JOIN l USING (o) GROUP BY ALL),
b AS (SELECT pid, arg_min(labels, rank) AS labels, min(rank) AS rank FROM m WHERE labels <> '' GROUP BY pid)
SELECT pid, b.labels, CASE rank WHEN 0 THEN 'paq_survey_db' WHEN 1 THEN 'taxonomy_manual_update' WHEN 2 THEN 'taxonomy_v1' ELSE '' END AS origin FROM p LEFT JOIN b USING (pid)""")
def taxonomies(spark, sf):
    """Customers as projects; their last order of each kind as table, manual and
    versioned file, a fifth of them without labels."""
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey", F.when(k % 3 == 0, "-p").otherwise("")).alias("pid"), (k % 4).alias("rank"), F.when(k % 5 != 0, F.col("o_orderpriority")).otherwise("").alias("labels"), k)
    last = o.groupBy("pid", "rank").agg(F.max_by("labels", "o_orderkey").alias("labels"))
    c = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, "-p").otherwise("")).alias("pid"))
    names = ["paq_survey_db", "taxonomy_manual_update", "taxonomy_v1"]
    return Y.first_usable(c, [(name, last.where(F.col("rank") == i), F.col("labels") != "") for i, name in enumerate(names)], ["labels"])


@query("""WITH p AS (SELECT 'p' || doc_id // 12 AS pid, doc_id, 'd' || doc_id % 7 AS paper_id, CASE WHEN doc_id % 4 <> 0 THEN lang END AS title, CASE WHEN doc_id % 3 = 0 THEN 1990 + doc_id % 30 END AS year, doc_id % 5 < 2 AS s FROM documents),
o AS (SELECT pid, paper_id, max(doc_id) AS doc_id, count(*) AS n FROM p GROUP BY ALL),
k AS (SELECT o.pid, o.n, o.paper_id || ':' || coalesce(title, 'Unknown') || ':' || coalesce(year::VARCHAR, 'Unknown') || ':' || s AS e FROM o JOIN p USING (doc_id))
SELECT pid, sum(n)::BIGINT AS count, string_agg(e, ',' ORDER BY e) AS papers FROM k GROUP BY pid""")
def project_maps(spark, sf):
    """Twelve documents a project, seven ids."""
    k = F.col("doc_id")
    d = t(spark, sf, "documents").select(F.concat(F.lit("p"), F.floor(k / 12)).alias("pid"), k.alias("pos"), F.concat(F.lit("d"), k % 7).alias("paper_id"), F.when(k % 4 != 0, F.col("lang")).alias("title"), F.when(k % 3 == 0, 1990 + k % 30).alias("year"), F.when(k % 5 < 2, "text").alias("summary"))
    line = lambda e: F.concat_ws(":", e["key"], e["value"]["title"], e["value"]["year"], e["value"]["has_summary"].cast("string"))
    return Y.project_map(d).select("pid", "count", F.array_join(F.array_sort(F.transform(F.map_entries("papers"), line)), ",").alias("papers"))


_NAMES = "['研究問題與目標', '方法論', ' 資料與實驗設定 ', '限制', '其他', '', '結果與證據強度', '方法與系統設計']"


@query(f"""WITH c AS (SELECT conv_id, list({{'d': trim({_NAMES}[(conv_id + turn * 3) % 8 + 1]), 'b': CASE WHEN turn % 4 = 1 THEN '' ELSE coalesce(text, '') END, 's': CASE WHEN turn % 3 = 0 THEN 'High' ELSE '' END}} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
g AS (SELECT conv_id, list_filter(l, lambda p: p.d <> '') AS l FROM c),
k AS (SELECT conv_id, l, list_transform(list_filter(list_transform(l, lambda p, i: CASE WHEN list_position(list_transform(l, lambda q: q.d), p.d) = i THEN p.d END), lambda x: x IS NOT NULL), lambda x: x) AS names FROM g),
d AS (SELECT conv_id, l, names, unnest(range(5)) AS n, unnest(['研究問題與目標', '方法與系統設計', '資料與實驗設定', '結果與證據強度', '限制與風險']) AS dim FROM k),
f AS (SELECT *, CASE WHEN list_contains(names, dim) THEN dim ELSE list_filter(names, lambda x: contains(x, left(dim, 2)) OR contains(dim, left(x, 2)))[1] END AS name FROM d),
p AS (SELECT conv_id, n, dim, list_filter(l, lambda x: x.d = name)[-1] AS p FROM f),
v AS (SELECT conv_id, n, dim, CASE WHEN p IS NULL THEN 'N/A' WHEN p.b = '' THEN 'N/A' ELSE left(regexp_replace(regexp_replace(p.b, '^\\s+', ''), '\\s+$', ''), 220) END AS b, CASE WHEN p IS NULL THEN '資料不足，待補充比較證據。' ELSE 'N/A' END AS y, CASE WHEN p IS NULL THEN 'Low' WHEN p.s = '' THEN 'Medium' ELSE p.s END AS s FROM p)
SELECT conv_id, string_agg(s, ',' ORDER BY n) AS significance, md5(string_agg('【' || dim || '】' || chr(10) || '基準: ' || b || chr(10) || '對照: N/A' || chr(10) || '評析: ' || y, chr(10) || chr(10) ORDER BY n)) AS analysis_md5 FROM v GROUP BY conv_id""")
def comparisons(spark, sf):
    """Turns as points of a comparison, some of other names."""
    names = F.array(*map(F.lit, ["研究問題與目標", "方法論", " 資料與實驗設定 ", "限制", "其他", "", "結果與證據強度", "方法與系統設計"]))
    c, n = t(spark, sf, "conversations"), F.col("turn")
    none = F.lit(None).cast("string")
    point = F.struct(F.element_at(names, ((F.col("conv_id") + n * 3) % 8 + 1).cast("int")).alias("dimension"), F.when(n % 4 == 1, "").otherwise(F.col("text")).alias("baseline_view"), none.alias("target_view"), none.alias("synthesis"), F.when(n % 3 == 0, "High").otherwise("").alias("significance"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", point.alias("p")))).alias("a"))
    g = g.select("conv_id", Y.comparison_points(F.transform("a", lambda x: x["p"])).alias("points"))
    return g.select("conv_id", F.array_join(F.transform("points", lambda p: p["significance"]), ",").alias("significance"), F.md5(Y.comparison_text(F.col("points"))).alias("analysis_md5"))


@query()
def layer_commits(spark, sf):
    """Turns of conversations as refreshes and overrides, two commits, the ledger."""
    c, n = t(spark, sf, "conversations"), F.col("turn")
    paper = lambda i: F.struct(F.concat(F.col("role"), F.lit(f" {i}")).alias("title"), (2000 + (n * 7 + i) % 20).cast("int").alias("year"), F.lit("web").alias("source"), F.lit("").alias("doi"), F.lit("").alias("url"), ((n + i) % 10 / 10.0).alias("confidence"))
    kind = F.when(n % 3 == 0, "refresh").otherwise("override")
    events = c.select(F.concat(F.lit("p"), "conv_id").alias("pid"), n.cast("long").alias("seq"), (F.lit(1000) + n - n % 3).cast("long").alias("ts"), kind.alias("kind"), F.col("role").alias("topic"), F.substring("text", 1, 80).alias("reasoning"), F.array(*map(paper, range(9))).alias("papers"),
        F.when(n % 2 == 0, "t1").alias("tenant_id"), F.lit("internal").alias("access_level"), F.format_string("lit-%d-%d", 1000 + n - n % 3, n % 3 * 4).alias("claim_id"), F.create_map(F.lit("title"), F.substring("text", 1, 40)).alias("patch"), F.lit("editor").alias("editor"))
    first = K.commit(K.empty_state(spark), events.where(n < 4))
    state = K.commit({k: first[k] for k in K.STATE}, events.where(n >= 4))
    return state["ledger"].select("pid", "version", "event", "claim_id", "claims_count", "truncated_count", "before", "after")


@query()
def paper_states(spark, sf):
    """Documents as papers with artifacts, summaries, reflows and stored rows."""
    k = F.col("doc_id")
    d = t(spark, sf, "documents").select(F.concat(F.lit("p"), k % 50).alias("pid"), k.cast("string").alias("paper_id"), k, "text")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    artifacts = d.select("pid", "paper_id", *[(k % (3 + i) != 0).alias(f) for i, f in enumerate(S.FLAGS)])
    summaries = d.where(k % 3 != 1).select("pid", "paper_id", F.to_json(F.struct(pick(["ok", "degraded", "error_fallback", ""], k % 4).alias("mode"), F.when(k % 2 == 0, F.col("text")).alias("abstract_zh"))).alias("raw"))
    reflows = d.where(k % 4 != 2).select("pid", "paper_id", (k % 3).alias("sections"), pick(["", "task_5b_reflow", "heuristic_fallback", "other"], k % 4).alias("mode"), pick(["", "used=task_5interpret"], k % 2).alias("note"))
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    rows = d.where(k % 5 != 3).select("pid", "paper_id", F.lit("T").alias("title"), pick(["pending", "analyzing", "t5_queued", "gold_ready", "failed", "processing_B", "ready_b", ""], k % 8).alias("status"), (now - F.make_dt_interval(secs=(k * 37 % 9000).cast("decimal(18,6)"))).alias("updated_at"))
    locks = d.where(k % 7 == 0).select("pid", now.alias("locked_at"))
    return S.paper_status(artifacts, summaries, reflows, rows, locks, now)


@query("""WITH d AS (SELECT 'p' || doc_id // 12 AS pid, doc_id, doc_id % 7 = 3 AS broken, doc_id % 5 = 2 AS bare, length(trim(text)) >= 20 AS long FROM documents)
SELECT pid, count(*) FILTER (NOT broken AND NOT bare AND long) AS papers_indexed, count(*) FILTER (NOT broken AND (bare OR long IS NOT TRUE)) AS papers_skipped, count(*) FILTER (broken) AS papers_failed FROM d GROUP BY pid""")
def rebuild_reports(spark, sf):
    """Documents as papers of one section, some broken, some without sections."""
    k = F.col("doc_id")
    d = t(spark, sf, "documents").select(F.concat(F.lit("p"), F.floor(k / 12)).alias("pid"), k.cast("string").alias("paper_id"), k, "text")
    one = F.to_json(F.struct(F.when(k % 5 != 2, F.array(F.struct(F.lit("Results").alias("section_label"), F.col("text").alias("content_en")))).otherwise(F.array().cast("array<struct<section_label:string,content_en:string>>")).alias("sections")))
    semantic = d.select("pid", "paper_id", F.lit("semantic").alias("stage"), one.alias("raw"))
    summary = d.select("pid", "paper_id", F.lit("summary").alias("stage"), F.when(k % 7 == 3, "{broken").otherwise('{"conclusion": "the end of this paper"}').alias("raw"))
    return B.rebuild_project(semantic.unionAll(summary))[2]
