"""Queries of block rules, the library and evidence segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import blocks as K
from corvane.functions import metadata as M
from corvane.functions import text as T
from corvane.operators import library as Y
from corvane.plans.catalog import _BLOCKS, _sq, blocks, query, t

_GARBAGE = r"(x = '' OR length(x) < 40 AND (regexp_matches(x, '[=\[\]{}\\|^_]|\bdef\b|[∫∑∏]') OR 2 * len(list_filter(string_split(x, ' '), lambda v: length(v) <= 2)) >= len(string_split(x, ' ')) OR len(regexp_extract_all(x, '[A-Za-z\x{4e00}-\x{9fff}]')) < 6))"


@query(rf"""WITH b AS (SELECT seq_id, pos, CASE WHEN pos % 11 = 5 THEN 'header' WHEN pos % 7 = 3 THEN 'Unknown' WHEN pos % 13 = 2 THEN NULL ELSE type END AS k, doc_id % 5 = 1 AND pos % 6 = 0 AS noise, pos % 17 = 4 AS eq, {_sq('text')} AS x FROM {_BLOCKS})
SELECT seq_id, CASE WHEN k = 'header' OR noise THEN 'noise' WHEN k = 'Title' THEN 'title' WHEN k = 'Equation' OR eq THEN 'equation' WHEN k = 'Figure' THEN 'figure' WHEN k = 'Table' THEN 'table' WHEN k = 'Unknown' AND {_GARBAGE} THEN 'noise' ELSE 'body' END AS kind,
  CASE WHEN k = 'header' OR noise THEN 'page_noise' WHEN k IN ('Title', 'Equation', 'Figure', 'Table') OR eq THEN '' WHEN k = 'Unknown' AND {_GARBAGE} THEN 'ocr_fragment' ELSE '' END AS reason,
  coalesce(k, '') <> 'Equation' AND NOT eq AND (coalesce(lower(k), '') IN ('title', 'body') OR x <> '' AND coalesce(k, '') NOT IN ('Figure', 'Table')) AS textual FROM b""")
def flow_kinds(spark, sf):
    """Kinds by position."""
    p = F.col("pos")
    kind = F.when(p % 11 == 5, "header").when(p % 7 == 3, "Unknown").when(p % 13 == 2, F.lit(None)).otherwise(F.col("type"))
    b = blocks(spark, sf).select("seq_id", kind.alias("k"), ((F.col("doc_id") % 5 == 1) & (p % 6 == 0)).alias("noise"), (p % 17 == 4).alias("eq"), "text")
    k = K.flow_kind(F.col("k"), F.col("text"), F.col("noise"), F.col("eq"), F.lit(False))
    return b.select("seq_id", k["kind"].alias("kind"), k["reason"].alias("reason"), K.is_textual_block(F.col("k"), F.col("eq"), F.col("text")).alias("textual"))


@query(rf"""SELECT seq_id, CASE WHEN type = 'Body' AND s <> '' AND length(s) <= 64 AND len(regexp_extract_all(s, '\S+')) <= 9 AND (regexp_matches(s, '^\d+(?:\.\d+)*\.?\s+[A-Z]') OR regexp_matches(s, '(?i)^(?:Abstract|Introduction|Related Work|Background|Motivation|Preliminaries|Methods?|Materials and Methods|Approach|Model|Experiments?|Experimental Setup|Results?|Evaluation|Discussion|Conclusions?|Future Work|References|Bibliography|Acknowledge?ments?|Appendix|Data)\b')) THEN 'Title' ELSE type END AS type
FROM (SELECT seq_id, type, CASE pos % 5 WHEN 0 THEN left(trim(text), 50) WHEN 1 THEN '2.' || pos || ' ' || upper(left(trim(text), 30)) WHEN 2 THEN 'Results of ' || left(trim(text), 60) WHEN 3 THEN 'Dataset' ELSE 'data ' || left(trim(text), 20) END AS r, trim(r) AS s FROM {_BLOCKS})""")
def retagged_titles(spark, sf):
    """Beginnings of lines, numbered or behind a heading's word."""
    x, p = F.trim("text"), F.col("pos")
    s = F.when(p % 5 == 0, F.left(x, F.lit(50))).when(p % 5 == 1, F.concat(F.lit("2."), p, F.lit(" "), T.upper_simple(F.left(x, F.lit(30))))).when(p % 5 == 2, F.concat(F.lit("Results of "), F.left(x, F.lit(60)))).when(p % 5 == 3, "Dataset").otherwise(F.concat(F.lit("data "), F.left(x, F.lit(20))))
    return blocks(spark, sf).withColumn("s", F.trim(s)).select("seq_id", K.retag_title(F.col("type"), F.col("s")).alias("type"))


@query(f"""WITH b AS (SELECT seq_id, CASE WHEN pos % 4 = 0 THEN '' ELSE text END AS b, x0 / 400 AS bs, CASE WHEN pos % 3 = 0 THEN NULL ELSE 'a ' || text END AS a, CASE WHEN pos % 5 = 0 THEN x0 / 400 ELSE y0 / 700 END AS "as", type FROM {_BLOCKS})
SELECT seq_id, CASE WHEN trim(b) = '' AND trim(coalesce(a, '')) = '' THEN '' WHEN trim(coalesce(a, '')) = '' OR trim(b) <> '' AND bs >= "as" THEN 'stack_b' ELSE 'stack_a' END AS source, CASE WHEN trim(b) = '' AND trim(coalesce(a, '')) = '' THEN 0 WHEN trim(coalesce(a, '')) = '' OR trim(b) <> '' AND bs >= "as" THEN bs ELSE "as" END AS score,
 type = 'Equation' AND (bs < 0.6 OR "as" > 0.9) AS low_confidence FROM b""")
def best_readings(spark, sf):
    """Two readers of each line, scores by box."""
    p, bs = F.col("pos"), F.col("x0") / 400
    a_score = F.when(p % 5 == 0, bs).otherwise(F.col("y0") / 700)
    r = K.best_reading(F.when(p % 4 == 0, "").otherwise(F.col("text")), bs, F.when(p % 3 != 0, F.concat(F.lit("a "), "text")), a_score)
    low = K.is_low_confidence_equation(F.col("type"), F.lit(False), F.lit(False), bs, F.when(a_score > 0.9, "ocr_Fallback").otherwise("ocr"))
    return blocks(spark, sf).select("seq_id", r["source"].alias("source"), r["score"].alias("score"), low.alias("low_confidence"))


@query(rf"""WITH b AS (SELECT doc_id, list(CASE pos % 4 WHEN 0 THEN ' p' || page || '-b' || pos || ' ' WHEN 1 THEN 'summary.json' WHEN 2 THEN 'p' || page || '-b0' ELSE 'x' || pos END ORDER BY pos) AS r FROM {_BLOCKS} GROUP BY doc_id),
v AS (SELECT doc_id, list_filter(list_transform(r, lambda x: trim(x)), lambda x: regexp_matches(x, '^(p\d+-b\d+|summary\.json)$')) AS l FROM b)
SELECT doc_id, array_to_string(list_slice(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), 1, 12), ',') AS refs FROM v""")
def normal_refs(spark, sf):
    """H04, H06."""
    p = F.col("pos")
    r = F.when(p % 4 == 0, F.concat(F.lit(" p"), "page", F.lit("-b"), p, F.lit(" "))).when(p % 4 == 1, "summary.json").when(p % 4 == 2, F.concat(F.lit("p"), "page", F.lit("-b0"))).otherwise(F.concat(F.lit("x"), p))
    b = blocks(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(p, r.alias("r")))), lambda x: x["r"]).alias("r"))
    return b.select("doc_id", F.array_join(K.normalize_refs(F.col("r"), 12), ",").alias("refs"))


@query("""SELECT p_partkey, p_name AS title, p_size AS year, CASE p_partkey % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'included' ELSE 'excluded' END AS screening_status FROM part
WHERE p_partkey % 3 = 1 AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')""")
def library_entries(spark, sf):
    """C06, G07."""
    state = F.when(F.col("p_partkey") % 3 == 0, "candidate").when(F.col("p_partkey") % 3 == 1, "included").otherwise("excluded")
    e = t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("venue"), F.col("p_size").alias("year"), state.alias("screening_status"), F.lit("read").alias("reading_status"))
    return Y.list_entries(e, screening="included", reading="read", query=" BRAND#1 ").select("p_partkey", "title", "year", "screening_status")


@query("""WITH p AS (SELECT l.doc_id // 2 AS paper_id, l.doc_id AS id, CASE l.doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a-p' ELSE 'b' END AS pid, 't' || l.doc_id AS title FROM labels l)
SELECT d.doc_id, coalesce((SELECT max_by(title, id) FROM p WHERE p.paper_id = d.doc_id AND pid IN ('a', 'a-p')), '') AS paper_title FROM documents d""")
def evidence_titles(spark, sf):
    """Labelled rows as papers, two to an id."""
    pid = F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "a-p").otherwise("b")
    papers = t(spark, sf, "labels").select(F.floor(F.col("doc_id") / 2).cast("long").alias("paper_id"), F.col("doc_id").alias("id"), pid.alias("pid"), F.concat(F.lit("t"), "doc_id").alias("title"))
    return Y.with_paper_titles(t(spark, sf, "documents").select(F.col("doc_id").alias("paper_id")), papers, "a-p").select(F.col("paper_id").alias("doc_id"), "paper_title")


@query(f"""WITH b AS (SELECT * FROM {_BLOCKS}),
sem AS (SELECT doc_id AS paper_id, 'sec-' || (pos + 1) AS segment_id, CASE WHEN pos % 2 = 0 THEN 'L' ELSE 'Section ' || (pos + 1) END AS title, concat_ws(chr(10) || chr(10), nullif(trim(text), ''), CASE WHEN pos % 3 = 0 THEN 'zh' END) AS text, 'flow_b' AS stage FROM b WHERE doc_id % 4 = 0),
tit AS (SELECT doc_id AS paper_id, 'fsec-' || pos AS segment_id, 'T' AS title, text, 'titles' AS stage FROM b WHERE doc_id % 4 IN (0, 1) AND type = 'Title'),
pag AS (SELECT doc_id AS paper_id, 'page-' || page AS segment_id, 'Page ' || page AS title, min(text) AS text, 'pages' AS stage FROM b WHERE doc_id % 4 <> 3 GROUP BY doc_id, page),
u AS (SELECT *, 0 AS r FROM sem WHERE length(text) >= 20 UNION ALL SELECT *, 1 FROM tit UNION ALL SELECT *, 2 FROM pag),
m AS (SELECT *, min(r) OVER (PARTITION BY paper_id) AS best FROM u),
s AS (SELECT doc_id AS paper_id, 'summary' AS segment_id, 'Summary' AS title, concat_ws(chr(10), nullif(trim(lang), ''), 'finding ' || source, 'the end') AS text, 'summary' AS stage FROM documents WHERE doc_id IN (SELECT paper_id FROM u))
SELECT paper_id, segment_id, title, md5(text) AS text_md5, stage FROM m WHERE r = best UNION ALL SELECT paper_id, segment_id, title, md5(text), stage FROM s WHERE length(text) >= 20""")
def rebuilt_evidence(spark, sf):
    """Stages that papers have by their ids modulo 4."""
    b, four = blocks(spark, sf).withColumn("paper_id", F.col("doc_id")), F.col("doc_id") % 4
    sem = Y.semantic_segments(b.where(four == 0).select("paper_id", (F.col("pos") + 1).alias("n"), F.when(F.col("pos") % 2 == 0, " L ").otherwise("").alias("section_label"), F.col("text").alias("content_en"), F.when(F.col("pos") % 3 == 0, " zh").alias("content_zh")))
    tit = b.where(four.isin(0, 1) & (F.col("type") == "Title")).select("paper_id", F.concat(F.lit("fsec-"), "pos").alias("segment_id"), F.lit("T").alias("title"), "text", F.lit("titles").alias("stage"))
    pag = b.where(four != 3).groupBy("paper_id", "page").agg(F.min("text").alias("text")).select("paper_id", F.concat(F.lit("page-"), "page").alias("segment_id"), F.concat(F.lit("Page "), "page").alias("title"), "text", F.lit("pages").alias("stage"))
    summ = Y.summary_segments(t(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("abstract_zh"), F.array(F.lit(" "), F.concat(F.lit(" finding "), "source")).alias("key_findings"), F.lit("the end").alias("conclusion")))
    return Y.rebuild_evidence(sem, tit, pag, summ).select("paper_id", "segment_id", "title", F.md5("text").alias("text_md5"), "stage")


@query("""WITH u AS (SELECT c_custkey AS id, c_name AS username, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN ' User' || c_nationkey || '@X.org ' WHEN 3 THEN lower(c_name) || '@invalid.local' ELSE c_name || '@y.org' END AS email FROM customer),
n AS (SELECT id, trim(coalesce(email, '')) <> '' AS given, CASE WHEN trim(coalesce(email, '')) <> '' THEN lower(trim(email)) ELSE lower(trim(username)) || '@invalid.local' END AS norm FROM u)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY norm ORDER BY given DESC, id) = 1 THEN norm ELSE 'dup' || id || '.' || norm END AS email FROM n""")
def resolved_emails(spark, sf):
    """Customers as users."""
    k = F.col("c_custkey") % 5
    mail = F.when(k == 0, F.lit(None)).when(k == 1, " ").when(k == 2, F.concat(F.lit(" User"), "c_nationkey", F.lit("@X.org "))).when(k == 3, F.concat(F.lower("c_name"), F.lit("@invalid.local"))).otherwise(F.concat("c_name", F.lit("@y.org")))
    return Y.resolve_emails(t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), mail.alias("email"))).select("id", "email")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS pid, 'viewer' AS role FROM orders)
SELECT * FROM m UNION ALL SELECT user_id, 'b', role FROM m WHERE pid = 'a' AND user_id NOT IN (SELECT user_id FROM m WHERE pid = 'b')""")
def copied_members(spark, sf):
    """Customers of orders as members."""
    pid = F.when(F.col("o_orderkey") % 3 == 0, "a").when(F.col("o_orderkey") % 3 == 1, "b").otherwise("c")
    return Y.copy_members(t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), pid.alias("pid"), F.lit("viewer").alias("role")).distinct(), "a", "b")


@query()
def extractive_summaries(spark, sf):
    """F22."""
    return Y.extractive_summary(blocks(spark, sf), "doc_id")


@query()
def pack_fingerprints(spark, sf):
    """Each conversation's turns as a context pack."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.lit("chat").alias("source_type"), F.col("role").alias("source_id"), F.lit(None).cast("string").alias("paper_id"), F.col("turn").cast("string").alias("segment_id"), F.lit("").alias("fingerprint"), F.col("text").alias("snippet"), F.length("text").alias("estimated_tokens"))
    return Y.pack_metadata(c, "conv_id", "turn")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, (doc_id * 37 % 100) / 100 AS c, doc_id % 3 = 0 AS ok FROM documents),
v AS (SELECT *, n <= 20 AND ok AS is_verified, CASE WHEN n <= 20 AND NOT ok THEN greatest(0.0, round(c - 0.15, 4)) ELSE c END AS confidence FROM r)
SELECT doc_id, confidence, is_verified, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, is_verified DESC, n)::INT AS rank FROM v""")
def verified_ranks(spark, sf):
    """Documents of a source as its ranked papers."""
    d = t(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") * 37 % 100 / 100).alias("confidence"), (F.col("doc_id") % 3 == 0).alias("link_ok"))
    return Y.verified_ranking(d, "source", "doc_id").select("doc_id", "confidence", "is_verified", "rank")


@query("""SELECT p_partkey, p_partkey % 4 < 2 AS csl, CASE p_partkey % 4 WHEN 3 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN 1900 + p_size WHEN p_partkey % 4 = 2 THEN 2000 + p_size END AS year, CASE p_partkey % 4 WHEN 0 THEN 'Fam, Giv;Lit' WHEN 1 THEN 'Name' WHEN 2 THEN 'One;Two' ELSE '' END AS authors, p_brand AS venue FROM part""")
def entry_fields(spark, sf):
    """Parts as entries in four spellings."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.format_string('{"title": "%s", "author": [{"family": "Fam", "given": "Giv"}, {"literal": "Lit"}], "issued": {"date-parts": [["%d", 2]]}, "container-title": "%s"}', "p_name", F.col("p_size") + 1900, "p_brand"))
    raw = raw.when(k == 1, F.format_string('{"title": "%s", "author": [{"name": "Name"}], "DOI": null, "container-title": "%s"}', "p_name", "p_brand"))
    raw = raw.when(k == 2, F.format_string('{"paper_title": " %s ", "authors": "One; Two", "year": [], "publish_date": "in %d-01", "journal": "%s"}', "p_name", F.col("p_size") + 2000, "p_brand")).otherwise(F.format_string('{"title": "", "authors": [], "venue": "%s"}', "p_brand"))
    p = t(spark, sf, "part").select("p_partkey", raw.alias("raw")).withColumn("csl", M.looks_like_csl(F.col("raw")))
    e = p.withColumn("e", M.entry_metadata(F.when(F.col("csl"), M.csl_to_raw(F.col("raw"))).otherwise(F.col("raw"))))
    return e.select("p_partkey", "csl", "e.title", "e.year", F.array_join("e.authors", ";").alias("authors"), "e.venue")
