"""Named queries over the supplied tables and the DuckDB SQL that must agree with them.

The supplied tables stand in for the engine's own: documents for evidence and papers, labels
for screening, conversations for chat, events for heartbeats and usage, orders, customers and
suppliers for projects, members and entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import biblio as B
from corvane.functions import geometry as G
from corvane.functions import status as S
from corvane.functions import text as T
from corvane.functions import udfs as U
from corvane.operators import accounts as A
from corvane.operators import layout as L
from corvane.operators import pages as P
from corvane.operators import quota as K
from corvane.operators import retrieval as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ASKED = [("q1", "the onble thtion of eranth"), ("q2", "der und pflich ungeheit src3"), ("q3", "MIT License released under")]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '\p{{Han}}+|[\p{{L}}\p{{N}}_]+')"


def _sq(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


# Lines of documents, numbered from 0.
_LINES = "(SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
# Layout blocks: five lines a page, kinds and boxes by arithmetic.
_BLOCKS = f"(SELECT doc_id, source, pos, pos // 5 + 1 AS page, 's' || doc_id || '_' || pos AS seq_id, line AS text, CASE (doc_id * 7 + pos) % 10 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Table' WHEN 2 THEN 'Equation' WHEN 3 THEN 'Title' ELSE 'Body' END AS type, (doc_id * 31 + pos * 17) % 400 AS x0, (doc_id * 13 + pos * 29) % 700 AS y0 FROM {_LINES})"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    d, p = F.col("doc_id"), F.col("pos")
    kind = F.when((d * 7 + p) % 10 == 0, "Figure").when((d * 7 + p) % 10 == 1, "Table").when((d * 7 + p) % 10 == 2, "Equation").when((d * 7 + p) % 10 == 3, "Title").otherwise("Body")
    return lines(spark, sf).select("doc_id", "source", "pos", (F.floor(p / 5) + 1).alias("page"), F.concat(F.lit("s"), d, F.lit("_"), p).alias("seq_id"), F.col("line").alias("text"), kind.alias("type"), ((d * 31 + p * 17) % 400).alias("x0"), ((d * 13 + p * 29) % 700).alias("y0"))


# Retrieval ------------------------------------------------------------------------------------

def evidence(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    return d.select(F.col("source").alias("paper_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("segment_id"), F.lit("").alias("title"), "text", F.lit("paper_segment").alias("source_type"), F.lit("").alias("paper_title"))


_ASKED = ", ".join(f"('{i}', '{q}')" for i, q in ASKED)
_HITS = f"""
q AS (SELECT query_id, query, list_distinct({_tok('query')}) AS q, regexp_replace(lower(query), '[^a-z0-9]+', '', 'g') AS cq FROM (VALUES {_ASKED}) v(query_id, query)),
e AS (SELECT doc_id, source, text, {_tok("source || ' ' || source || ' ' || source || '   ' || text")} AS w FROM documents),
s AS (SELECT query_id, source AS paper_id, source AS source_id, doc_id AS segment_id, text,
        len(list_intersect(q, w)) AS o, len(q) AS nq, len(list_filter(w, lambda x: list_contains(q, x))) AS tf, len(w) AS nw,
        len(source) >= 4 AND (contains(cq, source) OR contains(source, cq)) AS named_match FROM e, q),
h AS (SELECT *, round(CASE WHEN o > 0 THEN round(0.58 * o / nq + 0.37 * (tf / (tf + 1.5 + 0.25 * greatest(0, nw - 80) / 80)) + 0.02, 6) ELSE 0 END + CASE WHEN named_match THEN 1.0 ELSE 0 END, 6) AS score,
        greatest(1, length(text) // 4) AS estimated_tokens FROM s),
hits AS (SELECT * FROM h WHERE score > 0)"""


@query(f"WITH {_HITS} SELECT query_id, rank::INT AS rank, paper_id, segment_id, score, named_match, estimated_tokens FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id, segment_id) AS rank FROM hits) WHERE rank <= 20")
def evidence_search(spark, sf):
    """I01, I05, I16, I17, I19, C01, D04, G01."""
    return R.best(R.score_evidence(evidence(spark, sf), ASKED), 20, "segment_id").select("query_id", "rank", "paper_id", "segment_id", "score", "named_match", "estimated_tokens")


@query(f"""WITH {_HITS},
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id, segment_id) AS n, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, source_id, segment_id) AS k FROM hits),
b AS (SELECT *, min(n) OVER (PARTITION BY query_id, paper_id) AS f, max(named_match::INT) OVER (PARTITION BY query_id, paper_id) AS nm FROM a),
c AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY f) AS pr, sum(CASE WHEN k = 1 AND nm = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS nn FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nn = 1 THEN 1 WHEN nn >= 2 AND nm = 1 THEN 0 WHEN nn = 0 AND pr <= 4 AND k <= 3 THEN 0 ELSE 1 END,
   CASE WHEN nn >= 2 AND nm = 1 THEN k WHEN nn = 0 AND pr <= 4 AND k <= 3 THEN pr ELSE 0 END, CASE WHEN nn >= 2 AND nm = 1 THEN f WHEN nn = 0 AND pr <= 4 AND k <= 3 THEN k ELSE 0 END, n) AS pick FROM c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id, segment_id)::INT AS rank, paper_id, segment_id, score FROM p WHERE pick <= 12""")
def evidence_search_quota(spark, sf):
    """F07."""
    return R.per_paper_quota(R.score_evidence(evidence(spark, sf), ASKED), 12).select("query_id", "rank", "paper_id", "segment_id", "score")


def screening(spark, sf):
    s = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "included").otherwise("unknown")
    return t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), s.alias("status"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'included' ELSE 'unknown' END AS status FROM labels)
SELECT d.doc_id::VARCHAR AS paper_id, CASE WHEN d.doc_id % 10 = 0 THEN 'study_note' ELSE 'paper_segment' END AS source_type FROM documents d
WHERE d.doc_id % 10 = 0 OR (d.doc_id IN (SELECT doc_id FROM s WHERE status = 'included') AND d.doc_id NOT IN (SELECT doc_id FROM s WHERE status = 'excluded'))""")
def evidence_screened(spark, sf):
    """C02, C03, E20."""
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.when(F.col("doc_id") % 10 == 0, "study_note").otherwise("paper_segment").alias("source_type"))
    return R.screening_gate(d, screening(spark, sf), "writing")


@query("SELECT CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'included' ELSE 'unknown' END AS status, count(*) AS papers FROM labels GROUP BY 1")
def screening_counts(spark, sf):
    """E16."""
    return screening(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("papers"))


@query(f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id, segment_id) AS rank FROM hits),
g AS (SELECT query_id, paper_id, round(sum(score), 6) AS score, count(*) AS segments, min_by(segment_id, rank) AS first_segment FROM r WHERE rank <= 15 GROUP BY ALL)
SELECT query_id, paper_id, score, segments, first_segment, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM g) WHERE rank <= 5""")
def citation_suggest(spark, sf):
    """E04."""
    hits = R.best(R.score_evidence(evidence(spark, sf), ASKED), 15, "segment_id").withColumn("snippet", F.substring("text", 1, 200))
    return R.citation_suggestions(hits, 5).select("query_id", "paper_id", "score", F.size("segment_ids").cast("long").alias("segments"), F.col("segment_ids")[0].alias("first_segment"), "rank")


@query("""WITH c AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS w FROM conversations),
x AS (SELECT conv_id, turn, unnest(w) AS k FROM c), f AS (SELECT conv_id, turn, k, count(*) AS n FROM x GROUP BY ALL),
z AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM f GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.k = b.k AND b.turn = 0 GROUP BY ALL)
SELECT c.conv_id, c.turn, round(coalesce(p.dot / (z.norm * z0.norm), 0), 6) AS cosine FROM c LEFT JOIN p USING (conv_id, turn) LEFT JOIN z USING (conv_id, turn) LEFT JOIN z z0 ON z0.conv_id = c.conv_id AND z0.turn = 0""")
def lexical_chain_cosine(spark, sf):
    """Each turn against the first of its conversation."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", T.chain_tokens(F.col("text")).alias("w"))
    first = c.where("turn = 0").select("conv_id", F.col("w").alias("w0"))
    return c.join(first, "conv_id", "left").select("conv_id", "turn", F.round(F.coalesce(R.sparse_cosine(F.col("w"), F.col("w0")), F.lit(0.0)), 6).alias("cosine"))


@query("""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT qe FROM q)::DOUBLE[]), 6) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 20""")
def dense_topk(spark, sf):
    """G02 on dense vectors: the 20 nearest to vector 0."""
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("qe"))
    s = e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", F.round(R.dense_cosine(F.col("embedding"), F.col("qe")), 6).alias("score"))
    return s.orderBy(F.col("score").desc(), "vec_id").limit(20)


@query("""SELECT sha256('{"metadata": {"lang": "' || lang || '"}, "text": ' || to_json(text)::VARCHAR || '}') AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def content_hash_dedupe(spark, sf):
    """JSON text with sorted keys and the separators of the stored hashes."""
    js = F.concat(F.lit('{"metadata": {"lang": "'), F.col("lang"), F.lit('"}, "text": '), F.substring(F.to_json(F.array("text")), 2, 2**31 - 1))
    raw = F.concat(F.regexp_replace(js, r"\]$", ""), F.lit("}"))
    return t(spark, sf, "documents").groupBy(F.sha2(raw, 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


# Text rules -----------------------------------------------------------------------------------

_LOW = r"""(length(s) < 24 OR len(regexp_extract_all(s, '[A-Za-z0-9]')) < 0.48 * length(s) OR (len(regexp_extract_all(s, '[A-Za-z]')) < 10 AND len(regexp_extract_all(s, '[0-9%#\-+./]')) >= 10) OR regexp_matches(s, '(?:\b[A-Za-z]{1,2}\b[\s,;:\-|]*){8,}'))"""


@query(rf"WITH l AS (SELECT doc_id, pos, line, {_sq('line')} AS s FROM {_LINES}) SELECT doc_id, pos::INT AS pos, {_LOW} AS low_information, regexp_matches(line, '{T.CITATION_NEEDED}') AS citation_needed FROM l")
def line_predicates(spark, sf):
    """C09, C11, I60 over every line."""
    return lines(spark, sf).select("doc_id", "pos", T.is_low_information(F.col("line")).alias("low_information"), T.is_citation_needed(F.col("line")).alias("citation_needed"))


@query(rf"""WITH l AS (SELECT doc_id, pos, {_sq('line')} AS s FROM {_LINES}), w AS (SELECT *, regexp_extract_all(s, '[A-Za-z][A-Za-z\-'']+') AS ws FROM l)
SELECT doc_id, pos::INT AS pos, (length(s) = 0 OR (length(s) <= 240 AND (regexp_matches(s, '{T.META_NOISE}') OR (len(ws) >= 8 AND len(regexp_extract_all(s, '[,;]\s*[A-Za-z]')) >= 3 AND length(s) <= 220 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) >= 6 AND list_sum(list_transform(ws, lambda x: length(x))) <= 10 * len(ws))))) AS meta_noise FROM w""")
def meta_noise_lines(spark, sf):
    """C12."""
    return lines(spark, sf).select("doc_id", "pos", T.is_meta_noise(F.col("line")).alias("meta_noise"))


@query(rf"""SELECT doc_id, round(len(regexp_extract_all(text, '\p{{Han}}')) / greatest(1, len(regexp_extract_all(text, '\S'))), 6) AS cjk_share,
 floor(1.5::DOUBLE * len(regexp_extract_all(text, '\p{{Han}}')) + 0.35::DOUBLE * (length(text) - len(regexp_extract_all(text, '\p{{Han}}')))) AS tokens_cjk, greatest(1, length(text) // 4) AS tokens_quarter, greatest(1, ceil(length(text) / 3.6)::BIGINT) AS tokens_provider FROM documents""")
def token_estimates(spark, sf):
    """C30, I18, I19, I20."""
    d = t(spark, sf, "documents")
    share = F.regexp_count("text", F.lit(f"[{T.CJK}]")) / F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\S")))
    return d.select("doc_id", F.round(share, 6).alias("cjk_share"), T.estimate_cjk(F.col("text")).cast("double").alias("tokens_cjk"), T.estimate_quarter(F.col("text")).alias("tokens_quarter"), T.estimate_provider(F.col("text")).alias("tokens_provider"))


_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(h, '(?i){p}') THEN '{lab}'" for lab, p in T.SECTION_LABELS) + " ELSE '' END"


@query(rf"""WITH b AS (SELECT item_id, unnest(string_split(text, '.')) AS s FROM benchmark UNION ALL SELECT r_regionkey, v || ' ' || r_name FROM region, (VALUES ('2.1 Methods and'), ('IV. Results of'), ('Abstract'), ('3) Future Work in'), ('References')) x(v)),
n AS (SELECT item_id, trim(s) AS s, lower(trim(regexp_replace({_sq('s')}, '^(?:[0-9]+(?:\.[0-9]+)*[.)]?|[IVXivx]+[.)])\s+', ''))) AS h FROM b)
SELECT item_id, s AS heading, {_LABEL} AS label, length(s) <= 90 AND regexp_matches(s, '{T.NUMBERED_HEADING}') AS numbered, length(s) > 0 AND ((length(s) <= 90 AND regexp_matches(s, '{T.NUMBERED_HEADING}')) OR (length(s) <= 90 AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: length(x) > 0)) <= 14 AND NOT regexp_matches(s, '[。！？!?]\s'))) AS heading_like FROM n""")
def heading_labels(spark, sf):
    """C13, C14, C15, I62."""
    b = t(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", r"\.")).alias("s"))
    made = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("item_id"), F.explode(F.transform(F.array(*[F.lit(x) for x in ("2.1 Methods and", "IV. Results of", "Abstract", "3) Future Work in", "References")]), lambda x: F.concat_ws(" ", x, "r_name"))).alias("s"))
    s = F.trim("s")
    return b.unionByName(made).select("item_id", s.alias("heading"), T.section_label(F.col("s")).alias("label"), T.is_numbered_heading(F.col("s")).alias("numbered"), T.is_heading_like(F.col("s")).alias("heading_like"))


@query(f"""WITH p AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS pages, count(*) AS n FROM {_BLOCKS} GROUP BY doc_id, page)
SELECT doc_id, page, n AS blocks, CASE WHEN page / pages <= 0.12 THEN 'Abstract' WHEN page / pages <= 0.35 THEN 'Introduction' WHEN page / pages <= 0.62 THEN 'Methods' WHEN page / pages <= 0.82 THEN 'Results' WHEN page / pages <= 0.94 THEN 'Discussion' ELSE 'Conclusion' END AS label FROM p""")
def position_labels(spark, sf):
    """C16."""
    p = blocks(spark, sf).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("blocks"))
    return p.withColumn("pages", F.max("page").over(Window.partitionBy("doc_id"))).select("doc_id", "page", "blocks", T.label_by_position(F.col("page"), F.col("pages")).alias("label"))


@query(rf"""WITH l AS (SELECT source, doc_id, lower({_sq('line')}) AS norm FROM {_LINES}) SELECT source, norm, count(DISTINCT doc_id) AS pages FROM l WHERE norm <> '' AND length(norm) < 90 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""")
def running_header_lines(spark, sf):
    """C17 with documents as pages of their source."""
    return L.running_headers(lines(spark, sf), "source", "doc_id", "line")


@query(rf"""WITH l AS (SELECT source, doc_id, pos, line, lower({_sq('line')}) AS norm FROM {_LINES}), h AS (SELECT source, norm FROM l WHERE norm <> '' AND length(norm) < 90 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS kept, sum(length(line))::BIGINT AS chars FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source = l.source AND h.norm = l.norm) GROUP BY doc_id""")
def without_headers(spark, sf):
    """C17, F25."""
    sized = lines(spark, sf).withColumn("chars", F.length("line"))
    return L.without_running_headers(sized, "source", "doc_id", "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("chars").alias("chars"))


@query(r"""WITH w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
k AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS a, list_distinct(regexp_extract_all(lower(prev), '[a-z]{4,}')) AS b FROM w WHERE prev IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(100.0 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 1) END AS overlap FROM k""")
def overlap_report(spark, sf):
    """Each turn against the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf, "conversations").withColumn("prev", F.lag("text").over(w)).where("prev IS NOT NULL")
    return c.select("conv_id", "turn", T.overlap_jaccard(F.col("text"), F.col("prev")).alias("overlap"))


_TURNS = "(SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS g, lower(trim(regexp_replace(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '\\s+', ' ', 'g'))) AS p FROM conversations)"


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as true texts, whole, each with the turn before it as what was read."""
    return t(spark, sf, "conversations").withColumn("read", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))


# DuckDB's levenshtein counts bytes: letters that take two become capitals, of which there are none.
_ASCII = "translate({}, 'ßäçèéêíñóöüàâîôûëïáú', 'ABCDEFGHIJKLMNOPQRST')"


@query(f"SELECT conv_id, turn, round(CASE WHEN length(g) = 0 THEN CASE WHEN length(p) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein({_ASCII.format('g')}, {_ASCII.format('p')}) / length(g) END, 6) AS cer FROM {_TURNS}")
def ocr_cer(spark, sf):
    """Whole turns."""
    return readings(spark, sf).select("conv_id", "turn", F.round(T.character_error_rate(F.col("read"), F.col("text")), 6).alias("cer"))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select("conv_id", "turn", T.character_error_rate(F.col("read"), F.col("text")).alias("cer"), U.word_error_rate(F.col("read"), F.col("text")).alias("wer"))


@query()
def ocr_error_rates(spark, sf):
    """I23, I24, I25, I26 of whole turns."""
    return rates(spark, sf)


@query()
def ocr_average(spark, sf):
    """0 where there is no sample."""
    return T.average_error_rates(rates(spark, sf))


# Packing and listing --------------------------------------------------------------------------

@query("""WITH c AS (SELECT conv_id, turn, text, greatest(1, length(text) // 4) AS cost, coalesce(sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, rtrim(CASE WHEN cost <= 60 - before THEN text ELSE rtrim(substr(text, 1, (4 * (60 - before))::INT)) END) AS packed, CASE WHEN cost <= 60 - before THEN cost ELSE 60 - before END::BIGINT AS packed_tokens FROM c WHERE before < 60""")
def budget_pack(spark, sf):
    """F09."""
    out = R.pack_budget(t(spark, sf, "conversations"), 60, ["conv_id"], "turn", "text")
    return out.select("conv_id", "turn", F.rtrim("packed").alias("packed"), "packed_tokens")


@query("""WITH c AS (SELECT conv_id, turn, sum(floor(0.35::DOUBLE * length(text))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, turn, used::BIGINT AS used FROM c WHERE used <= 120""")
def history_tail_pack(spark, sf):
    """F10, F11, I18."""
    return R.pack_newest(t(spark, sf, "conversations"), 120, ["conv_id"], "turn").select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def last_n_turns(spark, sf):
    """A10, A11, A40."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return t(spark, sf, "conversations").withColumn("n", n).where("n <= 4").select("conv_id", "turn", "role")


@query("""WITH c AS (SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn, count(*) FILTER (WHERE role = 'user') AS user_turns FROM conversations GROUP BY conv_id), n AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY last_turn DESC, conv_id) AS n FROM c)
SELECT conv_id, message_count, last_turn, user_turns, total FROM n WHERE n > 10 AND n <= 60""")
def conversation_list(spark, sf):
    """The second page of 50, and how many there are."""
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("user_turns"))
    total = c.agg(F.count(F.lit(1)).alias("total"))
    page = c.orderBy(F.col("last_turn").desc(), "conv_id").offset(10).limit(50)
    return page.join(F.broadcast(total))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_listing(spark, sf):
    """A12, A13, A16, E23."""
    return t(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5)::BIGINT AS batch FROM orders")
def fixed_batches(spark, sf):
    """E24."""
    return L.batches(t(spark, sf, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "batch")


# Layout ---------------------------------------------------------------------------------------

@query(f"""WITH b AS (SELECT doc_id, page, pos, seq_id, type, lag(seq_id) OVER w AS prev_id, lead(seq_id) OVER w AS next_id, lag(type) OVER w AS pt, lead(type) OVER w AS nt FROM {_BLOCKS} WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos))
SELECT seq_id, prev_id, next_id, 'eq:' || CASE WHEN type = 'Equation' THEN seq_id WHEN nt = 'Equation' THEN next_id WHEN pt = 'Equation' THEN prev_id END AS affinity FROM b""")
def prev_next_links(spark, sf):
    """F02."""
    return L.neighbour_links(blocks(spark, sf), ["doc_id", "page"], "pos").select("seq_id", "prev_id", "next_id", "affinity")


@query(f"""WITH b AS (SELECT seq_id, type, sum((type = 'Figure')::INT) OVER w AS f, sum((type = 'Table')::INT) OVER w AS t, sum((type = 'Equation')::INT) OVER w AS e FROM {_BLOCKS} WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT seq_id, CASE type WHEN 'Figure' THEN 'fig.' || f::BIGINT WHEN 'Table' THEN 'table.' || t::BIGINT WHEN 'Equation' THEN 'eq.' || e::BIGINT END AS label FROM b""")
def label_counters(spark, sf):
    """F03."""
    return L.label_counters(blocks(spark, sf), "doc_id", ["pos"]).select("seq_id", "label")


@query(f"""SELECT seq_id, last_value(CASE WHEN type = 'Title' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM {_BLOCKS}""")
def section_forward_fill(spark, sf):
    """F04, F26."""
    title = F.when(F.col("type") == "Title", F.col("text")).otherwise("")
    return L.section_fill(blocks(spark, sf), "doc_id", ["pos"], title).select("seq_id", "section")


@query(f"""WITH b AS (SELECT *, sum((type = 'Title')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM {_BLOCKS}),
s AS (SELECT doc_id, island, coalesce(max(CASE WHEN type = 'Title' THEN text END), 'Front Matter') AS title, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE type <> 'Title'), '') AS text FROM b GROUP BY doc_id, island),
f AS (SELECT *, max(island) OVER (PARTITION BY doc_id) AS titles FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island)::INT AS segment, title, sha256(text) AS text_hash FROM f WHERE titles > 0 AND length(text) >= 20""")
def title_segments(spark, sf):
    """F05; of K11 the title sections alone."""
    s = L.title_segments(blocks(spark, sf), "doc_id", "pos", F.col("type") == "Title", F.col("text"))
    return s.select("doc_id", "segment", "title", F.sha2("text", 256).alias("text_hash"))


@query(f"""SELECT doc_id, page, string_agg(text, chr(10) ORDER BY pos) AS text FROM {_BLOCKS} WHERE type NOT IN ('Figure', 'Table') GROUP BY doc_id, page HAVING length(string_agg(text, chr(10) ORDER BY pos)) >= 20""")
def page_segments(spark, sf):
    """A29, K12."""
    b = blocks(spark, sf).where(~F.col("type").isin("Figure", "Table"))
    g = b.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return g.where(F.length("text") >= 20)


_BOX = "[x0, y0, x0 + 120, y0 + 60]"


def _reader(b: DataFrame, shift: int) -> DataFrame:
    x, y = F.col("x0") + shift, F.col("y0") + shift
    return b.select("doc_id", "page", "seq_id", "type", F.array(x, y, x + 120, y + 60).alias("bbox"), F.col("text").alias("content"), ((F.col("doc_id") * 7 + F.col("pos") * 3 + shift) % 100 / 100.0).alias("score"))


@query(f"""WITH a AS (SELECT * FROM {_BLOCKS} WHERE type = 'Body'), b AS (SELECT doc_id, page, CASE WHEN pos % 2 = 0 THEN seq_id ELSE 'b' || seq_id END AS bid, x0 + 10 AS bx, y0 + 10 AS byy, pos FROM {_BLOCKS}),
i AS (SELECT a.seq_id, b.bid, true AS by_id FROM a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq_id = b.bid),
r AS (SELECT a.seq_id, b.bid, false AS by_id, greatest(0, least(a.x0 + 120, b.bx + 120) - greatest(a.x0, b.bx)) * greatest(0, least(a.y0 + 60, b.byy + 60) - greatest(a.y0, b.byy)) AS inter, a.x0, a.y0, b.bx, b.byy
  FROM a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = a.doc_id AND c.page = a.page AND c.bid = a.seq_id))
SELECT seq_id, bid AS b_seq_id, by_id FROM i UNION ALL SELECT seq_id, bid, by_id FROM r WHERE inter / (14400.0 - inter) > 0.1 OR (bx + 60 BETWEEN x0 AND x0 + 120 AND byy + 30 BETWEEN y0 AND y0 + 60)""")
def dual_reader_match(spark, sf):
    """D05, I28, I31."""
    b = blocks(spark, sf)
    right = _reader(b.withColumn("seq_id", F.when(F.col("pos") % 2 == 0, F.col("seq_id")).otherwise(F.concat(F.lit("b"), "seq_id"))), 10)
    return L.match_readers(_reader(b.where("type = 'Body'"), 0), right, ["doc_id", "page"]).select("seq_id", "b_seq_id", "by_id")


@query(f"""WITH a AS (SELECT seq_id, type, trim(text) AS a, (doc_id * 7 + pos * 3) % 100 / 100.0 AS sa, trim(substr(text, 1, length(text) - length(text) // 10)) AS b, (doc_id * 7 + pos * 3 + 30) % 100 / 100.0 AS sb FROM {_BLOCKS} WHERE type IN ('Body', 'Figure', 'Table')),
d AS (SELECT *, CASE WHEN length(a) < 3 AND length(b) > 3 THEN true WHEN sb > sa + 0.1 AND length(b) >= greatest(3, floor(length(a) * 0.85)) THEN true WHEN type IN ('Figure', 'Table') AND length(b) > length(a) THEN true ELSE false END AS ub FROM a)
SELECT seq_id, sha256(CASE WHEN ub THEN b ELSE a END) AS content_hash, CASE WHEN ub THEN 'stack_b_override' ELSE 'stack_a' END AS source, round(CASE WHEN ub THEN sb WHEN sa > 0 THEN sa ELSE sb END, 4) AS score, round(greatest(sa, sb), 4) AS arbiter_score FROM d""")
def dual_reader_arbitrate(spark, sf):
    """D08 (without rescue), I36, H10 apart."""
    b = blocks(spark, sf).where("type IN ('Body', 'Figure', 'Table')")
    right = b.withColumn("text", F.substr("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 10).cast("int")))
    out = L.arbitrate(_reader(b, 0), _reader(right, 30).withColumn("bbox", F.col("bbox")), ["doc_id", "page"])
    return out.select("seq_id", F.sha2("content", 256).alias("content_hash"), "source", "score", "arbiter_score")


@query(f"""WITH b AS (SELECT seq_id, x0, y0, (x0 * 3 + 50) % 400 AS x, (y0 * 5 + 20) % 700 AS y FROM {_BLOCKS}), i AS (SELECT *, greatest(0, least(x0 + 120, x + 100) - greatest(x0, x)) * greatest(0, least(y0 + 60, y + 80) - greatest(y0, y)) AS inter FROM b)
SELECT seq_id, round(inter / (7200 + 8000 - inter), 6) AS iou, round(inter / 7200, 6) AS overlap, (x0 <= x + 50 AND x + 50 <= x0 + 120 AND y0 <= y + 40 AND y + 40 <= y0 + 60) AS inside FROM i""")
def box_overlap(spark, sf):
    """I27, I28, I29, I30, I31, D07."""
    x, y = (F.col("x0") * 3 + 50) % 400, (F.col("y0") * 5 + 20) % 700
    a = F.array("x0", "y0", F.col("x0") + 120, F.col("y0") + 60)
    b = F.array(x, y, x + 100, y + 80)
    return blocks(spark, sf).select("seq_id", F.round(G.iou(a, b), 6).alias("iou"), F.round(G.overlap_ratio(a, b), 6).alias("overlap"), G.center_inside(b, a).alias("inside"))


@query(f"""WITH s AS (SELECT doc_id, pos // 7 AS section, min(pos) AS first, max(pos) AS last FROM {_BLOCKS} WHERE pos % 3 <> 2 GROUP BY doc_id, pos // 7), r AS (SELECT doc_id, seq_id AS ref, pos FROM {_BLOCKS} WHERE pos % 3 = 2),
j AS (SELECT r.*, s.section, s.last, (s.first <= r.pos AND r.pos <= s.last) AS inside FROM r JOIN s ON r.doc_id = s.doc_id AND (s.last <= r.pos OR (s.first <= r.pos AND r.pos <= s.last)))
SELECT ref, section FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY inside DESC, last DESC, section DESC) AS n FROM j) WHERE n = 1""")
def nearest_section_asof(spark, sf):
    """D14."""
    b = blocks(spark, sf)
    s = b.where("pos % 3 <> 2").groupBy("doc_id", F.floor(F.col("pos") / 7).alias("section")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    r = b.where("pos % 3 = 2").select("doc_id", F.col("seq_id").alias("ref"), "pos")
    return L.nearest_section(r, s, "doc_id").select("ref", "section")


@query(f"""SELECT doc_id, ref, n::INT AS n FROM (SELECT doc_id, seq_id AS ref, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {_BLOCKS} WHERE NOT (type = 'Body' AND pos % 2 = 0)) WHERE n <= 180""")
def uncovered_refs(spark, sf):
    """D15, H08."""
    b = blocks(spark, sf).select("doc_id", F.col("seq_id").alias("ref"), "pos", "type")
    return L.uncovered(b, b.where("type = 'Body' AND pos % 2 = 0"), "doc_id").select("doc_id", "ref", "n")


@query(f"""SELECT doc_id, min(section) AS section, ref FROM (SELECT doc_id, pos % 3 AS section, type AS ref FROM {_BLOCKS}) GROUP BY doc_id, ref""")
def first_claims(spark, sf):
    """Kinds of block as refs, claimed by position modulo 3."""
    s = blocks(spark, sf).groupBy("doc_id", (F.col("pos") % 3).alias("section")).agg(F.collect_set("type").alias("refs"))
    return L.first_claim(s, "doc_id").select("doc_id", "section", "ref")


@query(f"""WITH r AS (SELECT doc_id, length(text) AS n, type = 'Body' AS a, type = 'Table' AS d FROM {_BLOCKS})
SELECT doc_id, count(*) AS refs, sum((a OR d)::INT)::BIGINT AS covered, round(sum((a OR d)::INT) / count(*), 4) AS ref_ratio, round(least(2.0, sum(CASE WHEN a THEN n ELSE 0 END) / greatest(1, sum(n))), 4) AS char_ratio FROM r GROUP BY doc_id""")
def reflow_coverage(spark, sf):
    """E06, E07, E15."""
    r = blocks(spark, sf).select("doc_id", F.col("seq_id").alias("ref"), "text", (F.col("type") == "Body").alias("assigned"), (F.col("type") == "Table").alias("dropped"))
    return L.coverage(r, "doc_id").select("doc_id", "refs", "covered", "ref_ratio", "char_ratio")


@query(rf"""WITH b AS (SELECT doc_id, {_sq('text')} AS s, CASE WHEN pos % 9 = 4 THEN ' Stack_A.left' WHEN doc_id % 4 = 1 AND pos % 9 = 5 THEN '' ELSE 'stack_b' END AS src FROM {_BLOCKS}),
g AS (SELECT doc_id, count(*) AS block_count, sum(len(regexp_extract_all(s, '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]+')))::BIGINT AS token_total, count(*) FILTER (WHERE starts_with(lower(trim(src)), 'stack_a')) AS stack_a_count, count(*) FILTER (WHERE starts_with(lower(trim(src)), 'stack_b')) AS stack_b_count FROM b WHERE s <> '' GROUP BY doc_id),
v AS (SELECT *, token_total / block_count AS a, stack_b_count / block_count AS r FROM g)
SELECT doc_id, block_count, token_total, stack_a_count, stack_b_count, round(a, 4) AS avg_tokens_per_block, round(stack_a_count / block_count, 4) AS stack_a_ratio, round(r, 4) AS stack_b_ratio,
  (block_count >= 16 AND (a < 4 OR r > 0.92 AND a < 8)) AS low_quality, concat_ws(',', CASE WHEN block_count >= 16 AND a < 4 THEN printf('avg_tokens_per_block=%.2f<4.00', a) END, CASE WHEN block_count >= 16 AND r > 0.92 AND a < 8 THEN printf('stack_b_ratio=%.3f>0.920 with avg_tokens=%.2f<8.00', r, a) END) AS reasons FROM v""")
def fusion_quality(spark, sf):
    """Readers by position."""
    reader = F.when(F.col("pos") % 9 == 4, " Stack_A.left").when((F.col("doc_id") % 4 == 1) & (F.col("pos") % 9 == 5), "").otherwise("stack_b")
    return L.quality_metrics(blocks(spark, sf).withColumn("source", reader), "doc_id").withColumn("reasons", F.array_join("reasons", ","))


@query(f"""SELECT doc_id, page, sum((type = 'Body')::INT)::BIGINT AS body, sum((type = 'Figure')::INT)::BIGINT AS figure, sum((type = 'Table')::INT)::BIGINT AS "table", sum((type = 'Equation')::INT)::BIGINT AS equation, count(*) AS blocks, count(x0 % 50) <> count(DISTINCT x0 % 50) AS order_repeats FROM {_BLOCKS} GROUP BY doc_id, page""")
def page_audit(spark, sf):
    """E08, E18."""
    return L.page_audit(blocks(spark, sf).withColumn("reading_order", F.col("x0") % 50), ["doc_id", "page"])


@query(f"""WITH h AS (SELECT DISTINCT doc_id FROM {_BLOCKS} WHERE type = 'Title' AND page = 1)
SELECT doc_id, arg_max(seq_id, (length(text), seq_id)) AS ref, max(length(text)) AS chars FROM {_BLOCKS} WHERE page = 1 AND length(text) >= 300 AND doc_id NOT IN (SELECT doc_id FROM h) GROUP BY doc_id""")
def abstract_fallback(spark, sf):
    """F23, A04."""
    r = blocks(spark, sf).select("doc_id", "page", F.col("seq_id").alias("ref"), "text", F.when((F.col("type") == "Title") & (F.col("page") == 1), "Abstract").alias("label"))
    return L.longest_as_abstract(r, "doc_id").select("doc_id", "ref", F.col("chars").cast("long").alias("chars"))


# Usage, sessions and rates ----------------------------------------------------------------------

def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a usage log: vendors and models in turn, tokens from the value and the id."""
    e, i = t(spark, sf, "events"), F.col("event_id")
    vendor = F.when(i % 3 == 0, "OpenAI").when(i % 3 == 1, "Google").otherwise("openrouter")
    model = F.when(i % 3 == 0, F.when(i % 2 == 0, "gpt-4.1").otherwise("gpt-4.1-mini-2025-04-14")).when(i % 3 == 1, F.when(i % 2 == 0, "gemini-2.5-pro").otherwise("gemini-flash-latest")).otherwise("auto")
    return e.select("event_id", "user_id", F.concat(F.lit("p"), F.col("user_id") % 7).alias("pid"), vendor.alias("vendor"), model.alias("model"), ((i * 37) % 400000).alias("input_tokens"), ((i * 11) % 900).alias("output_tokens"), ((i * 5) % 500).alias("cached_tokens"))


_USAGE = """u AS (SELECT event_id, user_id, 'p' || user_id % 7 AS pid, CASE event_id % 3 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Google' ELSE 'openrouter' END AS vendor,
  CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'gpt-4.1' ELSE 'gpt-4.1-mini-2025-04-14' END WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'gemini-2.5-pro' ELSE 'gemini-flash-latest' END ELSE 'auto' END AS model,
  (event_id * 37) % 400000 AS i, (event_id * 11) % 900 AS o, least((event_id * 5) % 500, (event_id * 37) % 400000) AS c, (event_id * 5) % 500 AS craw FROM events),
r AS (SELECT *, CASE WHEN model = 'gpt-4.1' THEN [2.0, 0.5, 8.0] WHEN model LIKE 'gpt-4.1-mini%' THEN [0.4, 0.1, 1.6] WHEN model = 'gemini-2.5-pro' THEN CASE WHEN i > 200000 THEN [2.5, 0.25, 15.0] ELSE [1.25, 0.125, 10.0] END END::DECIMAL(9,4)[] AS p FROM u),
k AS (SELECT *, round(((i - c) * p[1] + c * p[2] + o * p[3])::DECIMAL(24,4) * 0.000001::DECIMAL(7,6), 6)::DOUBLE AS cost FROM r)"""


@query(f"""WITH {_USAGE} SELECT pid, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(craw)::BIGINT AS cached_tokens, sum(i + o)::BIGINT AS total_tokens, round(sum(coalesce(cost, 0)), 4) AS cost_usd,
max((cost IS NULL)::INT) AS has_unpriced, sum(CASE WHEN cost IS NULL THEN i + o ELSE 0 END)::BIGINT AS unpriced_tokens, array_to_string(list_sort(list(DISTINCT vendor || '/' || model)), ',') AS models FROM k GROUP BY pid""")
def usage_summary(spark, sf):
    """E01, E02, I37, I38."""
    return A.usage_summary(A.with_cost(usage(spark, sf)), "pid").withColumn("cost_usd", F.round("cost_usd", 4))


@query(f"WITH {_USAGE} SELECT event_id, cost AS cost_usd FROM k")
def usage_cost(spark, sf):
    """Null where a model has no price."""
    return A.with_cost(usage(spark, sf)).select("event_id", "cost_usd")


@query(f"WITH {_USAGE} SELECT vendor, model, count(*) AS calls, count(cost) AS priced, count(*) - count(cost) AS unpriced FROM k GROUP BY ALL")
def usage_unpriced(spark, sf):
    """What a backfill can price."""
    c = A.with_cost(usage(spark, sf))
    return c.groupBy("vendor", "model").agg(F.count(F.lit(1)).alias("calls"), F.count("cost_usd").alias("priced"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"))


@query("""WITH j AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"prompt_tokens": ' || event_id || ', "completion_tokens": 5}' WHEN 1 THEN '{"prompt_token_count": ' || event_id || ', "candidates_token_count": 3, "total_token_count": 10}' ELSE '{"input_tokens": "x", "cached_tokens": 4}' END AS raw FROM events)
SELECT event_id, CASE event_id % 3 WHEN 2 THEN 0 ELSE event_id END AS input, CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 0 END::BIGINT AS output, CASE event_id % 3 WHEN 0 THEN event_id + 5 WHEN 1 THEN 10 ELSE 0 END::BIGINT AS total FROM j""")
def usage_normalised(spark, sf):
    """Keys of several vendors, total falling back to the sum."""
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit('{"prompt_tokens": '), i, F.lit(', "completion_tokens": 5}'))).when(i % 3 == 1, F.concat(F.lit('{"prompt_token_count": '), i, F.lit(', "candidates_token_count": 3, "total_token_count": 10}'))).otherwise(F.lit('{"input_tokens": "x", "cached_tokens": 4}'))
    e = t(spark, sf, "events").select("event_id", raw.alias("raw"))
    e = e.select("event_id", A.first_number(F.col("raw"), "input_tokens", "prompt_tokens", "prompt_token_count").alias("input"), A.first_number(F.col("raw"), "output_tokens", "completion_tokens", "candidates_token_count").alias("output"), A.first_number(F.col("raw"), "total_tokens", "total_token_count").alias("t"))
    return e.select("event_id", "input", "output", F.when(F.col("t") > 0, F.col("t")).otherwise(F.col("input") + F.col("output")).alias("total"))


_SESSIONS = """e AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e),
s AS (SELECT user_id, session, min(ts) AS login_at, max(ts) AS ended_at, count(*) AS beats, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000)::BIGINT AS seconds FROM n GROUP BY user_id, session)"""


@query(f"WITH {_SESSIONS} SELECT user_id, epoch_us(login_at) AS login_us, epoch_us(ended_at) AS ended_us, beats, seconds FROM s")
def idle_sessions(spark, sf):
    """J01, J02, J07."""
    s = A.sessions(t(spark, sf, "events"), "user_id", "ts", 3600)
    return s.select("user_id", F.unix_micros(F.col("login_at").cast("timestamp")).alias("login_us"), F.unix_micros(F.col("ended_at").cast("timestamp")).alias("ended_us"), "beats", "seconds")


@query(f"WITH {_SESSIONS} SELECT user_id, count(*) AS logins, sum(seconds)::BIGINT AS total_seconds, epoch_us(max(login_at)) AS last_login_us, round(sum(seconds) / 60, 1) AS total_minutes, round(sum(seconds) / 60 / count(*), 1) AS mean_minutes FROM s GROUP BY user_id")
def activity_stats(spark, sf):
    """E09."""
    a = A.activity(A.sessions(t(spark, sf, "events"), "user_id", "ts", 3600), "user_id")
    return a.select("user_id", "logins", "total_seconds", F.unix_micros(F.col("last_login").cast("timestamp")).alias("last_login_us"), "total_minutes", "mean_minutes")


@query("""SELECT epoch_us(ts) // 60000000 AS minute, count(*) AS requests, sum((event_id * 11) % 900)::BIGINT AS tokens, count(*) > 2 AS over FROM events GROUP BY 1""")
def rate_windows(spark, sf):
    """Sums of tumbling minutes."""
    return A.rate_windows(t(spark, sf, "events"), "ts", (F.col("event_id") * 11) % 900, 2)


# Sequential within a key's day: a list of requests is folded, its state carried in the first of two.
_ADMIT = """CASE WHEN (CASE WHEN r.m = a.m THEN a.rm ELSE 0 END) + 1 > 2 THEN 'rpm_limit' WHEN (CASE WHEN r.m = a.m THEN a.tm ELSE 0 END) + r.n > 1300 THEN 'tpm_limit' WHEN a.rd + 1 > 55 THEN 'rpd_limit' ELSE 'ok' END"""


@query(f"""WITH e AS (SELECT event_id, event_type AS k, epoch_us(ts) // 1000000 AS s, epoch_us(ts) AS us, greatest(1, (event_id * 11) % 900) AS n FROM events),
g AS (SELECT k, s // 86400 AS d, list({{'m': s // 60, 'n': n, 'rm': 0::BIGINT, 'tm': 0::BIGINT, 'rd': 0::BIGINT, 'out': [{{'id': event_id, 's': s, 'why': ''}}]}} ORDER BY us, event_id) AS l FROM e GROUP BY ALL),
f AS (SELECT list_reduce(list_prepend({{'m': -1::BIGINT, 'n': 0::BIGINT, 'rm': 0::BIGINT, 'tm': 0::BIGINT, 'rd': 0::BIGINT, 'out': []::STRUCT(id BIGINT, s BIGINT, why VARCHAR)[]}}, l), lambda a, r: {{'m': r.m, 'n': r.n,
  'rm': (CASE WHEN r.m = a.m THEN a.rm ELSE 0 END) + ({_ADMIT} = 'ok')::INT, 'tm': (CASE WHEN r.m = a.m THEN a.tm ELSE 0 END) + CASE WHEN {_ADMIT} = 'ok' THEN r.n ELSE 0 END, 'rd': a.rd + ({_ADMIT} = 'ok')::INT,
  'out': list_append(a.out, {{'id': r.out[1].id, 's': r.out[1].s, 'why': {_ADMIT}}})}}).out AS o FROM g),
x AS (SELECT unnest(o) AS o FROM f)
SELECT o.id AS event_id, o.why = 'ok' AS allowed, CASE o.why WHEN 'ok' THEN 0.0 WHEN 'rpd_limit' THEN greatest(60, 86400 - o.s % 86400) ELSE greatest(1, 60 - o.s % 60) END::DOUBLE AS wait_seconds, o.why AS reason FROM x""")
def rate_admission(spark, sf):
    """Requests of each event type under limits a minute (2 and 1300 tokens) and a day (55)."""
    e = t(spark, sf, "events").withColumn("tokens", (F.col("event_id") * 11) % 900).withColumn("ts", F.col("ts").cast("timestamp"))
    return K.admissions(e, "event_type", "ts", "event_id", "tokens", K.Limits(2, 1300, 55, 1)).select("event_id", "allowed", "wait_seconds", "reason")


# Bibliography -----------------------------------------------------------------------------------

def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidate references: titles repeat, some have a DOI."""
    k = F.col("p_partkey")
    return t(spark, sf, "part").select(
        k.alias("pos"), F.concat_ws(" ", F.initcap("p_name"), "p_type").alias("title"), F.when(k % 5 == 0, F.concat(F.lit("https://doi.org/10.1234/ABC."), k % 300, F.lit("."))).otherwise("").alias("doi"), F.when(k % 4 == 0, "").otherwise(F.concat_ws(" ", F.lit("Alice Chen and"), "p_brand")).alias("authors"),
        F.when(k % 3 == 0, F.lit(None)).otherwise((F.lit(1990) + k % 35).cast("int")).alias("year"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("http://ex.org/"), k)).alias("url"), F.col("p_brand").alias("venue"), F.when(k % 4 == 1, "arXiv").when(k % 4 == 2, "crossref").otherwise("web").alias("source"), (k % 150).alias("citations"))


_CAND = """c AS (SELECT p_partkey AS pos, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' ' || p_type AS title,
 CASE WHEN p_partkey % 5 = 0 THEN 'https://doi.org/10.1234/ABC.' || p_partkey % 300 || '.' ELSE '' END AS rawdoi, CASE WHEN p_partkey % 5 = 0 THEN '10.1234/ABC.' || p_partkey % 300 ELSE '' END AS doi,
 CASE WHEN p_partkey % 4 = 0 THEN [] ELSE ['Alice Chen', p_brand] END AS authors, CASE WHEN p_partkey % 3 <> 0 THEN (1990 + p_partkey % 35)::INT END AS year, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'http://ex.org/' || p_partkey END AS url, p_brand AS venue,
 CASE p_partkey % 4 WHEN 1 THEN 'arXiv' WHEN 2 THEN 'crossref' ELSE 'web' END AS source, p_partkey % 150 AS citations FROM part),
d AS (SELECT *, regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', '', 'g') AS tk, (CASE WHEN title <> '' THEN 1 ELSE 0 END + (len(authors) > 0)::INT + (year IS NOT NULL)::INT + (doi <> '' OR url <> '')::INT) / 4 AS complete FROM c),
e AS (SELECT *, CASE WHEN doi <> '' THEN 'doi:' || lower(doi) ELSE 'title:' || tk[:120] END AS ckey FROM d)"""


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf).withColumn("doi", B.normalize_doi(F.col("doi"))).withColumn("authors", B.clean_authors(F.col("authors")))
    return c.withColumn("complete", B.completeness(F.col("title"), F.col("authors"), F.col("year"), F.col("doi"), F.col("url"))).withColumn("ckey", B.candidate_key(F.col("doi"), F.col("title")))


@query(f"WITH {_CAND} SELECT pos, doi, len(authors)::INT AS n_authors, year, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE regexp_replace(url, '^http://', 'https://') END AS link, 'lib-' || substr(sha1(CASE WHEN doi <> '' THEN 'doi:' || lower(doi) ELSE 'title:' || tk[:200] END), 1, 12) AS entry, ckey, complete FROM e")
def reference_keys(spark, sf):
    """I09, I40, I42, I48, I50, H01, H02."""
    return prepared(spark, sf).select("pos", "doi", F.size("authors").alias("n_authors"), B.normalize_year(F.col("year")).alias("year"), B.canonical_url(F.col("doi"), F.col("url")).alias("link"), B.entry_key(F.col("doi"), F.col("title")).alias("entry"), "ckey", "complete")


@query(f"WITH {_CAND} SELECT ckey, pos, min(seen) AS seen_at FROM (SELECT ckey, first_value(pos) OVER (PARTITION BY ckey ORDER BY complete DESC, pos) AS pos, pos AS seen FROM e) GROUP BY ckey, pos")
def candidate_dedupe(spark, sf):
    """H01."""
    return A.dedupe_candidates(prepared(spark, sf), "ckey", "complete", "pos").select("ckey", "pos", "seen_at")


_TERMS = ["economy", "steel", "polished copper", "brushed"]


@query(f"""WITH {_CAND}, s AS (SELECT pos, len(list_filter(['economy', 'steel', 'polished copper', 'brushed'], lambda x: contains(lower(title || ' ' || venue), x))) / 4 AS kw, CASE lower(source) WHEN 'crossref' THEN 1.0 WHEN 'arxiv' THEN 0.9 ELSE 0.7 END::DOUBLE AS sw, least(ln(1 + citations) / 6.0, 1.0) AS ci, CASE WHEN year IS NULL THEN 0.4 ELSE greatest(0.0, 1.0 - greatest(0, 2026 - year) / 20.0) END::DOUBLE AS re, complete FROM e)
SELECT pos, round(kw, 4) AS keyword, round(sw, 4) AS source, round(ci, 4) AS citation, round(re, 4) AS recency, round(greatest(0, least(1, 0.35::DOUBLE * kw + 0.25::DOUBLE * sw + 0.2::DOUBLE * ci + 0.1::DOUBLE * re + 0.1::DOUBLE * complete)), 4) AS confidence FROM s""")
def candidate_rank(spark, sf):
    """I08, G04, C10 with a stated year."""
    c = prepared(spark, sf)
    s = B.candidate_score(F.concat_ws(" ", "title", "venue"), F.array(*[F.lit(x) for x in _TERMS]), F.col("source"), F.col("citations"), F.col("year"), F.col("complete"), 2026)
    return c.select("pos", s.alias("s")).select("pos", "s.keyword", "s.source", "s.citation", "s.recency", F.col("s.final").alias("confidence"))


@query(f"WITH {_CAND}, k AS (SELECT *, contains(lower(title), 'steel') OR contains(lower(title), 'zebra') AS hit FROM e) SELECT pos FROM k WHERE hit OR (SELECT count(*) FROM k WHERE hit) = 0")
def keyword_filter(spark, sf):
    """Rows with a keyword, or all where none has one."""
    low = F.lower("title")
    hit = low.contains("steel") | low.contains("zebra")
    c = prepared(spark, sf).withColumn("hit", hit)
    any_hit = c.agg(F.max(F.col("hit").cast("int")).alias("any"))
    return c.join(F.broadcast(any_hit)).where("hit OR any = 0").select("pos")


@query(f"""WITH {_CAND}, b AS (SELECT ckey AS key, min_by(title, pos) AS title, max(doi) AS doi, min_by(venue, pos) AS venue, max((pos % 6 = 0)::INT) = 1 AS suspect FROM e WHERE pos % 3 <> 1 GROUP BY ckey), c2 AS (SELECT ckey AS key, min_by(title, pos) AS title, max(doi) AS doi, min_by(venue, pos) AS venue FROM e WHERE pos % 3 <> 2 GROUP BY ckey)
SELECT coalesce(b.key, c2.key) AS key, coalesce(b.title, c2.title) AS title, coalesce(nullif(b.doi, ''), c2.doi) AS doi, coalesce(b.venue, c2.venue) AS venue, b.key IS NOT NULL AND c2.key IS NOT NULL AS consensus FROM b FULL OUTER JOIN c2 ON b.key = c2.key WHERE (b.key IS NOT NULL AND c2.key IS NOT NULL) OR NOT coalesce(b.suspect, false)""")
def scout_merge(spark, sf):
    """D12, G06, H03."""
    c = prepared(spark, sf)
    g = lambda d, *more: d.groupBy(F.col("ckey").alias("key")).agg(F.min_by("title", "pos").alias("title"), F.max("doi").alias("doi"), F.min_by("venue", "pos").alias("venue"), *more)
    b = g(c.where("pos % 3 <> 1"), (F.max((F.col("pos") % 6 == 0).cast("int")) == 1).alias("suspect"))
    return A.scout_merge(b, g(c.where("pos % 3 <> 2")))


@query(f"""WITH {_CAND} SELECT ckey, min_by(title, pos) AS title, min_by(venue, pos) AS venue, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max((pos % 7 = 0)::INT) AS verified, max(citations / 150) AS confidence, count(*) AS seen FROM e GROUP BY ckey""")
def library_merge(spark, sf):
    """K03, K04, A26."""
    c = prepared(spark, sf).withColumn("verified", F.col("pos") % 7 == 0).withColumn("confidence", F.col("citations") / 150).withColumn("abstract", F.lit(""))
    return A.merge_candidates(c, "ckey", "pos").drop("abstract")


_CKEY = "coalesce(nullif(regexp_replace(lower(string_split(coalesce(authors[1], 'unknown'), ' ')[-1]) || coalesce(year::VARCHAR, 'nd') || array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+')[:3], ''), '[^a-z0-9_:-]', '', 'g'), ''), 'ref')"


@query(f"""WITH {_CAND} SELECT pos, '@article{{' || {_CKEY} || ',' || chr(10) || array_to_string(list_filter(['  title = {{' || title || '}}', CASE WHEN len(authors) > 0 THEN '  author = {{' || array_to_string(authors, ' and ') || '}}' END, '  year = {{' || year || '}}', '  journal = {{' || venue || '}}', CASE WHEN doi <> '' THEN '  doi = {{' || doi || '}}' END, CASE WHEN url <> '' THEN '  url = {{' || url || '}}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS entry FROM e""")
def bibtex_export(spark, sf):
    """B01, B04, I53."""
    c = prepared(spark, sf)
    return c.select("pos", B.bibtex_entry(F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("doi"), F.col("url")).alias("entry"))


@query(f"""WITH {_CAND} SELECT pos, array_to_string(list_filter(['TY  - JOUR', 'TI  - ' || title, CASE WHEN len(authors) > 0 THEN 'AU  - ' || array_to_string(authors, chr(10) || 'AU  - ') END, 'PY  - ' || year, 'JO  - ' || venue, CASE WHEN doi <> '' THEN 'DO  - ' || doi END, CASE WHEN url <> '' THEN 'UR  - ' || url END, 'ER  - '], lambda x: x IS NOT NULL), chr(10)) AS entry FROM e""")
def ris_export(spark, sf):
    """B02."""
    return prepared(spark, sf).select("pos", B.ris_entry(F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("doi"), F.col("url")).alias("entry"))


@query(f"""WITH {_CAND} SELECT pos, CASE len(authors) WHEN 0 THEN 'Unknown' ELSE authors[1] || ' & ' || authors[2] END || ' (' || coalesce(year::VARCHAR, 'n.d.') || '). ' || title || '. ' || venue || '.' || CASE WHEN doi <> '' THEN ' https://doi.org/' || doi WHEN url <> '' THEN ' ' || url ELSE '' END AS citation FROM e""")
def apa_citations(spark, sf):
    """I46, I47."""
    return prepared(spark, sf).select("pos", B.apa_citation(F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("doi"), F.col("url")).alias("citation"))


@query(f"""WITH {_CAND} SELECT pos, '{{"type":"article-journal","id":"' || {_CKEY} || '","title":"' || title || '"' || CASE WHEN len(authors) > 0 THEN ',"author":[{{"literal":"' || authors[1] || '"}},{{"literal":"' || authors[2] || '"}}]' ELSE '' END || CASE WHEN year IS NOT NULL THEN ',"issued":{{"date-parts":[[' || year || ']]}}' ELSE '' END || ',"container-title":"' || venue || '"' || CASE WHEN doi <> '' THEN ',"DOI":"' || doi || '"' ELSE '' END || CASE WHEN url <> '' THEN ',"URL":"' || url || '"' ELSE '' END || '}}' AS item FROM e""")
def csl_export(spark, sf):
    """B03."""
    return prepared(spark, sf).select("pos", B.csl_json(F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("doi"), F.col("url")).alias("item"))


# Members, versions, merges ------------------------------------------------------------------------

@query("""SELECT n_name AS project, c_custkey AS user_id, c_mktsegment AS role FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def project_membership(spark, sf):
    """D01, D02."""
    c = t(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("project"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))


_ROLES = "CASE c_custkey % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'editor' WHEN 2 THEN 'coauthor' WHEN 3 THEN 'reviewer' ELSE 'viewer' END"


@query(f"""WITH m AS (SELECT c_nationkey AS user_id, 'P' || c_custkey % 9 AS base_pid, {_ROLES} AS role, [5, 4, 3, 2, 1][c_custkey % 5 + 1] AS rank FROM customer) SELECT user_id, base_pid, max_by(role, rank) AS role FROM m GROUP BY ALL""")
def workspace_roles(spark, sf):
    """D27, H09."""
    k = F.col("c_custkey")
    role = F.element_at(F.array(*[F.lit(x) for x in ("owner", "editor", "coauthor", "reviewer", "viewer")]), (k % 5 + 1).cast("int"))
    pid = F.concat(F.lit("P"), k % 9, F.when(k % 2 == 0, "-p").otherwise(""))
    m = t(spark, sf, "customer").select(F.col("c_nationkey").alias("user_id"), pid.alias("pid"), role.alias("role"))
    return A.highest_role(m, "user_id", "pid", "role")


@query("""WITH o AS (SELECT o_custkey, count(*) AS projects, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_tasks, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(projects, 0) AS projects, coalesce(open_tasks, 0) AS open_tasks, coalesce(total, 0) AS total FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def mentor_dashboard(spark, sf):
    """Aggregated first, then joined."""
    o = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("projects"), F.count_if(F.col("o_orderstatus") == "O").alias("open_tasks"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = t(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("projects", "open_tasks", "total")])


@query("""WITH m AS (SELECT DISTINCT doc_id // 3 AS u, 'p' || doc_id % 41 AS pid FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 41 % 7 = 0)
SELECT k.u // 4 AS mentor, k.u AS mentee FROM (SELECT DISTINCT doc_id // 3 AS u FROM documents) k WHERE k.u // 4 <> k.u AND EXISTS (SELECT 1 FROM m a JOIN m b ON a.pid = b.pid WHERE a.u = k.u // 4 AND b.u = k.u)""")
def mentor_project_links(spark, sf):
    """Documents as memberships of users, three each, in 41 projects; each fifth as a
    coauthor; each seventh project is open to those. A user's mentor is derived from the key."""
    k = F.col("doc_id")
    d = t(spark, sf, "documents").select(F.floor(k / 3).alias("user"), F.concat(F.lit("p"), k % 41).alias("pid"), F.when(k % 5 == 0, "coauthor").otherwise("editor").alias("role"), (k % 41 % 7 == 0).alias("open"))
    links = d.select(F.floor(F.col("user") / 4).alias("mentor"), F.col("user").alias("mentee")).distinct().where("mentor <> mentee")
    return A.shared_project_links(links, d)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderpriority = '1-URGENT') OR (o_orderkey % 4 = 0 AND o_orderkey % 3 = 0)""")
def comment_versions(spark, sf):
    """An equal version, or old rows without one."""
    ver = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    legacy = F.col("o_orderkey") % 3 == 0
    o = t(spark, sf, "orders")
    return o.where((F.col("o_orderpriority") == "1-URGENT") | (ver.isNull() & legacy)).select("o_orderkey", "o_custkey")


@query("""WITH v AS (SELECT o_custkey, 'V' || (o_orderkey % 40) // 10 || '.' || (o_orderkey % 40) % 10 AS ver FROM orders), p AS (SELECT o_custkey, regexp_extract(ver, '^V([0-9]+)\\.([0-9])$', 1)::INT * 10 + regexp_extract(ver, '^V([0-9]+)\\.([0-9])$', 2)::INT AS tenths FROM v)
SELECT o_custkey, max(tenths) + 1 AS next_tenths, ((max(tenths) + 1) // 10) || '.' || ((max(tenths) + 1) % 10) AS next_version FROM p GROUP BY o_custkey""")
def next_versions(spark, sf):
    """A14, A15, F24, I54, I55, K16."""
    n = F.col("o_orderkey") % 40
    v = t(spark, sf, "orders").select("o_custkey", B.parse_version(F.concat(F.lit("V"), F.floor(n / 10), F.lit("."), n % 10)).alias("tenths"))
    return A.next_version(v, "o_custkey").withColumn("next_version", B.format_version(F.col("next_tenths")))


@query("""WITH u AS (SELECT DISTINCT l_suppkey, l_linenumber + l_orderkey % 3 AS n FROM lineitem), g AS (SELECT l_suppkey, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS k FROM u WHERE n > 0)
SELECT l_suppkey, coalesce(max(n) FILTER (WHERE n = k), 0) + 1 AS free FROM g GROUP BY l_suppkey""")
def smallest_free_number(spark, sf):
    """F28, F29."""
    u = t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_linenumber") + F.col("l_orderkey") % 3).alias("n"))
    return A.smallest_free(u, "l_suppkey", "n")


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS venue, c_acctbal AS created FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new ' || c_name END AS title, '' AS venue, -1.0::DOUBLE AS created FROM customer WHERE c_custkey % 3 <> 1)
SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(nullif(n.venue, ''), o.venue) AS venue, coalesce(o.created, n.created) AS created, o.id IS NOT NULL AS existed FROM o FULL OUTER JOIN n ON o.id = n.id""")
def evidence_upsert(spark, sf):
    """K01, K05, B12."""
    c, k = t(spark, sf, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("venue"), F.col("c_acctbal").alias("created"))
    new = c.where(k % 3 != 1).select(k.alias("id"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("new "), "c_name")).alias("title"), F.lit("").alias("venue"), F.lit(-1.0).alias("created"))
    return A.upsert_latest(old, new, ["id"], ["title", "venue"], ["created"])


@query("""SELECT l_orderkey, l_linenumber, 'old' AS state FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, 'new' FROM orders WHERE o_orderstatus = 'P'""")
def paper_replacement(spark, sf):
    """K02, K10, B05."""
    old = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("state"))
    new = t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("new").alias("state"))
    return A.replace_partition(old, new, ["l_orderkey"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_decisions(spark, sf):
    """K06, C07, E13."""
    return A.latest_decision(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(o_orderdate) > 24 * 3600000000 THEN 'failed' ELSE o_orderstatus END AS status FROM orders""")
def stale_jobs(spark, sf):
    """J08 as of the latest order."""
    o = t(spark, sf, "orders")
    as_of = o.agg(F.max("o_orderdate").cast("timestamp").alias("as_of"))
    j = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated")).join(F.broadcast(as_of))
    return A.fail_stale(j, ["O", "P"], "updated", F.col("as_of")).select("o_orderkey", "status")


@query("SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 21600 * 1000000::BIGINT")
def search_cache_ttl(spark, sf):
    """J05, J06 as of the latest event."""
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return A.within_ttl(e.join(F.broadcast(e.agg(F.max("ts").alias("as_of")))), "ts", F.col("as_of")).select("event_id")


@query("""SELECT c_custkey, c_custkey % 4 AS base_rev, (c_custkey * 7) % 4 AS rev, c_custkey % 5 <> 0 AND c_custkey % 4 <> (c_custkey * 7) % 4 AS conflict, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> (c_custkey * 7) % 4 THEN (c_custkey * 7) % 4 ELSE (c_custkey * 7) % 4 + 1 END AS new_rev FROM customer WHERE c_custkey % 5 <> 0""")
def optimistic_saves(spark, sf):
    """K17."""
    c, k = t(spark, sf, "customer"), F.col("c_custkey")
    current = c.select("c_custkey", ((k * 7) % 4).alias("rev"))
    writes = c.where(k % 5 != 0).select("c_custkey", (k % 4).alias("base_rev"))
    return A.optimistic_save(current, writes, "c_custkey")


@query("""SELECT user_id, (user_id % 4) AS level, (event_id % 6) AS need, (CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) >= (CASE event_id % 6 WHEN 0 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END) AS allowed, (event_id % 3 = 0 OR event_id % 5 = user_id % 5) AS tenant_ok, event_id FROM events""")
def access_predicates(spark, sf):
    """C04, C05."""
    names = F.array(*[F.lit(x) for x in ("public", "internal", "confidential", "secret", "odd", "")])
    at = lambda c: F.element_at(names, (c + 1).cast("int"))
    level, need = F.col("user_id") % 4, F.col("event_id") % 6
    tag = F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 5).cast("string"))
    return t(spark, sf, "events").select("user_id", level.alias("level"), need.alias("need"), R.access_allowed(at(need), at(level)).alias("allowed"), R.tenant_allowed(tag, (F.col("user_id") % 5).cast("string")).alias("tenant_ok"), "event_id")


@query("""WITH c AS (SELECT c_nationkey AS grp, c_custkey AS claim_id, 1990 + c_custkey % 30 AS year, floor(abs(c_acctbal)) AS confidence FROM customer), w AS (SELECT *, lead(claim_id) OVER v AS o, lead(year) OVER v AS oy, lead(confidence) OVER v AS oc FROM c WINDOW v AS (PARTITION BY grp ORDER BY confidence DESC, claim_id)),
f AS (SELECT grp, claim_id AS subject, CASE WHEN year >= oy THEN 'improves_upon' ELSE 'precursor_of' END AS predicate, o AS object, (confidence + oc) / 2 AS confidence FROM w WHERE o IS NOT NULL)
SELECT grp, subject, predicate, object, confidence FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, subject) AS n FROM f) WHERE n <= 80""")
def chronology_triples(spark, sf):
    """F08."""
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("claim_id"), (1990 + F.col("c_custkey") % 30).alias("year"), F.floor(F.abs("c_acctbal")).cast("double").alias("confidence"))
    return R.chronology_triples(c, "grp").select("grp", "subject", "predicate", "object", "confidence")


@query("SELECT DISTINCT l_suppkey AS pid FROM lineitem")
def distinct_projects(spark, sf):
    """E14."""
    return t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pid")).distinct()


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '85%' WHEN 1 THEN '101' WHEN 2 THEN 'x' ELSE '' || (s_suppkey % 90 + 0.5) END AS v FROM supplier)
SELECT s_suppkey, v, CASE s_suppkey % 4 WHEN 0 THEN 85 WHEN 1 THEN 100 WHEN 3 THEN round_even(s_suppkey % 90 + 0.5, 0)::INT END AS pct FROM s""")
def percent_clamp(spark, sf):
    """Halves to even."""
    k = F.col("s_suppkey")
    v = F.when(k % 4 == 0, "85%").when(k % 4 == 1, "101").when(k % 4 == 2, "x").otherwise((k % 90 + F.lit(0.5)).cast("string"))
    return t(spark, sf, "supplier").select("s_suppkey", v.alias("v"), B.clamp_percent(v).alias("pct"))


_URL = r"""CASE page_id % 9 WHEN 0 THEN 'https://api.crossref.org/works?q=' || page_id WHEN 1 THEN 'https://evildoi.org/' WHEN 2 THEN 'https://doi.org.evil/' WHEN 3 THEN 'HTTPS://User:pw@DOI.org:443/10.1/x' WHEN 4 THEN 'http://doi.org/10.1' WHEN 5 THEN 'https://doi.org@evil.org/' WHEN 6 THEN 'https://export.arxiv.org#a' WHEN 7 THEN 'https://evil.org/?u=https://doi.org/' ELSE url END"""


@query(rf"""WITH p AS (SELECT page_id, {_URL} AS u FROM pages)
SELECT page_id, regexp_extract(lower(u), '^[a-z]+://(?:[^/?#]*@)?([^/?#:@]*)', 1) AS host, lower(u) LIKE 'https://%' AND regexp_extract(lower(u), '^[a-z]+://(?:[^/?#]*@)?([^/?#:@]*)', 1) IN ('api.crossref.org', 'api.openalex.org', 'export.arxiv.org', 'eutils.ncbi.nlm.nih.gov', 'pubmed.ncbi.nlm.nih.gov', 'doi.org') AS allowed FROM p""")
def url_allow(spark, sf):
    """pages' addresses and some that only look like an allowed one."""
    u = t(spark, sf, "pages").select("page_id", F.expr(_URL).alias("u"))
    return u.select("page_id", S.url_host(F.col("u")).alias("host"), S.is_allowed_url(F.col("u")).alias("allowed"))


@query(r"""WITH d AS (SELECT doc_id, squash AS s FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS squash FROM documents)),
f AS (SELECT doc_id, unnest(range(0, greatest(1, (length(s) + 36) // 37))) AS n, s FROM d),
t AS (SELECT doc_id, n, trim(substr(s, n * 37 + 1, 37)) AS x FROM f),
w AS (SELECT *, string_split(x, ' ') AS p FROM t)
SELECT doc_id, n, x = '' OR length(x) < 40 AND (regexp_matches(x, '[=\[\]{}\\|^_]|\bdef\b|[∫∑∏]') OR 2 * len(list_filter(p, lambda v: length(v) <= 2)) >= len(p) OR len(regexp_extract_all(x, '[A-Za-z\x{4e00}-\x{9fff}]')) < 6) AS garbage FROM w""")
def garbage_fragments(spark, sf):
    """Pieces of documents."""
    cut = F.regexp_extract_all(T.squash(F.col("text")), F.lit("(?s).{1,37}"), F.lit(0))
    pieces = t(spark, sf, "documents").select("doc_id", F.posexplode(T.bind(cut, lambda c: F.when(F.size(c) == 0, F.array(F.lit(""))).otherwise(c))).alias("n", "x"))
    return pieces.select("doc_id", F.col("n").cast("long").alias("n"), T.is_garbage_fragment(F.trim("x")).alias("garbage"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents),
c AS (SELECT *, len(regexp_extract_all(s, '[\x{4e00}-\x{9fff}]')) AS zh, len(regexp_extract_all(s, '[A-Za-z]')) AS en, len(regexp_extract_all(s, '\[[0-9,\s]{1,20}\]')) AS cites FROM d),
n AS (SELECT doc_id, left(s, 30 + doc_id % 300) AS t FROM d)
SELECT c.doc_id, length(s) >= 60 AND (zh <= 3 AND en >= 80 OR zh <= 5 AND (cites >= 2 OR regexp_matches(s, '[~_|]{2}|[A-Za-z]{28}'))) AS noisy,
  length(trim(t)) BETWEEN 3 AND 260 AND lower(trim(t)) NOT IN ('untitled', 'unknown', 'n/a') AND NOT regexp_matches(lower(t), '研究背景與動機|context\s*&\s*background|project background') AND len(regexp_extract_all(t, '[。！？!?]')) < 2 AND NOT (length(trim(t)) > 120 AND len(regexp_extract_all(t, '[，,；;]')) >= 8) AS title
FROM c JOIN n USING (doc_id)""")
def summary_and_title_rules(spark, sf):
    """C26 on whole texts, C28 on their beginnings as titles."""
    s = T.squash(F.col("text"))
    head = F.substr(s, F.lit(1), (F.col("doc_id") % 300 + 30).cast("int"))
    return t(spark, sf, "documents").select("doc_id", T.is_noisy_summary(F.col("text")).alias("noisy"), T.is_plausible_title(head).alias("title"))


_ERROR = """CASE event_id % 8 WHEN 0 THEN 'HTTP 429 Quota exceeded: GenerateRequestsPerDay' WHEN 1 THEN 'Connection RESET by peer' WHEN 2 THEN 'connection refused' WHEN 3 THEN 'quota of PerProjectPerModel' WHEN 4 THEN 'daily limit' WHEN 5 THEN 'request failed after ' || event_id WHEN 6 THEN 'service unavailable' ELSE NULL END"""


@query(f"""WITH e AS (SELECT event_id, lower(coalesce({_ERROR}, '')) AS x FROM events)
SELECT event_id, regexp_matches(x, 'timeout|timed out|request failed after|503|429|resource_exhausted|quota throttle|rate limit|connection reset') AS retryable, regexp_matches(x, 'quota|429') AND regexp_matches(x, 'perday|per day|daily|perprojectpermodel') AS daily FROM e""")
def error_rules(spark, sf):
    """C36, C47."""
    e = t(spark, sf, "events").select("event_id", F.expr(_ERROR).alias("x"))
    return e.select("event_id", T.is_retryable(F.col("x")).alias("retryable"), T.is_daily_quota(F.col("x")).alias("daily"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 120 THEN s ELSE rtrim(substr(s, 1, 120)) || '...' END AS clipped, sha1(lower(s)) AS query_key, CASE WHEN length(s) <= 1200 THEN s ELSE substr(s, 1, 380) || substr(s, length(s) // 2, 380) || substr(s, length(s) - 379, 380) END AS sampled FROM d""")
def clip_and_sample(spark, sf):
    """I15, I61, F30."""
    s = T.squash(F.col("text"))
    d = t(spark, sf, "documents").select("doc_id", s.alias("s"))
    n = F.length("s")
    mid = F.concat(F.substr("s", F.lit(1), F.lit(380)), F.substr("s", F.floor(n / 2).cast("int"), F.lit(380)), F.substr("s", n - 379, F.lit(380)))
    return d.select("doc_id", T.clip(F.col("s"), 120).alias("clipped"), T.query_key(F.col("s")).alias("query_key"), F.when(n <= 1200, F.col("s")).otherwise(mid).alias("sampled"))


# Sequential and algorithmic rules -----------------------------------------------------------------

@query()
def html_text(spark, sf):
    """I57, B11 in part."""
    return t(spark, sf, "pages").select("page_id", U.html_to_text(F.col("html")).alias("text"))


@query()
def ocr_wer(spark, sf):
    """Whole turns."""
    return readings(spark, sf).select("conv_id", "turn", F.round(U.word_error_rate(F.col("read"), F.col("text")), 6).alias("wer"))


@query()
def title_similarity(spark, sf):
    """Candidates of one block compared with the first of it."""
    c = prepared(spark, sf)
    first = c.groupBy("venue").agg(F.min_by("title", "pos").alias("t0"))
    j = c.join(first, "venue").select("pos", F.round(U.title_similarity(F.col("title"), F.col("t0")), 6).alias("ratio"))
    return j.withColumn("same", F.col("ratio") >= 0.82)


@query()
def resolved_references(spark, sf):
    """Every page cited with a word of its title left out or a later year, looked for among
    all pages of its host; a DOI among all pages."""
    k = F.col("page_id")
    p = t(spark, sf, "pages").select(k, S.url_host(F.col("url")).alias("venue"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), (1990 + k % 30).cast("int").alias("year"), F.when(k % 5 == 0, F.concat(F.lit("10.1234/p."), k)).otherwise("").alias("doi"), F.lit("page").alias("source"))
    title = F.when(k % 3 == 0, F.regexp_replace("title", r"^\S+ ", "")).when(k % 7 == 0, "").otherwise(F.col("title"))
    refs = p.select(k.alias("ref"), "venue", title.alias("title"), (F.col("year") + k % 4).cast("int").alias("year"), F.when(k % 2 == 0, F.col("doi")).otherwise("").alias("doi"))
    return A.resolve_references(refs, p.select(k.alias("paper"), "venue", "title", "year", "doi", "source"), ["venue"])


@query()
def densest_snippet(spark, sf):
    """F14."""
    hits = R.best(R.score_evidence(evidence(spark, sf), ASKED), 20, "segment_id")
    words = F.create_map(*[x for i, q in ASKED for x in (F.lit(i), F.array(*[F.lit(w) for w in q.lower().split()]))])[F.col("query_id")]
    return hits.select("query_id", "rank", "segment_id", U.snippet(600)(F.col("text"), words).alias("snippet"))


@query()
def sentence_packing(spark, sf):
    """F15, F16."""
    pieces = t(spark, sf, "documents").select("doc_id", F.posexplode(U.split_long_text(600)(F.col("text"))).alias("n", "piece"))
    return P.request_batches(pieces, "doc_id", "n", "piece").select("doc_id", "n", F.length("piece").alias("chars"), "batch")


@query()
def hash_embedding(spark, sf):
    """I10, L01."""
    return t(spark, sf, "documents").select("doc_id", U.hash_embedding(32)(F.col("text")).alias("vector"))


@query()
def protected_spans(spark, sf):
    """I65, I66."""
    d = t(spark, sf, "documents").select("doc_id", "text", U.protect_spans(F.col("text")).alias("p"))
    back = F.aggregate(F.map_entries("p.spans"), F.col("p.text"), lambda a, e: F.replace(a, e["key"], e["value"]))
    return d.select("doc_id", F.size(F.col("p.spans")).alias("spans"), (back == F.col("text")).alias("restored"))


@query()
def merged_bodies(spark, sf):
    """F06, C21."""
    b = blocks(spark, sf).select("doc_id", "pos", "type", "text", F.lit(False).alias("noise"), F.array("x0", "y0", F.col("x0") + 120, F.col("y0") + 60).alias("bbox"))
    return P.merge_bodies(b, "doc_id", "pos").select("doc_id", "pos", "type", F.length("text").alias("chars"), "bbox")


@query()
def section_keys(spark, sf):
    """K18."""
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("n"), F.concat(F.lit("k"), F.col("o_orderkey") % 3, F.when(F.col("o_orderkey") % 4 == 0, " bad").otherwise("")).alias("section_key"))
    return P.unique_keys(o, "project", "n")


@query()
def affinity_chunks(spark, sf):
    """F17."""
    b = blocks(spark, sf).select("doc_id", "pos", F.when(F.col("pos") % 9 < 6, F.floor(F.col("pos") / 9).cast("string")).otherwise("").alias("affinity"))
    return P.affinity_chunks(b, "doc_id", "pos", 8)


@query()
def stub_replies(spark, sf):
    """A fixed model in the place of a hosted one."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", U.stub_model(F.concat(F.lit("User: "), "text")).alias("reply"))
    return c.select("conv_id", "turn", U.parse_json_reply(F.col("reply")).alias("reply"))


# States -------------------------------------------------------------------------------------------

_STATES = ["timeout", "flowb_broken", "queued", "completed", "", "Running"]


@query("""WITH e AS (SELECT event_id, ['timeout', 'flowb_broken', 'queued', 'completed', '', 'Running'][event_id % 6 + 1] AS s FROM events)
SELECT event_id, CASE s WHEN 'timeout' THEN 'timeout' WHEN 'flowb_broken' THEN 'translation_incomplete' WHEN '' THEN NULL ELSE 'failed' END AS error, CASE lower(s) WHEN 'queued' THEN 'waiting' WHEN 'completed' THEN 'ready' WHEN 'running' THEN 'processing' ELSE 'waiting' END AS progress,
CASE event_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 60 WHEN 2 THEN 100 ELSE 0 END AS pct FROM e""")
def states(spark, sf):
    """C31, C32, I73, I74."""
    i = F.col("event_id")
    s = F.element_at(F.array(*[F.lit(x) for x in _STATES]), (i % 6 + 1).cast("int"))
    done = F.when(i % 4 == 0, F.array(F.lit("upload"))).when(i % 4 == 1, F.array(F.lit("upload"), F.lit("arbitrate"))).when(i % 4 == 2, F.array(F.lit("ready"))).otherwise(F.array().cast("array<string>"))
    return t(spark, sf, "events").select("event_id", S.classify_error(s).alias("error"), S.progress_state(s).alias("progress"), S.progress_percent(S.milestones(done)).alias("pct"))


@query(r"""WITH b AS (SELECT l_orderkey, l_linenumber, 'p' || l_linenumber || '_figure_' || l_orderkey AS seq FROM lineitem)
SELECT l_orderkey, l_linenumber, regexp_extract(seq, '^p([0-9]+)_', 1)::INT AS page, regexp_extract(seq, '_([0-9]+)$', 1)::INT AS ord, CASE WHEN l_linenumber % 3 = 0 THEN 'cloud' WHEN l_orderkey > 20000 THEN 'cloud' WHEN l_linenumber % 2 = 0 THEN 'local' ELSE 'cloud' END AS engine FROM b""")
def media_keys(spark, sf):
    """G10, G11, I68, L09."""
    l = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_linenumber", F.lit("_figure_"), "l_orderkey").alias("seq"))
    parts = S.sequence_parts(F.col("seq"))
    engine = S.translation_engine(F.col("l_orderkey"), F.when(F.col("l_linenumber") % 3 == 0, "study").otherwise("batch"), F.col("l_linenumber") % 2 == 0)
    return l.select("l_orderkey", "l_linenumber", parts["page"].alias("page"), parts["order"].alias("ord"), engine.alias("engine"))


@query("""SELECT user_id, count(*) AS artifacts, count(*) FILTER (WHERE event_type = 'click') AS clicks, CASE WHEN count(*) FILTER (WHERE event_type = 'click') = 0 THEN 'empty' WHEN count(*) FILTER (WHERE event_type = 'click') >= 5 THEN 'ready' ELSE 'started' END AS status FROM events GROUP BY user_id""")
def workflow_snapshot(spark, sf):
    """E10, D11 in part: states from counts of artifacts."""
    clicks = F.count_if(F.col("event_type") == "click")
    return t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("artifacts"), clicks.alias("clicks"), F.when(clicks == 0, "empty").when(clicks >= 5, "ready").otherwise("started").alias("status"))


@query("""WITH b AS (SELECT p_brand, min(p_partkey) AS base FROM part GROUP BY p_brand) SELECT p.p_partkey AS target, b.base AS baseline FROM part p JOIN b USING (p_brand) WHERE p.p_partkey <> b.base""")
def baseline_pairs(spark, sf):
    """The first paper of a project against each other one."""
    p = t(spark, sf, "part").select("p_brand", "p_partkey")
    base = p.groupBy("p_brand").agg(F.min("p_partkey").alias("baseline"))
    return p.join(base, "p_brand").where("p_partkey <> baseline").select(F.col("p_partkey").alias("target"), "baseline")


@query("""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS page, coalesce(a.q, b.q) AS value, a.q IS NOT NULL AS fixed FROM (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a FULL OUTER JOIN (SELECT l_orderkey, min(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b ON a.l_orderkey = b.l_orderkey""")
def raw_fixed_merge(spark, sf):
    """The corrected page, else the raw one."""
    l = t(spark, sf, "lineitem")
    a = l.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("fq"))
    b = l.where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.min("l_quantity").alias("rq"))
    return a.join(b, "l_orderkey", "full_outer").select(F.col("l_orderkey").alias("page"), F.coalesce("fq", "rq").alias("value"), F.col("fq").isNotNull().alias("fixed"))


@query("""SELECT n_regionkey AS project, string_agg(n_name, ', ' ORDER BY n_name) AS sections FROM nation WHERE n_regionkey % 2 = 1 OR n_nationkey % 3 = 0 GROUP BY n_regionkey""")
def visible_sections(spark, sf):
    """Section-scoped roles see what they are assigned; others all."""
    n = t(spark, sf, "nation").where("n_regionkey % 2 = 1 OR n_nationkey % 3 = 0")
    return n.groupBy(F.col("n_regionkey").alias("project")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("sections"))


from corvane.plans import chain, cleaning, library, reading, repairs, sections  # noqa: E402,F401  their queries register themselves
