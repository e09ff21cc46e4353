"""Evidence retrieval: scoring, gates, quotas and token budgets over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

# Weight of each kind of evidence.
SOURCE_PRIORITY = {"paper_segment": 1.0, "study_note": 0.9, "paq_note": 0.7, "manuscript_note": 0.8, "context_chain_item": 0.6}
ACCESS_LEVELS = {"public": 0, "internal": 1, "confidential": 2, "secret": 3}


def lexical_score(query: Column, words: Column, priority: Column | float = 1.0, updated: Column | bool = True) -> Column:
    """Coverage of distinct query tokens and a saturated term frequency, six decimals."""
    q = F.array_distinct(query)
    overlap = F.size(F.array_intersect(q, words))
    tf = F.size(F.filter(words, lambda t: F.array_contains(q, t)))
    return score_of_counts(overlap, tf, F.size(q), F.size(words), priority, updated)


def score_of_counts(overlap: Column, tf: Column, asked: Column, length: Column, priority: Column | float = 1.0, updated: Column | bool = True) -> Column:
    """The score of a text of that many words, overlap distinct ones of the asked, tf in all."""
    coverage = overlap / F.greatest(F.lit(1), asked)
    saturated = tf / (tf + 1.5 + 0.25 * F.greatest(F.lit(0), length - 80) / 80)
    recency = F.when(F.lit(updated) if isinstance(updated, bool) else updated, 0.02).otherwise(0.0)
    return F.when(overlap > 0, F.round((0.58 * coverage + 0.37 * saturated + recency) * priority, 6)).otherwise(0.0)


def context_score(query: Column, words: Column, priority: float = 0.5) -> Column:
    """Coverage of the query and of the text, six decimals."""
    q, w = F.array_distinct(query), F.array_distinct(words)
    overlap = F.size(F.array_intersect(q, w))
    return F.when(overlap > 0, F.round((0.72 * overlap / F.size(q) + 0.28 * overlap / F.size(w)) * priority, 6)).otherwise(0.0)


def named_match(query: Column, *names: Column) -> Column:
    """Whether an identifier of four characters or more lies in the query, or the query in it."""
    q = T.compact_identifier(query)
    variants = F.array_distinct(F.concat(*[T.identifier_variants(n) for n in names]))
    return (q != "") & F.exists(variants, lambda a: q.contains(a) | a.contains(q))


def score_evidence(evidence: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """Hits of each (id, text) query in evidence(paper_id, source_id, segment_id, title, text,
    source_type, paper_title), without limit; hits of score 0 are dropped (G01).

    The queries' few distinct words are counted in each row's words once, and each query's score
    is a sum of these counts, so nothing is joined or shuffled; rows leave as (row, query) only
    where the score is above 0."""
    spark = evidence.sparkSession
    asked = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("id"), F.array_distinct(T.tokens(F.lit(q))).alias("q"), T.compact_identifier(F.lit(q)).alias("c")) for i, q in queries]))).collect()
    terms = sorted({w for r in asked for w in r.q})
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])[F.col("source_type")], F.lit(0.5))
    body = F.concat_ws(" ", "paper_id", "source_id", "paper_id", "paper_title", "title", "text")
    names = F.array_distinct(F.concat(T.identifier_variants(F.col("paper_id")), T.identifier_variants(F.col("paper_title"))))
    cores = spark.sparkContext.defaultParallelism
    if evidence.rdd.getNumPartitions() < cores:  # few splits: a small table leaves cores idle otherwise
        evidence = evidence.repartition(cores)
    rows = evidence.where(~T.is_non_evidence_title(F.col("title"))).withColumn("words", T.tokens(body)).withColumn("names", names).withColumn("priority", kind)
    rows = rows.withColumn("counts", F.array(*[F.size("words") - F.size(F.array_remove("words", w)) for w in terms]) if terms else F.array().cast("array<int>"))

    def hit(r) -> Column:
        own = [F.col("counts")[terms.index(w)] for w in r.q]
        overlap, tf = (sum(x, F.lit(0)) for x in ([F.when(c > 0, 1).otherwise(0) for c in own], own))
        named = F.exists("names", lambda a: F.lit(r.c).contains(a) | a.contains(r.c)) if r.c else F.lit(False)
        return F.struct(F.lit(r.id).alias("query_id"), named.alias("named"), score_of_counts(overlap, tf, F.lit(len(r.q)), F.size("words"), F.col("priority")).alias("lexical"))

    scored = F.transform(F.array(*[hit(r) for r in asked]), lambda h: F.struct(h["query_id"].alias("query_id"), h["named"].alias("named"), F.round(h["lexical"] + F.when(h["named"], 1.0).otherwise(0.0), 6).alias("score")))
    hits = rows.withColumn("hit", F.explode(F.filter(scored, lambda h: h["score"] > 0)))
    return hits.select("hit.query_id", "paper_id", "source_id", "segment_id", "title", "text", F.col("hit.named").alias("named_match"), "hit.score", T.estimate_quarter(F.col("text")).alias("estimated_tokens"))


def best(hits: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k best hits of each query: score, then source_id, then the tie columns."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source_id", *tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(k, 50)))


def per_paper_quota(hits: DataFrame, k: int, least: int = 3) -> DataFrame:
    """At most k hits a query, shared between papers.

    Two named papers or more take turns; with one, score alone decides; with none, the k // least
    best papers get least places each. What is left goes by score."""
    by_score = [F.col("score").desc(), F.col("source_id"), F.col("segment_id")]
    q, paper = Window.partitionBy("query_id"), Window.partitionBy("query_id", "paper_id")
    # No paper gives more than k rows, so its best k are all that need be ranked.
    h = hits.withColumn("of_paper", F.row_number().over(paper.orderBy(*by_score))).where(F.col("of_paper") <= k)
    h = h.withColumn("n", F.row_number().over(q.orderBy(*by_score)))
    h = h.withColumn("first", F.min("n").over(paper)).withColumn("named", F.max(F.col("named_match").cast("int")).over(paper))
    h = h.withColumn("paper_rank", F.dense_rank().over(q.orderBy("first"))).withColumn("papers", F.max("paper_rank").over(q)).withColumn("rows", F.count(F.lit(1)).over(q))
    h = h.withColumn("n_named", F.sum(F.when((F.col("of_paper") == 1) & (F.col("named") == 1), 1).otherwise(0)).over(q))
    turns = (F.col("n_named") >= 2) & (F.col("named") == 1)
    floor = (F.col("n_named") == 0) & (F.col("paper_rank") <= max(1, k // least)) & (F.col("of_paper") <= least)
    plain = (F.col("papers") <= 1) | (F.col("rows") <= k) | (F.col("n_named") == 1)
    tier = F.when(plain, 1).when(turns | floor, 0).otherwise(1)
    turn = F.when(plain, 0).when(turns, F.col("of_paper")).when(floor, F.col("paper_rank")).otherwise(0)
    inner = F.when(plain, 0).when(turns, F.col("first")).when(floor, F.col("of_paper")).otherwise(0)
    picked = h.withColumn("pick", F.row_number().over(q.orderBy(tier, turn, inner, "n"))).where(F.col("pick") <= k)
    return picked.withColumn("rank", F.row_number().over(q.orderBy(*by_score))).select("query_id", "rank", "paper_id", "source_id", "segment_id", "score", "named_match", "estimated_tokens", "title", "text")


def screening_gate(hits: DataFrame, screening: DataFrame, scope: str = "all") -> DataFrame:
    """Drops excluded papers; in scope writing keeps included ones only. Other kinds of evidence
    than papers pass. screening: (paper_id, status) (C03, E20)."""
    is_paper = F.col("source_type") == "paper_segment"
    out = screening.where("status = 'excluded'").select(F.col("paper_id").alias("x")).distinct()
    gated = hits.where(is_paper).join(out, F.col("paper_id") == F.col("x"), "left_anti")
    if scope == "writing":
        included = screening.where("status = 'included'").select(F.col("paper_id").alias("x")).distinct()
        gated = gated.join(included, F.col("paper_id") == F.col("x"), "left_semi")
    return gated.unionByName(hits.where(~is_paper | F.col("source_type").isNull()))


def citation_suggestions(hits: DataFrame, k: int = 5) -> DataFrame:
    """Hits grouped by paper: summed score, first three distinct snippets, segments."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "title", "snippet", "segment_id")))
    g = hits.where("paper_id <> ''").groupBy("query_id", "paper_id").agg(F.round(F.sum("score"), 6).alias("score"), ordered.alias("rows"))
    g = g.withColumn("title", F.col("rows")[0]["title"])
    g = g.withColumn("snippets", F.slice(F.array_distinct(F.filter(F.col("rows.snippet"), lambda s: s != "")), 1, 3)).withColumn("segment_ids", F.array_distinct(F.col("rows.segment_id")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "paper_id")
    return g.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rows")


def pack_budget(items: DataFrame, budget: int, group: list[str], order: str, text: str = "snippet") -> DataFrame:
    """Items in order until the token budget is spent; the one that overflows is cut to what is
    left and kept (F09). Tokens are length // 4, at least 1."""
    cost = T.estimate_quarter(F.col(text))
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("before")
    out = items.withColumn("before", before).where(F.col("before") < budget)
    cut = F.when(cost <= left, F.col(text)).otherwise(F.rtrim(F.substr(F.col(text), F.lit(1), (4 * left).cast("int"))))
    return out.withColumn("packed", cut).withColumn("packed_tokens", F.when(cost <= left, cost).otherwise(left)).drop("before")


def pack_newest(items: DataFrame, budget: int, group: list[str], order: str, text: str = "text") -> DataFrame:
    """The newest items that fit together, stopping at the first that doesn't."""
    back = Window.partitionBy(*group).orderBy(F.col(order).desc())
    total = F.sum(T.estimate_cjk(F.col(text))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("used", total).where(F.col("used") <= budget)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token lists as term counts; 0 where one is empty."""
    def count(words: Column, t: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == t))

    def norm(words: Column) -> Column:
        return F.sqrt(F.aggregate(F.array_distinct(words), F.lit(0).cast("double"), lambda s, t: s + count(words, t) * count(words, t)))

    dot = F.aggregate(F.array_intersect(a, b), F.lit(0).cast("double"), lambda s, t: s + count(a, t) * count(b, t))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def dense_cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0).cast("double"), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tenant_allowed(record: Column, requester: Column) -> Column:
    """No tag is visible to all; a tag only to its own tenant."""
    r = F.trim(F.coalesce(record, F.lit("")))
    return (r == "") | (r == F.trim(F.coalesce(requester, F.lit(""))))


def access_allowed(record: Column, requester: Column) -> Column:
    """Requester's level at least the record's; an unknown level counts as internal."""
    levels = F.create_map(*[F.lit(x) for kv in ACCESS_LEVELS.items() for x in kv])
    rank = lambda c: F.coalesce(levels[F.lower(F.trim(c))], F.lit(1))
    return rank(requester) >= rank(record)


def chronology_triples(claims: DataFrame, group: str, most: int = 80) -> DataFrame:
    """Each claim and the next by confidence: the later improves upon the earlier.
    claims: (group, claim_id, year, confidence)."""
    w = Window.partitionBy(group).orderBy(F.col("confidence").desc(), "claim_id")
    nxt = lambda c: F.lead(c).over(w)
    t = claims.withColumn("o", nxt("claim_id")).withColumn("oy", nxt("year")).withColumn("oc", nxt("confidence")).where("o IS NOT NULL")
    t = t.withColumn("predicate", F.when(F.col("year") >= F.col("oy"), "improves_upon").otherwise("precursor_of"))
    t = t.select(group, F.col("claim_id").alias("subject"), "predicate", F.col("o").alias("object"), F.round((F.col("confidence") + F.col("oc")) / 2, 4).alias("confidence"))
    return t.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(F.col("confidence").desc(), "subject"))).where(F.col("n") <= most).drop("n")


def budget_plan(instruction: Column, query: Column, context: Column, total: int = 4000) -> Column:
    """Shares of 20, 20, 50 and 10 per cent and what is used of them."""
    used = T.estimate_cjk(instruction) + T.estimate_cjk(query) + T.estimate_cjk(context)
    return F.struct(F.lit(total * 20 // 100).alias("instruction"), F.lit(total * 20 // 100).alias("query"), F.lit(total * 50 // 100).alias("context"), F.lit(total * 10 // 100).alias("reserve"), used.alias("used"), (used >= 0.8 * total).alias("near_limit"))
