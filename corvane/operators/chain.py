"""Chains of context: layers of claims, packets and triples of a project, their search, overrides,
and the blocks of a prompt that are built of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import blocks as K
from corvane.functions import text as T
from corvane.functions import udfs as U
from corvane.operators import library as Y
from corvane.operators import retrieval as R

# Shares of a prompt's budget, the heading of an unsaved draft, keys of a context item.
SHARES = {"current_section": 0.30, "chat_history": 0.26, "other_sections": 0.20, "review": 0.10, "paq": 0.06, "literature": 0.08}
UNSAVED = "[作者目前未存草稿（覆蓋伺服器版本）]"
ITEM_KEYS = "source_type source_id paper_id paper_title segment_id title score estimated_tokens fingerprint snippet".split()


def _strip(c: Column) -> Column:
    """Without white space of any kind at both ends; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _json_value(c: Column) -> Column:
    """One value as JSON; null is null."""
    raw = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(raw, F.lit(6), F.length(raw) - 6)


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-1 of the fields' JSON, keys in order, a blank behind each colon and comma."""
    parts = [F.concat(F.lit(f'"{k}": '), _json_value(fields[k])) for k in sorted(fields)]
    return F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).cast("binary"))


def cache_key(task: Column, prompt: Column, provider: Column, model: Column, params: Column, context: Column) -> Column:
    """SHA-256 of a call's compact JSON, keys in order; params is a map of strings, null as an
    empty one (I14)."""
    p = F.coalesce(params, F.create_map().cast("map<string,string>"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(p)))
    fields = {"task_type": task, "prompt": prompt, "provider": provider, "model": model, "context_fingerprint": context}
    parts = {k: _json_value(F.coalesce(c, F.lit(""))) for k, c in fields.items()} | {"params": F.to_json(ordered, {"ignoreNullFields": "false"})}
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]), F.lit("}")), 256)


def _visible(queries: DataFrame, rows: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best rows of each query's own project that its tenant and level may see."""
    r = rows.select(F.col("pid").alias("r_pid"), F.col("tenant_id").alias("r_tenant"), F.col("access_level").alias("r_level"), *[c for c in rows.columns if c not in ("pid", "tenant_id", "access_level")])
    may = R.tenant_allowed(F.col("r_tenant"), F.col("tenant_id")) & R.access_allowed(F.col("r_level"), F.col("access_level"))
    hits = queries.join(r, (F.col("pid") == F.col("r_pid")) & may).withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, min(k, 20)))


def hybrid_topk(queries: DataFrame, packets: DataFrame, triples: DataFrame, k_packets: int = 5, k_triples: int = 5) -> DataFrame:
    """For each query (query_id, pid, query, tenant_id, access_level) its best packets (pid, pos,
    tenant_id, access_level, text) by cosine and its best triples (pid, pos, tenant_id,
    access_level, subject, predicate, object, confidence) by cosine and confidence, as two lists
    (G03). At most 20 each; ties go to the smaller pos. A query without a visible row has empty
    lists. Rows meet the queries of their own project only; each list is cut before it is gathered."""
    q = queries.withColumn("q", T.chain_tokens(F.col("query")))
    p = packets.select("pid", "pos", "tenant_id", "access_level", "text", T.chain_tokens(F.col("text")).alias("w"))
    said = F.trim(F.concat_ws(" ", "subject", "predicate", "object"))
    t = triples.select("pid", "pos", "tenant_id", "access_level", "subject", "predicate", "object", "confidence", T.chain_tokens(said).alias("w"))
    cosine = R.sparse_cosine(F.col("q"), F.col("w"))
    best = _visible(q, p, F.round(cosine, 6), k_packets).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", "score"))).alias("vector_facts"))
    linked = _visible(q, t, K.triple_score(cosine, F.col("confidence")), k_triples)
    linked = linked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), "score"))).alias("kg_relations"))
    out = queries.join(best, "query_id", "left").join(linked, "query_id", "left")
    for name, kind in (("vector_facts", "array<struct<n:int,text:string,score:double>>"), ("kg_relations", "array<struct<n:int,s:string,p:string,o:string,score:double>>")):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def format_context(brief: Column, facts: Column, relations: Column) -> Column:
    """Brief (500 characters), five facts (220 each) and the full ones of the first five relations
    (s, p, o), as the blocks of a prompt (I75)."""
    one = _strip
    said = F.slice(F.filter(F.transform(facts, one), lambda f: f != ""), 1, 5)
    full = F.filter(F.slice(relations, 1, 5), lambda r: (one(r["s"]) != "") & (one(r["p"]) != "") & (one(r["o"]) != ""))
    lines = F.transform(full, lambda r: F.concat(F.lit("- "), one(r["s"]), F.lit(" --"), one(r["p"]), F.lit("--> "), one(r["o"])))
    return _strip(F.concat_ws(
        "\n\n",
        F.when(one(brief) != "", F.concat(F.lit("[Project Brief]\n"), F.substring(one(brief), 1, 500))),
        F.when(F.size(said) > 0, F.concat(F.lit("[Vector Facts]\n"), F.array_join(F.transform(said, lambda f: F.concat(F.lit("- "), F.substring(f, 1, 220))), "\n"))),
        F.when(F.size(lines) > 0, F.concat(F.lit("[KG Relations]\n"), F.array_join(lines, "\n")))))


def usable_packets(packets: DataFrame, layers: DataFrame) -> DataFrame:
    """Packets (pid, layer, ...) without those of stale layers L2, L3 and KG; L1 always stays, as
    it holds what people corrected (K09). layers: (pid, layer, stale)."""
    gone = layers.where(F.col("stale") & F.col("layer").isin("L2", "L3", "KG")).select("pid", "layer").distinct()
    return packets.join(gone, ["pid", "layer"], "left_anti")


def override_claims(claims: DataFrame, patches: DataFrame) -> DataFrame:
    """Claims (pid, claim_id, tenant_id, access_level, text columns) with patches (pid, claim_id,
    seq, patch map, tenant_id, access_level) laid over them, and a row for each patch that names no
    claim (K08). status: kept, patched, not_found, tenant_mismatch or access_denied. Of several
    patches to a claim the last seq counts. Only string columns that claims have are patched."""
    keys = ["pid", "claim_id"]
    last = patches.groupBy(*keys).agg(F.max_by(F.struct("patch", F.col("tenant_id").alias("tenant"), F.col("access_level").alias("level")), "seq").alias("new"))
    joined = claims.withColumn("found", F.lit(True)).join(last, keys, "full")
    status = F.when(F.col("new").isNull(), "kept").when(F.col("found").isNull(), "not_found").when(~R.tenant_allowed(F.col("tenant_id"), F.col("new.tenant")), "tenant_mismatch")
    status = status.when(~R.access_allowed(F.col("access_level"), F.col("new.level")), "access_denied").otherwise("patched")
    out = joined.withColumn("status", status)
    text = [c for c, kind in claims.dtypes if kind == "string" and c not in keys]
    laid = lambda c: F.when((F.col("status") == "patched") & F.map_contains_key(F.col("new.patch"), F.lit(c)), F.col("new.patch")[c]).otherwise(F.col(c)).alias(c)
    return out.select(*[laid(c) if c in text else F.col(c) for c in claims.columns], "status")


def layers_after(layers: DataFrame, overridden: DataFrame) -> DataFrame:
    """Layers (pid, layer, version, stale) after overrides: in a project with a patched claim L1
    takes the next version and is fresh, all others are stale (K08)."""
    changed = overridden.where("status = 'patched'").select("pid").distinct().withColumn("changed", F.lit(True))
    top = Window.partitionBy("pid")
    out = layers.join(changed, "pid", "left").withColumn("next", F.max("version").over(top) + 1)
    is_l1 = F.col("layer") == "L1"
    return out.select("pid", "layer", F.when(F.col("changed") & is_l1, F.col("next")).otherwise(F.col("version")).alias("version"), F.when(F.col("changed"), ~is_l1).otherwise(F.col("stale")).alias("stale"))


def render_pack(items: DataFrame, group: str, order: str) -> DataFrame:
    """One text for each context pack: its tokens, fingerprint and items as numbered lines of
    key: value (B14). Nulls are written as nothing, in score and estimated_tokens as 0."""
    value = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("0" if k in ("score", "estimated_tokens") else ""))
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), value(k)) for k in ITEM_KEYS])
    g = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("a"))
    body = F.array_join(F.transform("a", lambda x, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("]\n"), x["t"], F.lit("\n"))), "\n")
    head = F.concat(F.lit("[Injected Context Pack]\ntotal_estimated_tokens: "), "total_estimated_tokens", F.lit("\ncontext_pack_fingerprint: "), "context_pack_fingerprint", F.lit("\n\n"))
    return g.join(Y.pack_metadata(items, group, order), group).select(group, _strip(F.concat(head, body)).alias("block"))


def comparable(text: Column) -> Column:
    """A text without tags, blanks squeezed, lower-cased: for comparison only."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " ")))


def pack_sections(sections: DataFrame, group: str, budget: int) -> DataFrame:
    """The other sections of a bundle (group, pos, text) by pos: each may take half of what is left
    of their share of the budget, and a last token; those that get nothing are left out (F12).
    A group is one manuscript's sections."""
    share = int(budget * SHARES["other_sections"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = share, []
        for key, pos, text in rows.sort_values("pos").itertuples(index=False):
            cut = U.cut_to_budget(text, left // 2 or left) if left > 0 else ""
            if cut:
                cost = U.estimate(cut)
                left -= cost
                out.append((key, pos, cut, cost))
        return pd.DataFrame(out, columns=[group, "pos", "packed", "tokens"])

    kinds = dict(sections.dtypes)
    return sections.select(group, "pos", "text").groupBy(group).applyInPandas(pack, f"`{group}` {kinds[group]}, pos {kinds['pos']}, packed string, tokens long")


def pack_prompt(prompts: DataFrame, budget: int) -> DataFrame:
    """Adds packed and remaining to prompts (draft, saved, bundle): the unsaved draft comes first,
    marked where it differs from the saved section, then the bundle's other blocks (array of
    (tier, text)) without that section; each is cut to what is left, and 0 may remain (F13)."""
    draft, saved = _strip(F.col("draft")), F.coalesce("saved", F.lit(""))
    replaces = (draft != "") & (saved != "")
    shown = F.when(replaces & (comparable(draft) != comparable(saved)), F.concat(F.lit(UNSAVED + "\n"), draft)).otherwise(draft)
    blocks = F.coalesce("bundle", F.array().cast("array<struct<tier:string,text:string>>"))
    kept = F.when(replaces, F.filter(blocks, lambda b: b["tier"] != "current_section")).otherwise(blocks)
    p = prompts.withColumn("c_draft", U.truncate_to_budget(shown, F.lit(budget)))
    p = p.withColumn("c_left", budget - T.estimate_cjk(F.col("c_draft")))
    p = p.withColumn("c_rest", U.truncate_to_budget(_strip(F.array_join(kept["text"], "\n\n")), F.col("c_left")))
    both = F.concat_ws("\n\n", *[F.nullif(F.col(c), F.lit("")) for c in ("c_draft", "c_rest")])
    left = F.greatest(F.lit(0).cast("long"), F.col("c_left") - T.estimate_cjk(F.col("c_rest")))
    return p.withColumn("packed", both).withColumn("remaining", left).drop("c_draft", "c_left", "c_rest")
