"""Layers of context chains under one version, and the ledger of what changed them.

A batch of events of many projects is one commit: refreshes replace a project's layers, overrides
correct claims. Nothing loops over projects or events but the patches of one claim, which fold in
their order. Committing two batches one after another gives what one batch of both gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import retrieval as R
from corvane.operators.chain import _json_value, _strip

# Packets of L2, triples of KG, entries of the ledger, the brief of nothing.
MOST_PACKETS, MOST_TRIPLES, MOST_ENTRIES = 8, 80, 500
NO_BRIEF = "No high-confidence literature summary available."
LAYERS = ("L1", "L2", "L3", "KG")
EVENT = "pid string, seq long, ts long, kind string, topic string, reasoning string, papers array<struct<title:string,year:int,source:string,doi:string,url:string,confidence:double>>, tenant_id string, access_level string, claim_id string, patch map<string,string>, editor string"
STATE = {
    "claims": "pid string, pos int, claim_id string, fields map<string,string>",
    "packets": "pid string, pos int, claim_id string, text string, tenant_id string, access_level string",
    "briefs": "pid string, brief string, tenant_id string, access_level string",
    "triples": "pid string, pos int, subject string, predicate string, object string, confidence double, tenant_id string, access_level string",
    "layers": "pid string, layer string, version long, stale boolean",
    "ledger": "pid string, version long, event string, ts long, topic string, claim_id string, editor string, claims_count long, truncated_count long, before string, after string, tenant_id string",
}


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], kind) for name, kind in STATE.items()}


def claim_fingerprint(fields: Column) -> Column:
    """SHA-1 of a claim's JSON, keys in order, a blank behind each colon and comma."""
    parts = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(_json_value(e["key"]), F.lit(": "), _json_value(e["value"])))
    return F.sha1(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")).cast("binary"))


def _refreshed(events: DataFrame) -> DataFrame:
    """Claims of each refresh: pid, epoch, pos, claim_id, the paper's columns and fields."""
    x = events.where("kind = 'refresh'").select("pid", "epoch", "ts", "topic", "tenant_id", F.lower(_strip(F.coalesce("access_level", F.lit("internal")))).alias("access_level"), F.posexplode("papers").alias("at", "p"))
    x = x.select("pid", "epoch", "topic", "tenant_id", "access_level", (F.col("at") + 1).alias("pos"), F.format_string("lit-%d-%d", "ts", F.col("at") + 1).alias("claim_id"), "p.*")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = {"claim_id": F.col("claim_id"), "type": F.lit("paper_recommendation"), **{c: text(c) for c in ("title", "source", "doi", "url", "topic", "access_level")}, "year": F.col("year").cast("string"), "confidence": F.coalesce(F.col("confidence").cast("string"), F.lit("0")), "tenant_id": F.col("tenant_id")}
    return x.withColumn("fields", F.create_map(*[v for k, c in named.items() for v in (F.lit(k), c)]))


def _overridden(claims: DataFrame, events: DataFrame) -> DataFrame:
    """claims (pid, epoch, claim_id, fields, ...) after their patches, with log: seq, status,
    before and after of each."""
    patch = F.struct("seq", "patch", F.col("tenant_id").alias("tenant"), F.col("access_level").alias("level"))
    per = events.where("kind = 'override'").groupBy("pid", "epoch", "claim_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(patch).alias("p")))).alias("todo"))
    kind = "seq long, patch map<string,string>, tenant string, level string"
    none = F.array().cast("array<struct<seq:bigint,status:string,before:string,after:string>>")

    def step(acc: Column, e: Column) -> Column:
        p = F.from_json(e["p"], kind)
        fields, new = acc["fields"], F.coalesce(p["patch"], F.create_map().cast("map<string,string>"))
        status = F.when(~R.tenant_allowed(fields["tenant_id"], p["tenant"]), "tenant_mismatch").when(~R.access_allowed(fields["access_level"], p["level"]), "access_denied").otherwise("patched")
        laid = F.map_from_entries(F.concat(F.filter(F.map_entries(fields), lambda x: ~F.map_contains_key(new, x["key"])), F.map_entries(new)))
        after = F.when(status == "patched", laid).otherwise(fields)
        entry = F.struct(e["seq"].alias("seq"), status.alias("status"), claim_fingerprint(fields).alias("before"), claim_fingerprint(after).alias("after"))
        return F.struct(after.alias("fields"), F.concat(acc["log"], F.array(entry)).alias("log"))

    found = claims.join(per, ["pid", "epoch", "claim_id"], "left")
    start = F.struct(F.col("fields"), none.alias("log"))
    folded = F.when(F.col("todo").isNull(), start).otherwise(F.aggregate("todo", start, step))
    return found.withColumn("f", folded).withColumn("fields", F.col("f.fields")).withColumn("log", F.col("f.log")).drop("f", "todo")


def commit(state: dict[str, DataFrame], events: DataFrame) -> dict[str, DataFrame]:
    """The state after a batch of events (K07, K08), and under rejected the overrides that name no
    claim (not_found) or may not change it (tenant_mismatch, access_denied).

    events: EVENT, seq unique in a project; later batches have larger ones. kind refresh: the
    project's four layers are made anew from papers; override: patch is laid over a claim of the
    newest refresh before it; L1 is fresh and the derived layers are stale from then on. Each event
    that counts takes the next version and a ledger entry, of which the last 500 stay. Null papers:
    none. Projects without events keep their state; no events: the state as it was."""
    before = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("epoch", F.sum(F.when(F.col("kind") == "refresh", 1).otherwise(0)).over(before))
    fresh = _refreshed(e)
    columns = ["pid", "epoch", "pos", "claim_id", "fields"]
    touched = e.select("pid").distinct()
    old = state["claims"].withColumn("epoch", F.lit(0).cast("long")).join(touched, "pid", "left_semi")
    claims = _overridden(old.select(columns).unionByName(fresh.select(*[F.col(c).cast("int") if c == "pos" else F.col(c) for c in columns])), e)
    log = claims.select("pid", F.explode("log").alias("l")).select("pid", "l.*")
    told = e.join(log, ["pid", "seq"], "left").withColumn("status", F.when(F.col("kind") == "refresh", "refreshed").otherwise(F.coalesce("status", F.lit("not_found"))))

    chain = state["layers"].groupBy("pid").agg(F.max("version").alias("was"))
    counts = told.where(F.col("status").isin("refreshed", "patched")).join(chain, "pid", "left")
    counts = counts.withColumn("version", F.coalesce("was", F.lit(0)) + F.row_number().over(Window.partitionBy("pid").orderBy("seq")))
    size = F.greatest(F.lit(0), F.coalesce(F.size("papers"), F.lit(0))).cast("long")
    is_refresh = F.col("kind") == "refresh"
    entries = counts.select("pid", "version", F.when(is_refresh, "task3_context_refresh").otherwise("manual_override").alias("event"), "ts", F.when(is_refresh, F.col("topic")).alias("topic"), F.when(~is_refresh, F.col("claim_id")).alias("claim_id"), F.when(~is_refresh, F.coalesce("editor", F.lit("user"))).alias("editor"),
        F.when(is_refresh, size).alias("claims_count"), F.when(is_refresh, F.greatest(F.lit(0), size - MOST_PACKETS).cast("long")).alias("truncated_count"), "before", "after", "tenant_id")
    newest = Window.partitionBy("pid").orderBy(F.desc("version"))
    ledger = state["ledger"].unionByName(entries).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= MOST_ENTRIES).drop("k")

    last = counts.groupBy("pid").agg(F.max("version").alias("top"), F.max(F.when(is_refresh, F.col("version"))).alias("made"), F.max("epoch").alias("epoch"))
    ends = e.groupBy("pid").agg(F.max("epoch").alias("epoch"))
    now = claims.join(ends, ["pid", "epoch"], "left_semi").select("pid", "pos", "claim_id", "fields")
    made = ends.where("epoch > 0")
    mine = fresh.join(made, ["pid", "epoch"], "left_semi")
    title, year, conf = F.coalesce("title", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.coalesce(F.col("confidence").cast("string"), F.lit("0"))
    packets = mine.where(F.col("pos") <= MOST_PACKETS).select("pid", F.col("pos").cast("int").alias("pos"), "claim_id", F.concat(title, F.lit(" ("), year, F.lit(") ["), F.coalesce("source", F.lit("")), F.lit("] conf="), conf).alias("text"), "tenant_id", "access_level")
    refresh = e.where(is_refresh).join(made, ["pid", "epoch"], "left_semi")
    titles = F.filter(F.transform(F.slice(F.coalesce("papers", F.array().cast(events.schema["papers"].dataType)), 1, 3), lambda p: F.coalesce(p["title"], F.lit(""))), lambda t: t != "")
    brief = F.when(F.coalesce("reasoning", F.lit("")) != "", _strip(F.col("reasoning"))).when(F.size(titles) > 0, F.array_join(titles, "; ")).otherwise(NO_BRIEF)
    briefs = refresh.select("pid", brief.alias("brief"), "tenant_id", F.lower(_strip(F.coalesce("access_level", F.lit("internal")))).alias("access_level"))
    triples = _triples(mine)
    layer = last.select("pid", "top", "made", F.explode(F.array(*map(F.lit, LAYERS))).alias("layer"))
    layer = layer.join(state["layers"].withColumnRenamed("version", "old_version").withColumnRenamed("stale", "old_stale"), ["pid", "layer"], "left")
    is_l1 = F.col("layer") == "L1"
    layer = layer.select("pid", "layer", F.when(is_l1, F.col("top")).otherwise(F.coalesce("made", "old_version", F.lit(0))).alias("version"), (~is_l1 & F.coalesce(F.col("top") > F.col("made"), F.lit(True))).alias("stale"))

    def kept(name: str, gone: DataFrame) -> DataFrame:
        return state[name].join(gone.select("pid"), "pid", "left_anti")

    new = {"claims": kept("claims", touched).unionByName(now), "packets": kept("packets", made).unionByName(packets), "briefs": kept("briefs", made).unionByName(briefs), "triples": kept("triples", made).unionByName(triples), "layers": kept("layers", last).unionByName(layer), "ledger": ledger}
    rejected = told.where(~F.col("status").isin("refreshed", "patched")).select("pid", "seq", "claim_id", "status")
    return {k: d.select([c.split()[0] for c in STATE[k].replace(">", "").split(", ")]) for k, d in new.items()} | {"rejected": rejected}


def _triples(claims: DataFrame) -> DataFrame:
    """Topic, source and chronology of each claim by confidence, the first 80 of a project."""
    by = Window.partitionBy("pid").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "pos")
    c = claims.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("conf", F.coalesce("confidence", F.lit(0.0))).withColumn("rank", F.row_number().over(by))
    c = c.withColumn("next_title", F.lead("title").over(by)).withColumn("next_year", F.lead("year").over(by)).withColumn("next_conf", F.lead("conf").over(by))

    def triple(k: int, ok: Column, predicate: Column, target: Column, conf: Column) -> DataFrame:
        return c.where(ok).select("pid", "rank", F.lit(k).alias("k"), F.col("title").alias("subject"), predicate.alias("predicate"), target.alias("object"), conf.alias("confidence"), "tenant_id", "access_level")

    dated = (F.col("title") != "") & (F.col("next_title") != "") & (F.coalesce("year", F.lit(0)) != 0) & (F.coalesce("next_year", F.lit(0)) != 0)
    later = F.when(F.col("year") >= F.col("next_year"), "improves_upon").otherwise("precursor_of")
    parts = [
        triple(0, F.col("title") != "", F.lit("targets_topic"), F.col("topic"), F.col("conf")),
        triple(1, F.coalesce("source", F.lit("")) != "", F.lit("published_in"), F.col("source"), F.col("conf")),
        triple(2, dated, later, F.col("next_title"), F.round((F.col("conf") + F.col("next_conf")) / 2, 4)),
    ]
    n = F.row_number().over(Window.partitionBy("pid").orderBy("rank", "k"))
    return reduce(DataFrame.unionByName, parts).withColumn("pos", n).where(F.col("pos") <= MOST_TRIPLES).drop("rank", "k")
