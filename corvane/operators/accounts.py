"""Usage and cost, sessions, rate windows, members, versions and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.biblio import blank, normalize_year
from corvane.functions.udfs import normal_title, similar_titles, title_similarity

# USD per million tokens (input, cached input, output), a second rate for long
# prompts (threshold, input, cached, output), and names that stand for changing models.
PRICES = {
    "openai/gpt-4.1": (2.00, 0.50, 8.00), "openai/gpt-4.1-mini": (0.40, 0.10, 1.60),
    "google/gemini-2.5-flash": (0.30, 0.03, 2.50), "google/gemini-2.5-flash-lite": (0.10, 0.01, 0.40),
    "google/gemini-2.5-pro": (1.25, 0.125, 10.00),
}
LONG_PROMPTS = {"google/gemini-2.5-pro": (200_000, 2.50, 0.25, 15.00)}
UNPRICED = ["google/gemini-flash-latest", "google/gemini-pro-latest", "openrouter/auto"]
IDLE_SECONDS = 300
ROLE_RANK = {"owner": 5, "editor": 4, "coauthor": 3, "reviewer": 2, "viewer": 1}


def micros(ts: Column) -> Column:
    """Microseconds of the epoch of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *v, *LONG_PROMPTS.get(k, (None, None, None, None))) for k, v in PRICES.items()]
    return spark.createDataFrame(rows, "model_key string, p_in double, p_cached double, p_out double, tier_over long, t_in double, t_cached double, t_out double")


def model_key(vendor: Column, model: Column) -> Column:
    """vendor/model in lower case, without a date at the end."""
    return F.regexp_replace(F.concat(F.lower(F.trim(vendor)), F.lit("/"), F.lower(F.trim(model))), "-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")


def with_cost(usage: DataFrame) -> DataFrame:
    """cost_usd of vendor, model, input_tokens, output_tokens, cached_tokens; null if unpriced.
    Cached tokens are at most the input; long prompts take the second rate."""
    prices = price_table(usage.sparkSession)
    u = usage.withColumn("model_key", model_key(F.col("vendor"), F.col("model"))).join(F.broadcast(prices), "model_key", "left")
    long = F.col("tier_over").isNotNull() & (F.col("input_tokens") > F.col("tier_over"))
    rate = lambda t, p: F.when(long, F.col(t)).otherwise(F.col(p))
    zero = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    cached = F.least(zero("cached_tokens"), zero("input_tokens"))
    cost = ((zero("input_tokens") - cached) * rate("t_in", "p_in") + cached * F.coalesce(rate("t_cached", "p_cached"), rate("t_in", "p_in")) + zero("output_tokens") * rate("t_out", "p_out")) / 1e6
    return u.withColumn("cost_usd", F.round(cost, 6)).select(*usage.columns, "cost_usd")


def usage_summary(usage: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens, cost, whether and how much is unpriced, models used."""
    priced = F.col("cost_usd").isNotNull()
    return usage.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens")], F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd"), F.max((~priced).cast("int")).alias("has_unpriced"), F.sum(F.when(~priced, F.col("input_tokens") + F.col("output_tokens")).otherwise(0)).alias("unpriced_tokens"),
        F.array_join(F.sort_array(F.collect_set(F.concat_ws("/", "vendor", "model"))), ",").alias("models"))


def first_number(raw: Column, *keys: str) -> Column:
    """The first of several keys of a JSON text that is a number of 0 or more, else 0."""
    found = [F.get_json_object(raw, f"$.{k}").try_cast("double") for k in keys]
    return F.coalesce(*[F.when(f >= 0, f.cast("long")) for f in found], F.lit(0))


def sessions(events: DataFrame, user: str, ts: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions that end at the last sign of life before a gap longer than the limit."""
    w = Window.partitionBy(user).orderBy(ts)
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(w))
    e = events.withColumn("new", F.when(gap.isNull() | (gap > idle_seconds * 1_000_000), 1).otherwise(0))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = e.groupBy(user, "session").agg(F.min(ts).alias("login_at"), F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("beats"))
    return s.withColumn("seconds", F.floor((micros(F.col("ended_at")) - micros(F.col("login_at"))) / 1_000_000))


def activity(sessions_df: DataFrame, user: str) -> DataFrame:
    """Logins, seconds, minutes, mean minutes and last login of each user."""
    g = sessions_df.groupBy(user).agg(F.count(F.lit(1)).alias("logins"), F.sum("seconds").alias("total_seconds"), F.max("login_at").alias("last_login"))
    # Rounded as SQL does, by tenths of the double: 2.4499999999999997 is 24.5 tenths, thus 2.5.
    tenths = lambda x: F.round(x * 10) / 10
    return g.withColumn("total_minutes", tenths(F.col("total_seconds") / 60)).withColumn("mean_minutes", tenths(F.col("total_seconds") / 60 / F.col("logins")))


def rate_windows(events: DataFrame, ts: str, tokens: Column, minute_limit: int) -> DataFrame:
    """Requests and tokens of each minute of the epoch, and whether they pass the limit (J03 sums)."""
    minute = F.floor(micros(F.col(ts)) / 60_000_000)
    g = events.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))
    return g.withColumn("over", F.col("requests") > minute_limit)


def pid_aliases(pid: Column) -> Column:
    """A project's id, its base and its formal id."""
    base = F.regexp_replace(pid, "-p$", "")
    return F.array_distinct(F.array(pid, base, F.concat(base, F.lit("-p"))))


def highest_role(members: DataFrame, user: str, pid: str, role: str) -> DataFrame:
    """The role of highest rank over a project's aliases."""
    rank = F.create_map(*[F.lit(x) for kv in ROLE_RANK.items() for x in kv])[F.col(role)]
    base = F.regexp_replace(F.col(pid), "-p$", "")
    return members.groupBy(F.col(user), base.alias("base_pid")).agg(F.max_by(role, F.struct(rank, F.col(role))).alias("role"))


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], fill: list[str], keep: list[str]) -> DataFrame:
    """Rows matched by key are updated, filled columns falling back to the old value; others are
    inserted; columns to keep stay as they were (K01)."""
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in (*fill, *keep)]).withColumn("__old", F.lit(True))
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in (*fill, *keep)])
    j = o.join(n, key, "full_outer")
    return j.select(*key, *[F.coalesce(blank(F.col(f"n_{c}").cast("string")), F.col(f"o_{c}").cast("string")).alias(c) for c in fill], *[F.coalesce(F.col(f"o_{c}"), F.col(f"n_{c}")).alias(c) for c in keep], F.coalesce(F.col("__old"), F.lit(False)).alias("existed"))


def replace_partition(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the keys that new has are replaced by new's."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def merge_candidates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One entry a key: first non-empty title, venue and abstract, united sources, any verified,
    largest confidence (K03, K04)."""
    def first(c: str) -> Column:
        value = blank(F.col(c))
        return F.min_by(value, F.when(value.isNotNull(), F.col(order))).alias(c)

    return rows.groupBy(key).agg(first("title"), first("venue"), first("abstract"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max(F.col("verified").cast("int")).alias("verified"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("seen"))


def dedupe_candidates(rows: DataFrame, key: str, complete: str, order: str) -> DataFrame:
    """One row a key, the most complete and of those the first; in order of first sight."""
    w = Window.partitionBy(key)
    best = F.row_number().over(w.orderBy(F.col(complete).desc(), order))
    return rows.withColumn("seen_at", F.min(order).over(w)).withColumn("__n", best).where("__n = 1").drop("__n")


def scout_merge(b: DataFrame, c: DataFrame) -> DataFrame:
    """Two scouts' findings by key: consensus where both have it, gaps filled, suspects that one
    side alone has dropped (D12). Columns: key, title, doi, venue, suspect."""
    right = c.select(*[F.col(x).alias(f"c_{x}") for x in ("key", "title", "doi", "venue")])
    j = b.join(right, F.col("key") == F.col("c_key"), "full_outer")
    both = F.col("key").isNotNull() & F.col("c_key").isNotNull()
    pick = lambda x: F.coalesce(blank(F.col(x)), F.col(f"c_{x}")).alias(x)
    j = j.withColumn("consensus", both).where(both | ~F.coalesce(F.col("suspect"), F.lit(False)))
    return j.select(pick("key"), pick("title"), pick("doi"), pick("venue"), "consensus")


def next_version(versions: DataFrame, *by: str) -> DataFrame:
    """Largest tenths plus one."""
    return versions.groupBy(*by).agg((F.coalesce(F.max("tenths"), F.lit(0)) + 1).alias("next_tenths"))


def smallest_free(used: DataFrame, group: str, number: str) -> DataFrame:
    """The lowest positive number a group doesn't use (F28): the first gap in the sorted numbers."""
    w = Window.partitionBy(group).orderBy(number)
    d = used.where(F.col(number) > 0).select(group, number).distinct().withColumn("__k", F.row_number().over(w))
    return d.groupBy(group).agg((F.coalesce(F.max(F.when(F.col(number) == F.col("__k"), F.col("__k"))), F.lit(0)) + 1).alias("free"))


def optimistic_save(current: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """Revision after a write: no base overwrites, another base than the current is a conflict."""
    j = writes.join(current, key, "left").withColumn("rev", F.coalesce("rev", F.lit(0)))
    conflict = F.col("base_rev").isNotNull() & (F.col("base_rev") != F.col("rev"))
    return j.select(key, "base_rev", "rev", conflict.alias("conflict"), F.when(conflict, F.col("rev")).otherwise(F.col("rev") + 1).alias("new_rev"))


def latest_decision(ledger: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last entry of an append-only ledger."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return ledger.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def fail_stale(jobs: DataFrame, running: list[str], updated: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Running jobs without an update for 24 hours, or without any, become failed."""
    old = F.col(updated).isNull() | (micros(as_of) - micros(F.col(updated)) > hours * 3_600_000_000)
    return jobs.withColumn("status", F.when(F.col("status").isin(running) & old, "failed").otherwise(F.col("status")))


def within_ttl(entries: DataFrame, ts: str, as_of: Column, seconds: int = 21_600) -> DataFrame:
    """Entries not older than six hours."""
    return entries.where(micros(as_of) - micros(F.col(ts)) <= seconds * 1_000_000)


def shared_project_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links (mentor, mentee) whose two hold a role in one project that is not section-scoped.

    members: user, pid, role, open. A coauthor is section-scoped unless the project is open.
    Links that repeat are given once."""
    scoped = F.coalesce(F.col("role") == "coauthor", F.lit(False)) & ~F.coalesce(F.col("open"), F.lit(False))
    m = members.where(~scoped).select("user", "pid").distinct()
    held = links.select("mentor", "mentee").distinct().join(m.withColumnRenamed("user", "mentee"), "mentee")
    return held.join(m.withColumnRenamed("user", "mentor"), ["mentor", "pid"], "left_semi").select("mentor", "mentee").distinct()


#: Services in the order in which titles are looked for (D21); others come last.
FINDERS = ("crossref", "openalex", "pubmed", "arxiv")
#: Most titles of a side, about, that meet in one cell.
CELL_TITLES = 2000


def like_titles(keys: DataFrame, known: DataFrame, block: list[str], floor: float) -> DataFrame:
    """(block, key, known, s): titles of a block whose ratio s is floor at least. All pairs of a
    block are looked at, as the ratio is no metric and its bounds are too wide for an index; cells
    of bounded size share them out, so memory is bounded and no pair is shuffled.
    keys: block, key; known: block, known; distinct."""
    def dealt(rows: DataFrame, title: str, own: str, other: str) -> DataFrame:
        held = rows.withColumn(own, F.pmod(F.xxhash64(title), F.col(f"{own}s")).cast("int"))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select(*[F.col(c).alias(c) for c in block], "row", "column", title)

    many = lambda rows, name: rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / CELL_TITLES).cast("int").alias(name))
    sizes = F.broadcast(many(keys, "rows").join(many(known, "columns"), block))
    left, right = dealt(keys.join(sizes, block), "key", "row", "column"), dealt(known.join(sizes, block), "known", "column", "row")
    cell = [*block, "row", "column"]
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (rows.repartition(tasks, *cell) for rows in (left, right))  # few bytes and much work: not to be put together

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i, j, s = similar_titles(a["key"].tolist(), b["known"].tolist(), floor)
        out = a.iloc[i][[*block, "key"]].reset_index(drop=True)
        return out.assign(known=b["known"].iloc[j].to_numpy(), s=pd.Series(s, dtype="float64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.select(*block, "key").schema)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(compare, f"{schema}, known string, s double")


def resolve_references(refs: DataFrame, papers: DataFrame, block: list[str], *, doi_floor: float = 0.55, title_floor: float = 0.82, verbatim: float = 0.95, years: int = 1) -> DataFrame:
    """The paper that each reference means, if any: ref, paper, match (doi, title), score.

    refs: ref, title, year, doi and block columns; papers: paper, title, year, doi, source and
    block columns; DOIs are normalised. A DOI hit (the first service's paper of least key) counts
    from doi_floor on, or where the reference has no title. Else the best title of the
    block from title_floor on, the earlier service on ties; once a service has a verbatim one,
    later services are not asked. The best one's year may be years off where both are known.
    A title that its block holds word for word, with its first service, is not compared further."""
    rank = F.lit(len(FINDERS))
    for i, name in enumerate(FINDERS):
        rank = F.when(F.lower("source") == name, F.lit(i)).otherwise(rank)
    p = papers.withColumn("rank", rank).withColumn("first", F.struct("rank", "paper"))
    r = refs.select("ref", *block, F.trim(F.coalesce("title", F.lit(""))).alias("title"), normalize_year(F.col("year")).alias("year"), F.lower(F.coalesce("doi", F.lit(""))).alias("doi"))
    of_doi = p.where(F.coalesce("doi", F.lit("")) != "").groupBy(F.lower("doi").alias("doi")).agg(F.min_by("paper", "first").alias("paper"), F.min_by("title", "first").alias("hit"))
    score = F.when(F.col("title") == "", F.lit(1.0)).otherwise(title_similarity(F.col("title"), F.col("hit")))
    by_doi = r.join(of_doi, "doi").withColumn("score", score).where(F.col("score") >= doi_floor).select("ref", "paper", F.lit("doi").alias("match"), F.round("score", 4).alias("score"))

    asked = r.where("title <> ''").join(by_doi.select("ref"), "ref", "left_anti").withColumn("key", normal_title(F.col("title")))
    held = p.groupBy(*block, normal_title(F.col("title")).alias("known"), "rank").agg(F.min("paper").alias("paper"), F.min_by("year", "paper").alias("found_year"))
    keys = asked.select(*block, "key").where("key <> ''").distinct()
    # Nothing ranks before the first service's equal title.
    first = held.groupBy(*block, "known").agg(F.min("rank").alias("rank")).join(held.groupBy(*block).agg(F.min("rank").alias("least")), block)
    equal = keys.join(first.where("rank = least").select(*block, F.col("known").alias("key")), [*block, "key"], "left_semi").select(*block, "key", F.col("key").alias("known"), F.lit(1.0).alias("s"))
    rest = keys.join(equal.select(*block, "key"), [*block, "key"], "left_anti")
    like = equal.unionByName(like_titles(rest, held.select(*block, "known").where("known <> ''").distinct(), block, title_floor))
    sure, at = F.col("s") >= verbatim, F.col("rank").cast("double")
    order = F.struct((~sure).alias("a"), F.when(sure, at).otherwise(-F.col("s")).alias("b"), F.when(sure, -F.col("s")).otherwise(at).alias("c"), "paper", "found_year", "s")
    best = like.join(held, [*block, "known"]).groupBy(*block, "key").agg(F.min(order).alias("best")).select(*block, "key", "best.paper", "best.found_year", "best.s")
    found = normalize_year(F.col("found_year"))
    near = F.coalesce(F.abs(F.col("year") - found) <= years, F.lit(True))
    by_title = asked.join(best, [*block, "key"]).where(near).select("ref", "paper", F.lit("title").alias("match"), F.round("s", 4).alias("score"))
    return by_doi.unionByName(by_title)
