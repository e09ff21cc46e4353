"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. Document rates are the distribution closest to one copy of
each document (least relative entropy, no rate above the limit) that meets the targets:
rate = min(limit, exp(lambda * size / mean size)), with one multiplier for each source. The
multipliers solve a convex dual; each Newton step is one aggregation over a histogram of
(source, size), with bisection inside a bracket where a step would leave it. Rates become
whole copies by systematic rounding, largest sizes first, and a repair among the smallest.
Columns and SQL functions only; the driver sees one number for each step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, materialize, materialize_at, shared_path

#: Documents of one source and size that are ranked together when copies are dealt out.
CELL_ROWS = 2048


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Adds target: share of all sizes by weight, at most limit times the source's size.

    Weights repeat over the sources in code point order, null last. Past a cap the excess is
    reshared by weight; that is one level theta with target = min(cap, weight * theta), found
    from running sums in the order of cap / weight."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("weight", w).withColumn("cap", limit * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(every))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    spent = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - spent) / open_weight)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    theta = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("theta", theta)
    return t.withColumn("target", F.when(F.col("theta").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("theta")))).select("source", "docs", "source_size", "target")


def _rate(limit: float) -> Column:
    tilt = F.col("lam") * F.col("size") / F.col("mean")
    return F.when(F.col("full"), F.lit(limit)).when(tilt >= math.log(limit), F.lit(limit)).otherwise(F.exp(tilt))


def solve_multipliers(cells: DataFrame, sources: DataFrame, limit: float, tolerance: float = 1e-7, most_steps: int = 60) -> DataFrame:
    """Newton steps on the dual, one aggregation each, until every target is met."""
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    low = F.when(F.col("target") < F.col("source_size"), mean * F.ln(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size"))).otherwise(F.lit(0.0))
    lam = sources.select("source", "source_size", "target", mean.alias("mean"), F.lit(0.0).alias("lam"), low.alias("low"), (mean * math.log(limit)).alias("high"), (F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)).alias("full"))
    last = shared_path(cells.sparkSession, "mix-step")
    lam = materialize_at(lam.coalesce(1), last)
    for _ in range(most_steps):
        rate = _rate(limit)
        tokens = F.col("n") * F.col("size") * rate
        free = F.when(rate < limit, tokens * F.col("size") / F.col("mean")).otherwise(0.0)
        joined = cells.join(lam.select(F.col("source").alias("s"), "mean", "lam", "full"), F.col("source").eqNullSafe(F.col("s")))
        sums = joined.groupBy("source").agg(F.sum(tokens).alias("g"), F.sum(free).alias("h")).withColumnRenamed("source", "s")
        step = lam.join(sums, F.col("source").eqNullSafe(F.col("s"))).withColumn("gap", F.when(F.col("full"), 0.0).otherwise(F.col("g") - F.col("target")))
        step = step.withColumn("high", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low")))
        newton = F.col("lam") - F.col("gap") / F.greatest(F.col("h"), F.lit(1e-300))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        nxt = F.when(F.abs("gap") <= tolerance * F.col("target"), F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        path = shared_path(cells.sparkSession, "mix-step")
        lam = materialize_at(step.select("source", "source_size", "target", "mean", nxt.alias("lam"), "low", "high", "full", "gap").coalesce(1), path, last)
        last = path
        worst = lam.agg(F.max(F.abs("gap") / F.greatest(F.col("target"), F.lit(1e-9)))).first()[0]
        if worst is None or worst <= tolerance:
            break
    return lam.select("source", "source_size", "target", "mean", "lam", "full")


def _whole_copies(cells: DataFrame, limit: int) -> DataFrame:
    """Copies m of each cell: expected copies cumulated from the largest size, then rounded."""
    down = Window.partitionBy("source").orderBy(F.col("size").desc(), "part")
    expected = F.col("n") * F.col("rate")
    until = F.floor(F.sum(expected).over(down.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    c = cells.withColumn("until", until)
    c = c.withColumn("m", F.col("until") - F.coalesce(F.lag("until").over(down), F.lit(0)))
    c = c.withColumn("m", F.greatest(F.lit(0), F.least(F.col("m"), limit * F.col("n"))).cast("long"))
    whole, up = Window.partitionBy("source"), Window.partitionBy("source").orderBy("size", "part")
    c = c.withColumn("rest", F.col("target") - F.sum(F.col("m") * F.col("size")).over(whole))
    room = F.when(F.col("size") == 0, 0).when(F.col("rest") > 0, limit * F.col("n") - F.col("m")).otherwise(F.col("m"))
    c = c.withColumn("room", room.cast("long"))
    used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    move = F.when(F.col("size") == 0, 0).otherwise(F.floor((F.abs("rest") - used) / F.greatest(F.col("size"), F.lit(1))))
    move = F.least(F.col("room"), F.greatest(F.lit(0), move)).cast("long")
    return c.withColumn("m", F.col("m") + F.when(F.col("rest") > 0, move).otherwise(-move)).select("source", "size", "part", "n", "m", "source_size", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: int = 2, carry: bool = False) -> DataFrame:
    """How many copies of each document a mix of share times all words takes.

    Size is the number of words (null text: 0). Sources in code point order, null last, get
    weights in turn. Returns one row for each row of docs: doc_id, source, size, source_size,
    target (of the source, in words), copies (0 to limit), taken (copies * size). A source's
    taken words miss its target by less than the size of one of its small documents; a
    source without words has target 0 and its documents get whole copies near rate 1.
    Copies follow from the row's id and text, so reruns agree; rows that repeat an id, or have
    none, are dealt copies one by one. Empty table: empty result. With carry, also the row of
    docs itself as a struct named row; its columns may have any names. The distinct sources
    are ranked in one task: millions fit, a source for each document would not.
    """
    key = F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col)).alias("key")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    wide, sized = sized, materialize(sized.drop("row"), "mix-sizes")
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("s"), F.col("size").alias("z"), F.ceil(F.col("n") / CELL_ROWS).alias("parts"))
    counts = materialize(counts, "mix-counts")

    def place(rows: DataFrame) -> DataFrame:
        part = F.pmod("key", F.col("parts")).cast("int")
        return rows.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select(*rows.columns, part.alias("part"))

    placed = materialize(place(sized), "mix-placed")
    cells = materialize(placed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    lam = solve_multipliers(cells, materialize(water_fill(sources, weights, share, float(limit)), "mix-targets"), float(limit))
    rated = cells.join(lam.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", _rate(float(limit))).drop("s")
    dealt = _whole_copies(rated, limit).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "n", "m", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("key", "doc_id"))
    ranked = (place(wide) if carry else placed).withColumn("rank", rank)
    out = ranked.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    copies = F.floor(F.col("m") / F.col("n")) + (F.col("rank") <= F.pmod("m", "n")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(["row"] if carry else []))
