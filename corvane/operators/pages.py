"""Rules on one page or paper whose result depends on the order of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def merge_bodies(blocks: DataFrame, paper: str, order: str) -> DataFrame:
    """Consecutive mergeable bodies joined by a space with united boxes (F06). What has been merged
    may always be merged again, as it is as long as its last part and ends as that does, so runs of
    mergeable blocks merge whole. Columns: type, text, noise, bbox; others are the first one's."""
    strip = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    ok = T.bind(strip, lambda t: (F.length(t) >= 150) | F.regexp_like(t, F.lit(r"[.!?。！？]\z")))
    w = Window.partitionBy(paper).orderBy(order)
    b = blocks.withColumn("_ok", F.coalesce((F.col("type") == "Body") & ~F.coalesce("noise", F.lit(False)) & ok, F.lit(False)))
    b = b.withColumn("_new", (~(F.col("_ok") & F.lag("_ok", 1, False).over(w))).cast("int"))
    b = b.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    sides = [f(F.col("bbox")[i]) for i, f in enumerate((F.min, F.min, F.max, F.max))]
    alone = F.count(F.lit(1)) == 1
    kind = blocks.schema["bbox"].dataType
    own = {
        "text": F.when(alone, F.min_by("text", order)).otherwise(F.array_join(F.transform(parts, lambda x: F.coalesce(x["t"], F.lit(""))), " ")),
        "bbox": F.when(alone, F.min_by("bbox", order)).otherwise(F.array(*sides).cast(kind)),
    }
    g = b.groupBy(paper, "_run").agg(*[own.get(c, F.min_by(c, order)).alias(c) for c in blocks.columns if c != paper])
    return g.select(*blocks.columns)


def _in_order(rows: DataFrame, key: str, order: str, inputs: list[str], start, name: str, kind: str) -> DataFrame:
    """rows with a column by a rule on each key's rows in order: start() gives a function of the
    inputs that is called row by row. Sorted partitions pass in batches; only the state is held."""
    names = [f.name for f in rows.schema]
    fields = ", ".join(f"`{f.name}` {kind if f.name == name else f.dataType.simpleString()}" for f in rows.schema)
    fields += "" if name in names else f", `{name}` {kind}"

    def run(batches):
        at, step = None, None
        for g in batches:
            out = []
            for k, *v in zip(g[key], *(g[c] for c in inputs)):
                if step is None or (k != at and (k == k or at == at)):  # a null key is one key
                    at, step = k, start()
                out.append(step(*v))
            yield g.assign(**{name: out})

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, fields)


def merge_boxes(boxes: DataFrame, page: list[str], order: str, page_w: Column, x_gap: int = 24, y_gap: int = 16) -> DataFrame:
    """Rectangles of each page, in the order given: one within the gaps of a rectangle so far joins
    the first such, unless that would bridge two columns (over 0.62 of the page's width from parts
    under 0.46); those under 10 wide or high are left out (F27). boxes: page columns, order, bbox
    (x, y, w, h). Returns page columns, n (order), bbox. A fold over one page's boxes, in the JVM."""
    rows = boxes.where((F.col("bbox")[2] >= 10) & (F.col("bbox")[3] >= 10))
    lists = rows.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.transform("bbox", lambda v: v.cast("long")).alias("b")))).alias("all"), F.max(page_w).alias("pw"))
    wide, narrow = F.col("pw") * 0.62, F.col("pw") * 0.46

    def joins(a: Column, m: Column) -> Column:
        shared = F.least(a[0] + a[2], m[0] + m[2]) - F.greatest(a[0], m[0])
        apart_y = F.greatest(a[1], m[1]) - F.least(a[1] + a[3], m[1] + m[3])
        union = F.greatest(a[0] + a[2], m[0] + m[2]) - F.least(a[0], m[0])
        return (apart_y <= y_gap) & (-shared <= x_gap) & ~((union > wide) & (F.greatest(a[2], m[2]) < narrow))

    def union(a: Column, m: Column) -> Column:
        x, y = F.least(a[0], m[0]), F.least(a[1], m[1])
        return F.array(x, y, F.greatest(a[0] + a[2], m[0] + m[2]) - x, F.greatest(a[1] + a[3], m[1] + m[3]) - y)

    def step(acc: Column, e: Column) -> Column:
        a = e["b"]
        at = F.array_position(F.transform(acc, lambda m: joins(a, m)), True)
        return F.when(at == 0, F.concat(acc, F.array(a))).otherwise(F.transform(acc, lambda m, i: F.when(i == at - 1, union(a, m)).otherwise(m)))

    merged = F.aggregate("all", F.array().cast("array<array<bigint>>"), step)
    return lists.select(*page, F.posexplode(merged).alias("n", "bbox"))


def unique_keys(sections: DataFrame, project: str, order: str, key: str = "section_key") -> DataFrame:
    """Valid unused keys stay; others become sec_n with the next free n."""
    import re

    def start():
        used, at = set(), 0

        def step(raw):
            nonlocal at
            at += 1
            n, k = at, (raw or "").strip()
            if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", k) or k in used:
                while f"sec_{n}" in used:
                    n += 1
                k = f"sec_{n}"
            used.add(k)
            return k

        return step

    return _in_order(sections, project, order, [key], start, key, "string")


def affinity_chunks(rows: DataFrame, paper: str, order: str, size: int = 24, most_more: int = 4) -> DataFrame:
    """Chunk numbers of fixed size; a boundary moves up to four rows on while the affinity key
    goes on (F17). Columns: affinity."""
    def start():
        chunk, held, more, last = 0, 0, 0, None

        def step(k):
            nonlocal chunk, held, more, last
            if held < size:
                held += 1
            elif more < most_more and k and k == last:
                more += 1
            else:
                chunk, held, more = chunk + 1, 1, 0
            last = k
            return chunk

        return step

    return _in_order(rows, paper, order, ["affinity"], start, "chunk", "int")


def request_batches(segments: DataFrame, paper: str, order: str, text: str, most_items: int = 4, most_chars: int = 1800) -> DataFrame:
    """Batch numbers of a paper's segments in order (F16)."""
    def start():
        batch, items, chars = 0, 0, 0

        def step(t):
            nonlocal batch, items, chars
            n = len(t or "")
            if items and (items >= most_items or chars + n > most_chars):
                batch, items, chars = batch + 1, 0, 0
            items, chars = items + 1, chars + n
            return batch

        return step

    return _in_order(segments, paper, order, [text], start, "batch", "int")
