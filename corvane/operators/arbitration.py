"""Two readers of one page become one: matching, choice, release, rescue and order.

A page's blocks of both readers meet in one row, so each text moves once and all further steps are
functions on that row. Which block of reader B is still free is decided by the last block of reader
A that had it for a candidate: texts are compared with that one only, and only where no block of A
covers the place. The rescue depends on what was rescued before, and folds over the free blocks of a
page, in their order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.functions import text as T

# Limits and marks that results depend on.
SAME_PLACE, COVERED, SAME_WORDS = 0.1, 0.2, 0.6
FAILED_MARK = "<Failed to OCR Equation>"
UNORDERED = 1_000_000_000
#: What a block may have besides pos, seq_id, bbox, type, content, score; absent ones are null.
OPTIONAL = {"reading_order": "int", "source": "string", "equation_failed": "boolean", "equation_marker": "string", "equation_failure_reason": "string", "equation_source": "string", "equation_png_path": "string", "png_path": "string"}
#: Unicode's white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What arbitration gives a block.
MERGED = {"content": "string", "source": "string", "score": "double", "stack_a_score": "double", "stack_b_score": "double", "arbiter_score": "double", "equation_failed": "boolean", "equation_marker": "string", "equation_failure_reason": "string", "equation_source": "string", "equation_png_path": "string"}


def _strip(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE))


def covers(box: Column, other: Column) -> Column:
    """Whether a frame other leaves no room for box: its centre inside, or an overlap over 0.2."""
    return G.holds_center(other, box) | G.overlaps(box, other, COVERED)


def has_same_text(a: Column, b: Column) -> Column:
    """One text holds the other, or their words overlap by 0.6; case and white space apart."""
    def shared(u: Column, v: Column) -> Column:
        n, all_ = F.size(F.array_intersect(u, v)), F.size(u) + F.size(v)
        could = F.least(F.size(u), F.size(v)) >= SAME_WORDS * F.greatest(F.size(u), F.size(v))
        return could & T.bind(n, lambda n: n >= SAME_WORDS * (all_ - n))

    def words(t: Column) -> Column:
        return F.array_distinct(F.split(t, " "))

    def of(x: Column, y: Column) -> Column:
        alike = T.bind(words(x), lambda u: T.bind(words(y), lambda v: shared(u, v)))
        return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | alike)

    return T.bind(F.lower(T.squash(a)), lambda x: T.bind(F.lower(T.squash(b)), lambda y: of(x, y)))


def _reader(blocks: DataFrame, page: list[str], reader: str) -> DataFrame:
    have = {c.lower() for c in blocks.columns}
    more = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()]
    return blocks.select(*page, F.lit(reader).alias("reader"), "pos", _strip(F.col("seq_id")).alias("seq_id"), "bbox", F.coalesce("type", F.lit("")).alias("type"), _strip(F.col("content")).alias("content"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), *more)


def _pages(a: DataFrame, b: DataFrame, page: list[str]) -> DataFrame:
    """(page, a, b): one row for each page, the blocks of each reader in order of pos."""
    both = _reader(a, page, "a").unionByName(_reader(b, page, "b"))
    block = F.struct("pos", "seq_id", "bbox", G.frame(F.col("bbox")).alias("box"), "type", "content", "score", *OPTIONAL)
    return both.groupBy(*page).agg(*[F.sort_array(F.collect_list(F.when(F.col("reader") == r, block))).alias(r) for r in ("a", "b")])


def same_place(a: Column, b: Column) -> Column:
    """Whether block b lies where block a does: its centre inside, or an overlap over 0.1."""
    return G.holds_center(a["box"], b["box"]) | G.overlaps(a["box"], b["box"], SAME_PLACE)


def same_id(a: Column, b: Column) -> Column:
    return (a["seq_id"] != "") & (a["seq_id"] == b["seq_id"])


def candidates(a: Column, others: Column) -> Column:
    """(by_id, b): of the other reader's blocks those with a's seq_id, whatever their box; where
    there are none, those of like place (D05)."""
    def of(told: Column) -> Column:
        by_id = F.size(told) > 0
        return F.struct(by_id.alias("by_id"), F.when(by_id, told).otherwise(F.filter(others, lambda b: same_place(a, b))).alias("b"))

    return T.bind(F.filter(others, lambda b: same_id(a, b)), of)


def chosen(a: Column, found: Column, margin: float) -> Column:
    """(b_score, pick: content and source) of a block of A and its candidates, in order."""
    text = F.array_join(F.filter(F.transform(found["b"], lambda x: x["content"]), lambda t: t != ""), " ")
    mean = F.when(F.size(found["b"]) > 0, F.aggregate(found["b"], F.lit(0.0), lambda s, x: s + x["score"]) / F.size(found["b"])).otherwise(0.0)
    both = F.struct(text.alias("text"), mean.alias("score"))
    return T.bind(both, lambda b: F.struct(b["score"].alias("b_score"), G.decide_content(a["type"], a["content"], a["score"], b["text"], b["score"], margin).alias("pick")))


def is_free(b: Column, rows: Column) -> Column:
    """Whether a block of B is no candidate, or the last block of A which had it gave it back: that
    kept its own text, they were matched by place, and their text differs. rows: those of merged."""
    def given_back(last: Column) -> Column:
        return last.isNull() | (last["kept_own"].isNotNull() & (b["content"] != "") & ~has_same_text(b["content"], last["kept_own"]))

    had = F.filter(rows, lambda m: F.when(m["by_id"], same_id(m, b)).otherwise(same_place(m, b)))
    return T.bind(F.try_element_at(had, F.lit(-1)), given_back)


def is_clear(x: Column, kept: Column) -> Column:
    """Whether none of kept covers x; all have a frame box."""
    return ~F.coalesce(F.exists(kept, lambda o: covers(x["box"], o["box"])), F.lit(False))


def _fold(rest: Column) -> Column:
    """Blocks of rest, in order, that those taken before leave clear."""
    return F.aggregate(rest, F.slice(rest, 1, 0), lambda out, x: F.when(is_clear(x, out), F.concat(out, F.array(x))).otherwise(out))


def rescued(kept: DataFrame, free: DataFrame, page: list[str]) -> DataFrame:
    """Free blocks, in order, that nothing covers: neither kept boxes nor rescues before.
    kept: page, bbox; free: page, pos, block with bbox. A page's free blocks are one array."""
    boxes = kept.groupBy(*page).agg(F.collect_list(F.struct(G.frame(F.col("bbox")).alias("box"))).alias("boxes"))
    one = F.struct("block", G.frame(F.col("block.bbox")).alias("box"))
    rest = free.groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("rest")).join(boxes, page, "left")
    none = F.array().cast(boxes.schema["boxes"].dataType)
    return rest.select(*page, F.explode(_fold(F.filter("rest", lambda x: is_clear(x, F.coalesce("boxes", none))))).alias("x")).select(*page, "x.block")


def _row(block: Column, reader: str, **fields: Column) -> Column:
    """A block as it leaves arbitration; its first fields are its order on the page."""
    order = F.when(block["reading_order"] > 0, block["reading_order"]).otherwise(UNORDERED)
    return F.struct(
        order.alias("_order"), block["bbox"][1].cast("long").alias("_y"), block["bbox"][0].cast("long").alias("_x"), F.lit(reader).alias("reader"), *[block[c].alias(c) for c in ("pos", "seq_id", "type", "bbox")],
        *[fields[c].cast(t).alias(c) for c, t in MERGED.items()], block["reading_order"].alias("reading_order"))


def merged(a: Column, found: Column, choice: Column) -> Column:
    """(seq_id, box, by_id, kept_own, row): a block of A with the content chosen for it. kept_own:
    its text where it may give candidates back, else null."""
    source, text, own, other = choice["pick"]["source"], choice["pick"]["content"], a["score"], choice["b_score"]
    final = F.when(source == "stack_b_override", other).otherwise(F.when(own > 0, own).otherwise(other))
    zero = F.lit(0.0)
    is_eq = a["type"] == "Equation"

    def first(*found: Column) -> Column:
        return _strip(F.coalesce(*[F.when(c != "", c) for c in found]))

    def row(t: Column) -> Column:
        failed = F.coalesce(t["equation_failed"], F.lit(False)) | T.is_failed_equation(text)
        mark = T.bind(_strip(t["equation_marker"]), lambda m: F.when(m == "", FAILED_MARK).otherwise(m))
        mark = F.when(failed, mark).otherwise("")
        return _row(
            a, "a", content=F.when(is_eq & failed, mark).otherwise(text), source=source,
            score=F.round(F.greatest(zero, final), 4), stack_a_score=F.round(F.greatest(zero, own), 4), stack_b_score=F.round(F.greatest(zero, other), 4), arbiter_score=F.round(F.greatest(own, other), 4),
            equation_failed=F.when(is_eq, failed).otherwise(a["equation_failed"]), equation_marker=F.when(is_eq, mark).otherwise(a["equation_marker"]),
            equation_failure_reason=F.when(is_eq, F.coalesce(t["equation_failure_reason"], F.lit(""))).otherwise(a["equation_failure_reason"]),
            equation_source=F.when(is_eq, F.coalesce(first(t["equation_source"], t["source"], a["equation_source"]), F.lit(""))).otherwise(a["equation_source"]),
            equation_png_path=F.when(is_eq, F.coalesce(first(t["equation_png_path"], t["png_path"], a["equation_png_path"]), F.lit(""))).otherwise(a["equation_png_path"]))

    taken = F.when((source == "stack_b_override") & (F.size(found["b"]) > 0), found["b"][0]).otherwise(a)
    gives = (source != "stack_b_override") & ~found["by_id"]
    return F.struct(a["seq_id"].alias("seq_id"), a["box"].alias("box"), found["by_id"].alias("by_id"), F.when(gives, text).alias("kept_own"), T.bind(taken, row).alias("row"))


def _saved(b: Column) -> Column:
    score, none = F.round(b["score"], 4), F.lit(None)
    same = {c: b[c] for c in MERGED if c.startswith("equation_")}
    return _row(b, "b", content=b["content"], source=F.lit("stack_b_rescue"), score=score, stack_a_score=none, stack_b_score=none, arbiter_score=score, **same)


def arbitrate_pages(a: DataFrame, b: DataFrame, page: list[str], margin: float = 0.10) -> DataFrame:
    """The blocks of each page after arbitration, in order.

    a, b: page columns, pos (order of input, unique on a page), seq_id, bbox, type, content, score,
    and any of OPTIONAL. Blocks of A without four numbers in bbox are dropped, those of B without
    are never rescued. Null content is empty, null scores are 0; margin is cut to 0 to 0.5.
    Returns page columns, n (1 ...), seq_id, type, bbox, content, source, the scores, the fields of
    equations, and the pos and reader it comes from. Order: reading_order, then y, x; blocks
    without one (null or not positive) come last; ties by reader, then pos. Pages that only one
    reader has are kept; where a page column is null, no blocks match. Empty tables: empty result.
    A page's blocks are one row."""
    margin = min(0.5, max(0.0, margin))
    told = reduce(and_, [F.col(c).isNotNull() for c in page])

    def of(x: Column) -> Column:
        others = F.when(told, x["b"]).otherwise(F.slice(x["b"], 1, 0))

        def one(v: Column, others: Column) -> Column:
            return T.bind(candidates(v, others), lambda f: T.bind(chosen(v, f, margin), lambda c: merged(v, f, c)))

        rows = T.bind(others, lambda o: F.transform(F.filter(x["a"], lambda v: v["box"].isNotNull()), lambda v: one(v, o)))
        return T.bind(rows, lambda r: settled(r, x["b"]))

    def settled(rows: Column, others: Column) -> Column:
        met = F.when(told, rows).otherwise(F.slice(rows, 1, 0))
        saved = T.bind(met, lambda m: _fold(F.filter(others, lambda b: b["box"].isNotNull() & is_clear(b, m) & is_free(b, m))))
        return F.sort_array(F.concat(F.transform(rows, lambda m: m["row"]), F.transform(saved, _saved)))

    found = _pages(a, b, page).select(*page, F.posexplode(T.bind(F.struct("a", "b"), of)).alias("_n", "_row"))
    out = ["pos", "reader", "seq_id", "type", "bbox", *MERGED, "reading_order"]
    return found.select(*page, *[F.col(f"_row.{c}").alias(c) for c in out], (F.col("_n") + 1).alias("n"))
