"""Rules about regions of a page image: likely tables, figures, equations, captions.

A region's features are columns: x1, y1, x2, w, h, page_w, page_h in pixels, and the ratios
area_ratio, text_density, small_cc_count, table_grid_score, line_h_ratio, line_v_ratio,
grid_intersection_ratio, fg_ratio. A null feature counts as 0. All rules are built-in expressions
on one row, so they run inside the scan's stage."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """The features of a region as numeric columns, named as in this module's rules."""

    area: Column
    density: Column
    parts: Column
    grid: Column
    line_h: Column
    line_v: Column
    crossings: Column
    ink: Column
    x1: Column
    y1: Column
    x2: Column
    w: Column
    h: Column
    page_w: Column
    page_h: Column

    @classmethod
    def of_columns(cls) -> Region:
        names = "area_ratio text_density small_cc_count table_grid_score line_h_ratio line_v_ratio grid_intersection_ratio fg_ratio x1 y1 x2 w h page_w page_h".split()
        return cls(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names))

    def wide(self, share: float) -> Column:
        return self.w >= F.floor(self.page_w * share)

    def high(self, share: float) -> Column:
        return self.h >= F.floor(self.page_h * share)

    @property
    def weaker_line(self) -> Column:
        return F.least(self.line_h, self.line_v)


def is_caption_like(r: Region) -> Column:
    """A small, flat, dense block without a grid."""
    no_grid = (r.grid <= 0.070) | (r.weaker_line <= 0.0012)
    return (r.area <= 0.028) & (r.h <= F.floor(r.page_h * 0.08)) & r.wide(0.20) & (r.density >= 1.0) & no_grid


def is_table_like(r: Region) -> Column:
    """Of some size, with crossing lines or a strong grid; a large region of little text needs
    more crossings (C39)."""
    grid = r.grid >= 0.011
    lines = (r.crossings >= 0.0010) | grid & ((r.crossings >= 0.00045) | (r.weaker_line >= 0.0032) & (r.crossings >= 0.00035))
    hollow = (r.density <= 0.28) & (r.area >= 0.06) & (r.crossings < 0.0012)
    return (r.area >= 0.007) & r.wide(0.14) & r.high(0.024) & lines & ~hollow


def is_table_like_soft(r: Region) -> Column:
    """A larger region with a grid and either lines both ways or one strong direction."""
    lines = (r.weaker_line >= 0.0025) | (F.greatest(r.line_h, r.line_v) >= 0.020)
    return (r.area >= 0.010) & r.wide(0.18) & r.high(0.035) & (r.grid >= 0.020) & lines


def is_figure_like(r: Region) -> Column:
    """A large region without a grid, of little text unless very large; no dense text body."""
    size = (r.area >= 0.026) & r.wide(0.25) & r.high(0.075) | (r.area >= 0.020) & r.wide(0.30) & r.high(0.060)
    little = (r.density <= 1.95) | (r.parts <= 64) | (r.area >= 0.060) & (r.grid <= 0.005) & (r.density <= 1.75)
    body = (r.density >= 2.05) & (r.parts >= 70) & (r.grid <= 0.010) & (r.crossings <= 0.00045)
    return size & (r.grid <= 0.020) & little & ~body


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _upto(c: Column, full: float) -> Column:
    """Share of a full value, at most 1."""
    return F.least(F.lit(1.0), c / full)


def _weighed(terms: list[tuple[float, Column]], less: list[tuple[float, Column]]) -> Column:
    """Sum of weights times terms, less the amounts whose conditions hold."""
    total = reduce(add, [w * t for w, t in terms])
    return reduce(lambda s, p: s - F.when(p[1], p[0]).otherwise(0.0), less, total)


def _where(condition: Column, yes: float, no: float) -> Column:
    return F.when(condition, yes).otherwise(no)


# The weights, full values and deductions of the four scores.

def table_score(r: Region) -> Column:
    h, v = _upto(r.line_h, 0.010), _upto(r.line_v, 0.010)
    return _weighed(
        [(0.24, _upto(r.grid, 0.018)), (0.27, _upto(r.crossings, 0.0012)), (0.18, _upto(h + v, 1.35)), (0.11, _upto(r.area, 0.12)), (0.08, 1.0 - F.least(F.lit(1.0), F.abs(h - v))), (0.12, _where(r.ink.between(0.01, 0.40), 1.0, 0.0))],
        [
            (0.20, r.crossings < 0.00025),
            (0.16, (r.weaker_line < 0.0028) & (r.grid < 0.011)),
            (0.16, (r.area < 0.004) & (r.crossings < 0.00030)),
            (0.25, (r.density > 5.2) & (r.parts > 90) & (r.grid < 0.011) & (r.crossings < 0.00045)),
            (0.18, (r.density < 0.30) & (r.area >= 0.060) & (r.crossings < 0.0012)),
        ])


def figure_score(r: Region) -> Column:
    size = lambda c, page: _upto(c, F.greatest(F.lit(1.0), page))
    return _weighed(
        [(0.30, _upto(r.area, 0.10)), (0.22, 1.0 - _upto(r.density, 3.0)), (0.20, 1.0 - _upto(r.grid, 0.012)), (0.14, size(r.w, r.page_w * 0.30)), (0.14, size(r.h, r.page_h * 0.10))],
        [(0.20, (r.density > 2.2) & (r.parts > 45)), (0.18, (r.y1 < F.floor(r.page_h * 0.20)) & (r.h < r.page_h * 0.14) & (r.density > 1.6))])


def body_score(r: Region, column: Column) -> Column:
    """column: the region's column on a page of two, null on a page of one."""
    lines = F.least(_upto(r.line_h, 0.010), _upto(r.line_v, 0.010))
    own_column = F.coalesce(column.isin("left", "right"), F.lit(False)) & (r.w < r.page_w * 0.48)
    return _weighed(
        [(0.42, _upto(r.density, 4.5)), (0.25, _upto(r.parts, 75.0)), (0.16, 1.0 - _upto(r.grid, 0.018)), (0.09, _where(r.area < 0.30, 1.0, 0.45)), (0.08, _where(r.ink.between(0.01, 0.35), 1.0, 0.65))],
        [(0.22, (r.grid >= 0.015) & (lines >= 0.40)), (-0.05, own_column)])


def equation_score(r: Region) -> Column:
    tall, broad = r.h / F.greatest(F.lit(1.0), r.page_h), r.w / F.greatest(F.lit(1.0), r.page_w)
    shape = F.when(tall.between(0.018, 0.185) & (broad >= 0.16), 1.0).when(tall.between(0.012, 0.225) & (broad >= 0.12), 0.72).otherwise(0.0)
    off_center = F.abs((r.x1 + r.x2) / 2.0 / F.greatest(F.lit(1.0), r.page_w) - 0.5)
    return _weighed(
        [(0.30, shape), (0.18, 1.0 - _upto(off_center, 0.24)), (0.20, 1.0 - _upto(F.abs(r.density - 1.45), 2.2)), (0.16, 1.0 - _upto(r.grid, 0.012)), (0.08, 1.0 - _upto(r.crossings, 0.0009)), (0.08, _upto(r.parts, 120.0))],
        [(0.20, (r.grid >= 0.018) & (r.crossings >= 0.00055)), (0.18, (r.density >= 4.2) & (r.parts >= 95)), (0.05, (r.y1 <= F.floor(r.page_h * 0.10)) & (r.h <= F.floor(r.page_h * 0.06)))])


def with_types(regions: DataFrame, column: Column, name: str = "types") -> DataFrame:
    """Adds (table, figure, body, equation, pred, confidence, reasons) of each region (C43); column
    as in body_score. The scores are a step of their own, so each is computed once. The reasons that
    features alone give belong to that step: Spark plans array functions outside its whole-stage
    code, in methods small enough for the JVM to compile; all scores in one method are interpreted."""
    r = Region.of_columns()
    scores = {"table": table_score(r), "figure": figure_score(r), "body": body_score(r, column), "equation": equation_score(r)}
    scored = regions.withColumn(name, F.struct(*[_unit(s).alias(k) for k, s in scores.items()], _reasons_of_features(r).alias("seen")))
    pred, confidence, reasons = decide(r, F.col(name))
    return scored.withColumn(name, F.struct(*[F.col(f"{name}.{k}") for k in scores], pred.alias("pred"), confidence.alias("confidence"), reasons.alias("reasons")))


def _named(reasons: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for name, c in reasons]))


def _reasons_of_features(r: Region) -> Column:
    return _named([
        ("GRID_STRONG", r.grid >= 0.012), ("GRID_INTERSECTIONS", r.crossings >= 0.0008), ("LARGE_REGION", r.area >= 0.05), ("TEXT_DENSE", r.density >= 2.2), ("LOW_TEXT_DENSITY", r.density <= 1.2),
        ("HV_LINES_BALANCED", (r.line_h >= 0.004) & (r.line_v >= 0.004)),
    ])


def decide(r: Region, scores: Column) -> tuple[Column, Column, Column]:
    """Kind, confidence and reasons, those of the features (seen) first. Table needs no less than figure, both more than body; an
    equation more than the best of these and 0.62; a table without a strict grid yields to a figure
    of nearly its score, or to the body."""
    table, figure, body, equation = (scores[k] for k in ("table", "figure", "body", "equation"))
    best = F.greatest(body, table, figure)
    is_equation = (equation > best) & (equation >= F.greatest(F.lit(0.62), body - 0.04))
    is_table = ~is_equation & (table >= figure) & (table > body)
    strict = (r.crossings >= 0.00045) & (r.grid >= 0.011) & (r.weaker_line >= 0.0032)
    yields = is_table & ~strict & (figure >= F.greatest(F.lit(0.52), table - 0.08))
    is_figure = ~is_equation & (figure > table) & (figure > body) | yields & (figure >= body)
    pred = F.when(is_equation, "Equation").when(is_figure, "Figure").when(is_table & ~yields, "Table").otherwise("Body")
    confidence = F.when(is_equation, equation).when(yields & ~is_figure, body).when(yields, F.greatest(figure, body)).otherwise(best)
    reasons = F.concat(scores["seen"], _named([("EQUATION_LIKE", equation >= 0.66), ("TABLE_STRICT_CHECK", table >= F.greatest(F.lit(0.60), figure))]))
    return pred, confidence, reasons


def needs_review(r: Region, scores: Column) -> Column:
    """Sure tables that look like pictures with lines, and bodies that score as equations."""
    pred, sure = scores["pred"], scores["confidence"]
    picture = (pred == "Table") & (sure >= 0.80) & (r.area >= 0.045) & (r.w >= r.page_w * 0.26) & (r.h >= r.page_h * 0.08) & (r.grid >= 0.010) & (r.density <= 2.2) & (r.parts <= 85)
    formula = (pred == "Body") & (scores["equation"] >= 0.68) & (sure >= 0.70) & (r.grid <= 0.020) & (r.density <= 3.6) & (r.w >= r.page_w * 0.15) & (r.h >= r.page_h * 0.015)
    return picture | formula
