"""Boxes as four columns x0, y0, x1, y1 of an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sides(box: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4))


def _inter(a: tuple, b: tuple) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def _area(a: tuple) -> Column:
    return F.greatest(F.lit(0), a[2] - a[0]) * F.greatest(F.lit(0), a[3] - a[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where a box has no area or fewer than four numbers."""
    x, y = _sides(a), _sides(b)
    inter = _inter(x, y)
    union = _area(x) + _area(y) - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def iou_swapped(a: Column, b: Column) -> Column:
    """As iou, corners put in order first."""
    def sort(s):
        return F.least(s[0], s[2]), F.least(s[1], s[3]), F.greatest(s[0], s[2]), F.greatest(s[1], s[3])

    x, y = sort(_sides(a)), sort(_sides(b))
    inter = _inter(x, y)
    union = _area(x) + _area(y) - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def iou_floor(a: Column, b: Column) -> Column:
    """As iou on whole numbers with every area at least 1."""
    x, y = ([F.floor(v).cast("long") for v in _sides(s)] for s in (a, b))
    inter = _inter(x, y)
    return F.coalesce(inter / F.greatest(F.lit(1), F.greatest(F.lit(1), _area(x)) + F.greatest(F.lit(1), _area(y)) - inter), F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    x, y = _sides(a), _sides(b)
    return F.coalesce(_inter(x, y) / F.greatest(F.lit(1), F.least(_area(x), _area(y))), F.lit(0.0))


def center_inside(small: Column, big: Column) -> Column:
    """Whether the centre of one box lies in another, edges included."""
    s, b = _sides(small), _sides(big)
    cx, cy = (s[0] + s[2]) / 2.0, (s[1] + s[3]) / 2.0
    return F.coalesce((b[0] <= cx) & (cx <= b[2]) & (b[1] <= cy) & (cy <= b[3]), F.lit(False))


def frame(box: Column) -> Column:
    """Sides, area and centre of a box as doubles, for functions that compare a box with many; null
    where it has fewer than four numbers."""
    s = [v.cast("double") for v in _sides(box)]
    fields = {"x0": s[0], "y0": s[1], "x1": s[2], "y1": s[3], "area": _area(s), "cx": (s[0] + s[2]) / 2.0, "cy": (s[1] + s[3]) / 2.0}
    return F.when(F.size(box) >= 4, F.struct(*[v.alias(k) for k, v in fields.items()]))


def overlaps(a: Column, b: Column, share: float) -> Column:
    """Whether iou of two frames is above a share of at least 0; false or null where not."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    union = a["area"] + b["area"] - w * h
    return (w > 0) & (h > 0) & F.when(union > 0, w * h / union > share)


def holds_center(big: Column, small: Column) -> Column:
    """center_inside of two frames; false or null where not."""
    return (big["x0"] <= small["cx"]) & (small["cx"] <= big["x1"]) & (big["y0"] <= small["cy"]) & (small["cy"] <= big["y1"])


def column_id(box: Column, page_width: Column, split: Column, half_gutter: Column) -> Column:
    """left, right, span or full (I34). On a page of two columns, by the gutter about split; where
    split is null, only boxes of at most 0.48 of the width that end or begin near the middle are
    left or right. Boxes without a width or four numbers are full."""
    s = [F.floor(v) for v in _sides(box)]
    two = F.when(s[2] <= split - half_gutter, "left").when(s[0] >= split + half_gutter, "right").otherwise("span")
    narrow = (s[2] - s[0]) / F.greatest(F.lit(1), page_width) <= 0.48
    one = F.when(narrow & (s[2] <= F.floor(page_width * 0.54)), "left").when(narrow & (s[0] >= F.floor(page_width * 0.46)), "right").otherwise("full")
    return F.when(s[3].isNull() | F.coalesce(s[2] <= s[0], F.lit(True)), "full").when(split.isNotNull(), two).otherwise(one)


def block_score(score: Column, type_confidence: Column) -> Column:
    """A positive score clamped to 1, else 0.85 of the type's confidence within 0.35 to 0.88."""
    s = F.coalesce(score, F.lit(0.0))
    fallback = F.when(type_confidence > 0, F.least(F.lit(0.88), F.greatest(F.lit(0.35), 0.85 * type_confidence))).otherwise(0.35)
    return F.when(s > 0, F.least(s, F.lit(1.0))).otherwise(fallback)


def decide_content(kind: Column, a: Column, score_a: Column, b: Column, score_b: Column, margin: float = 0.10) -> Column:
    """Which reader's text a block gets, and why: struct(content, source)."""
    from corvane.functions.text import is_failed_equation, looks_like_latex

    def take(text: Column, source: str) -> Column:
        return F.struct(text.alias("content"), F.lit(source).alias("source"))

    use_a, use_b = take(a, "stack_a"), take(b, "stack_b_override")
    bad_a, bad_b, tex_a, tex_b = is_failed_equation(a), is_failed_equation(b), looks_like_latex(a), looks_like_latex(b)
    n_a, n_b = F.length(a), F.length(b)
    equation = (
        F.when(bad_a & ~bad_b, use_b).when(bad_b & ~bad_a, use_a).when(bad_a & bad_b, take(F.lit("<Failed to OCR Equation>"), "equation_failed"))
        .when(tex_a & tex_b, F.when(score_b > score_a + 0.10, use_b).otherwise(use_a)).when(tex_b, use_b).when(tex_a, use_a)
        .when((n_b > n_a) & (score_b > score_a + 0.20), use_b).otherwise(use_a)
    )
    other = (
        F.when((((n_a < 3) & (n_b > 3)) | a.isin("[Figure]", "[Table]")) & (n_b > 0), use_b)
        .when((score_b > score_a + margin) & (n_b >= F.greatest(F.lit(3), F.floor(n_a * 0.85))), use_b)
        .when(kind.isin("Figure", "Table") & (n_b > n_a), use_b).otherwise(use_a)
    )
    return F.when(kind == "Equation", equation).otherwise(other)
