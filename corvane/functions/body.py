"""What a region that is no figure, table or caption of a page is: a cascade on one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.regions import Region

# Names of headings; all limits below are such that results depend on them.
HEADING_HINTS = ["MainTitle", "Subtitle", "SubSubtitle"]


def body_phase(r: Region, table: Column, figure: Column, body: Column, equation: Column, column: Column, page_num: Column, rejected: Column, label: Column, label_confidence: Column, heading: Column, reasons: Column) -> Column:
    """struct(type, is_page_noise, type_confidence, reasons) of a region.

    The first of: equation by a label or score; running header from page 2 on; heading by a hint;
    small heading; figure or table that was rejected for want of a caption (Unknown); main title;
    section heading; else Body. Null scores are 0, a null column is full, null reasons are none."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    table, figure, body, equation, sure = map(zero, (table, figure, body, equation, label_confidence))
    lost = F.coalesce(rejected, F.lit(False))
    share_w, share_h = (lambda x: F.floor(r.page_w * x)), (lambda x: F.floor(r.page_h * x))

    def not_major(least: float, over: float) -> Column:
        limit = F.greatest(F.lit(least), body + over)
        return (table < limit) & (figure < limit)

    forced = F.coalesce(label == "Equation", F.lit(False)) & (sure >= 0.70) & (r.w >= share_w(0.10)) & (r.h >= share_h(0.014))
    like_equation = (equation >= F.greatest(F.lit(0.68), body - 0.04)) & (r.grid <= 0.022) & (r.crossings <= 0.00065) & (r.w >= share_w(0.14)) & (r.h >= share_h(0.016))
    header = (F.coalesce(page_num, F.lit(0)) >= 2) & (r.y1 <= share_h(0.06)) & (r.h <= share_h(0.035)) & (r.w <= share_w(0.70))
    hinted = F.coalesce(heading.isin(HEADING_HINTS), F.lit(False)) & (sure >= 0.70)
    small = (r.h >= F.greatest(F.lit(18), share_h(0.009))) & (r.h <= share_h(0.032)) & (r.w >= share_w(0.04)) & (r.w <= share_w(0.26)) & (r.y1 <= share_h(0.60)) & (r.x1 >= share_w(0.05)) & (r.x2 <= share_w(0.95)) & (r.density <= 1.95) & (r.parts <= 78) & not_major(0.68, 0.03)
    demoted = lost & (F.greatest(table, figure) >= F.greatest(F.lit(0.72), body + 0.04))
    title = F.coalesce(column, F.lit("full")).isin("full", "span", "") & (r.y1 <= share_h(0.18)) & (r.h <= share_h(0.10)) & (r.h >= F.greatest(F.lit(34), share_h(0.025))) & (r.w >= share_w(0.52)) & (r.density <= 2.40) & not_major(0.70, 0.02)
    section = (r.h >= F.greatest(F.lit(22), share_h(0.015))) & (r.h <= share_h(0.045)) & (r.w >= share_w(0.16)) & (r.w <= share_w(0.42)) & (r.x1 <= share_w(0.62)) & (r.y1 <= share_h(0.80)) & (r.density <= 1.95) & (r.parts <= 95) & not_major(0.70, 0.03)
    is_sub = r.h >= F.greatest(F.lit(30), share_h(0.022))

    def rule(kind: Column | str, confidence: Column, *codes: Column | str) -> Column:
        named = F.array_compact(F.array(*[c if isinstance(c, Column) else F.lit(c) for c in codes]))
        return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), confidence.alias("confidence"), named.alias("codes"))

    at_least = lambda x: F.greatest(body, F.lit(x))
    picked = (
        F.when(forced | like_equation, rule("Equation", F.greatest(body, equation, sure * 0.95, F.lit(0.70)), "EQUATION_FALLBACK_PROMOTE", F.when(forced, "LLM_FORCE_EQUATION")))
        .when(header, rule("Header", at_least(0.70), "RUNNING_HEADER_ZONE")).when(hinted, rule(heading, F.greatest(body, sure * 0.95, F.lit(0.72)), "LLM_HEADING_PROMOTE"))
        .when(small, rule("Subtitle", at_least(0.73), "SMALL_HEADING_ZONE"))
        .when(demoted, rule("Unknown", F.greatest(F.lit(0.52), F.least(F.lit(0.78), F.greatest(table, figure) * 0.82)), "DEMOTE_TO_UNKNOWN_NO_CAPTION"))
        .when(title, rule("MainTitle", at_least(0.78), "HEADER_ZONE")).when(section, rule(F.when(is_sub, "Subtitle").otherwise("SubSubtitle"), at_least(0.70), "SECTION_HEADING"))
        .otherwise(rule("Body", body, F.lit(None).cast("string"))))
    given = F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    codes = F.array_sort(F.array_distinct(F.concat(given, F.when(lost, F.array(F.lit("CAPTION_REQUIRED_FAIL_DEMOTE"))).otherwise(F.array().cast("array<string>")), picked["codes"])))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), picked["confidence"])), 4)
    return F.struct(picked["type"].alias("type"), (picked["type"] == "Header").alias("is_page_noise"), confidence.alias("type_confidence"), codes.alias("reasons"))
