"""Column rules about layout blocks: kinds, equations, headings, best texts, refs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as T

# Kinds of textual blocks, words of headings, signs of mathematics, formats of refs.
TEXTUAL_KINDS = "title body text maintitle subtitle subsubtitle figurecaption tablecaption".split()
TITLE_KINDS = "title maintitle subtitle subsubtitle".split()
HEADINGS = r"(?i)^(?:Abstract|Introduction|Related Work|Background|Motivation|Preliminaries|Methods?|Materials and Methods|Approach|Model|Experiments?|Experimental Setup|Results?|Evaluation|Discussion|Conclusions?|Future Work|References|Bibliography|Acknowledge?ments?|Appendix|Data)\b"
MATH_SIGNS = r"\\(?:frac|sum|prod|alpha|beta|partial|mathbf|mathcal|arg|max|ln)|[=^_]"
PROSE_SIGNS = r"(?i)\b(?:therefore|portion of the total probability|paths going through)\b"
REF = r"^(?:p\d+-b\d+|summary\.json)$"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def is_unreliable_latex(latex: Column, confidence: Column, content: Column) -> Column:
    """Empty, of low confidence, text in disguise, or prose with few mathematical signs."""
    x, conf, t = T.squash(latex), F.coalesce(confidence, F.lit(0.0)), T.squash(content)
    words = F.regexp_count(F.regexp_replace(x, r"\\[A-Za-z]+", " "), F.lit("[A-Za-z]{3,}"))
    prose = F.regexp_like(t, F.lit(r"(?i)^From\s+\(\d+\)\s+we\s+can\s+see\b")) | (F.length(t) > 120) & F.regexp_like(t, F.lit(PROSE_SIGNS))
    return (x == "") | (conf > 0) & (conf < 0.6) | x.startswith("\\text{") & (conf < 0.8) | prose | (words >= 16) & (F.regexp_count(x, F.lit(MATH_SIGNS)) < 8)


def flow_kind(kind: Column, content: Column, noise: Column, is_equation: Column, hidden_header: Column) -> Column:
    """(kind, hidden, reason) of a block in the document's flow (C20)."""
    k = F.lower(_text(kind))
    k = F.when(k == "", "body").otherwise(k)

    def of(name: str, reason: str = "") -> Column:
        return F.struct(F.lit(name).alias("kind"), F.lit(bool(reason)).alias("hidden"), F.lit(reason).alias("reason"))

    yes = lambda c: F.coalesce(c, F.lit(False))
    out = F.when((k == "header") | yes(noise) | yes(hidden_header), of("noise", "page_noise")).when(k.isin(TITLE_KINDS), of("title"))
    out = out.when((k == "equation") | yes(is_equation), of("equation")).when(k == "figure", of("figure")).when(k == "table", of("table"))
    return out.when((k == "unknown") & T.is_garbage_fragment(content), of("noise", "ocr_fragment")).otherwise(of("body"))


def _flat(kind: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(kind, F.lit("")), "_", "")))


def is_textual_block(kind: Column, is_equation: Column, content: Column) -> Column:
    """No equation, and a textual kind, a caption, or any text out of figures and tables."""
    k = _flat(kind)
    return (k != "equation") & ~F.coalesce(is_equation, F.lit(False)) & (k.isin(TEXTUAL_KINDS) | k.contains("caption") | (_text(content) != "") & ~k.isin("figure", "table"))


def is_low_confidence_equation(kind: Column, is_equation: Column, failed: Column, confidence: Column, source: Column) -> Column:
    """An equation that failed, has confidence under 0.6, or comes of a fallback."""
    equation = (_flat(kind) == "equation") | F.coalesce(is_equation, F.lit(False))
    s = F.lower(F.coalesce(source, F.lit("")))
    return equation & (F.coalesce(failed, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < 0.6) | s.contains("fallback") | s.contains("failed"))


def retag_title(kind: Column, content: Column) -> Column:
    """Title for body or unknown blocks of at most 64 characters and 9 words that begin as
    headings do; else the kind (C35)."""
    s = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+|\s+$", "")
    heading = F.regexp_like(s, F.lit(r"^\d+(?:\.\d+)*\.?\s+[A-Z]")) | F.regexp_like(s, F.lit(HEADINGS))
    return F.when(kind.isin("Body", "Unknown") & (s != "") & (F.length(s) <= 64) & (F.regexp_count(s, F.lit(r"(?U)\S+")) <= 9) & heading, F.lit("Title")).otherwise(kind)


def best_block_text(zh: Column, en: Column) -> Column:
    """(text, lang): Chinese unless it says little, else English, else the longer."""
    z, e = T.squash(zh), T.squash(en)
    of = lambda c, lang: F.struct(c.alias("text"), F.lit(lang).alias("lang"))
    return F.when((z != "") & ~T.is_low_information(z), of(z, "zh")).when((e != "") & ~T.is_low_information(e), of(e, "en")).when(F.length(z) >= F.length(e), of(z, "zh")).otherwise(of(e, "en"))


def best_reading(b_text: Column, b_score: Column, a_text: Column, a_score: Column) -> Column:
    """(text, source, score) of the reader with the higher score, the second on a tie; readings
    without text are left out (G13, and G14 with LaTeX and confidence)."""
    def of(text: Column, source: str, score: Column, number: int) -> Column:
        s = F.coalesce(score, F.lit(0.0))
        return F.when(_text(text) != "", F.struct(s.alias("score"), F.lit(number).alias("n"), _text(text).alias("text"), F.lit(source).alias("source")))

    best = F.array_max(F.array_compact(F.array(of(b_text, "stack_b", b_score, 1), of(a_text, "stack_a", a_score, 0))))
    return F.struct(F.coalesce(best["text"], F.lit("")).alias("text"), F.coalesce(best["source"], F.lit("")).alias("source"), F.coalesce(best["score"], F.lit(0.0)).alias("score"))


def normalize_refs(refs: Column, most: int = 128) -> Column:
    """Valid refs of a list, distinct in order of first appearance, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.transform(refs, _text), lambda r: F.regexp_like(r, F.lit(REF)))), 1, most)


def fixed_is_compatible(raw_ids: Column, raw_size: Column, fixed_ids: Column, fixed_size: Column) -> Column:
    """Whether corrected blocks can replace a page's: the same ids where both have them, else no
    fewer blocks (D19)."""
    both = (F.size(raw_ids) > 0) & (F.size(fixed_ids) > 0)
    same = (F.size(raw_ids) == F.size(fixed_ids)) & (F.array_sort(F.array_distinct(raw_ids)) == F.array_sort(F.array_distinct(fixed_ids)))
    return F.when(fixed_size == 0, False).when(raw_size == 0, True).when(both, same).otherwise(fixed_size >= raw_size)


def triple_score(similarity: Column, confidence: Column) -> Column:
    """0.7 of the cosine and 0.3 of the confidence, six decimals."""
    return F.round(0.7 * similarity + 0.3 * F.coalesce(confidence, F.lit(0.0)), 6)
