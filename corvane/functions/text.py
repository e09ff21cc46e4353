"""Text rules as column expressions: normalising, tokens, estimates, noise and headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
CJK = r"\x{4e00}-\x{9fff}"
TOKEN_RUN = r"[\x{4e00}-\x{9fff}]+|[\p{L}\p{N}_&&[^\x{4e00}-\x{9fff}]]+"
NUMBERED_HEADING = r"^\s*(?:[0-9]+(?:\.[0-9]+)*[.)]?|[IVX]+[.)])\s+\S"
SECTION_LABELS = [
    ("Abstract", r"\babstract\b|^摘要$"),
    ("Introduction", r"\bintroduction\b|\bbackground\b|^引言$"),
    ("Related Work", r"related work|literature review|相關研究"),
    ("Methods", r"\bmethod(?:s|ology)?\b|materials and methods|\bapproach\b|方法"),
    ("Results", r"\bresults?\b|\bexperiment(?:s|al)?\b|\bevaluation\b|結果"),
    ("Discussion", r"\bdiscussion\b|討論"),
    ("Conclusion", r"\bconclusions?\b|future work|結論"),
    ("References", r"\breferences?\b|\bbibliography\b|參考文獻"),
    ("Appendix", r"\bappendix\b|\bappendices\b|附錄"),
]
META_NOISE = r"(?i)\bimpact factor\b|\bquartile\b|\bcorresponding author\b|\bco-?author\b|\breporter\b|\bpublish institute\b|\b(open access|all rights reserved|copyright)\b|\bdoi\b|\bagenda\b|\bdepartment\b|影響因子|四分位|通訊作者|合著者|記者|開放獲取|版權"
CITATION_NEEDED = r"(?i)研究指出|文獻顯示|已被證實|previous studies|has been reported|\b[0-9]+(\.[0-9]+)?\s?%|\b(compared with|higher than|lower than|more than|less than)\b|\b(mechanism|pathway|mediated by|associated with)\b"
NON_EVIDENCE_TITLE = r"(?i)^\s*([0-9]+[.\s]*)*\s*(references?|bibliography|acknowledge?ments?)\s*$|uncovered\s+ocr"
POSITION_LABELS = [(0.12, "Abstract"), (0.35, "Introduction"), (0.62, "Methods"), (0.82, "Results"), (0.94, "Discussion")]
HEADING_TYPES = ["title", "maintitle", "subtitle", "subsubtitle", "heading", "section_title"]
TEMPLATE_TITLES = r"(?U)研究背景與動機|context\s*&\s*background|project background"
RETRYABLE = ["timeout", "timed out", "request failed after", "503", "429", "resource_exhausted", "quota throttle", "rate limit", "connection reset"]
# Eight crumbs as good as more; words end where ASCII ones do, and no group repeats without bound
# (Java recurses once a turn: a line of 2,000 crumbs would overflow an executor's stack).
CRUMBS = r"(?:(?<![A-Za-z0-9_])[A-Za-z]{1,2}(?![A-Za-z0-9_])[\s,;:\-|]*+){8}"
LATEX_WORDS = r"(?i)\b(sum|prod|frac|sqrt|alpha|beta|gamma|theta|lambda)\b"
STOP_WORDS = "the and for with from that this into using based study research analysis of in on to a an".split()


def squash(text: Column) -> Column:
    """White space runs become one space; trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def upper_simple(text: Column) -> Column:
    """Upper case by characters, as SQL has it: one that would become several (ß) stays."""
    whole = F.upper(text)
    each = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(c))
    return F.when(F.length(whole) == F.length(text), whole).otherwise(F.array_join(each, ""))


def clip(text: Column, n: int) -> Column:
    """At most n characters, else the prefix, right-trimmed, and three dots."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("...")))


def sanitize(text: Column) -> Column:
    """Without control characters, tab and line ends excepted."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def tokens(text: Column) -> Column:
    """Lower-cased words; a run of CJK becomes its character pairs, a single one stays.
    Words are looked at one by one only in texts that hold such a run."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_RUN), F.lit(0))
    cjk = F.lit(rf"^[{CJK}]{{2,}}$")
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.regexp_like(r, cjk), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))).otherwise(F.array(r))))
    return F.when(F.regexp_like(text, F.lit(f"[{CJK}]{{2}}")), pairs).otherwise(runs)


def chain_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and CJK of two characters or more, lower-cased."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[^a-zA-Z0-9{CJK}]+")
    return F.filter(parts, lambda t: F.length(t) >= 2)


def estimate_cjk(text: Column) -> Column:
    """int(1.5 per CJK character + 0.35 per other)."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit(f"[{CJK}]"))
    return F.floor(1.5 * cjk + 0.35 * (F.length(t) - cjk)).cast("long")


def estimate_exact(text: Column) -> Column:
    """estimate_cjk in twentieths: no token is lost where 0.35 a character is a whole number."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit(f"[{CJK}]")).cast("long")
    return F.floor((30 * cjk + 7 * (F.length(t) - cjk)) / 20).cast("long")


def estimate_quarter(text: Column) -> Column:
    """max(1, length // 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def estimate_provider(text: Column, output: int = 0, images: int = 0, per_image: int = 0) -> Column:
    """max(1, ceil(length / 3.6) + output + images)."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3.6) + output + images * per_image).cast("long")


def compact_identifier(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def identifier_variants(text: Column) -> Column:
    """The joined identifier and its parts, each of four characters or more."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(F.array_distinct(F.concat(F.array(compact_identifier(text)), parts)), lambda x: F.length(x) >= 4)


def query_key(query: Column) -> Column:
    """SHA-1 of the squashed lower-cased query."""
    return F.sha1(F.lower(squash(query)))


def normalize_metric_text(text: Column) -> Column:
    """Trimmed, lower-cased, white space squashed."""
    return F.lower(squash(text))


def character_error_rate(prediction: Column, truth: Column) -> Column:
    """Levenshtein distance over the length of the truth; an empty truth gives 0 or 1."""
    p, t = normalize_metric_text(prediction), normalize_metric_text(truth)
    return F.when(F.length(t) == 0, F.when(F.length(p) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(p, t) / F.length(t))


def average_error_rates(rates: DataFrame) -> DataFrame:
    """Means of cer and wer over all samples, 0 where there are none."""
    return rates.agg(F.count(F.lit(1)).alias("samples"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"average_{c}") for c in ("cer", "wer")])


def is_non_evidence_title(title: Column) -> Column:
    return F.regexp_like(F.coalesce(title, F.lit("")), F.lit(NON_EVIDENCE_TITLE))


def is_citation_needed(text: Column) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit(CITATION_NEEDED))


def bind(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value worked out once, however often it is named."""
    return F.transform(F.array(value), of)[0]


def low_information_line(t: Column) -> Column:
    """is_low_information of a squashed line."""
    keep = F.regexp_count(t, F.lit(f"[A-Za-z0-9{CJK}]"))
    letters = F.regexp_count(t, F.lit(f"[A-Za-z{CJK}]"))
    digits = F.regexp_count(t, F.lit(r"[0-9%#\-+./]"))
    return (F.length(t) < 24) | (keep < 0.48 * F.length(t)) | ((letters < 10) & (digits >= 10)) | F.regexp_like(t, F.lit(CRUMBS))


def meta_noise_line(t: Column) -> Column:
    """is_meta_noise of a squashed line. Long lines are let through before they are looked at."""
    words = F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z\-']+"), F.lit(0))

    def listed(w: Column) -> Column:
        capital = F.size(F.filter(w, lambda x: F.regexp_like(x, F.lit("^[A-Z]"))))
        letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        return (F.size(w) >= 8) & (capital >= 6) & (letters <= 10 * F.size(w))

    joins = F.regexp_count(t, F.lit(r"[,;]\s*[A-Za-z]"))
    names = (F.length(t) <= 220) & (joins >= 3) & bind(words, listed)
    return (F.length(t) == 0) | ((F.length(t) <= 240) & (F.regexp_like(t, F.lit(META_NOISE)) | names))


def is_low_information(text: Column) -> Column:
    """Too short, too few letters, mostly digits, or a chain of one- and two-letter tokens (C11)."""
    return bind(squash(text), low_information_line)


def is_meta_noise(text: Column) -> Column:
    """A line of boilerplate, or a list of capitalised names."""
    return bind(squash(text), meta_noise_line)


def normalize_heading(text: Column) -> Column:
    """Lower-cased, without a leading number or roman numeral."""
    return F.lower(F.trim(F.regexp_replace(squash(text), r"^(?:[0-9]+(?:\.[0-9]+)*[.)]?|[IVXivx]+[.)])\s+", "")))


def is_numbered_heading(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) <= 90) & F.regexp_like(t, F.lit(NUMBERED_HEADING))


def is_heading_like(text: Column, kind: Column | None = None) -> Column:
    """A heading type, a numbered short line, or a short line without a sentence end inside."""
    t = F.trim(F.coalesce(text, F.lit("")))
    short = (F.length(t) <= 90) & (F.size(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 0)) <= 14)
    plain = (F.length(t) > 0) & (is_numbered_heading(text) | (short & ~F.regexp_like(t, F.lit(r"[。！？!?]\s"))))
    return plain if kind is None else F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin(HEADING_TYPES) | plain


def section_label(text: Column) -> Column:
    """The first label whose pattern a heading contains, else empty."""
    norm = normalize_heading(text)
    out = F.lit("")
    for label, pattern in reversed(SECTION_LABELS):
        out = F.when(F.regexp_like(norm, F.lit(f"(?i){pattern}")), F.lit(label)).otherwise(out)
    return out


def is_section_anchor(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) > 0) & (F.length(t) <= 90) & (is_numbered_heading(text) | (section_label(text) != ""))


def label_by_position(page: Column, pages: Column) -> Column:
    """The label usual at a share of the document."""
    ratio = F.greatest(F.lit(1), F.coalesce(page, F.lit(1))) / F.greatest(F.lit(1), F.coalesce(pages, F.lit(1)))
    out = F.lit("Conclusion")
    for most, label in reversed(POSITION_LABELS):
        out = F.when(ratio <= most, F.lit(label)).otherwise(out)
    return out


def is_garbage_fragment(text: Column) -> Column:
    """Empty, or under 40 characters with brackets or mathematical signs, half short tokens, or
    under 6 letters (C18)."""
    def of(t: Column) -> Column:
        parts = F.filter(F.split(t, " "), lambda w: F.length(w) > 0)
        few = bind(parts, lambda p: 2 * F.size(F.filter(p, lambda w: F.length(w) <= 2)) >= F.size(p))
        symbols = F.regexp_like(t, F.lit(r"(?U)[=\[\]{}\\|^_]|\bdef\b|[∫∑∏]"))
        return (t == "") | (F.length(t) < 40) & (symbols | few | (F.regexp_count(t, F.lit(f"[A-Za-z{CJK}]")) < 6))

    return bind(squash(text), of)


def is_failed_equation(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | (t == "[Equation]") | t.contains("Failed to OCR Equation")


def looks_like_latex(text: Column) -> Column:
    """Backslash, script marks, operator beside a letter or digit, or a mathematical word."""
    t = F.trim(F.coalesce(text, F.lit("")))
    marks = F.regexp_like(t, F.lit(r"[\\^_{}]"))
    operator = F.regexp_like(t, F.lit(r"[=+\-*/<>]")) & F.regexp_like(t, F.lit("[A-Za-z0-9]"))
    return ~is_failed_equation(text) & ~t.isin("[Figure]", "[Table]") & (marks | operator | F.regexp_like(t, F.lit(LATEX_WORDS)))


def is_mostly_chinese(text: Column, threshold: float = 0.4) -> Column:
    """CJK characters over all that aren't white space."""
    t = F.coalesce(text, F.lit(""))
    visible = F.regexp_count(t, F.lit(r"\S"))
    return (visible > 0) & (F.regexp_count(t, F.lit(f"[{CJK}]")) >= threshold * visible)


def has_degenerate_repetition(text: Column) -> Column:
    """A run of 8 equal characters, or 6 turns of 2 to 4 characters that begin in the first
    2, 4 or 6 to 8 places of the second half (C29)."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    tail = F.substr(t, F.floor(F.length(t) / 2).cast("int") + 1)
    turns = [F.regexp_like(tail, F.lit(rf"(?sU)^.{{0,{2 * n - 1}}}(?!\s{{{n}}})(.{{{n}}})\1{{5}}")) for n in (2, 3, 4)]
    return F.regexp_like(t, F.lit(r"(?U)(\S)\1{7}")) | turns[0] | turns[1] | turns[2]


def is_noisy_summary(text: Column) -> Column:
    """60 characters or more, hardly any Chinese, and much English, citations or odd tokens."""
    t = squash(text)
    zh, en = F.regexp_count(t, F.lit(f"[{CJK}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    cites = F.regexp_count(t, F.lit(r"(?U)\[[0-9,\s]{1,20}\]"))
    weird = F.regexp_like(t, F.lit(r"[~_|]{2}|[A-Za-z]{28}"))
    return (F.length(t) >= 60) & (((zh <= 3) & (en >= 80)) | ((zh <= 5) & ((cites >= 2) | weird)))


def is_plausible_title(title: Column) -> Column:
    """3 to 260 characters, no placeholder or heading of a template, under two sentence ends, and
    no long list of clauses (C28)."""
    t = squash(title)
    ends, commas = F.regexp_count(t, F.lit(r"[。！？!?]")), F.regexp_count(t, F.lit(r"[，,；;]"))
    known = F.lower(t).isin("untitled", "unknown", "n/a") | F.regexp_like(F.lower(t), F.lit(TEMPLATE_TITLES))
    return F.length(t).between(3, 260) & ~known & (ends < 2) & ~((F.length(t) > 120) & (commas >= 8))


def is_mergeable_body(kind: Column, text: Column, noise: Column) -> Column:
    """Body text of 150 characters or more, or that ends a sentence."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (kind == "Body") & ~F.coalesce(noise, F.lit(False)) & ((F.length(t) >= 150) | F.regexp_like(t, F.lit(r"[.!?。！？]$")))


def search_keywords(topic: Column, most: int = 8) -> Column:
    """The squashed topic, then its words without stop words, distinct, at most eight."""
    clean = squash(topic)
    words = F.filter(F.split(F.lower(clean), rf"[^a-zA-Z0-9{CJK}]+"), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(F.concat(F.when(clean != "", F.array(clean)).otherwise(F.array().cast("array<string>")), words)), 1, most)


def matched_keywords(text: Column, words: Column, most: int = 2) -> Column:
    """Keywords in a text: ASCII words whole, others anywhere; at most two."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.filter(words, lambda k: (F.length(k) >= 2) & F.when(F.regexp_like(F.lower(k), F.lit("^[a-z0-9_]+$")), F.array_contains(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower(k))).otherwise(low.contains(F.lower(k))))
    return F.slice(hit, 1, most)


def overlap_jaccard(a: Column, b: Column) -> Column:
    """Words of four letters or more that two texts share, as a percentage of all, one decimal."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))) for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.round(100.0 * F.size(F.array_intersect(x, y)) / union, 1))


def has_high_overlap(a: Column, b: Column) -> Column:
    """One text within the other, or a word Jaccard of 0.6 or more."""
    x, y = F.lower(squash(a)), F.lower(squash(b))
    u, v = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | (F.size(F.array_intersect(u, v)) >= 0.6 * F.size(F.array_union(u, v))))


def retry_after_seconds(error: Column) -> Column:
    """The first number of seconds that an error names, else 0."""
    e = F.lower(F.coalesce(error, F.lit("")))
    found = [F.regexp_extract(e, p, 1) for p in (r"retry in ([0-9]+(?:\.[0-9]+)?)", r"retry[-_ ]?after[^0-9]{0,3}([0-9]+(?:\.[0-9]+)?)", r"retrydelay[^0-9]{0,6}([0-9]+(?:\.[0-9]+)?)")]
    return F.coalesce(*[F.expr("try_cast(NULL AS double)"), *[F.when(f != "", f.try_cast("double")) for f in found], F.lit(0.0)])


def is_retryable(error: Column) -> Column:
    """Whether an error names what may pass."""
    return F.regexp_like(F.lower(F.coalesce(error, F.lit(""))), F.lit("|".join(RETRYABLE)))


def is_daily_quota(error: Column) -> Column:
    """A quota error that names a day or a model of a project."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.regexp_like(e, F.lit("quota|429")) & F.regexp_like(e, F.lit("perday|per day|daily|perprojectpermodel"))
