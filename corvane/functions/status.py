"""States of papers and errors, media fields and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import squash as _squash

# Fixed values.
ERRORS = {"timeout": "timeout", "quota_exhausted": "quota", "missing_source": "source_missing", "cancelled": "cancelled"}
PROGRESS = {"idle": "waiting", "queued": "waiting", "running": "processing", "processing": "processing", "done": "ready", "completed": "ready", "failed": "failed", "error": "failed"}
MILESTONES = [("upload", 5), ("segment", 20), ("ocr", 45), ("arbitrate", 60), ("fuse", 75), ("summary", 90), ("ready", 100)]
ENGINE_CHARS = 20_000


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def classify_error(raw: Column) -> Column:
    """A stated kind, translation_incomplete for flowb_ errors, else failed."""
    r = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(r == "", F.lit(None).cast("string")).otherwise(F.coalesce(_mapped(r, ERRORS), F.when(r.startswith("flowb_"), "translation_incomplete").otherwise("failed")))


def progress_state(flow: Column) -> Column:
    return F.coalesce(_mapped(F.lower(F.trim(F.coalesce(flow, F.lit("")))), PROGRESS), F.lit("waiting"))


def milestones(done: Column) -> Column:
    """Stages with percentage and state, from the array of finished stages."""
    return F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(p).alias("pct"), F.array_contains(done, k).alias("done")) for k, p in MILESTONES])


def progress_percent(stages: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(stages, lambda m: m["done"]), lambda m: m["pct"])), F.lit(0))


def resolved_title(title: Column, filename: Column, paper_id: Column) -> Column:
    """The title unless it is just the file's or paper's name."""
    bare = lambda c: F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.[A-Za-z0-9]{1,5}$", ""))
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when((t != "") & ~bare(title).isin(bare(filename)) & (bare(title) != bare(paper_id)), t)


def sequence_parts(seq_id: Column) -> Column:
    """page and order of pN_type_M."""
    p = r"^p([0-9]+)_[A-Za-z]+_([0-9]+)$"
    s = F.coalesce(seq_id, F.lit(""))
    number = lambda k: F.regexp_extract(s, p, k).try_cast("int")
    return F.struct(number(1).alias("page"), number(2).alias("order"))


def caption(kind: Column, text: Column) -> Column:
    """From Figure n. or Table n: on, as the kind asks, at most 700 characters, else 420 of the
    whole text; white space squashed (I67)."""
    src = _squash(text)
    found = F.when(kind == "figure", F.regexp_extract(src, r"(?is)(Figure\s*\d+[.:]\s*.+)", 1)).when(kind == "table", F.regexp_extract(src, r"(?is)(Table\s*\d+[.:]\s*.+)", 1)).otherwise("")
    return F.when(found != "", F.substring(found, 1, 700)).otherwise(F.substring(src, 1, 420))


def image_type(data: Column) -> Column:
    """By the first bytes."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpg").when(h.startswith("47494638"), "gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")


def natural_key(name: Column) -> Column:
    """Sorts digits in names as numbers."""
    return F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]")), F.lpad(p, 20, "0")).otherwise(F.lower(p)))


def translation_engine(length: Column, context: Column, local_ready: Column) -> Column:
    """Cloud for study and for long texts, else local if there."""
    return F.when((context == "study") | (length > ENGINE_CHARS), "cloud").when(local_ready, "local").otherwise("cloud")


def wants_search(text: Column) -> Column:
    """Keyword hint that a user asks for literature."""
    return F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"找|搜尋|文獻|paper|search|literature|reference"))


def voxel_line(value: Column, x: Column, y: Column, z: Column, text: Column) -> Column:
    """Value clamped to 0..1 in front of its place and text."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))
    return F.format_string("[RPI: %.2f] (%s, %s, %s) %s", v, x, y, z, F.regexp_replace(F.coalesce(text, F.lit("")), "\n", "<br>"))


# Hosts that may be asked.
ALLOWED_HOSTS = ["api.crossref.org", "api.openalex.org", "export.arxiv.org", "eutils.ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "doi.org"]


def url_host(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port or brackets; else empty."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:@\[\]]*))", 2))


def is_private_address(address: Column) -> Column:
    """IPv4 addresses that are private, loopback, link-local, shared, reserved or multicast."""
    return F.regexp_like(F.coalesce(address, F.lit("")), F.lit(r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.(?:0\.[02]|168)\.|^198\.(?:1[89]\.|51\.100\.)|^203\.0\.113\.|^2(?:2[4-9]|[345]\d)\."))


def is_allowed_url(url: Column, hosts: list[str] = ALLOWED_HOSTS, addresses: Column | None = None) -> Column:
    """https and a host of the list; where its landed addresses are given, none of them private,
    and at least one (C46)."""
    ok = F.regexp_like(F.lower(F.trim(F.coalesce(url, F.lit("")))), F.lit("^https://")) & url_host(url).isin(hosts)
    return ok if addresses is None else ok & F.coalesce((F.size(addresses) > 0) & ~F.exists(addresses, is_private_address), F.lit(False))
