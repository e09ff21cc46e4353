"""Bibliographic rules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import squash

# Fixed values.
SOURCE_WEIGHTS = {"crossref": 1.0, "openalex": 1.0, "arxiv": 0.9, "pubmed": 1.0}
OTHER_SOURCE = 0.7


def blank(c: Column) -> Column:
    """Null for null, empty or white space."""
    t = F.trim(c)
    return F.when(t != "", t)


def normalize_doi(raw: Column) -> Column:
    """Without resolver and trailing punctuation; empty unless it is a DOI."""
    d = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    d = F.regexp_replace(F.trim(d), r"[.,;)]+$", "")
    return F.when(F.regexp_like(d, F.lit(r"^10\.[0-9]{4,9}/\S+$")), d).otherwise("")


def coerce_year(value: Column) -> Column:
    """The first year of 18dd to 21dd in a value."""
    return F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), "((?:18|19|20|21)[0-9]{2})", 1).try_cast("int")


def normalize_year(value: Column) -> Column:
    """A whole number from 1800 to 3000, else null."""
    y = F.trim(value.cast("string")).try_cast("int")
    return F.when(y.between(1800, 3000), y)


def clean_authors(value: Column) -> Column:
    """A list of names from text parted by semicolons or 'and' (I50)."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r";|, and | and "), lambda a: F.trim(a)), lambda a: a != "")


def canonical_url(doi: Column, url: Column) -> Column:
    """The DOI's address, else the url with https."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(blank(doi).isNotNull(), F.concat(F.lit("https://doi.org/"), F.trim(doi))).otherwise(F.regexp_replace(u, "^http://", "https://"))


def title_key(title: Column, n: int) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\W+", ""), 1, n)


def candidate_key(doi: Column, title: Column) -> Column:
    """doi:… or title:… of 120 characters."""
    d = F.lower(F.trim(F.coalesce(doi, F.lit(""))))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).otherwise(F.concat(F.lit("title:"), title_key(title, 120)))


def entry_key(doi: Column, title: Column) -> Column:
    """lib- and 12 digits of a SHA-1; null where both are empty."""
    d, t = F.lower(F.trim(F.coalesce(doi, F.lit("")))), title_key(title, 200)
    raw = F.when(d != "", F.concat(F.lit("doi:"), d)).when(t != "", F.concat(F.lit("title:"), t))
    return F.concat(F.lit("lib-"), F.substring(F.sha1(raw), 1, 12))


def scout_key(doi: Column, title: Column) -> Column:
    """As candidate_key, titles by a-z and 0-9 alone."""
    d = F.lower(F.trim(F.coalesce(doi, F.lit(""))))
    t = F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", ""), 1, 120)
    return F.when(d != "", F.concat(F.lit("doi:"), d)).otherwise(F.concat(F.lit("title:"), t))


def completeness(title: Column, authors: Column, year: Column, doi: Column, url: Column) -> Column:
    """Share of title, authors, year, link that are there."""
    flags = [blank(title).isNotNull(), F.size(authors) > 0, year.isNotNull(), blank(doi).isNotNull() | blank(url).isNotNull()]
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0)) / 4.0


def candidate_score(text: Column, terms: Column, source: Column, citations: Column, year: Column, complete: Column, as_of_year: int) -> Column:
    """Weighted score of a candidate as a struct of its parts, four decimals."""
    low = F.lower(text)
    keyword = F.size(F.filter(terms, lambda t: low.contains(F.lower(t)))) / F.greatest(F.size(terms), F.lit(1))
    weight = F.lit(OTHER_SOURCE)
    for name, w in SOURCE_WEIGHTS.items():
        weight = F.when(F.lower(source) == name, F.lit(w)).otherwise(weight)
    cited = F.least(F.log1p(F.coalesce(citations, F.lit(0))) / 6.0, F.lit(1.0))
    recent = F.when(year.isNull(), 0.4).otherwise(F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), F.lit(as_of_year) - year) / 20.0))
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * keyword + 0.25 * weight + 0.20 * cited + 0.10 * recent + 0.10 * complete))
    return F.struct(*[F.round(c, 4).alias(n) for n, c in (("keyword", keyword), ("source", weight), ("citation", cited), ("recency", recent), ("completeness", complete), ("final", final))])


def apa_authors(authors: Column) -> Column:
    """One name, two joined by &, or the first and et al.."""
    n = F.size(authors)
    one = F.try_element_at(authors, F.lit(1))
    return F.when(n <= 0, "Unknown").when(n == 1, one).when(n == 2, F.concat(one, F.lit(" & "), F.try_element_at(authors, F.lit(2)))).otherwise(F.concat(one, F.lit(" et al.")))


def apa_citation(authors: Column, year: Column, title: Column, venue: Column, doi: Column, url: Column) -> Column:
    """authors (year). title. venue. link."""
    head = F.concat(apa_authors(authors), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")."))
    name = F.concat(F.regexp_replace(F.coalesce(blank(title), F.lit("Untitled")), r"\.+$", ""), F.lit("."))
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), blank(doi)), blank(url))
    return F.concat_ws(" ", head, name, F.concat(blank(venue), F.lit(".")), link)


def citation_key(authors: Column, year: Column, title: Column) -> Column:
    """Last name, year and three words of the title."""
    first = F.lower(F.element_at(F.split(F.coalesce(F.try_element_at(authors, F.lit(1)), F.lit("unknown")), r"\s+"), -1))
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, 3)
    key = F.regexp_replace(F.concat(first, F.coalesce(year.cast("string"), F.lit("nd")), F.array_join(words, "")), "[^a-z0-9_:-]", "")
    return F.when(key != "", key).otherwise("ref")


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\{}])", r"\\$1")


def bibtex_entry(authors: Column, year: Column, title: Column, journal: Column, doi: Column, url: Column) -> Column:
    """An @article; null where every field is empty."""
    names = F.when(F.size(authors) > 0, F.array_join(F.transform(authors, _escape), " and "))
    fields = [("title", _escape(blank(title))), ("author", names), ("year", year.cast("string")), ("journal", _escape(blank(journal))), ("doi", blank(doi)), ("url", blank(url))]
    lines = F.concat_ws(",\n", *[F.concat(F.lit(f"  {k} = {{"), v, F.lit("}")) for k, v in fields])
    return F.when(lines != "", F.concat(F.lit("@article{"), citation_key(authors, year, title), F.lit(",\n"), lines, F.lit("\n}")))


def ris_entry(authors: Column, year: Column, title: Column, journal: Column, doi: Column, url: Column) -> Column:
    """A journal record, one tag a line."""
    tag = lambda k, v: F.concat(F.lit(f"{k}  - "), v)
    names = F.when(F.size(authors) > 0, F.array_join(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    return F.concat_ws("\n", F.lit("TY  - JOUR"), tag("TI", blank(title)), names, tag("PY", year.cast("string")), tag("JO", blank(journal)), tag("DO", blank(doi)), tag("UR", blank(url)), F.lit("ER  - "))


def csl_json(authors: Column, year: Column, title: Column, journal: Column, doi: Column, url: Column) -> Column:
    """An article-journal object without empty keys."""
    item = F.struct(
        F.lit("article-journal").alias("type"), citation_key(authors, year, title).alias("id"), blank(title).alias("title"),
        F.when(F.size(authors) > 0, F.transform(authors, lambda a: F.struct(a.alias("literal")))).alias("author"),
        F.when(year.isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts"))).alias("issued"),
        blank(journal).alias("container-title"), blank(doi).alias("DOI"), blank(url).alias("URL"),
    )
    return F.to_json(item)


def parse_version(text: Column) -> Column:
    """Tenths of a version such as V1.2, else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    whole, part = F.regexp_extract(t, r"^[vV]?([0-9]+)(?:\.([0-9]))?$", 1), F.regexp_extract(t, r"^[vV]?([0-9]+)(?:\.([0-9]))?$", 2)
    return F.when(whole != "", whole.cast("int") * 10 + F.when(part != "", part.cast("int")).otherwise(0))


def format_version(tenths: Column) -> Column:
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def clamp_percent(value: Column) -> Column:
    """0 to 100 from a number or text such as 80%, halves to even; null if it is none."""
    v = F.regexp_replace(F.trim(value.cast("string")), "%$", "").try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)
    return F.when(ok, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(v).cast("long")))).cast("int")


def inverted_index_text(index: Column) -> Column:
    """Words placed at their positions, joined by spaces (A20); index: map<string, array<int>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return squash(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))
