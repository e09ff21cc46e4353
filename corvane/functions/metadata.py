"""Metadata of entries and papers from raw JSON of any spelling, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.biblio import blank, clean_authors, coerce_year


def _fields(raw: Column) -> Column:
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _first(fields: Column, *keys: str) -> Column:
    """The first of the keys that holds neither null, nor empty text, nor an empty list."""
    def given(k: str) -> Column:
        v = F.try_element_at(fields, F.lit(k))
        return F.when((v != "") & (F.regexp_replace(v, r"\s", "") != "[]"), v)

    return F.coalesce(*[given(k) for k in keys], F.lit(""))


def author_names(value: Column, *, parts: bool = True) -> Column:
    """Names of text parted by semicolons or 'and', or of a JSON list of texts or objects: literal
    or name, else family and given; without parts, name alone."""
    def name(x: Column) -> Column:
        of = {k: blank(F.get_json_object(x, f"$.{k}")) for k in ("literal", "name", "family", "given")}
        whole = F.coalesce(of["literal"], of["name"], F.concat_ws(", ", of["family"], of["given"])) if parts else F.coalesce(of["name"], F.lit(""))
        return F.trim(F.when(x.startswith("{"), whole).otherwise(F.coalesce(x, F.lit(""))))

    listed = F.filter(F.transform(F.from_json(value, "array<string>"), lambda x: name(x)), lambda x: x != "")
    return F.when(F.ltrim(value).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(clean_authors(value))


def looks_like_csl(raw: Column) -> Column:
    """Whether a JSON object has a field of CSL, or authors with family or literal names."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    authors = F.from_json(F.get_json_object(raw, "$.author"), "array<string>")
    named = F.exists(authors, lambda a: F.arrays_overlap(F.coalesce(F.json_object_keys(a), F.array().cast("array<string>")), F.array(F.lit("family"), F.lit("literal"))))
    return F.arrays_overlap(keys, F.array(F.lit("issued"), F.lit("container-title"), F.lit("DOI"))) | F.coalesce(named, F.lit(False))


def csl_to_raw(raw: Column) -> Column:
    """JSON of the fields that an entry is normalised from; the year is the first part of the
    first date (A25)."""
    get = lambda k: F.coalesce(F.get_json_object(raw, f"$['{k}']"), F.lit(""))
    year = F.coalesce(F.get_json_object(raw, "$.issued['date-parts'][0][0]"), F.lit(""))
    fields = {"title": get("title"), "authors": get("author"), "year": year, "venue": get("container-title"), "doi": get("DOI"), "url": get("URL"), "abstract": get("abstract")}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def entry_metadata(raw: Column) -> Column:
    """Fields of a library entry under one spelling, cut to 500, 300 and 4000 characters."""
    m = _fields(raw)
    year = F.coalesce(coerce_year(_first(m, "year", "publish_year", "publish_date", "issued")), F.lit(None).cast("int"))
    return F.struct(
        F.left(F.trim(_first(m, "title", "paper_title", "display_name")), F.lit(500)).alias("title"), author_names(_first(m, "authors", "author")).alias("authors"), year.alias("year"),
        F.left(F.trim(_first(m, "venue", "journal", "container_title", "container-title")), F.lit(300)).alias("venue"), F.trim(_first(m, "doi", "DOI")).alias("doi"), F.trim(_first(m, "url", "URL", "link")).alias("url"),
        F.left(F.trim(_first(m, "abstract")), F.lit(4000)).alias("abstract"), F.coalesce(_first(m, "citations").try_cast("int"), F.lit(0)).alias("citations"),
    )


def paper_metadata(raw: Column) -> Column:
    """Fields of a paper under one spelling; the year as text."""
    m = _fields(raw)
    year = F.coalesce(coerce_year(_first(m, "year", "publish_year", "published_year", "publish_date")).cast("string"), F.lit(""))
    plain = {"journal": ("journal", "container_title", "source"), "doi": ("doi", "DOI"), "url": ("url", "link"), "abstract": ("abstract",), "publisher": ("publisher",)}
    return F.struct(F.trim(_first(m, "title", "paper_title")).alias("title"), author_names(_first(m, "authors", "author"), parts=False).alias("authors"), year.alias("year"), *[F.trim(_first(m, *of)).alias(k) for k, of in plain.items()])
