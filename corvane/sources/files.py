"""Readers of landed files: papers by folder, chat sessions, predictions, references, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.biblio import inverted_index_text

# Folders that hold no paper.
SYSTEM_FOLDERS = ["literature", "manuscript", "study", "paq", "chat", "context_chain", "notes"]
CROSSREF = "DOI string, URL string, title array<string>, author array<struct<family string, given string>>, issued struct<`date-parts` array<array<int>>>, `container-title` array<string>, abstract string, `is-referenced-by-count` long"
OPENALEX = "doi string, display_name string, publication_year int, cited_by_count long, authorships array<struct<author struct<display_name string>>>, abstract_inverted_index map<string, array<int>>"


def paths(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder with its size; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def paper_folders(files: DataFrame) -> DataFrame:
    """(pid, paper_id, path, layout) of <pid>/literature/papers/* and, where that has no paper of
    the name, of <pid>/* with 00_origins (A01, A02)."""
    new = files.select(F.regexp_extract("path", r"^(.*?/([^/]+)/literature/papers/([^/]+))/", 1).alias("path"), F.regexp_extract("path", r"/([^/]+)/literature/papers/([^/]+)/", 1).alias("pid"), F.regexp_extract("path", r"/literature/papers/([^/]+)/", 1).alias("paper_id")).where("path <> ''")
    old = files.select(F.regexp_extract("path", r"^(.*/[^/]+/[^/]+)/00_origins/", 1).alias("path"), F.regexp_extract("path", r"/([^/]+)/([^/]+)/00_origins/", 1).alias("pid"), F.regexp_extract("path", r"/([^/]+)/00_origins/", 1).alias("paper_id")).where("path <> '' AND path NOT LIKE '%/literature/papers/%'")
    ok = ~F.substring("paper_id", 1, 1).isin(".", "_") & ~F.col("paper_id").isin(SYSTEM_FOLDERS)
    new, old = new.where(ok).distinct().withColumn("layout", F.lit("new")), old.where(ok).distinct().withColumn("layout", F.lit("legacy"))
    return new.unionByName(old.join(new.select("pid", "paper_id"), ["pid", "paper_id"], "left_anti"))


def artifact_quality(files: DataFrame) -> DataFrame:
    """gold, silver or bronze of each paper by the artifacts it has."""
    folder = F.regexp_extract("path", r"^(.*/papers/[^/]+)/", 1)
    g = files.groupBy(folder.alias("paper")).agg(*[F.max(F.col("path").rlike(p).cast("int")).alias(n) for n, p in (("summary", r"/summary\.json$"), ("translated", r"/translated[^/]*\.json$"), ("fused", r"/full_text\.json$"), ("raw", r"/text_[0-9]+_(?:raw|fixed)\.json$"))])
    return g.where("paper <> ''").withColumn("quality", F.when(F.col("summary") + F.col("translated") == 2, "gold").when(F.col("fused") == 1, "silver").when(F.col("raw") == 1, "bronze").otherwise("empty"))


def stage_pages(files: DataFrame, suffix: str, least_bytes: int = 100) -> DataFrame:
    """Page numbers of text_N_*suffix files of some size (A34), and of page_N images."""
    n = F.coalesce(F.nullif(F.regexp_extract("path", rf"/text_([0-9]+)_[^/]*{suffix}$", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"/page_([0-9]+)\.(?:jpg|jpeg|png)$", 1), F.lit("")))
    return files.where(F.col("length") > least_bytes).select(n.cast("int").alias("page")).where("page IS NOT NULL").distinct()


def pages_to_blocks(documents: DataFrame) -> DataFrame:
    """content[].blocks[] as rows (A04). documents: paper_id, content."""
    p = documents.select("paper_id", F.posexplode("content").alias("page_index", "p"))
    return p.select("paper_id", F.col("p.page").alias("page"), F.posexplode("p.blocks").alias("block_index", "b")).select("paper_id", "page", "block_index", "b.*")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, whole; one that doesn't parse is a row with quality error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return raw.withColumn("doc", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("quality", F.when(F.try_parse_json("value").isNull(), "error").otherwise("ok")).drop("value")


def chat_records(spark: SparkSession, path: str, schema: str, limit: int = 40) -> DataFrame:
    """The last records of session files, whose names sort by time (A10, A11); limit 1 to 60."""
    docs = read_documents(spark, path, f"array<struct<{schema}>>").where("doc IS NOT NULL")
    rows = docs.select("path", F.posexplode("doc").alias("i", "r"))
    n = F.row_number().over(Window.orderBy(F.col("path").desc(), F.col("i").desc()))
    return rows.withColumn("n", n).where(F.col("n") <= max(1, min(60, limit))).orderBy(F.col("n").desc()).select("r.*")


def prediction_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Ground truth *.gt.txt with the first of .pred.txt, .txt, .ocr.txt; missing is empty."""
    raw = spark.read.text(root, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.gt|\.pred|\.ocr)?\.txt$", 1).alias("sample"), F.regexp_extract("_metadata.file_name", r"(\.gt|\.pred|\.ocr)?\.txt$", 1).alias("kind"), "value")
    rank = F.when(F.col("kind") == ".pred", 0).when(F.col("kind") == "", 1).otherwise(2)
    best = raw.where("kind <> '.gt'").groupBy("sample").agg(F.min_by("value", rank).alias("prediction"))
    return raw.where("kind = '.gt'").select("sample", F.col("value").alias("truth")).join(best, "sample", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def crossref_papers(raw: DataFrame, value: str = "value") -> DataFrame:
    """Landed items of one reference service as candidates."""
    i = raw.select(F.from_json(value, CROSSREF).alias("i")).select("i.*")
    names = F.transform(F.slice(F.coalesce("author", F.array().cast("array<struct<family:string,given:string>>")), 1, 8), lambda a: F.concat_ws(", ", a["family"], a["given"]))
    return i.select(F.col("title")[0].alias("title"), names.alias("authors"), F.col("issued")["date-parts"][0][0].alias("year"), F.col("DOI").alias("doi"), F.when(F.col("DOI").isNotNull(), F.concat(F.lit("https://doi.org/"), "DOI")).otherwise(F.col("URL")).alias("url"), F.col("container-title")[0].alias("venue"), F.col("is-referenced-by-count").alias("citations"), F.lit("crossref").alias("source"))


def openalex_papers(raw: DataFrame, value: str = "value") -> DataFrame:
    """Landed items of another, abstracts rebuilt from their index."""
    i = raw.select(F.from_json(value, OPENALEX).alias("i")).select("i.*")
    return i.select(F.col("display_name").alias("title"), F.slice(F.transform("authorships", lambda a: a["author"]["display_name"]), 1, 8).alias("authors"), F.col("publication_year").alias("year"), F.regexp_replace("doi", r"^https?://doi\.org/", "").alias("doi"), inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"), F.col("cited_by_count").alias("citations"), F.lit("openalex").alias("source"))


def arxiv_papers(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed Atom files."""
    e = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string, published string, author array<struct<name string>>").load(path)
    return e.select(F.trim("title").alias("title"), F.transform("author", lambda a: a["name"]).alias("authors"), F.substring("published", 1, 4).try_cast("int").alias("year"), F.col("id").alias("url"), F.trim("summary").alias("abstract"), F.lit("arXiv").alias("venue"), F.lit("arxiv").alias("source"))


def log_tail(spark: SparkSession, path: str, n: int = 120) -> DataFrame:
    """The last 1 to 1000 lines of a log."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("i"))
    return rows.orderBy(F.col("i").desc()).limit(max(1, min(1000, n))).orderBy("i").select("value")


def append_events(events: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    events.write.mode("append").json(path)


def write_entries(entries: DataFrame, path: str, column: str = "entry", gap: str = "\n\n") -> None:
    """Export text, entries parted by a gap."""
    entries.select(F.col(column).alias("value")).write.option("lineSep", gap).text(path)


SEGMENT = "seq_id string, type string, page int, pair_id string, bbox array<int>, png_path string, caption_text string, caption string, has_caption boolean, caption_bbox array<int>"


def segmentation_records(spark: SparkSession, path: str) -> DataFrame:
    """(pid, paper_id, pos, fields of SEGMENT) from projects' <pid>_vns.json files, whole and over
    several lines: papers is a map of ids to records (A35). A file that doesn't parse, and papers
    without records, give no rows."""
    docs = read_documents(spark, path, f"struct<papers: map<string, struct<records: array<struct<{SEGMENT}>>>>>")
    papers = docs.select(F.regexp_extract("path", r"([^/]+)_vns\.json$", 1).alias("pid"), F.explode("doc.papers").alias("paper_id", "p"))
    return papers.select("pid", "paper_id", F.posexplode("p.records").alias("pos", "r")).where("r IS NOT NULL").select("pid", "paper_id", "pos", "r.*")
