"""Figures, tables and equations of papers with what sidecar files add to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import blocks as K
from corvane.functions import status as S

# Kinds of media and their names in records.
KINDS = {"figure": "Figure", "table": "Table", "equation": "Equation"}
_LAST = 999_999
FIELDS = ["type", "page", "pair_id", "bbox", "png_path", "caption_text", "has_caption", "caption_bbox"]


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _locked(has: Column, box: Column) -> Column:
    """Whether a caption has been paired."""
    return F.coalesce(has, F.lit(False)) | F.coalesce(F.size(box) >= 4, F.lit(False))


def _some(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(_text(o), F.lit("")) for o in options], F.lit(""))


def media_gallery(records: DataFrame, sidecars: DataFrame, images: DataFrame, kind: str) -> DataFrame:
    """The media of one kind of all papers, in order.

    records: pid, paper_id, pos, seq_id, caption and FIELDS; sidecars: pid, name, paper_id, seq_id,
    FIELDS and ocr (b_text, b_score, a_text, a_score); images: pid, name, path. Sidecars and images
    are those of the kind's folder. A record needs a seq_id, the kind's type, a picture (its path, or
    the first name that holds its seq_id) and, but for equations, a paired caption, its own or its
    sidecar's; of several with one seq_id the first by pos counts. Of sidecars that share a seq_id the
    last name counts. A paper without any gets its own sidecars of the type instead, all of them.
    Returns pid, paper_id, n, seq_id, page, pair_id, bbox, picture, caption_text, ocr_text,
    ocr_source, ocr_score. Null seq ids take no part. Empty tables: empty result."""
    name = KINDS[kind]
    side = sidecars.where(_text(F.col("seq_id")) != "").groupBy("pid", _text(F.col("seq_id")).alias("seq_id")).agg(F.max_by(F.struct("paper_id", *FIELDS, "ocr"), "name").alias("s"))
    named = images.where(F.lower("name").endswith(".png"))
    known = images.select("pid", F.col("path").alias("given")).distinct().withColumn("there", F.lit(True))

    def pictured(rows: DataFrame, given: Column) -> DataFrame:
        """rows with picture: null where there is none. Names are looked up only for rows without
        a path that exists, within their own project."""
        asked = rows.withColumn("given", given).join(known, ["pid", "given"], "left")
        open_ids = asked.where("there IS NULL").select("pid", "seq_id").distinct()
        guessed = open_ids.join(named, "pid").where(F.contains("name", "seq_id")).groupBy("pid", "seq_id").agg(F.min_by("path", "name").alias("guess"))
        out = asked.join(guessed, ["pid", "seq_id"], "left")
        return out.withColumn("picture", F.when(F.col("there"), F.col("given")).otherwise(F.col("guess"))).drop("given", "there", "guess")

    def read(ocr: Column) -> Column:
        return K.best_reading(ocr["b_text"], ocr["b_score"], ocr["a_text"], ocr["a_score"])

    of_type = lambda c: F.lower(_text(c)) == name.lower()
    free = F.lit(kind == "equation")
    own = records.withColumn("seq_id", _text(F.col("seq_id"))).where((F.col("seq_id") != "") & of_type(F.col("type"))).join(side, ["pid", "seq_id"], "left")
    own = own.where(free | _locked(F.col("has_caption"), F.col("caption_bbox")) | _locked(F.col("s.has_caption"), F.col("s.caption_bbox")))
    own = pictured(own, _some(F.col("png_path"), F.col("s.png_path"))).where("picture IS NOT NULL").withColumn("ocr", read(F.col("s.ocr")))
    first = F.row_number().over(Window.partitionBy("pid", "paper_id", "seq_id").orderBy("pos"))
    own = own.withColumn("k", first).where("k = 1")
    page = lambda *c: F.coalesce(*[F.nullif(x.cast("int"), F.lit(0)) for x in c], F.lit(0))
    seed = _some(F.col("caption_text"), F.col("caption"), F.col("s.caption_text"), F.col("ocr.text"))
    own = own.select("pid", "paper_id", F.col("pos").cast("long").alias("pos"), "seq_id", page(F.col("page"), F.col("s.page")).alias("page"), _some(F.col("pair_id"), F.col("s.pair_id")).alias("pair_id"), "bbox", "picture", S.caption(F.lit(kind), seed).alias("caption_text"), "ocr")

    spare = side.where(of_type(F.col("s.type"))).where(free | _locked(F.col("s.has_caption"), F.col("s.caption_bbox"))).where(_text(F.col("s.paper_id")) != "").withColumn("paper_id", _text(F.col("s.paper_id")))
    spare = spare.join(own.select("pid", "paper_id").distinct(), ["pid", "paper_id"], "left_anti")
    spare = pictured(spare, _text(F.col("s.png_path"))).where("picture IS NOT NULL").withColumn("ocr", read(F.col("s.ocr")))
    spare = spare.select("pid", "paper_id", F.lit(0).cast("long").alias("pos"), "seq_id", page(F.col("s.page")).alias("page"), _text(F.col("s.pair_id")).alias("pair_id"), F.col("s.bbox").alias("bbox"), "picture", S.caption(F.lit(kind), F.col("ocr.text")).alias("caption_text"), "ocr")

    number = lambda k: F.nullif(F.regexp_extract("seq_id", r"^p(\d+)_[a-z]+_(\d+)$", k), F.lit("")).try_cast("int")
    at = Window.partitionBy("pid", "paper_id").orderBy(F.coalesce(number(1), F.col("page")), F.coalesce(number(2), F.lit(_LAST)), "pos", "seq_id")
    out = own.unionByName(spare).withColumn("n", F.row_number().over(at))
    return out.select("pid", "paper_id", "n", "seq_id", "page", "pair_id", "bbox", "picture", "caption_text", F.col("ocr.text").alias("ocr_text"), F.col("ocr.source").alias("ocr_source"), F.round("ocr.score", 4).alias("ocr_score"))
