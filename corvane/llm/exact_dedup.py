"""Exact dedup: a stream keeps digest, id and locator of every text in disk-backed state.

The stream reads the table's files batch by batch into a RocksDB state store without a
watermark, so nothing expires: per digest the largest id, its locator (file and row number in
it) and the number of rows. The finished state is read back with Spark's own state reader. A row
whose digest another row shares is a hit: its text meets the text at the locator of its digest,
byte by byte; rows that only share the digest are grouped by their bytes instead. Texts of other
rows never move: a bitmap over the shared digests, of bounded size, sorts them out where they
are read. Columns and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, join_hot, materialize, shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one group that are compared with one copy of its kept text.
ROWS_PER_SALT = 128
#: Bits that the bitmap has for each shared digest, and at most in all (128 MB).
BITS_EACH, MOST_BITS = 16, 1 << 30
#: Bits of one bitmap of bitmap_construct_agg.
_WIDTH = 32768


def _locator() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest: Callable[[Column], Column], files_per_batch: int) -> DataFrame:
    """Runs the stream over all files and returns its state: digest, keep_id, locator, group_size.
    The locator is the path of a file and the number of a row in it."""
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    path = path.rstrip("/")
    # Written as a pattern, a path may be one file; else the stream source takes files as folders.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = rows.select(digest(norm).alias("digest"), F.struct(F.col(id_col).cast("long").alias("id"), _locator()).alias("row"))
    state = keyed.groupBy("digest").agg(F.max("row").alias("top"), F.count(F.lit(1)).alias("n"))
    checkpoint = shared_path(spark, "exact-dedup-state")
    # Without fallocate a store of few rows takes its own size on disk, not 4 MB more for its manifest.
    options = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    stored = spark.read.format("statestore").load(checkpoint)
    buffers = [f.name for f in stored.schema["value"].dataType]  # in the order of agg()
    top, n = (F.col("value").getField(x) for x in buffers[:2])
    return stored.select(F.col("key.digest").alias("digest"), top.getField("id").alias("keep_id"), top.getField("locator").alias("locator"), n.alias("group_size"))


def maybe_shared(rows: DataFrame, shared: DataFrame, n_shared: int) -> DataFrame:
    """rows with maybe: false only where no digest of shared is that of the row.

    One bit of a bitmap for each hash of a shared digest; the bitmap's size is bounded, past
    which more rows are taken for shared, never fewer."""
    bits = _WIDTH
    while bits < min(MOST_BITS, BITS_EACH * n_shared):
        bits *= 2
    h = F.pmod(F.xxhash64("digest"), F.lit(bits))
    place = F.pmod(h, F.lit(_WIDTH))
    maps = shared.groupBy(F.floor(h / _WIDTH).cast("int").alias("part")).agg(F.bitmap_construct_agg(place).alias("bits"))
    met = rows.withColumn("part", F.floor(h / _WIDTH).cast("int")).join(F.broadcast(maps), "part", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.bit_get(F.coalesce(byte, F.lit(0)), F.pmod(place, F.lit(8)).cast("int")) == 1
    return met.withColumn("maybe", maybe).drop("part", "bits")


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", *, digest: Callable[[Column], Column] = sha256_digest, files_per_batch: int = 4096) -> DataFrame:
    """Of the rows at path whose texts are equal after A-Z is lower-cased, one row of largest id
    stays.

    Returns one row for each input row: doc_id (id_col as long), digest, keep_id, locator (file
    and row number of the row that stays), group_size, kept. Null text counts as empty, so empty
    and null texts are one group. A null id is smaller than any other; where all ids of a group
    are null, so is keep_id, and one of its rows is kept. Of rows that repeat both id and text
    one stays, by the larger locator; all are counted. Empty table: empty result. Other columns
    are not read.
    """
    state = materialize(digest_state(spark, path, id_col, text_col, digest, files_per_batch), "exact-dedup-digests")
    total, n_shared = state.agg(F.sum("group_size"), F.count(F.when(F.col("group_size") > 1, 1))).first()

    docs = spark.read.parquet(path).select(F.col(id_col).cast("long").alias("doc_id"), _locator().alias("own"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")).withColumn("digest", digest(F.col("norm")))
    docs = maybe_shared(docs, state.where("group_size > 1"), n_shared).withColumn("norm", F.when(F.col("maybe"), F.col("norm"))).drop("maybe")
    found = join_hot(docs, state, "digest", "group_size", total or 0, F.xxhash64("own"))
    found = materialize(found.withColumn("norm", F.when(F.col("group_size") > 1, F.col("norm"))), "exact-dedup-rows")

    hits = found.where("group_size > 1").select("digest", "own", "doc_id", "norm", "locator", F.ceil(F.col("group_size") / ROWS_PER_SALT).cast("int").alias("salts"))
    kept = hits.where("own = locator").select(F.col("digest").alias("kd"), F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("ks"))
    again = hits.where("own <> locator").withColumn("salt", F.pmod(F.xxhash64("own"), F.col("salts")).cast("int"))
    other = again.join(kept, (F.col("digest") == F.col("kd")) & (F.col("salt") == F.col("ks"))).where("norm <> kept_norm").select("doc_id", "digest", "own", "norm")
    other = materialize(other, "exact-dedup-unequal")
    found = found.select("doc_id", "digest", "own", "keep_id", "locator", "group_size")
    if not other.isEmpty():
        found = _regroup(found, other)
    return found.withColumn("kept", F.col("own") == F.col("locator")).drop("own")


def _regroup(found: DataFrame, other: DataFrame) -> DataFrame:
    """Takes rows that only share a digest out of its group and groups them by their bytes."""
    of = other.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "own")).alias("top"), F.count(F.lit(1)).alias("own_size"))
    moved = other.join(of, ["digest", "norm"]).select("own", "top", "own_size")
    gone = other.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    left = found.join(moved, "own", "left").join(gone, "digest", "left")
    out = F.col("own_size").isNotNull()
    return left.select("doc_id", "digest", "own", F.when(out, F.col("top.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(out, F.col("top.own")).otherwise(F.col("locator")).alias("locator"), F.when(out, F.col("own_size")).otherwise(F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"))
