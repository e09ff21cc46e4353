"""How filters interact, whatever the order they run in, from one histogram of failures.

A document's outcome under any order of five filters depends only on which of them it fails: a
mask of 5 bits. So documents are counted once, by part and mask, and every order follows from
products of that stacked incidence matrix (a row for each part and label, 32 columns) with fixed
integer matrices of 32 rows and 600 columns (120 orders of 5 steps).

Documents never meet in a group of equal texts: the smallest id of each text comes from a partial
aggregation, and a row asks for (text, own id) in it, a key that repeats only with the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACES = r"[\x20\x09-\x0D]+"
#: Parts whose products are held at once: 600 rows of seven counts each.
PARTS_AT_ONCE = 256
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def outcome_matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: 32 x 600 of 0 and 1; step (order, k) is column 5 * order + k."""
    mask = np.arange(MASKS)[:, None]
    bit, before = [], []
    for order in ORDERS:
        seen = 0
        for letter in order:
            before.append(seen)
            bit.append(1 << FILTERS.index(letter))
            seen |= bit[-1]
    bit, before = np.array(bit), np.array(before)
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == bit}
    return {k: v.astype(np.int64) for k, v in found.items()}


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (A is bit 0)."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * upper > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def mask_histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part: counts of all, good and toxic documents by mask, as three arrays of 32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = materialize(rows, "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc").alias("doc")).withColumn("is_first", F.lit(True))
    of = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("doc").isNotNull() & F.col("is_first").isNull()
    told = rows.join(first, ["digest", "doc"], "left").join(of, "doc", "left").withColumn("mask", F.col("mask") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0)))
    counts = told.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))  # 32 entries at most

    def stacked(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda k: F.coalesce(F.col("m")[k][name], F.lit(0)))

    return by_mask.select("part", stacked("n").alias("n"), stacked("good").alias("good"), stacked("toxic").alias("toxic"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = outcome_matrices()
    steps = len(FILTERS) * len(ORDERS)
    letter = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    own = (letter[:, None] == np.arange(len(FILTERS))).astype(np.int64)
    names = pa.array([order for order in ORDERS for _ in FILTERS])
    for batch in batches:
        for at in range(0, batch.num_rows, PARTS_AT_ONCE):
            some = batch.slice(at, PARTS_AT_ONCE)
            n, good, toxic = (np.array(some.column(k).flatten()).reshape(-1, MASKS) for k in (1, 2, 3))
            removed = n @ by["removed"]
            columns = [n @ by["kept"], removed, n @ by["redundant"], n @ by["unique"], good @ by["removed"], toxic @ by["removed"], (removed @ own)[:, letter]]
            part = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), steps)))
            order = names.take(pa.array(np.tile(np.arange(steps), some.num_rows)))
            step = pa.array(np.tile(np.arange(steps) % len(FILTERS) + 1, some.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(c.ravel()) for c in columns)], names=[c.split()[0] for c in OUT.split(", ")])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step; all counts within the part.

    docs: doc_id, text, source (other columns are not read); a null text is empty, a null source
    is the empty part. labels: doc_id, quality, toxic; documents without labels, and null labels,
    are neither good nor toxic; of repeated labels any 1 counts. Rows that repeat an id count each;
    equal texts of the smallest id all pass E, and so does a row without id, which is neither
    smaller nor larger than any. Empty table: empty result."""
    return mask_histogram(docs, labels).mapInArrow(_products, OUT)
