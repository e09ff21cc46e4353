"""MinHash near-dedup with exact confirmation and connected components.

1. Texts with equal shingle sets form a class; its smallest id stands for it from here on.
2. Minima under many universal hash functions are cut into bands; classes that agree on a
   band share a bucket. At the contract's threshold 0.8 the defaults (26 bands of 5) miss a
   pair with probability (1 - 0.8^5)^26 < 4e-5.
3. Each class goes once to its largest bucket, split into cells of bounded size, and full
   shingle sets are compared there. That links most of each group.
4. Components that meet in a bucket send a few documents each, so that parts of one group join.
5. Buckets that still hold several components are looked at again: signatures within a margin
   of the threshold connect classes of different components, and the groups that come of it
   compare full sets between components, as a grid of bounded cells. Nothing that shares a
   bucket stays unchecked, and within a component nothing more need be.
6. Large-star and small-star label the links' components.

No pair is ever written out: cells emit one edge for each document linked in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_hot, materialize, mix64, shuffle_partitions, text_bytes, unused, word_hashes
from corvane.llm.components import connected_components

BANDS, ROWS = 26, 5
#: Documents of one side of a cell in which full sets or signatures are compared.
CELL = 256
#: Documents that a component sends to each of its buckets to meet other components.
ENVOYS = 4
#: Ids that may be broadcast to pick candidates' texts; beyond that they are joined by shuffle.
BROADCAST_IDS = 400_000
#: By how much a signature's estimate may lie below the threshold: over 5 standard deviations.
MARGIN = 0.18
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased."""
    h = word_hashes(raw.lower())
    if not len(h):
        return h
    width = min(words, len(h))
    acc = mix64(h[: len(h) - width + 1] + np.uint64(width))
    for j in range(1, width):
        acc = mix64(acc * _FOLD + h[j : len(h) - width + 1 + j])
    return np.unique(acc)


def _hashers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashers(bands * rows)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = text_bytes(table, "text")
            sizes = np.zeros(len(texts), dtype=np.int64)
            minima = np.full((len(texts), bands * rows), 0xFFFFFFFF, dtype=np.uint32)
            idents: list[bytes | None] = []
            for i, raw in enumerate(texts):
                s = shingle_set(raw, words)
                sizes[i] = len(s)
                idents.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                x = (s >> np.uint64(32)).astype(np.uint32)
                for at in range(0, len(x), 2048):
                    np.minimum(minima[i], (a * x[at : at + 2048] + b).min(axis=1), out=minima[i])
            key = np.tile(salt, (len(texts), 1))
            for j in range(rows):
                key = mix64(key * _FOLD + minima.reshape(-1, bands, rows)[:, :, j].astype(np.uint64))
            full = sizes > 0
            offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[full].ravel().view(np.int64)))
            sig = (minima >> np.uint32(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")), pa.array(sizes), pa.array(idents, pa.binary()), keys, pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc", "n", "ident", "bands", "sig"])

    return run


def _groups(link: np.ndarray) -> np.ndarray:
    """Component number of each row of a symmetric boolean matrix."""
    label = np.full(len(link), -1)
    for i in range(len(link)):
        if label[i] >= 0:
            continue
        reached = np.zeros(len(link), dtype=bool)
        front = np.array([i])
        reached[i] = True
        while len(front):
            new = link[front].any(axis=0) & ~reached
            reached |= new
            front = np.flatnonzero(new)
        label[reached] = i
    return label


def overlap_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over shared shingles."""
    sizes = [len(s) for s in sets]
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    column = np.cumsum(times > 1) - 1
    use = times[at] > 1
    row, col = row[use], column[at[use]]
    inter = np.zeros((len(sets), len(sets)))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        inter += m @ m.T
    return inter


def _edges_of(ids: np.ndarray, link: np.ndarray) -> tuple[list[int], list[int]]:
    label = _groups(link)
    a, b = [], []
    for root in np.unique(label):
        own = ids[label == root]
        least = own.min()
        a += [x for x in own.tolist() if x != least]
        b += [int(least)] * (len(a) - len(b))
    return a, b


def _cells(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, ids) of each cell of a group of cells."""
    cell = np.array(table.column("cell").to_pylist())
    ids = np.array(table.column("doc").to_pylist(), dtype=np.int64)
    order = np.argsort(cell, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        if len(part) > 1:
            yield part, ids[part]


def _compare_sets(words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        texts = text_bytes(table, "text")
        for part, ids in _cells(table):
            sets = [shingle_set(texts[i], words) for i in part]
            inter, size = overlap_counts(sets), np.array([len(s) for s in sets])
            link = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
            x, y = _edges_of(ids, link)
            a, b = a + x, b + y
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compare_signatures(least_share: float):
    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        packed = table.column("sig").to_pylist()
        comps = np.array(table.column("comp").to_pylist(), dtype=np.int64)
        for part, ids in _cells(table):
            sig = np.frombuffer(b"".join(packed[i] for i in part), dtype=np.uint8).reshape(len(part), -1)
            comp = comps[part]
            link = np.zeros((len(part), len(part)), dtype=bool)
            for i in range(len(part)):
                other = np.flatnonzero(comp != comp[i])
                if len(other):
                    link[i, other] = (sig[other] == sig[i]).mean(axis=1) >= least_share
            if link.any():
                x, y = _edges_of(ids, link)
                a, b = a + x, b + y
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _grid(rows: DataFrame, key: str, total: int) -> DataFrame:
    """Deals rows (key, doc, comp) of groups with several components into cells, so that any two
    rows of one group and different components meet in a cell of at most about 2 * CELL rows.

    Rows of a group's commonest component need not meet each other: each goes to one block and
    meets the blocks of all other rows. Those meet the commonest component's blocks and each
    other's."""
    per = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy(key).agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("comps"))
    top = top.where("comps > 1").select(key, F.col("top.comp").alias("main"), F.col("n"), F.ceil(F.col("top.c") / CELL).cast("int").alias("gm"), F.ceil((F.col("n") - F.col("top.c")) / CELL).cast("int").alias("go"))
    r = join_hot(rows, top, key, "n", total, F.xxhash64("doc")).withColumn("k", F.col(key))
    spread = F.xxhash64("doc", F.lit(7))
    is_main = F.col("comp") == F.col("main")
    own_m, own_o = F.pmod(spread, F.col("gm")).cast("int"), F.pmod(spread, F.col("go")).cast("int")

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    with_others = F.transform(upto(F.col("go")), lambda j: F.xxhash64(F.col("k"), F.lit("m"), own_m, j))
    with_main = F.transform(upto(F.col("gm")), lambda i: F.xxhash64(F.col("k"), F.lit("m"), i, own_o))
    each_other = F.transform(upto(F.col("go")), lambda j: F.xxhash64(F.col("k"), F.lit("o"), F.least(j, own_o), F.greatest(j, own_o)))
    small = F.array(F.xxhash64(F.col("k"), F.lit("s")))
    cells = F.when(F.col("n") <= 2 * CELL, small).when(is_main, with_others).otherwise(F.concat(with_main, each_other))
    return r.select("doc", "comp", F.explode(cells).alias("cell"))


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    c = comps.select(F.col("node").alias("x"), "component")
    return rows.join(c, F.col("doc") == F.col("x"), "left").withColumn("comp", F.coalesce("component", "doc")).drop("x", "component")


def _stars(comps: DataFrame) -> DataFrame:
    return comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of word shingles.

    Words are runs of other than white space, A-Z lower-cased; a text of fewer words than a
    shingle is one shingle; a text without words, or null, has none and is linked with nothing.
    Returns for each row: doc_id (long), n_shingles, component_id (smallest id reachable), kept
    (doc_id = component_id). Rows of one id and different texts are one node of the graph. A null id takes no part: component_id null, kept true. Ties and repeated rows
    fall into one class. Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    p = shuffle_partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = materialize(base.mapInArrow(_sign(words, bands, rows), "doc long, n long, ident binary, bands array<long>, sig binary"), "near-signed")
    taking_part = signed.where("doc IS NOT NULL AND n > 0")
    classes = taking_part.groupBy("ident").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    total = signed.count()
    reps = taking_part.join(classes.select(F.col("rep").alias("doc"), "ident"), ["doc", "ident"], "left_semi").dropDuplicates(["doc", "ident"])

    # Sets whose sizes differ by more than the threshold allows can't be linked: 1.25 at 80 %.
    size_class = F.floor(F.ln(F.col("n")) / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n").cast("int")
    keys = reps.select("doc", size_class.alias("k"), F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = materialize(join_hot(keys, shared, "bucket", "c", total, F.xxhash64("doc")), "near-members")
    wanted = materialize(members.select("doc").distinct(), "near-candidates")
    few = wanted.count() <= BROADCAST_IDS
    texts = base.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi")
    texts = materialize(texts.dropDuplicates(["doc", "text"]) if not few else texts, "near-texts")

    # Each class once, in its largest bucket.
    first = members.groupBy("doc").agg(F.max(F.struct("c", "bucket", "k")).alias("b"))
    part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("b.c") / CELL))
    first = first.select("doc", F.xxhash64("b.bucket", F.when(F.col("b.c") > CELL, F.col("b.k")), part).alias("cell"))
    compare, edge = _compare_sets(words, percent), "a long, b long"
    group = F.pmod(F.xxhash64("cell"), F.lit(4 * p)).cast("int")
    edges = materialize(texts.join(first, "doc").withColumn("grp", group).groupBy("grp").applyInArrow(compare, edge), "near-edges")
    comps = materialize(connected_components(edges), "near-components")

    # A few of each component in each bucket: parts of one group that lay in different cells.
    known = members.select("doc", "bucket").join(comps.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc")
    several = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_distinct("comp").alias("comps")).where("lo <> hi").select(F.col("bucket").alias("b"), "comps")
    rank = F.row_number().over(Window.partitionBy("bucket", "comp").orderBy(F.xxhash64("doc", F.lit(3)), "doc"))
    envoys = known.withColumn("rank", rank).where(F.col("rank") <= ENVOYS).join(several, F.col("bucket") == F.col("b"))
    part = F.pmod(F.xxhash64("comp", F.lit(5)), F.ceil(F.col("comps") * ENVOYS / CELL))
    envoys = envoys.select("doc", F.xxhash64("bucket", part).alias("cell"))
    bridges = materialize(texts.join(envoys, "doc").withColumn("grp", group).groupBy("grp").applyInArrow(compare, edge).unionAll(_stars(comps)), "near-edges")
    comps = materialize(connected_components(bridges), "near-components")

    # What is left between components.
    dealt = _grid(_with_component(members.select("doc", "bucket"), comps), "bucket", total).join(reps.select("doc", "sig"), "doc")
    close = dealt.withColumn("grp", group).groupBy("grp").applyInArrow(_compare_signatures(percent / 100 - MARGIN), edge)
    rough = materialize(connected_components(close), "near-rough")
    left = _grid(_with_component(rough.select(F.col("node").alias("doc"), F.col("component").alias("rough")), comps), "rough", total)
    more = left.join(texts, "doc").withColumn("grp", group).groupBy("grp").applyInArrow(compare, edge)
    more = materialize(more, "near-edges")
    if not more.isEmpty():
        comps = materialize(connected_components(_stars(comps).unionAll(more)), "near-components")

    # Texts without words and rows without an id have no class.
    of = _with_component(classes.select("ident", "copies", F.col("rep").alias("doc")), comps).select("ident", "copies", "comp")
    narrow = signed.select("doc", "n", "ident")
    classed = join_hot(narrow.where("doc IS NOT NULL AND n > 0"), of, "ident", "copies", total, F.xxhash64("doc")).select("doc", "n", "comp")
    out = classed.unionAll(narrow.where("doc IS NULL OR n = 0").select("doc", "n", F.lit(None).cast("long").alias("comp")))
    component = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("comp"))
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The row of docs that stands for each component; columns unchanged. Of rows that repeat the
    id that stays, that of smallest text hash stays; rows without an id all stay."""
    (own,) = unused(docs, "own")
    found = near_duplicates(docs, id_col, text_col, **settings).where("kept AND doc_id IS NOT NULL")
    kept = materialize(found.groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n")), "near-kept")
    same = F.col(id_col).cast("long") == F.col(own)
    once = docs.join(kept.where("n = 1"), same, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    again = docs.join(kept.where("n > 1"), same, "left_semi")
    first = again.groupBy(F.col(id_col).cast("long")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.xxhash64(text_col), F.col(text_col))).alias("r")).select("r.*")
    return once if kept.where("n > 1").isEmpty() else once.unionByName(first)
