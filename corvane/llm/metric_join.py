"""Exact join of texts by Jaccard similarity of word shingles, as a join in a metric space.

1 - Jaccard is a metric; r is the largest distance that links (0.2 at 80 percent).

1. Texts with equal shingle sets form a class; its smallest id stands for it.
2. Nearly every pair of documents is at distance 1, where a pivot tells nothing. A pair within r
   shares one of the first n - ceil(0.8 n) + 1 shingles of both sets, in any one order of all
   shingles. Each such shared shingle has a pivot, one of the documents that hold it; a region is
   a pivot with the documents that meet it. Rare shingles come first, by a sketch of counts.
   Which shingles may be shared is found from four bytes of each; only these are grouped whole.
   Documents leave a region where no other there has nearly their size, and then where their counts
   in parts of all shingles differ too much from those of all others there: these counts never lie
   farther apart than the sets. What is left is looked at again with counts in more parts.
3. Each document goes to its largest region first. Documents within r of the pivot are linked to
   it, and among them nothing more need be compared. Of others, x and y are compared only where
   their distances to the pivot differ by r at most.
4. A region of more than CELL documents is divided by several pivots of its own: each document goes
   to its nearest pivot (a Voronoi region) and, as the triangle inequality asks, to every other
   pivot not farther than 2r beyond that, and than r beyond the region's radius. Regions divide
   again while they shrink.
5. Regions that hold several components after step 3 are joined in the same way, all of them, with
   those documents that counts in parts leave possible partners of another component.
   Those that pivots don't shrink meet as a grid of bounded cells between components.
6. Large-star and small-star label the links' components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_hot, materialize, materialize_at, mix64, shared_path, shuffle_partitions, text_bytes
from corvane.llm.components import connected_components
from corvane.llm.exact_dedup import maybe_shared
from corvane.llm.near_dedup import BROADCAST_IDS, CELL, _edges_of, _grid, _stars, _with_component, overlap_counts, shingle_set

#: Counters of the sketch of shingle counts, and the pieces that it is added up in.
COUNTERS, SLICES = 1 << 18, 64
#: Parts of all prefix shingles, each looked through for repeated ones by itself: a power of two.
PACKS = 1024
#: Most pivots that divide a region at one level.
PIVOTS = 16
#: A part that holds more than this share of its region is not divided again.
SHRINK = 0.7
#: Most documents of a cell in which counts in parts are compared, and most parts of a set.
FOLDED, PARTS = 1024, 1 << 15
#: Parts that are compared at a time.
STEP = 1024
#: For windows of floating-point distances; links are decided in whole numbers.
SLACK = 1e-9
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def _sign(words: int):
    """(doc, n, ident) of each text, then this task's counts of shingles in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        names = ["doc", "n", "ident", "slice", "counts"]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes, idents = [], []
            for raw in text_bytes(table, "text"):
                s = shingle_set(raw, words)
                sizes.append(len(s))
                idents.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")), pa.array(sizes, pa.int64()), pa.array(idents, pa.binary()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=names)
        if counts.any():
            pieces = [p.tobytes() for p in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(pieces, pa.binary())], names=names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(raw, dtype=np.int64)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])


def shingle_levels(signed: DataFrame) -> np.ndarray:
    """A byte for each counter: the logarithm of its count. A quarter of a megabyte, whatever the input."""
    sums = signed.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_add_slices, "slice int, counts binary")
    counts = np.zeros((SLICES, COUNTERS // SLICES), dtype=np.int64)
    for row in sums.collect():  # SLICES rows
        counts[row["slice"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return (4 * np.log2(counts.ravel() + 1)).astype(np.uint8)


def prefix_of(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set one of which any set within the threshold has in its own prefix."""
    rank = (levels[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    return s[np.argsort(rank, kind="stable")[: len(s) + 1 + (-percent * len(s)) // 100]]


def _prefixes(words: int, percent: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            idents, firsts, sizes, folds = [], [], [], []
            for raw in text_bytes(table, "text"):
                s = shingle_set(raw, words)
                sizes.append(len(s))
                folds.append(fold_of(s).tobytes())
                idents.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                firsts.append(prefix_of(s, levels, percent).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            values = pa.array(np.concatenate(firsts) if firsts else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")), pa.array(idents, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(sizes, pa.int64()), pa.array(folds, pa.binary())], names=["doc", "ident", "prefix", "n", "fold"])

    return run


def pack_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pack of each shingle, and the four bytes that stand for it there."""
    return (s & np.uint64(PACKS - 1)).astype(np.int32), (s >> np.uint64(32)).astype(np.uint32)


def pack_digest(s: Column) -> Column:
    """Pack and bytes of a shingle in one number, as _repeated gives them."""
    return F.shiftrightunsigned(s, 32) * PACKS + s.bitwiseAND(F.lit(PACKS - 1))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, keys): of each batch's prefixes what stands for the shingles of a pack."""
    for batch in batches:
        s = np.concatenate([np.zeros(0, dtype=np.int64), batch.column(0).flatten().to_numpy(zero_copy_only=False)]).astype(np.int64).view(np.uint64)
        pack, key = pack_keys(s)
        order = np.argsort(pack, kind="stable")
        pack, key = pack[order], key[order]
        at = np.flatnonzero(np.diff(pack, prepend=-1))
        keys = [x.tobytes() for x in np.split(key, at[1:])] if len(at) else []
        yield pa.RecordBatch.from_arrays([pa.array(pack[at], pa.int32()), pa.array(keys, pa.binary())], names=["cell", "keys"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands for shingles more than once, as pack_digest; a pack at a time."""
    for table in _cells(batches):
        key = np.sort(np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.uint32))
        again = np.unique(key[1:][key[1:] == key[:-1]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(again * PACKS + table.column("cell")[0].as_py(), pa.int64())], names=["digest"])


def of_like_size(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (region, n, ...) that another of their region can be linked with by their sizes."""
    w = Window.partitionBy("region").orderBy("n")
    down = F.col("n") * percent <= F.lag("n").over(w) * 100
    up = F.lead("n").over(w) * percent <= F.col("n") * 100
    return rows.withColumn("like", F.coalesce(down, F.lit(False)) | F.coalesce(up, F.lit(False))).where("like").drop("like")


def fold_of(s: np.ndarray, finer: int = 0, top: int = 255) -> np.ndarray:
    """Counts of a set's shingles in parts of all shingles, top at most: a power of two of parts, 4
    to 8 shingles each, or half as many for each step finer. The sum of two sets' differences is
    never more than the number of shingles that only one of them has, nor where pairs of parts are
    added up."""
    parts = min(PARTS, 1 << max(5, int(len(s) // 4).bit_length() - 1 + finer))
    part = ((s >> np.uint64(20)) & np.uint64(parts - 1)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=parts), top).astype(np.uint8)


def possible(n: np.ndarray, folds: list[np.ndarray], percent: int, comp: np.ndarray | None = None, top: int = 255) -> np.ndarray:
    """Which of some sets, given sizes and counts in parts, may be linked with another of them, and,
    where comp is given, of another component.

    Sets within the threshold have as many parts, or twice as many, and these are added up."""
    size = np.array([len(f) for f in folds])
    near = np.zeros(len(n), dtype=bool)
    for parts in np.unique(size):
        own, other = (x[np.argsort(n[x], kind="stable")] for x in (np.flatnonzero(size == parts), np.flatnonzero(size == 2 * parts)))
        rows = np.concatenate([own, other])
        counts = [np.stack([folds[i] for i in own]).astype(np.int16)]
        if len(other):
            twice = np.stack([folds[i] for i in other]).astype(np.int16)
            counts.append(np.minimum(twice[:, :parts] + twice[:, parts:], top))
        counts, sizes = np.concatenate(counts), n[rows]
        most = sizes[: len(own)] * 100 // percent  # no larger set is within the threshold
        end = np.searchsorted(sizes[: len(own)], most, side="right")
        end_other = len(own) + np.searchsorted(sizes[len(own) :], most, side="right")
        for i in range(len(own)):
            at = np.concatenate([np.arange(i + 1, end[i]), np.arange(len(own), end_other[i])])
            if near[rows[i]]:
                at = at[~near[rows[at]]]
            if comp is not None:
                at = at[comp[rows[at]] != comp[rows[i]]]
            apart, bound = np.zeros(len(at), dtype=np.int64), (100 - percent) * (sizes[at] + sizes[i])
            for lo in range(0, parts, STEP):  # most are told apart by the first parts
                apart += np.abs(counts[at, lo : lo + STEP] - counts[i, lo : lo + STEP]).sum(axis=1, dtype=np.int64)
                met = (100 + percent) * apart <= bound
                at, apart, bound = at[met], apart[met], bound[met]
            near[rows[at]] = True
            near[rows[i]] |= len(at) > 0
    return near


def packed(fold: np.ndarray) -> bytes:
    """Counts of 15 at most, two a byte."""
    return (fold[::2] | (fold[1::2] << np.uint8(4))).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, dtype=np.uint8)
    return np.stack([x & np.uint8(15), x >> np.uint8(4)], axis=1).ravel()


def _folds(words: int):
    """(doc, n, fold) of each text, with counts in four times as many parts as its prefix comes with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, folds = [], []
            for raw in text_bytes(pa.Table.from_batches([batch]), "text"):
                s = shingle_set(raw, words)
                sizes.append(len(s))
                folds.append(packed(fold_of(s, 2, 15)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")), pa.array(sizes, pa.int64()), pa.array(folds, pa.binary())], names=["doc", "n", "fold"])

    return run


def _possible(percent: int, fine: bool = False):
    """Of each cell its own documents that another one there may be linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            folds = [unpacked(x) if fine else np.frombuffer(x, dtype=np.uint8) for x in table.column("fold").to_pylist()]
            columns = {c: np.array(table.column(c).to_pylist()) for c in table.column_names if c != "fold"}
            near = possible(columns["n"], folds, percent, columns.get("comp"), 15 if fine else 255) & columns.get("own", True)
            if near.any():
                region = columns.get("region", columns["cell"])
                yield pa.RecordBatch.from_arrays([pa.array(x[near], pa.int64()) for x in (region, columns["doc"], columns["n"])], names=["region", "doc", "n"])

    return run


def nearer(rows: DataFrame, folds: DataFrame, percent: int, total: int, fine: bool = False) -> DataFrame:
    """(region, doc, n) of the rows (region, doc, n, comp, c) that another of their region and of
    another component may be linked with; folds: doc, n, fold.

    Regions of more than FOLDED rows are looked at by size: documents of one class of sizes with
    those of the next smaller and larger ones. Where even these are more, all stay."""
    size_class = F.floor(F.ln(F.col("n")) / math.log((100 / percent) * (1 + SLACK)))
    small = rows.where(F.col("c") <= FOLDED).select(F.col("region").alias("cell"), "region", "doc", "n", "comp", F.lit(True).alias("own"))
    large = rows.where(F.col("c") > FOLDED).select("region", "doc", "n", "comp", size_class.alias("k")).withColumn("at", F.explode(F.sequence(F.col("k") - 1, F.col("k") + 1)))
    large = large.select(F.xxhash64("region", "at").alias("cell"), "region", "doc", "n", "comp", (F.col("at") == F.col("k")).alias("own"))
    sizes = large.groupBy("cell").agg(F.count(F.lit(1)).alias("k"))
    large = join_hot(large, sizes, "cell", "k", total, F.xxhash64("doc"))
    cells = small.unionAll(large.where(F.col("k") <= FOLDED).drop("k")).join(folds.select("doc", "n", "fold"), ["doc", "n"])
    cells = cells.repartition(shuffle_partitions(rows.sparkSession), "cell").sortWithinPartitions("cell", "doc")
    rest = large.where((F.col("k") > FOLDED) & F.col("own")).select("region", "doc", "n")
    return cells.mapInArrow(_possible(percent, fine), "region long, doc long, n long").unionAll(rest)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a task sorted by cell, one cell at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        cell = np.array(batch.column(batch.schema.get_field_index("cell")).to_pylist(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if held and cell[lo] != now:
                    yield pa.Table.from_batches(held)
                    held = []
                now = cell[lo]
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def window_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Edges that connect what is linked in a cell; distances to the first document come first.

    Those within r of it are linked to it. They are compared with others only where the triangle
    inequality leaves it open: at a distance of no less than that of the nearest other, less r."""
    size = np.array([len(s) for s in sets])
    both = np.array([overlap(sets[0], s) for s in sets])
    union = size + size[0] - both
    near = 100 * both >= percent * union
    a = [int(x) for x in ids[near].tolist() if x != ids[0]]
    b = [int(ids[0])] * len(a)
    if near.all():
        return a, b
    d = 1 - both / union
    r = 1 - percent / 100
    use = np.flatnonzero(~near | (d >= d[~near].min() - r - SLACK))
    inter = overlap_counts([sets[i] for i in use])
    link = 100 * inter >= percent * (size[use][:, None] + size[use][None, :] - inter)
    x, y = _edges_of(ids[use], link)
    return a + x, b + y


def _join_cells(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            sets = [shingle_set(raw, words) for raw in text_bytes(table, "text")]
            if len(sets) > 1:
                a, b = window_links(np.array(table.column("doc").to_pylist()), sets, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


PLACED = "part long, pivot long, doc long, d double, home boolean, linked boolean, before long"


def _place(words: int, percent: int):
    """Distances of a cell's documents to its region's pivots: a row for the nearest and for each
    other pivot within the window 2r, or within r itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = 2 * (1 - percent / 100) + SLACK
        for table in _cells(batches):
            sets = [shingle_set(raw, words) for raw in text_bytes(table, "text")]
            ids, is_pivot = table.column("doc").to_pylist(), table.column("is_pivot").to_pylist()
            pivots = sorted((ids[i], i) for i in range(len(ids)) if is_pivot[i])
            part = [mix64(np.array([table.column("region")[0].as_py(), k], dtype=np.int64).view(np.uint64)) for k, _ in pivots]
            part = [int((x[:1] * _FOLD + x[1:]).view(np.int64)[0]) for x in part]
            before, out = table.column("c")[0].as_py(), []
            for i in range(len(ids)):
                if is_pivot[i]:
                    continue
                both = np.array([overlap(sets[i], sets[k]) for _, k in pivots])
                union = np.array([len(sets[i]) + len(sets[k]) for _, k in pivots]) - both
                d, linked = 1 - both / union, 100 * both >= percent * union
                home = int(d.argmin())
                out += [(part[j], pivots[j][0], ids[i], float(d[j]), j == home, bool(linked[j]), before) for j in np.flatnonzero((d <= d[home] + window) | linked).tolist()]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PLACED.split(", ")])

    return run


class _Join:
    """Joins regions (region, doc) of documents whose texts are given; what they link is in edges."""

    def __init__(self, texts: DataFrame, words: int, percent: int) -> None:
        self.texts, self.words, self.percent = texts, words, percent
        self.tasks = shuffle_partitions(texts.sparkSession)
        self.edges: list[DataFrame] = []

    def _with_texts(self, rows: DataFrame) -> DataFrame:
        """Texts go to their cells in one shuffle; those that rows don't ask for never move."""
        rows = materialize(rows, "join-dealt")
        n = rows.count()
        if n <= BROADCAST_IDS:
            met = self.texts.join(F.broadcast(rows), "doc")
        else:
            met = rows.join(maybe_of(self.texts, rows, n), "doc")
        return met.repartition(self.tasks, "cell").sortWithinPartitions("cell", "doc")

    def join_small(self, rows: DataFrame) -> None:
        """Regions of CELL documents at most."""
        cells = self._with_texts(rows.select("doc", F.col("region").alias("cell")))
        self.edges.append(materialize(cells.mapInArrow(_join_cells(self.words, self.percent), "a long, b long"), "join-edges"))

    def place(self, rows: DataFrame) -> DataFrame:
        """Documents of large regions (region, doc, c) by their nearest pivots and windows."""
        h = F.xxhash64("doc", F.col("region"))
        wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("c") / CELL) + 1)
        drawn = rows.withColumn("h", h).where(F.pmod(F.col("h"), F.col("c")) < 3 * wanted)
        least = rows.groupBy("region", "c").agg(F.min(F.struct(h.alias("h"), "doc")).alias("x")).select("region", "x.doc", "c", "x.h")
        rank = F.row_number().over(Window.partitionBy("region").orderBy("h", "doc"))  # of some 3 * PIVOTS rows
        pivots = drawn.select("region", "doc", "c", "h").unionAll(least).dropDuplicates(["region", "doc"]).withColumn("rank", rank).where(F.col("rank") <= wanted)
        chunks = F.ceil(F.col("c") / CELL).cast("int")
        chunk = F.pmod(F.xxhash64("doc", F.lit(11)), chunks).cast("int")
        dealt = rows.select("region", "c", "doc", chunk.alias("chunk"), F.lit(False).alias("is_pivot")).unionAll(pivots.select("region", "c", "doc", F.explode(F.sequence(F.lit(0), chunks - 1)), F.lit(True)))
        cells = self._with_texts(dealt.select("region", "c", "doc", "is_pivot", F.xxhash64("region", "chunk").alias("cell")))
        placed = materialize(cells.mapInArrow(_place(self.words, self.percent), PLACED), "join-placed")
        self.edges.append(placed.where("linked AND doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
        return placed

    def parts(self, placed: DataFrame) -> DataFrame:
        """(region, doc, c, before): Voronoi regions with their windows, without what need not be compared."""
        r = 1 - self.percent / 100
        shell = F.min(F.when(~F.col("linked"), F.col("d"))).alias("shell")
        of = placed.groupBy("part").agg(F.max(F.when(F.col("home"), F.col("d"))).alias("radius"), shell, F.count(F.lit(1)).alias("size"))
        of = of.where("radius IS NOT NULL AND shell IS NOT NULL")
        kept = join_hot(placed, of, "part", "size", placed.count(), F.xxhash64("doc"))
        kept = kept.where(F.col("home") | (F.col("d") <= F.col("radius") + r + SLACK)).where(~F.col("linked") | (F.col("d") >= F.col("shell") - r - SLACK))
        return counted(materialize(kept.select(F.col("part").alias("region"), "doc", "before").distinct(), "join-parts"))

    def join(self, rows: DataFrame) -> DataFrame:
        """All regions (region, doc, c), dividing those over CELL; returns those that don't shrink."""
        left = None
        while True:
            self.join_small(rows.where(F.col("c") <= CELL))
            large = materialize(rows.where(F.col("c") > CELL), "join-large")
            if large.isEmpty():
                return left
            parts = self.parts(self.place(large))
            stuck = (F.col("c") > CELL) & (F.col("c") > SHRINK * F.col("before"))
            some = materialize(parts.where(stuck).select("region", "doc", "c"), "join-stuck")
            left = some if left is None else left.unionAll(some)
            rows = parts.where(~stuck).select("region", "doc", "c")


def once_each(texts: DataFrame, again: DataFrame) -> DataFrame:
    """texts (doc, text) without repeated rows; again holds the ids of more rows than one, so that
    texts of other ids stay where they are."""
    n = again.count()
    if n > BROADCAST_IDS:
        return texts.dropDuplicates(["doc", "text"])
    if n == 0:
        return texts
    few = F.broadcast(again)
    return texts.join(few, "doc", "left_anti").unionAll(texts.join(few, "doc", "left_semi").dropDuplicates(["doc", "text"]))


def maybe_of(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """rows whose doc is among ids (doc), of which there are about n; where n is large a bitmap tells
    them, which lets few others pass, and no row moves."""
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids.select("doc")), "doc", "left_semi")
    told = maybe_shared(rows.withColumn("digest", F.col("doc")), ids.select(F.col("doc").alias("digest")), n)
    return told.where("maybe").select(*rows.columns)


def counted(rows: DataFrame) -> DataFrame:
    """rows of (region, doc, ...) with c, the size of their region."""
    size = rows.groupBy("region").agg(F.count(F.lit(1)).alias("c"))
    return join_hot(rows, size, "region", "c", rows.count(), F.xxhash64("doc"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of word shingles.

    Words are runs of other than white space, A-Z lower-cased; a text of fewer words than a
    shingle is one shingle; a text without words, or null, has none and is linked with nothing.
    Returns for each row: doc_id (long), n_shingles, component_id (smallest id reachable). Rows of
    one id and different texts are one node. A null id takes no part: component_id null. Repeated
    rows fall into one class. Empty table: empty result. Other columns are not read.
    Shingles are 64-bit hashes; every link between different sets is found."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    both = materialize(base.mapInArrow(_sign(words), "doc long, n long, ident binary, slice int, counts binary"), "join-signed")
    signed = both.where("slice IS NULL").select("doc", "n", "ident")
    taking_part = signed.where("doc IS NOT NULL AND n > 0")
    classes = materialize(taking_part.groupBy("ident").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "join-classes")
    total = signed.count()

    # Regions: documents that share a prefix shingle, under the smallest id that holds it.
    levels = shingle_levels(both)
    rep = classes.select(F.col("rep").alias("doc"), "ident")
    copies, n_copies = taking_part.select("doc", "ident").join(rep, ["doc", "ident"], "left_anti"), total - rep.count()

    def prefixes(texts: DataFrame) -> DataFrame:
        return texts.where("doc IS NOT NULL").mapInArrow(_prefixes(words, percent, levels), "doc long, ident binary, prefix array<long>, n long, fold binary")

    if n_copies <= BROADCAST_IDS:
        reps = prefixes(base).join(F.broadcast(copies), ["doc", "ident"], "left_anti")
    else:  # prefixes move only where a document may be a copy and may stand for a class
        told = maybe_shared(base.withColumn("digest", F.col("doc")), copies.select(F.col("doc").alias("digest")), n_copies)
        both_ways = maybe_of(told.where("maybe").select("doc", "text"), rep, total - n_copies)
        reps = prefixes(told.where("NOT maybe").select("doc", "text")).unionAll(prefixes(both_ways).join(rep, ["doc", "ident"], "left_semi"))
    path = shared_path(docs.sparkSession, "join-prefixes")
    held = materialize_at(reps.select("doc", "prefix", "n", "fold"), path)
    # Most shingles are one document's: a bitmap of bounded size keeps nearly all of them from what follows.
    tasks = shuffle_partitions(docs.sparkSession)
    packs = held.select("prefix").mapInArrow(_packed, "cell int, keys binary").repartition(tasks, "cell").sortWithinPartitions("cell")
    again = materialize(packs.mapInArrow(_repeated, "digest long"), "join-again")
    keys = maybe_shared(held.select("doc", "n", F.explode("prefix").alias("s")).withColumn("digest", pack_digest(F.col("s"))), again, again.count())
    some = shared_path(docs.sparkSession, "join-keys")
    keys = materialize_at(keys.where("maybe").select("doc", "n", "s"), some)
    shared = keys.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("region"), F.max("doc").alias("last")).where("region <> last").select("s", "c", "region")
    shared = materialize(shared, "join-shared")
    met = join_hot(keys, shared, "s", "c", total, F.xxhash64("doc")).select("region", "doc", "n").distinct()
    first, some = some, shared_path(docs.sparkSession, "join-met")
    met = counted(materialize_at(met, some, first))

    # Without documents that differ too much from all others of their region.
    first, some = some, shared_path(docs.sparkSession, "join-met")
    like = of_like_size(met.where(F.col("c") <= CELL), percent).unionAll(met.where(F.col("c") > CELL))
    like = materialize_at(like.select("region", "doc", "n", F.col("doc").alias("comp"), "c"), some, first)
    met = materialize_at(nearer(like, held, percent, total), shared_path(docs.sparkSession, "join-met"), some)
    wanted = met.select("doc").distinct()
    folds = maybe_of(base, wanted, wanted.count()).mapInArrow(_folds(words), "doc long, n long, fold binary")
    folds = materialize_at(folds, shared_path(docs.sparkSession, "join-folds"), path)
    met = counted(met.withColumn("comp", F.col("doc")))
    members = materialize(counted(nearer(met, folds, percent, total, True).distinct()), "join-regions")
    wanted = materialize(members.select("doc").distinct(), "join-candidates")
    texts = maybe_of(base, wanted, wanted.count())
    again = taking_part.groupBy("doc").agg(F.min("ident").alias("lo"), F.max("ident").alias("hi"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = materialize(again, "join-again")
    work = _Join(materialize(once_each(texts, again.select("doc")), "join-texts"), words, percent)
    # An id of several sets joins their classes.
    several = again.where("lo <> hi").select("doc")
    work.edges.append(taking_part.join(several, "doc").join(classes, "ident").select(F.col("doc").alias("a"), F.col("rep").alias("b")))

    # Each document once, in its largest region.
    once = members.groupBy("doc").agg(F.max(F.struct("c", "region")).alias("m")).select("m.region", "doc")
    once = materialize(counted(materialize(once, "join-once")), "join-first")
    work.join_small(once.where(F.col("c") <= CELL))
    if not once.where(F.col("c") > CELL).isEmpty():
        work.place(once.where(F.col("c") > CELL))
    comps = materialize(connected_components(_union(work.edges)), "join-components")

    # Then every region that still holds several components.
    told = _with_component(members.select("region", "doc", "n"), comps)
    several = told.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("region", "c")
    rest = materialize(join_hot(told, several, "region", "c", total, F.xxhash64("doc")), "join-several")
    rest = materialize(counted(nearer(rest, folds, percent, total, True).select("region", "doc").distinct()), "join-rest")
    work.edges = [_stars(comps)]
    stuck = work.join(rest)
    if stuck is not None:
        cells = _grid(_with_component(stuck.select("region", "doc"), comps), "region", total)
        work.join_small(cells.select("doc", F.col("cell").alias("region")))
    comps = materialize(connected_components(_union(work.edges)), "join-components")

    of = _with_component(classes.select("ident", "copies", F.col("rep").alias("doc")), comps).select("ident", "copies", "comp")
    classed = join_hot(taking_part, of, "ident", "copies", total, F.xxhash64("doc")).select("doc", "n", "comp")
    lone: Column = F.when(F.col("doc").isNotNull(), F.col("doc"))
    out = classed.unionAll(signed.where("doc IS NULL OR n = 0").select("doc", "n", lone))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def _union(edges: list[DataFrame]) -> DataFrame:
    out = edges[0].select("a", "b")
    for e in edges[1:]:
        out = out.unionAll(e.select("a", "b"))
    return out
