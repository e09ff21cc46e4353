"""Line dedup: documents probe sharded minimal perfect hashes over distinct line hashes.

A document belongs to the block its id hashes to. A block sends each of its distinct line
hashes once, packed by shard, so a line that a third of all documents hold arrives once from
each block. A shard builds a minimal perfect hash over the distinct hashes, fills arrays of
fingerprints, document counts and smallest ids through it, and answers each block with the
lines that repeat. A block puts these under a hash of the same kind, and its documents probe the
arrays. Lines themselves are never shuffled for the comparison; texts move once, to their block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, mix64, shuffle_partitions, text_bytes, unused, without

ABSENT = np.iinfo(np.int64).max
# n: twice the number of documents with an id, and one more where rows without an id hold the line.
_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("n", "<i8")])
_ANSWER = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8")])


class MinimalPerfectHash:
    """Levels of bit arrays; a key's slot is the rank of the first bit it owns alone."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.levels: list[tuple[int, np.ndarray]] = []
        self.ranks: list[np.ndarray] = []
        self.n = 0
        left = keys
        while len(left):
            size = max(64, int(len(left) * gamma))
            at = self._place(left, len(self.levels), size)
            owned = np.bincount(at, minlength=size) == 1
            self.levels.append((size, owned))
            self.ranks.append(self.n + np.cumsum(owned) - owned)
            self.n += int(owned.sum())
            left = left[~owned[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix64(keys + seed) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; a foreign key gets any slot, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, (size, owned) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], k, size)
            hit = owned[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out


class CompactIndex:
    """Slots of 128-bit hashes: a minimal perfect hash over their first halves, an array of
    fingerprints with the second. A hash that shares its first half with another is kept apart
    in a table of its own, so that no two hashes are ever taken for one."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.mph = MinimalPerfectHash(np.unique(h1))
        at = self.mph.slots(h1)
        self.fingerprint = np.zeros(self.mph.n, dtype=np.uint64)
        self.fingerprint[at] = h2
        self.others: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(self.fingerprint[at] != h2):
            self.others.setdefault((int(h1[i]), int(h2[i])), self.mph.n + len(self.others))
        self.n = self.mph.n + len(self.others)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it is not indexed."""
        if not self.n:
            return np.full(len(h1), -1, dtype=np.int64)
        at = self.mph.slots(h1)
        at[(at >= 0) & (self.fingerprint[np.maximum(at, 0)] != h2)] = -1
        if self.others:
            for i in np.flatnonzero(at < 0):
                at[i] = self.others.get((int(h1[i]), int(h2[i])), -1)
        return at


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """What lines are compared by, or None for a line too short to be dropped."""
    key = line.strip(SPACE).lower()  # bytes.lower changes A-Z alone
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return np.array([ABSENT if x is None else x for x in table.column(name).to_pylist()], dtype=np.int64)


def _hash_block(id_col: str, text_col: str, min_chars: int, shards: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        digests, counts = [], []
        for raw in text_bytes(table, text_col):
            own = {xxhash.xxh3_128_digest(k) for x in raw.split(b"\n") if (k := line_key(x, min_chars)) is not None}
            digests.append(b"".join(own))
            counts.append(len(own))
        h = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        doc = np.repeat(_ids(table, id_col), counts)
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        h, doc = h[order], doc[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (h[1:] != h[:-1]).any(axis=1)
        fresh = new.copy()  # a document counts once for a line, even if its row is repeated
        fresh[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(new)
        out = np.zeros(len(first), dtype=_ENTRY)
        out["h1"], out["h2"], out["doc"] = h[first, 0], h[first, 1], doc[first]
        if len(first):
            named = doc != ABSENT
            out["n"] = 2 * np.add.reduceat((fresh & named).astype(np.int64), first) + np.maximum.reduceat((~named).astype(np.int64), first)
        shard = (out["h1"] % np.uint64(shards)).astype(np.int32)
        by = np.argsort(shard, kind="stable")
        out, shard = out[by], shard[by]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        packed = [x.tobytes() for x in np.split(out, cuts[1:])] if len(out) else []
        return pa.table({"shard": pa.array(shard[cuts], pa.int32()), "blk": pa.array([key[0].as_py()] * len(packed), pa.int32()), "keys": pa.array(packed, pa.binary())})

    return run


def _index_and_probe(min_docs: int, block: str):
    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("blk").to_pylist()
        packed = [np.frombuffer(x, dtype=_ENTRY) for x in table.column("keys").to_pylist()]
        rows = np.concatenate(packed)
        index = CompactIndex(rows["h1"], rows["h2"])
        slot = index.find(rows["h1"], rows["h2"])
        count, nameless, smallest = np.zeros(index.n, dtype=np.int64), np.zeros(index.n, dtype=np.int64), np.full(index.n, ABSENT, dtype=np.int64)
        np.add.at(count, slot, rows["n"] >> 1)
        np.maximum.at(nameless, slot, rows["n"] & 1)
        np.minimum.at(smallest, slot, rows["doc"])
        count += nameless
        out_blocks, answers = [], []
        for blk, part in zip(blocks, packed):
            at = index.find(part["h1"], part["h2"])
            dup = count[at] >= min_docs
            if dup.any():
                chosen = np.zeros(int(dup.sum()), dtype=_ANSWER)
                chosen["h1"], chosen["h2"], chosen["doc"] = part["h1"][dup], part["h2"][dup], smallest[at[dup]]
                out_blocks.append(blk)
                answers.append(chosen.tobytes())
        return pa.table({block: pa.array(out_blocks, pa.int32()), "keys": pa.array(answers, pa.binary())})

    return run


def _rewrite(id_col: str, text_col: str, min_chars: int, schema_names: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(answers.column("keys").to_pylist()), dtype=_ANSWER)
        index = CompactIndex(found["h1"], found["h2"])
        owner = np.full(index.n, ABSENT, dtype=np.int64)
        owner[index.find(found["h1"], found["h2"])] = found["doc"]
        texts, ids = text_bytes(docs, text_col), _ids(docs, id_col)
        n_lines, n_dropped = [raw.count(b"\n") + 1 for raw in texts], [0] * len(texts)
        digests: list[bytes] = []
        lines_of, count = [], []
        for raw in texts if index.n else ():  # one probe for all lines of the block
            before = len(digests)
            for i, x in enumerate(raw.split(b"\n")):
                if (k := line_key(x, min_chars)) is not None:
                    digests.append(xxhash.xxh3_128_digest(k))
                    lines_of.append(i)
            count.append(len(digests) - before)
        h = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        of = np.repeat(np.arange(len(count)), count)
        at = index.find(h[:, 0], h[:, 1])
        gone = np.flatnonzero((at >= 0) & (owner[at] != ids[of])) if index.n else at
        for part in np.split(gone, np.flatnonzero(np.diff(of[gone])) + 1) if len(gone) else ():
            doc, dropped = int(of[part[0]]), {lines_of[i] for i in part}
            texts[doc] = b"\n".join([x for i, x in enumerate(texts[doc].split(b"\n")) if i not in dropped])
            n_dropped[doc] = len(dropped)
        new = {text_col: pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string()) if texts else pa.array([], pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        return pa.table([new[c] if c in new else docs.column(c) for c in schema_names], names=schema_names)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, min_docs: int = 2, blocks: int | None = None, shards: int | None = None) -> DataFrame:
    """Drops a line from every document but the one of smallest id among those that hold it.

    A text is split at each newline. Lines are compared after white space is stripped at both
    ends and A-Z is lower-cased; lines of under min_chars code points, or held by under
    min_docs documents, all stay. Within the owning document every occurrence stays.

    Returns the columns of docs, text_col rewritten, with n_lines (before) and n_dropped.
    Null text: one empty line, returned as an empty text. Null id: one document that comes
    after all others. Rows repeating an id are one document, and each keeps its own row.
    Empty table: empty result. Columns of docs named n_lines or n_dropped are replaced.
    blocks and shards bound what a task holds; by default they follow
    spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    p = shuffle_partitions(spark)
    blocks, shards = blocks or 3 * p, shards or p
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    plain = without(docs, "n_lines", "n_dropped")
    (block,) = unused(plain, "blk")
    # Rows without an id are one document, dealt over the blocks by their texts.
    of = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(F.col(id_col).cast("long")))
    blocked = plain.withColumn(block, F.pmod(of, F.lit(blocks)).cast("int"))
    sent = blocked.groupBy(block).applyInArrow(_hash_block(id_col, text_col, min_chars, shards), "shard int, blk int, keys binary")
    answers = sent.groupBy("shard").applyInArrow(_index_and_probe(min_docs, block), f"`{block}` int, keys binary")
    out_names = [*names, "n_lines", "n_dropped"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names) + ", n_lines long, n_dropped long"
    return blocked.groupBy(block).cogroup(answers.groupBy(block)).applyInArrow(_rewrite(id_col, text_col, min_chars, out_names), schema)
