"""A prefix trie over conversations, built as a Patricia trie from sorted sequences.

1. A turn becomes 16 bytes of a SHA-256 over role and text, with its count of words; a conversation
   becomes a row of those, its first turns taken from the conversation that heads its twenty.
2. Equal sequences meet once: ids are sorted by (sequence, id) over all tasks, so that thousands of
   members of one sequence lie in several tasks; runs of ids become comma-joined pieces, and only
   pieces (not ids) of a run that crosses tasks are hashed one after another.
3. Distinct sequences are range-partitioned and sorted. A task makes points only at ends, branches
   and leaves, from the common prefixes of neighbours; edges are compressed. Members, leaves and
   saved words are added up along these edges, then the unary nodes of an edge follow from suffix
   sums over its words.
4. Only nodes on the path of a task's first or last sequence can reach into another task. Their
   parts are added; these paths, two for each task, are one small trie of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, materialize, shuffle_partitions

#: Conversations that share the head of their first one, and the turns it may give.
FAMILY, HEAD_TURNS = 20, 4
#: Bytes of one piece of joined ids.
PIECE = 1 << 20
#: Points whose edges are expanded at once.
POINTS_AT_ONCE = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()
RUN = "sid binary, lead long, n long, hashed binary, whole boolean"
NODE = "kind int, part int, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_key binary, words long"
_NAMES = [c.split()[0] for c in NODE.split(", ")]
#: Kinds of rows that a task makes: nodes, nodes whose parent other tasks share, and shared nodes.
FINAL, DEFERRED, SPINE = 0, 1, 2


def rebuilt_sequences(turns: DataFrame) -> DataFrame:
    """(conv, sid, seq): each conversation as its digests and word counts of turns, in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.unhex(F.substring(F.sha2(framed, 256), 1, 32))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.struct("turn", key.alias("k"), F.regexp_count(text, F.lit(WORD)).alias("w")).alias("t"))
    own = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = materialize(own.select("conv", F.transform("t", lambda t: F.struct(t["k"].alias("k"), t["w"].alias("w"))).alias("seq")), "trie-turns")
    heads = own.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("head"), F.slice("seq", 1, HEAD_TURNS - 1).alias("first"))
    h = (F.crc32(F.col("conv").cast("string")) % HEAD_TURNS).cast("int")
    both = own.join(heads, F.col("conv") - F.col("conv") % FAMILY == F.col("head"), "left")
    rest = F.slice("seq", h + 1, F.size("seq"))
    both = both.select("conv", F.when(F.col("first").isNull(), rest).otherwise(F.concat(F.slice("first", F.lit(1), h), rest)).alias("seq"))
    sid = F.unhex(F.substring(F.sha2(F.array_join(F.transform("seq", lambda t: F.hex(t["k"])), ""), 256), 1, 32))
    return materialize(both.select("conv", sid.alias("sid"), "seq"), "trie-sequences")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sid, conv) to runs: whole ones hashed, those at a task's borders and long ones as pieces."""
    sid, ids, pieces, whole = None, [], 0, False
    out: list[tuple] = []

    def close(ended: bool) -> None:
        nonlocal ids, pieces
        if not ids:
            return
        text = ",".join(map(str, ids)).encode()
        entire = whole and ended and not pieces
        out.append((sid, ids[0], len(ids), hashlib.sha256(text).digest() if entire else text, entire))
        ids, pieces = [], pieces + 1

    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != sid:
                close(True)
                whole = sid is not None  # a task's first run may have begun in another
                sid, pieces = s, 0
            ids.append(c)
            if len(ids) >= PIECE // 20:
                close(False)
        if len(out) > 5000:
            yield _rows(out, RUN)
            out = []
    close(False)  # and its last one may go on
    if out:
        yield _rows(out, RUN)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (sid, first id) to one hash for each sid; one piece is held at a time."""
    sid, state, lead, n = None, None, 0, 0
    for batch in batches:
        out = []
        for s, first, count, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if s != sid:
                if sid is not None:
                    out.append((sid, lead, n, state.digest(), True))
                sid, state, lead, n = s, hashlib.sha256(), first, 0
            state.update(b"," * (n > 0) + text)
            n += count
        if out:
            yield _rows(out, RUN)
    if sid is not None:
        yield _rows([(sid, lead, n, state.digest(), True)], RUN)


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """(seq, lead, n, ends): each sequence once, with its smallest conversation, members and their hash."""
    p = shuffle_partitions(rebuilt.sparkSession)
    pairs = rebuilt.select("sid", "conv").repartitionByRange(p, "sid", "conv").sortWithinPartitions("sid", "conv")
    runs = materialize(pairs.mapInArrow(_runs, RUN), "trie-runs")
    cut = runs.where("NOT whole").repartition(p, "sid").sortWithinPartitions("sid", "lead").mapInArrow(_join_runs, RUN)
    classes = runs.where("whole").unionAll(cut).select("sid", F.col("lead").alias("conv"), "n", F.lower(F.hex("hashed")).alias("ends"))
    return rebuilt.join(classes, ["sid", "conv"]).select("seq", F.col("conv").alias("lead"), "n", "ends")


def common_prefixes(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each sequence the length of the prefix it shares with the one before; 0 for the first."""
    size = np.diff(offsets)
    out = np.zeros(len(size), dtype=np.int64)
    act, d = np.arange(1, len(size)), 0
    while len(act):
        act = act[np.minimum(size[act - 1], size[act]) > d]
        act = act[(keys[offsets[act - 1] + d] == keys[offsets[act] + d]).all(axis=1)]
        d += 1
        out[act] = d
    return out


class Patricia:
    """Points (ends, branches, leaves) of sorted distinct sequences, with sums over their subtrees."""

    def __init__(self, keys: np.ndarray, words: np.ndarray, offsets: np.ndarray, n: np.ndarray, lead: np.ndarray) -> None:
        self.offsets, self.words, self.keys = offsets, words, keys
        self.run = np.concatenate([[0], np.cumsum(words)])  # words before each turn
        self.m = len(n)
        size, prefix = np.diff(offsets).tolist(), [*common_prefixes(keys, offsets).tolist(), -1]
        at, run = offsets.tolist(), self.run.tolist()
        self.depth, self.top, self.start, self.end, self.count, self.lead, self.leaves, self.saved, self.children, self.parent, self.ends = ([] for _ in range(11))
        self.by_saved: list[int] = []  # of the node that begins the edge
        stack: list[int] = []

        def point(depth: int, start: int, own: int) -> int:
            for column, x in ((self.depth, depth), (self.top, 0), (self.start, start), (self.end, start), (self.count, 0), (self.lead, None), (self.leaves, 0), (self.saved, 0), (self.children, 0), (self.parent, -1), (self.ends, own), (self.by_saved, 0)):
                column.append(x)
            return len(self.depth) - 1

        def add(p: int, count: int, lead: int) -> None:
            self.count[p] += count
            self.lead[p] = lead if self.lead[p] is None else min(self.lead[p], lead)

        root = point(0, 0, -1)
        stack.append(root)
        for i, (count, least) in enumerate(zip(n.tolist(), lead.tolist())):
            if size[i] > self.depth[stack[-1]]:
                stack.append(point(size[i], i, i))
            else:
                self.ends[stack[-1]] = i  # only the empty sequence: it ends at the root
            add(stack[-1], count, least)
            shared = prefix[i + 1]
            while stack and self.depth[stack[-1]] > shared:
                p = stack.pop()
                self.end[p] = i
                d, begin = self.depth[p], at[self.start[p]]
                if not self.children[p]:
                    self.leaves[p] = 1
                above = max(shared, self.depth[stack[-1]] if stack else -1)
                self.top[p] = above + 1
                self.saved[p] += (self.count[p] - 1) * (run[begin + d] - run[begin + d - 1] if d else 0)
                if not stack and shared < 0:
                    break  # the root
                self.by_saved[p] = self.saved[p] + (self.count[p] - 1) * (run[begin + d - 1] - run[begin + above])
                if self.depth[stack[-1]] < above:
                    stack.append(point(above, self.start[p], -1))
                q = stack[-1]
                self.parent[p] = q
                self.children[q] += 1
                self.leaves[q] += self.leaves[p]
                self.saved[q] += self.by_saved[p]
                add(q, self.count[p], self.lead[p])

    def spine(self, p: int) -> bool:
        """Whether other tasks may hold members of the nodes of this point's edge."""
        return self.start[p] == 0 or self.end[p] == self.m - 1


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of one task's sorted sequences: nodes of its own, and its parts of the shared ones."""
    keys, words, sizes, count, lead, ends = [], [], [], [], [], [NOTHING]
    for batch in batches:
        seq = batch.column(0)
        key, w = seq.flatten().flatten()
        keys.append(np.frombuffer(b"".join(key.to_pylist()), dtype="<u8").reshape(-1, 2))
        words.append(np.array(w.to_pylist(), dtype=np.int64))
        sizes.append(np.array(seq.value_lengths().to_pylist(), dtype=np.int64))
        count.append(np.array(batch.column(2).to_pylist(), dtype=np.int64))
        lead.append(np.array(batch.column(1).to_pylist(), dtype=np.int64))
        ends += batch.column(3).to_pylist()
    if not sizes or not sum(len(s) for s in sizes):
        return
    part = TaskContext.get().partitionId()
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    t = Patricia(np.concatenate(keys), np.concatenate(words), offsets, np.concatenate(count), np.concatenate(lead))
    shas = pa.array(ends)
    depth, top, start, last, n, least, leaves, saved, children, parent, own = (np.array(x, dtype=np.int64) for x in (t.depth, t.top, t.start, t.end, t.count, t.lead, t.leaves, t.saved, t.children, t.parent, t.ends))
    shared = (start == 0) | (last == t.m - 1)
    inner = np.flatnonzero(~shared)
    for at in range(0, len(inner), POINTS_AT_ONCE):
        some = inner[at : at + POINTS_AT_ONCE]
        length = depth[some] - top[some] + 1
        p = np.repeat(some, length)
        d = top[p] + np.arange(len(p)) - np.repeat(np.cumsum(length) - length, length)
        begin, is_point, is_top = offsets[start[p]], d == depth[p], d == top[p]
        above = parent[p]
        deferred = is_top & shared[above]
        sums = saved[p] + (n[p] - 1) * (t.run[begin + depth[p] - 1] - t.run[begin + d - 1])
        side = np.where(start[above] == 0, 0, 1)
        columns = [
            pa.array(np.where(deferred, DEFERRED, FINAL).astype(np.int32)),
            pa.array(np.full(len(p), part, dtype=np.int32)),
            pa.array(np.where(deferred, side, 0).astype(np.int32)),
            pa.array(d),
            pa.array(least[p]),
            pa.array(np.where(is_top, least[above], least[p]), mask=deferred),
            pa.array(n[p]),
            pa.array(np.where(is_point, children[p], 1)),
            pa.array(leaves[p]),
            pa.array(sums),
            shas.take(pa.array(np.where(is_point, own[p] + 1, 0))),
            pa.nulls(len(p), pa.binary()),
            pa.nulls(len(p), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    hang = {p: [0, 0, 0] for p in np.flatnonzero(shared).tolist()}
    for p in inner[shared[parent[inner]]].tolist():
        h = hang[t.parent[p]]
        h[0], h[1], h[2] = h[0] + 1, h[1] + t.leaves[p], h[2] + t.by_saved[p]
    by_path: dict[tuple[int, int], int] = {}
    for p in hang:
        for d in range(t.top[p], t.depth[p] + 1):
            by_path[(0 if t.start[p] == 0 else 1), d] = p
    rows = []
    for side, i in ((0, 0), (1, t.m - 1)):
        for d in range(int(offsets[i + 1] - offsets[i]) + 1):
            p = by_path.get((side, d))
            turn = int(offsets[i]) + d - 1
            key, w = (t.keys[turn].tobytes(), int(t.words[turn])) if d else (b"", 0)
            if p is None:  # counted with the first sequence's path
                rows.append((SPINE, part, side, d, None, None, 0, 0, 0, 0, None, key, w))
                continue
            h = hang[p] if d == t.depth[p] else (0, 0, 0)
            sha = ends[t.ends[p] + 1] if d == t.depth[p] and t.ends[p] >= 0 else None
            rows.append((SPINE, part, side, d, t.lead[p], None, t.count[p], h[0], h[1], h[2], sha, key, w))
        if t.m == 1:
            break
    yield _rows(rows, NODE)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tasks' parts of shared nodes, paths in order: nodes, and each path's ids for parents."""
    lead, n, children, leaves, saved, ends, words, parent, depth = ([] for _ in range(9))
    slots: list[tuple[int, int, int, int]] = []
    path: list[int] = []
    keys: list[bytes] = []
    same = False
    for batch in batches:
        c = {name: batch.column(batch.schema.get_field_index(name)).to_pylist() for name in _NAMES}
        for part, side, d, conv, count, kids, tips, sums, sha, key, w in zip(*(c[x] for x in ("part", "side", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_key", "words"))):
            if d == 0:
                same = bool(path)
            elif same and not (d < len(path) and keys[d] == key):
                same = False
            if not same:
                del path[d:], keys[d:]
                path.append(len(lead))
                keys.append(key)
                for column, x in ((lead, None), (n, 0), (children, 0), (leaves, 0), (saved, 0), (ends, None), (words, w), (parent, path[d - 1] if d else -1), (depth, d)):
                    column.append(x)
            i = path[d]
            slots.append((part, side, d, i))
            if conv is not None:
                lead[i] = conv if lead[i] is None else min(lead[i], conv)
            n[i], children[i], leaves[i], saved[i] = n[i] + count, children[i] + kids, leaves[i] + tips, saved[i] + sums
            ends[i] = sha or ends[i]
    for i in range(len(lead) - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] if children[i] else 1
        saved[i] += (n[i] - 1) * words[i]
        if (q := parent[i]) >= 0:
            children[q], leaves[q], saved[q] = children[q] + 1, leaves[q] + leaves[i], saved[q] + saved[i]
    for at in range(0, len(lead), POINTS_AT_ONCE):
        yield _rows([(FINAL, 0, 0, depth[i], lead[i], lead[parent[i]] if parent[i] >= 0 else None, n[i], children[i], leaves[i], saved[i], ends[i] or NOTHING, None, None) for i in range(at, min(len(lead), at + POINTS_AT_ONCE))], NODE)
    for at in range(0, len(slots), POINTS_AT_ONCE):
        yield _rows([(SPINE, p, s, d, lead[i], None, None, None, None, None, None, None, None) for p, s, d, i in slots[at : at + POINTS_AT_ONCE]], NODE)


def prefix_trie(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    turns: conv_id, turn, role, text; other columns are not read. Turns are ordered by turn, null
    first, ties by the digest of role and text (repeated rows are turns of their own); null role or
    text is empty. Conversation c gives its own turns after its first h, h = crc32(c) mod 4, behind
    the first h turns of conversation c - c % 20, if there is one. Rows without conv_id belong to no
    conversation and are left out. Empty table: empty result.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; see the contract of op11. One conversation's digests (20 bytes a
    turn) are held as one row; parts sets the tasks that sorted sequences are dealt over."""
    p = parts or shuffle_partitions(turns.sparkSession)
    ranged = distinct_sequences(rebuilt_sequences(turns)).repartitionByRange(p, "seq").sortWithinPartitions("seq")
    local = materialize(ranged.mapInArrow(_local, NODE), "trie-local")
    shared = local.where(F.col("kind") == SPINE).repartition(1).sortWithinPartitions("part", "side", "depth")
    merged = materialize(shared.mapInArrow(_merge, NODE), "trie-shared")
    of = merged.where(F.col("kind") == SPINE).select("part", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("shared_parent"))
    late = local.where(F.col("kind") == DEFERRED).join(of, ["part", "side", "depth"]).withColumn("parent_conv_id", F.col("shared_parent"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return local.where(F.col("kind") == FINAL).select(out).unionAll(late.select(out)).unionAll(merged.where(F.col("kind") == FINAL).select(out))
