"""Exact top-k search: block-at-a-time pruning over forward indexes of document ranges.

Each dimension is a term. A block is a range of vector ids with its forward index (ids and
integer values) and each term's largest and smallest value. A group of queries meets a run of
blocks in one task; each query takes them in the order of its bound, the sum over terms of the
most that a term can add, and stops once a bound falls below its k-th score. Results of the
runs are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shuffle_partitions

BLOCK_ROWS = 512
#: Blocks that meet a query group in one task.
RUN_BLOCKS = 64
QUERY_ROWS = 256
_PACKED = "block long, ids binary, vals binary, dim int"


def quantize(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component as double; vectors that are null, or hold null
    or non-finite components, and rows without an id, are left out."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ok = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
    return ok.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"), F.lit(float(scale)).alias("scale"))


def _pack(rows_per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vecs: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            dim = max((len(v) for v in vecs), default=0)
            m = np.zeros((len(vecs), dim))
            for i, v in enumerate(vecs):
                m[i, : len(v)] = v
            got = pa.RecordBatch.from_arrays([pa.array([ids[0]], pa.int64()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([dim], pa.int32())], names=["block", "ids", "vals", "dim"])
            ids.clear()
            vecs.clear()
            return got

        for batch in batches:
            for i, v, scale in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), batch.column("scale").to_pylist()):
                ids.append(i)
                vecs.append(np.floor(scale * np.array(v, dtype=np.float64)))
                if len(ids) == rows_per_block:
                    yield out()
        if ids:
            yield out()

    return run


def _unpack(ids: bytes, vals: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype=np.int64)
    return i, np.frombuffer(vals, dtype=np.float64).reshape(len(i), dim)


def _fit(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def search_blocks(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list[tuple[int, int, int]], int]:
    """The k best of each query over some blocks, and how many (query, block) pairs were scored."""
    dim = max([q.shape[1], *(b.shape[1] for _, b in blocks)])
    q, blocks = _fit(q, dim), [(i, _fit(b, dim)) for i, b in blocks]
    top = np.stack([b.max(axis=0) for _, b in blocks])
    low = np.stack([b.min(axis=0) for _, b in blocks])
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    exact = float(np.abs(q).max(initial=0)) * float(max(np.abs(top).max(initial=0), np.abs(low).max(initial=0))) * dim < 2.0**53
    if not exact:  # whole numbers of any size
        whole = np.vectorize(int, otypes=[object])
        up, down, top, low, q = (whole(x) if x.size else x for x in (up, down, top, low, q))
        blocks = [(i, whole(b)) for i, b in blocks]
    bound = up.dot(top.T) + down.dot(low.T)
    order = np.argsort(-bound, axis=1, kind="stable")
    best: list[list[tuple]] = [[] for _ in q_ids]  # (-score, id), sorted
    live = list(range(len(q_ids)))
    scored = 0
    for step in range(len(blocks)):
        by: dict[int, list[int]] = {}
        still = []
        for i in live:
            b = int(order[i, step])
            if len(best[i]) == k and bound[i, b] < -best[i][-1][0]:
                continue  # this and all later blocks are below the k-th score
            still.append(i)
            by.setdefault(b, []).append(i)
        live = still
        for b, who in by.items():
            ids, vals = blocks[b]
            scores = q[who].dot(vals.T)
            scored += len(who)
            for i, row in zip(who, scores):
                other = ids != q_ids[i]
                least = -best[i][-1][0] if len(best[i]) == k else None
                pick = np.flatnonzero(other if least is None else other & (row >= least))
                if len(pick) > 8 * k and least is None:  # ties at the k-th score all stay
                    values = row[pick]
                    pick = pick[values >= np.partition(values, len(values) - k)[len(values) - k]]
                if len(pick):
                    best[i] = sorted(best[i] + [(-row[j], int(ids[j])) for j in pick])[:k]
    return [(int(q_ids[i]), x, int(-s)) for i, found in enumerate(best) for s, x in found], scored


def top_k_search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The k largest integer inner products of each query, ties to the smaller id.

    Components become floor(scale * x), x as double. Candidates are all vectors but those of the
    query's own id. Returns query_id, rank (from 1), id_col, score. Null vectors, or with null
    or non-finite components, and null ids take no part. Shorter vectors count as ended by
    zeros. Of queries that repeat an id one is asked; candidates that repeat an id count each.
    Fewer than k candidates: all. No queries or candidates: empty result. Other columns are not
    read. Scores must fit a long.
    """
    spark = vectors.sparkSession
    p = shuffle_partitions(spark)
    rows = quantize(vectors, id_col, vector_col, scale)
    index = materialize(rows.repartitionByRange(p, "id").sortWithinPartitions("id").mapInArrow(_pack(BLOCK_ROWS), _PACKED), "topk-index")
    asked = quantize(queries, id_col, vector_col, scale).dropDuplicates(["id"])
    asked = materialize(asked.repartitionByRange(max(1, p // 4), "id").mapInArrow(_pack(QUERY_ROWS), _PACKED), "topk-queries")
    n_blocks = index.count()
    runs = max(1, -(-n_blocks // RUN_BLOCKS))
    blocks = index.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(runs)).cast("int"))
    sent = asked.select(F.col("block").alias("grp"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"), F.col("dim").alias("q_dim"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    pairs = sent.select(F.col("grp").alias("g"), F.col("run").alias("r"))
    keyed = blocks.join(pairs, blocks.run == pairs.r).select(F.col("g").alias("grp"), F.col("run"), "ids", "vals", "dim")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            parts = [_unpack(*x) for x in zip(*(left.column(c).to_pylist() for c in ("ids", "vals", "dim")))]
            for ids, vals, dim in zip(*(right.column(c).to_pylist() for c in ("q_ids", "q_vals", "q_dim"))):
                out += search_blocks(*_unpack(ids, vals, dim), parts, k)[0]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), columns)})

    found = keyed.groupBy("grp", "run").cogroup(sent.groupBy("grp", "run")).applyInArrow(run, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
