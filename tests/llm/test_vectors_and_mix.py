import collections
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.mixing import mix_sources, solve_multipliers, water_fill
from corvane.llm.topk import search_blocks, top_k_search

VECTORS = "vec_id long, embedding array<float>"


def brute_top(rows, queries, k):
    ok = [(i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i in queries:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-0.5, 0.5) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.25] * 6) for i in range(50)]  # ties
    rows += [(400, None), (401, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*x, 3) for x in rows], VECTORS + ", rank int")
    got = top_k_search(df, df.where("vec_id % 50 = 0"), k=5).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute_top(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)


def test_top_k_small_and_empty(spark):
    none = spark.createDataFrame([], VECTORS)
    assert top_k_search(none, none).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], VECTORS)
    assert [tuple(x) for x in top_k_search(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]


def test_pruning_skips_blocks_and_stays_exact():
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 8)) * 400
    blocks = [(np.arange(100) + 100 * b, np.floor(c + r.normal(size=(100, 8)) * 5)) for b, c in enumerate(centres)]
    q = np.floor(centres[:4])
    got, scored = search_blocks(np.array([-1, -2, -3, -4]), q, blocks, 5)
    assert scored < 4 * 12
    whole = np.concatenate([b for _, b in blocks])
    for n in range(4):
        want = sorted((-s, i) for i, s in enumerate((whole @ q[n]).astype(int).tolist()))[:5]
        assert [(i, s) for qid, i, s in got if qid == -1 - n] == [(i, -s) for s, i in want]


def test_large_components_stay_whole_numbers():
    big = np.array([[float(1 << 28), 1.0]])
    got, _ = search_blocks(np.array([0]), big, [(np.array([1]), np.array([[float(1 << 28), 1.0]]))], 1)
    assert got == [(0, 1, (1 << 56) + 1)]


def targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, done = share * sum(sizes.values()), {}
    open_ = set(names)
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            return done | {s: level * w[s] for s in open_}
        for s in over:
            done[s] = cap * sizes[s]
            left -= done[s]
            open_.discard(s)


def test_mix_meets_targets(spark):
    r = random.Random(6)
    rows = []
    for i in range(3000):
        source = r.choice(["a", "a", "a", "b", "c", "d", "é", None])
        rows.append((i, " ".join(["w"] * int(r.lognormvariate(3, 1.2))), source))
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, "w\t" * 20000, "a"), (5003, "same row", "b"), (5003, "same row", "b"), (None, "x y", "c")]
    docs = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, source string, target string")
    out = mix_sources(docs).collect()
    assert len(out) == len(rows)
    size, took, target = defaultdict(int), defaultdict(int), {}
    for x in out:
        size[x.source] += x.size
        took[x.source] += x.taken
        target[x.source] = x.target
        assert 0 <= x.taken <= 2 * x.size and x.copies in (0, 1, 2)
    want = targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and took[s] == pytest.approx(want[s], rel=0.01)
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(str(tuple(x)) for x in out) == sorted(str(tuple(x)) for x in again)


def test_rates_are_exponentially_tilted(spark):
    # One source whose target is under its size: longer documents must be taken less often.
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 100)), "b") for i in range(400)] + [(1000 + i, "w " * 5000, "a") for i in range(5)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(9.0, 1.0)).where("source = 'b'").groupBy("size").agg(F.avg("copies").alias("r")).collect()
    rate = {x["size"]: x["r"] for x in out}
    assert rate[100] < rate[10] <= 2


def test_rates_solve_the_dual(spark):
    """Multipliers against plain bisection on each source's tilted sum."""
    r = random.Random(3)
    sizes = {"a": [r.randint(0, 300) for _ in range(900)], "b": [r.randint(1, 40) for _ in range(500)], "c": [5] * 50}
    cells = [(s, z, 0, n) for s, of in sizes.items() for z, n in sorted(collections.Counter(of).items())]
    target = {"a": 0.4 * sum(sizes["a"]), "b": 1.7 * sum(sizes["b"]), "c": 2.0 * sum(sizes["c"])}
    df = spark.createDataFrame(cells, "source string, size long, part int, n long")
    of = spark.createDataFrame([(s, len(x), sum(x), target[s]) for s, x in sizes.items()], "source string, docs long, source_size long, target double")
    got = {x.source: x for x in solve_multipliers(df, of, 2.0).collect()}
    assert got["c"].full
    for s in "ab":
        mean, low, high = sum(sizes[s]) / len(sizes[s]), -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            total = sum(z * min(2.0, math.exp(min(50.0, mid * z / mean))) for z in sizes[s])
            low, high = (mid, high) if total < target[s] else (low, mid)
        assert got[s].lam == pytest.approx(low, rel=1e-4)


def test_mix_carries_rows(spark):
    rows = [(1, "a b", "s", 5), (1, "a b c", "s", 6), (None, None, None, 7)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, `row` int"), carry=True).collect()
    assert sorted((x["row"]["text"] or "", x["row"]["row"], x.size) for x in out) == [("", 7, 0), ("a b", 5, 2), ("a b c", 6, 3)]


def test_mix_degenerate_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).collect() == []
    out = mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert sorted((x.doc_id, x.size, x.target, x.taken) for x in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_water_fill_reshares(spark):
    s = spark.createDataFrame([("a", 1, 10), ("b", 1, 1000), ("c", 1, 1000), (None, 1, 500)], "source string, docs long, source_size long")
    got = {x.source: x.target for x in water_fill(s, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    want = targets({"a": 10, "b": 1000, "c": 1000, None: 500})
    assert all(got[k] == pytest.approx(want[k]) for k in want)
