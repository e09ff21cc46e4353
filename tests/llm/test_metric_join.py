import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import metric_join, near_dedup
from corvane.llm.metric_join import COUNTERS, _cells, _possible, fold_of, jaccard_join, prefix_of, window_links

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(rows, words=5, percent=80):
    sets = [(d, shingles(t, words)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def family(r, start, size, length, edits):
    """Copies of one text, each with words replaced and each from the one before or from the first."""
    texts = [[f"w{r.randint(0, 300)}" for _ in range(length)]]
    for _ in range(size - 1):
        t = list(r.choice([texts[0], texts[-1]]))
        for _ in range(r.randint(0, edits)):
            t[r.randrange(length)] = f"v{r.randint(0, 40)}"
        texts.append(t)
    return [(start + i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cell", [3, 12, 256])
def test_join_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(near_dedup, "CELL", cell)
    r = random.Random(cell)
    rows = family(r, 0, 40, 60, 4) + family(r, 100, 25, 30, 2) + family(r, 200, 30, 120, 12)
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(300 + i, " ".join([passage, *(f"x{i}y{k}" for k in range(r.choice([3, 8, 9, 10, 30])))])) for i in range(30)]
    rows += [(400 + i, " ".join(f"q{r.randint(0, 10**6)}" for _ in range(50))) for i in range(20)]
    r.shuffle(rows)
    got = found(jaccard_join(spark.createDataFrame(rows, DOCS)))
    assert got == brute(rows)
    assert len({c for *_, c in got}) < len(rows)


def test_nulls_repeats_short_and_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " end"), (8, "one two"), (9, "ä b c d e f"), (9, "ä b c d e f"), (None, "one two"), (10, "Ä b c d e f"), (11, "e " * 40), (12, "E " * 50)]
    df = spark.createDataFrame([(*x, 1, 2, "s") for x in rows], DOCS + ", region long, doc long, ident string")
    got = jaccard_join(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(got) == brute(rows)
    assert jaccard_join(spark.createDataFrame([], DOCS)).collect() == []
    assert found(jaccard_join(spark.createDataFrame(rows[:3], DOCS))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_candidates_by_broadcast_or_shuffle_agree(spark, monkeypatch):
    rows = family(random.Random(5), 0, 30, 40, 3) + [(3, "another text of the same id")]
    want = brute(rows)
    assert found(jaccard_join(spark.createDataFrame(rows, DOCS))) == want
    monkeypatch.setattr(metric_join, "BROADCAST_IDS", 0)
    assert found(jaccard_join(spark.createDataFrame(rows, DOCS))) == want


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(1)
    levels = r.integers(0, 40, COUNTERS).astype(np.uint8)
    for _ in range(300):
        n = int(r.integers(1, 60))
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        cut = int(r.integers(0, max(1, len(x) // 5 + 1)))
        y = np.unique(np.concatenate([x[cut:], r.integers(0, 1 << 62, int(r.integers(0, 5))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
            assert len(np.intersect1d(prefix_of(x, levels, 80), prefix_of(y, levels, 80)))


def test_counts_in_parts_keep_every_linked_document():
    r = np.random.default_rng(7)
    base = [np.unique(r.integers(0, 1 << 62, n).astype(np.uint64)) for n in (3, 40, 127, 129, 400, 4100, 30000)]
    sets = [x for s in base for x in (s, s[: len(s) - len(s) // 9], s[len(s) // 2 :], np.unique(np.append(s, s[:1] + np.uint64(1))))]
    for x in sets:
        for y in sets:
            f, g = fold_of(x).astype(int), fold_of(y).astype(int)
            while len(f) != len(g):
                f, g = (f.reshape(2, -1).sum(axis=0), g) if len(f) > len(g) else (f, g.reshape(2, -1).sum(axis=0))
            assert np.abs(f - g).sum() <= len(np.setxor1d(x, y))
    docs = np.arange(len(sets))
    table = pa.RecordBatch.from_arrays([pa.array([5] * len(sets)), pa.array(docs), pa.array([len(s) for s in sets]), pa.array([fold_of(s).tobytes() for s in sets])], names=["cell", "doc", "n", "fold"])
    kept = {d for b in _possible(80)([table]) for d in b.column(1).to_pylist()}
    linked = {i for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    assert linked <= kept < set(docs.tolist())


def test_window_links_against_all_pairs():
    r = np.random.default_rng(2)
    for _ in range(60):
        base = r.integers(0, 10**6, 40)
        sets = [np.unique(np.where(r.random(40) < r.choice([0.02, 0.1, 0.3]), r.integers(0, 10**6, 40), base)).astype(np.uint64) for _ in range(14)]
        ids = np.arange(14) + 5
        a, b = window_links(ids, sets, 80)
        rows = [(int(i), s) for i, s in zip(ids, sets)]
        label = {int(i): int(i) for i in ids}

        def merge(pairs, label):
            for _ in label:
                for x, y in pairs:
                    label[x] = label[y] = min(label[x], label[y])
            return label

        pairs = [(i, j) for i, x in rows for j, y in rows if i < j and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))]
        assert merge(list(zip(a, b)), dict(label)) == merge(pairs, dict(label))


def test_cells_span_batches():
    batches = [pa.RecordBatch.from_pydict({"cell": c, "doc": c}) for c in ([1, 1], [1], [2, 3, 3], [], [3], [4])]
    batches[3] = batches[0].slice(0, 0)
    assert [t.column("cell").to_pylist() for t in _cells(batches)] == [[1, 1, 1], [2], [3, 3, 3], [4]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_supplied_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(jaccard_join(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_texts_reach_their_cells_in_one_shuffle(spark):
    """A text moved twice a round, asked for or not, once by its id and once to its cell."""
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(9)], DOCS.replace("doc_id", "doc"))
    rows = spark.createDataFrame([(2, 7), (3, 7), (3, 8)], "doc long, cell long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = metric_join._Join(texts, 5, 80)._with_texts(rows)
        assert "SortMergeJoin" not in met._jdf.queryExecution().toString()
        assert sorted(map(tuple, met.select("cell", "doc", "text").collect())) == [(7, 2, "text 2"), (7, 3, "text 3"), (8, 3, "text 3")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    both = texts.unionAll(texts.where("doc = 4"))
    assert metric_join.once_each(both, texts.where("doc = 4").select("doc")).count() == 9


@pytest.mark.parametrize("most", [0, 400_000])
def test_many_texts_meet_their_cells_by_a_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(metric_join, "BROADCAST_IDS", most)
    r = random.Random(9)
    rows = family(r, 0, 20, 40, 3) + family(r, 50, 10, 30, 2) + [(3, "a b c d e f"), (3, "a b c d e f")]
    assert found(jaccard_join(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_repeated_shingles_are_found_in_packs(spark):
    r = np.random.default_rng(3)
    s = r.integers(-(2**63), 2**63 - 1, 4000)
    rows = [(s[i : i + 500].tolist(),) for i in range(0, 4000, 500)] + [(s[100:120].tolist(),), ([],)]
    held = spark.createDataFrame(rows, "prefix array<long>").repartition(3)
    packs = held.mapInArrow(metric_join._packed, "cell int, keys binary").repartition(4, "cell").sortWithinPartitions("cell")
    again = {x.digest for x in packs.mapInArrow(metric_join._repeated, "digest long").collect()}
    told = spark.createDataFrame([(int(x),) for x in s[100:120]], "s long").select(metric_join.pack_digest(metric_join.F.col("s")).alias("d"))
    assert again == {x.d for x in told.collect()} and len(again) == 20


def test_sizes_too_far_apart_leave_a_region(spark):
    rows = [(1, 10, 80), (1, 11, 100), (1, 12, 126), (2, 20, 79), (2, 21, 100), (3, 30, 5), (3, 31, 5)]
    left = metric_join.of_like_size(spark.createDataFrame(rows, "region long, doc long, n long"), 80)
    assert sorted(x.doc for x in left.collect()) == [10, 11, 30, 31]


def test_possible_partners_by_size_component_and_parts(monkeypatch):
    monkeypatch.setattr(metric_join, "STEP", 16)
    r = np.random.default_rng(11)
    base = [np.unique(r.integers(0, 1 << 62, n).astype(np.uint64)) for n in (6, 90, 255, 257, 900) for _ in range(3)]
    sets = [x for s in base for x in (s, s[: len(s) - len(s) // 9], s[: len(s) - len(s) // 3])]
    n = np.array([len(s) for s in sets])
    comp = np.array([i // 9 if i % 2 else -i for i in range(len(sets))])
    linked = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))]
    for finer, top in ((0, 255), (2, 15)):
        folds = [fold_of(s, finer, top) for s in sets]
        if top == 15:
            folds = [metric_join.unpacked(metric_join.packed(f)) for f in folds]
        near = metric_join.possible(n, folds, 80, top=top)
        other = metric_join.possible(n, folds, 80, comp, top)
        assert {i for i, _ in linked} <= set(np.flatnonzero(near).tolist()) and not near.all()
        assert {i for i, j in linked if comp[i] != comp[j]} <= set(np.flatnonzero(other).tolist()) and not (other & ~near).any()
    same = metric_join.possible(n[:2], folds[:2], 80, np.array([4, 4]), 15)
    assert not same.any()


@pytest.mark.parametrize("folded", [2, 5, 1024])
def test_large_regions_keep_only_possible_partners(spark, monkeypatch, folded):
    monkeypatch.setattr(metric_join, "FOLDED", folded)
    r = np.random.default_rng(5)
    sets = {}
    for k, n in enumerate((40, 80, 160, 320, 640)):
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        sets |= {10 * k: x, 10 * k + 1: x[: n - n // 8], 10 * k + 2: np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))}
    rows = spark.createDataFrame([(7, d, len(s), d, len(sets)) for d, s in sets.items()], "region long, doc long, n long, comp long, c long")
    folds = spark.createDataFrame([(d, len(s), bytearray(metric_join.packed(fold_of(s, 2, 15)))) for d, s in sets.items()], "doc long, n long, fold binary")
    left = [(x.region, x.doc, x.n) for x in metric_join.nearer(rows, folds, 80, 100, True).collect()]
    linked = {(7, d, len(s)) for d, s in sets.items() if d % 10 < 2}
    assert len(left) == len(set(left)) and (set(left) == linked if folded > 2 else set(left) >= linked)


def test_documents_of_a_large_region_without_partner_are_no_candidates(spark, monkeypatch):
    """A long text that shares a passage with each of many others made all of them candidates."""
    monkeypatch.setattr(metric_join, "CELL", 4)
    asked, write = {}, metric_join.materialize

    def told(df, tag):
        asked[tag] = write(df, tag)
        return asked[tag]

    monkeypatch.setattr(metric_join, "materialize", told)
    passages = [" ".join(f"p{i}_{k}" for k in range(40)) for i in range(12)]
    rows = [(0, " ".join(passages))] + [(i + 1, p + " " + " ".join(f"own{i}_{k}" for k in range(5))) for i, p in enumerate(passages)] + [(50, "a b c d e f g h"), (51, "a b c d e f g h i")]
    assert found(jaccard_join(spark.createDataFrame(rows, DOCS))) == brute(rows)
    assert {x.doc for x in asked["join-candidates"].collect()} == {50, 51}


def test_texts_of_many_candidates_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BROADCAST_IDS", 0)
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(50)], DOCS.replace("doc_id", "doc"))
    met = metric_join.maybe_of(texts, texts.where("doc < 9").select("doc"), 9)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and met.columns == ["doc", "text"]
    assert set(range(9)) <= {x.doc for x in met.collect()} and met.count() < 50
