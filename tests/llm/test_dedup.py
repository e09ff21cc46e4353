import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.line_dedup import CompactIndex, MinimalPerfectHash, line_dedup
from corvane.llm.near_dedup import drop_near_duplicates, near_duplicates, shingle_set

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, least=10):
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(k) >= least:
                holders[k].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[x.strip(" \t\n\x0b\x0c\r").translate(LOWER)]) < 2 or min(holders[x.strip(" \t\n\x0b\x0c\r").translate(LOWER)]) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_minimal_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    mph = MinimalPerfectHash(keys)
    assert mph.n == len(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    assert MinimalPerfectHash(np.zeros(0, dtype=np.uint64)).n == 0


def test_compact_index_tells_all_hashes_apart():
    r = np.random.default_rng(2)
    h1, h2 = r.integers(0, 40, 300).astype(np.uint64), r.integers(0, 6, 300).astype(np.uint64)  # first halves clash
    index = CompactIndex(h1, h2)
    slot = index.find(h1, h2)
    of = {(a, b): s for a, b, s in zip(h1.tolist(), h2.tolist(), slot.tolist())}
    assert index.n == len(of) and sorted(of.values()) == list(range(index.n))
    assert index.find(np.array([1000, h1[0]], dtype=np.uint64), np.array([0, 77], dtype=np.uint64)).tolist() == [-1, -1]
    assert CompactIndex(h1[:0], h2[:0]).find(h1, h2).tolist() == [-1] * 300


def test_line_dedup_against_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice(["alpha", "Beta", "äöü", "x"]) for _ in range(r.randint(1, 5))) for _ in range(30)]
    rows = [(i, r.choice(["\n", "\r\n"]).join(r.choice(["", " ", "\t"]) + r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same line of text\nsame line of text"), (103, "SAME line of text  "), (104, "short"), (105, "short"), (106, "long " * 5000 + "\nsame line of text")]
    docs = spark.createDataFrame([(d, t, "extra", 1) for d, t in rows], DOCS + ", `odd name` string, n_lines int").withColumn("__blk", F.lit("b")).withColumn("BLK", F.lit(1))
    out = line_dedup(docs, blocks=5, shards=3)
    assert out.columns == ["doc_id", "text", "odd name", "__blk", "BLK", "n_lines", "n_dropped"]
    assert sorted((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in out.collect()) == brute_lines(rows)


def test_line_dedup_empty_null_and_repeated_ids(spark):
    assert line_dedup(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, "a line that is long"), (1, "a line that is long"), (None, "a line that is long"), (2, "another line here")]
    out = {(x.doc_id, x.text, x.n_dropped) for x in line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {(1, "a line that is long", 0), (None, "", 1), (2, "another line here", 0)}
    # Rows without an id are one document, wherever their texts take them.
    alone = [(None, f"only without an id\n{i}") for i in range(9)]
    assert {x.n_dropped for x in line_dedup(spark.createDataFrame(alone, DOCS), blocks=7, shards=2).collect()} == {0}


def expected_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    return sorted((d, max(groups[(t or "").translate(LOWER)]), len(groups[(t or "").translate(LOWER)]), d == max(groups[(t or "").translate(LOWER)])) for d, t in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_checks_bytes(spark, tmp_path, weak):
    rows = [(1, "Same"), (2, "same"), (3, "SAME"), (4, "ÄB"), (5, "äb"), (6, None), (7, ""), (8, "other"), (9, "x" * 50000), (10, "X" * 50000), (11, "äB")]
    rows += [(20 + i, "hot copy") for i in range(300)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(d, t, "z") for d, t in rows], DOCS + ", keep_id string").repartition(3).write.parquet(path)
    # A digest of the length alone makes different texts meet; their bytes must part them.
    digest = (lambda t: F.length(t).cast("string")) if weak else (lambda t: F.sha2(t, 256))
    out = exact_dedup(spark, path, digest=digest, files_per_batch=1)
    assert sorted((x.doc_id, x.keep_id, x.group_size, x.kept) for x in out.collect()) == expected_groups(rows)


def brute_exact(rows):
    """(id, keep_id, group_size) of each row, and how many rows of each text are kept: one."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    top = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, top[(t or "").translate(LOWER)], len(groups[(t or "").translate(LOWER)])) for d, t in rows), key=str), len(groups)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_repeated_rows_and_null_ids(spark, tmp_path, weak):
    rows = [(1, "ab"), (2, "cd"), (2, "cd"), (3, "xy"), (None, "zz"), (5, "zz"), (None, "qq"), (None, "qq"), (7, "same"), (7, "same"), (7, "emas"), (7, None), (None, "")]
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(path)
    digest = (lambda t: F.length(t).cast("string")) if weak else (lambda t: F.sha2(t, 256))
    out = exact_dedup(spark, path, digest=digest).collect()
    want, groups = brute_exact(rows)
    assert sorted(((x.doc_id, x.keep_id, x.group_size) for x in out), key=str) == want
    kept = [x for x in out if x.kept]
    assert len(kept) == groups and all(x.doc_id == x.keep_id for x in kept)


def test_exact_dedup_deals_hot_digests(spark, tmp_path):
    """A digest of over 1,000 rows goes to several tasks, with and without equal bytes."""
    rows = [(i, ("HOT" if i % 2 else "hot") if i % 7 else "tho") for i in range(5200)] + [(9000 + i, f"text {i}") for i in range(50)]
    path = str(tmp_path / "hot.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    for digest in (lambda t: F.sha2(t, 256), lambda t: F.length(t).cast("string")):
        out = exact_dedup(spark, path, digest=digest)
        assert sorted((x.doc_id, x.keep_id, x.group_size, x.kept) for x in out.collect()) == expected_groups(rows)


def test_exact_dedup_empty_and_single_file(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    assert exact_dedup(spark, path).collect() == []
    spark.createDataFrame([(1, "a"), (None, "a"), (2, "b")], DOCS).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    file = next((tmp_path / "one.parquet").glob("part-*.parquet"))
    got = {(x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup(spark, str(file)).collect()}
    assert got == {(1, 1, 2, True), (None, 1, 2, False), (2, 2, 1, True)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (5, 4)]
    got = {(x.node, x.component) for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 41)} | {(i, 100) for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_near(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_brute_force(spark, words):
    r = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 120, 300]))]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 5, 9])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), r.choice([" ", "\n", "\t"]).join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (505, "one two"), (506, "ONE TWO"), (507, "É"), (508, "é")]
    got = near_duplicates(spark.createDataFrame([(d, t, 0) for d, t in rows], DOCS + ", kept int"), words=words)
    assert sorted(tuple(x) for x in got.collect()) == brute_near(rows, words, 80)


def brute_near_of_few(rows):
    """As brute_near, over the few distinct texts."""
    first = {}
    for d, t in sorted(rows):
        first.setdefault(t, d)
    of = {d: (n, c) for d, n, c, _ in brute_near([(d, t) for t, d in first.items()], 2, 80)}
    return sorted((d, of[first[t]][0], of[first[t]][1], d == of[first[t]][1]) for d, t in rows)


def test_near_duplicates_large_group_is_split_into_cells(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(900):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(60)] = f"x{r.randrange(100000)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, DOCS), words=2)
    assert sorted(tuple(x) for x in got.collect()) == brute_near(rows, 2, 80)


def test_near_duplicates_nulls_repeats_and_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "A b c d e f g")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(x) for x in near_duplicates(docs).collect()), key=str)
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True)]
    left = drop_near_duplicates(docs.withColumn("own", F.lit("x"))).collect()
    assert sorted((str(x.doc_id), x.own) for x in left) == [("1", "x"), ("None", "x")]
    two = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (1, "u v w x y z"), (4, "u v w x y z")], DOCS)
    assert [x.doc_id for x in drop_near_duplicates(two).collect()] == [1]


def test_near_duplicates_hot_copies_are_dealt(spark):
    rows = [(i, "copy of one text that is held by many rows") for i in range(2600)] + [(5000 + i, f"copy of one text that is held by many rows {i % 3}") for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, DOCS), words=2).collect()
    assert sorted(tuple(x) for x in got) == brute_near_of_few(rows)


def test_shingles_ignore_case_of_a_to_z_only():
    assert (shingle_set("A b C d e".encode(), 2) == shingle_set("a B c D E".encode(), 2)).all()
    assert len(shingle_set("É".encode(), 2)) == 1 and (shingle_set("É".encode(), 2) != shingle_set("é".encode(), 2)).all()
    big = " ".join(f"w{i}" for i in range(300000)).encode()
    assert len(shingle_set(big, 5)) == 299996
