import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from corvane.llm.conversation_trie import Patricia, common_prefixes, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16], role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - int(np.fmod(c, 20))
        out[c] = tuple(own.get(head, [])[:h] + x[h:])
    return out


def brute(rows):
    seqs = rebuilt(rows)
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for s, who in members.items():
        inside = [x for x in members if x[: len(s)] == s]
        kids = [x for x in inside if len(x) == len(s) + 1]
        leaves = [x for x in inside if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in inside if x)
        ends = ",".join(str(c) for c in sorted(who) if len(seqs[c]) == len(s))
        out.append((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_trie_against_brute_force(spark, parts):
    r = random.Random(parts)
    rows = [(c, k, r.choice(["user", "bot"]), r.choice(["a b", "c", "", "d e f"])) for c in range(-5, 90) for k in range(r.randint(1, 6))]
    rows += [(200 + 20 * k, 0, "user", "hot first turn") for k in range(30)] + [(200 + 20 * k, 1, "bot", f"answer {k % 3}") for k in range(20)]
    rows += [(c, 0, "user", "one and the same") for c in range(1000, 1200)]
    rows += [(1300, k, "user", f"turn {k}") for k in range(120)] + [(None, 0, "user", "lost")]
    r.shuffle(rows)
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA), parts)) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(20, None, None, None), (20, 1, "", ""), (21, 0, "u", "x y"), (21, 0, "u", "x y"), (21, 0, "a", "z"), (40, 3, "u", None), (41, 3, "ä", "ö ü" * 5000), (59, None, "u", " \t\n"), (7, 0, "1:a", "b"), (27, 0, "1", ":ab")]
    df = spark.createDataFrame([(*x, 1, "s", b"k") for x in rows], SCHEMA + ", n_convs int, sid string, seq binary")
    got = prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(got) == brute(rows)
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    only = [(c, 0, "u", "t") for c in (1, 21, 61, 81)]  # some rebuild to nothing
    assert found(prefix_trie(spark.createDataFrame(only, SCHEMA))) == brute(only)


def test_long_runs_of_ids_are_hashed_in_pieces(spark, monkeypatch):
    from corvane.llm import conversation_trie

    rows = [(c, 0, "u", "same") for c in range(0, 8000, 20)]
    want = hashlib.sha256(",".join(str(c) for c in range(0, 8000, 20)).encode()).hexdigest()
    batches = conversation_trie._runs
    monkeypatch.setattr(conversation_trie, "PIECE", 20 * 7)
    import pyarrow as pa

    pieces = list(batches([pa.RecordBatch.from_arrays([pa.array([b"s"] * 50), pa.array(range(50))], names=["sid", "conv"])]))[0]
    assert pieces.num_rows > 5 and not any(pieces.column(4).to_pylist())
    joined = list(conversation_trie._join_runs([pieces]))[0]
    assert joined.column(3).to_pylist() == [hashlib.sha256(",".join(map(str, range(50))).encode()).digest()]
    got = {r.ends_sha256 for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).where("depth = 1").collect()}
    assert got == {want}


def test_points_only_at_ends_branches_and_leaves():
    seqs = [[1, 2, 3, 4], [1, 2, 5], [1, 2, 5, 6, 7]]
    flat = np.array([x for s in seqs for x in s], dtype=np.uint64)
    keys, offsets = np.stack([flat, flat], axis=1), np.array([0, 4, 7, 12])
    assert common_prefixes(keys, offsets).tolist() == [0, 2, 3]
    t = Patricia(keys, np.ones(12, dtype=np.int64), offsets, np.array([1, 1, 1]), np.array([9, 4, 6]))
    assert sorted(t.depth) == [0, 2, 3, 4, 5]  # nothing at 1, and one edge of two turns to 5
    assert t.leaves[0] == 2 and t.count[0] == 3 and t.lead[0] == 4 and t.saved[0] == 2 + 2 + 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_supplied_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(prefix_trie(df)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
