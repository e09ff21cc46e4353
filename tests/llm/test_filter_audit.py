import os
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from corvane.llm.filter_audit import MASKS, ORDERS, audit_filters, outcome_matrices

SF = "/root/testdata/sf0.001"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def fails_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    return out + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out, by_filter = defaultdict(Counter), Counter()
    rows = []
    for d, text, part in docs:
        text = text or ""
        e = d is not None and any(x is not None and x < d and (t or "") == text for x, t, _ in docs)
        rows.append((part or "", fails_of(text) + "E" * e, d in good, d in toxic))
    for order in permutations("ABCDE"):
        for part, fails, g, t in rows:
            gone = False
            for step, x in enumerate(order, 1):
                c = out[part, "".join(order), step]
                c["unique_fails"] += fails == x
                if x in fails and gone:
                    c["redundant"] += 1
                elif x in fails:
                    gone = True
                    c.update({"removed": 1, "good_lost": int(g), "toxic_lost": int(t)})
                    by_filter[part, x] += 1
                elif not gone:
                    c["kept"] += 1
    return {k: tuple(c[x] for x in COLUMNS) + (by_filter[k[0], k[1][k[2] - 1]],) for k, c in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in [*COLUMNS, "shapley"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_matrices_partition_the_documents():
    m = outcome_matrices()
    assert all(x.shape == (32, 600) and x.dtype == np.int64 for x in m.values())
    last = m["kept"].reshape(MASKS, len(ORDERS), 5)[:, :, -1]
    removed = m["removed"].reshape(MASKS, len(ORDERS), 5).sum(axis=2)
    assert (last + removed == 1).all()  # kept by all or removed once, in every order
    assert (m["kept"] * (m["removed"] + m["redundant"]) == 0).all() and m["unique"].sum() == 600


def test_audit_against_brute_force(spark):
    lots = " ".join(f"w{i}" for i in range(250))
    rows = [(5, lots, "a"), (3, lots, "b"), (9, lots, "a"), (9, lots, "a"), (3, lots, "a"), (None, lots, "a"), (1, None, None), (2, "", ""), (4, " \t\n", "b")]
    rows += [(10, "same " * 300, "b"), (11, "ABC " * 300, "b"), (12, lots + " # $", "a"), (13, "É" * 5, "c"), (14, "x" * 70000, "c"), (15, "AB" + "x" * 98, "c"), (16, "ABC" + "x" * 97, "c"), (17, lots.upper(), "a")]
    labels = [(3, 1, 0), (9, 1, 1), (9, 0, None), (10, None, 1), (77, 1, 1), (None, 1, 1), (5, 0, 1)]
    docs = spark.createDataFrame([(d, t, s, 1, "x", "y") for d, t, s in rows], "doc_id long, text string, source string, mask int, digest string, part string")
    got = found(audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, source string")
    got = found(audit_filters(one, labels))
    assert len(got) == 600 and {k[0] for k in got} == {""}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_supplied_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert found(audit_filters(docs, labels)) == brute(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
