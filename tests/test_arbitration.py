"""Arbitration of two readers against a plain loop over each page."""

import random

from pyspark.sql import functions as F

from corvane.operators.arbitration import arbitrate_pages, has_same_text

KIND = "doc int, page int, pos int, seq_id string, bbox array<int>, type string, content string, score double, reading_order int, equation_failed boolean, equation_marker string, source string"
NAMES = [c.split()[0] for c in KIND.split(", ")]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    total = sum(max(0, x[2] - x[0]) * max(0, x[3] - x[1]) for x in (a, b)) - inter
    return inter / total if total > 0 else 0


def inside(s, b):
    return b[0] <= (s[0] + s[2]) / 2 <= b[2] and b[1] <= (s[1] + s[3]) / 2 <= b[3]


def failed(t):
    return t in ("", "[Equation]") or "Failed to OCR Equation" in t


def tex(t):
    return not failed(t) and any(c in t for c in "\\^_{}=+")


def decide(kind, a, sa, b, sb):
    if kind == "Equation":
        if failed(a) or failed(b):
            return ("<Failed to OCR Equation>", "equation_failed") if failed(a) and failed(b) else (b, "stack_b_override") if failed(a) else (a, "stack_a")
        if tex(a) and tex(b):
            return (b, "stack_b_override") if sb > sa + 0.1 else (a, "stack_a")
        if tex(a) or tex(b):
            return (a, "stack_a") if tex(a) else (b, "stack_b_override")
        return (b, "stack_b_override") if len(b) > len(a) and sb > sa + 0.2 else (a, "stack_a")
    if (len(a) < 3 and len(b) > 3 or a in ("[Figure]", "[Table]")) and b or sb > sa + 0.1 and len(b) >= max(3, int(len(a) * 0.85)) or kind in ("Figure", "Table") and len(b) > len(a):
        return b, "stack_b_override"
    return a, "stack_a"


def alike(a, b):
    a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
    x, y = set(a.split()), set(b.split())
    return bool(a and b) and (a in b or b in a or len(x & y) / len(x | y) >= 0.6)


def plain(a_rows, b_rows):
    out, used = [], set()
    for a in a_rows:
        if not a["bbox"] or len(a["bbox"]) < 4:
            continue
        seq = (a["seq_id"] or "").strip()
        own = [i for i, b in enumerate(b_rows) if seq and (b["seq_id"] or "").strip() == seq]
        by_id = bool(own)
        if not own:
            own = [i for i, b in enumerate(b_rows) if b["bbox"] and len(b["bbox"]) >= 4 and (iou(a["bbox"], b["bbox"]) > 0.1 or inside(b["bbox"], a["bbox"]))]
        used |= set(own)
        texts = [(b_rows[i]["content"] or "").strip() for i in own]
        sb = sum(b_rows[i]["score"] or 0 for i in own) / len(own) if own else 0.0
        content, source = decide(a["type"] or "", (a["content"] or "").strip(), a["score"] or 0.0, " ".join(t for t in texts if t), sb)
        for i, t in zip(own, texts):
            if source != "stack_b_override" and not by_id and t and not alike(t, content):
                used.discard(i)
        if a["type"] == "Equation":
            pick = b_rows[own[0]] if source == "stack_b_override" and own else a
            if pick["equation_failed"] or failed(content):
                content = (pick["equation_marker"] or "").strip() or "<Failed to OCR Equation>"
        out.append((a, "a", content, source))
    for i, b in enumerate(b_rows):
        if i not in used and b["bbox"] and len(b["bbox"]) >= 4 and not any(iou(b["bbox"], x[0]["bbox"]) > 0.2 or inside(b["bbox"], x[0]["bbox"]) for x in out):
            out.append((b, "b", (b["content"] or "").strip(), "stack_b_rescue"))
    return [(r, x["pos"], c, s) for x, r, c, s in sorted(out, key=lambda x: ((x[0]["reading_order"] or 0) if (x[0]["reading_order"] or 0) > 0 else 10**9, x[0]["bbox"][1], x[0]["bbox"][0]))]


def found(df):
    got = {}
    for r in df.orderBy("doc", "page", "n").collect():
        got.setdefault((r.doc, r.page), []).append((r.reader, r.pos, r.content, r.source))
    return got


def test_pages_equal_a_plain_loop(spark):
    r = random.Random(1)
    words = "alpha beta gamma x=1 \\frac delta [Figure] epsilon".split()

    def block(page, pos, own):
        x, y = r.randrange(0, 200, 20), r.randrange(0, 300, 20)
        box = [x, y, x + r.choice([40, 100]), y + r.choice([20, 60])]
        text = r.choice(["", "  ", None, "[Equation]", " ".join(r.choice(words) for _ in range(r.randint(1, 6)))])
        marks = (r.choice([None, True, False]), r.choice([None, "", " mark "]), "src")
        return (1, page, pos, r.choice([f"s{r.randint(0, 12)}", f"{own}{pos}", "", None]), r.choice([box, box, box, box, None, [1, 2]]), r.choice(["Body", "Equation", "Figure", "Table", None]), text, r.choice([None, 0.0, 0.5, 0.55, 0.7, 0.9]), r.choice([None, 0, pos % 4]), *marks)

    a = [block(p, i, "a") for p in range(60) for i in range(r.randint(0, 9))]
    b = [block(p, i, "b") for p in range(62) for i in range(r.randint(0, 12))]
    got = found(arbitrate_pages(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND), ["doc", "page"]))
    for p in range(62):
        rows = [[dict(zip(NAMES, x)) for x in side if x[1] == p] for side in (a, b)]
        assert got.get((1, p), []) == plain(*rows), p
    sources = {s for x in got.values() for *_, s in x}
    assert sources == {"stack_a", "stack_b_override", "stack_b_rescue", "equation_failed"}


def test_place_matched_text_is_given_back_and_rescued(spark):
    a = spark.createDataFrame([(1, 1, 0, "a1", [0, 0, 100, 100], "Body", "kept text of reader a", 0.9, None, None, None, None)], KIND)
    b = spark.createDataFrame([(1, 1, 0, "b1", [0, 80, 100, 180], "Body", "something else entirely", 0.5, None, None, None, None), (1, 1, 1, "b2", [0, 85, 100, 185], "Body", "covered by the rescue before", 0.5, None, None, None, None)], KIND)
    rows = arbitrate_pages(a, b, ["doc", "page"]).orderBy("n").collect()
    assert [(r.source, r.seq_id, r.n) for r in rows] == [("stack_a", "a1", 1), ("stack_b_rescue", "b1", 2)]
    same = spark.createDataFrame([(1, 1, 0, "b1", [0, 80, 100, 180], "Body", "TEXT of  reader", 0.5, None, None, None, None)], KIND)
    assert [r.source for r in arbitrate_pages(a, same, ["doc", "page"]).collect()] == ["stack_a"]


def test_blocks_of_few_columns_and_empty_tables(spark):
    few = "doc int, page int, pos int, seq_id string, bbox array<int>, type string, content string, score double"
    none = spark.createDataFrame([], few)
    assert arbitrate_pages(none, none, ["doc", "page"]).collect() == []
    one = spark.createDataFrame([(1, 1, 0, None, [0, 0, 9, 9], "Body", "x", None)], few)
    assert [(r.reader, r.source, r.score) for r in arbitrate_pages(none, one, ["doc", "page"]).collect()] == [("b", "stack_b_rescue", 0.0)]
    assert [(r.reader, r.source) for r in arbitrate_pages(one, none, ["doc", "page"]).collect()] == [("a", "stack_a")]


def test_texts_move_once(spark):
    few = "doc int, page int, pos int, seq_id string, bbox array<int>, type string, content string, score double"
    rows = spark.createDataFrame([(1, 1, 0, "a", [0, 0, 9, 9], "Body", "x", 0.5)], few)
    plan = arbitrate_pages(rows, rows, ["doc", "page"])._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange hashpartitioning"), plan.count("Join"), plan.count("Window")) == (1, 0, 0)


def test_pages_without_a_key_and_boxes_with_nulls(spark):
    few = "doc int, page int, pos int, seq_id string, bbox array<int>, type string, content string, score double"
    a = [(None, 1, 0, "s", [0, 0, 100, 100], "Body", "own", 0.5), (1, 1, 0, "s", [0, None, 100, 100], "Body", "own", 0.5)]
    b = [(None, 1, 0, "s", [0, 0, 100, 100], "Body", "other", 0.9), (1, 1, 0, "t", [0, 10, 100, 100], "Body", "other", 0.9)]
    rows = arbitrate_pages(spark.createDataFrame(a, few), spark.createDataFrame(b, few), ["doc", "page"]).collect()
    got = {(r.doc, r.reader): (r.source, r.content) for r in rows}
    assert got == {(None, "a"): ("stack_a", "own"), (None, "b"): ("stack_b_rescue", "other"), (1, "a"): ("stack_a", "own"), (1, "b"): ("stack_b_rescue", "other")}


def test_contents_lose_every_kind_of_white_space(spark):
    few = "doc int, page int, pos int, seq_id string, bbox array<int>, type string, content string, score double"
    text = "\u2003\x85\n kept \xa0\u3000\u200b"
    a = spark.createDataFrame([(1, 1, 0, " s\u2028", [0, 0, 9, 9], "Body", text, 0.5)], few)
    row = arbitrate_pages(a, a.limit(0), ["doc", "page"]).first()
    assert (row.seq_id, row.content) == ("s", "kept \xa0\u3000\u200b")


def test_texts_that_are_the_same(spark):
    rows = [("A  b", "a B c", True), ("a b c d", "d c b a", True), ("a b c", "a b d", False), ("a b c d x", "a b d c y", True), ("", "a", False), (" ", " ", False), ("a a a b c", "c b q", False), ("q r s t", "t", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want == alike(r.a, r.b) for r in df.select("*", has_same_text(F.col("a"), F.col("b")).alias("got")).collect())
