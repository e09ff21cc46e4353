"""Captions assigned to figures and tables, and boxes merged, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.regions import Region
from corvane.operators.captions import assign_captions, is_caption_candidate, pair_reason, pair_score
from corvane.operators.layout import reading_order
from corvane.operators.pages import merge_boxes

W, H = 700, 1000
PAIR = "a array<int>, b array<int>, ac string, bc string, at string, bt string, want string"


def reason(a, b, ac, bc, at, bt):
    if a is None or b is None or len(a) < 4 or len(b) < 4:
        return "BAD_BBOX"
    if a[2] <= a[0] or a[3] <= a[1] or b[2] <= b[0] or b[3] <= b[1]:
        return "BAD_GEOMETRY"
    ac, bc = ac or "full", bc or "full"
    if ac != bc and not {ac, bc} <= {"full", "span"}:
        return "CAPTION_NOT_SAME_COLUMN"
    if max(0, min(a[2], b[2]) - max(a[0], b[0])) / max(1, min(a[2] - a[0], b[2] - b[0])) < 0.18:
        return "CAPTION_X_OVERLAP_LOW"
    if b[1] < a[3] and b[3] > a[1]:
        return "CAPTION_NOT_ABOVE_OR_BELOW"
    if b[1] >= a[3]:
        if b[1] - a[3] > max(6, int(H * 0.10)):
            return "CAPTION_GAP_TOO_FAR"
    elif a[1] - b[3] > max(4, int(H * 0.07)):
        return "CAPTION_GAP_TOO_FAR_TOP"
    if bt not in ("Figure", "Table"):
        return "CAPTION_TYPE_UNKNOWN"
    if at not in ("Figure", "Table"):
        return "MAIN_TYPE_INVALID"
    if at != bt:
        return "CAPTION_TYPE_MISMATCH"
    return "CAPTION_TOO_TALL" if b[3] - b[1] > max(int(H * 0.20), int((a[3] - a[1]) * 0.95)) else "OK"


def score(a, b, ac, bc):
    if a[2] <= a[0] or a[3] <= a[1] or b[2] <= b[0] or b[3] <= b[1]:
        return 0.0
    w, u = a[2] - a[0], b[2] - b[0]
    over = max(0, min(a[2], b[2]) - max(a[0], b[0])) / min(w, u)
    below = max(0.0, 1 - (b[1] - a[3]) / max(1, int(H * 0.09))) if b[1] >= a[3] else 0.0
    above = 0.85 * max(0.0, 1 - (a[1] - b[3]) / max(1, int(H * 0.03))) if a[1] >= b[3] else 0.0
    if over < 0.18 or max(below, above) <= 0:
        return 0.0
    return min(1.0, 0.55 * over + 0.25 * max(below, above) + 0.12 * (1 - min(1.0, abs(w - u) / max(w, u))) + 0.08 * (ac == bc or "span" in (ac, bc)))


def test_every_reason(spark):
    main = [100, 300, 300, 400]
    rows = [
        (None, main, "left", "left", "Figure", "Figure", "BAD_BBOX"), ([1, 2, 3], main, "", "", "", "", "BAD_BBOX"), (main, [5, 5, 5, 9], "left", "left", "Figure", "Figure", "BAD_GEOMETRY"),
        (main, [100, 410, 300, 430], "left", "right", "Figure", "Figure", "CAPTION_NOT_SAME_COLUMN"), (main, [100, 410, 300, 430], "left", None, "Figure", "Figure", "CAPTION_NOT_SAME_COLUMN"), (main, [270, 410, 470, 430], "left", "left", "Figure", "Figure", "CAPTION_X_OVERLAP_LOW"),
        (main, [100, 390, 300, 430], "left", "left", "Figure", "Figure", "CAPTION_NOT_ABOVE_OR_BELOW"), (main, [100, 501, 300, 520], "left", "left", "Figure", "Figure", "CAPTION_GAP_TOO_FAR"), (main, [100, 200, 300, 229], "left", "left", "Figure", "Figure", "CAPTION_GAP_TOO_FAR_TOP"),
        (main, [100, 410, 300, 430], "left", "left", "Figure", "", "CAPTION_TYPE_UNKNOWN"), (main, [100, 410, 300, 430], "left", "left", None, "Table", "MAIN_TYPE_INVALID"), (main, [100, 410, 300, 430], "left", "left", "Figure", "Table", "CAPTION_TYPE_MISMATCH"),
        (main, [100, 410, 300, 611], "left", "left", "Figure", "Figure", "CAPTION_TOO_TALL"), (main, [100, 410, 300, 610], "left", "left", "Figure", "Figure", "OK"), (main, [100, 500, 300, 520], "full", "span", "Table", "Table", "OK"), (main, [100, 200, 300, 230], None, "", "Table", "Table", "OK"),
    ]
    assert {reason(*r[:6]) for r in rows} == {r[6] for r in rows} and len({r[6] for r in rows}) == 12
    got = spark.createDataFrame(rows, PAIR).select("want", pair_reason(F.col("a"), F.col("b"), F.col("ac"), F.col("bc"), F.lit(H), F.col("at"), F.col("bt")).alias("got"))
    assert [(r.got, r.want) for r in got.collect() if r.got != r.want] == []


KIND = "d int, pos int, bbox array<int>, column string, page_w int, page_h int, is_major boolean, is_caption boolean, pred string, figure_score double, table_score double, can_figure boolean, can_table boolean, target string, embedded string, embedded_by string, read_target string, reasons array<string>"
NAMES = [c.split()[0] for c in KIND.split(", ")]


def plain(rows):
    used, out, n = set(), {}, {"Figure": 0, "Table": 0}
    for m in sorted((r for r in rows if r["is_major"]), key=lambda r: (r["bbox"][1], r["bbox"][0], r["pos"])):
        kind = m["pred"] if m["pred"] in n else "Table" if (m["table_score"] or 0) >= (m["figure_score"] or 0) else "Figure"
        best, top = None, 0.0
        for c in rows:
            t = c["target"] or ""
            if not c["is_caption"] or c["is_major"] or c["pos"] in used or t not in n or not m["can_table" if t == "Table" else "can_figure"] or reason(m["bbox"], c["bbox"], m["column"], c["column"], t, t) != "OK":
                continue
            s = score(m["bbox"], c["bbox"], m["column"], c["column"])
            s = min(1.0, s + 0.1 * (t == kind)) if s > 0 else 0.0 + 0.1 * (t == kind)
            if s > top:
                best, top = (c["pos"], t, c["bbox"]), s
        codes, inner = set(m["reasons"] or []), False
        if best is None:
            t = m["embedded"] if m["embedded"] in n else m["read_target"] or ""
            sure = m["embedded_by"] in ("ocr", "hint") if m["embedded"] in n else True
            x1, y1, x2, y2 = m["bbox"]
            if t in n and sure:
                fits = m["can_table"] if t == "Table" else m["can_figure"]
                if not fits and t == "Figure" and m["embedded_by"] == "ocr" and m["read_target"] == "Figure" and (x2 - x1) * (y2 - y1) / (W * H) >= 0.012 and x2 - x1 >= int(W * 0.16) and y2 - y1 >= int(H * 0.03):
                    fits = True
                    codes.add("EMBEDDED_FIGURE_OCR_HEAD_RELAX")
                if fits:
                    best, top, inner = (None, t, m["bbox"]), 0.6, True
            elif t in n:
                codes.add("EMBEDDED_CAPTION_UNTRUSTED")
        if best is None or top < 0.58:
            out[m["pos"]] = (False, None, None, None, m["bbox"], None, sorted(codes | {"CAPTION_REQUIRED_MISSING" if best is None else "CAPTION_PAIR_WEAK"}))
            continue
        cap, t, b = best
        used.add(cap)
        n[t] += 1
        box = m["bbox"] if inner else [min(m["bbox"][0], b[0]), min(m["bbox"][1], b[1]), max(m["bbox"][2], b[2]), max(m["bbox"][3], b[3])]
        codes |= {"CAPTION_MATCHED", "CAPTION_REQUIRED_PASS", f"CAPTION_TYPE_{t.upper()}"} | ({"CAPTION_EMBEDDED"} if inner else set()) | ({"CAPTION_TYPE_OVERRIDE"} if t != kind else set())
        out[m["pos"]] = (True, cap, t, round(top, 4), box, f"{'fig' if t == 'Figure' else 'table'}.{n[t]}", sorted(codes))
    return out


def test_assignment_equals_a_plain_loop(spark):
    r = random.Random(3)
    rows = []
    for d in range(80):
        for pos in range(r.randint(1, 9)):
            x, y, major = r.choice([20, 60, 300]), r.randrange(50, 700, 25), r.random() < 0.5
            box = [x, y, x + r.choice([90, 200, 210]), y + (r.choice([60, 120]) if major else r.choice([20, 30, 250]))]
            rows.append((d, pos, box, r.choice(["left", "left", "full", "span", ""]), W, H, major, not major or r.random() < 0.2, r.choice(["Figure", "Table", "Body"]), r.choice([None, 0.2, 0.8]), r.choice([None, 0.2, 0.8]), r.random() < 0.7, r.random() < 0.7, r.choice(["Figure", "Table", "", None]), r.choice(["Figure", "Table", "", "", None]), r.choice(["ocr", "hint", "geom", None]), r.choice(["Figure", "", None]), r.choice([None, ["old"]])))
    got = {}
    for x in assign_captions(spark.createDataFrame(rows, KIND), ["d"]).collect():
        got.setdefault(x.d, {})[x.pos] = (x.accepted, x.caption_pos, x.node_type, x.score, x.bbox, x.pair_id, x.reasons)
    for d in range(80):
        assert got.get(d, {}) == plain([dict(zip(NAMES, x)) for x in rows if x[0] == d]), d
    seen = {c for page in got.values() for v in page.values() for c in v[6]}
    assert {"CAPTION_PAIR_WEAK", "CAPTION_REQUIRED_MISSING", "CAPTION_EMBEDDED", "CAPTION_TYPE_OVERRIDE", "EMBEDDED_CAPTION_UNTRUSTED", "CAPTION_MATCHED", "old"} <= seen
    assert assign_captions(spark.createDataFrame([], KIND), ["d"]).collect() == []


def test_pair_scores(spark):
    main = [100, 100, 300, 200]
    rows = [([100, 210, 300, 230], "left"), ([100, 70, 300, 90], "span"), ([100, 300, 300, 320], "left"), ([280, 210, 480, 230], "left"), ([100, 150, 300, 170], "left"), ([100, 210, 100, 230], "left"), ([150, 210, 250, 230], "right")]
    got = [r.s for r in spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(rows)], "i int, b array<int>, c string").orderBy("i").select(pair_score(F.lit(main), F.col("b"), F.lit("left"), F.col("c"), F.lit(H)).alias("s")).collect()]
    assert got == pytest.approx([score(main, b, "left", c) for b, c in rows])


def test_caption_candidates(spark):
    names = "area_ratio text_density small_cc_count table_grid_score line_h_ratio line_v_ratio grid_intersection_ratio fg_ratio x1 y1 x2 w h page_w page_h".split()
    good = dict(zip(names, [0.01, 0.5, 5, 0.01, 0, 0, 0, 0, 50, 500, 250, 200, 30, W, H]))
    cases = [({}, True), ({"h": 261}, False), ({"h": 17}, False), ({"w": 69}, False), ({"w": 645}, False), ({"y1": 59}, False), ({"y1": 961}, False), ({"text_density": 0.3}, False), ({"small_cc_count": 2}, False), ({"table_grid_score": 0.08}, False), ({"h": 999, "hint": True}, True), ({"h": 999, "target": "Table"}, True), ({"h": 999, "target": "Body"}, False)]
    rows = [tuple(float({**good, **c}[n]) for n in names) + (c.get("hint"), c.get("target"), want) for c, want in cases]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", hint boolean, target string, want boolean")
    assert all(r.got == r.want for r in df.select("want", is_caption_candidate(Region.of_columns(), F.col("hint"), F.col("target")).alias("got")).collect())


def test_boxes_merge_in_order_of_input(spark):
    def plain_merge(boxes, page_w):
        out = []
        for x, y, w, h in boxes:
            if w < 10 or h < 10:
                continue
            for i, (a, b, c, d) in enumerate(out):
                shared = min(x + w, a + c) - max(x, a)
                v = max(0, max(y, b) - min(y + h, b + d))
                if v <= 16 and (shared > 0 or max(0, -shared) <= 24):
                    union = max(x + w, a + c) - min(x, a)
                    if union > page_w * 0.62 and max(w, c) < page_w * 0.46:
                        continue
                    out[i] = (min(x, a), min(y, b), union, max(y + h, b + d) - min(y, b))
                    break
            else:
                out.append((x, y, w, h))
        return [list(b) for b in out]

    r = random.Random(9)
    pages = [[(r.randrange(0, 560), r.randrange(0, 300), r.choice([5, 40, 120, 260]), r.choice([8, 12, 30])) for _ in range(r.randint(0, 25))] for _ in range(40)]
    rows = [(d, i, list(b)) for d, p in enumerate(pages) for i, b in enumerate(p)]
    got = {}
    for x in merge_boxes(spark.createDataFrame(rows, "d int, i int, bbox array<int>"), ["d"], "i", F.lit(600)).orderBy("d", "n").collect():
        got.setdefault(x.d, []).append(x.bbox)
    assert all(got.get(d, []) == plain_merge(p, 600) for d, p in enumerate(pages))


def test_reading_order_by_hand(spark):
    kind = "d int, seq_id string, x0 int, y0 int, column string, two_columns boolean"
    page = [("t", 0, 100, "span"), ("l2", 0, 400, "left"), ("l1", 0, 90, "left"), ("r1", 300, 80, "right"), ("r2", 300, 200, "right"), ("wide", 0, 152, "full"), ("late", 0, 153, "full"), ("odd", 9, 1, "margin")]
    seen = [(1, *p, False) for p in page] + [(2, *p, None) for p in page if p[0] != "l2"]  # a single left block: one column
    got = {}
    for x in reading_order(spark.createDataFrame([(d, s, x, y, c, t) for d, s, x, y, c, t in seen], kind), ["d"], F.lit(1000)).orderBy("d", "reading_order").collect():
        got.setdefault(x.d, []).append(x.seq_id)
    assert got == {1: ["t", "wide", "l1", "l2", "r1", "r2", "late", "odd"], 2: ["odd", "r1", "l1", "t", "wide", "late", "r2"]}


def test_body_phase_by_hand(spark):
    from corvane.functions.body import body_phase

    names = "area_ratio text_density small_cc_count table_grid_score line_h_ratio line_v_ratio grid_intersection_ratio fg_ratio x1 y1 x2 w h page_w page_h".split()
    plain_body = dict(zip(names, [0.01, 1.0, 5, 0.05, 0, 0, 0, 0, 100, 900, 900, 800, 200, 1000, 1400])) | {"t": 0.1, "f": 0.1, "b": 0.4, "e": 0.1, "col": "left", "page": 1, "lost": False, "label": None, "sure": None, "hint": None}
    cases = [
        ({}, ("Body", 0.4, [])), ({"b": None}, ("Body", 0.0, [])), ({"label": "Equation", "sure": 0.8}, ("Equation", 0.76, ["EQUATION_FALLBACK_PROMOTE", "LLM_FORCE_EQUATION"])), ({"e": 0.9, "table_grid_score": 0.02}, ("Equation", 0.9, ["EQUATION_FALLBACK_PROMOTE"])),
        ({"page": 2, "y1": 84, "h": 49, "w": 700}, ("Header", 0.7, ["RUNNING_HEADER_ZONE"])), ({"page": 1, "y1": 84, "h": 49, "w": 700}, ("Body", 0.4, [])), ({"hint": "MainTitle", "sure": 0.7}, ("MainTitle", 0.72, ["LLM_HEADING_PROMOTE"])), ({"hint": "Title", "sure": 0.9}, ("Body", 0.4, [])),
        ({"h": 20, "w": 200, "x2": 300, "y1": 800}, ("Subtitle", 0.73, ["SMALL_HEADING_ZONE"])), ({"lost": True, "t": 0.8}, ("Unknown", 0.656, ["CAPTION_REQUIRED_FAIL_DEMOTE", "DEMOTE_TO_UNKNOWN_NO_CAPTION"])), ({"lost": True}, ("Body", 0.4, ["CAPTION_REQUIRED_FAIL_DEMOTE"])),
        ({"col": None, "y1": 100, "h": 60, "w": 520}, ("MainTitle", 0.78, ["HEADER_ZONE"])), ({"y1": 100, "h": 60, "w": 520}, ("Body", 0.4, [])), ({"h": 30, "w": 400, "y1": 1000}, ("Subtitle", 0.7, ["SECTION_HEADING"])), ({"h": 29, "w": 400, "y1": 1000}, ("SubSubtitle", 0.7, ["SECTION_HEADING"])), ({"h": 29, "w": 400, "y1": 1000, "f": 0.7}, ("Body", 0.4, [])),
    ]
    keys = [*names, "t", "f", "b", "e", "col", "page", "lost", "label", "sure", "hint"]
    kinds = {"col": "string", "page": "int", "lost": "boolean", "label": "string", "hint": "string"}
    rows = [(i, *(float(v) if (v := {**plain_body, **c}[k]) is not None and k not in kinds else v for k in keys)) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{k} {kinds.get(k, 'double')}" for k in keys))
    b = body_phase(Region.of_columns(), *(F.col(c) for c in ("t", "f", "b", "e", "col", "page", "lost", "label", "sure", "hint")), F.array(F.lit(" ")))
    got = {r.i: (r.k.type, r.k.type_confidence, r.k.reasons) for r in df.select("i", b.alias("k")).collect()}
    assert [(cases[i][0], got[i], w) for i, (_, w) in enumerate(cases) if got[i] != w] == []
