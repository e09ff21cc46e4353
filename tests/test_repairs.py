"""Refills, first usable sources, project maps and comparisons against plain Python."""

from pyspark.sql import functions as F

from corvane.functions import cleaning as C
from corvane.operators import repairs as R

SECTION = "paper_id string, n int, section_label string, source_block_refs array<string>, content_en string, content_zh string, extra int"
BLOCK = "paper_id string, page int, block int, content string, content_zh string"
LONG = "This paragraph says something about the data that was measured, number {}."


def test_only_empty_languages_are_filled(spark):
    blocks = [("a", 1, 1, LONG.format(1), "第一段中文內容。"), ("a", 1, 2, LONG.format(1), None), ("a", 2, 1, LONG.format(2), "第二段中文內容。"), ("a", 2, 2, "tiny", ""), ("b", 3, 1, "All rights reserved by the publisher", None), ("b", 3, 2, LONG.format(7), None), ("b", 3, 9, LONG.format(9), None), ("b", 4, 1, LONG.format(8), None), ("c", 1, 1, "short", None)]
    sections = [
        ("a", 0, "Results", [" p2-b1 ", "p1-b1", "p1-b2", "p9-b9", None], " \n", "", 1), ("a", 1, "Methods", ["p1-b1"], "own text", None, 2), ("a", 2, "Discussion", ["p2-b2"], "", "自己", 3), ("a", 3, "Abstract", None, None, None, 4),
        ("b", 0, " ABSTRACT ", ["p9-b1"], "", "", 5), ("c", 0, "Abstract", [], "", "", 6), ("c", 1, "Results", [], "", "", 7),
    ]
    said = [("a", " " + LONG.format(3) + " ", None), ("b", "", "這裡有一段足夠長的中文摘要，說明研究的方法以及結果的意義與限制。")]
    got = {(r.paper_id, r.n): r for r in R.refill_languages(spark.createDataFrame(sections, SECTION), spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(said, "paper_id string, abstract_en string, abstract_zh string")).collect()}
    assert len(got) == len(sections) and got["a", 0].extra == 1
    assert (got["a", 0].content_en, got["a", 0].content_zh, got["a", 0].repaired) == (LONG.format(2) + "\n\n" + LONG.format(1), "第二段中文內容。\n\n第一段中文內容。", 2)
    assert (got["a", 1].content_en, got["a", 1].content_zh, got["a", 1].repaired) == ("own text", "第一段中文內容。", 1)
    assert (got["a", 2].content_en, got["a", 2].content_zh, got["a", 2].repaired) == ("tiny", "自己", 1)  # shorter than a line: the text as it is
    assert (got["a", 3].content_en, got["a", 3].content_zh, got["a", 3].repaired) == (LONG.format(3), None, 1)
    assert (got["b", 0].content_en, got["b", 0].repaired) == (LONG.format(7), 2) and got["b", 0].content_zh.startswith("這裡有")
    assert got["c", 0].repaired == 0 and got["c", 1].repaired == 0 and got["c", 0].content_en == ""
    none = spark.createDataFrame([], SECTION)
    assert R.refill_languages(none, spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(said, "paper_id string, abstract_en string, abstract_zh string")).collect() == []


def test_refills_are_cut_and_cleaned(spark):
    texts = [f"{i} " + f"word{i} " * 60 for i in range(30)]
    blocks = spark.createDataFrame([("a", 1, i, x, "字" * 10 + x) for i, x in enumerate(texts)], BLOCK)
    section = spark.createDataFrame([("a", 0, "Results", [f"p1-b{i}" for i in range(30)], "", "", 1)], SECTION)
    r = R.refill_languages(section, blocks, spark.createDataFrame([], "paper_id string, abstract_en string, abstract_zh string")).first()
    squashed = [" ".join(x.split()) for x in texts]
    merged = "\n\n".join(squashed)[:4200].rstrip() + "..."
    want = spark.range(1).select(C.relaxed(F.lit(merged), 8, 1600).alias("c")).first().c
    assert r.content_en == want and len(want) < 1700
    zh = "\n\n".join("字" * 10 + x for x in squashed)[:4200].rstrip() + "..."
    assert r.content_zh == spark.range(1).select(C.extractive(F.lit(zh), 20, 4200).alias("c")).first().c


def test_first_usable_source(spark):
    kind = "pid string, labels map<string,string>"
    x, y, z = {"a": "x"}, {"a": "y"}, {"a": "z"}
    db = [("p1-p", x), ("p2", y), ("p3-p", {}), ("p3", x), ("p4", None)]
    manual = [("p3", z), ("p4-p", {}), ("p4", y), ("p5", x)]
    version = [("p4-p", z), ("p5-p", y), ("p6", x), ("p6", {"a": "w"})]
    asked = spark.createDataFrame([("p1-p",), ("p2-p",), ("p3-p",), ("p4-p",), ("p5-p",), ("p6",), ("p7",), ("p2-p",)], "pid string")
    usable = F.size("labels") > 0
    got = R.first_usable(asked, [(n, spark.createDataFrame(d, kind), usable) for n, d in (("db", db), ("manual", manual), ("v1", version))], ["labels"])
    # p3-p: its own empty row hides the base's in the table; p4-p: so does the manual file.
    assert {r.pid: (r.labels, r.origin) for r in got.collect()} == {"p1-p": (x, "db"), "p2-p": (y, "db"), "p3-p": (z, "manual"), "p4-p": (z, "v1"), "p5-p": (x, "manual"), "p6": (x, "v1"), "p7": (None, "")}


def test_project_map(spark):
    rows = [("p", 1, "a", "T", 2000, None), ("p", 2, "a", None, None, "s"), ("p", 3, "b", "U", 1999, ""), ("p", 4, None, "V", None, "s"), ("q", 1, None, None, None, None)]
    got = {r.pid: r for r in R.project_map(spark.createDataFrame(rows, "pid string, pos int, paper_id string, title string, year int, summary string")).collect()}
    assert got["p"]["count"] == 4 and {k: tuple(v) for k, v in got["p"].papers.items()} == {"a": ("Unknown", "Unknown", True), "b": ("U", "1999", False)}
    assert got["q"]["count"] == 1 and got["q"].papers == {}


POINT = "array<struct<dimension:string,baseline_view:string,target_view:string,synthesis:string,significance:string>>"


def plain(points):
    by = {}
    for p in points or []:
        if (p[0] or "").strip():
            by[p[0].strip()] = p
    out = []
    for dim in R.DIMENSIONS:
        src = by.get(dim) or next((v for k, v in by.items() if dim[:2] in k or k[:2] in dim), None)
        if src:
            b, t, s, g = (str(src[i] or d).strip() for i, d in ((1, "N/A"), (2, "N/A"), (3, "N/A"), (4, "Medium")))
            out.append((dim, b[:220], t[:220], s[:260], g))
        else:
            out.append((dim, "N/A", "N/A", "資料不足，待補充比較證據。", "Low"))
    return out


def test_comparison_points(spark):
    d = R.DIMENSIONS
    rows = [
        None, [], [(None, "a", "b", "c", "d"), (" ", "a", "b", "c", "d")], [(d[0], "first", None, "", None), (d[0], "last", " t ", "s" * 300, "High")], [("方法", "m", "n", "o", "p"), ("方法論", "q", "r", "s", "t")],
        [("限制條件", "x" * 250, "", None, " "), (d[4] + " ", " y ", "z", "w", "Low")], [("研究", "r", "", "", ""), ("其他", "o", "", "", ""), ("x", "u", "", "", "")], [("與", "one character", "", "", "")],
    ]
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, p {POINT}").withColumn("c", R.comparison_points(F.col("p"))).withColumn("text", R.comparison_text(F.col("c")))
    for r in df.collect():
        want = plain(rows[r.i])
        assert [tuple(x) for x in r.c] == want, r.i
        assert r.text == "\n\n".join(f"【{a}】\n基準: {b}\n對照: {c}\n評析: {s}" for a, b, c, s, _ in want)
