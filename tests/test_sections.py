"""Sections, equations, members and small rules against plain Python."""

import base64

from pyspark.sql import functions as F

from corvane.operators import sections as S

LONG = "This paragraph says something about the data that was measured, number {}."
SUMMARY = "paper_id string, abstract_zh string, key_findings array<string>"
BLOCK = "paper_id string, page int, pages int, block int, type string, content string, content_zh string"


def test_blocks_follow_their_heading(spark):
    rows = [("a", 1, 10, 1, "Body", LONG.format(1), ""), ("a", 2, 10, 1, "Title", "1. Introduction and Background", ""), ("a", 2, 10, 2, "Body", LONG.format(2), None), ("a", 3, 10, 1, "Body", LONG.format(3), ""), ("a", 3, 10, 2, "Body", None, None), ("a", 3, 10, 3, "Title", "Methods", ""), ("b", 5, 10, 1, "Body", LONG.format(4), "")]
    s = spark.createDataFrame([("a", " 這是一段足夠長的中文摘要，用來描述方法與結果以及結論。 ", ["not used"]), ("c", "none of its blocks", None), ("b", " ", [" ", "發現一", None, "第四個"])], SUMMARY)
    got = {(r.paper_id, r.section_label): r for r in S.section_buckets(spark.createDataFrame(rows, BLOCK), s).collect()}
    assert set(got) == {("a", "Abstract"), ("a", "Introduction"), ("b", "Methods"), ("b", "Abstract")}
    assert (got["b", "Abstract"].content_zh, got["b", "Abstract"].confidence, got["b", "Abstract"].n) == ("發現一", 0.58, 2)
    a, i, m = got["a", "Abstract"], got["a", "Introduction"], got["b", "Methods"]
    assert (a.n, a.confidence, a.inferred_label, a.source_block_refs) == (1, 0.6, True, ["p1-b1", "summary.json"]) and a.content_zh.startswith("這是")
    assert (i.n, i.confidence, i.inferred_label, i.source_block_refs) == (2, 0.86, False, ["p2-b2", "p3-b1"])
    assert i.content_en == LONG.format(2) + "\n\n" + LONG.format(3) and (m.confidence, m.inferred_label) == (0.62, True)


def test_long_sections_are_cut_as_whole_texts_are(spark):
    texts = [LONG.format(i) * 20 for i in range(40)]
    rows = [("a", 5, 10, i, "Body", x, "") for i, x in enumerate(texts)]
    none = spark.createDataFrame([], SUMMARY)
    got = S.section_buckets(spark.createDataFrame(rows, BLOCK), none).first()
    whole = "\n\n".join(texts)
    seen, want, used = set(), [], 0
    for line in [x for x in (whole[:12000].rstrip() + "...").split("\n\n")]:
        if line[:180] not in seen and used + len(line) <= 12000:
            seen.add(line[:180])
            want.append(line)
            used += len(line)
    assert got.content_en == "\n\n".join(want) and len(got.source_block_refs) == 40


def test_batches_merge_by_label(spark):
    kind = "g string, batch int, pos int, section_label string, confidence double, inferred_label boolean, source_block_refs array<string>, dropped_refs array<string>, content_en string, content_zh string"
    rows = [("p", 1, 0, "Results", 1.7, True, ["r2", " r1 ", ""], ["summary.json", "d"], LONG.format(1), None), ("p", 0, 1, " ", None, None, None, None, LONG.format(2), ""), ("p", 2, 0, "RESULTS", 0.5, False, ["r1", "r3"], ["d"], LONG.format(3), ""), ("p", 3, 0, "Empty", 0.5, True, [], [], "", None)]
    rows += [("q", 0, i, f"L{i}", 0.5, True, [], [], LONG.format(i), None) for i in range(30)]
    got = S.merge_sections(spark.createDataFrame(rows, kind), "g").orderBy("g", "n").collect()
    assert [r.section_label for r in got if r.g == "p"] == [S.UNSORTED, "Results"] and sum(r.g == "q" for r in got) == 24
    r = got[1]
    assert (r.confidence, r.inferred_label, r.source_block_refs, r.dropped_refs) == (0.75, False, ["r2", "r1", "r3"], ["d"])
    assert r.content_en == LONG.format(1) + "\n\n" + LONG.format(3) and got[0].confidence == 0.65


def test_equations_only_where_there_are_none(spark):
    kind = "paper_id string, page int, seq_id string, type string, is_equation boolean"
    own = [("a", 1, "s1", "Body", None), ("a", 1, "s2", "Body", False), ("b", 1, "s1", "equation ", None), ("c", 1, None, None, True)]
    more = [("a", 1, "s1", "Equation", True), ("a", 2, "s1", "Equation", True), ("a", 2, "s1", "Equation", True), ("a", 2, None, "Equation", True), ("a", 2, " ", "Equation", True), ("b", 1, "x", "Equation", True), ("c", 1, "x", "Equation", True), ("z", 1, "x", "Equation", True)]
    got = S.inject_equations(spark.createDataFrame(own, kind), spark.createDataFrame(more, kind)).where("injected").collect()
    assert sorted((r.paper_id, r.page, (r.seq_id or "").strip()) for r in got) == [("a", 2, ""), ("a", 2, ""), ("a", 2, "s1")]


def test_people_become_members_in_order(spark):
    people = [("p", 1, "主持人", "viewer", ["", " A@x.org"]), ("p", 2, None, "viewer", ["b@x.org"]), ("p", 3, None, "owner", ["b@x.org"]), ("p", 4, "Co-PI", None, ["b@x.org"]), ("p", 5, None, "boss", ["c@x.org"]), ("p", 6, None, "editor", ["no@x.org"]), ("p", 7, None, None, ["d@x.org"]), ("p", 8, None, "viewer", ["e@x.org"]), ("p", 9, None, "viewer", None)]
    users = [(i, f"{x}@X.org ") for i, x in enumerate("abcde")]
    members = [(2, "p", "owner"), (4, "p", "owner"), (0, "q", "viewer")]
    out = S.sync_members(spark.createDataFrame(members, "user_id int, pid string, role string"), spark.createDataFrame(people, "pid string, pos int, role string, access_role string, emails array<string>"), spark.createDataFrame(users, "id int, email string"))
    assert sorted(map(tuple, out.collect())) == [(0, "p", "editor"), (0, "q", "viewer"), (1, "p", "owner"), (2, "p", "owner"), (4, "p", "viewer")]


def test_attachments_and_modes(spark):
    data = "data:text/plain;base64," + base64.b64encode("héllo".encode()).decode()
    rows = [("data:image/png;base64,AAAA", ""), (data, "héllo"), ("A" * 513, ""), ("A" * 512, "A" * 512), (" words stay ", " words stay "), (None, "")]
    assert all(r.got == r.w for r in spark.createDataFrame(rows, "c string, w string").select("w", S.attachment_text(F.col("c")).alias("got")).collect())
    r = spark.range(1).select(S.is_quota_summary(F.lit('{"mode": "Quota_error"}')).alias("a"), S.is_quota_summary(F.lit("quota")).alias("b"), S.is_quota_summary(F.lit(None).cast("string")).alias("c"), S.is_ready_mode(F.lit(" Task_5B_reflow ")).alias("d"), S.is_ready_mode(F.lit(None).cast("string")).alias("e"), S.fallback_summary(F.lit(None).cast("string")).alias("f"), S.fallback_summary(F.lit("aa. bbb.cc .dddd")).alias("g")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, False, True, False)
    assert (r.f.key_findings, r.f.conclusion, r.g.key_findings, r.g.conclusion) == ([], "", ["dddd", "bbb", "aa"], "dddd")
