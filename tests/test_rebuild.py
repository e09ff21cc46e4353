"""Evidence rebuilt from landed JSON; a broken artifact costs its paper only."""

import json

from corvane.operators.rebuild import rebuild_project

LONG = "A sentence that is long enough to be a segment of its own, number {}."


def fused(*pages):
    return json.dumps({"content": [{"page": n, "blocks": [{"type": t, "content": c} for t, c in blocks]} for n, blocks in pages]})


def test_failures_become_rows_and_the_rest_goes_on(spark):
    sections = json.dumps({"sections": [{"section_label": "Results", "content_en": LONG.format(1), "content_zh": "中"}, {"content_en": "short"}, {"content_zh": LONG.format(2)}]})
    summary = json.dumps({"abstract_zh": LONG.format(3), "key_findings": ["f", None, " "], "conclusion": None})
    titled = fused((1, [("Body", LONG.format(4)), ("Title", "Methods")]), (2, [("Body", LONG.format(5)), ("Body", " ")]))
    plain = fused((None, [("Body", LONG.format(6)), ("Body", "and more of it")]), (7, [("Body", None)]))
    rows = [
        ("p", "all", "semantic", sections), ("p", "all", "fused", titled), ("p", "all", "summary", summary), ("p", "titles", "semantic", json.dumps({"sections": []})), ("p", "titles", "fused", titled), ("p", "pages", "fused", plain), ("p", "pages", "summary", None),
        ("p", "broken", "semantic", sections), ("p", "broken", "fused", "{oops"), ("p", "list", "summary", "[1]"), ("p", "odd", "fused", '{"content": 5}'), ("p", "what", "notes", "{}"), ("p", "none", "semantic", None), ("p", "empty", "fused", "{}"), ("p", "onlysum", "summary", summary),
        ("q", "all", "fused", plain),
    ]
    segments, errors, report = rebuild_project(spark.createDataFrame(rows, "pid string, paper_id string, stage string, raw string"))
    got = {(r.pid, r.paper_id, r.segment_id): (r.title, r.text, r.stage) for r in segments.collect()}
    assert got == {
        ("p", "all", "sec-1"): ("Results", LONG.format(1) + "\n\n中", "flow_b"), ("p", "all", "sec-3"): ("Section 3", LONG.format(2), "flow_b"), ("p", "all", "summary"): ("Summary", LONG.format(3) + "\nf", "summary"),
        ("p", "titles", "fsec-1"): ("Front Matter", LONG.format(4), "titles"), ("p", "titles", "fsec-2"): ("Methods", LONG.format(5), "titles"),
        ("p", "pages", "page-1"): ("Page 1", LONG.format(6) + "\nand more of it", "pages"), ("q", "all", "page-1"): ("Page 1", LONG.format(6) + "\nand more of it", "pages"),
    }
    assert sorted(map(tuple, errors.collect())) == [("p", "broken", "fused", "not JSON"), ("p", "list", "summary", "not an object"), ("p", "odd", "fused", "content is no list"), ("p", "what", "notes", "unknown stage notes")]
    # none, empty and onlysum have nothing that a summary could stand beside.
    assert {r.pid: (r.papers_indexed, r.papers_skipped, r.papers_failed) for r in report.collect()} == {"p": (3, 3, 4), "q": (1, 0, 0)}


def test_no_artifacts(spark):
    for d in rebuild_project(spark.createDataFrame([], "pid string, paper_id string, stage string, raw string")):
        assert d.collect() == []
