import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import accounts as A
from corvane.operators import layout as L
from corvane.operators import pages as P
from corvane.operators import retrieval as R
from corvane.operators.arbitration import rescued
from corvane.plans import catalog
from corvane.sources import files
from corvane.streaming import windows as W

HIT = "query_id string, paper_id string, source_id string, segment_id long, score double, named_match boolean, estimated_tokens long, title string, text string"


def hits(spark, named):
    rows = [("q", p, p, i, top - 0.01 * i, p in named, 1, "", "") for p, top in (("A", 9.0), ("B", 3.0)) for i in range(30)]
    return spark.createDataFrame(rows, HIT)


@pytest.mark.parametrize("named, check", [({"A", "B"}, lambda a, b: (a, b) == (6, 6)), ({"A"}, lambda a, b: a == 12), (set(), lambda a, b: b >= 3 and a > b)])
def test_quota_between_papers(spark, named, check):
    got = R.per_paper_quota(hits(spark, named), 12).groupBy("paper_id").count().collect()
    n = {r.paper_id: r["count"] for r in got}
    assert sum(n.values()) == 12 and check(n.get("A", 0), n.get("B", 0))


EVIDENCE = "paper_id string, source_id string, segment_id long, title string, text string, source_type string, paper_title string"


def test_search_finds_one_among_noise(spark):
    rows = [("p1", "s1", 0, "Results", "a target phrase about glucose", "paper_segment", "")] + [("p2", "s2", i, "", f"noise {i}", "paper_segment", "") for i in range(1, 1100)] + [("p3", "s3", 2000, "References", "glucose glucose", "paper_segment", "")]
    got = R.best(R.score_evidence(spark.createDataFrame(rows, EVIDENCE), [("q", "glucose target")]), 5, "segment_id").collect()
    assert [r.segment_id for r in got] == [0]


def test_named_paper_gets_its_bonus(spark):
    rows = [("SEBASR_x", "s1", 0, "", "about speech", "paper_segment", "")]
    got = R.score_evidence(spark.createDataFrame(rows, EVIDENCE), [("q", "use SEB-ASR for speech")]).first()
    assert got.named_match and got.score > 1


def test_screening(spark):
    rows = [("a", "paper_segment"), ("b", "paper_segment"), ("c", "paper_segment"), ("c", "study_note"), (None, None)]
    ev = spark.createDataFrame(rows, "paper_id string, source_type string")
    sc = spark.createDataFrame([("a", "included"), ("c", "excluded")], "paper_id string, status string")
    key = lambda df: sorted((str(r.paper_id), str(r.source_type)) for r in df.collect())
    assert key(R.screening_gate(ev, sc)) == [("None", "None"), ("a", "paper_segment"), ("b", "paper_segment"), ("c", "study_note")]
    assert key(R.screening_gate(ev, sc, "writing")) == [("None", "None"), ("a", "paper_segment"), ("c", "study_note")]


def test_budget_and_history(spark):
    rows = [("g", i, "x" * 40) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, n int, snippet string")
    got = R.pack_budget(df, 25, ["g"], "n").orderBy("n").collect()
    assert [(len(r.packed), r.packed_tokens) for r in got] == [(40, 10), (40, 10), (20, 5)]
    newest = R.pack_newest(df, 30, ["g"], "n", "snippet").collect()
    assert sorted(r.n for r in newest) == [2, 3]


def test_running_headers(spark):
    rows = [("p", i, t) for i, t in ((2, "My  Title"), (3, "my title"), (4, "MY TITLE"), (4, "unique text"))]
    df = spark.createDataFrame(rows, "paper string, page int, text string")
    assert [r.text for r in L.without_running_headers(df, "paper", "page", "text").collect()] == ["unique text"]


def test_coverage_facts(spark):
    rows = [("p", "b1", "aa", True, False), ("p", "b2", "aa", False, True), ("p", "b3", "aa", False, False), ("p", "b4", "aa", False, False)]
    df = spark.createDataFrame(rows, "g string, ref string, text string, assigned boolean, dropped boolean")
    assert L.coverage(df, "g").first().ref_ratio == 0.5
    used = df.where("assigned OR dropped")
    left = L.uncovered(df.withColumn("pos", F.col("ref")), used, "g").orderBy("pos")
    assert [r.ref for r in left.collect()] == ["b3", "b4"]


def test_abstract_from_first_page(spark):
    rows = [("p", 1, "b1", "x" * 400, None), ("p", 1, "b2", "y" * 10, None), ("q", 1, "b1", "z" * 500, "Abstract")]
    got = L.longest_as_abstract(spark.createDataFrame(rows, "g string, page int, ref string, text string, label string"), "g").collect()
    assert [(r.g, r.ref, r.label) for r in got] == [("p", "b1", "Abstract")]


def test_readers_and_rescue(spark):
    schema = "page int, seq_id string, type string, bbox array<int>, content string, score double"
    a = spark.createDataFrame([(1, "A", "Body", [0, 0, 100, 100], "text of a", 0.9)], schema)
    b = spark.createDataFrame([(1, "B", "Body", [0, 80, 100, 180], "other text", 0.9), (1, "C", "Body", [0, 90, 100, 175], "inside B", 0.9), (1, "D", "Body", [0, 0, 90, 90], "inside A", 0.9)], schema)
    got = rescued(a, b.select("page", F.struct(F.col("seq_id").alias("pos"), "seq_id", "bbox").alias("block")), ["page"]).collect()
    assert [r.block.seq_id for r in got] == ["B"]
    out = L.arbitrate(a, b, ["page"]).first()
    assert out.seq_id == "A" and out.source == "stack_a"


def test_merges_on_a_page(spark):
    s = "d int, pos int, type string, text string, noise boolean, bbox array<int>"
    rows = [(1, 0, "Body", "One.", False, [0, 0, 10, 10]), (1, 1, "Body", "Two.", False, [0, 10, 20, 20]), (1, 2, "Body", "no end", False, [0, 20, 10, 30]), (1, 3, "Title", "T.", False, [0, 30, 10, 40])]
    got = P.merge_bodies(spark.createDataFrame(rows, s), "d", "pos").orderBy("pos").collect()
    assert [(r.text, r.bbox) for r in got] == [("One. Two.", [0, 0, 20, 20]), ("no end", [0, 20, 10, 30]), ("T.", [0, 30, 10, 40])]


def test_keys_and_chunks(spark):
    rows = [("p", 1, "intro"), ("p", 2, "intro"), ("p", 3, "bad key!"), ("p", 4, None)]
    got = P.unique_keys(spark.createDataFrame(rows, "project string, n int, section_key string"), "project", "n").orderBy("n")
    assert [r.section_key for r in got.collect()] == ["intro", "sec_2", "sec_3", "sec_4"]
    rows = [("p", i, "k" if 3 <= i <= 6 else "") for i in range(10)]
    got = P.affinity_chunks(spark.createDataFrame(rows, "paper string, n int, affinity string"), "paper", "n", 4).orderBy("n")
    assert [r.chunk for r in got.collect()] == [0] * 7 + [1] * 3


def test_usage_cost_facts(spark):
    rows = [("p", "OpenAI", "gpt-4.1", 1000, 500, 0), ("p", "openai", "gpt-4.1-2025-04-14", 2000, 100, 0), ("q", "google", "gemini-flash-latest", 10, 10, 0)]
    df = spark.createDataFrame(rows, "pid string, vendor string, model string, input_tokens long, output_tokens long, cached_tokens long")
    got = {r.pid: r for r in A.usage_summary(A.with_cost(df), "pid").collect()}
    assert (got["p"].calls, got["p"].total_tokens, got["p"].cost_usd) == (2, 3600, 0.0108)
    assert got["q"].has_unpriced == 1 and got["q"].unpriced_tokens == 20


def test_sessions_end_before_the_gap(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("u", base + dt.timedelta(seconds=s)) for s in (0, 100, 400, 701, 2000)]
    got = A.sessions(spark.createDataFrame(rows, "user_id string, ts timestamp"), "user_id", "ts").orderBy("login_at").collect()
    assert [(r.beats, r.seconds) for r in got] == [(3, 400), (1, 0), (1, 0)]


def test_library_merge_facts(spark):
    s = "key string, pos int, title string, venue string, abstract string, source string, verified boolean, confidence double"
    rows = [("a", 1, "First title", "", "", "x", False, 0.5), ("a", 2, "Other title", "V", "filled", "y", True, 0.9), ("b", 3, "B", None, None, "x", False, 0.1)]
    got = {r.key: r for r in A.merge_candidates(spark.createDataFrame(rows, s), "key", "pos").collect()}
    assert (got["a"].title, got["a"].abstract, got["a"].confidence, got["a"].verified, got["a"].sources) == ("First title", "filled", 0.9, 1, "x,y")
    assert got["b"].venue is None


def test_free_numbers_and_roles(spark):
    df = spark.createDataFrame([("g", n) for n in (1, 2, 4, 4, 9)] + [("h", 2)], "g string, n int")
    assert {r.g: r.free for r in A.smallest_free(df, "g", "n").collect()} == {"g": 3, "h": 1}
    m = spark.createDataFrame([(1, "X", "viewer"), (1, "X-p", "editor")], "u int, pid string, role string")
    assert A.highest_role(m, "u", "pid", "role").first().role == "editor"
    w = A.optimistic_save(spark.createDataFrame([("a", 3)], "k string, rev int"), spark.createDataFrame([("a", 2), ("a", None), ("a", 3)], "k string, base_rev int"), "k")
    assert sorted((str(r.base_rev), r.conflict, r.new_rev) for r in w.collect()) == [("2", True, 3), ("3", False, 4), ("None", False, 4)]


def test_landed_files(spark, tmp_path):
    for p in ("P1/literature/papers/a", "P1/a/00_origins", "P1/b/00_origins", "P1/_x/00_origins"):
        d = tmp_path / "data" / p
        d.mkdir(parents=True)
        (d / "full_text.json").write_text("{}")
    f = files.paths(spark, str(tmp_path / "data"))
    assert sorted((r.paper_id, r.layout) for r in files.paper_folders(f).collect()) == [("a", "new"), ("b", "legacy")]
    assert files.artifact_quality(f).first().quality == "silver"
    logs = tmp_path / "ocr"
    logs.mkdir()
    for name, text in (("s1.gt.txt", "truth"), ("s1.pred.txt", "pred"), ("s1.txt", "plain"), ("s2.gt.txt", "only")):
        (logs / name).write_text(text)
    assert sorted((r["sample"], r.truth, r.prediction) for r in files.prediction_pairs(spark, str(logs)).collect()) == [("s1", "truth", "pred"), ("s2", "only", "")]


def test_reference_services(spark):
    item = json.dumps({"DOI": "10.1/x", "title": ["T"], "author": [{"family": "Chen", "given": "A"}], "issued": {"date-parts": [[2020, 1]]}, "container-title": ["J"], "is-referenced-by-count": 7})
    r = files.crossref_papers(spark.createDataFrame([(item,)], "value string")).first()
    assert (r.title, r.authors, r.year, r.url, r.venue, r.citations) == ("T", ["Chen, A"], 2020, "https://doi.org/10.1/x", "J", 7)
    item = json.dumps({"doi": "https://doi.org/10.2/y", "display_name": "N", "publication_year": 2021, "authorships": [{"author": {"display_name": "B"}}], "abstract_inverted_index": {"b": [1], "a": [0]}})
    r = files.openalex_papers(spark.createDataFrame([(item,)], "value string")).first()
    assert (r.doi, r.abstract, r.authors) == ("10.2/y", "a b", ["B"])


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("u", base + dt.timedelta(seconds=s), 10) for s in (0, 100, 2000)]
    spark.createDataFrame(rows, "user_id string, ts timestamp, tokens long").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("user_id string, ts timestamp, tokens long").parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert [(r.beats, (r.ended_at - r.login_at).seconds) for r in run(W.session_stream(events, idle="300 seconds", late="0 seconds"), "s")] == [(2, 100)]
    assert sorted(r.requests for r in run(W.rate_stream(events, late="0 seconds"), "r", "complete")) == [1, 1, 1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    texts = ["a" * 150 + "b" * 30, "a" * 150 + "c" * 30, "Größe  深度學習 café", "", "größe 深度学习 cafe"]
    spark.createDataFrame([(7, i, x) for i, x in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def rate(p, g):
        return distance(p, g) / len(g) if g else float(bool(p))

    norm = [" ".join(x.lower().split()) for x in ["", *texts]]
    want = [(7, i, rate(norm[i], norm[i + 1]), rate(norm[i].split(), norm[i + 1].split())) for i in range(5)]
    got = sorted(catalog.ocr_error_rates(spark, str(tmp_path)).collect())
    assert [tuple(x) for x in got] == [pytest.approx(w) for w in want]
    mean = catalog.ocr_average(spark, str(tmp_path)).first()
    assert tuple(mean) == pytest.approx((5, sum(w[2] for w in want) / 5, sum(w[3] for w in want) / 5))
    assert tuple(T.average_error_rates(spark.createDataFrame([], "cer double, wer double")).first()) == (0, 0.0, 0.0)


def test_shared_projects_of_all_and_roles(spark):
    links = spark.createDataFrame([(2, 3), (2, 4), (2, 5), (6, 7), (2, 3)], "mentor long, mentee long")
    rows = [(2, "p", "editor", False), (3, "p", "viewer", False), (4, "p", "coauthor", False), (5, "q", "editor", False), (6, "o", "coauthor", True), (7, "o", "owner", True)]
    got = A.shared_project_links(links, spark.createDataFrame(rows, "user long, pid string, role string, open boolean"))
    assert sorted(map(tuple, got.collect())) == [(2, 3), (6, 7)]


def test_references_resolve_to_the_best_of_a_block(spark):
    papers = [(1, "x", "A first other thing", 2000, "", "crossref"), (2, "x", "Deep learning of glucose", 2010, "", "arXiv"), (3, "x", "Deep learning of glucose", 2010, "", "crossref"), (4, "x", "Deep learning of glucoses", 2010, "10.1/a", "openalex"), (5, "y", "Deep learning of glucose", 1990, "10.1/b", "web"), (6, "x", "Sleep and memory", None, "", "web")]
    refs = [(1, "x", "Deep learning of glucose", 2011, ""), (2, "x", "Deep learning of glucose", 2012, ""), (3, "x", "Deep learnings of glucose!", None, "10.1/A"), (4, "x", "Wholly different words", 2010, "10.1/a"), (5, "x", None, None, "10.1/b"), (6, "x", None, 2000, "10.1/c"), (7, "x", "Sleep and memories", 1901, ""), (8, "y", "Deep learning on glucose", 1990, "")]
    got = A.resolve_references(spark.createDataFrame(refs, "ref int, venue string, title string, year int, doi string"), spark.createDataFrame(papers, "paper int, venue string, title string, year int, doi string, source string"), ["venue"])
    assert sorted((x.ref, x.paper, x.match) for x in got.collect()) == [(1, 3, "title"), (3, 4, "doi"), (5, 5, "doi"), (7, 6, "title"), (8, 5, "title")]


def test_sequential_rules_over_many_keys(spark):
    """Rules that go row by row keep one key's state apart from the next one's, null keys too."""
    keys = [("a", i, "x" if i % 7 else "") for i in range(9)] + [(None, i, "x") for i in range(9)]
    d = spark.createDataFrame(keys, "paper string, n int, affinity string").repartition(3)
    got = P.affinity_chunks(d, "paper", "n", 4).orderBy("paper", "n").collect()
    assert [r.chunk for r in got] == [0] * 8 + [1] + [0] * 7 + [1] * 2
    assert "FlatMapGroupsInPandas" not in P.affinity_chunks(d, "paper", "n", 4)._jdf.queryExecution().toString()
    s = P.unique_keys(spark.createDataFrame([(None, 1, "k"), (None, 2, "k"), ("b", 1, "k")], "p string, n int, section_key string"), "p", "n")
    assert [tuple(r) for r in s.orderBy("p", "n").collect()] == [(None, 1, "k"), (None, 2, "sec_2"), ("b", 1, "k")]


def test_bodies_merge_without_python(spark):
    rows = [("p", i, "Body", t, False, [i, 0, i + 1, 1]) for i, t in enumerate(["One.", "Two. \u001c", "open", "x" * 150, "End!", None])]
    m = P.merge_bodies(spark.createDataFrame(rows, "paper string, n int, type string, text string, noise boolean, bbox array<int>"), "paper", "n")
    assert "Python" not in m._jdf.queryExecution().toString() and "InPandas" not in m._jdf.queryExecution().toString()
    assert [(r.n, r.text, r.bbox) for r in m.orderBy("n").collect()] == [(0, "One. Two. \u001c", [0, 0, 2, 1]), (2, "open", [2, 0, 3, 1]), (3, "x" * 150 + " End!", [3, 0, 5, 1]), (5, None, [5, 0, 6, 1])]


def test_like_titles_in_cells_are_those_of_all_pairs(spark, monkeypatch):
    """Titles met in pairs that were shuffled and made distinct; now in cells, without the pairs."""
    import random

    from corvane.functions.udfs import common_lengths, similar_titles, title_ratio

    r = random.Random(4)
    words = ["the", "er", "and", "th", "tion", "a", "aa", "of sleep", "x" * 9]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(60)] + ["la " * 40 + "end"]
    known = sorted({*base, *(t[: len(t) // 2] + r.choice("aeo ") + t[len(t) // 2 :] for t in base)} - {""})
    keys = sorted({" ".join(t.split()[1:]) or "z" for t in known} | {"la " * 39 + "end"})
    want = sorted((k, t, title_ratio(k, t)) for k in keys for t in known if title_ratio(k, t) >= 0.82)
    i, j, s = similar_titles(keys, known, 0.82)
    assert sorted((keys[a], known[b], c) for a, b, c in zip(i, j, s)) == want and len(want) > 60
    assert common_lengths("abcb", np.array([list(b"bcb\0"), list(b"zzzz"), list(b"aabb")], dtype=np.uint8)).tolist() == [3, 0, 3]
    monkeypatch.setattr(A, "CELL_TITLES", 20)
    a, b = (spark.createDataFrame([("v", x) for x in t], f"venue string, {n} string") for t, n in ((keys, "key"), (known, "known")))
    got = A.like_titles(a, b.unionAll(spark.createDataFrame([("w", keys[0])], b.schema)), ["venue"], 0.82)
    assert sorted((x.key, x.known, x.s) for x in got.collect()) == want


def test_long_and_empty_lines_move_without_their_text(spark):
    """Every line was shuffled whole for its key, empty ones of a group to one task."""
    rows = [("p", k, x) for k in (1, 2, 3) for x in ("Head  Line", "", "x" * 89, "y" * 90, "z" * 50 + " " * 200 + "z", "  ", f"own {k}", None)]
    df = spark.createDataFrame(rows, "paper string, page int, text string")
    assert sorted((r.norm, r.pages) for r in L.running_headers(df, "paper", "page", "text").collect()) == [("head line", 3), ("x" * 89, 3), ("z" * 50 + " z", 3)]
    left = L.without_running_headers(df.withColumn("n", F.length("text")), "paper", "page", "text")
    assert left.count() == 3 * 5 and "__key" not in left.columns
    plan = left.groupBy("page").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan
    assert "regexp_replace" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "LeftAnti" in x)
