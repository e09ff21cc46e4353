"""Regions, chains of context and prompts against plain Python and values worked out by hand."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.functions import regions as Q
from corvane.functions import udfs as U
from corvane.operators import chain as C
from corvane.plans import chain as chain_plans

NAMES = "area_ratio text_density small_cc_count table_grid_score line_h_ratio line_v_ratio grid_intersection_ratio fg_ratio x1 y1 x2 w h page_w page_h".split()


def region(spark, *rows):
    return spark.createDataFrame([tuple(float(r.get(n, 0)) for n in NAMES) for r in rows], ", ".join(f"{n} double" for n in NAMES))


PAGE = {"page_w": 1000, "page_h": 1400}
GRID = PAGE | {"area_ratio": 0.12, "text_density": 0.9, "small_cc_count": 30, "table_grid_score": 0.018, "line_h_ratio": 0.01, "line_v_ratio": 0.01, "grid_intersection_ratio": 0.0012, "fg_ratio": 0.2, "x1": 100, "y1": 700, "x2": 500, "w": 400, "h": 420}
BLANK = PAGE | {"area_ratio": 0.1, "x1": 100, "y1": 700, "x2": 500, "w": 400, "h": 350}
FORMULA = PAGE | {"area_ratio": 0.02, "text_density": 1.45, "small_cc_count": 120, "x1": 300, "y1": 700, "x2": 700, "w": 400, "h": 70}


def test_scores_worked_out_by_hand(spark):
    got = [x.types for x in Q.with_types(region(spark, GRID, BLANK, FORMULA, PAGE), F.lit(None).cast("string")).collect()]
    assert got[0].table == pytest.approx(1.0) and (got[0].pred, got[0].confidence) == ("Table", got[0].table)
    assert list(got[0].reasons) == ["GRID_STRONG", "GRID_INTERSECTIONS", "LARGE_REGION", "LOW_TEXT_DENSITY", "HV_LINES_BALANCED", "TABLE_STRICT_CHECK"]
    assert got[1].figure == pytest.approx(1.0) and got[1].pred == "Figure"
    assert got[1].table == 0  # 0.11 * 0.1 / 0.12 + 0.08, less 0.20, 0.16 and 0.18, is below 0
    assert got[2].equation == pytest.approx(1.0) and got[2].pred == "Equation"
    assert got[3].body == pytest.approx(0.16 + 0.09 + 0.08 * 0.65)
    wide = Q.with_types(region(spark, FORMULA), F.lit("left")).first().types
    assert wide.body == pytest.approx(got[2].body + 0.05)


def test_kinds_at_their_bounds(spark):
    r = Q.Region.of_columns()
    rows = [GRID, GRID | {"grid_intersection_ratio": 0.0003}, GRID | {"text_density": 0.2, "grid_intersection_ratio": 0.0011}, GRID | {"h": 32}, GRID | {"h": 33}]
    assert [x.t for x in region(spark, *rows).select(Q.is_table_like(r).alias("t")).collect()] == [True, False, False, False, True]
    rows = [BLANK, BLANK | {"text_density": 2.05, "small_cc_count": 70}, BLANK | {"table_grid_score": 0.021}, BLANK | {"area_ratio": 0.019}]
    assert [x.t for x in region(spark, *rows).select(Q.is_figure_like(r).alias("t")).collect()] == [True, False, False, False]


def test_columns_of_a_page(spark):
    rows = [([0, 0, 400, 9], 500, "left"), ([0, 0, 480, 9], 500, "span"), ([525, 0, 900, 9], 500, "right"), ([5, 0, 5, 9], 500, "full"), ([0, 0, 540, 9], None, "full"), ([60, 0, 540, 9], None, "left"), ([470, 0, 900, 9], None, "right"), ([300, 0, 700, 9], None, "full"), ([1, 2], 500, "full"), (None, 500, "full")]
    df = spark.createDataFrame(rows, "b array<int>, s int, want string")
    assert all(x.got == x.want for x in df.select("want", G.column_id(F.col("b"), F.lit(1000), F.col("s"), F.lit(25)).alias("got")).collect())


def test_fingerprints_are_those_of_their_json(spark):
    said = 'a "q" é\n'
    r = spark.createDataFrame([(said, 3)], "a string, b int").select(C.fingerprint({"b": F.col("b"), "a": F.col("a"), "c": F.lit(None).cast("string")}).alias("f"), C.cache_key(F.lit("t"), F.col("a"), F.lit(None).cast("string"), F.lit("m"), F.create_map(F.lit("z"), F.lit("1"), F.lit("k"), F.lit("2")), F.lit("x")).alias("k")).first()
    assert r.f == hashlib.sha1(json.dumps({"a": said, "b": 3, "c": None}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    call = {"task_type": "t", "prompt": said, "provider": "", "model": "m", "params": {"z": "1", "k": "2"}, "context_fingerprint": "x"}
    assert r.k == hashlib.sha256(json.dumps(call, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_hybrid_search_sees_its_own_project_and_tenant(spark):
    q = spark.createDataFrame([("q", "p", "alpha beta", "t1", "internal"), ("n", "none", "alpha", "", "internal")], "query_id string, pid string, query string, tenant_id string, access_level string")
    kind = "pid string, pos int, tenant_id string, access_level string"
    p = spark.createDataFrame([("p", 0, "", "internal", "alpha beta"), ("p", 1, "t1", "public", "alpha gamma"), ("p", 2, "t2", "public", "alpha beta"), ("p", 3, "", "secret", "alpha beta"), ("o", 0, "", "public", "alpha beta"), ("p", 4, "", "", None)], f"{kind}, text string")
    tr = spark.createDataFrame([("p", 0, "", "internal", "alpha", "beta", "zz", 0.0), ("p", 1, "", "internal", "x1", "y1", "z1", 1.0), ("p", 2, "", "internal", None, None, None, None)], f"{kind}, subject string, predicate string, object string, confidence double")
    got = {r.query_id: r for r in C.hybrid_topk(q, p, tr, 2, 2).collect()}
    assert [(x.text, x.score) for x in got["q"].vector_facts] == [("alpha beta", 1.0), ("alpha gamma", 0.5)]
    assert [(x.s, x.score) for x in got["q"].kg_relations] == [("alpha", round(0.7 * 2 / 6**0.5, 6)), ("x1", 0.3)]
    assert list(got["n"].vector_facts) == [] == list(got["n"].kg_relations)


def test_context_blocks(spark):
    kind = "b string, f array<string>, r array<struct<s:string,p:string,o:string>>"
    rows = [(" brief " + "x" * 600, [" ", "f" * 300] + list("abcde"), [("s", "", "o"), ("s", "p", "o")]), (None, None, None), ("", [], [])]
    got = [x.c for x in spark.createDataFrame(rows, kind).select(C.format_context(F.col("b"), F.col("f"), F.col("r")).alias("c")).collect()]
    assert got[0] == "[Project Brief]\nbrief " + "x" * 494 + "\n\n[Vector Facts]\n- " + "f" * 220 + "\n- a\n- b\n- c\n- d\n\n[KG Relations]\n- s --p--> o"
    assert got[1:] == ["", ""]


def test_overrides_and_their_layers(spark):
    claims = spark.createDataFrame([("p", "a", "", "internal", "old", 1), ("p", "b", "t1", "internal", "old", 2), ("p", "c", "", "secret", "old", 3), ("r", "a", None, None, "old", 4)], "pid string, claim_id string, tenant_id string, access_level string, title string, year int")
    patch = lambda c, seq, title: ("p", c, seq, {"title": title, "unknown": "x"}, "t2", "internal")
    patches = spark.createDataFrame([patch("a", 1, "first"), patch("a", 2, "last"), patch("b", 1, "no"), patch("c", 1, "no"), patch("z", 1, "no")], "pid string, claim_id string, seq int, patch map<string,string>, tenant_id string, access_level string")
    out = C.override_claims(claims, patches)
    got = {(r.pid, r.claim_id): (r.status, r.title) for r in out.collect()}
    assert got == {("p", "a"): ("patched", "last"), ("p", "b"): ("tenant_mismatch", "old"), ("p", "c"): ("access_denied", "old"), ("p", "z"): ("not_found", None), ("r", "a"): ("kept", "old")}
    layers = spark.createDataFrame([(p, x, 4, x == "L1") for p in "pr" for x in ("L1", "L2", "L3", "KG")], "pid string, layer string, version int, stale boolean")
    after = C.layers_after(layers, out)
    assert {(r.pid, r.layer): (r.version, r.stale) for r in after.collect() if r.pid == "p"} == {("p", "L1"): (5, False), ("p", "L2"): (4, True), ("p", "L3"): (4, True), ("p", "KG"): (4, True)}
    packets = spark.createDataFrame([(p, x, 1) for p in "pr" for x in ("L1", "L2", "L3")], "pid string, layer string, n int")
    assert {(r.pid, r.layer) for r in C.usable_packets(packets, after).collect()} == {("p", "L1"), ("r", "L1"), ("r", "L2"), ("r", "L3")}


def test_prompts_keep_within_their_budget(spark):
    bundle = [("current_section", "[now]\nsaved"), ("review", "r" * 400)]
    rows = [("d1", "<p>Saved</p>", "saved", bundle), ("d2", "changed", "saved", bundle), ("d3", "", "saved", bundle), ("d4", "x" * 900, "saved", bundle), ("d5", None, None, None)]
    kind = "k string, draft string, saved string, bundle array<struct<tier:string,text:string>>"
    got = {r.k: r for r in C.pack_prompt(spark.createDataFrame(rows, kind), 100).collect()}
    assert got["d1"].packed.startswith("<p>Saved</p>\n\nrrr") and got["d2"].packed.startswith(C.UNSAVED + "\nchanged\n\nrrr")
    assert got["d3"].packed.startswith("[now]\nsaved\n\nrrr") and (got["d5"].packed, got["d5"].remaining) == ("", 100)
    assert all(0 <= r.remaining < 100 or r.k == "d5" for r in got.values()) and "rrr" not in got["d4"].packed[-5:]


def test_other_sections_halve_what_is_left(spark):
    texts = ["a" * 4000, "", "b" * 40, "c" * 4000, None] + ["d" * 4000] * 20
    rows = [(g, i, x) for g in (1, 2) for i, x in enumerate(texts)]
    got = C.pack_sections(spark.createDataFrame(rows, "g int, pos int, text string"), "g", 1000).where("g = 2").orderBy("pos").collect()
    left = 200
    for r in got:
        assert r.packed == U.cut_to_budget(texts[r.pos], left // 2 or left) and r.tokens == U.estimate(r.packed)
        left -= r.tokens
    assert [r.pos for r in got][:3] == [0, 2, 3] and 0 <= left <= 2


def test_rendered_pack_counts_its_items(spark):
    kind = "g string, o int, source_type string, source_id string, paper_id string, paper_title string, segment_id string, title string, score double, estimated_tokens long, fingerprint string, snippet string"
    rows = [("p", 2, "s", "i", None, None, "1", "t", None, None, "f", "second"), ("p", 1, "s", "i", "x", "X", "2", "t", 0.5, 7, "f", "first")]
    block = C.render_pack(spark.createDataFrame(rows, kind), "g", "o").first().block
    assert block.startswith("[Injected Context Pack]\ntotal_estimated_tokens: 7\n") and block.endswith("snippet: second")
    assert block.index("[Context 1]\nsource_type: s") < block.index("snippet: first\n\n[Context 2]") and "score: 0\nestimated_tokens: 0" in block


def test_scores_are_in_methods_that_the_jvm_compiles(spark):
    typed = Q.with_types(chain_plans.regions(spark, "/root/testdata/sf0.001"), F.when(F.col("x1") > 3, "left"))
    debug = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    code = typed._jdf.queryExecution().explainString(debug)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # the JVM leaves longer ones interpreted
    assert typed.first().types.asDict().keys() == {"table", "figure", "body", "equation", "pred", "confidence", "reasons"}


def test_features_of_regions_are_divided_as_doubles(spark):
    plan = chain_plans.regions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan
