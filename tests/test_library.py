"""Library, block and segment rules against plain Python."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import blocks as K
from corvane.operators import library as Y


def test_extractive_summary_against_plain_python(spark):
    texts = ["We propose a method and the results of an experiment are in the conclusion. " * k for k in (1, 2, 3)] + ["short", "import numpy as np and then some more words here to be long", "a b [1] c [2] d [3] " * 4, "plain words of a later page that say little but are long enough", "odd ~~ `` || __ {} words that are long enough for the rule", "中文摘要提出方法" * 8, "same start " * 9 + "one", "same start " * 9 + "two", "as Smith et al. said in some longer text of forty characters or more", "a doi of some longer text of forty characters or more, as it is"]
    rows = [(g, 1 + i % 5, i, x) for g in range(4) for i, x in enumerate(texts) if (i + g) % 4]
    got = {r.g: r for r in Y.extractive_summary(spark.createDataFrame(rows, "g int, page int, pos int, text string"), "g").collect()}
    for g in range(4):
        found = []
        for _, page, pos, x in (r for r in rows if r[0] == g):
            x = re.sub(r"\s+", " ", x).strip()
            if len(x) < 40 or "numpy" in x or len(re.findall(r"\[[0-9,\s]{1,20}\]", x)) >= 3 or re.search(r"\b(et al\.|doi)\b", x):
                continue
            if not re.search("[一-鿿]", x) and len(re.findall(r"[~`|_{}<>\\]", x)) >= 4:
                continue
            hits = len(re.findall(r"\b(?:abstract|introduction|we propose|contribution|method|results?|conclusion|framework|experiment|evaluation)\b|摘要|提出|方法|結果|結論|貢獻|實驗|評估", x, re.I))
            found.append((-(3 * (page in (1, 2, 3)) + 2 * hits + min(len(x) // 120, 4)), page, pos, x))
        want, seen, total = [], set(), 0
        for *_, x in sorted(found):
            if x[:80] not in seen and len(want) < 3:
                seen.add(x[:80])
                line = x[:180].rstrip() + ("..." if len(x) > 180 else "")
                if total + len(line) > 520:
                    break
                want.append(line)
                total += len(line)
        assert got[g].key_findings == want


def test_pack_fingerprint_is_that_of_its_json(spark):
    rows = [("p", 1, "chat", "s", None, "1", "f", 'a "quoted" é line\n', 7), ("p", 2, "chat", "s", "x", "2", "", "", None)]
    df = spark.createDataFrame(rows, "g string, o int, source_type string, source_id string, paper_id string, segment_id string, fingerprint string, snippet string, estimated_tokens long")
    got = Y.pack_metadata(df, "g", "o").first()
    items = [dict(zip(("source_type", "source_id", "paper_id", "segment_id", "fingerprint", "snippet"), r[2:8])) for r in rows]
    raw = json.dumps(items, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got.total_estimated_tokens == 7 and got.context_pack_fingerprint == hashlib.sha256(raw.encode()).hexdigest()


def test_latex_and_pages(spark):
    rows = [("", 0.9, "", True), ("x = y", 0.5, "", True), ("x = y", 0.0, "", False), ("\\text{so}", 0.7, "", True), ("x", 0.9, "From (12) we can see it", True), ("x", 0.9, "therefore " * 15, True), ("word " * 16, 0.9, "", True), ("word " * 16 + "= ^ _ = ^ _ = ^", 0.9, "", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, latex string, conf double, content string, want boolean")
    assert all(r.got == r.want for r in df.select("want", K.is_unreliable_latex(F.col("latex"), F.col("conf"), F.col("content")).alias("got")).collect())
    pages = [(["a", "b"], 2, ["b", "a"], 2, True), (["a", "b"], 2, ["a", "c"], 2, False), (["a"], 2, [], 3, True), ([], 2, [], 1, False), ([], 0, ["a"], 1, True), (["a"], 1, [], 0, False), (["a", "a"], 2, ["a"], 1, False)]
    df = spark.createDataFrame(pages, "r array<string>, n int, f array<string>, m int, want boolean")
    assert all(r.got == r.want for r in df.select("want", K.fixed_is_compatible(F.col("r"), F.col("n"), F.col("f"), F.col("m")).alias("got")).collect())


def test_best_texts_and_scores(spark):
    r = spark.range(1).select(K.best_block_text(F.lit("一段夠長的中文內容說明了方法"), F.lit("en")).alias("a"), K.best_block_text(F.lit(""), F.lit("English text that says enough to stay")).alias("b"), K.best_reading(F.lit(None), F.lit(0.9), F.lit(" "), F.lit(0.1)).alias("c"), K.best_reading(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5)).alias("d"), K.triple_score(F.lit(0.5), F.lit(None).cast("double")).alias("e")).first()
    assert r.a.lang == "zh" and r.b.lang == "en" and tuple(r.c) == ("", "", 0.0) and tuple(r.d) == ("b", "stack_b", 0.5) and r.e == 0.35


def test_chain_versions(spark):
    one = lambda v: spark.range(1).select(Y.upgrade_chain(F.lit(v))).first()[0]
    assert [one(v) for v in (None, "", "x", "0", "1")] == [1] * 5
    with pytest.raises(Exception, match="Unsupported context_chain"):
        one("2")


def test_metadata_of_any_spelling(spark):
    from corvane.functions import metadata as M

    csl = [('{"author": [{"family": null}]}', True), ('{"author": [{"name": "x"}]}', False), ('{"DOI": null}', True), ('{"author": "family"}', False), ("no json", False), (None, False), ("{}", False)]
    df = spark.createDataFrame(csl, "raw string, want boolean")
    assert [r.got for r in df.select(M.looks_like_csl(F.col("raw")).alias("got")).collect()] == [w for _, w in csl]
    raw = '{"title": null, "paper_title": " T ", "author": ["A B", {"name": " C "}, {"literal": "no"}, ""], "publish_year": "c. 1999", "container_title": "J", "DOI": "d", "link": "u", "publisher": " P "}'
    r = spark.createDataFrame([(raw,), ("bad",), (None,)], "raw string").select(M.paper_metadata(F.col("raw")).alias("p"), M.entry_metadata(F.col("raw")).alias("e")).collect()
    assert r[0].p.asDict() == {"title": "T", "authors": ["A B", "C"], "year": "1999", "journal": "J", "doi": "d", "url": "u", "abstract": "", "publisher": "P"}
    assert (r[0].e.authors, r[0].e.year, r[0].e.venue, r[0].e.citations) == (["A B", "C", "no"], 1999, "J", 0)
    for x in r[1:]:
        assert x.p.authors == [] and x.p.title == x.p.year == "" and x.e.year is None


def test_verified_ranking_checks_the_first_only(spark):
    rows = [("q", i, 0.5, i % 2 == 0) for i in range(25)] + [("r", 0, None, None)]
    got = {(x.g, x.p): x for x in Y.verified_ranking(spark.createDataFrame(rows, "g string, p int, confidence double, link_ok boolean"), "g", "p").collect()}
    want = sorted(((-(0.5 if i >= 20 or i % 2 == 0 else 0.35), not (i < 20 and i % 2 == 0), i) for i in range(25)))
    assert [i for *_, i in want] == sorted(range(25), key=lambda i: got["q", i]["rank"])
    assert got["r", 0].confidence == 0 and not got["r", 0].is_verified


def test_activity_rounds_tenths_as_sql(spark):
    """333 seconds in 3 sessions: 1.8499999999999999 minutes are 1.9 in SQL, 1.8 by decimals."""
    from corvane.operators import accounts as A

    s = spark.sql("SELECT 1 AS u, 111L AS seconds, timestamp'2024-01-01' + make_interval(0, 0, 0, id) AS login_at FROM range(3)".replace("id)", "CAST(id AS INT))"))
    r = A.activity(s, "u").first()
    assert (r.mean_minutes, r.total_minutes) == (1.9, 5.6)
