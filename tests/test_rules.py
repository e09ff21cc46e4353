"""Rules against plain readings of their statements, on adversarial rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import status as S
from corvane.functions import text as T
from corvane.operators import layout as L


def values(spark, rule, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n int, x string")
    return [r.v for r in df.select("n", rule(F.col("x")).alias("v")).orderBy("n").collect()]


def cycles(s):
    """A run of one visible character, or a cycle that begins near the middle."""
    s = s.strip()
    if re.search(r"(\S)\1{7}", s):
        return True
    half = s[len(s) // 2 :]
    return any(half[a : a + n].strip() and half[a : a + 6 * n] == half[a : a + n] * 6 and len(half) >= a + 6 * n for n in (2, 3, 4) for a in range(2 * n))


def test_degenerate_repetition(spark):
    r = random.Random(1)
    texts = ["格" * 8, "格" * 7, "", "  ", "x" * 30 + " " * 9, "ab" * 20, "good text " + "ab" * 12, "a" * 7 + "b" * 7, " ab" * 20, "😀" * 8, "plain words that go on " * 2]
    for _ in range(300):
        unit = "".join(r.choice("ab 的") for _ in range(r.randint(1, 5)))
        texts.append("".join(r.choice("abcdefg ") for _ in range(r.randint(0, 30))) + unit * r.randint(1, 14) + "".join(r.choice("xyz") for _ in range(r.randint(0, 9))))
    assert values(spark, T.has_degenerate_repetition, texts) == [cycles(x) for x in texts]


def test_garbage_fragments(spark):
    rows = {"": True, "x = y": True, "a [b] of the longer kind": True, "def is a word here": True, "undefined words here": False, "∑ of many words here": True, "to be or no of it so": True, "plain words stay here": False, "12345 67890": True, "a+b<c> words stay here": False, "long enough " * 4 + "= x": False, "中文字也算字母六個": False, "undef def": True}
    assert values(spark, T.is_garbage_fragment, rows) == list(rows.values())


def test_noisy_summaries(spark):
    long = "Some words of English text that fill the line up to where it counts, and then on for more of the same, line after line."
    rows = {long: True, "short": False, "中文" * 40: False, "1234 5678 " * 8 + "[1] [2,3]": True, "1234 5678 " * 8 + "[1]": False, "1234 5678 " * 8 + "~~": True, "中文字多些啊" + "1234 5678 " * 8 + "~~": False, "(Smith et al) 123 " * 5 + "9" * 20: False}
    assert values(spark, T.is_noisy_summary, rows) == list(rows.values())


def test_plausible_titles(spark):
    rows = {"A title": True, "ab": False, "x" * 261: False, "Untitled": False, "none": True, "Context  &  Background of it": False, "研究背景與動機": False, "What? Why!": False, "e.g. one. Two. Three": True, "a, " * 8 + "b" * 120: False, "a, " * 8 + "b": True}
    assert values(spark, T.is_plausible_title, rows) == list(rows.values())


def test_errors(spark):
    rows = {"Read TIMED OUT": (True, False), "connection refused": (False, False), "connection reset": (True, False), "quota": (False, False), "quota throttle": (True, False), "503 per day": (True, False), "429 daily": (True, True), "Quota PerProjectPerModel": (False, True), "service unavailable": (False, False)}
    assert values(spark, T.is_retryable, rows) == [a for a, _ in rows.values()]
    assert values(spark, T.is_daily_quota, rows) == [b for _, b in rows.values()]


def test_urls(spark):
    rows = {"https://doi.org/x": True, "HTTPS://u:p@API.Crossref.org:8443/w": True, "http://doi.org": False, "https://evildoi.org": False, "https://doi.org.evil/": False, "https://doi.org@evil.org": False, "https://[::1]/": False, "doi.org": False, "https:///doi.org": False, None: False}
    assert values(spark, S.is_allowed_url, rows) == list(rows.values())
    df = spark.createDataFrame([(["8.8.8.8"], True), (["8.8.8.8", "10.0.0.1"], False), ([], False), (None, False), (["172.31.0.1"], False), (["172.32.0.1"], True), (["127.0.0.1"], False), (["224.0.0.1"], False), (["169.254.1.1"], False)], "a array<string>, want boolean")
    assert all(r.got == r.want for r in df.select("want", S.is_allowed_url(F.lit("https://doi.org/"), addresses=F.col("a")).alias("got")).collect())


def test_fusion_quality(spark):
    rows = [("p", f"w{i} x", "stack_b1") for i in range(20)] + [("q", "one two three four five", "STACK_A")] * 20 + [("r", "one", "stack_b")] * 15 + [("s", "one two three four five", " stack_b")] * 30 + [("s", " ", "stack_a")]
    got = {x.g: x for x in L.quality_metrics(spark.createDataFrame(rows, "g string, text string, source string"), "g").collect()}
    assert got["p"].reasons == ["avg_tokens_per_block=2.00<4.00", "stack_b_ratio=1.000>0.920 with avg_tokens=2.00<8.00"] and got["p"].low_quality
    assert not got["q"].low_quality and got["q"].stack_a_ratio == 1.0 and not got["r"].low_quality
    assert got["s"].reasons == ["stack_b_ratio=1.000>0.920 with avg_tokens=5.00<8.00"] and got["s"].block_count == 30


def test_garbage_fragments_of_a_long_text(spark, tmp_path):
    """Half a million characters are cut once; positions count characters, null has one piece."""
    from corvane.plans import catalog

    long = "größe und wörter " * 30_000
    spark.createDataFrame([(1, long), (2, None), (3, "x" * 38), (4, "x" * 37)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n): r.garbage for r in catalog.garbage_fragments(spark, str(tmp_path)).collect()}
    assert sum(d == 1 for d, _ in got) == -(-len(long.strip()) // 37) and got[2, 0] and [k for k in sorted(got) if k[0] > 2] == [(3, 0), (3, 1), (4, 0)]
    assert not got[4, 0] and got[3, 1] and not got[1, 0]
