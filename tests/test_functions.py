import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import biblio as B
from corvane.functions import geometry as G
from corvane.functions import status as S
from corvane.functions import text as T
from corvane.functions import udfs as U
from corvane.operators.retrieval import context_score, dense_cosine, lexical_score, sparse_cosine


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_tokens(spark):
    cases = [("Diabetes insulin-resistance 2024", ["diabetes", "insulin", "resistance", "2024"]), ("深度學習", ["深度", "度學", "學習"]), ("肝", ["肝"]), ("", []), (None, []), ("snake_case café", ["snake_case", "café"])]
    df = spark.createDataFrame([(a, b) for a, b in cases], "a string, b array<string>")
    assert [r.t for r in df.select(T.tokens(F.col("a")).alias("t")).collect()] == [b for _, b in cases]
    assert one(spark, T.chain_tokens(F.lit("A b1 深度 x"))) == ["b1", "深度"]


def test_estimates_and_clips(spark):
    assert one(spark, T.estimate_cjk(F.lit("深度abcd"))) == int(1.5 * 2 + 0.35 * 4)
    assert one(spark, T.estimate_quarter(F.lit("abc"))) == 1
    assert one(spark, T.estimate_provider(F.lit("a" * 10), output=5)) == 3 + 5
    assert one(spark, T.clip(F.lit("abc def ghi"), 4)) == "abc..."
    assert one(spark, T.squash(F.lit(" a \n\t b "))) == "a b"
    assert one(spark, T.sanitize(F.lit("a\x00b\tc"))) == "ab\tc"


@pytest.mark.parametrize("text, want", [("previous studies have been reported in 42% of cases", True), ("Now we turn to the next section.", False), ("", False)])
def test_citation_needed(spark, text, want):
    assert one(spark, T.is_citation_needed(F.lit(text))) is want


def test_headings(spark):
    assert one(spark, T.section_label(F.lit("3.1 Materials and Methods"))) == "Methods"
    assert one(spark, T.section_label(F.lit("IV. Experimental evaluation"))) == "Results"
    assert one(spark, T.section_label(F.lit("nothing here"))) == ""
    assert one(spark, T.is_section_anchor(F.lit("2.3 Setup")))
    assert one(spark, T.is_non_evidence_title(F.lit("7. References"))) and not one(spark, T.is_non_evidence_title(F.lit("Reference model")))
    assert one(spark, T.label_by_position(F.lit(5), F.lit(10))) == "Methods"


def test_noise(spark):
    assert one(spark, T.is_low_information(F.lit("short")))
    assert not one(spark, T.is_low_information(F.lit("a perfectly ordinary sentence about many things")))
    assert one(spark, T.is_meta_noise(F.lit("Corresponding author: A. Person")))
    assert one(spark, T.is_meta_noise(F.lit("Alice Chen, Bob Lin, Carol Wu, Dan Ho, Eve Ng")))
    assert one(spark, T.has_degenerate_repetition(F.lit("aaaaaaaaaa"))) and not one(spark, T.has_degenerate_repetition(F.lit("ordinary text")))
    assert one(spark, T.is_mostly_chinese(F.lit("深度學習 ab"))) and not one(spark, T.is_mostly_chinese(F.lit("abcdef 深")))


def test_latex_and_equations(spark):
    assert one(spark, T.looks_like_latex(F.lit(r"\frac{a}{b}"))) and one(spark, T.looks_like_latex(F.lit("x = 1")))
    assert not one(spark, T.looks_like_latex(F.lit("[Equation]"))) and one(spark, T.is_failed_equation(F.lit("<Failed to OCR Equation>")))


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10))) == 1
    assert one(spark, G.iou(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0
    assert 0 < one(spark, G.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) < 1
    assert one(spark, G.iou_swapped(box(10, 10, 0, 0), box(0, 0, 10, 10))) == 1
    assert one(spark, G.iou(box(1, 2), box(0, 0, 1, 1))) == 0
    assert one(spark, G.iou_floor(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, G.center_inside(box(0, 0, 2, 2), box(1, 1, 5, 5)))
    assert one(spark, G.block_score(F.lit(0.0), F.lit(0.9))) == pytest.approx(0.765)


def test_decide_content(spark):
    pick = lambda k, a, sa, b, sb: tuple(one(spark, G.decide_content(F.lit(k), F.lit(a), F.lit(sa), F.lit(b), F.lit(sb))))
    assert pick("Body", "garbled", 0.5, "cleaner text", 0.8) == ("cleaner text", "stack_b_override")
    assert pick("Body", "long enough text", 0.5, "short", 0.9) == ("long enough text", "stack_a")
    assert pick("Equation", "[Equation]", 0.1, "x^2", 0.1) == ("x^2", "stack_b_override")
    assert pick("Equation", "", 0.1, "", 0.1)[1] == "equation_failed"
    assert pick("Figure", "[Figure]", 0.9, "caption", 0.1)[1] == "stack_b_override"


def test_bibliography(spark):
    assert one(spark, B.normalize_doi(F.lit(" https://doi.org/10.1234/Ab.c). "))) == "10.1234/Ab.c"
    assert one(spark, B.normalize_doi(F.lit("11.1/x"))) == ""
    assert one(spark, B.clean_authors(F.lit("Alice Chen and Bob Lin"))) == ["Alice Chen", "Bob Lin"]
    assert one(spark, B.coerce_year(F.lit("2024-01-01"))) == 2024
    assert one(spark, B.normalize_year(F.lit("99"))) is None
    names = F.array(F.lit("Alice Chen"), F.lit("Bob Lin"))
    assert one(spark, B.apa_authors(names)) == "Alice Chen & Bob Lin"
    entry = one(spark, B.bibtex_entry(names, F.lit(2024), F.lit("A {B} study"), F.lit("J"), F.lit(""), F.lit(None).cast("string")))
    assert entry == "@article{chen2024abstudy,\n  title = {A \\{B\\} study},\n  author = {Alice Chen and Bob Lin},\n  year = {2024},\n  journal = {J}\n}"
    assert one(spark, B.entry_key(F.lit(""), F.lit(" !"))) is None
    assert one(spark, B.inverted_index_text(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"


def test_versions_and_percent(spark):
    assert one(spark, B.parse_version(F.lit("V1.2"))) == 12 and one(spark, B.parse_version(F.lit("3"))) == 30 and one(spark, B.parse_version(F.lit("x"))) is None
    assert one(spark, B.format_version(F.lit(12))) == "1.2"
    df = spark.createDataFrame([("80%",), ("150",), ("-3",), ("nan",), ("2.5",), ("3.5",), ("x",), (None,)], "v string")
    assert [r.p for r in df.select(B.clamp_percent(F.col("v")).alias("p")).collect()] == [80, 100, 0, None, 2, 4, None, None]


def test_scores(spark):
    words = F.array(*[F.lit(x) for x in ("a", "b", "a")])
    q = F.array(F.lit("a"), F.lit("c"))
    assert one(spark, lexical_score(q, words)) == pytest.approx(round(0.58 * 0.5 + 0.37 * 2 / 3.5 + 0.02, 6))
    assert one(spark, lexical_score(F.array(F.lit("z")), words)) == 0
    assert one(spark, context_score(q, words, 1.0)) == pytest.approx(0.72 * 0.5 + 0.28 * 0.5)
    assert one(spark, sparse_cosine(words, words)) == pytest.approx(1)
    assert one(spark, dense_cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1 / math.sqrt(2))


def test_error_rates(spark):
    assert one(spark, T.character_error_rate(F.lit("abc"), F.lit("abc"))) == 0
    assert one(spark, T.character_error_rate(F.lit(""), F.lit(""))) == 0
    assert one(spark, T.character_error_rate(F.lit("x"), F.lit(""))) == 1
    assert U.word_error("a b c", "a x c") == pytest.approx(1 / 3)
    assert U.word_error("", "") == 0 and U.word_error("a", "") == 1
    assert U.edit_distance("kitten", "sitting") == 3


def test_snippet_takes_the_densest_window():
    text = "lead mer word " + "filler " * 300 + "mer mer value falls from 52.08 to 7.56 mer mer mer"
    got = U.densest_window(text, ["mer"], 600)
    assert "7.56" in got and len(got) <= 600
    assert U.densest_window("short", ["x"], 600) == "short"


def test_budget_cut():
    for n in (1, 5, 17, 40):
        assert U.estimate(U.cut_to_budget("深度 learning " * 50, n)) <= n
    assert U.cut_to_budget("abc", 100) == "abc" and U.cut_to_budget("abc", 0) == ""


def test_packing():
    assert U.pack_sentences("One. Two. " + "x" * 25, 10) == ["One. Two.", "x" * 10, "x" * 10, "xxxxx"]
    assert U.pack_batches([10, 10, 10, 10, 10]) == [0, 0, 0, 0, 1]
    assert U.pack_batches([1700, 200, 10]) == [0, 1, 1]


def test_json_and_spans():
    assert U.json_blob('x {"a": "}"} y') == '{"a": "}"}'
    assert U.json_reply('```json\n{"b": 1}\n```') == '{"b": 1}'
    assert U.json_reply("no json") is None
    text = r"see $x^2$ at https://a.b/c and 10.1234/x.y"
    masked, spans = U.protect(text)
    assert len(spans) == 3 and "$" not in masked and U.restore(masked, spans) == text


def test_embedding_and_html():
    v = U.hash_vector("a b a", 8)
    assert len(v) == 8 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    assert U.hash_vector("", 2) == [0.0] * 4
    assert U.plain_text("<p>a&amp;b<br>c</p><ul><li>d</ul><script>x</script>") == "a&b\nc\n• dx"


def test_documents_in_other_coats():
    import base64
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:t>one</w:t><w:tab/><w:t>two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:document>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}"><w:p><w:t>head</w:t></w:p></w:hdr>')
    assert U.docx_text(raw.getvalue()) == "one\ttwo\nthree\n\nhead"
    assert U.docx_text(b"no zip") == ""
    assert U.data_url_text("data:text/plain;base64," + base64.b64encode("hé".encode()).decode()) == "hé"
    assert U.data_url_text("data:text/plain,a%20b") == "a b"
    assert U.data_url_text("data:image/png;base64,AAAA") == "" and U.data_url_text(None) == ""


def test_states(spark):
    assert one(spark, S.classify_error(F.lit("flowb_x"))) == "translation_incomplete"
    assert one(spark, S.progress_percent(S.milestones(F.array(F.lit("upload"), F.lit("ocr"))))) == 45
    assert tuple(one(spark, S.sequence_parts(F.lit("p3_figure_12")))) == (3, 12)
    assert one(spark, S.resolved_title(F.lit("My Paper.pdf"), F.lit("my paper.pdf"), F.lit("x"))) is None
    assert one(spark, S.image_type(F.unhex(F.lit("89504E470D0A1A0A00000000")))) == "png"
    assert one(spark, S.natural_key(F.lit("p10"))) > one(spark, S.natural_key(F.lit("p9")))
    assert one(spark, S.voxel_line(F.lit(1.5), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("t\nu"))) == "[RPI: 1.00] (a, b, c) t<br>u"
    assert one(spark, T.retry_after_seconds(F.lit("429, retry in 12.5s"))) == 12.5
    assert one(spark, T.overlap_jaccard(F.lit("alpha beta"), F.lit("beta gamma"))) == pytest.approx(33.3)
    assert one(spark, T.search_keywords(F.lit("The study of Deep nets"))) == ["The study of Deep nets", "deep", "nets"]


def test_crumbs_on_a_long_line(spark):
    """Lines of 200,000 crumbs overflow no stack; words end where ASCII letters do, as in SQL."""
    lines = ["a b " * 100_000, "su de y de de do y ciónmi and more words behind", "su de y de de words y a lot more of them behind"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", T.is_low_information(F.col("x")).alias("low")).orderBy("i").collect()
    assert [r.low for r in got] == [True, True, False]


def test_exact_estimates(spark):
    """140 characters are 49 tokens; sums of doubles make 48 of some such lengths."""
    off = [n for n in range(20, 60_000, 20) if int(0.35 * n) != 7 * n // 20]
    assert off and all(U.estimate_exact("a" * n) == 7 * n // 20 for n in off[:20])
    x = "a" * off[0]
    assert one(spark, T.estimate_exact(F.lit(x))) == 7 * off[0] // 20
    cut = U.cut_to_budget("a" * 70_000, 7 * off[0] // 20, U.estimate_exact)
    assert U.estimate_exact(cut) <= 7 * off[0] // 20 < U.estimate_exact(cut + "a")


def test_upper_case_by_characters(spark):
    assert one(spark, T.upper_simple(F.lit("ßtraße ünd"))) == "ßTRAßE ÜND"
    assert one(spark, T.upper_simple(F.lit("plain é"))) == "PLAIN É"
