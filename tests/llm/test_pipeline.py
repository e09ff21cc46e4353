import zlib
from collections import Counter

import pytest

import corpus_pipeline


def test_stages_keep_columns_and_run(spark, tmp_path):
    good = "The quick brown fox jumps over the lazy dog while seven wise owls look on from old oaks."
    rows = [(i, f"{good} Story {i} has its own ending, told by person {i * 7} on day {i % 9}.", "en", f"src{i % 4}", 10) for i in range(60)]
    rows += [(100 + i, "*** $$$ ### !!! " * 20 + str(i), "en", "src0", 10) for i in range(40)]
    rows += [(200, None, None, None, None), (201, "", "en", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in rows[:100]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names[0] == "quality classifier" and len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        path = str(tmp_path / f"out{k}")
        out.write.parquet(path)
        now = spark.read.parquet(path)
        if k < 4:
            assert now.columns == list(corpus_pipeline.COLUMNS)
        if k == 0:
            assert {x.doc_id for x in now.collect()} & set(range(160)) == set(range(60))
    assert now.where("NOT exact").count() == 0 and now.count() > 0


def staged(spark, tmp_path, rows, labels):
    """The stages' outputs, each written and read again."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        out.append(now.collect())
    return out


def test_stages_against_brute_force(spark, tmp_path):
    """Line dedup, near copies and the mix's sums as plain Python finds them, repeated ids included."""
    rows = []
    for i in range(50):
        body = " ".join(f"word{(i * 31 + k * k) % 97} tale{k * i % 13}" for k in range(30))
        rows.append((i, f"{body}.\nA line that many documents of this table share", "en", f"src{i % 3}", 10, "x"))
    rows += [(60, rows[3][1] + " more", "en", "src0", 10, "x"), (7, "another text under an id that is taken already, with words of its own", "en", "src1", 1, "x"), (7, rows[8][1], "en", "src2", 1, "x")]
    rows += [(None, "a text without any id stays a text of its own here", None, None, None, None), (61, "long " * 300, "en", "src0", 1, "x")]
    first, second, third, fourth, fifth = staged(spark, tmp_path, rows, [])
    assert len(first) == len(rows)  # no labels: a constant score of one half rejects nothing
    holders = {}
    for d, t, *_ in rows:
        for line in t.split("\n"):
            holders.setdefault(line.strip().lower(), set()).add(float("inf") if d is None else d)
    want = Counter()
    for d, t, *_ in rows:
        own = float("inf") if d is None else d
        want[d, "\n".join(x for x in t.split("\n") if len(x.strip()) < 10 or len(holders[x.strip().lower()]) < 2 or min(holders[x.strip().lower()]) == own)] += 1
    assert Counter((x.doc_id, x.text) for x in second) == want
    # The second row of id 7 repeats the line of 8, which thereby is left without words; the rows
    # of 7 are one document, of which one row stays. No two others are near copies here.
    assert Counter(x.doc_id for x in third) == Counter({d: 1 for d, *_ in rows})
    size = Counter()
    for x in third:
        size[x.source] += len(x.text.split())
    took = Counter()
    for x in fourth:
        took[x.source] += len(x.text.split())
    assert set(Counter((x.doc_id, x.text) for x in fourth).values()) <= {1, 2}
    assert {(x.doc_id, x.text) for x in fourth} <= {(x.doc_id, x.text) for x in third}
    assert sum(took.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.2)
    assert {x.doc_id for x in fifth} == {x.doc_id for x in fourth} and all(x.exact for x in fifth)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert [len(x) for x in staged(spark, tmp_path, [], [])] == [0] * 5


def test_mix_stage_takes_what_the_operator_took(spark, tmp_path):
    """Rows of one id with different texts: the words taken are those that the mix dealt."""
    from corvane.llm.mixing import mix_sources

    rows = [(i // 3, " ".join(["w"] * (1 + zlib.crc32(str(i).encode()) % 90)), "en", "ab"[i % 2], 1) for i in range(300)] + [(None, "v " * k, "en", "a", 1) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dealt, took = Counter(), Counter()
    for x in mix_sources(docs).collect():
        dealt[x.source] += x.taken
    for x in corpus_pipeline.mix(spark, docs, "").collect():
        took[x.source] += len(x.text.split())
    assert took == dealt
