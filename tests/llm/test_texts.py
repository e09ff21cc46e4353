import collections
import hashlib

import numpy as np
import pytest

from corvane.llm.common import mix64, word_hashes
from corvane.llm.subword import Vocabulary, _state, decode, decode_pieces, encode_samples, sample_texts
from corvane.llm.warc import archive_and_read, parse_records, read_warc, write_warc

PAGES = "page_id long, url string, html string"


def test_word_hashes_depend_on_words_alone():
    a = word_hashes("one two  one\tthree".encode())
    assert a[0] == a[2] and len(set(a.tolist())) == 3
    long = ("x" * 2_000_000 + " one").encode()
    assert word_hashes(long)[1] == a[0] and len(word_hashes(b" \n")) == 0


def b32(raw):
    import base64

    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, None), (4, "http://a/ 4\r\n", ""), (6, "u", "WARC/1.1\r\n\r\n" * 3), (7, "u", "ä€😀" * 20000), (8, "u", "tail\r\n\r\n"), (None, "u", "same"), (9, "u", "one"), (9, "u", "one")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], PAGES + ", kind string")
    got = archive_and_read(pages, captures_per_file=3).collect()
    top = {"same": 5, "": 4, "one": 9}
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        best = top.get(t or "", i)
        want.append((str(i), len(raw), b32(raw), "response" if i == best else "revisit", None if i == best else best))
    assert sorted((str(x.page_id), x.response.payload_bytes, x.response.payload_digest, x.response.kind, x.refers_to) for x in got) == sorted(want, key=lambda x: (x[0], x[1]))
    assert all(x.request is not None and x.metadata is not None for x in got)
    write_warc(pages, str(tmp_path / "w"))
    read = read_warc(spark, str(tmp_path / "w")).where("kind = 'response'").collect()
    # One response of each payload; of the rows that repeat the largest id and the payload, both.
    assert sorted(x.payload for x in read) == sorted([*{(t or "").encode() for _, _, t in rows}, b"one"])
    assert archive_and_read(spark.createDataFrame([], PAGES)).collect() == []


def test_archives_leave_small_payloads_alone(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = archive_and_read(spark.createDataFrame(rows, PAGES), least_bytes=3).collect()
    assert sorted((x.page_id, x.response.kind, x.refers_to) for x in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_damaged_archives_are_refused():
    with pytest.raises(ValueError):
        list(parse_records(b"no archive\r\n\r\n"))
    with pytest.raises(ValueError):
        list(parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def segmentations(lat, s):
    if not s:
        yield (), 0.0
        return
    for j in range(1, len(s) + 1):
        hit = lat.weights.get(s[:j])
        if hit:
            for rest, w in segmentations(lat, s[j:]):
                yield (hit[0], *rest), hit[1] + w


def test_samples_follow_the_distribution_without_replacement(vocabulary):
    lat = _state(vocabulary)
    logs = dict(segmentations(lat, " the on"))
    total = np.logaddexp.reduce(list(logs.values()))
    p = {k: float(np.exp(w - total)) for k, w in logs.items()}
    n = 6000
    out = sample_texts(["the on"] * n, mix64(np.arange(n, dtype=np.uint64)), vocabulary, 3)
    first = collections.Counter(tuple(o[0][0]) for o in out)
    second = collections.Counter(tuple(o[1][0]) for o in out)
    after = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    assert max(abs(first[k] / n - p[k]) for k in p) < 0.015
    assert max(abs(second[k] / n - after[k]) for k in p) < 0.015
    for o in out[:500]:
        assert len({tuple(s[0]) for s in o}) == 3 and o[0][2] >= o[1][2] >= o[2][2]
        assert all(abs(s[1] - np.log(p[tuple(s[0])])) < 1e-9 for s in o)
    # Inclusion scores make an unbiased estimate of the whole mass.
    assert np.mean([sum(np.exp(s[1]) / s[3] for s in o) for o in out]) == pytest.approx(1, abs=0.01)


def test_a_text_with_few_segmentations_gives_all(vocabulary):
    lat = _state(vocabulary)
    n = len(list(segmentations(lat, " in")))
    got = sample_texts(["in"], np.array([3], dtype=np.uint64), vocabulary, 50)[0]
    assert len(got) == n == len({tuple(s[0]) for s in got})
    assert all(s[3] == 1.0 for s in got)


@pytest.mark.parametrize("text", ["", " ", "a", "  two  blanks ", "line\n\nline\t", "é 😀 ▁ 肝 \x00 <s> <0x0A>", "ß" * 3000])
def test_round_trip(vocabulary, text):
    for ids, *_ in sample_texts([text], np.array([1], dtype=np.uint64), vocabulary, 4)[0]:
        assert decode(ids, vocabulary) == text


def test_samples_do_not_depend_on_batches(spark, vocabulary):
    rows = [(i, f"some words of text number {i} " * (i % 5 + 1)) for i in range(40)] + [(90, None), (91, ""), (None, "x"), (None, "x")]
    one = encode_samples(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, samples int").coalesce(1), vocabulary, samples=3)
    many = encode_samples(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), vocabulary, samples=3)
    key = lambda df: sorted((str(x.doc_id), x.text or "", [list(s.ids) for s in x.samples]) for x in df.collect())
    assert key(one) == key(many)
    assert all(s.exact for x in many.collect() for s in x.samples)
    ids = many.where("doc_id = 5").selectExpr("doc_id", "samples[0].ids AS ids")
    assert decode_pieces(ids, vocabulary).first().text == rows[5][1]
    assert encode_samples(spark.createDataFrame([], "doc_id long, text string"), vocabulary).collect() == []
