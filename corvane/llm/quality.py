"""Quality classifier: boosted trees over statistics of whole texts.

The trees are fitted on the driver from a bounded sample of labelled rows and travel to the
executors as a few small arrays. Every text is scored in full where it lies; nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.boosting import Forest, fit_boosted
from corvane.llm.common import text_bytes, without, word_hashes, word_spans

#: Labelled rows that a classifier is fitted on, at most.
FIT_ROWS = 20_000
#: Words of the windows in which the share of odd words is taken.
WINDOWS = (16, 64)

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 newline, 6 point, 7 symbol, 8 high
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[list(b" \t\x0b\x0c\r")], _KIND[10] = 4, 5
_KIND[list(b".,;:?'\"-()")] = 6
_KIND[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 7
_KIND[128:] = 8


def _share(a, b) -> float:
    return float(a) / max(float(b), 1.0)


def text_statistics(raw: bytes) -> list[float]:
    """Numbers that describe a text; the empty text has zeros."""
    b = np.frombuffer(raw, dtype=np.uint8)
    kinds = np.bincount(_KIND[b], minlength=9)
    visible = len(b) - kinds[4] - kinds[5]
    out = [np.log1p(len(b)), *(_share(kinds[k], visible) for k in (1, 2, 3, 6, 7, 8))]
    starts, ends = word_spans(raw)
    n = len(starts)
    if not n:
        return [*out, *[0.0] * (14 + 2 * len(WINDOWS))]
    size = ends - starts
    first, last = _KIND[b[starts]], _KIND[b[ends - 1]]
    second = _KIND[b[np.minimum(starts + 1, ends - 1)]]
    shout = (first == 1) & (second == 1) & (size > 1)
    symbol = (last == 7) | (first == 7)
    h = word_hashes(raw)
    same = np.zeros(n, dtype=bool)
    same[1:] = h[1:] == h[:-1]
    counts = np.unique(h, return_counts=True)[1]
    pairs = np.unique(h[1:] * np.uint64(31) + h[:-1]) if n > 1 else h
    odd = shout | symbol | same
    lines = raw.count(b"\n") + 1
    ended = np.isin(b[ends - 1], np.frombuffer(b".!?", dtype=np.uint8)).sum()
    out += [np.log1p(n), size.mean(), size.std(), float(size.max()), _share(len(counts), n), _share(counts.max(), n), _share(len(pairs), n - 1), _share(shout.sum(), n), _share(symbol.sum(), n), _share(same.sum(), n), np.log1p(odd.sum()), _share(ended, n), _share(n, lines), _share((size == 1).sum(), n)]
    run = np.concatenate([[0], np.cumsum(odd)])
    for w in WINDOWS:
        w = min(w, n)
        out.append(float((run[w:] - run[:-w]).max()) / w)
        out.append(float((run[w:] - run[:-w]).min()) / w)
    return [float(v) for v in out]


N_STATISTICS = len(text_statistics(b""))


def _statistics(text_col: str, out_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [text_statistics(raw) for raw in text_bytes(pa.Table.from_batches([batch]), text_col)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("label"), pa.array(stats, out_type)], names=["doc", "label", "x"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, most_rows: int = FIT_ROWS) -> Forest:
    """Trees fitted on labelled rows whose crc32(id as text) mod 3 is not 1.

    Of more than most_rows such rows, those of smallest hash are taken. Null labels and labels
    without a document are skipped; an id that repeats, in docs or labels, gives a row for each
    pair, within most_rows; labels of one class only, or none, give a constant score."""
    train = labels.where((F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) != 1) & F.col(label_col).isNotNull())
    train = train.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("label"))
    sample = train.orderBy(F.xxhash64("doc"), "doc", "label").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc")
    stats = rows.mapInArrow(_statistics("text", pa.list_(pa.float64())), "doc long, label int, x array<double>")
    got = stats.orderBy(F.xxhash64("doc"), "doc", "label", "x").limit(most_rows).collect()  # ids may repeat
    got.sort(key=lambda r: (r.doc, r.label, r.x))
    x = np.array([r.x for r in got], dtype=float).reshape(-1, N_STATISTICS)
    return fit_boosted(x, np.array([r.label for r in got], dtype=float))


def score_quality(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5).

    Null text is scored as the empty text. Columns named score or predicted are replaced; all
    others, whatever their names, pass unchanged. Only the text enters the score."""
    plain = without(docs, "score", "predicted")
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(pa.Table.from_batches([batch]), text_col)
            x = np.array([text_statistics(raw) for raw in texts], dtype=float).reshape(-1, N_STATISTICS)
            score = forest.probabilities(x) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, score double, predicted int")
