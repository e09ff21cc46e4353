"""What the operators of this package share: the shared folder, Arrow access, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of every contract here: space and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"
#: Keys with this share (one in ...) of all rows, and so many rows, are dealt over several tasks.
HOT_SHARE, HOT_ROWS = 1000, 1000
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A temporary folder stands in only where the session runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        existing = sc._jsc.sc().getCheckpointDir()
        named = existing.get() if existing.isDefined() else None
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corvane-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}/{tag}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_at(df: DataFrame, path: str, old: str | None = None) -> DataFrame:
    """Writes df to path, reads it back, and deletes old, the step that path follows: what is
    written in the shared folder outlives executors, so steps before the last are not needed."""
    df.write.parquet(path)
    if old:
        sc = df.sparkSession.sparkContext
        gone = sc._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, held: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """rows joined with held, which has one row for each key and in size the number of its rows.

    Keys of at least a HOT_SHARE-th of total rows (and HOT_ROWS), of which there are at most
    HOT_SHARE, are dealt over several tasks by spread, each with its copy of the row of held."""
    hot = max(HOT_ROWS, total // HOT_SHARE)
    at, salts = unused(rows, "at", "salts")
    parts = F.ceil(F.col(size) / hot).cast("int")
    few = held.where(F.col(size) >= hot).select(key, parts.alias(salts))
    dealt = rows.join(F.broadcast(few), key, "left").withColumn(at, F.pmod(spread, F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    return dealt.join(held.withColumn(at, F.explode(F.sequence(F.lit(0), parts - 1))), [key, at]).drop(at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same, faster, where a text is all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def text_bytes(table: pa.Table, name: str) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [b"" if x is None else x for x in table.column(name).cast(pa.large_binary()).to_pylist()]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that clash, ignoring case, with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, ignoring case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# Odd multipliers of public integer mixers.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE_TABLE = np.zeros(256, dtype=bool)
_SPACE_TABLE[list(SPACE)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            _powers[key] = np.multiply.accumulate(full)
    return _powers["up"], _powers["down"]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't white space."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE_TABLE[b]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order.

    A polynomial over the bytes, from differences of one running sum, so that no Python
    code runs for a word. Texts are taken in pieces that end at white space."""
    out = []
    at, step = 0, 1 << 20
    while at < len(raw):
        end = min(len(raw), at + step)
        while end < len(raw) and raw[end] not in SPACE:
            end += 1
        piece = raw[at:end]
        at = end
        starts, ends = word_spans(piece)
        if not len(starts):
            continue
        up, down = _power_table(len(piece) + 1)
        terms = (np.frombuffer(piece, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(piece)]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(terms, out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        out.append(mix64(h + (ends - starts).astype(np.uint64) * _MIX2))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
