"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

A text is cut where no piece of the vocabulary can cross: before each run of blanks and around
characters that only byte pieces cover. Each distinct cut has a lattice whose arcs are pieces,
weighted by a Zipf law over the vocabulary's ranks; the log mass below a node is an exact
heuristic. The k segmentations of largest Gumbel-perturbed log probability are found best
first (A*): a path keeps the Gumbel of the set it came from, and each set it leaves behind gets
a Gumbel bounded by that one, so the next best path starts at the largest of those. Random
numbers are hashes of the row's key, so neither batches nor partitions change a result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import mix64, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the texts that are sampled together, and arcs a worker keeps between batches.
BATCH_CHARS, MOST_ARCS = 500_000, 1_200_000
#: Natural log weight of an arc that spells a character in bytes.
BYTE_WEIGHT = -30.0
BLANK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as in the model file; ids of byte pieces; alpha sharpens (>1) or flattens (<1)."""

    pieces: tuple[str, ...]
    kinds: tuple[str, ...]
    usable: tuple[bool, ...]
    alpha: float
    key: str

    @staticmethod
    def load(path: str = MODEL, alpha: float = 1.0) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = tuple(m.id_to_piece(i) for i in range(n))
        kinds = tuple("byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "text" for i in range(n))
        # A merge that training never scored is no piece that encoding can give.
        usable = tuple(k == "text" and (m.get_score(i) > -1e8 or len(pieces[i]) == 1) for i, k in enumerate(kinds))
        return Vocabulary(pieces, kinds, usable, alpha, xxhash.xxh3_64_hexdigest(repr((pieces, usable, alpha)).encode()))


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of piece ids: bytes joined, blanks restored, the dummy blank in front removed."""
    return _state(vocabulary).decode(np.asarray(ids, dtype=np.int64))


@dataclass
class _Lattices:
    """Lattices of distinct cuts, as arrays over nodes and arcs that grow."""

    v: Vocabulary
    weights: dict[str, tuple[int, float]] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=lambda: [0] * 256)

    def __post_init__(self):
        spelled = []
        for i, (p, kind) in enumerate(zip(self.v.pieces, self.v.kinds)):
            if kind == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
                spelled.append(bytes([int(p[3:5], 16)]))
            else:
                spelled.append(p.replace(BLANK, " ").encode() if kind == "text" else b"")
        total, rank = 0.0, 0
        for i, p in enumerate(self.v.pieces):
            if self.v.usable[i]:
                rank += 1
                w = -self.v.alpha * np.log(rank + 2.7)
                total += np.exp(w)
                text = p.replace(BLANK, " ")
                self.weights[text] = (i, float(w))
        self.weights = {t: (i, w - float(np.log(total))) for t, (i, w) in self.weights.items()}
        self._index_pieces()
        self.bytes_at = np.concatenate([[0], np.cumsum([len(b) for b in spelled])]).astype(np.int64)
        self.bytes_of = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        used = sorted({c for t in self.weights for c in t} - {" "})
        # Characters outside the vocabulary stand alone; others join with the blanks before them.
        inside = "".join(re.escape(c) for c in used)
        self.cut = re.compile(f" *[{inside}]+| +|[^ {inside}]")
        self.clear()

    def _index_pieces(self) -> None:
        """An open-addressed table from hashes of pieces and their prefixes to piece id and weight."""
        known: dict[int, tuple[int, float]] = {}
        for text, (i, w) in self.weights.items():
            h = 0
            for j, c in enumerate(text):
                h = (h * int(_CHAR) + ord(c) + 1) % (1 << 64)
                if j == len(text) - 1:
                    known[h] = (i, w)
                else:
                    known.setdefault(h, (-1, 0.0))
        if len(known) != len({t[:j] for t in self.weights for j in range(1, len(t) + 1)}):
            raise ValueError("two pieces have one hash")
        size = 1 << (4 * len(known)).bit_length()
        self.mask = np.uint64(size - 1)
        self.slot_key, self.slot_piece, self.slot_weight = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32), np.zeros(size)
        self.slot_used = np.zeros(size, dtype=bool)
        self.longest_probe = 1
        homes = (mix64(np.array(list(known), dtype=np.uint64)) & self.mask).tolist()
        for (h, (i, w)), at in zip(known.items(), homes):
            tries = 1
            while self.slot_used[at]:
                at, tries = (at + 1) & (size - 1), tries + 1
            self.longest_probe = max(self.longest_probe, tries)
            self.slot_used[at], self.slot_key[at], self.slot_piece[at], self.slot_weight[at] = True, h, i, w

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        at = mix64(h) & self.mask
        found = np.full(len(h), -1, dtype=np.int64)
        left = np.arange(len(h))
        for _ in range(self.longest_probe):
            own = at[left]
            used = self.slot_used[own]
            same = used & (self.slot_key[own] == h[left])
            found[left[same]] = own[same]
            left = left[used & ~same]
            if not len(left):
                break
            at[left] = (at[left] + np.uint64(1)) & self.mask
        return found

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.first = np.zeros(1 << 16, dtype=np.int32)  # arcs of node: first[node] .. first[node + 1]
        self.share = np.zeros(1 << 17)  # cumulated within a node, ends at 1
        self.logp = np.zeros(1 << 17)
        self.next = np.zeros(1 << 17, dtype=np.int32)  # node, or -1 at the end of the cut
        self.out = np.zeros(1 << 17, dtype=np.int32)  # piece id, or -1 - (start of byte ids)
        self.node = np.zeros(1 << 17, dtype=np.int32)  # that the arc leaves
        self.nodes = self.arcs = 0
        self.spelled: list[int] = []

    def _room(self, nodes: int, arcs: int) -> None:
        while self.nodes + nodes + 1 >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.arcs + arcs >= len(self.logp):
            for name in ("share", "logp", "next", "out", "node"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.zeros_like(a)]))

    def starts(self, cuts: list[str]) -> np.ndarray:
        """First node of each cut; new cuts get their lattice."""
        index = self.index
        new = [c for c in dict.fromkeys(cuts) if c not in index]
        if new:
            self._add(new)
        return np.fromiter(map(index.__getitem__, cuts), dtype=np.int64, count=len(cuts))

    def _add(self, cuts: list[str]) -> None:
        """Lattices of new cuts, all at once: pieces by length, log masses from the ends."""
        joined = "".join(cuts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(code)
        sizes = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        ends = np.cumsum(sizes)
        end = np.repeat(ends, sizes)
        base = self.nodes
        self.index.update(zip(cuts, (base + ends - sizes).tolist()))
        at, h = np.arange(n), np.zeros(n, dtype=np.uint64)
        start, length, piece, weight = [], [], [], []
        alone = np.ones(n, dtype=bool)  # characters that are no piece by themselves
        width = 0
        while len(at):
            h = h * _CHAR + code[at + width] + np.uint64(1)
            width += 1
            slot = self._slots(h)
            known = slot >= 0
            at, h, slot = at[known], h[known], slot[known]
            is_piece = self.slot_piece[slot] >= 0
            start.append(at[is_piece])
            length.append(np.full(int(is_piece.sum()), width))
            piece.append(self.slot_piece[slot[is_piece]].astype(np.int64))
            weight.append(self.slot_weight[slot[is_piece]])
            if width == 1:
                alone[at[is_piece]] = False
            more = at + width < end[at]
            at, h = at[more], h[more]
        lone = np.flatnonzero(alone)
        spelled = []
        for i in lone.tolist():
            raw = joined[i].encode("utf-8", "surrogatepass")
            spelled.append(-1 - len(self.spelled))
            self.spelled += [len(raw), *(self.byte_ids[b] for b in raw)]
        start.append(lone)
        length.append(np.ones(len(lone), dtype=np.int64))
        piece.append(np.array(spelled, dtype=np.int64))
        weight.append(np.full(len(lone), BYTE_WEIGHT))
        start, length, piece, weight = (np.concatenate(x[::-1]) for x in (start, length, piece, weight))  # longest first
        # Arcs of the same distance from the end together: masses below them are then known.
        left = end[start] - start
        order = np.lexsort((start, left))
        start, length, piece, weight, left = (x[order] for x in (start, length, piece, weight, left))
        beta = np.zeros(n + 1)
        to = start + length
        at_end = to == end[start]
        logp = np.empty(len(start))
        new = np.flatnonzero(np.diff(start, prepend=-1))
        steps = np.flatnonzero(np.diff(left, prepend=-1))
        group_of_step = np.searchsorted(new, steps)
        bounds, groups = np.append(steps, len(start)), np.append(group_of_step, len(new))
        for k in range(len(steps)):
            lo, hi = bounds[k], bounds[k + 1]
            heads = new[groups[k] : groups[k + 1]]
            value = weight[lo:hi] + np.where(at_end[lo:hi], 0.0, beta[np.minimum(to[lo:hi], n)])
            top = np.maximum.reduceat(value, heads - lo)
            count = np.diff(np.append(heads, hi))
            mass = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), heads - lo))
            beta[start[heads]] = mass
            logp[lo:hi] = value - np.repeat(mass, count)
        order = np.argsort(start, kind="stable")
        start, to, piece, logp, at_end = start[order], to[order], piece[order], logp[order], at_end[order]
        self._room(n, len(start))
        first = np.searchsorted(start, np.arange(n + 1)) + self.arcs
        self.first[base : base + n + 1] = first
        p = np.exp(logp)
        run = np.cumsum(p)
        heads = first[:-1] - self.arcs
        count = np.diff(first)
        share = run - np.repeat(run[heads] - p[heads], count)
        last = heads + count - 1
        share /= np.repeat(share[last], count)
        share[last] = 1.0
        put = slice(self.arcs, self.arcs + len(start))
        self.share[put], self.logp[put], self.out[put] = share, np.minimum(logp, 0.0), piece
        self.next[put], self.node[put] = np.where(at_end, -1, base + to), base + start
        self.nodes, self.arcs = base + n, self.arcs + len(start)

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc of each node at which its cumulated share passes u."""
        arc = self.first[node]
        low = np.flatnonzero(u >= self.share[arc])
        while len(low):
            arc[low] += 1
            low = low[u[low] >= self.share[arc[low]]]
        return arc

    def paths(self, start: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of one sampled path from each start node, flat, and how many each has."""
        count = np.zeros(len(start), dtype=np.int64)
        live, node, steps, step = np.arange(len(start)), start, [], 0
        while len(live):
            arc = self.choose(node, _uniform(seed[live] + _times(_STEP, step)))
            steps.append((live, arc))
            count[live] += 1
            after = self.next[arc]
            go = after >= 0
            live, node, step = live[go], after[go], step + 1
        at = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(at[-1], dtype=np.int64)
        for k, (who, arc) in enumerate(steps):
            flat[at[who] + k] = arc
        return flat, count

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        out = self.out[arcs]
        if (out >= 0).all():
            return out
        parts, at = [], 0
        for i in np.flatnonzero(out < 0).tolist():
            parts.append(out[at:i])
            k = -1 - int(out[i])
            parts.append(np.array(self.spelled[k + 1 : k + 1 + self.spelled[k]], dtype=np.int64))
            at = i + 1
        parts.append(out[at:])
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        start, size = self.bytes_at[ids], self.bytes_at[ids + 1] - self.bytes_at[ids]
        ends = np.cumsum(size)
        flat = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        text = self.bytes_of[flat].tobytes().decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


# Odd constants of public integer hashes.
_STEP, _WORD, _PATH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_CHAR = np.uint64(0x100000001B3)
_workers: dict[str, _Lattices] = {}


def _state(v: Vocabulary) -> _Lattices:
    if v.key not in _workers:
        _workers.clear()
        _workers[v.key] = _Lattices(v)
    return _workers[v.key]


def _times(a: np.uint64, n: int, plus: np.uint64 | int = 0) -> np.uint64:
    """a * n + plus modulo 2^64, for single numbers."""
    return np.uint64((int(a) * n + int(plus)) % (1 << 64))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashes."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _below(location: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of the given locations, each conditioned to lie below the bound."""
    return location - np.log(np.exp(np.minimum(location - bound, 700.0)) - np.log(u))


class _Walk:
    """The search of one text: paths found so far and the sets left behind, best first."""

    def __init__(self, seed: int, samples: int):
        self.seed, self.samples = np.uint64(seed), samples
        self.heap: list[tuple] = []  # (-gumbel, path, step, arcs taken, log mass)
        self.paths: list[np.ndarray] = []
        self.logp: list[float] = []
        self.gumbel: list[float] = []

    def add(self, lat: _Lattices, arcs: np.ndarray, since: int, gumbel: float) -> None:
        """Takes a path; from step since on it left sets behind that are new."""
        logs = lat.logp[arcs]
        run = np.cumsum(logs)
        k = len(self.paths)
        self.paths.append(arcs)
        self.logp.append(float(run[-1]) if len(run) else 0.0)
        self.gumbel.append(gumbel)
        rest = -np.expm1(np.minimum(logs[since:], -1e-300))
        node = lat.node[arcs[since:]]
        open_ = np.flatnonzero((rest > 1e-15) & (lat.first[node + 1] - lat.first[node] > 1))
        if not len(open_):
            return
        step = open_ + since
        mass = run[step] - logs[step] + np.log(rest[open_])
        u = _uniform(_times(_PATH, k + 1, self.seed) + (step.astype(np.uint64) + np.uint64(1)) * _WORD)
        g = _below(mass, gumbel, u)
        need = self.samples - len(self.paths) + 1  # as many paths to come, and one for the threshold
        if len(g) > need:
            best = np.argpartition(-g, need - 1)[:need]
            step, g, mass = step[best], g[best], mass[best]
        for s, x, m in zip(step.tolist(), g.tolist(), mass.tolist()):
            heapq.heappush(self.heap, (-x, k, s, (int(arcs[s]),), m))

    def pop(self, lat: _Lattices) -> tuple[float, int, int, int] | None:
        """(gumbel, path, step, arc): the best set left, and the arc drawn from it."""
        if not self.heap:
            return None
        minus, k, step, taken, mass = heapq.heappop(self.heap)
        node = lat.node[self.paths[k][step]]
        arcs = [a for a in range(lat.first[node], lat.first[node + 1]) if a not in taken]
        p = np.exp(lat.logp[arcs])
        turn = _times(_PATH, len(self.paths) + 1)
        u = _uniform(np.array([self.seed ^ turn]))[0]
        arc = arcs[min(int(np.searchsorted(np.cumsum(p) / p.sum(), u, side="right")), len(arcs) - 1)]
        if len(arcs) > 1:  # what is still left of the set
            left = float(p.sum() - np.exp(lat.logp[arc]))
            if left > 1e-300:
                less = mass + float(np.log(left / p.sum()))
                g = _below(np.array([less]), -minus, _uniform(np.array([_times(_WORD, 1, self.seed) ^ turn])))[0]
                heapq.heappush(self.heap, (-float(g), k, step, (*taken, arc), less))
        return -minus, k, step, arc


def sample_texts(texts: list[str], seeds: np.ndarray, v: Vocabulary, samples: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to samples distinct segmentations: (ids, log probability, perturbed log
    probability, inclusion probability), largest perturbed value first."""
    lat = _state(v)
    if lat.arcs > MOST_ARCS:
        lat.clear()
    cuts = [lat.cut.findall(" " + t) if t else [] for t in texts]
    at = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
    start = lat.starts([c for own in cuts for c in own])
    del cuts
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    word_seed = seeds[doc] + (np.arange(at[-1]) - at[doc]).astype(np.uint64) * _WORD
    flat, count = lat.paths(start, word_seed + _PATH)
    ends = np.concatenate([[0], np.cumsum(count)])[at]
    walks = [_Walk(int(s), samples) for s in seeds]
    words_of = [[count[at[i] : at[i + 1]]] for i in range(len(texts))]
    for i, w in enumerate(walks):
        root = float(-np.log(-np.log(_uniform(np.array([seeds[i] ^ _STEP]))[0])))
        w.add(lat, flat[ends[i] : ends[i + 1]], 0, root)
    for r in range(1, samples):
        jobs, nodes, seed = [], [], []
        for i, w in enumerate(walks):
            got = w.pop(lat) if len(w.paths) == r else None
            if got is None:
                continue
            g, k, step, arc = got
            counts = words_of[i][k]
            word = int(np.searchsorted(np.cumsum(counts), step, side="right"))
            inside = int(lat.next[arc])
            first = at[i] + word + 1
            own = np.concatenate([[inside] if inside >= 0 else [], start[first : at[i + 1]]]).astype(np.int64)
            number = np.arange(word + (inside < 0), at[i + 1] - at[i], dtype=np.uint64)
            jobs.append((i, g, k, step, arc, word, inside >= 0, len(own)))
            nodes.append(own)
            seed.append(number * _WORD + _times(_PATH, r + 1, seeds[i]))
        if not jobs:
            break
        flat, count = lat.paths(np.concatenate(nodes), np.concatenate(seed))
        ends = np.concatenate([[0], np.cumsum(count)])
        here = 0
        for i, g, k, step, arc, word, inside, n in jobs:
            tail, counts = flat[ends[here] : ends[here + n]], count[here : here + n]
            here += n
            w, old = walks[i], words_of[i][k]
            arcs = np.concatenate([w.paths[k][:step], [arc], tail])
            own = step - int(old[:word].sum()) + 1 + (int(counts[0]) if inside else 0)
            words_of[i].append(np.concatenate([old[:word], [own], counts[1:] if inside else counts]))
            w.add(lat, arcs, step + 1, g)
    out = []
    for w in walks:
        got = w.heap[0][0] if w.heap and len(w.paths) == samples else None
        found = []
        for arcs, logp, g in zip(w.paths, w.logp, w.gumbel):
            # The (k+1)-th largest perturbed value is the threshold; without one, all are included.
            inclusion = 1.0 if got is None else float(-np.expm1(-np.exp(min(logp + got, 700.0))))
            found.append((lat.ids(arcs).astype(np.int32), logp, g, inclusion))
        out.append(found)
    return out


SAMPLES = "array<struct<ids:array<int>,logp:double,perturbed:double,inclusion:double,exact:boolean>>"


def encode_samples(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", *, samples: int = 2, seed: int = 1) -> DataFrame:
    """Adds samples: up to that many distinct segmentations of each whole text, drawn without
    replacement, seeded by the row's id. Each has ids, logp, perturbed (descending), inclusion
    (the probability of being drawn, given the threshold) and exact (ids decode to the text).

    Null or empty text: one sample without ids. A text that has fewer segmentations has fewer
    samples, with inclusion 1. Characters outside the vocabulary become byte pieces, so every
    text is restored exactly. Rows that repeat id and text get equal samples; null ids are
    seeded alike. Empty table: empty result. A column of docs named samples is replaced; others
    pass unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "samples"])
    names = plain.columns
    (key,) = unused(plain, "key")
    keyed = plain.withColumn(key, F.xxhash64(F.lit(seed), F.col(id_col).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            seeds = mix64(np.array(batch.column(key).to_pylist(), dtype=np.int64).view(np.uint64))
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_CHARS):
                    size += len(texts[hi])
                    hi += 1
                found = sample_texts(texts[lo:hi], seeds[lo:hi], v, samples)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], _nested(found, texts[lo:hi], v)], names=[*names, "samples"])
                lo = hi
        _state(v).clear()  # an idle worker keeps no lattices

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema)
    return keyed.mapInArrow(run, f"{fields}samples {SAMPLES}")


def _nested(found: list, texts: list[str], v: Vocabulary) -> pa.Array:
    flat = [s for own in found for s in own]
    lat = _state(v)
    exact = [lat.decode(s[0].astype(np.int64)) == t for own, t in zip(found, texts) for s in own]
    offsets = np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s[0] for s in flat]) if flat else np.zeros(0, np.int32), pa.int32()))
    columns = [ids, *[pa.array([s[k] for s in flat], pa.float64()) for k in (1, 2, 3)], pa.array(exact, pa.bool_())]
    rows = pa.StructArray.from_arrays(columns, ["ids", "logp", "perturbed", "inclusion", "exact"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(o) for o in found])]).astype(np.int32)), rows)


def decode_pieces(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds text_col: the text that ids_col spells. Null ids: null; no ids: empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    plain = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != text_col.lower()])
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, shared.value) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}`{text_col}` string")


def vocabulary_of(spark: SparkSession, path: str | None = None, alpha: float = 1.0) -> Vocabulary:
    """The vocabulary file that the session names in corvane.sentencepiece.model, or MODEL."""
    return Vocabulary.load(path or spark.conf.get("corvane.sentencepiece.model", MODEL), alpha)
