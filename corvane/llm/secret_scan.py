"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long tokens and the values of assignments, found in whole texts. The forest
looks at a candidate's length, its character transitions, how much of it dictionary words
cover, the path of its file and the words beside it. It is fitted on the driver from labelled
findings, a bounded table, and scores every candidate where its text lies; nothing shuffles.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.boosting import Forest, fit_random_forest

#: Labelled findings that a forest is fitted on, at most.
FIT_ROWS = 20_000
#: Characters on either side in which neighbouring words are looked for.
NEAR = 64
#: A candidate is a secret from this score on.
THRESHOLD = 0.5

# Words in the names of secrets, of what only looks like one, and common words.
SECRET_NAMES = "token secret key apikey api_key password passwd pwd passphrase auth bearer credential credentials access private signature client_secret connection".split()
OTHER_NAMES = "sha sha1 sha256 md5 hash checksum digest commit revision uuid guid etag version example sample dummy placeholder test fixture todo integrity url path file color id".split()
DICTIONARY = "about account action address admin after again all and another any app application are array auth base been before between body build button cache call can change changeme check class client code color column command common config connection container content context control count create custom data database date default delete demo description development device digital document domain down email enable end engine error event example export false field file filter final find first font foo for format from function general get global group handler have header height hello her high home host http https image import index info input inner insert integer item join key label language last layer left length level library license line link list local location log login long main make manager map match max member menu message method model module more name network new next node none not null number object only open option order other output page panel parameter parent part pass password path pattern place placeholder point port position post prefix print private process product profile project property public query random range read record reference release remove request resource response result return right role root row run sample save schema script search section select sequence server service session set shared simple size small some source standard start state static status step stop storage store string style subject summary support switch system table target task template test text that the their then there this time title token tool total tree true type under undefined update url use user username value variable version view was web when where which width window with word work would write your".split()
TEST_PATHS = re.compile(r"(?:^|[/_.-])(?:test|tests|spec|fixture|fixtures|example|examples|sample|samples|doc|docs|mock|demo)(?:[/_.-]|$)", re.I)

_ASSIGNED = re.compile(r"(?::=|=>|[:=])[ \t]{0,3}([\"'`]?)([A-Za-z0-9+/_.~!@#$%^&*-]{8,}+={0,2})")
_NAME = re.compile(r"([A-Za-z_][\w.-]{0,39})[\"']?[ \t]{0,3}$")
# A signed or encrypted web token with its dots, or a run of key characters.
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:eyJ[A-Za-z0-9_-]{17,}+(?:\.[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]++){3}|(?:\.[A-Za-z0-9_-]++){2})|[A-Za-z0-9+/_-]{20,}+={0,2})")
_KEY_LINE = re.compile(r"-----(BEGIN|END) ([A-Z ]{0,20})PRIVATE KEY-----")
# What can follow a BEGIN line that has no END: full lines of base64, then a last one of any length.
_KEY_BODY = re.compile(r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{40,}+={0,2})++(?:(?:\s|\\[nr])++[A-Za-z0-9+/]++={0,2}(?=[\r\n\\\"'`]|\Z))?+")
_WORDS = re.compile(r"[a-z_][a-z0-9_]*")
_LETTERS = re.compile(r"[a-z]{3,}")


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each private key from its BEGIN to its END line. Without an END of its
    type before the next BEGIN, the base64 that follows belongs to it."""
    begun = None

    def unended(b: re.Match, upto: int) -> tuple[int, int]:
        body = _KEY_BODY.match(text, b.end(), upto)
        return b.start(), body.end() if body else b.end()

    for m in _KEY_LINE.finditer(text):
        if m.group(1) == "BEGIN":
            if begun:
                yield unended(begun, m.start())
            begun = m
        elif begun and m.group(2) == begun.group(2):
            yield begun.start(), m.end()
            begun = None
    if begun:
        yield unended(begun, len(text))


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, rule) of each candidate of a text, in order and whole, of any length; key
    blocks come first where rules overlap, then assigned values."""
    at = 0
    for start, end in key_blocks(text):
        yield from _tokens(text, at, start)
        yield start, end, "key_block"
        at = end
    yield from _tokens(text, at, len(text))


def _tokens(text: str, at: int, upto: int) -> Iterator[tuple[int, int, str]]:
    taken_to = -1
    found = []
    for m in _ASSIGNED.finditer(text, at, upto):
        if m.group(1) or _NAME.search(text, max(0, m.start() - 44), m.start()):
            found.append((m.start(2), m.end(2), "assigned"))
    for m in _BARE.finditer(text, at, upto):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            found.append((m.start(), m.end(), "bare"))
    for start, end, rule in sorted(found, key=lambda x: (x[0], x[2])):
        if start >= taken_to:
            taken_to = end
            yield start, end, rule


@dataclass
class SecretModel:
    forest: Forest
    transitions: np.ndarray
    dictionary: frozenset[str]

    def scores(self, rows: list[tuple[str, str, str, str]]) -> np.ndarray:
        """Probabilities of (value, before, after, path) rows."""
        if not rows:
            return np.zeros(0)
        x = np.array([features(*r, self.transitions, self.dictionary) for r in rows])
        return self.forest.margins(x)


_CLASS = np.full(128, 37)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i
for _i in range(10):
    _CLASS[48 + _i] = 26 + _i
_CLASS[[45, 95, 46, 47]] = 36


def _classes(value: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(value.encode("ascii", "replace"), dtype=np.uint8), 127)]


def fit_transitions(words: list[str]) -> np.ndarray:
    """Log probabilities of a character after another in ordinary words, add-one smoothed."""
    counts = np.ones((38, 38))
    for w in words:
        c = _classes(w)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _covered(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that dictionary words of 3 letters or more cover."""
    low, covered, i = value.lower(), 0, 0
    while i < len(low):
        for n in range(min(14, len(low) - i), 2, -1):
            if low[i : i + n] in dictionary:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(1, len(value))


def features(value: str, before: str, after: str, path: str, transitions: np.ndarray, dictionary: frozenset[str]) -> list[float]:
    n = max(1, len(value))
    c = _classes(value)
    steps = transitions[c[:-1], c[1:]] if n > 1 else np.zeros(1)
    counts = np.unique(c, return_counts=True)[1] / n
    upper, lower, digit = (sum(map(f, value)) / n for f in (str.isupper, str.islower, str.isdigit))
    kinds = np.select([c < 26, c < 36], [0, 1], 2)
    left, right = _WORDS.findall(before.lower()), _WORDS.findall(after.lower())
    close = left[-3:]
    return [
        float(len(value)), float(steps.mean()), float(steps.min()), float(-(counts * np.log2(counts)).sum()), float(len(counts)),
        upper, lower, digit, float((kinds[1:] != kinds[:-1]).sum() / n), _covered(value, dictionary),
        float(max((len(x) for x in _LETTERS.findall(value.lower())), default=0)), float(all(x in "0123456789abcdefABCDEF" for x in value)),
        float(value.count("-") + value.count("_") + value.count("/") + value.count(".")), float(len(set(value)) / n),
        float(any(any(k in w for k in SECRET_NAMES) for w in close)), float(any(w in OTHER_NAMES for w in close)),
        float(any(w in SECRET_NAMES for w in left)), float(any(w in OTHER_NAMES for w in left + right[:4])),
        float(before.rstrip(" \t\"'`")[-1:] in ("=", ":", ">")), float(before[-1:] in "\"'`" and before[-1:] == after[:1] and bool(before)),
        float(TEST_PATHS.search(path) is not None), float(path.lower().endswith((".md", ".txt", ".lock", ".sum", ".svg", ".min.js"))),
    ]


def default_findings(rows: int = 6000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, label) where a caller has none: random keys
    in the contexts of keys, and digests, ids, paths, placeholders and words in theirs."""
    r = random.Random(seed)
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def some(letters: str, low: int, high: int) -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(low, high)))

    def prose() -> str:
        return " ".join(some("aeinorsthld", 2, 9) if r.random() < 0.7 else r.choice(DICTIONARY) for _ in range(r.randint(0, 6)))

    out = []
    for _ in range(rows):
        label = int(r.random() < 0.5)
        if label:
            value = r.choice([lambda: some(hexa, 32, 64), lambda: some(b64, 20, 64), lambda: some(b64 + "+/", 40, 88), lambda: r.choice(["AKIA", "ASIA"]) + some(b64[:26] + "0123456789", 16, 16), lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + some(b64, 20, 40), lambda: some(b64 + "!#$%&*", 12, 24)])()
            name = r.choice(SECRET_NAMES)
            if r.random() < 0.4:
                name = r.choice(["my_", "db_", "app_", "aws_", "GITHUB_", "X-"]) + name
            quote = r.choice(['"', "'", "", '"'])
            before, after = f"{prose()} {name}{r.choice([' = ', '=', ': ', ' := '])}{quote}", quote + r.choice([" ", "\n", ";", ","]) + prose()
            path = r.choice(["src/config.py", "app/settings.yaml", "deploy/.env", "src0", "lib/client.js", ""])
        else:
            kind = r.randrange(6)
            if kind == 0:
                value, name = some(hexa, 40, 40) if r.random() < 0.5 else some(hexa, 64, 64), r.choice(["commit", "sha256", "revision", "checksum", "digest", "etag"])
            elif kind == 1:
                h = some(hexa, 32, 32)
                value, name = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), r.choice(["id", "uuid", "guid", "file"])
            elif kind == 2:
                value, name = r.choice(["_", "-", "/", ""]).join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + r.choice(["", "1", "2024"]), r.choice(["path", "name", "url", "version", "token", "password"])
            elif kind == 3:
                value, name = r.choice(["x" * r.randint(8, 40), "your_" + r.choice(SECRET_NAMES) + "_here", "changeme123", "1234567890" * r.randint(1, 4), "example_" + r.choice(DICTIONARY) + "_key", "0" * r.randint(16, 40)]), r.choice(SECRET_NAMES)
            elif kind == 4:
                value, name = "/".join(some("abcdefghijklmnoprstuvw", 3, 9) for _ in range(r.randint(3, 6))) + f"/v{r.randint(1, 9)}", r.choice(["url", "path", "file", "import"])
            else:
                value, name = some("aeinorsthld", 20, 34) + str(r.randint(0, 99)), prose()
            before = f"{prose()} {name}{r.choice([' = ', ': ', ' ', '='])}" + r.choice(["", '"'])
            after, path = r.choice([" ", "\n", '" ']) + prose(), r.choice(["tests/fixtures/data.py", "docs/readme.md", "package.lock", "src/main.go", "src3", ""])
        out.append((value, before[-NEAR:], after[:NEAR], path, label))
    return out


def fit_secret_model(findings: list[tuple[str, str, str, str, int]] | DataFrame | None = None, *, most_rows: int = FIT_ROWS, dictionary: list[str] | None = None) -> SecretModel:
    """A forest from labelled findings (value, before, after, path, label: 1 is a secret).

    Of a DataFrame of more than most_rows rows those of smallest hash are taken; nulls count as
    empty. Without findings, default_findings() are used."""
    if isinstance(findings, DataFrame):
        names = ["value", "before", "after", "path"]
        of = findings.where("value IS NOT NULL AND label IS NOT NULL").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names], F.col("label").cast("int"))
        findings = [tuple(x) for x in of.orderBy(F.xxhash64(*names), *names, "label").limit(most_rows).collect()]
    rows = default_findings() if findings is None else findings
    words = frozenset(dictionary or DICTIONARY)
    transitions = fit_transitions(sorted(words) + [r[0] for r in rows if not r[4] and r[0].isalpha()])
    x = np.array([features(*r[:4], transitions, words) for r in rows]) if rows else np.zeros((0, 22))
    return SecretModel(fit_random_forest(x, np.array([r[4] for r in rows], dtype=float)), transitions, words)


def scan_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", *, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate of every text: doc_id, start and end (code points), rule, value_sha256,
    score, is_secret (score >= threshold). Values themselves are not returned; a value is the
    whole token, a private key its block from BEGIN to END.

    Null or empty text has no candidates; a null path counts as empty; rows that repeat are
    each scanned; null ids pass. Empty table: empty result. Other columns are not read.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
    names = ["doc_id", "start", "end", "rule", "value_sha256", "score", "is_secret"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, seen = [], []
            for doc, text, where in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("path").to_pylist()):
                text = text.as_py()
                for start, end, rule in candidates(text):
                    value = text[start:end]
                    found.append((doc, start, end, rule, hashlib.sha256(value.encode()).hexdigest()))
                    seen.append((value, text[max(0, start - NEAR) : start], text[end : end + NEAR], where))
            score = model.scores(seen)
            for i, k in enumerate(found):  # a private key block needs no second opinion
                if k[3] == "key_block":
                    score[i] = 1.0
            columns = list(zip(*found)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip([*columns, score.tolist(), (score >= threshold).tolist()], types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, "doc_id long, start long, end long, rule string, value_sha256 string, score double, is_secret boolean")
