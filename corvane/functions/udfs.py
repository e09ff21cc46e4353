"""Rules that are sequential or algorithmic, as vectorised functions over Arrow batches."""

from __future__ import annotations

import base64
import binascii
import difflib
import hashlib
import html
import io
import json
import math
import re
import urllib.parse
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SENTENCE_END = re.compile(r"(?<=[.!?。！？；;])\s+|\n+")
MARKER = "\n...[context truncated by token budget]"
HITS_PER_TOKEN = 50
LEAD_CHARS = 80
PROTECTED = re.compile(r"\$\$.*?\$\$|\\\(.*?\\\)|\\\[.*?\\\]|\$[^$\n]{1,200}\$|https?://\S+|doi:\s*\S+|10\.\d{4,9}/\S+", re.S)
WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def edit_distance(a, b) -> int:
    """Levenshtein over any two sequences (I24), a row of the table at a time."""
    number = {x: i for i, x in enumerate(dict.fromkeys((*a, *b)))}
    q = np.array([number[x] for x in b], dtype=np.int64)
    at = np.arange(len(q) + 1)
    row = at
    for i, x in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (q != number[x]), out=best[1:])
        row = np.minimum.accumulate(best - at) + at  # insertions run along the row
    return int(row[-1])


def word_error(prediction: str | None, truth: str | None) -> float:
    p, t = (prediction or "").lower().split(), (truth or "").lower().split()
    return edit_distance(p, t) / len(t) if t else float(bool(p))


@F.pandas_udf(T.DoubleType())
def word_error_rate(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    """Word-level edit distance over the words of the truth."""
    return pd.Series([word_error(p, t) for p, t in zip(prediction, truth)])


def normal_title(title: Column) -> Column:
    """As title_ratio reads a title."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def title_ratio(left: str | None, right: str | None) -> float:
    a, b = (re.sub(r"[^a-z0-9]+", " ", (x or "").lower()).strip() for x in (left, right))
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def title_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of normalised titles."""
    return pd.Series([title_ratio(a, b) for a, b in zip(left, right)])


#: Columns that pairs of characters are counted in, and rows compared at once.
PAIR_COLUMNS, ROWS_AT_ONCE = 512, 256


def common_lengths(key: str, codes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a title of 64 characters at most and each row of
    codes (characters, 0 where a title has ended), all rows at once: one bit for each character of
    the key, cleared where it is matched."""
    masks = np.zeros(128, dtype=np.uint64)
    for i, c in enumerate(key.encode("ascii", "replace")):
        masks[c & 127] |= np.uint64(1 << i)
    v = np.full(len(codes), np.uint64(2**64 - 1))
    for column in codes.T:
        m = v & masks[column]
        v = (v + m) | (v - m)
    return len(key) - np.bitwise_count(v & np.uint64((1 << len(key)) - 1)).astype(np.int64) if len(key) else np.zeros(len(codes), dtype=np.int64)


def pair_counts(titles: list[str]) -> np.ndarray:
    """How often each title holds each pair of neighbouring characters; pairs may share a column."""
    out = np.zeros((len(titles), PAIR_COLUMNS), dtype=np.float32)
    for i, x in enumerate(titles):
        c = np.frombuffer(x.encode("ascii", "replace"), dtype=np.uint8).astype(np.int64)
        out[i] = np.bincount((c[:-1] * 37 + c[1:]) % PAIR_COLUMNS, minlength=PAIR_COLUMNS)
    return out


def similar_titles(keys: list[str], known: list[str], floor: float) -> tuple[list[int], list[int], list[float]]:
    """Places (i, j) of normalised titles whose ratio is floor at least, and that ratio.

    M characters matched of S in both titles lie in at most S - 2M + 1 blocks, as between two
    blocks one title holds a character more; so the titles share at least 3M - S - 1 pairs of
    neighbours, and the product of their counts is no less. The blocks are a common subsequence.
    Pairs of titles that either bound tells apart are not compared."""
    found: tuple[list[int], list[int], list[float]] = ([], [], [])
    if not keys or not known:
        return found
    a, b = pair_counts(keys), pair_counts(known)
    na, nb = (np.array([len(x) for x in t], dtype=np.float64) for t in (keys, known))
    codes = np.zeros((len(known), int(nb.max())), dtype=np.uint8)
    for j, x in enumerate(known):
        codes[j, : len(x)] = np.frombuffer(x.encode("ascii", "replace"), dtype=np.uint8)
    for at in range(0, len(keys), ROWS_AT_ONCE):
        size = na[at : at + ROWS_AT_ONCE, None] + nb[None, :]
        may = a[at : at + ROWS_AT_ONCE] @ b.T >= (1.5 * floor - 1) * size - 1 - 1e-6
        for i, row in enumerate(may, at):
            some = np.flatnonzero(row)
            if len(some) and len(keys[i]) <= 64:
                some = some[2 * common_lengths(keys[i], codes[some]) >= (floor - 1e-9) * (na[i] + nb[some])]
            for j in some.tolist():
                s = title_ratio(keys[i], known[j])
                if s >= floor:
                    for place, value in zip(found, (i, j, s)):
                        place.append(value)
    return found


def estimate(text: str) -> int:
    cjk = sum("一" <= c <= "鿿" for c in text)
    return int(1.5 * cjk + 0.35 * (len(text) - cjk))


def estimate_exact(text: str) -> int:
    """estimate in twentieths: no token is lost where 0.35 a character is a whole number."""
    cjk = sum("一" <= c <= "鿿" for c in text)
    return (30 * cjk + 7 * (len(text) - cjk)) // 20


def cut_to_budget(text: str | None, budget: int, estimate=estimate) -> str:
    """The longest prefix with a marker whose estimate is within the budget."""
    text = text or ""
    if budget <= 0:
        return ""
    if estimate(text) <= budget:
        return text
    mark = MARKER if estimate(MARKER) < budget else ""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if estimate(text[:mid] + mark) <= budget else (low, mid - 1)
    return text[:low] + mark


@F.pandas_udf(T.StringType())
def truncate_to_budget(text: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([cut_to_budget(t, int(b)) for t, b in zip(text, budget)])


@F.pandas_udf(T.StringType())
def truncate_to_exact_budget(text: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([cut_to_budget(t, int(b), estimate_exact) for t, b in zip(text, budget)])


def densest_window(text: str | None, tokens, size: int) -> str:
    """The window of size characters that holds most hits; it starts 80 before one of them."""
    body = (text or "").strip()
    if len(body) <= size:
        return body
    low, places = body.lower(), []
    for token in tokens if tokens is not None else ():
        at = low.find(token) if token else -1
        for _ in range(HITS_PER_TOKEN):
            if at < 0:
                break
            places.append(at)
            at = low.find(token, at + len(token))
    if not places:
        return body[:size].strip()
    places.sort()
    starts = [max(0, p - LEAD_CHARS) for p in places]
    counts = [sum(s <= p < s + size for p in places) for s in starts]
    best = starts[counts.index(max(counts))]
    return body[best : best + size].strip()


def snippet(size: int = 3000):
    @F.pandas_udf(T.StringType())
    def of(text: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([densest_window(a, b, size) for a, b in zip(text, tokens)])

    return of


def pack_sentences(text: str | None, most: int) -> list[str]:
    """A text within the limit as it is; else sentences joined by a space into pieces of at most
    that many characters. Longer sentences are cut, and their pieces stay alone (F15)."""
    whole = (text or "").strip()
    if len(whole) <= most:
        return [whole] if whole else []
    out, now = [], ""
    for s in (x.strip() for x in SENTENCE_END.split(whole)):
        if now and (len(s) > most or len(now) + 1 + len(s) > most):
            out.append(now)
            now = ""
        if len(s) > most:
            out += [s[i : i + most] for i in range(0, len(s), most)]
        elif s:
            now = f"{now} {s}" if now else s
    return [*out, now] if now else out


def split_long_text(most: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([pack_sentences(t, most) for t in text])

    return of


def pack_batches(sizes: list[int], most_items: int = 4, most_chars: int = 1800) -> list[int]:
    """Batch number of each item in order (F16)."""
    out, batch, items, chars = [], 0, 0, 0
    for n in sizes:
        if items and (items >= most_items or chars + n > most_chars):
            batch, items, chars = batch + 1, 0, 0
        out.append(batch)
        items, chars = items + 1, chars + n
    return out


def plain_text(raw: str | None) -> str:
    """Line breaks for br and closing p, div, li, h1 to h6 and tr, bullets for items, no tags (what
    is in scripts stays), entities decoded, no control characters (I57)."""
    s = re.sub(r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>", "\n", raw or "")
    s = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<li[^>]*>", "• ", s)))
    s = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\u3000]+", " ", s))
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s).strip()


@F.pandas_udf(T.StringType())
def html_to_text(raw: pd.Series) -> pd.Series:
    return raw.map(plain_text)


def json_blob(text: str | None) -> str:
    """The first balanced object or array, brackets in strings apart."""
    text = text or ""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return ""
    depth, quoted, escaped = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth.append("}" if c == "{" else "]")
        elif c in "}]":
            if not depth or depth.pop() != c:
                return ""
            if not depth:
                return text[start : i + 1]
    return ""


def json_reply(text: str | None) -> str | None:
    """The first of the text, the text without its fence, and the blob in it that parses (I64)."""
    raw = (text or "").strip()
    bare = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", raw)
    for x in (raw, bare, json_blob(bare)):
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def parse_json_reply(text: pd.Series) -> pd.Series:
    return text.map(json_reply)


def protect(text: str | None) -> tuple[str, dict[str, str]]:
    """Formulas, addresses and DOIs replaced by numbered marks, and what they stand for."""
    found: dict[str, str] = {}

    def mark(m) -> str:
        key = f"[[P{len(found)}]]"
        found[key] = m.group()
        return key

    return PROTECTED.sub(mark, text or ""), found


def restore(text: str, found: dict[str, str]) -> str:
    for k, v in found.items():
        text = text.replace(k, v)
    return text


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.MapType(T.StringType(), T.StringType()))]))
def protect_spans(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([protect(t) for t in text], columns=["text", "spans"])


def hash_vector(text: str | None, dim: int = 32) -> list[float]:
    """Signed counts of hashed words, to length 1, six decimals."""
    dim = max(4, dim)
    v = [0.0] * dim
    for w in (text or "").split():
        d = hashlib.sha256(w.encode()).digest()
        v[int.from_bytes(d[:4], "big") % dim] += 1.0 if d[4] % 2 == 0 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [round(x / n, 6) for x in v] if n else v


def hash_embedding(dim: int = 32):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([hash_vector(t, dim) for t in text])

    return of


def docx_text(data: bytes | None) -> str:
    """Paragraphs of a word document, then of its headers, footers and notes."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data or b""))
    except zipfile.BadZipFile:
        return ""
    names = [n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", n)]
    parts = []
    for name in sorted(names, key=lambda n: (n != "word/document.xml", n)):
        try:
            root = ElementTree.fromstring(z.read(name))
        except ElementTree.ParseError:
            continue
        tag = {f"{WORD_XML}t": lambda e: e.text or "", f"{WORD_XML}tab": lambda e: "\t", f"{WORD_XML}br": lambda e: "\n"}
        lines = ["".join(tag[e.tag](e) for e in p.iter() if e.tag in tag) for p in root.iter(f"{WORD_XML}p")]
        text = "\n".join(x for x in lines if x.strip())
        if text:
            parts.append(text)
    return "\n\n".join(parts)


def data_url_text(url: str | None) -> str:
    """Text of a data address: base64 or percent payload, several encodings; binary is empty."""
    m = re.match(r"data:([^;,]*)((?:;[^,]*)?),(.*)", url or "", re.S)
    if not m:
        return ""
    kind, more, payload = m.groups()
    try:
        data = base64.b64decode(payload) if "base64" in more else urllib.parse.unquote_to_bytes(payload)
    except (binascii.Error, ValueError):
        return ""
    if "wordprocessingml" in kind:
        return docx_text(data)
    if kind == "application/msword":
        return ""
    if not (kind == "" or kind.startswith("text/") or re.search("json|xml|csv|markdown", kind)):
        head = data[:2048].decode("latin-1")
        if kind != "application/octet-stream" or sum(c.isprintable() or c in "\r\n\t" for c in head) < 0.8 * max(1, len(head)):
            return ""
    for code in ("utf-8", "utf-16", "big5", "latin-1"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return ""


@F.pandas_udf(T.StringType())
def decode_data_url(url: pd.Series) -> pd.Series:
    return url.map(data_url_text)


def stub_reply(prompt: str | None) -> str:
    """A fixed answer that names the prompt's length and its turns."""
    p = prompt or ""
    return json.dumps({"text": f"stub reply: {len(p)} chars, {len(re.findall(r'(?m)^User:', p))} turns", "input_tokens": len(p) // 4, "output_tokens": 16})


@F.pandas_udf(T.StringType())
def stub_model(prompt: pd.Series) -> pd.Series:
    return prompt.map(stub_reply)
