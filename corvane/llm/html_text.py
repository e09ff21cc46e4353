"""HTML extraction: main text from the slots of wrappers that are inferred for each host.

1. Every page becomes a tree of containers and text slots; the distinct trees of a host are
   aligned one after another into a wrapper with optional and repeated groups (html_tree).
2. Every page is laid on its host's wrapper. What its slots hold is counted over all pages of
   the host: characters, characters in links, and on how many pages each line is found.
3. From these each slot gets a role. Furniture: named so by elements or classes. Template: lines
   that nearly all pages repeat in one slot. Menu: slots of links on nearly every page. Content:
   the rest, below article or main, or else below the container that holds most of the rest.
4. A page's text is that of its content slots.

Trees, wrappers and counts are small next to the pages, and pages themselves are never shuffled
unless the wrappers are too large to broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shuffle_partitions, unused, without
from corvane.llm.html_tree import align, dump, in_main, is_furniture, is_own, line_text, load, match, parse, slot_paths

#: Bytes of all wrappers up to which they are broadcast; beyond that, pages are joined by host.
BROADCAST_BYTES = 32 << 20
#: Pages of a slot from which on a repeated line or a menu can tell that it is template.
LEAST_PAGES = 3
#: Share of a slot's pages that hold a template line; of a host's pages that hold a menu.
NEARLY_ALL = 0.9
#: Share of the text that the container of the main text holds, where no article or main does.
MOST_TEXT = 0.8
#: Containers that can hold the main text where no article or main does.
REGIONS = frozenset("body center details div html section table td tr".split())
HOST_SALTS = 32


def _key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _kept(signs: tuple[str, ...], heading: bool) -> bool:
    """Whether a line can't be template: in an article, a heading, below nothing that has a name of
    its own, or below a name that parts of articles have."""
    last = max((i for i, s in enumerate(signs) if s in ("article", "main")), default=None)
    return last is not None and (heading or is_own(signs) or all("." not in s for s in signs[last:]))


@lru_cache(maxsize=1024)
def _wrapper(text: str):
    nodes = load(text)
    paths = slot_paths(nodes)
    return nodes, {id(x): i for i, (x, _, _) in enumerate(paths)}, [(at, signs) for _, at, signs in paths]


@lru_cache(maxsize=1024)
def _rules(text: str):
    r = json.loads(text)
    return r["wrapper"], frozenset(r["main"]), frozenset(r["rest"]), frozenset(map(tuple, r["lines"]))


def slots_of(source: str, wrapper: str) -> tuple[list[tuple[int, list]], list[tuple[int, tuple[str, ...]]]]:
    """A page laid on a wrapper: (slot, lines) in order of the wrapper, and for slots without a
    place there (slot -1) the signs of the page's own elements."""
    tree = parse(source)
    nodes, number, _ = _wrapper(wrapper)
    found = match(nodes, tree)
    own = {id(x): signs for x, _, signs in slot_paths(tree)} if any(w is None for _, w in found) else {}
    laid = [(number[id(w)] if w is not None else -1, p.lines) for p, w in found]
    return laid, [(k, own[id(p)]) for k, (p, w) in enumerate(found) if w is None]


def infer_wrapper(shapes: list[str]) -> str:
    """The alignment of trees, each as dump() writes it."""
    wrapper = load(shapes[0])
    for shape in shapes[1:]:
        wrapper = align(wrapper, load(shape))
    return dump(wrapper)


def page_counts(source: str, wrapper: str) -> Iterator[tuple[int, int | None, int, int, int]]:
    """(slot, line, characters, characters in links, lines): one row without a line for each slot
    of a page, one for the page itself (slot -1), one for each distinct line of a slot that may
    hold template, and one for the page's lines as a whole (slot -1 again)."""
    paths = _wrapper(wrapper)[2]
    total: dict[int, list] = {-1: [0, 0, 0]}
    seen: dict[tuple[int, int], int] = {}
    whole = xxhash.xxh3_64()
    for slot, lines in slots_of(source, wrapper)[0]:
        if slot < 0:
            continue
        of = total.setdefault(slot, [0, 0, 0])
        for _, raw, links, heading in lines:
            if text := line_text(raw):
                of[0] += len(text)
                of[1] += min(links, len(text))
                of[2] += 1
                whole.update(text.encode("utf-8", "surrogatepass") + b"\n")
                if not _kept(paths[slot][1], heading):
                    seen[slot, _key(text)] = len(text)
    seen[-1, whole.intdigest() - (1 << 63)] = 0
    for slot, of in total.items():
        yield slot, None, *of
    for (slot, key), chars in seen.items():
        yield slot, key, chars, 0, 0


def judge_slots(wrapper: str, counts: dict[int, tuple[int, int, int, int]], repeated: list[tuple[int, int, int, int]]) -> str:
    """Roles of a wrapper's slots as JSON. counts: pages, characters, characters in links and
    lines by slot; repeated: (slot, line, characters) of lines on nearly all of a slot's pages.
    Where nearly all pages are copies of one, nothing sets template apart and no line is."""
    if any(s < 0 for s, *_ in repeated):
        repeated = []
    paths = _wrapper(wrapper)[2]
    pages = counts.get(-1, (0,) * 4)[0]
    empty = (0, 0, 0, 0)
    fixed: dict[int, int] = {}
    for s, _, chars in repeated:
        fixed[s] = fixed.get(s, 0) + chars
    menu = {s for s, (n, chars, links, lines) in counts.items() if s >= 0 and n >= max(LEAST_PAGES, NEARLY_ALL * pages) and links >= NEARLY_ALL * chars > 0 and lines >= 3 * n and paths[s][1] and paths[s][1][-1] not in ("article", "main")}
    # A list of links in an article is a menu only if pages have its links in common.
    menu = {s for s in menu if not in_main(paths[s][1]) or not is_own(paths[s][1]) and 2 * fixed.get(s, 0) * counts[s][0] >= counts[s][1]}
    able = [s for s in range(len(paths)) if s not in menu and not is_furniture(paths[s][1])]
    mass = {s: max(0, counts.get(s, empty)[1] - counts.get(s, empty)[2] - fixed.get(s, 0)) for s in able}
    rest = [s for s in able if not in_main(paths[s][1])]
    whole, names = sum(mass[s] for s in rest), _names(wrapper)
    below: dict[tuple[int, ...], int] = {}
    for s in rest:
        at = paths[s][0]
        for d in range(1, len(at) + 1):
            below[at[:d]] = below.get(at[:d], 0) + mass[s]
    region = max((at for at, held in below.items() if held >= MOST_TEXT * whole > 0 and names[at].partition(".")[0] in REGIONS), key=len, default=())
    return json.dumps({"wrapper": wrapper, "main": [s for s in able if in_main(paths[s][1])], "rest": [s for s in rest if paths[s][0][: len(region)] == region], "lines": [(s, key) for s, key, _ in repeated]}, ensure_ascii=False)


def _names(wrapper: str) -> dict[tuple[int, ...], str]:
    out: dict[tuple[int, ...], str] = {}

    def walk(nodes: list, at: tuple[int, ...]) -> None:
        for i, x in enumerate(nodes):
            out[(*at, i)] = x.sign
            walk(x.kids, (*at, i))

    walk(_wrapper(wrapper)[0], ())
    return out


def main_text(source: str, rules: str) -> tuple[str, bool]:
    """Blocks of the main text joined by newlines; whether the page fits its host's wrapper."""
    wrapper, main, rest, template = _rules(rules)
    paths = _wrapper(wrapper)[2]
    laid, strange = slots_of(source, wrapper)
    own = dict(strange)
    has_main = any(in_main(own[k]) if s < 0 else in_main(paths[s][1]) for k, (s, _) in enumerate(laid))
    blocks: dict[int, list[str]] = {}
    for k, (slot, lines) in enumerate(laid):
        if slot < 0:  # no place in the wrapper: the page's own names decide
            if is_furniture(own[k]) or has_main and not in_main(own[k]):
                continue
        elif slot not in (main if has_main else rest):
            continue
        for block, raw, _, heading in lines:
            if not template or heading and slot >= 0 and _kept(paths[slot][1], True) or (slot, _key(line_text(raw))) not in template:
                blocks.setdefault(block, []).append(raw)
    found = (line_text("".join(parts)) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in found if x), not strange


def rules_of(sources: list[str]) -> str:
    """Wrapper and roles of the slots of some pages of one host: the job's steps on a list."""
    wrapper = infer_wrapper(sorted({dump(parse(s)) for s in sources}))
    counts: dict[int, list[int]] = {}
    on: dict[tuple[int, int], list[int]] = {}
    for s in sources:
        for slot, key, *of in page_counts(s, wrapper):
            if key is None:
                counts[slot] = [x + y for x, y in zip(counts.get(slot, [0] * 4), (1, *of))]
            else:
                on[slot, key] = [x + y for x, y in zip(on.get((slot, key), [0] * 2), (1, of[0]))]
    repeated = [(s, key, chars) for (s, key), (n, chars) in sorted(on.items()) if n >= max(LEAST_PAGES, NEARLY_ALL * counts[s][0])]
    return judge_slots(wrapper, {s: tuple(x) for s, x in counts.items()}, repeated)


def _by_host(df: DataFrame, host: str, of: DataFrame, columns: list[str], broadcast_bytes: int) -> DataFrame:
    """df with columns of its host's row of `of` (h, *columns); a host's rows are dealt over
    several keys where `of` is too large to broadcast."""
    size = of.agg(F.sum(sum((F.octet_length(c) for c in columns), F.octet_length("h")))).first()[0] or 0
    if size <= broadcast_bytes:
        return df.join(F.broadcast(of), F.col(host) == F.col("h"), "left").drop("h")
    at, salt = unused(df, "at", "salt")
    dealt = df.withColumn(salt, F.floor(F.rand(3) * HOST_SALTS).cast("int"))
    spread = of.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))))
    return dealt.join(spread, (F.col(host) == F.col("h")) & (F.col(salt) == F.col(at)), "left").drop("h", at, salt)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = dict.fromkeys((h, dump(parse(s or ""))) for h, s in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["host", "shape"])


def _infer(table: pa.Table) -> pa.Table:
    return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "shape": pa.array([infer_wrapper(sorted(table.column("shape").to_pylist()))], pa.string())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "slot", "line", "chars", "links", "lines"]
    types = [pa.string(), *[pa.int64()] * 5]
    for batch in batches:
        found = [(h, *x) for h, s, w in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))) for x in page_counts(s or "", w)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 6, types)], names=names)


def _judge(counts: pa.Table, wrappers: pa.Table) -> pa.Table:
    rows = list(zip(*(counts.column(c).to_pylist() for c in ("slot", "line", "pages", "chars", "links", "lines"))))
    by_slot = {s: (n, *of) for s, line, n, *of in rows if line is None}
    repeated = sorted((s, line, chars) for s, line, _, chars, *_ in rows if line is not None)
    host, wrapper = (wrappers.column(c)[0].as_py() for c in ("h", "wrapper"))
    return pa.table({"h": pa.array([host], pa.string()), "rules": pa.array([judge_slots(wrapper, by_slot, repeated)], pa.string())})


def host_rules(pages: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(h, rules) of each host of pages (host, html), from all its pages."""
    p = shuffle_partitions(pages.sparkSession)
    shapes = materialize(pages.mapInArrow(_shapes, "host string, shape string").distinct(), "html-shapes")
    part = F.pmod(F.xxhash64("shape"), F.lit(p)).cast("int")
    parts = shapes.withColumn("part", part).groupBy("host", "part").applyInArrow(_infer, "host string, shape string")
    wrappers = parts.groupBy("host").applyInArrow(_infer, "host string, shape string")
    wrappers = materialize(wrappers.select(F.col("host").alias("h"), F.col("shape").alias("wrapper")), "html-wrappers")

    seen = _by_host(pages, "host", wrappers, ["wrapper"], broadcast_bytes).mapInArrow(_count, "host string, slot long, line long, chars long, links long, lines long")
    sums = [F.sum(c).alias(c) for c in ("chars", "links", "lines")]
    seen = materialize(seen.groupBy("host", "slot", "line").agg(F.count(F.lit(1)).alias("pages"), *sums).where(F.col("line").isNull() | (F.col("pages") >= LEAST_PAGES)), "html-counts")
    slots = seen.where("line IS NULL")
    # Lines of one slot of a large host are many: they meet its page count under several keys.
    salt = F.pmod("line", F.lit(HOST_SALTS))
    of = slots.select(F.col("host").alias("sh"), F.col("slot").alias("ss"), F.col("pages").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))).alias("at"))
    lines = seen.where("line IS NOT NULL").join(of, (F.col("host") == F.col("sh")) & (F.col("slot") == F.col("ss")) & (salt == F.col("at")))
    lines = lines.where(F.col("pages") >= NEARLY_ALL * F.col("of")).select(slots.columns)
    found = slots.unionAll(lines).groupBy("host").cogroup(wrappers.groupBy("h")).applyInArrow(_judge, "h string, rules string")
    return materialize(found, "html-rules")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The main text of every page, from the slots of wrappers inferred for each host.

    Left out: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup and reader comments; where a page has article or main elements, all outside them; what
    nearly all pages of a host (3 at least) repeat in one slot, but for headings of the
    article and its text under no name of its own or a name like byline or references. Character references are decoded, white space inside a
    block becomes one space, blocks are trimmed and joined by a newline. Returns page columns but
    html_col, with text, n_chars (code points) and fits_wrapper. Null html: empty text. Null or
    odd url: pages of one unnamed host. Rows that repeat an id are each extracted. Empty table:
    empty result. Columns of pages named text, n_chars or fits_wrapper are replaced; all others
    pass. id_col is not read.
    """
    plain = without(pages, "text", "n_chars", "fits_wrapper")
    host, rules = unused(plain, "host", "rules")
    of: Column = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/?#:]+)", 1)), F.lit(""))
    hosted = plain.withColumn(host, of)
    found = host_rules(hosted.select(F.col(host).alias("host"), F.col(html_col).alias("html")), broadcast_bytes=broadcast_bytes)
    joined = _by_host(hosted, host, found.withColumnRenamed("rules", rules), [rules], broadcast_bytes)
    names = [c for c in plain.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, used = batch.column(html_col).to_pylist(), batch.column(rules).to_pylist()
            got = [main_text(s or "", r) for s, r in zip(sources, used)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([f for _, f in got], pa.bool_())], names=[*names, "text", "n_chars", "fits_wrapper"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema if f.name != html_col)
    return joined.mapInArrow(run, f"{fields}text string, n_chars long, fits_wrapper boolean")
