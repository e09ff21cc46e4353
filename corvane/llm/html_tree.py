"""Pages as trees of text slots, and their alignment into union-free wrappers.

A page's token stream becomes a tree of containers and text slots. Neighbours of one label, and
runs of labels that repeat, fold into repeated groups; two trees are aligned by their labels, and
what only one of them has becomes optional. A slot holds the lines of text between two containers.
"""

from __future__ import annotations

import html
import json
import re
from difflib import SequenceMatcher

#: Open containers beyond which one makes no node of its own: its text joins the slot around it.
MOST_DEPTH = 100
#: Labels of the longest run that is folded into a repeated group.
LONGEST_RUN = 6
#: Product of the lengths of two lists from which on their alignment is by longest common runs.
LONG = 40_000

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("address article aside body center details dir div dl fieldset figure footer form header html main menu nav ol section table td th tr ul".split())
TEXTUAL = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li option optgroup p pre summary tbody tfoot thead".split())
BLOCK = CONTAINERS | TEXTUAL | frozenset(("br", "dialog", "hr"))
RAW = "script|style|textarea|title"
#: Elements whose inside is no text of the page; end tags inside do not close what is outside.
EMBEDDED = frozenset("annotation annotation-xml audio canvas iframe noscript object select svg template video".split())
#: What head may hold; anything else ends it where its end tag is left out.
IN_HEAD = frozenset("base basefont bgsound link meta noscript template".split())
FURNITURE = frozenset("aside button dialog footer form label menu nav".split())
MAIN = frozenset(("article", "main"))
UNNAMED = MAIN | {"body", "html"}
#: Elements that end an open one of their kind.
SIBLINGS = frozenset("dd dt li option td th tr".split())
_EDGE, _END = r"(?:^|[\s_-])(?:", r")(?:$|[\s_-])"
#: Words in class or role that mark any element as no part of the article.
STRONG = re.compile(_EDGE + r"ad|ads|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|subscribe|newsletter|comment|comments|disqus" + _END, re.I)
#: Words in class, id, role or label that mark a container.
MARKED = re.compile(_EDGE + r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumb\w*|sidebar|side|footer|cookie\w*|consent|gdpr|notice|popup|modal|overlay|subscribe|newsletter|share|sharing|social|related|recommend\w*|comment|comments|respond|disqus|widget|toolbar|contentinfo|complementary|search|skip" + _END, re.I)
#: A class, id or role that marks a part of an article as none of it: such a word, alone or with
#: words that only say what kind of box it is. Longer names say what a text is about.
EXACT = re.compile(r"(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|cookies?|consent|gdpr|notice|popup|modal|overlay|subscribe|newsletter|share|sharing|social|related|recommend\w*|comments?|respond|disqus|widget|toolbar|contentinfo|complementary|search|skip)(?:[-_](?:ads?|area|articles?|banner|bar|block|box|button|buttons|container|content|feed|footer|form|header|icons?|inner|item|items|label|link|links|list|media|menu|notice|panel|posts?|reading|section|sidebar|signup|slot|stories|thread|toolbar|unit|widget|wrap|wrapper|0))*", re.I)
#: Names of parts of an article that may look alike on all pages of a host.
OWN = re.compile(r"(?:abstract|authors?|bibliography|byline|citations?|dateline|footnotes?|lead|refs?|references?)(?:[-_](?:box|inner|item|items|line|list|name|section|wrap|wrapper|0))*", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADED = re.compile(_EDGE + r"header|masthead" + _END, re.I)
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<({RAW})\b(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>|[^<]++|<", re.S | re.I)
_EMBED = re.compile(rf"<(?:{'|'.join(sorted(EMBEDDED))})\b", re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_ATTR = re.compile(r"[\s\"'](class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\s(hidden)(?=[\s>/=])|\saria-(hidden)\s*=\s*[\"']?true", re.I)


class Node:
    """A slot ("#"), a group ("()") or an element; lines are [block, text, characters in links,
    whether it is a heading]."""

    __slots__ = ("sign", "kids", "rep", "opt", "lines")

    def __init__(self, sign: str, kids: list | None = None, rep: bool = False, opt: bool = False):
        self.sign, self.kids, self.rep, self.opt = sign, kids if kids is not None else [], rep, opt
        self.lines: list[list] = []

    def label(self) -> str:
        return "(" + " ".join(k.label() for k in self.kids) + ")" if self.sign == "()" else self.sign

    def plain(self) -> list:
        return [self.sign, 2 * self.opt + self.rep, [k.plain() for k in self.kids]]


def dump(nodes: list[Node]) -> str:
    return json.dumps([x.plain() for x in nodes], ensure_ascii=False, separators=(",", ":"))


def load(text: str) -> list[Node]:
    def node(x: list) -> Node:
        return Node(x[0], [node(k) for k in x[2]], bool(x[1] & 1), bool(x[1] & 2))

    return [node(x) for x in json.loads(text)]


def absorb(a: Node, b: Node, repeated: bool = False) -> None:
    """Widens a to accept what b, of the same label, accepts."""
    a.rep, a.opt = a.rep or b.rep or repeated, a.opt or b.opt
    a.lines.extend(b.lines)
    a.kids = align(a.kids, b.kids)


def _gather(nodes: list[Node], others: list[Node]) -> list[Node]:
    """nodes with each run that is a group of others put into a group of one turn."""
    for group in others:
        if group.sign != "()":
            continue
        want = [k.label() for k in group.kids]
        i = 0
        while i + len(want) <= len(nodes):
            if nodes[i].sign == want[0] and [x.label() for x in nodes[i : i + len(want)]] == want:
                nodes = [*nodes[:i], Node("()", nodes[i : i + len(want)]), *nodes[i + len(want) :]]
            i += 1
    return nodes


def _weight(label: str) -> int:
    return 1 if label == "#" else 4 if "." in label else 2


def _common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a heaviest common subsequence: named elements weigh most, slots least.
    Lists whose product passes LONG are compared by longest common runs instead."""
    start, n, m = 0, len(left), len(right)
    while start < min(n, m) and left[start] == right[start]:
        start += 1
    while n > start and m > start and left[n - 1] == right[m - 1]:
        n, m = n - 1, m - 1
    out = [(i, i) for i in range(start)]
    a, b = left[start:n], right[start:m]
    if a and b and len(a) * len(b) > LONG:
        out += [(start + i + d, start + k + d) for i, k, size in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for d in range(size)]
    elif a and b:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            weight = _weight(a[i])
            for k in range(len(b) - 1, -1, -1):
                best[i][k] = max(best[i + 1][k], best[i][k + 1], best[i + 1][k + 1] + weight if a[i] == b[k] else 0)
        i = k = 0
        while i < len(a) and k < len(b):
            if a[i] == b[k] and best[i][k] == best[i + 1][k + 1] + _weight(a[i]):
                out.append((start + i, start + k))
                i, k = i + 1, k + 1
            elif best[i + 1][k] >= best[i][k + 1]:
                i += 1
            else:
                k += 1
    return out + [(n + d, m + d) for d in range(len(left) - n)]


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One list that accepts both: nodes of one label are merged, what one side has is optional."""
    a, b = _gather(a, b), _gather(b, a)
    left, right = [x.label() for x in a], [x.label() for x in b]
    out: list[Node] = []
    i = k = 0
    for x, y in [*_common(left, right), (len(a), len(b))]:
        for extra in (*a[i:x], *b[k:y]):
            extra.opt = True
            out.append(extra)
        if x < len(a):
            absorb(a[x], b[y])
            out.append(a[x])
        i, k = x + 1, y + 1
    return out


def fold(nodes: list[Node]) -> list[Node]:
    """Neighbours of one label, then runs of labels that repeat, as repeated groups."""
    out: list[Node] = []
    for x in nodes:
        if out and out[-1].label() == x.label():
            absorb(out[-1], x, repeated=True)
        else:
            out.append(x)
    for width in range(2, LONGEST_RUN + 1):
        if len(out) < 2 * width:
            break
        labels, i, folded = [x.label() for x in out], 0, []
        while i < len(out):
            unit, n = labels[i : i + width], 1
            while len(unit) == width and labels[i + n * width : i + (n + 1) * width] == unit:
                n += 1
            if n == 1:
                folded.append(out[i])
                i += 1
                continue
            group = Node("()", out[i : i + width], rep=True)
            for turn in range(1, n):
                for x, y in zip(group.kids, out[i + turn * width : i + (turn + 1) * width]):
                    absorb(x, y)
            folded.append(group)
            i += n * width
        out = folded
    return out


def match(wrapper: list[Node], page: list[Node]) -> list[tuple[Node, Node | None]]:
    """(page slot, wrapper slot) of every slot of a page; None where the wrapper has no place."""
    out: list[tuple[Node, Node | None]] = []

    def lost(nodes: list[Node]) -> None:
        for x in nodes:
            out.append((x, None)) if x.sign == "#" else lost(x.kids)

    def pair(x: Node, y: Node) -> None:
        out.append((y, x)) if y.sign == "#" else walk(x.kids, y.kids)

    def place(y: Node, near: list[Node]) -> None:
        """A node beside the common subsequence: the next of its label, in groups too."""
        if y.sign == "()":
            for kid in y.kids:
                place(kid, near)
            return
        for x in near:
            for z in x.kids if x.sign == "()" else (x,):
                if z.sign == y.sign:
                    return pair(z, y)
        lost([y])

    def walk(a: list[Node], b: list[Node]) -> None:
        b = _gather(b, a)
        met = {k: i for i, k in _common([x.label() for x in a], [x.label() for x in b])}
        at = 0
        for k, y in enumerate(b):
            if k in met:
                at = met[k]
                pair(a[at], y)
            else:
                place(y, a[at:] + a[:at])

    walk(wrapper, page)
    return out


def slot_paths(wrapper: list[Node]) -> list[tuple[Node, tuple[int, ...], tuple[str, ...]]]:
    """(slot, position, signs of the elements around it) of each slot, in order."""
    out = []

    def walk(nodes: list[Node], at: tuple[int, ...], signs: tuple[str, ...]) -> None:
        for i, x in enumerate(nodes):
            if x.sign == "#":
                out.append((x, at, signs))
            else:
                walk(x.kids, (*at, i), signs if x.sign == "()" else (*signs, x.sign))

    walk(wrapper, (), ())
    return out


def in_main(signs: tuple[str, ...]) -> bool:
    return any(s.partition(".")[0] in MAIN for s in signs)


def is_own(signs: tuple[str, ...]) -> bool:
    """Whether a slot lies in a part of an article that is named as such."""
    last = max((i for i, s in enumerate(signs) if s.partition(".")[0] in MAIN), default=len(signs))
    return any(OWN.fullmatch(w) for s in signs[last:] for w in s.partition(".")[2].split())


def is_furniture(signs: tuple[str, ...]) -> bool:
    """Whether names of elements, classes or roles say that a slot is no part of the article: any
    telling word outside of it, in it only names that say nothing else."""
    inside = False
    for sign in signs:
        tag, _, words = sign.partition(".")
        inside = inside or tag in MAIN
        if tag in FURNITURE or tag == "header" and not inside or "hidden" in words.split():
            return True
        if words and inside and any((STRONG.search(w) if tag in TEXTUAL or tag in SIBLINGS else True) and EXACT.fullmatch(w) for w in words.split()):
            return True
        if words and not inside and (STRONG if tag in TEXTUAL or tag in SIBLINGS else MARKED).search(words) or words and not inside and HEADED.search(words):
            return True
    return False


def _unended(source: str) -> set[int]:
    """Where embedded elements begin whose end tag is missing: their tags alone are left out."""
    if not _EMBED.search(source):
        return set()
    begun: dict[str, list[int]] = {}
    for m in TOKEN.finditer(source):
        token = m.group()
        if m.group(1) is None and token[0] == "<" and (name := _NAME.match(token)) and (tag := name.group(1).lower()) in EMBEDDED:
            if token[1] != "/":
                if not token.endswith("/>"):
                    begun.setdefault(tag, []).append(m.start())
            elif begun.get(tag):
                begun[tag].pop()
    return {x for of in begun.values() for x in of}


def _words(token: str, tag: str) -> str:
    """What of class, id, role and label names an element; digits, which often count, are one."""
    if tag in UNNAMED or "=" not in token and "hidden" not in token.lower():
        return ""
    few = tag in TEXTUAL or tag in SIBLINGS
    # A label is one name, whatever words it has.
    found = ["_".join(x.split()) if name.lower() == "aria-label" else x for name, *values in _ATTR.findall(token) for x in values if x and not (few and name.lower() in ("id", "aria-label"))]
    return re.sub(r"\d+", "0", " ".join(found))


def parse(source: str) -> list[Node]:
    """The folded tree of a page."""
    root = Node("")
    stack: list[tuple[str, Node | None, Node, bool]] = []  # tag, own node, node around it, hides
    here, block, hidden, links, depth = root, 0, 0, 0, 0
    line: list | None = None
    within: Node | None = None
    unended = _unended(source)

    def close(upto: int) -> None:
        nonlocal here, hidden, links, depth
        while len(stack) > upto:
            tag, node, around, hides = stack.pop()
            hidden -= hides
            links -= tag == "a"
            here = around
            if node is not None:
                depth -= 1
                node.kids = fold(node.kids)
                if not node.kids:
                    around.kids.pop()

    def opened(tag: str, stop) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                return i
            if stop(stack[i]):
                return None
        return None

    for m in TOKEN.finditer(source):
        token = m.group()
        if m.group(1) is not None:
            block += m.group(1).lower() not in ("script", "style")
            continue
        if token[0] != "<" or token == "<":
            blank = not token.strip()
            if not blank and stack and stack[-1][0] == "head":
                close(len(stack) - 1)
                block += 1
            if hidden:
                continue
            if line is None or line[0] != block or within is not here:
                if blank and (line is None or line[0] != block):
                    continue
                if not here.kids or here.kids[-1].sign != "#":
                    here.kids.append(Node("#"))
                line, within = [block, "", 0, any(e[0] in HEADINGS for e in stack)], here
                here.kids[-1].lines.append(line)
            line[1] += token
            if links:
                line[2] += len(token.strip())
            continue
        name = _NAME.match(token)
        if name is None:
            continue
        tag = name.group(1).lower()
        block += tag in BLOCK
        if token[1] == "/":
            if tag in BLOCK:
                i = opened(tag, lambda e: e[0] in EMBEDDED)
            else:
                i = opened(tag, lambda e: e[0] in EMBEDDED and e[0] != tag or e[0] in CONTAINERS)
            if i is not None:
                close(i)
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
            block += 1
        block += tag in EMBEDDED or tag == "head"
        if tag in VOID or token.endswith("/>") or m.start() in unended:
            continue
        if tag in SIBLINGS or tag == "a":
            i = opened(tag, lambda e: e[0] in EMBEDDED or e[0] in CONTAINERS and e[0] not in SIBLINGS or tag == "td" and e[0] == "tr")
            if i is not None:
                close(i)
        if tag in BLOCK and tag not in SIBLINGS:
            i = opened("p", lambda e: e[0] in EMBEDDED or e[0] in CONTAINERS)
            if i is not None:
                close(i)
        words = _words(token, tag)
        sign = f"{tag}.{words}" if words else tag
        # A button or label amid a sentence is a word of it.
        amid = tag in ("button", "label") and line is not None and line[0] == block and bool(line[1].strip()) and "hidden" not in words.split() and next((e[0] for e in reversed(stack) if e[0] in BLOCK), "") in TEXTUAL - SIBLINGS
        named = not amid and (tag in CONTAINERS or tag in FURNITURE or bool(words) and (tag in TEXTUAL or is_furniture((sign,))))
        hides = tag in EMBEDDED or tag == "head" or named and depth >= MOST_DEPTH and is_furniture((sign,))
        node = Node(sign) if named and not hides and depth < MOST_DEPTH else None
        stack.append((tag, node, here, hides))
        hidden += hides
        links += tag == "a"
        if node is not None:
            depth += 1
            here.kids.append(node)
            here = node
    close(0)
    return fold(root.kids)


def line_text(raw: str) -> str:
    """References decoded, white space as one blank, trimmed."""
    return " ".join(html.unescape(raw).split())
