import random

import pytest

from corvane.llm.html_text import extract_main_text, infer_wrapper, main_text, rules_of
from corvane.llm.html_tree import Node, align, dump, fold, load, match, parse, slot_paths

PAGES = "page_id long, url string, html string"


def alone(source):
    return main_text(source, rules_of([source]))[0]


def page(body, n=1):
    return f'<html><head><title>T</title></head><body><nav><ul>{"<li><a href=x>m</a></li>" * n}</ul></nav>{body}<footer>&copy; f</footer></body></html>'


def shape(source):
    return dump(parse(source))


def test_trees_fold_and_align():
    assert shape("<ul><li>a<li>b</ul>") == '[["ul",0,[["#",0,[]]]]]'
    assert shape("<div class='c 1'>a</div> <div class='c 22'>b</div>") == '[["div.c 0",1,[["#",0,[]]]]]'
    items = "<div class=k>a</div><div class=v>b</div>"
    assert [x[:2] for x in map(Node.plain, parse(items * 3))] == [["()", 1]]
    a, b = parse("<div class=a>1</div><div class=b>2</div><div class=c>3</div>"), parse("<div class=a>1</div><div class=c>3</div>")
    assert [(x.sign, x.opt) for x in align(a, b)] == [("div.a", False), ("div.b", True), ("div.c", False)]
    whole = align(parse(items * 3), parse(items))  # one turn of a group meets the group
    assert len(whole) == 1 and whole[0].sign == "()" and whole[0].rep and not whole[0].opt
    assert fold([]) == [] and parse("") == []


def test_a_wrapper_accepts_all_its_pages():
    r = random.Random(4)
    for _ in range(30):
        parts = ["<div class=a>x<ul><li>y</ul></div>", "<section>z</section>", "<div class=b><p>q</div><div class=b><p>q<div>w</div></div>", "text", "<table><tr><td>1<td>2<tr><td>3</table>"]
        sources = ["<body>" + "".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(12)]
        wrapper = load(infer_wrapper(sorted({shape(s) for s in sources})))
        for s in sources:
            tree = parse(s)
            laid = match(wrapper, tree)
            assert sum(w is not None for _, w in laid) >= 0.9 * len(laid)
            lines = [x[0] for p, _ in laid for x in p.lines]
            assert len(lines) == len(set(lines)) == len([x for p, *_ in slot_paths(parse(s)) for x in p.lines])


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>A&amp;B</h1><p>one\n two<b> bold</b></p><p>three<br>four</article>", "A&B\none two bold\nthree\nfour"),
        ("<div class='ad'>buy</div><article><p>x</p><aside>no</aside><form>f<input></form><script>var a='</p>';</script><!-- c --><div class='comments'>r</div></article>", "x"),
        ("<article></article>", ""),
        ("<article><p>a < b &lt;i&gt; &#233; &eacute;</p></article>", "a < b <i> é é"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<main><p>in</p></main><div>out</div>", "in"),
        ("<div><p>no landmark</p></div>", "no landmark"),
        # Names inside an article that only look like furniture.
        ("<article><header><h1>Title</h1></header><p>x</article>", "Title\nx"),
        ("<article><p class='related'>see also</p><h2 id='search'>Search trees</h2><p>y</article>", "see also\nSearch trees\ny"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p></article>", "Let x=1 hold."),
        ("<article><fieldset><legend>L</legend><p>in a box</p></fieldset></article>", "L\nin a box"),
        ("<article><p>a <span class='ad'>no</span> b</p><p>c</article>", "a b\nc"),
        ("<article><p class='intro'>a<p class='intro'>b</article>", "a\nb"),
        ("<article><p class='ad'>buy</p><p>c</article>", "c"),
        ("<header><p>site</p></header><article>c</article>", "c"),
        # Longer names say what a text is about; single words, alone or of a box, are furniture.
        ("<article><section id='related-work'><h2>Related work</h2><p>a</section><div class='social-history'>b</div><div class='search-algorithms'><p>c</div></article>", "Related work\na\nb\nc"),
        ("<article><p>a<div class='related-posts'>no</div><div class='share'>no</div><div class='ad-slot-7'>no</div><section class='x comments'>no</section><div aria-label='Search results of 1900'>b</div></article>", "a\nb"),
        ("<article><p>Press the <button>Start</button> key and <label>hold it</label> down.</p><button>Share this</button><p><button>Print</button></p></article>", "Press the Start key and hold it down."),
        ("<article><ul><li><button>Like</button></li></ul><p>a</article>", "a"),
    ],
)
def test_main_text(body, want):
    assert alone(page(body)) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("<html><head><title>T</title><body><article><p>x</article>", "x"),
        ("<html><head><meta charset=utf-8><title>T</title><style>p{}</style><p>x<p>y", "x\ny"),
        ("<head><title>T</title>x<p>y", "x\ny"),
        ("<head><title>T</title></head><noscript><iframe src=a></iframe></noscript><p>x", "x"),
        ("<article><p>a</p><select><option>o<p>b</p></article><article>c</article>", "a\no\nb\nc"),
        ("<article><object data=x><p>a</p><svg><text>s</text></svg><p>b</p></article>", "a\nb"),
        ("<article><p>a<object><p>no</p></div></object>b<video><video>v</video></video>c</article>", "a\nb\nc"),
        ("<article>a<textarea><p>no</textarea><script>'<object>'</script><iframe src=x />b</article>", "a\nb"),
        ("<div>" * 3000 + "deep" + "<nav>no</nav><p>er", "deep\ner"),
    ],
)
def test_missing_end_tags_and_deep_pages_cut_nothing(source, want):
    assert alone(source) == want


def test_the_wrapper_finds_template_that_names_do_not_tell():
    """Neutral class names: one page alone keeps them, the host's wrapper leaves them out."""
    def source(i):
        return f"<body><div class=q1>Daily Planet</div><article><h1>Story {i}</h1><div class=q2>Read us every morning</div><p>Own text {i}.</p><p>Licensed as stated.</p><ul class=q3><li><a href=a{i}>one {i}</a><li><a href=b>two</a><li><a href=c>three</a></ul></article><div class=q4>End</div>"

    sources = [source(i) for i in range(5)]
    rules = rules_of(sources)
    for i, s in enumerate(sources):
        # The repeated paragraph lies in the article under no name: it is the article's.
        assert main_text(s, rules) == (f"Story {i}\nOwn text {i}.\nLicensed as stated.", True)
    assert alone(sources[2]) == "Story 2\nRead us every morning\nOwn text 2.\nLicensed as stated.\none 2\ntwo\nthree"
    copies = rules_of([sources[0]] * 5)  # nothing sets template apart
    assert "Read us every morning" in main_text(sources[0], copies)[0]


def test_the_wrapper_finds_the_container_of_pages_without_an_article():
    def source(i, extra=""):
        return f"<body><div class=a>Site name</div><div class=b><a href=1>x{i}</a> <a href=2>y</a></div><div class=m><div class=in><p>Title {i}<p>A longer text of page {i} that goes on.{extra}</div></div><div class=z>Tail {i}</div>"

    sources = [source(i, "<div class=box>More " + "and more " * i + f"{i}</div>" if i % 2 else "") for i in range(6)]
    rules = rules_of(sources)
    assert main_text(sources[2], rules) == ("Title 2\nA longer text of page 2 that goes on.", True)
    assert main_text(sources[3], rules) == ("Title 3\nA longer text of page 3 that goes on.\nMore and more and more and more 3", True)
    assert "Site name" in alone(sources[2])


def test_an_article_keeps_its_headings_references_and_byline():
    def source(i):
        parts = f"<section class='abstract'><h2>Abstract</h2><p>Sum of {i}.</section><section id='methods'><h2>Methods</h2><p>We did {i}.</section>"
        refs = "".join(f"<li><a href='{i}-{k}'>Paper {i}-{k}</a>" for k in range(4))
        links = "".join(f"<li><a href='{k}'>More {k}</a>" for k in range(4))
        return f"<body><article><h1>T</h1><div class='byline'>By Jane Doe</div>{parts}<div class=q2>Read us daily</div><ul class='refs'>{refs}</ul><ul class=mm>{links}</ul><ul class=nn>{refs}</ul></article>"

    sources = [source(i) for i in range(10)]
    rules = rules_of(sources)
    refs = "\n".join(f"Paper 3-{k}" for k in range(4))
    assert main_text(sources[3], rules)[0] == f"T\nBy Jane Doe\nAbstract\nSum of 3.\nMethods\nWe did 3.\n{refs}\n{refs}"
    # Here the wrapper decides: one page alone keeps the line and the links that all pages share.
    assert main_text(sources[3], rules)[0] != alone(sources[3]) and "Read us daily" in alone(sources[3]) and "More 2" in alone(sources[3])


def test_constant_text_outside_an_article_is_template():
    sources = [f"<body><div><p>Shared banner text</p><p>own text number {i} of this page here</p></div></body>" for i in range(4)]
    assert main_text(sources[2], rules_of(sources))[0] == "own text number 2 of this page here"
    assert main_text(sources[0], rules_of([sources[0]] * 4))[0].startswith("Shared banner text")


def made_host(r):
    """Pages of a random template with their texts: a brute-force version knows the template."""
    def words(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))

    top, mid, end = (words(4) for _ in range(3))
    out = []
    for _ in range(r.randint(3, 7)):
        blocks = [words(3), *[words(r.randint(5, 30)) for _ in range(r.randint(1, 6))]]
        inside = f"<h1>{blocks[0]}</h1>"
        for k, x in enumerate(blocks[1:]):
            inside += r.choice([f"<p>{x}</p>", f"<p>{x}", f"<blockquote>{x}</blockquote>", f"<ul><li>{x}</li></ul>", f"<p><i>{x[:5]}</i>{x[5:]}</p>"])
            if k == 0:
                inside += f"<div class='k7'>{mid}</div>"
        side = "".join(f"<li><a href='{i}'>{words(2)}</a></li>" for i in range(r.randint(1, 5)))
        out.append((f"<html><body><div class='k1'>{top}</div><nav><ul>{side}</ul></nav><article>{inside}</article>" + r.choice(["", f"<aside>{words(5)}</aside>"]) + f"<div class='k9'>{end} {words(2)}</div></body></html>", "\n".join(blocks)))
    return out


def test_extraction_of_random_templates(spark):
    r = random.Random(8)
    rows, want = [], {}
    for h in range(25):
        for source, text in made_host(r):
            want[len(rows)] = text
            rows.append((len(rows), f"https://user@H{h}.example:80/p{len(rows)}", source))
    for limit in (1 << 20, 0):  # wrappers broadcast, or joined by host
        out = extract_main_text(spark.createDataFrame(rows, PAGES).repartition(5), broadcast_bytes=limit).collect()
        assert {x.page_id: x.text for x in out} == want
        assert all(x.fits_wrapper for x in out) and len(out) == len(rows)


def test_extract_rows(spark):
    rows = [(1, "http://a.example/x", page("<article><p>hi</p></article>")), (2, "http://a.example/y", None), (3, None, ""), (4, "not a url", page("<article><p>ho</p></article>")), (4, "not a url", page("<article><p>ho</p></article>")), (5, "http://b.example", page("<article>" + "<p>word é</p>" * 4000 + "</article>")), (None, "http://c.example", "x")]
    df = spark.createDataFrame([(*r, 7, "w", "h", "t") for r in rows], PAGES + ", text int, wrapper string, __host string, Host string")
    out = extract_main_text(df).collect()
    assert sorted((x.page_id or 0, x.text[:7], x.n_chars, x.wrapper, x["__host"], x["Host"]) for x in out) == [(0, "x", 1, "w", "h", "t"), (1, "hi", 2, "w", "h", "t"), (2, "", 0, "w", "h", "t"), (3, "", 0, "w", "h", "t"), (4, "ho", 2, "w", "h", "t"), (4, "ho", 2, "w", "h", "t"), (5, "word é\n", 7 * 4000 - 1, "w", "h", "t")]
    assert extract_main_text(spark.createDataFrame([], PAGES)).collect() == []
