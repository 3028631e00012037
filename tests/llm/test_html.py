import json
import random
import re
import time

from millrace.llm import html_wrappers as W

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">X</a></li></ul></nav><!-- ad --><div class="ad">Buy!</div>
<article><h2>Head&amp;line {n}</h2><p>First   <b>bo</b>ld &lt;text&gt; {n}.<br>After break<p>Second &copy; par
{more}<div class="share-bar">Share me</div><section class="comments"><p>A reader says</p></section></article>
<aside>Side</aside><div class="cookie-notice">Cookies</div><form><label>Mail</label><input><button>Go</button></form><footer>Foot</footer></body></html>"""


def test_article_alone(spark):
    pages = [(i, "http://a.example.org/x", PAGE.format(n=i, more="<p>third</p>" * (i % 4))) for i in range(12)]
    pages += [(20, None, None), (21, "http://b.org", ""), (22, "::odd::", "just text &amp; more"), (23, "http://a.example.org/y", "<article>other <i>shape</i>"), (24, "http://c.org", "<p>" + "long " * 5000), (20, None, None)]
    df = spark.createDataFrame([(*p, "clash", "w") for p in pages], "page_id long, url string, html string, host string, wrapper string").repartition(3)
    got = sorted((r["page_id"], r["text"]) for r in W.extract(df).collect())
    for i in range(12):
        assert got[i] == (i, " ".join([f"Head&line {i} First bold <text> {i}. After break Second © par", *["third"] * (i % 4)]))
    assert got[12:] == [(20, ""), (20, ""), (21, ""), (22, "just text & more"), (23, "other shape"), (24, " ".join(["long"] * 5000))]
    assert W.extract(df.limit(0)).count() == 0


def test_main_text_without_marks():
    page = "<body><div id=top><a href=x>One</a> <a href=y>Two</a></div><div id=c><p>{0}</p><p>{0} again</p></div><div id=low><a href=z>Links links links</a></div></body>"
    made = None
    for i in range(5):
        made = W.merge(made, W.wrapper_of(page.format(f"text number {i} " * 30)))
    assert W.Wrapper(made).text(page.format("some text")) == "some text some text again"


def test_pages_of_several_layouts_on_a_host(spark):
    bodies = ["<nav>Menu</nav><article><p>in article</p></article>", "<nav>Menu</nav><main><p>in main</p></main>", "<div class=content><p>in content</p></div>", "<div><p>no mark</p></div>", "<nav>Menu</nav>"]
    pages = [(i, url, f"<body>{b}</body>") for url in ("http://a.org/x", None) for i, b in enumerate(bodies)]
    got = W.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    assert all(r["text"] == ["in article", "in main", "in content", "no mark", ""][r["page_id"]] for r in got) and len(got) == 10


def test_unmarked_text_beside_the_richest_element():
    page = "<body>Loose<div id=top><a href=x>One</a> <a href=y>Two</a></div><div id=c><p>{0}</p></div><div id=d>A short end</div><div id=low><a href=z>Links</a></div></body>"
    made = None
    for i in range(5):
        made = W.merge(made, W.wrapper_of(page.format(f"text number {i} " * 30)))
    assert W.Wrapper(made).text(page.format("some text")) == "Loose some text A short end"


def leaves(text, **keys):
    """Items of a stream written as letters: capitals are tags alone, the others texts."""
    return [["o", c] if c.isupper() else ["t", W._value(c), W.BASE, 1, 1, 0] for c in text]


def written(items):
    """An expression as a pattern over the heads of its items."""
    out = ""
    for x in items:
        if x[0] in "+?":
            out += f"(?:{written(x[1])}){x[0]}"
        elif x[0] == "e":
            out += re.escape(f"<e:{x[1]}>") + written(x[2]) + "<c>"
        else:
            out += "<t>" if x[0] == "t" else re.escape(f"<o:{x[1]}>")
    return out


def held(made, page):
    return re.fullmatch(written(made["items"]), "".join(f"<{s}>" for s in W.symbols(page)[0])) is not None


def heads(items):
    return [W._strict(x) for x in items]


def test_inference():
    assert heads(W.fold(leaves("ABABABC"), W.in_a_row)) == ["(o:A o:B)", "o:C"]
    assert heads(W.fold(leaves("XABABY"), W.in_a_row)) == ["o:X", "(o:A o:B)", "o:Y"]
    long = "ABCDEFGHIJKLMNOPQRSTUVWXY"
    assert len(W.fold(leaves(long * 3 + "Z"), W.in_a_row)) == 2  # however long
    assert heads(W.align(leaves("ABC"), leaves("AC"), W.on_pages)) == ["o:A", "?o:B", "o:C"]
    group = W.fold(leaves("APaPaC"), W.in_a_row)
    assert heads(W.align(group, leaves("APaC"), W.on_pages)) == heads(group) == ["o:A", "(o:P t)", "o:C"]
    (slot,) = W.align(leaves("a"), leaves("b"), W.on_pages)
    (fixed,) = W.align(leaves("a"), leaves("a"), W.on_pages)
    assert slot[1] is None and fixed[1] == W._value("a") and slot[3] == fixed[3] == 2


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 5 - depth)):
        kind = rng.randrange(5)
        if kind < 2 or depth > 2:
            out += rng.choice(["<p>", "<li class=x>", ""]) + rng.choice(["a", "b", "c"])
        else:
            name = rng.choice(["div", "section class=s", "h2"])
            out += f"<{name}>{random_page(rng, depth + 1)}</{name.split()[0]}>" * rng.choice([1, 1, 2, 3])
    return out


def test_wrappers_hold_their_pages_and_place_texts_as_a_regular_expression_would():
    rng = random.Random(3)
    for _ in range(150):
        pages = [random_page(rng) for _ in range(rng.randint(1, 5))]
        made = None
        for page in pages:
            made = W.merge(made, W.wrapper_of(page))
        wrapper = W.Wrapper(made)
        for page in pages:
            stream = W.symbols(page)[0]
            assert held(made, page)
            assert [wrapper._met[at] for at in wrapper.places(stream)] == stream
        for page in (random_page(rng) for _ in range(10)):  # other pages are held just where the pattern holds them
            assert (wrapper.places(W.symbols(page)[0]) is not None) == held(made, page)


def test_pages_match_their_wrapper():
    pages = [PAGE.format(n=i, more=m) for i, m in enumerate(["", "<p>x</p>", "<ul><li>a<li>b</ul>", "<table><tr><td>1<td>2</table>", "<h3>sub</h3><p>y</p>" * 3])]
    made = None
    for p in pages:
        made = W.merge(made, W.wrapper_of(p))
    for p in pages:
        assert held(made, p) and W.Wrapper(made).places(W.symbols(p)[0]) is not None


SAME = "<body><div><div class=x>Get our app!<p>It is free.</div><div class=y><h2>Story</h2><p>{0} one<p>{0} two</div><p>Printed on paper.</body>"


def test_text_of_the_template_is_left_out():
    pages = [SAME.format(f"text {i}") for i in range(W.TEMPLATE_PAGES)]
    made = None
    for page in pages:
        made = W.merge(made, W.wrapper_of(page))
    wrapper = W.Wrapper(made)
    assert [wrapper.text(p) for p in pages] == [f"Story text {i} one text {i} two" for i in range(W.TEMPLATE_PAGES)]
    # a page that has something else at such a place keeps it, and a heading stays
    assert "It costs a lot." in wrapper.text(pages[0].replace("It is free.", "It costs a lot."))
    # with another expression, another text: of one page or of copies nothing is known to be the template's
    assert W.Wrapper(W.wrapper_of(pages[0])).text(pages[0]) == "Get our app! It is free. Story text 0 one text 0 two Printed on paper."
    copies = None
    for _ in range(W.TEMPLATE_PAGES):
        copies = W.merge(copies, W.wrapper_of(pages[0]))
    assert W.Wrapper(copies).text(pages[0]).startswith("Get our app!")


def test_results_do_not_depend_on_how_pages_are_dealt_out(spark):
    rng = random.Random(5)
    bodies = [f"<body><nav>n</nav><div class=x>Promo<div>{random_page(rng)}</div></div></body>" for _ in range(150)]
    df = spark.createDataFrame([(i, f"http://h{i % 2}.org/", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    found = [sorted(map(tuple, W.infer(df.repartition(n, "page_id")).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 2
    for h, made in found[0]:
        assert all(held(json.loads(made), b) for i, b in enumerate(bodies) if h == f"h{i % 2}.org")


def test_cut_off_markup():
    assert W.tokens("a <b>x</b> <div class='u'>y</div> <a href='") == [("t", "", "a x", 0), ("o", "div u", "", 0), ("t", "", "y", 0), ("c", "div", "", 0), ("t", "", "<a href='", 0)]
    assert [t[2] for t in W.tokens("<script>if (a < b) {}") if t[0] == "t"] == []
    assert W.host("HTTP://A.Example.org:80/x") == "a.example.org" and W.host(None) == "" and W.host("http://[bad") == ""


def test_hostile_pages_end_in_time():
    began = time.monotonic()
    for page in ("<p>text</p><a href=http://example.org/" + "abc" * 5000, '<a href=xxxx" >tail</a>' * 3000, '<a x="' * 60_001, "<a x='>" * 40_001 + "end", "<a" * 100_000, "<!--" * 50_000, "<script>" * 30_000, "<![CDATA[" * 30_000, "a=\"'" * 50_000 + ">", "<p " + "=" * 100_000, "<b =\"" * 20_000 + ">x"):
        W.tokens(page)
        W.tokens(f"<article>{page}</article>")
    for i in range(len(PAGE)):  # every prefix
        W.tokens(PAGE[:i])
    assert time.monotonic() - began < 20


def test_odd_nesting_ends_in_time():
    began = time.monotonic()
    deep = [f"{t}x" * 20_000 for t in ("<div>", "<p>", "<div></p>", "<section></div>", "<li><div>a</div>", "<div class=a><p>b<h2>")]
    deep.append("".join(f"<{random.Random(1).choice('pq')}{i % 7}>x" for i in range(5000)))
    for page in deep:
        W.Wrapper(W.merge(W.wrapper_of(page), W.wrapper_of(page + "<h1>y</h1>"))).text(page)
    assert time.monotonic() - began < 40


def test_odd_quotes():
    said = lambda page: [t[2] for t in W.tokens(page) if t[0] == "t"]
    assert said('<a href=xxxx" >tail</a> more') == ["tail more"]
    assert said('<p title="a > b">one</p><p class=x\'>two</p>') == ["one", "two"]
    assert said("<p id='open>one</p>two") == ["one", "two"]
    assert said('<img alt="x>y">z') == ["z"]
