import html as H
import random

from logloom.llm import catalog, html

PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{x}}</style></head><body><header><h1>Site name</h1><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies</div><nav><ul><li>One</li><li>Two</li></ul></nav><div class="wrap"><div class="{main}"><h2>Title {i}</h2>
<p>Paragraph {i} of the <b>bold</b> article, long enough &amp; varied {r}.</p>{extra}<ul><li>item {i}</li><li>other</li></ul><p>Last words {r}</p>
<div class="share-buttons">Share this</div><p>Read more on our site</p></div><aside>Popular {r}</aside><div class="ad-box">Buy {r}</div>
<section class="comments"><h3>Comments</h3><p>Reader {r} says a very long thing about the article, longer than anything else in it, again and again.</p></section></div>
<form><label>Mail</label><input name=q><button>Go</button></form><footer>&copy; {i}</footer><script>if (a < b) {{ "</p>" }}</script></body></html>"""


def pages(main="content"):
    rng = random.Random(1)
    return [PAGE.format(i=i, r=rng.randrange(10**9), main=main, extra="<blockquote>A quote</blockquote>" if i % 2 else "") for i in range(12)]


def expected(i, page):
    r = page.split("varied ")[1].split(".")[0]
    lines = [f"Title {i}", f"Paragraph {i} of the bold article, long enough & varied {r}.", *(["A quote"] if i % 2 else []), f"item {i}", "other", f"Last words {r}"]
    return "\n".join(lines)


def region(wrapper):
    return next(x.sig for x in html._all(wrapper.root) if x.region)


def test_wrapper_of_a_template():
    given = pages()
    wrapper = html.infer(given)
    assert region(wrapper) == "div.content"
    assert "(<blockquote>" in wrapper.expression and ")?" in wrapper.expression and ")+" in wrapper.expression
    for i, page in enumerate(given):
        assert html.extract(page, wrapper) == expected(i, page)
        alone = html.extract(page, None)  # one page does not tell that the last paragraph is part of the template
        assert alone == expected(i, page) + "\nRead more on our site"


def test_marked_articles_win():
    for tag in ("article", "main"):
        page = f"<body><div><p>{'menu text ' * 9}</p></div><{tag}><p>one<br>two</p><div>three  <i>four</i>\n five</div></{tag}><div>{'x ' * 20}</div></body>"
        assert html.extract(page, None) == "one\ntwo\nthree four five"


def test_broken_markup():
    cases = {
        "": "",
        "plain & simple": "plain & simple",
        "<p>one<p>two<b>three</p>four": "one\ntwothree\nfour",
        "<div>a</span>b</div>c": "ab\nc",
        "<p>x<script>never closed <p>y": "x",
        "<!-- <p>no</p> --><p title='a>b'>yes</p>": "yes",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a b\nc",
        "<p>a &lt;b&gt; &#233; &am</p": "a <b> é &am",
        "<ul><li>1<li>2</ul>": "1\n2",
        "<body><header>Site</header><p>text</p></body>": "text",
        "<article><header><h1>Title</h1></header><p>text</p></article>": "Title\ntext",
        "<p>&am<b>p;</b></p>": "&amp;",
    }
    for page, want in cases.items():
        assert html.extract(page, None) == want, page


def test_wide_pages_stay_fast():
    import time

    began = time.perf_counter()
    made = ["<article>" + "".join(f"<p>{i} <b>x{k}</b> y<br>z</p>" + (f"<dl><dt>{i}<dd>{k}</dl>" if i % (7 + k) == 0 else "<h3>t</h3>" * (i % 5 == k)) for i in range(5000)) + "</article>" for k in range(3)]
    wrapper = html.infer(made)
    assert region(wrapper) == "article"
    assert html.extract(made[1], wrapper).startswith("0 x1 y\nz\n0\n1\n1 x1 y\nz")
    assert time.perf_counter() - began < 60


def test_query_against_the_articles(spark, data):
    import re

    top = data.replace("0.001", "0.01")
    given = {r.page_id: r for r in spark.read.parquet(f"{top}/pages.parquet").collect()}
    got = catalog.op6_html(spark, top).collect()
    assert len(got) == len(given)
    for r in got:
        inner = re.search("<article>(.*?)(?:</article>|$)", given[r.page_id].html, re.S).group(1)
        lines = (" ".join(H.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", inner))
        assert r.text == "\n".join(x for x in lines if x)
        assert (r.url, r.n_chars) == (given[r.page_id].url, len(r.text))


def test_words_of_a_class_are_hints_only():
    """The article stays whatever its container is called, with its title; what is beside it goes, and so do comments."""
    page = (
        '<body class="no-sidebar"><div class="content-with-sidebar"><div class="article-header"><h1>Title {i}</h1></div><p>Text {i} of the article, {r}, long enough.</p>'
        '<div class="comments"><h3>Comments</h3><p>I say {r}</p></div></div><div class="sidebar-widget"><p>Other {r}</p></div></body>'
    )
    given = [page.format(i=i, r=i * 7919) for i in range(8)]
    for wrapper in (html.infer(given), None):
        for i, x in enumerate(given):
            assert html.extract(x, wrapper) == f"Title {i}\nText {i} of the article, {i * 7919}, long enough."


def test_pages_without_wrappers_keep_template_text(spark):
    """Text within articles that every page has: only the wrapper of all pages tells."""
    page = "<body><article><h1>Title {i}</h1><p>Words {r} of article {i}</p><h5>Read more on our site</h5><p>Last words {r}</p></article></body>"
    rows = [(i, f"http://h.com/{i}", page.format(i=i, r=i * i)) for i in range(10)] + [(10, "http://other.com/", page.format(i=10, r=100))]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    alone = {i: html.extract(x, None) for i, _, x in rows}
    assert all("\nRead more on our site\n" in x for x in alone.values())
    assert got == {i: x if i == 10 else x.replace("Read more on our site\n", "") for i, x in alone.items()}


def test_near_copies_of_an_article_keep_what_they_share():
    given = [f"<article><h1>One title</h1><p>A long text that all the copies have.</p><p>Another one of these.</p><p>copy {i}</p></article>" for i in range(9)]
    wrapper = html.infer(given)
    assert html.extract(given[3], wrapper) == "One title\nA long text that all the copies have.\nAnother one of these.\ncopy 3"


def test_groups_repeat_as_a_whole():
    given = [f"<body><nav>n</nav><dl>{''.join(f'<dt>t{k}</dt><dd>d{k * i}</dd>' for k in range(2 + i))}</dl></body>" for i in range(4)] + ["<body><nav>n</nav><dl><dt>x</dt><dd>y</dd></dl></body>"]
    wrapper = html.infer(given)
    assert "(<dt>#</dt><dd>#</dd>)+" in wrapper.expression
    assert html.extract(given[1], wrapper) == "t0\nd0\nt1\nd1\nt2\nd2"
    assert html.extract(given[-1], wrapper) == "x\ny"


def test_equal_elements_are_told_apart_by_their_place():
    """An optional notice before the article has its signature; the expression says which is which."""
    given = [f"<body>{'<div><h4>Notice</h4></div>' if i % 2 else ''}<h2>Head {i}</h2><div><p>Text {i} that differs, {i * 31}</p></div></body>" for i in range(10)]
    atoms = html._Atoms(html.infer(given).root.children[0].children)
    sigs = [x.sig for x in atoms.parts]
    assert sigs == ["div", "h2", "div"]
    for p in atoms.parts:
        p.plain = False
    assert atoms.match(["h2", "div"]) == atoms.parts[1:]
    assert atoms.match(["div", "h2", "div"]) == atoms.parts
    assert atoms.match(["div", "h9", "h2"]) == [atoms.parts[0], None, atoms.parts[1]]


def test_any_depth():
    import sys

    before, out = sys.getrecursionlimit(), []
    sys.setrecursionlimit(html.DEPTH)
    try:
        for page in ("<div>" * 8_000 + "<nav>menu</nav>deep", "<span>" * 8_000 + "deep", "<b><p>" * 3_000 + "deep"):
            out.append(html.extract(page, html.infer([page, page + "er"])))
    finally:
        sys.setrecursionlimit(before)
    assert out == ["deep"] * 3


def test_joined_wrappers_give_the_same(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", p) for i, p in enumerate(pages("body-text"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, b = (sorted((r.page_id, r.text) for r in html.extract_pages(df, broadcast_bytes=n).collect()) for n in (1 << 20, 0))
    assert a == b
    assert all(t.startswith("Title") for _, t in a)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "", "<p>a</p>", "x"), (2, "", "<p>a</p>", "x"), (None, "http://a.b/", "<p>" + "long " * 200_000, "y"), (4, "nohost", "", "z"), (5, "http://a.b/", "<div>" * 3000 + "deep", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text[:10], r.n_chars) for r in html.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "", "a", 1), (2, "", "a", 1), (None, "http://a.b/", "long long ", 999_999), (4, "nohost", "", 0), (5, "http://a.b/", "deep", 4)], key=str)
    assert html.extract_pages(df.where("false")).collect() == []
