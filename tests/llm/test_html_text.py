import itertools
import random

from weirgate.llm import html_text
from weirgate.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- <p>no</p> -->
<main><article class="post"><h1>Head &amp; shoulders</h1><p>First   para <b>bold<br>next <p>Second &lt;x&gt; &eacute;&#33;</p><ul><li>one<li>two</ul>
<aside>Also read this.</aside><div class="ad">Buy now.</div><blockquote>Quoted words.</blockquote></article>
<section id="comments"><p>I liked this article very much, thank you for it, it was good.</p></section></main>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Head & shoulders\n\nFirst para bold next\n\nSecond <x> é!\n\none\n\ntwo\n\nQuoted words."


def test_page_without_semantic_elements():
    page = "<div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content><h2>News</h2>" + "<p>This is a sentence that says what has happened in the town today.</p>" * 3 + "</div><div id='footer'>All rights.</div>"
    assert main_text(page) == "News" + "\n\nThis is a sentence that says what has happened in the town today." * 3


def test_kinds_of_boilerplate_around_and_inside_an_article():
    prose = "<p>The council met on Monday and agreed to repair the bridge before winter.</p>"
    want = "\n\n".join(["The council met on Monday and agreed to repair the bridge before winter."] * 2)
    for junk in (
        '<div class="sidebar"><h3>Popular</h3><p>Ten things that you did not know about the bridge.</p></div>', '<ol class="commentlist"><li><p>I live next to it and I have never seen anybody work there.</p></li></ol>',
        '<aside><p>Our reporter has lived in the town for twenty years and likes it.</p></aside>', '<div id="cookieBanner" role="dialog">We use cookies to improve this site for all of our readers.</div>',
        '<form action="/s"><p>Write to us and we will answer within three working days.</p><input name=q></form>', '<div style="display: none"><p>Nobody will ever read this hidden sentence on the page.</p></div>',
        '<div class="ad-slot"><p>Buy the new phone now, it is cheaper than it has ever been.</p></div>', "<noscript>Please enable JavaScript to read the comments.</noscript>", "<script>document.write('<p>x</p>')</script>",
    ):
        assert main_text(f"<body><article>{prose}{junk}{prose}</article></body>") == want, junk
        assert main_text(f"<body>{junk}<main>{prose}{prose}</main>{junk}</body>") == want, junk
        assert main_text(f"<body>{junk}<div class=content>{prose}{prose}</div>{junk}</body>") == want, junk


def test_empty_and_broken():
    assert main_text(None) == main_text("") == main_text("<html><script>x") == ""
    assert main_text("<p>A stray < sign & an <b unclosed tag in words that go on and on and on.") != ""


def test_min_cut_and_settled_labels_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 9)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[a][b] = edges[b][a] = rng.uniform(0, 2)

        def cost(side):
            return sum(max(0, g) for g, s in zip(gain, side) if not s) + sum(max(0, -g) for g, s in zip(gain, side) if s) + sum(w for a in range(n) for b, w in edges[a].items() if a < b and side[a] != side[b])

        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert abs(cost(html_text.min_cut(gain, edges)) - best) < 1e-6


def test_frame(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == [(0, 0, 0)] + [(1, len(main_text(PAGE)),) * 1 + (len(main_text(PAGE)),)] * 2
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_words_in_names_that_mean_something_else():
    prose = "The council met on Monday and agreed to repair the bridge before winter."
    kept = ['<h2 id="related-work">Related work</h2>', '<h2 id="comments-on-law">Comments on law</h2>', '<div class="alert-levels">Levels</div>', '<p class="reply">Yes.</p>', '<section class="social-history"><p>History.</p></section>',
            '<p class="tags-of-war">Tags</p>', "<address>Main Street 5</address>", '<p class="byline">By A. Writer</p>', "<ul>" + "<li>item</li>" * 30 + "</ul>", "<table><tr><td>1<td>2<tr><td>3</table>", '<p>See <a href="/x">this page</a></p>']
    for inner in kept:
        for page in (f"<body><nav><a href=/>Home</a></nav><article><p>{prose}</p>{inner}<p>{prose}</p></article><footer>x</footer></body>", f"<article>{inner}</article>"):
            got = main_text(page)
            want = [html_text.html.unescape(x) for x in html_text.re.findall(r">([^<>]+)<", page.split("<article>")[1].split("</article>")[0].replace('See <a href="/x">this page</a>', "See this page"))]
            assert got.split("\n\n") == want, inner


def test_the_cut_decides(spark):
    """On the pages table, labels that differ from a block's own costs are those of their surroundings, and the cut is minimal."""
    changed = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = html_text.Page(row.html)
        gain, edges = page.graph()
        labels = html_text.min_cut(gain, edges)
        changed += sum((g > 0) != x for g, x in zip(gain[: len(page.blocks)], labels))
        where = [page.elements[b.element].main for b in page.blocks]
        assert labels[: len(page.blocks)] == where
        flow = html_text.max_flow(list(gain), [dict(e) for e in edges])  # without settling first
        assert abs(cost(gain, edges, flow) - cost(gain, edges, labels)) < 1e-6
    assert changed > 200


def cost(gain, edges, side):
    return sum(max(0, g) for g, s in zip(gain, side) if not s) + sum(max(0, -g) for g, s in zip(gain, side) if s) + sum(w for a in range(len(gain)) for b, w in edges[a].items() if a < b and side[a] != side[b])


def test_small_pages_equal_brute_force():
    rng = random.Random(4)
    parts = ["<p>A sentence with quite a few words that says something at last.</p>", "<div class=ad>Buy.</div>", "<ul><li>a<li>b</ul>", "<p>x</p>", "<div><a href=1>go there</a></div>", "<aside>y</aside>", "<div id=content>", "<article>", "</div>", "</article>", "<footer>"]
    seen = 0
    for _ in range(150):
        page = html_text.Page("".join(rng.choices(parts, k=rng.randrange(1, 6))))
        gain, edges = page.graph()
        if 0 < len(gain) <= 13:
            seen += 1
            best = min(cost(gain, edges, side) for side in itertools.product([False, True], repeat=len(gain)))
            assert abs(cost(gain, edges, html_text.min_cut(gain, edges)) - best) < 1e-6
    assert seen > 80


def test_long_pages_take_linear_time():
    import time

    def seconds(page):
        at = time.process_time()
        main_text(page)
        return time.process_time() - at

    for make in (lambda n: "<div>" * n + "x" + "</p>" * n, lambda n: "<div>" * n + "<li>x</li>" * n, lambda n: "<li><ul>" + "<div>" * n + "<li>x</li>" * n, lambda n: "<p>words and more words.</p><a href=1>b</a><div class=ad>c</div>" * n, lambda n: "<section>words <a href=1>and links</a>" * n):
        assert seconds(make(20_000)) < 20 * seconds(make(4_000)) + 0.5


def test_text_that_nothing_speaks_against_stays():
    assert main_text("<p>Hello</p>") == "Hello" == main_text("<nav><a href=/>Home</a></nav><p>Hello</p><footer>x</footer>")
    assert main_text("plain text") == "plain text" and main_text("<h1>Hi</h1><p>Two words</p>") == "Hi\n\nTwo words"
    sections = "<section><p>Some words here</p><ul><li><a href=1>x</a></li></ul></section>" * 1000
    assert main_text(sections) == "\n\n".join(["Some words here\n\nx"] * 1000)
    assert main_text("<ul>" + "<li><a href=/a>A link</a></li>" * 9 + "</ul>") == ""


def test_names_of_comments_adverts_and_menus():
    prose = "Real prose text stands in this place."
    course = "The menu of the restaurant has ten courses this year."
    junk = '<article class="comment"><p>I liked this very much indeed, thanks.</p></article><div id="ad-300x250">Buy</div><div class="adsbygoogle">Buy it</div><div class="menu"><a href=1>Home</a></div>'
    assert main_text(f'<article class="post related"><p>{prose}</p><div class="menu"><p>{course}</p></div>{junk}</article>') == f"{prose}\n\n{course}"


def test_ends_of_tags_and_comments():
    assert main_text('<p title="a>b">q</p>') == "q" and main_text("<p title='it>q</p>r") == "q\n\nr"
    assert main_text("a <!-- x") == "a" and main_text("a < b <!-- x --> c <d") == "a < b c <d" and main_text("<p>a<b") == "a<b"
    assert main_text('<!-- <p>x --><p>y<script>var a="</p>"</script>z') == "yz" and main_text("<p>x<script></script y") == "x"


def test_unclosed_tags_take_linear_time():
    import time

    for part in ('<p class="a" ', '<a "', "<!", '<a ">" ', "<script></script ", "<a \"'>", "<b '\">\" ", "<!--", '<a b="'):
        for page in (part * (1_000_000 // len(part)), part * (1_000_000 // len(part)) + ">"):
            at = time.process_time()
            main_text(page)
            assert time.process_time() - at < 5, part
