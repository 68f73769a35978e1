import numpy as np

from matchgrid.llm import html_text

PARA = "A paragraph with enough words to be told from a menu, and some more of them."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</div><!-- ad 0 --><div class=ad>Buy this now.</div>
<article><header><h1>The  title &amp; more</h1></header><p><b>First&nbsp;one.<br><p>{PARA}<p>Short.</p>
<aside>See also</aside><form><p>Name <input name=n></p></form><ul><li>One<li>Two</ul><div id="ads">x</div>
<table><tr><td>a<td>b</table><p>Last &lt;p&gt; caf&eacute;</p></article>
<section class="comments"><article><p>{PARA} {PARA}</p></article></section>
<div class=sidebar>More</div><footer>&copy; x</footer></body></html>"""


def test_article():
    want = ["The title & more", "First one.", PARA, "Short.", "One", "Two", "a", "b", "Last <p> café"]
    assert html_text.main_text(PAGE).split("\n") == want


def test_without_article():
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div><h2>Title</h2><p>{PARA}</p><p>Yes.</p><p>{PARA}</p></div><ul><li><a href=3>Three</a></li></ul></body>"
    assert html_text.main_text(page).split("\n") == ["Title", PARA, "Yes.", PARA]


def test_odd_pages():
    for page, text in ((None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<article><p>x", "x"), ("</p></div><article>a</b></article>", "a"), ("<nav>x", "")):
        assert html_text.main_text(page) == text
    assert html_text.main_text("<article>" + "<p>word " * 20000 + "</article>").count("\n") == 19999


def test_regions_over_the_whole_page():
    text = lambda page: html_text.main_text(f"<body>{page}").split("\n")
    long = "".join(f"<p>{PARA} {PARA} {PARA} {k}" for k in range(10))
    want = [f"{PARA} {PARA} {PARA} {k}" for k in range(10)]
    card = "<article><a href=1>A card of the page</a></article>"
    # text in a div beside one card; a short article beside a long one; title and lead in an article of their own
    assert text(f"<div>{long}</div>{card}") == want
    assert text(f"<article><h2>One</h2><p>{PARA}</article><article>{long}</article>") == ["One", PARA, *want]
    assert text(f"<article><header><h1>Title</h1></header><p>{PARA[:40]}</article><main>{long}</main>") == ["Title", PARA[:40], *want]
    # parents and nested articles together
    assert text(f"<article><h1>T</h1><p>{PARA}<article>{long}</article><p>Last.</article>") == ["T", PARA, *want, "Last."]
    # text outside, and links inside, are told by their ratios
    links = "".join(f"<li><a href={k}>Linked</a>" for k in range(12))
    assert text(f"<div>Site</div><h1>Title</h1><p>{PARA} {PARA}</p><article>{long}<ul>{links}</ul></article><div>Imprint</div>") == ["Title", f"{PARA} {PARA}", *want]


def test_names_are_hints():
    body = f"<h2 id=legal-history>History</h2><p>{PARA}</p><section id=related-work><h3>Work</h3><p>Brief.</p></section><section id=discussion><h3>Talk</h3><p>Yes.</p></section><p>{PARA}</p>"
    want = ["History", PARA, "Work", "Brief.", "Talk", "Yes.", PARA]
    for start in ('<article class="post no-comments">', '<div class="content has-sidebar"><article>', '<div class=sidebar><main id=menu>', "<article>", '<div id=social class="side notice"><article>'):
        page = f'<body>{start}{body}<div class="share-buttons">Share this</div><p>Some <span class=ad>buy now</span> more.</article></main></div><div class=related>Read <a href=1>this one</a></div><div class="ad">Buy.</div>'
        assert html_text.main_text(page).split("\n") == [*want, "Some more."]
    links = "".join(f"<li><a href={k}>A linked page of some length</a>" for k in range(20))
    assert html_text.main_text(f"<article>{body}<div class=my-related><h3>More</h3><ul>{links}</ul></div></article>").split("\n") == want


def test_open_head_and_paragraphs():
    for start in ("<html><head><title>T</title><body><article><p>", "<head><title>T</title><meta name=x><article><p>", "<head><style>p{}</style><div><p>"):
        assert html_text.main_text(f"{start}{PARA}") == PARA
    assert html_text.main_text(f"<head><title>T</title>{PARA}") == PARA
    assert html_text.main_text(f"<head><noscript><img src=x></noscript><title>T</title></head><body><p>{PARA}") == PARA
    assert html_text.main_text(f"<body><p class=ad><b>Buy <i>this<p>{PARA}<p>{PARA}") == f"{PARA}\n{PARA}"


def test_smoothing():
    x = np.array([0.0, 0, 9, 0, 0, 0])
    k = np.exp(-0.5 * (np.arange(-2, 3)) ** 2)
    brute = [sum(k[j - i + 2] * x[j] for j in range(6) if abs(j - i) <= 2) / sum(k[j - i + 2] for j in range(6) if abs(j - i) <= 2) for i in range(6)]
    assert np.allclose(html_text.smooth(x), brute)


def test_pages(spark, sf):
    import html
    import re

    got = html_text.op6_html_text(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in got.collect():
        inside = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id])[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if False else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", PAGE)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract(odd).collect())[:2] == [0, 0]
