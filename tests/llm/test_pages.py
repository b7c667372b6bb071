"""HTML extraction: fixtures of page parts, least cuts against brute force."""

import itertools

import numpy as np

from courtloom.llm import html_extraction as H

MODEL = H.BlockModel((1.0, 0.0, -6.0, 0.5, 0.3, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0), -3.0)
PAGE = """<!DOCTYPE html><html><head><title>Final &amp; more</title><style>p{a:b}</style><script>var t="</p>";</script></head><body class=x>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Scores</a><li><a href="/b">Teams</a></ul></nav><!-- ad <p>no</p> -->
<div class="ad banner">Buy shoes now, at half of the price, today only.</div><div class='cookie-notice'>We use cookies.</div>
<article><h1>Late  three wins\nit</h1><p>The guard &lt;7&gt; passed to the
 corner&#33; Caf&eacute; <b>bold</b><i>er</i>.<p>Second paragraph<br>goes on.<form><input value=a>Search <button>Go</button></form>
<ul><li>First item of the story.</li><li>Second item.</li></ul><div class="comments"><p>Reader: I was there, and it was great.</p></div></article>
<aside>Related stories</aside><footer>&copy; 2024 Court</footer><noscript>Enable it</noscript></body></html>"""


def test_parts_of_a_page():
    assert H.main_text(PAGE, MODEL) == ("Late three wins it\nThe guard <7> passed to the corner! Café bolder.\nSecond paragraph goes on.\n"
                                        "First item of the story.\nSecond item.")


def test_odd_pages():
    for page in (None, "", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<p><p><p>", "&#0;&bogus;&amp", "<a <b> c", "<div>" * 5000):
        assert isinstance(H.main_text(page, MODEL), str)
    assert H.main_text("<article>" + "<p>Some words of the story, told at length.</p>" * 3000 + "</article>", MODEL).count("\n") == 2999


def test_unclosed_hidden_elements_do_not_hide_the_article():
    story = "<article><p>The guard passed to the corner, and the crowd rose at once.<p>It was the third win of the week, by far.</article>"
    want = "The guard passed to the corner, and the crowd rose at once.\nIt was the third win of the week, by far."
    for lead in ("<head><title>x</title><body>", "<head><title>x</title><meta a=b><style>p{}</style>", "<html><head><title>x<body>", "<select><option>a<option>b", "<iframe src=x>", "<object data=x>",
                 "<noscript>", "<svg><path d=x><text>t</text>", "<select><option>a<p>", "<head><noscript><p>No</noscript></head><body>", "<svg><title>a</title></svg><select><option>a</option></select>",
                 "<template><p>Not shown, ever, to a reader.</template><object><p>Neither is this, nor that.</object>"):
        assert H.main_text(lead + story, MODEL) == want, lead


def test_names_of_wrappers_do_not_hide_the_article():
    story = "<p>The guard passed to the corner, and the crowd rose at once.</p>"
    want = "The guard passed to the corner, and the crowd rose at once."
    for before in ("<body class='single has-sidebar'><article>", "<html class=header-fixed><body><main>", "<body><div class='page has-sidebar'><article>", "<body><form id=f><article>",
                   "<body><div id=header-fixed><div><main class=has-sidebar>"):
        assert H.main_text(before + story, MODEL) == want, before
    for before in ("<article><div class=comments><article>", "<div id=comments><article class=comment>", "<aside><article>", "<nav><main>"):
        assert H.main_text(before + story, MODEL) == "", before


def test_least_cut_is_least():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(1, 8))
        source, sink = rng.random(n) * 3, rng.random(n) * 3
        edges = [(i, j, float(rng.random())) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side, source=source, sink=sink, edges=edges):
            return sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for i, j, c in edges if side[i] != side[j])

        assert abs(cost(H._least_cut(source, sink, edges)) - min(cost(s) for s in itertools.product((False, True), repeat=n))) < 1e-6


def test_over_spark(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None), (None, "v", "", None)], "page_id long, url string, html string, text string")
    got = H.extract_main_text(pages, H.fit_block_model(pages)).collect()
    assert len(got) == 4 and got[0].text == got[1].text and got[0].text.startswith("Late three") and got[2].text == got[3].text == ""
    assert H.extract_main_text(pages.limit(0), H.fit_block_model(pages.limit(0))).count() == 0
