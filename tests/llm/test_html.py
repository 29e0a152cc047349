import numpy as np

from candlemill.llm import html


def texts(page):
    return [t for p, t in html.blocks(page) if p == "article"]


def test_article_without_junk():
    page = """<html><head><title>T</title><script>x('<p>')</script></head><body class="has-sidebar"><nav><a>Menu</a></nav>
    <div class="cookie-notice">We use</div><article><h1>Head &amp; tail</h1><p><b>One
      two<br>three <p>Four&nbsp;five</p><form>Name</form><aside>Side</aside><div class="ad">Buy</div>
      <section id="comments"><p>Nice!</p></section><table><tr><td>a</td><td>b</td></tr></table>six</article><footer>&copy;</footer>"""
    assert texts(page) == ["Head & tail", "One two three", "Four five", "a b", "six"]


def test_odd_pages():
    assert html.blocks(None) == html.blocks("") == html.blocks("<!-- only") == []
    assert html.blocks("plain &lt;text&gt;") == [("open", "plain <text>")]
    assert texts("<article><p>cut off &am") == ["cut off &am"]
    assert texts("<article>" + "<p>x" * 5000) == ["x"] * 5000
    assert texts("<article><p title='a>b'>x</p>" + "y" * 200_000) == ["x", "y" * 200_000]


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(3)
    streams = [[str(x) for x in rng.integers(0, 4, rng.integers(0, 60))] for _ in range(12)]
    pages = [0, 0, *range(1, 11)]
    got = html.repeated(streams, pages)
    where = {}
    for s, p in zip(streams, pages):
        for i in range(len(s) - html.MIN_RUN + 1):
            where.setdefault(tuple(s[i : i + html.MIN_RUN]), set()).add(p)
    for s, g in zip(streams, got):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - html.MIN_RUN + 1):
            if len(where[tuple(s[i : i + html.MIN_RUN])]) > 1:
                want[i : i + html.MIN_RUN] = True
        assert (g == want).all()


def test_host_boilerplate_goes_where_no_article_tells(spark):
    boiler = "<div>our shop sells the best tea in the whole wide town</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{boiler}<div>text {i} is about subject number {i} alone</div></body>", 1) for i in range(5)]
    rows += [(9, None, None, 1), (10, "http://h.example/x", "<article><p>our shop sells the best tea in the whole wide town</p></article>", 1), (0, "http://h.example/0", rows[0][2], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").drop("text")
    got = sorted((r.page_id, r.text) for r in html.extract(pages).collect())
    want = [(i, f"text {i} is about subject number {i} alone") for i in (0, 0, 1, 2, 3, 4)] + [(9, ""), (10, "our shop sells the best tea in the whole wide town")]
    assert got == want


def test_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_articles_stay():
    p = "<p>Whole article text"
    for page in (
        f'<div class="layout no-sidebar"><article>{p}', f'<div id="menu-board"><article>{p}', f'<div class="content with-sidebar"><main>{p}',
        f'<article class="post comments-open">{p}', f'<form id="search"><div class="header"><article>{p}', f'<div class="sidebar"><main><div data-id="menu">{p}',
        f'<div id="comments"><article class="post">Nice</article></div><article>{p}', f"<main>{p}</main>",
    ):
        assert texts(page) == ["Whole article text"], page
    assert html.blocks('<article><p>Own<div class="ad-free story">Free') == [("article", "Own"), ("open", "Free")]
    assert html.blocks("<main><p>Beside</p><article><p>Own</article></main>") == [("open", "Beside"), ("article", "Own")]
    assert texts("<article><p>One</p><article><p>Two</p></article>Three</article>") == ["One", "Two", "Three"]


def test_references_are_decoded_between_tags():
    assert texts("<article><p>&<b>lt;</b> &#65;&eacute;") == ["&lt; Aé"]
    assert texts('<article><p>x<a href="abc>y</a> z') == ["xy z"]


def test_open_blocks_in_articles_and_shards(spark):
    boiler = "our shop sells the best tea in the whole wide town"
    rows = [(i, f"http://h.example/{i}", f'<nav>a b</nav><article><p>story {i} of page {i}</p><div class="tea-promo">{boiler}</div><div class="ad-free">free words number {i} here</div></article>') for i in range(9)]
    rows += [(20 + i, f"http://h.example/{i}", f"<body><div>{boiler}</div><div>text {i} is about subject number {i} alone</div>") for i in range(9)]
    rows += [(40, "http://other.example/", f'<article><p>x</p><div class="tea-promo">{boiler}'), rows[3]]
    want = {i: f"story {i} of page {i}\n\nfree words number {i} here" for i in range(9)}
    want |= {20 + i: f"text {i} is about subject number {i} alone" for i in range(9)} | {40: f"x\n\n{boiler}"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1, 2, 5, 2000):
        got = html.extract(pages, shard_pages=size).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want, size


def test_extra_columns_and_nulls(spark):
    rows = [(None, None, "<article>x", "h", "t"), (1, "u", None, "h", "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, places string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "x"), (1, "")]


def test_teasers_in_junk_stay_out():
    teaser = '<article><p>Teaser'
    for junk in (f'<aside class="related">{teaser}</article></aside>', f"<footer>{teaser}</article></footer>", f"<nav>{teaser}</article></nav>", f'<div class="related-posts">{teaser}</article></div>'):
        for page in (f"<main><article><p>Body text</p></article></main>{junk}", f"{junk}<article><p>Body text</p></article>", f"<main><p>Body text</p></main>{junk}", f'<div class="no-sidebar"><article><p>Body text</p></article></div><nav>{teaser}</article></nav>'):
            assert texts(page) == ["Body text"], page
    cards = "".join(f'<div class="related-cards">{teaser} {k}</article></div>' for k in range(3))
    assert html.blocks(f"<article><p>Body text</p></article>{cards}") == [("article", "Body text"), *(("open", f"Teaser {k}") for k in range(3))]
    assert texts("<main><h1>Title</h1><div class='search'><article><p>Body text</p></article></div></main>") == ["Body text"]
