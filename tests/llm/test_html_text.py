from grainmill.llm import html_text as ht

SHELL = "<html><head><title>T &amp; x</title><style>p{}</style><script>var a='</p><p>no';</script></head><body>{}</body></html>"


def text(source, **kw):
    return ht.main_text(ht.Page(source), "h", **kw)


def test_markup_is_taken_away():
    page = SHELL.replace(
        "{}",
        "<nav><ul><li><a href=/x>Menu</a></li></ul></nav><!-- <p>hidden --><div class='top ad'>Buy</div><div id=\"cookie-notice\">We use</div>"
        "<article><h1>A &lt;b&gt; &amp;amp; c</h1><p><b>One\n two<br><p>three&nbsp;four <i>fi</i>ve<ul><li>x<li>y</ul><aside>side</aside><form><p>name</form>"
        "<section class=comments><p>First!</section><table><tr><td>1<td>2<tr><td>3</table><p>last</article><footer>&copy; me</footer>",
    )
    assert text(page) == "A <b> &amp; c\nOne two\nthree four five\nx\ny\n1\n2\n3\nlast"
    assert text("") == "" and text("plain  text") == "plain text" and text("<p>a<p>b &am") == "a\nb &am"
    assert text("<p>cut off <b") == "cut off <b" and text("<article><header><h1>H</h1></header><p>x</article>") == "H\nx"
    assert text("<body class='no-sidebar'><div hidden>no</div><div style='display: none'>no</div><p>1 < 2 > 0</p><p a='>'>q</p>") == "1 < 2 > 0\nq"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    # Names of side parts around the only article don't hide it; beside another article they do.
    assert text("<div class=has-sidebar><article class='post share'><p>x</p><p class=share>y</p></article></div>") == "x"
    assert text("<article><p>a</p></article><div class=related><article>b</article></div>") == "a"
    assert text("<article><p>a</p><section class=comments><article class=comment>b</article></section></article>") == "a"


def test_deep_elements_are_told_apart():
    places = {b[0] for b in ht.Page("<div>" * 40 + "<p class=a>x</p><p class=b>y</p><div><p class=a>z</p></div>").blocks}
    assert len(places) == 3 and len({tuple(ht.branches(p)[: ht.BRANCH_DEPTH]) for p in places}) == 1


def site(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"https://One.example/{i}", f"<body><div class=intro><p>Same line</p><p>Also same</p></div><div class=story><p>Story {i}</p><p>More of {i}</p></div></body>", i))
        rows.append((100 + i, f"http://two.example/{i}", f"<body><div class=intro><p>Only {i}</p></div></body>", i))
    rows += [(200, None, "<p>no url", 1), (201, "http://[bad", None, 1), (200, None, "<p>no url", 1), (None, "http://three.example/", "<main>m</main><p>out", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text int")


def test_repeated_branches_go(spark):
    pages = site(spark)
    for most in (ht.MAX_CUT, 1, 0):
        got = [(r.page_id, r.url, r.text) for r in ht.extract_text(pages, max_cut=most).collect()]
        assert len(got) == 20
        by = {p: t for p, _, t in got}
        assert all(by[i] == f"Story {i}\nMore of {i}" and by[100 + i] == f"Only {i}" for i in range(8))
        assert by[201] == "" and by[None] == "m" and [t for p, _, t in got if p == 200] == ["no url"] * 2
    assert ht.extract_text(pages.limit(0)).count() == 0
    low = {(r.host, r.place) for r in ht.low_branches(pages.selectExpr("url", "coalesce(html, '') AS src")).collect()}
    assert ("one.example", "/body/div.intro") in low and not any(h == "two.example" for h, _ in low)


def neutral_site(spark, n, wrap="{}", copies=0):
    """Pages of elements without telling names: a line of links, a repeated notice inside the text, the text, a closing line."""
    rows = []
    for i in range(n + copies):
        own = min(i, n - 1)
        body = f"<div><div><span>Home News About</span></div><section><div>Story {own}</div><div>More of story {own}</div><section><div>Share this with friends</div></section></section><div><div>All rights reserved</div></div></div>"
        rows.append((i, f"http://plain.example/{i}", f"<body>{wrap.format(body)}</body>"))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_the_tree_decides_without_telling_markup(spark):
    for most in (ht.MAX_CUT, 0):
        got = {r.page_id: r.text for r in ht.extract_text(neutral_site(spark, 12), max_cut=most).collect()}
        assert got == {i: f"Story {i}\nMore of story {i}" for i in range(12)}


def test_the_tree_decides_inside_articles(spark):
    """A repeated branch of the article goes where enough pages say so, by both ways of passing the branches."""
    for most in (ht.MAX_CUT, 0):
        got = {r.page_id: r.text for r in ht.extract_text(neutral_site(spark, 40, "<article>{}</article>"), max_cut=most).collect()}
        assert got == {i: f"Story {i}\nMore of story {i}" for i in range(40)}
    few = {r.page_id: r.text for r in ht.extract_text(neutral_site(spark, 6, "<article>{}</article>")).collect()}
    assert few[3] == "Home News About\nStory 3\nMore of story 3\nShare this with friends\nAll rights reserved"


def test_copies_of_a_page_keep_their_text(spark):
    pages = spark.createDataFrame([(i, f"http://copy.example/{i}", "<article><h1>One</h1><p>and the same</p></article>") for i in range(60)], "page_id long, url string, html string")
    assert {r.text for r in ht.extract_text(pages).collect()} == {"One\nand the same"}
