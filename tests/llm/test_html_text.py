import time

import pytest

from chatloom.llm.html_text import extract_text, main_text

LONG = "This is a sentence of the article, long enough to be told from a menu. " * 3
PARAGRAPH = " ".join(LONG.split())

PAGES = {
    # the article's blocks, short ones too, in their order
    "<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>A.<p>B</p><p>  </p><ul><li>one<li>two</ul></article><footer>f</footer>": "Title\nA.\nB\none\ntwo",
    # broken markup
    "<article><h1>T &am</h1><p><b>One<br><p>Two&amp;three &amp four</article><footer>&copy;": "T &am\nOne\nTwo&three & four",
    # white space and references
    "<article><p> a\n\t b&nbsp;&#32;c &lt;p&gt; &#x27;&eacute;&hellip; </p></article>": "a b c <p> 'é…",
    # what is inside the article and not of it
    f"<article><header><h1>T</h1><p>by</p></header><p>{LONG}</p><aside>see also</aside><div class='ad'>buy</div><form>mail <input></form>"
    "<script>var a = '</p>';</script><style>p{}</style><!-- c --><p>End.</p><section id=comments><p>first!</p></section></article>": f"T\n{PARAGRAPH}\nEnd.",
    # a comment that is an article of its own
    f"<article><p>{LONG}</p></article><div class='comment-list'><article><p>{LONG} not</p></article></div>": PARAGRAPH,
    # no article element: the largest region and its short ends
    f"<div id=top><a href=/>Home</a> <a href=/b>More</a></div><div id=main><h2>H</h2><p>Short.</p><p>{LONG}</p><p>{LONG}</p><p>End.</p></div>"
    f"<div class=sidebar><p>{LONG} aside</p></div><p>small print</p>": f"H\nShort.\n{PARAGRAPH}\n{PARAGRAPH}\nEnd.",
    f"<body><p>top</p><div class=page><div><p>{LONG}</p><p>End.</p></div></div><div class=widget>w</div></body>": f"{PARAGRAPH}\nEnd.",
    "<header>x</header><main><header><h1>T</h1></header><p>a</p><div class=alert>n</div></main><div>b</div>": "T\na",
    "<main><p>teaser</p><article><p>a</p></article></main>": "a",
    "<div role=main><p>a</p></div><p>b</p>": "a",
    "<p>only</p>": "only",
    "plain  text\nonly": "plain text only",
    "": "",
    None: "",
    "<nav>menu</nav><footer>foot</footer>": "",
    "<body><div class=notice>n</div><p>a < b &lt; c</p><p>x</p></body>": "a < b < c\nx",
    # a line of links belongs to an article, not to a page without one
    "<article><p>a</p><p><a href=/x>link</a></p><p>b <a href=/>c</a>d</p></article>": "a\nlink\nb cd",
    # unfinished
    "<article><p>a</p><p>b <a href='x": "a\nb",
    "<article><p>a<script>never ends <p>b": "a",
    '<article><p title="never ends>a</p><p>b</p></article>': "a\nb",
    "<ARTICLE><P CLASS=\"x\">a</P></ARTICLE><DIV>b</DIV>": "a",
    "<article><p class='ad'>buy<p>a</article>": "a",
    "<nav><ul><li>menu<li>menu</nav><article><p>a</p></article>": "a",
}


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_page(page):
    assert main_text(page or "") == PAGES[page]


def test_rows(spark):
    rows = [(i, f"u{i}", p, "old", 7) for i, p in enumerate(PAGES)] + [(None, None, "<p>a</p>", None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = extract_text(pages.repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(r[0], r[1], PAGES.get(r[2], "a"), len(PAGES.get(r[2], "a"))) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<p>a", "<b><p>", "<div>", "</x>", '<a x="', "<", "<!--", "<a ", "&amp", "<script>", "<i class=ad>", "<li>x</ul>"])
def test_long_pages_stay_linear(unit):
    def seconds(n):
        page = "<article>" + unit * n
        begin = time.perf_counter()
        main_text(page)
        return time.perf_counter() - begin

    seconds(2_000)
    assert seconds(100_000) < 5.0
