from tests.conftest import SF
from tidemill.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- ad 3 --><div class="ad">Buy now</div><div id="post-17" class="post-17 wide"><h2>Fish &amp; chips</h2><p>One   two<br>three&nbsp;four
<p><b>Bold text without end<p>A <a href="x">link</a> inside.</p><blockquote>Quoted &lt;b&gt;</blockquote><form>Mail: <input></form><aside>More</aside></div>
<div class="comments"><article>First!</article></div><footer>&copy; me</footer></body></html>"""
TEXT = "Fish & chips\n\nOne two three four\n\nBold text without end\n\nA link inside.\n\nQuoted <b>"


def test_one_page():
    assert htmltext.Page(PAGE).best() == ">html>body>div.post-#"
    assert htmltext.extract(PAGE, []) == TEXT
    assert htmltext.extract(PAGE.partition("<footer>")[0], [">html>body>div.post-#"]) == TEXT
    for broken in ("", "<", "a < b", "<p", "<p class='x>text", "</div></p>", "<!-- open", "<script>x", "plain"):
        htmltext.extract(broken, ["nowhere"])
    assert htmltext.extract("a < b &amp; c", []) == "a < b & c"


def test_table(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in htmltext.main_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(htmltext.entities.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)


def test_edge_rows(spark):
    rows = [(1, "http://a.example/x", PAGE), (1, "http://a.example/x", PAGE), (2, None, PAGE), (None, "nonsense", None), (4, "http://a.example/y", ""), (5, "HTTP://A.example:80/z", "<body><p>alone</p>" + "<p>w</p>" * 20_000)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as paths")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and by[1] == TEXT == by[2] and by[None] == by[4] == "" and by[5].startswith("alone\n\nw\n\nw")
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_words_in_names():
    page = lambda inner: htmltext.extract(f"<body><nav>Menu</nav><article>{inner}<p>{'Long text. ' * 20}</p></article></body>", [])
    tail = ("Long text. " * 20).strip()
    for kept in ('<p class="share-price">Up</p>', '<div class="notice-of-sale">Up</div>', '<p id="search-and-rescue">Up</p>', "<header><h1>Up</h1><p>by me</p></header>"):
        assert page(kept) == f"Up\n\n{tail}"
    for gone in ('<div class="share-buttons">x</div>', '<div class="site-notice">x</div>', '<div class="ad-slot-2">x</div>', '<section id="related-posts">x</section>', '<div class="wide comment-list"><h2>x</h2></div>'):
        assert page(gone) == tail
    assert "Site" not in htmltext.extract(f"<body><header><h1>Site</h1></header><main><p>{tail}</p></main></body>", [])


def test_votes(spark):
    body = lambda c, n: f"<body><div class='menu'>m</div><div class='{c}'><p>{'word ' * n}</p></div></body>"
    rows = [("a", body(f"x{chr(97 + i % 26)}{chr(97 + i // 26)}", 9)) for i in range(300)]
    rows += [("b", body("one", 9))] * 6 + [("b", body("two", 9))] * 3 + [("b", body("three", 9))] + [("c", body("q", 9)), ("c", body("p", 9)), ("", body("z", 9)), ("d", "")]
    got = {r["host"]: r["paths"] for r in htmltext.consensus(spark.createDataFrame(rows, "host string, html string").repartition(3)).collect()}
    assert got == {"a": [">body>div.xaa"], "b": [">body>div.one", ">body>div.two"], "c": [">body>div.p", ">body>div.q"]}


def test_comments_footers_and_headers_of_an_article():
    tail = ("Long text. " * 20).strip()
    page = lambda inner: htmltext.extract(f"<body><nav>Menu</nav><div class='post'>{inner}<p>{tail}</p></div></body>", [])
    for gone in ("post-comments", "entry-footer", "article-comments", "content-sidebar", "comment-list", "post-footer"):
        assert page(f'<div class="{gone}">reader says</div>') == tail
    for kept in ("content-header", "entry-header", "post-header wide", "article-header-inner"):
        assert page(f'<div class="{kept}"><h1>Title</h1></div>') == f"Title\n\n{tail}"
    for gone in ("site-header", "page-header-menu", "header"):
        assert page(f'<div class="{gone}">Site</div>') == tail
    assert page("<p>A post about comments and footers.</p>").startswith("A post about")


def test_a_path_that_holds_little():
    tail = ("Long text. " * 20).strip()
    html = f"<body><div class='teaser'><p>teaser</p></div><div class='long'><p>{tail}</p></div></body>"
    assert htmltext.extract(html, [">body>div.teaser"]) == tail
    assert htmltext.extract(html, [">body>div.teaser", ">body>div.long"]) == tail
    assert htmltext.extract("<body><div class='one'><p>short</p></div></body>", [">body>div.one"]) == "short"


def test_hidden_in_a_name():
    page = lambda inner: htmltext.extract(f"<body><article>{inner}<p>tail</p></article></body>", [])
    assert page('<p class="text-hidden">kept</p>') == "kept\n\ntail" and page('<p class="hidden">x</p>') == page("<p hidden>x</p>") == "tail"
