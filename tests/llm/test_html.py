import html
import re

from eventloom.llm.html import extract, op8_html

SF = "/root/testdata/sf0.01"


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op8_html(spark, SF).collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[k] == "\n\n".join(p for p in parts if p)


def test_cases(spark):
    page = ('<body><header>Top</header><div class="content"><p>One &amp; <b>two</b>\n three</p><div class="comments"><p>no</p></div>'
            '<p>Four</div><aside>side</aside><form><p>f</p></form><script>x</script>')
    rows = [(1, "http://a/x", page, 1), (1, "http://a/x", page, 1), (2, None, None, 1), (3, "http://b/", "", 1), (4, "x", "plain", 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)][:4] == ["One & two three\n\nFour"] * 2 + ["", ""]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def read(spark, *pages, host="http://a/"):
    rows = [(i, host + str(i), page) for i, page in enumerate(pages)]
    return [r.text for r in sorted(extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_implied_end_tags_of_boilerplate(spark):
    article = "<article><p>One<p>Two<ul><li>a<li>b</ul></article>"
    assert read(spark, f'<body><nav><ul><li class="nav-item">a<li class="nav-item">b</ul></nav>{article}',
                f'<body><p class="advert">x<p>y{article}', f'<body><p class="advert">x<div>y</div>{article}',
                f'<body><table><tr><td class="menu">m<tr><td>n</table>{article}') == ["One\n\nTwo\n\na\n\nb"] * 4


def test_class_rules_spare_what_holds_the_article(spark):
    text = "<p>" + "word " * 40 + "</p>"
    want = [("word " * 40).strip()]
    assert read(spark, f'<body><main class="content with-sidebar">{text}</main><div class="sidebar"><p>s</p></div>') == want
    assert read(spark, f'<body><article class="post has-comments">{text}<div class="comments"><p>c</p></div></article>') == want
    assert read(spark, f'<body><form><div class="page-header-wrapper">{text}</div><div class="sidebar"><p>s</p></div></form>') == want
    assert read(spark, f'<body><article>{text}</article><div id="comments"><article class="comment">{text * 3}</article></div>') == want
    assert read(spark, f'<body><article><svg class=a />{text}</article><iframe src="a"/><title>t') == want


def test_title_and_lead_outside_the_text_container(spark):
    post = '<body><nav>n</nav><div class="post"><h1>T{0}</h1><p>lead{0}</p><div class="text"><p>' + "long{0} " * 80 + "</p></div></div><div>by me</div>"
    pages = [post.replace("{0}", str(i)) for i in range(4)]
    assert read(spark, *pages) == [f"T{i}\n\nlead{i}\n\n" + (f"long{i} " * 80).strip() for i in range(4)]
    page = "<body><main><h1>T</h1><article><p>" + "long " * 80 + "</p></article></main>"
    assert read(spark, page, page, host="http://b/") == ["T\n\n" + ("long " * 80).strip()] * 2
    # one text on every page is boilerplate, a list is no paragraph
    same = [p.replace("<h1>", "<p>All about us</p><h1>") for p in pages]
    assert read(spark, *same, host="http://c/") == [(f"long{i} " * 80).strip() for i in range(4)]
    assert "item" not in "".join(read(spark, *[p.replace("<h1>", "<ul><li>item</ul><h1>") for p in pages]))
