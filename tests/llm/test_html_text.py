import random

import pytest

from loadlens.llm.html_text import extract, main_texts, parse, winning_paths

SCHEMA = "page_id long, url string, html string, winner string"


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='<p>no</p>';</script></head>"
        "<body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li><a href='/x'>Menu</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><div id='wrap'><article class='post-12'><h1>{title}</h1>{body}"
        "<aside>Aside</aside><form><p>Mail</p></form><div class='ad-slot'>Buy</div></article>"
        f"<div class='sidebar'><p>Side {'text ' * 50}</p></div><section class='comments'><p>Nice {'post ' * 80}</p></section>{extra}</div>"
        "<footer>&copy; all</footer></body></html>"
    )


CASES = {
    "": "",
    "plain  text": "plain text",
    "<p>x &lt;b&gt; &amp;amp; &eacute;&#233; y<br>z": "x <b> &amp; éé y z",
    "<p>One<p>Two<li>a<li>b": "One\nTwo\na\nb",
    "<p>a<b>b</p><p>c</b>d</p>": "ab\ncd",
    "<p>cut <a href='x": "cut",
    "<div>a<script>var x = '</p>';": "a",
    "<div hidden><p>no</p></div><div style='display: none'>no</div><p>yes</p>": "yes",
    "<!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>": "yes",
    "<table><tr><td>a<td>b</table>": "a\nb",
    "<P CLASS=Advert>no</P><P>yes</P>": "yes",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<nav>only menus</nav>": "",
    "<div>" * 3000 + "deep" + "</div>" * 10: "deep",
    "<p>" + "word " * 20000 + "</p>": ("word " * 20000).strip(),
}


@pytest.mark.parametrize("html", CASES, ids=range(len(CASES)))
def test_pages_alone(html):
    assert extract(html, None)[0] == CASES[html]


def test_article_without_the_rest():
    got = extract(page("Head &amp; line", ["One  <a href='y'>two</a>", "three", " "]), None)[0]
    assert got == "Head & line\nOne two\nthree"


def test_host_path_beats_a_page_alone(spark):
    """A short article beside a long unmarked column: only its host's other pages tell."""
    rng = random.Random(2)
    column = "<div class='col-7'>" + "<p>teaser text of another page</p>" * 30 + "</div>"
    body = "<div id=a><div class='text-{}'>{}</div>{}</div>"
    rows = []
    for i in range(9):
        words = " ".join(f"w{rng.randrange(999)}" for _ in range(300))
        rows.append((i, f"http://h.example/{i}", body.format(i, f"<p>{words}</p>", ""), "x"))
    rows.append((9, "http://H.example/9", body.format(9, "<p>short</p>", column), "x"))
    rows.append((10, "http://other.example/9", body.format(9, "<p>short</p>", column), "x"))
    rows += [(11, "http://h.example/e", "", ""), (12, None, None, None), (13, "no scheme", "<p>t</p>", "")]
    rows += [(9, "http://H.example/9", body.format(9, "<p>short</p>", column), "x")]
    pages = spark.createDataFrame(rows, SCHEMA)
    winners = {r.host: r.winner for r in winning_paths(pages).collect()}
    assert winners["h.example"] == "div/div.text-#"
    got = [(r.page_id, r.text, r.by_host) for r in main_texts(pages).collect()]
    assert len(got) == len(rows)
    texts = {page_id: text for page_id, text, _ in got}
    assert texts[9] == "short" and texts[10] != "short"
    assert texts[11] == "" and texts[12] == "" and texts[13] == "t"
    assert sorted(p for p, _, _ in got).count(9) == 2
    assert main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_any_text_parses():
    rng = random.Random(4)
    bits = ["<", ">", "</", "<p", "<div class='", '"', "'", "a", " ", "<!--", "-->", "<script>", "</p>", "<article>", "&", "&lt"]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=40))
        parse(text)
        extract(text, "div")


LONG = " ".join(f"word{i}" for i in range(80))
WHOLE = {
    f"<body><h1><a href='/t'>Title</a></h1><p>lead</p><div class=content><p>{LONG}</p></div></body>": f"Title\nlead\n{LONG}",
    f"<main><article class=a>one {LONG}</article><article class=b>two {LONG}</article></main>": f"one {LONG}\ntwo {LONG}",
    f"<body><div><a href=x>Menu</a> <a href=y>More</a></div><h1>T</h1><div><p>{LONG}</p></div></body>": f"T\n{LONG}",
}


@pytest.mark.parametrize("html", WHOLE, ids=range(len(WHOLE)))
def test_all_good_text_of_a_page(html):
    assert extract(html, None)[0] == WHOLE[html]


def test_blocks_that_a_host_repeats_are_left_out(spark):
    """An unmarked slogan goes where a host repeats it; what only one page has stays."""
    body = "<body><div class=a><p>We are the best shop</p></div><h1>Title {0}</h1><div class=b>{1} {0}</div>{2}</body>"
    rows = [(i, f"http://h.example/{i}", body.format(i, LONG, ""), "") for i in range(5)]
    rows += [(5, "http://h.example/5", body.format(5, LONG, "<div class=z>a last remark</div>"), "")]
    rows += [(6, "http://alone.example/", body.format(6, LONG, ""), "")]
    texts = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(texts[i] == f"Title {i}\n{LONG} {i}" for i in range(5))
    assert texts[5] == f"Title 5\n{LONG} 5\na last remark"
    assert texts[6].startswith("We are the best shop\nTitle 6")


def test_two_templates_on_a_host(spark):
    prose, article = "<body><div>prose {0} {1}</div>", "<body><div>Updated {0} May</div><article>{1} {0}</article>"
    rows = [(i, f"http://h.example/{i}", prose.format(i, LONG), "") for i in range(6)]
    rows += [(i, f"http://h.example/{i}", article.format(i, LONG), "") for i in range(6, 9)]
    rows += [(i, None, prose.format(i, LONG), "") for i in range(9, 15)]
    rows += [(15, "no scheme", article.format(15, LONG), "")]
    pages = spark.createDataFrame(rows, SCHEMA)
    (host,) = winning_paths(pages).collect()
    assert (host.host, host.winner, sorted(host.paths)) == ("h.example", "body/div", ["body", "body/div"])
    texts = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert texts[0] == f"prose 0 {LONG}" and texts[9] == f"prose 9 {LONG}"
    for i in (6, 7, 8, 15):
        assert texts[i] == f"Updated {i} May\n{LONG} {i}"


WRAPPERS = [
    "<div class='wrapper has-sidebar'>", "<div class='post comments-open'>", "<div class=overflow-hidden>",
    "<div id=page class='with-header sticky-menu'>", "<section class='search-engines'>", "<div class=sticky-menu><div class=ad-free>",
]
COMMENTS = f"<ol class=comments><li><article>{LONG} {LONG}</article></ol>"
CONTENTS = {
    f"<p>{LONG}</p>": LONG,
    f"<h1>T</h1><p>{LONG}</p><div class=ad>Buy</div>": f"T\n{LONG}",
    f"<article>{LONG}</article>{COMMENTS}<div class=menu>Menu</div>": LONG,
    f"<main><div class=share>x</div>{LONG}</main>": LONG,
}


@pytest.mark.parametrize("content", CONTENTS, ids=range(len(CONTENTS)))
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_noise_words_on_a_wrapper(wrapper, content):
    page = f"<body><div class=topbar>Top of page</div>{wrapper}{content}</body>"
    assert extract(page, None)[0] == CONTENTS[content]


def test_noise_words_beside_the_article():
    """Two wrapped articles stay; long comments, cookies and a marked span go."""
    two = f"<main><div class=post-widget><article>a {LONG}</article></div><div class=post-widget><article>b {LONG}</article></div></main>"
    assert extract(two, None)[0] == f"a {LONG}\nb {LONG}"
    page = f"<article>Short <span class=ad>buy</span> one</article>{COMMENTS}<div class=cookies>We use cookies</div>"
    assert extract(page, None)[0] == "Short one"
    header = f"<div class=page-header><h1>Title</h1><ul class=breadcrumb><li>Home</ul></div><div>{LONG}</div>"
    assert extract(header, None)[0] == f"Title\n{LONG}"
    forum = f"<main><p>Thread</p><div class=discussion>{LONG}</div></main>"
    assert extract(forum, None)[0] == f"Thread\n{LONG}"
