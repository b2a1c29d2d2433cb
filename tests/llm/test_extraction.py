import re
import time
from html import unescape

from epochal.llm.extraction import extracted, main_text, op3_html_extraction

SF = "/root/testdata/sf0.001"


def test_article_of_each_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op3_html_extraction(spark, SF).collect():
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = [re.sub(r"\s+", " ", unescape(re.sub("</?b>|<br>", " ", x))).strip() for x in re.split("</?(?:p|h1|h2)>", inner)]
        assert r.text == "\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_cases(spark):
    body = "A sentence that is long enough to be the main text of this page, twice over."
    page = f"<body><div class='sidebar'>x y z</div><form>f</form><p>{body}</p><p>Short &amp; end.</p><div id=comments><p>{body}</p></div><aside>{body}</aside></body>"
    assert main_text(page) == f"{body}\nShort & end."
    assert main_text("") == "" and main_text("<p>a") == "a" and main_text("plain  text") == "plain text"
    df = spark.createDataFrame([(1, None, None, 1), (1, "u", "<p>" + "w " * 100000, 2)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in extracted(df).collect()) == [0, 199999]
    assert extracted(df.limit(0)).count() == 0


def test_named_elements_around_the_text_stay():
    body = "A sentence that is long enough to be the main text of this page, twice over."
    inner = f"<p>{body}</p><p>{body}</p>"
    for wrap in ("<div class='site no-sidebar'>{}</div>", "<div class='post has-comments'>{}</div>", "<div class='sidebar-page'><div class=sidebar>x y</div>{}</div>", "<form id='aspnetForm'>{}</form>"):
        assert main_text(f"<body>{wrap.format(inner)}</body>") == f"{body}\n{body}", wrap
        assert main_text(f"<body>{wrap.format('<article>' + inner + '</article>')}<div class=comments>{inner * 4}</div></body>") == f"{body}\n{body}", wrap
    assert main_text(f"<body><p>{body}</p><div id=comments>{inner * 4}</div><div class=related><p>{body}</p></div></body>") == body


def test_pages_without_an_article():
    body = "A sentence that is long enough to be the main text of this page, twice over."
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6)) + "</ul>"
    parts = ["<h1>Title of the page</h1>", "<p>By A.</p>", "<p>Short.</p>", "<p>S.</p>", f"<p>{body}</p>", f"<div>{body} <a href=x>with a link</a></div>", "<p>E.</p>", f"<p>{body}</p>"]
    want = "\n".join(["Title of the page", "By A.", "Short.", "S.", body, f"{body} with a link", "E.", body])
    foot = "<div><a href=a>About</a> | <a href=b>Contact</a></div><div><a href=c>Terms</a></div><div><a href=d>Jobs</a></div>"
    assert main_text(f"<body>{menu}{''.join(parts)}{foot}</body>") == want
    assert main_text(f"<body><div class='post-content share-enabled'>{menu}{''.join(parts)}</div>{foot}</body>") == want
    assert main_text(f"<body>{menu}<p data-id='menu'>{body}</p><p>{body}</p>{foot}</body>") == f"{body}\n{body}"


def test_the_windows_cut_where_text_is_thin():
    """Without an article or heading, surge and dive alone decide."""
    body = "A sentence that is long enough to be the main text of this page, twice over."
    thin = "".join(f"<div><a href=/{i}>Link number {i} with a rather long text that isn't prose</a></div>" for i in range(8))
    assert main_text(f"<body>{thin}<div>{body}</div><div>Short.</div><div>{body}</div>{thin}</body>") == f"{body}\nShort.\n{body}"


def test_two_articles():
    body = "A sentence that is long enough to be the main text of this page, twice over."
    links = "<div><a href=x>More</a></div>" * 3
    assert main_text(f"<article><p>Hi.</p><p>{body}</p></article>{links}<article><p>Bye.</p></article>{links}") == f"Hi.\n{body}\nBye."


def test_names_inside_an_article_are_anchors():
    body = "A sentence that is long enough to be the main text of this page, twice over."
    page = f"<article><h1>Title</h1><p>{body}</p><h2 id='related-work'>Related work</h2><p>{body}</p><section id='notice'><p>{body} Noted.</p></section><p class='share'>we share this</p><section class=comments><p>{body} Said.</p></section><p class='advert'>Buy.</p><div class=related><p>More.</p></div><p>End.</p></article>"
    assert main_text(page).split("\n") == ["Title", body, "Related work", body, f"{body} Noted.", "we share this", "End."]


def test_deep_pages_take_time_in_proportion():
    for unit in ("<form><p>x", "<div class=menu>x", "<b>x", "</i>x<u>", "<p>x</div>"):
        took = []
        for n in (4000, 16000):
            began = time.process_time()
            main_text(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.3, unit


def test_repeated_rows_give_repeated_results(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b c", "x")] * 3, "page_id long, url string, html string, text string")
    assert [tuple(r) for r in extracted(df).collect()] == [(1, "u", "a b c", 5)] * 3
