import html
import re

from strataloom.llm import html_text, queries


def test_query_equals_template(spark, sf):
    """The test pages keep their text in one article of headings and paragraphs."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        clean = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts)
        assert r.text == "\n".join(x for x in clean if x)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


POST = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, all kinds. Accept.</div>
<div class="layout"><div class="main-menu"><ul><li><a>Home</a><li><a>About</a></ul></div><div class="post"><h2>Title</h2>
<p>First paragraph, with text. And more &amp; more, of course.<p>Second &eacute;&#8212;paragraph; longer
  than   one would think, really.<ul><li>item one, yes<li>item two</ul><form><p>Sign up, now. Please.</p></form><!-- no, no --><p>Be.</p>
<script>if (a < b) document.write("</p><p>no.</p>")</script><style>p > a {}</style><p>La<b>st</b> <i>one</i>, here.</p></div>
<div class="sidebar"><p>Side text, here. And there.</p></div><div class="comments"><p>Great post, thanks, really nice. Truly.</p></div></div>
<footer><p>Copyright, all of it.</p></footer></body></html>"""


def test_untemplated_page():
    assert html_text.main_text(POST).split("\n") == [
        "Title", "First paragraph, with text. And more & more, of course.", "Second é—paragraph; longer than one would think, really.",
        "item one, yes", "item two", "Be.", "Last one, here."]


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "plain text, no tags"), (4, "<p>open <b>bold"), (5, "<script>x"), (6, "<!-- never closed <p>x</p>"), (7, "<div>" * 3000 + "deep, deep." + "</div>" * 10),
            (8, "a < b and c > d"), (8, "a < b and c > d"), (9, "<p>" + "w, " * 200_000 + "</p>"), (None, "<p>x</p>")]
    df = spark.createDataFrame([(i, h, "clash", "u") for i, h in rows], "page_id long, html string, text string, n_chars string")
    got = sorted(((r.page_id or 0, r.text) for r in html_text.extract(df).collect()), key=repr)
    assert got[:6] == [(0, "x"), (1, ""), (2, ""), (3, "plain text, no tags"), (4, "open bold"), (5, "")]
    assert dict(got)[7] == "deep, deep." and len(dict(got)[9]) == 599_999 and [g for g in got if g[0] == 8] == [(8, "a < b and c > d")] * 2
    assert html_text.extract(df.limit(0)).collect() == []


def test_article_parts_whose_names_look_like_boilerplate():
    body = """<p>A first paragraph, with text. And more, of course.</p><h2 id="related-work">Related work</h2><p>Others, too, did this. Well.</p>
<section id="discussion"><p>We discuss it, at length. Here.</p></section><p id="legal">A legal point, in passing.</p>
<div class="search-results-text">Found, in all, three.</div><p>See <span class="notice">this remark</span>, please.</p>
<div class="share-bar">Share this, now.</div>"""
    want = ["A first paragraph, with text. And more, of course.", "Related work", "Others, too, did this. Well.", "We discuss it, at length. Here.",
            "A legal point, in passing.", "Found, in all, three.", "See this remark, please."]
    for tag in ("article", "div"):
        page = f"<body><div class='menu'>Home, about.</div><{tag}>{body}</{tag}><div id='cookie-notice'>Cookies, all kinds. Accept.</div></body>"
        assert html_text.main_text(page).split("\n") == want


UNNAMED = """<html><body><div><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Shop</a></li></ul></div>
<div><div><h1>The title</h1><p>A first paragraph of some length, with commas, and a full stop. And one more sentence, here.</p>
<p>Short one.</p><h2>Part two</h2><p>The second paragraph, which is long enough too, has some marks; and it goes on, for a while.</p>
text of its own, after it all.</div></div><div><span>Read next: ten more things</span></div><div>All rights reserved</div></body></html>"""


def test_paths_choose_the_node_where_nothing_has_a_name(monkeypatch):
    want = ["The title", "A first paragraph of some length, with commas, and a full stop. And one more sentence, here.", "Short one.", "Part two",
            "The second paragraph, which is long enough too, has some marks; and it goes on, for a while.", "text of its own, after it all."]
    assert html_text.main_text(UNNAMED).split("\n") == want
    # with a constant score every path is content, and short texts in large numbers outweigh the article
    many = UNNAMED.replace("<li>", "<li>Go to another page of ours</li><li>" * 12, 1)
    assert html_text.main_text(many).split("\n") == want
    monkeypatch.setattr(html_text, "THRESHOLD", -1.0)
    assert html_text.main_text(many).split("\n") != want


def test_time_in_proportion_to_the_page():
    import time

    n = 60_000
    odd = ["<a " * n, "<a \"> " * n, "<div>" * n + "x", "<div>t" * n, "<div>" * n + "</section>" * n, "<b>" * n + "</i>" * n + "x", "<li><div>" * n + "x", "<p>a" * n,
           "<a '\">x\" y " * n + ">", "<div class=" + " " * n + "x>y", "<" * n, "&" * n, "<!--" * n, "<script>" * n]
    start = time.process_time()
    for page in odd:
        html_text.main_text(page)
    assert time.process_time() - start < 60


def test_blocks_of_nested_elements_stay_in_page_order():
    page = "<article>one, two.<div>three, four.<p>five, six.</p>seven, eight.</div>nine, ten.</article>"
    assert html_text.main_text(page).split("\n") == ["one, two.", "three, four.", "five, six.", "seven, eight.", "nine, ten."]


ARTICLE = "<article><h1>Head</h1><p>A first paragraph, with text. And more, of course.</p><p>A second one, with as much, or nearly so.</p></article>"
TEXT = ["Head", "A first paragraph, with text. And more, of course.", "A second one, with as much, or nearly so."]
AROUND = "<div class='menu'><a>Home</a> <a>About</a></div>{}<div class='comments'><p>Nice one, really. Thanks!</p></div><footer>All rights, reserved.</footer>"


def test_wrappers_whose_names_look_like_boilerplate():
    """A name does not judge what holds the article."""
    for page in (f'<div class="content with-sidebar">{ARTICLE}</div>', f'<div id="page" class="no-sidebar layout">{ARTICLE}</div>', f'<div class="two-col sidebar-left">{ARTICLE}</div>',
                 f'<div class="page-with-ads"><main>{ARTICLE[9:-10]}</main></div>', f'<form id="aspnetForm">{ARTICLE}</form>', f'<div class="sidebar">{ARTICLE}</div>',
                 f'<div class="widget"><div class="post">{ARTICLE[9:-10]}</div></div>'):
        assert html_text.main_text(f"<body>{AROUND.format(page)}</body>").split("\n") == TEXT


def test_parts_of_an_article_with_telling_names():
    inside = '<div class="promotion"><p>A promotion at work, they say, is never a gift; it is earned.</p></div><p class="share">Each share of the firm, at its best, was worth ten.</p>'
    inside += '<div class="modal verb">A modal verb, such as can or may, says how likely a thing is.</div>'
    want = [*TEXT, "A promotion at work, they say, is never a gift; it is earned.", "Each share of the firm, at its best, was worth ten.",
            "A modal verb, such as can or may, says how likely a thing is."]
    page = ARTICLE.replace("</article>", inside + '<div class="ad">Buy it, now, at half of the price. Really, do it.</div><div class="share">Share this</div></article>')
    assert html_text.main_text(f"<body>{AROUND.format(page)}</body>").split("\n") == want


def test_comments_go_whatever_their_size():
    many = "".join(f"<li class='comment'><article><p>Comment {k}, which is long, and says a lot. Or not?</p></article></li>" for k in range(30))
    assert html_text.main_text(f"<body>{ARTICLE}<ol class='comment-list'>{many}</ol></body>").split("\n") == TEXT
    plain = "".join(f"<p>Comment {k}, which is long, and says a lot. Or not?</p>" for k in range(30))
    assert html_text.main_text(f"<body><div class='post'>{ARTICLE[9:-10]}</div><div id='comments'>{plain}</div></body>").split("\n") == TEXT


def brute_paths(found):
    """Content paths block by block: ratios per path, Gaussian weights, product, threshold at half the mean."""
    import math

    blocks = {}
    for s, e in found:
        n, size, marks = blocks.get(e.path, (0, 0, 0))
        blocks[e.path] = (n + 1, size + len(s), marks + sum(c in ".,;:!?。，、；：！？…" for c in s))
    text, mark = ([blocks[e.path][k] / blocks[e.path][0] for _, e in found] for k in (1, 2))
    reach = 2 if len(found) >= 5 else len(found)

    def smooth(v, i):
        near = [(math.exp(-0.5 * (i - j) ** 2), v[j]) for j in range(len(v)) if abs(i - j) <= reach]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    score = [smooth(text, i) * (1 + smooth(mark, i)) for i in range(len(found))]
    least = 0.5 * sum(score) / len(score)
    assert all(abs(s - least) > 1e-9 * least for s in score)
    return {e.path for s, (_, e) in zip(score, found) if s >= least}


def test_content_paths_equal_brute_force(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + [POST, UNNAMED, AROUND.format(ARTICLE), "<p>a, b.</p><div>c</div>", "one"]
    for page in pages:
        found, _ = html_text.blocks(page)
        assert html_text.content_paths(found) == brute_paths(found)
