import re

from folio.llm.html_text import Page, main_text
from folio.llm.queries import read_table

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header>Site</header><nav><ul><li>Menu<li>More</ul></nav><!-- ad --><div class="ad box">Buy</div>
<article><h1>Head &eacute;</h1><p><b>One&nbsp; two<br><p>Three <i>four</i>&#33;</p><aside>Side</aside><ul><li>a<li>b</ul>
<div id="comments"><p>Nice</p></div><form>Send</form></article><footer>End</footer></body></html>"""


def test_one_page():
    assert Page(PAGE).text(frozenset()) == "Head é\nOne two\nThree four!\na\nb"
    assert Page("<p>plain <div>x</div> tail").text(frozenset()) == "plain\nx\ntail"
    assert Page("a < b & c &am").text(frozenset()) == "a < b & c &am"
    assert Page("<div>" * 5000 + "deep").text(frozenset()) == "deep"
    assert Page("").text(frozenset()) == "" and Page("<!-- open <p>x").text(frozenset()) == ""


def test_template_of_a_host_goes(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div><p>Own text {i}</p><p>Follow us</p></div><p>Tail {i % 3}</p></body>") for i in range(9)]
    rows += [(20 + i, f"http://other{i}.org/", "<p>Follow us</p>") for i in range(5)] + [(30, None, "<p>Follow us</p>"), (31, "http://h.org/", None), (32, "http://h.org/", ""), (None, "x", "<p>n</p>"), (30, None, "<p>Follow us</p>")]
    got = sorted((tuple(r) for r in main_text(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, host int")).collect()), key=str)
    want = [(i, u, f"Own text {i}\nTail {i % 3}" if i is not None and i < 9 else re.sub("<[^>]*>", "", h or "")) for i, u, h in rows]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_of_the_table(spark):
    import html

    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = main_text(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b), r.page_id


def test_copied_articles_stay_and_notices_of_large_hosts_go(spark):
    copy = "<body><div>Site links</div><article><h1>One head</h1><p>The copied text</p></article></body>"
    rows = [(i, f"http://copies.org/{i}", copy, "One head\nThe copied text") for i in range(8)]
    rows += [(10 + i, f"http://copies.org/v{i}", f"<article><h1>Head {i}</h1><p>Text {i}</p></article>", f"Head {i}\nText {i}") for i in range(4)]
    for i in range(300):  # a notice on 45 pages of 100
        notice = "<p>Subscribe to our letter</p>" if i % 100 < 45 else ""
        rows.append((100 + i, f"http://large.org/{i}", f"<article><p>Own {i}</p>{notice}</article>", f"Own {i}"))
    got = main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: r[3] for r in rows}


def test_one_article_on_different_pages_stays(spark):
    rows = [(i, f"http://six.org/{i}", f"<body><div>Links {i}</div><article><h1>One head</h1><p>The same text</p></article><p>Tail {i}</p></body>") for i in range(6)]
    for i in range(7):  # edited copies: one paragraph differs
        rows.append((10 + i, f"http://edited.org/{i}", f"<article><h1>Head of all</h1><p>A long paragraph that all the copies have in common</p><p>Edited {i}</p></article>"))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "One head\nThe same text" for i in range(6))
    assert all(got[10 + i] == f"Head of all\nA long paragraph that all the copies have in common\nEdited {i}" for i in range(7))


def test_quotes_matter_after_an_equals_sign_only():
    assert Page("<p data-x=it's>Hello</p>").text(frozenset()) == "Hello"
    assert Page('<p title="a > b" x=\'c>d\' "odd>One</p><p class=a"b>Two</p>').text(frozenset()) == "One\nTwo"
    assert Page('<p data-class="ad" title="class=ad">Kept</p><p class="ad">Gone</p><p CLASS=ad>Gone</p>').text(frozenset()) == "Kept"
    assert Page('<a href="open>lost').text(frozenset()) == ""


def test_nothing_of_the_article_is_lost_by_a_word():
    assert Page('<article><p class="related">One</p><p class="share">Two</p></article>').text(frozenset()) == "One\nTwo"
    assert Page('<article><div class="related"><p>All of it</p></div></article>').text(frozenset()) == "All of it"
    assert Page('<article><p>Text</p><div class="related"><p>More to read</p></div></article>').text(frozenset()) == "Text"
    assert Page("<article><p>Text</p><noscript><p>plain</p></noscript><object><p>inner</p></object><canvas>drawn</canvas></article>").text(frozenset()) == "Text\nplain\ninner\ndrawn"
    assert Page('<article><header class="header"><h1>Head</h1></header><p>Text</p></article>').text(frozenset()) == "Head\nText"


def text_of(source):
    return Page(source).text(frozenset())


def test_names_do_not_decide_on_the_article_or_what_holds_it():
    for source in ('<article class="post comments-open"><p>Own</p></article>', '<div class="has-sidebar"><article><p>Own</p></article></div>', '<main class="content no-sidebar"><p>Own</p></main>', '<body class="sidebar ad"><div id="comments"><main><p>Own</p></main></div></body>'):
        assert text_of(source) == "Own", source
    assert text_of('<article><p class="ad-free">One</p><p id="comment-on-law">Two</p><p>Three</p></article>') == "One\nTwo\nThree"
    assert text_of('<div class="social-history"><p>All of a page without an article</p></div>') == "All of a page without an article"
    assert text_of('<div class="sidebar"><p>Most of the words of a page without an article</p></div><p>Few words</p>') == "Most of the words of a page without an article\nFew words"
    assert text_of('<p>The text of the page</p><div class="comment-list"><p>Nice</p></div>') == "The text of the page"


def test_names_made_of_words_beside_the_text_go():
    for name in ("ad", "ad-box", "ads_1", "cookie-banner", "comment-list", "site-nav", "sidebar-left", "main-menu", "newsletter-form", "box ad"):
        assert text_of(f'<article><p>Own</p><div class="{name}"><p>Beside</p></div></article>') == "Own", name
    for tag in ("menu", "form", "aside", "nav", "footer", "script", "style"):
        assert text_of(f"<article><p>Own</p><{tag}>Beside</{tag}></article>") == "Own", tag
    assert text_of('<article><p>Own</p><div role="navigation">Beside</div></article>') == "Own"


def test_elements_that_are_no_forms_stay():
    assert text_of("<article><p>see <button>press</button> ok</p><dialog>said</dialog><svg><text>drawn</text></svg></article>") == "see press ok\nsaid\ndrawn"


def test_comments_end_where_html_ends_them():
    assert text_of("a<!--> b --> c") == "a b --> c"
    assert text_of("a<!---> b") == "a b" and text_of("a<!-- x --!> b") == "a b" and text_of("a<!-- - -> x --> b") == "a b"


def test_templates_are_those_of_a_plain_count(spark):
    """Subtrees by host against a count over distinct contents in plain Python."""
    import random
    from collections import defaultdict

    from folio.llm.html_text import LEAST_PAGES, MANY_PAGES, SHARE, templates

    rng, rows = random.Random(8), []
    for host in range(6):
        menus = [f"<nav><p>Menu {host} {i}</p></nav>" for i in range(3)]
        for i in range(rng.choice([4, 12, 40, 260])):
            body = "".join(rng.choice(menus + [f"<div><p>Shared {k}</p></div>" for k in range(4)]) for _ in range(3))
            rows.append((f"h{host}", f"<body>{body}<article><p>Own words number {rng.randrange(200)} {host}</p></article></body>"))
    seen, contents = defaultdict(set), defaultdict(set)
    for host, source in rows:
        page = Page(source)
        hashes = page.hashes()
        own, outside = page.contents(hashes)
        contents[host].add(own)
        for h, c in zip(hashes, outside):
            seen[host, h].add(c)
    want = {(host, h) for (host, h), c in seen.items() if h and len(c) >= LEAST_PAGES and (len(c) >= SHARE * len(contents[host]) or len(c) >= MANY_PAGES)}
    got = {tuple(r) for r in templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert got == want and want
