import html
import re

import pytest
from snapscope.llm import extract

CASES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"),
    ("<article><h1>T</h1><p>One\n two</p>\n<p>By.</p><div class='ad'>Buy</div><p>Three <a href=x>link</a>.</p></article><footer>F</footer>", "T One two By. Three link."),
    ("<nav>menu</nav><div id='main-content'><h2>Head</h2><p>Some long text of the page, long enough to weigh.</p><aside>no</aside><p>And more of it &lt;here&gt;.</p></div><div class='comments'><p>me too</p></div>",
     "Head Some long text of the page, long enough to weigh. And more of it <here>."),
    ("<main><p>a<script>if (a < b) { '</p>' }</script>b</p><style>p{}</style><form>f<input></form><section class=\"reader-comments\">c</section></main>", "ab"),
    ("<article><p>open <b>bold<p>next</article>", "open bold next"), ("<article>x<!-- <p>no</p> -->y</article>", "xy"),
    ("<article><p>1 < 2 &#233; &nbsp; z</p></article>", "1 < 2 é z"), ("<ARTICLE><P>caps</P></ARTICLE>", "caps"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one two c1 c2"),
    ("<article><div class=sidebar><div>in</div></div><p>out</p></article>", "out"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert extract.main_text(page or "") == text


def test_agrees_with_the_article_element_on_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract.extracted(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        want = " ".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split(r"<[^>]*>", inner)) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_rows_as_they_come(spark):
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    pages = spark.createDataFrame([(1, None, None, "t"), (1, "u", "", "t"), (None, "u", long, "t"), (2, "u", "<div>" * 5000 + "deep", "t")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.n_chars) for r in extract.extracted(pages).collect())
    assert got == sorted([("1", 0), ("1", 0), ("None", 500_000 - 1), ("2", 4)])
    assert extract.extracted(pages.limit(0)).count() == 0


def test_surge_and_dive():
    assert extract.runs_of([0, 5, 0, 0, 0, 7, 0, 1]) == [(1, 4, 5), (5, 8, 8)]
    assert extract.runs_of([]) == [] and extract.runs_of([0, 0]) == []


def test_unmarked_pages_keep_short_sections_and_what_follows_an_advert():
    long, tail = "long words of it " * 120, "closing words " * 28
    page = (f"<nav><a href=x>menu</a></nav><div><section><h2>First</h2><p>A short one.</p></section><section><h2>Second</h2><p>{long}</p>"
            f"<div class='advert'>Buy</div><p>{tail}</p></section><section><h2>Third</h2><p>Short too.</p></section></div><footer>F</footer>")
    assert extract.main_text(page) == f"First A short one. Second {long}{tail}Third Short too."


LONG = "A long article that goes on for a while, with many words in it. " * 4


@pytest.mark.parametrize("text", [f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p>", f"<div>{LONG}</div>", LONG, f"<h1>Title</h1><div>{LONG}</div>"])
@pytest.mark.parametrize("outer", ["{}", "<body>{}</body>", "<div id=page>{}</div>"])
def test_plain_menus_and_footers_of_unmarked_pages_go(text, outer):
    gap = "<br>" * 8
    page = outer.format(f"<div>Home</div><div>Products</div>{gap}{text}{gap}<div>Copyright 2020 Acme</div>")
    want = " ".join(x for x in (t.strip() for t in re.split(r"<[^>]*>", text)) if x)
    assert extract.main_text(page) == want


def test_lists_of_links_around_the_text_go():
    links = "".join(f"<li><a href=/{k}>Section number {k}</a></li>" for k in range(30))
    assert extract.main_text(f"<ul>{links}</ul><br><br><p>{LONG}</p><br><br><ul>{links}</ul>") == LONG.strip()
    assert extract.main_text(f"<p>{LONG}<a href=x>with a link</a></p>") == LONG + "with a link"


def test_names_count_as_a_whole():
    page = ("<article><p>One.</p><section class=\"legal-history\"><p>The law of 1820 said so.</p></section>"
            "<div class=\"form-of-government\"><p>A republic.</p></div><div class='search'>Find</div><div id=commentOn>On it.</div></article>")
    assert extract.main_text(page) == "One. The law of 1820 said so. A republic. On it."
    for name in ("site-footer", "sidebar_left", "readerComments", "article-comments", "ad-slot-3", "cookie-notice", "nav main"):
        assert extract.main_text(f"<article>x<div class='{name}'>{LONG}</div>y</article>") == "x y"
    for name in ("legal", "search-content"):  # more witness is needed
        assert extract.main_text(f"<article>x<div class={name}>{LONG}</div>y</article>") == f"x {LONG}y"
        assert extract.main_text(f"<article>x<div class={name}><a>{LONG}</a></div>y</article>") == "x y"
    for name in ("has-sidebar", "no-comments", "cookie-recipe"):
        assert extract.main_text(f"<div class={name}><p>{LONG}</p></div>") == LONG.strip()
    assert extract.main_text(f"<div class=overlay><main><p>{LONG}</p></main></div>") == LONG.strip()


def test_given_pages_without_their_article_tags(spark):
    """The title and all paragraphs stay; the menu, the advert and the footer go."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        assert extract.main_text(re.sub(r"</?article>", "", r.html)) == extract.main_text(r.html)
        bare = re.sub(r"<(/?)article>", r"<\1div>", r.html)
        assert extract.main_text(bare) == extract.main_text(r.html)


def test_deep_and_broken_markup_is_read_in_one_pass():
    assert extract.main_text("<b>" * 100_000 + "deep" + "</b>" * 100_000) == "deep"
    assert extract.main_text("<div class=ad>" * 50_000 + "no") == ""
    assert extract.main_text("<div>" * 50_000 + f"<p>{LONG}</p>" + "</div>" * 50_000) == LONG.strip()
