"""Selection, extraction and sanitizing on small pages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import markup
from newsloom.functions.columns import pin
from newsloom.functions.rules import RuleSet
from newsloom.functions.selectors import SelectorError, css, node_value, xpath
from newsloom.operators import extract
from newsloom.operators.extract import Field, Recipe

# A timetable: every row of a table is a card, the header row is none.
TIMETABLE = """<html><head><title>Quay</title><base href="https://quay.example/board/"></head><body><table>
<tr><th>Line</th><th>Leaves</th></tr>
<tr class="trip"><td><a href="line/7?seat=any#top">Line 7 &ndash; Nordö</a></td><td><span datetime="2030-08-19T05:20:00+02:00">early</span></td></tr>
<tr class="trip"><td><a href="/line/12">Line 12</a></td><td><span>20 August 2030</span></td></tr></table></body></html>"""
TRIPS = Recipe(items="tr.trip", title=Field("td:first-child"), link=Field("a"), date=Field("span"))
TRIPS_X = Recipe(kind="xpath", items="//tr[@class='trip']", title=Field("./td[1]"), link=Field("./td/a/@href"), date=Field(".//span"))


def capture(spark, html, url="https://example.com/news/page"):
    rows = [(1, "f", url, html, datetime(2031, 3, 10, 8))]
    return spark.createDataFrame(rows, "page_id long, feed_id string, url string, html string, captured_at timestamp")


def texts(spark, html, selector, kind="css"):
    n = F.col("nodes")
    found = xpath(n, selector) if kind == "xpath" else css(n, selector)
    df = capture(spark, html).select(markup.page_nodes("html").alias("nodes"))
    return df.select(pin(F.transform(found, lambda m: node_value(n, m)))).first()[0]


@pytest.mark.parametrize("recipe", [TRIPS, TRIPS_X], ids=["css", "xpath"])
def test_rows_of_a_table_as_cards(spark, recipe):
    rows = extract.stories(extract.read_pages(capture(spark, TIMETABLE), recipe)).orderBy("pos").collect()
    assert [r.title for r in rows] == ["Line 7 – Nordö", "Line 12"]
    assert [r.url for r in rows] == ["https://quay.example/board/line/7?seat=any", "https://quay.example/line/12"]
    # The attribute of the first is read as it is, the text of the second as a named date.
    assert [r.published for r in rows] == [datetime(2030, 8, 19, 3, 20), datetime(2030, 8, 20)]
    assert [r.html for r in rows] == ["", ""]


def test_markup_is_sanitized(spark):
    page = """<dl><dt>Jam</dt><dd onclick="a()">Boil <kbd>2</kbd> hours<style>b{}</style><a href="vbscript:b()">how</a> <a href="/jam?x=1&amp;y=2" target="_blank">more</a><object>c</object></dd></dl>"""
    row = extract.stories(extract.read_pages(capture(spark, page), Recipe(items="dl", title=Field("dt"), content=Field("dd")))).first()
    assert row.html == '<dd>Boil  hours how <a href="https://example.com/jam?x=1&amp;y=2" rel="nofollow">more</a></dd>'.replace("Boil  hours ", "Boil 2 hours")


@pytest.mark.parametrize(
    "tag, want",
    [
        ('<img src="data:,x" data-lazy-src="/pot.webp">', "https://example.com/pot.webp"),
        ('<img srcset="/pot-1.png 1x, /pot-2.png 2x, /pot-3.png 3x">', "https://example.com/pot-3.png"),
        ('<img src="pot.gif">', "https://example.com/news/pot.gif"),
        ("<img alt=none>", ""),
    ],
)
def test_image_of_a_card(spark, tag, want):
    pages = extract.read_pages(capture(spark, f"<figure><figcaption>Pot</figcaption>{tag}</figure>"), Recipe(items="figure", title=Field("figcaption")))
    assert extract.stories(pages).first().image == want


def test_attribute_description_is_escaped_and_warned(spark):
    page = '<p title="One" data-note="5 &lt; 6">x</p><p title="Two">y</p>'
    pages = extract.read_pages(capture(spark, page), Recipe(items="p", title=Field(".", "title"), content=Field(".", "data-note")))
    assert [r.html for r in extract.stories(pages).orderBy("pos").collect()] == ["5 &lt; 6", ""]
    assert [r.warning for r in extract.card_warnings(pages).collect()] == ['Match 2: Content should be text or markup, found attribute "data-note" is missing; published without description']


def test_cleanup_and_emptied_blocks(spark):
    page = '<article><h2>T</h2><div class="s"><p class="ad">x <i>y</i></p><p>keep</p></div></article><article><h2>U</h2><div class="s"><p class="ad">only</p></div></article>'
    recipe = Recipe(items="article", title=Field("h2"), content=Field(".s"), remove=(".ad",))
    pages = extract.read_pages(capture(spark, page), recipe)
    assert [r.html for r in extract.stories(pages).orderBy("pos").collect()] == ["<div><p>keep</p></div>", ""]
    assert extract.card_warnings(pages).first().warning == "Match 2: the cleanup rules left nothing of the description"
    inside = Recipe(items="article", title=Field("h2"), content=Field(".s"), remove=("./p[@class='ad']",), kind="xpath")
    inside = Recipe(**{**inside.__dict__, "items": "//article", "title": Field(".//h2"), "content": Field(".//div[@class='s']")})
    assert [r.html for r in extract.stories(extract.read_pages(capture(spark, page), inside)).orderBy("pos").collect()] == ["<div><p>keep</p></div>", ""]


def test_rejects_duplicates_and_rules(spark):
    page = '<li><a href="/1">One</a></li><li><a href="javascript:x">Two</a></li><li><a href="/3"></a></li><li><a href="/1">Again</a></li><li><a href="/5">Spam five</a></li>'
    recipe = Recipe(items="li", title=Field("a"), link=Field("a"), rules=RuleSet(exclude={"op": "contains_any", "field": "title", "keywords": ["SPAM"]}))
    pages = extract.read_pages(capture(spark, page), recipe)
    assert [(r.pos, r.key) for r in extract.stories(pages).collect()] == [(0, "https://example.com/1")]
    assert [tuple(r)[1:] for r in extract.rejected_cards(pages).orderBy("card").collect()] == [(2, "no usable address"), (3, "no title")]
    out = extract.page_outcomes(pages).first()
    assert (out.matches, out.valid, out.filtered, out["items"], out.error) == (5, 2, 1, 1, None)
    assert extract.filter_examples(pages).first().title == "Spam five"


def test_page_without_valid_cards_fails(spark):
    out = extract.page_outcomes(extract.read_pages(capture(spark, "<p>none</p>"), Recipe(items="li", title=Field("a")))).first()
    assert out.error == "none of 0 matches is a story"


PAGE = """<ul id="m"><li class="a b">one<li class="b">two <b>bold</b></li><li data-k="v-w">three</li></ul>
<div><p>p1<p>p2<div class="x">d</div></div><table><tr><td>1<td>2</table><script>if (a < b) "</p>"</script>"""


@pytest.mark.parametrize(
    "selector, want",
    [
        ("li", ["one", "two bold", "three"]),
        ("li.a.b", ["one"]),
        ("#m > li:nth-child(2n+1)", ["one", "three"]),
        ("li:last-child, li.a", ["one", "three"]),
        ("li + li", ["two bold", "three"]),
        ("li.a ~ li", ["two bold", "three"]),
        ("li:not(.b)", ["three"]),
        ("li:has(b)", ["two bold"]),
        ("li:contains('TWO')", ["two bold"]),
        ('[data-k^="v"]', ["three"]),
        ('[data-k|="v"]', ["three"]),
        ("div > p", ["p1", "p2"]),
        ("table tbody tr > td:nth-of-type(2)", ["2"]),
        ("div p + div.x", ["d"]),
    ],
)
def test_css(spark, selector, want):
    assert texts(spark, PAGE, selector) == want


@pytest.mark.parametrize(
    "path, want",
    [
        ("//li[2]", ["two bold"]),
        ("//ul/li[last()]", ["three"]),
        ("//li[contains(@class,'a') or @data-k]", ["one", "three"]),
        ("//li[not(b)]/text()", ["one", "three"]),
        ("//li/@data-k", ["v-w"]),
        ("//li[contains(.,'bold')]/b", ["bold"]),
        ("//b/..", ["two bold"]),
        ("//td[position()>1] | //li[1]", ["one", "2"]),
        ("//li[starts-with(normalize-space(.),'thr')]", ["three"]),
        ("//li[@class='b']/following-sibling::li", ["three"]),
    ],
)
def test_xpath(spark, path, want):
    assert texts(spark, PAGE, path, "xpath") == want


@pytest.mark.parametrize("bad", ["li >", "li:nope", "a[", "li:nth-child(x)"])
def test_bad_selectors_are_refused(spark, bad):
    with pytest.raises(SelectorError):
        texts(spark, PAGE, bad)


def test_article_outcomes(spark):
    page = '<base href="https://example.com/n/"><main class="body" data-b="&lt;p&gt;x"><h1>H</h1><p onclick="x()">B <a href="r.html">l</a></p><script>1</script></main><iframe class="f"></iframe>'

    def run(selector, attr="", remove=()):
        df = extract.article_bodies(capture(spark, page), Recipe(article=Field(selector, attr), remove=remove))
        return tuple(df.select("body", "failure").first())

    assert run(".body") == ('<h1>H</h1><p>B <a href="https://example.com/n/r.html" rel="nofollow">l</a></p>', None)
    assert run(".body", "data-b") == ("<p>x</p>", None)
    assert run(".gone") == ("", "the article selector found nothing")
    assert run(".body", remove=("h1", "p")) == ("", "the cleanup rules left nothing of the article")
    assert run(".f") == ("", None)
