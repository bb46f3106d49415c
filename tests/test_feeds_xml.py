"""Syndication documents of three dialects, including what feeds get wrong."""

import hashlib

from newsloom.operators.extract import Recipe
from newsloom.sources import captures as C
from newsloom.sources import entries as E

CONTENT, MEDIA, ATOM = "http://purl.org/rss/1.0/modules/content/", "http://search.yahoo.com/mrss/", "http://www.w3.org/2005/Atom"


def rss(*items):
    return f'<rss version="2.0" xmlns:content="{CONTENT}" xmlns:media="{MEDIA}"><channel>{"".join(f"<item>{i}</item>" for i in items)}</channel></rss>'


def atom(*entries, base=""):
    return f'<feed xmlns="{ATOM}"{base}>{"".join(entries)}</feed>'


def docs(spark, **bodies):
    return spark.createDataFrame([(k, "https://n.example/feed.xml", v) for k, v in bodies.items()], "doc_id string, url string, body string")


def stories(spark, recipe=None, **bodies):
    fields = E.entry_fields(E.explode_entries(E.feed_documents(docs(spark, **bodies))))
    return E.entry_stories(fields, recipe or Recipe())


def guid(text):
    return "guid:" + hashlib.sha256(text.encode()).hexdigest()


def only(spark, body, recipe=None):
    return stories(spark, recipe, one=body).orderBy("ord").first()


def test_identity_is_the_guid_then_the_link_then_the_title(spark):
    body = rss("<title>a</title><guid isPermaLink='false'>k</guid><link>/a</link>", "<title>b</title><link>/b#frag</link>", "<title>c</title>")
    keys = [r.key for r in stories(spark, one=body).orderBy("ord").collect()]
    assert keys == [guid("k"), "https://n.example/b", "title:" + hashlib.sha256(b"c").hexdigest()]


def test_a_permanent_id_stands_in_for_the_link(spark):
    body = rss("<title>t</title><guid>https://n.example/lasting</guid>", "<title>t</title><guid isPermaLink='false'>https://n.example/other</guid>")
    assert [r.url for r in stories(spark, one=body).orderBy("ord").collect()] == ["https://n.example/lasting", ""]


def test_title_markup_and_references(spark):
    assert only(spark, rss("<title>Tea &amp;amp; <![CDATA[<em>milk</em>]]></title><link>/t</link>")).title == "Tea & milk"
    assert only(spark, rss("<title>Why &lt;table&gt; stays</title><link>/t</link>")).title == "Why <table> stays"
    assert only(spark, rss("<description>No heading, only &amp;lt;3 words</description>")).title.startswith("No heading, only")


def test_full_text_goes_before_the_summary(spark):
    item = "<title>t</title><link>/t</link><description>short</description><content:encoded><![CDATA[<ol><li>long<script>x</script></li></ol>]]></content:encoded>"
    assert only(spark, rss(item)).html == "<ol><li>long</li></ol>"


def test_pictures_inside_a_description_but_no_pixels(spark):
    pixel, photo = '<img src="/px.gif" width="1" height="1">', '<img src="/boat.jpg">'
    assert only(spark, rss(f"<title>t</title><link>/t</link><description><![CDATA[{pixel}<p>b</p>{photo}]]></description>")).image == "https://n.example/boat.jpg"


def test_a_thumbnail_is_put_before_the_text(spark):
    row = only(spark, rss("<title>t</title><link>/t</link><description>words</description><media:thumbnail url='https://c.example/i.png?w=9&amp;h=9'/>"))
    assert row.image == "https://c.example/i.png?w=9&h=9" and row.html == '<p><img src="https://c.example/i.png?w=9&amp;h=9" alt=""></p>words'


def test_dates_of_three_dialects(spark):
    assert str(only(spark, rss("<title>t</title><pubDate>Fri, 3 Jan 2031 23:05:00 EST</pubDate>")).published) == "2031-01-04 04:05:00"
    assert str(only(spark, atom("<entry><title>t</title><id>urn:1</id><updated>2031-01-03T23:05:00+01:00</updated></entry>")).published) == "2031-01-03 22:05:00"
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><item rdf:about="https://r.example/1"><title>t</title><dc:date>2031-01-03</dc:date></item></rdf:RDF>'
    row = only(spark, rdf)
    assert str(row.published) == "2031-01-03 00:00:00" and row.key == guid("https://r.example/1")


def test_what_is_wrong_with_entries(spark):
    body = rss("<title>a</title><link>ftp://x</link>", "<title>b</title><guid>g</guid>", "<title>c</title><guid>g</guid>", "<title>d</title><pubDate>soon</pubDate>", "")
    assert [r.warning for r in E.entry_warnings(stories(spark, one=body)).orderBy("ord").collect()] == [
        "Entry 1 left out: its link is no web address",
        "Entry 3 left out: an earlier entry has its identity",
        'Entry 4: unreadable date "soon"; dated by its first listing',
        "Entry 5 left out: neither title nor description",
    ]


def test_cleanup_rules_on_descriptions(spark):
    body = rss("<title>t</title><link>/t</link><description><![CDATA[<div class='ad'>buy</div><p>read</p>]]></description>")
    assert only(spark, body, Recipe(remove=(".ad",))).html == "<p>read</p>"
    gone = only(spark, body, Recipe(remove=("div", "p")))
    assert gone.html == "" and gone.emptied and gone.title == "t"


def test_atom_bases_and_relations(spark):
    entry = "<entry xml:base='june/'><title type='html'>&lt;b&gt;Sun&lt;/b&gt; day</title><link rel='self' href='x'/><link href='4.html'/><id>urn:4</id><content type='xhtml'><div xmlns='http://www.w3.org/1999/xhtml'><p><a href='5.html'>next</a></p></div></content></entry>"
    row = only(spark, atom(entry, base=" xml:base='https://d.example/log/'"))
    assert row.url == "https://d.example/log/june/4.html" and row.title == "Sun day"
    assert row.html == '<div><p><a href="https://d.example/log/june/5.html" rel="nofollow">next</a></p></div>'


def test_atom_content_elsewhere_leaves_the_summary(spark):
    row = only(spark, atom("<entry><title>Plain &lt;i&gt;</title><id>https://d.example/9</id><content src='https://d.example/9.pdf' type='application/pdf'/><summary>1 &lt; 2</summary></entry>"))
    assert row.title == "Plain <i>" and row.html == "1 &lt; 2" and row.url == "https://d.example/9"


def test_undeclared_prefixes_and_what_follows_the_root(spark):
    row = only(spark, "<rss><channel><item><title>t</title><content:encoded>&lt;p&gt;w&lt;/p&gt;</content:encoded><dc:date>2031-02-01T00:00:00Z</dc:date></item></channel></rss><!-- x --><hr>")
    assert row.html == "<p>w</p>" and str(row.published) == "2031-02-01 00:00:00"


def test_document_outcomes(spark):
    many = "<rss><channel>" + "<item><title>t</title></item>" * 1003 + "</channel></rss>"
    bodies = dict(many=many, empty="<rss><channel></channel></rss>", page="<html><body>x</body></html>", broken="<?xml version='1.0'?>\n<rss><channel>\n<item></rss>")
    rows = {r.doc_id: r for r in E.document_outcomes(E.feed_documents(docs(spark, **bodies))).collect()}
    assert rows["many"].entries == 1000 and rows["many"].warning == "3 more entries were left out"
    assert rows["empty"].error is None and rows["empty"].warning == "no entries listed"
    assert rows["page"].error == "the document is no RSS, RDF or Atom feed"
    assert rows["broken"].error == "broken XML in line 3"


def test_charsets(spark):
    cases = [
        ("text/html; charset=windows-1252", b"Caf\xe9", "Café"),
        ("text/html", b"<meta charset=iso-8859-1>\x93x\x94", "<meta charset=iso-8859-1>“x”"),
        ("text/html; charset=iso-8859-1", "Café crème".encode(), "Café crème"),
        ("text/html", b"\xfe\xff\x00C\x00a", "Ca"),
        ("text/html; charset=euc-kr", b"\xc7\xd1\xb1\xb9", "한국"),
        ("text/html; charset=shift_jis", "今日はとても良い天気ですね。".encode("shift_jis"), "今日はとても良い天気ですね。"),
        ("text/html; charset=x-made-up", b"<meta charset=x-none><meta charset=windows-1252>\xe9", "<meta charset=x-none><meta charset=windows-1252>é"),
        ("text/html", b" " * 1024 + b"<meta charset=windows-1252>ok", " " * 1024 + "<meta charset=windows-1252>ok"),
        ("text/html", b'<META HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=Shift_JIS">\x93\xfa', '<META HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=Shift_JIS">日'),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "n int, content_type string, body binary")
    assert [r.html for r in C.decode_captures(df).orderBy("n").collect()] == [w for _, _, w in cases]


def test_xml_repair(values):
    got = values(["a\x0bb&#11;c&#x1F;&#xFFFE;d&#10;&#65;&#55300;"], E.repair_xml)
    assert got == ["abcd&#10;&#65;"]
