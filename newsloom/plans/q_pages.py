"""Queries over pages: scans, selection, extraction, images, dates, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates, images, markup, text, urls
from newsloom.functions.columns import first_of, pin
from newsloom.functions.rules import RuleSet
from newsloom.functions.selectors import css, document_union, node_value, xpath
from newsloom.operators import discovery, dom, extract, groups, keywords, recipe_table
from newsloom.operators.extract import Field, Recipe
from newsloom.plans import bindings as B
from newsloom.plans.registry import query
from newsloom.sources import captures as C
from newsloom.sources import entries as E

NAV = Recipe(items="nav li", title=Field("a"), link=Field("a"))
NAV_X = Recipe(items="//nav//li", title=Field(".//a"), link=Field(".//a/@href"), kind="xpath")


def nodes(spark, folder):
    return B.pages(spark, folder).select("page_id", "url", markup.page_nodes("html").alias("nodes"))


# ------------------------------------------------------------------ sources


@query(
    "S1_captures_scan",
    f"WITH {B.SQL_CAPTURES} SELECT page_id, feed_id, url, length(html) AS chars, captured_s AS captured_at FROM captures WHERE status=200 AND octet_length(encode(html))<=4194304",
)
def captures_scan(spark, folder):
    read = C.read_captures(B.captures(spark, folder))
    return read.select("page_id", "feed_id", "url", F.length("html").alias("chars"), "captured_at")


@query(
    "S1_capture_outcomes",
    f"WITH {B.SQL_CAPTURES} SELECT CASE WHEN status=304 THEN 'unchanged' WHEN status<>200 THEN 'failed' ELSE 'read' END AS outcome, count(*) AS pages FROM captures GROUP BY 1",
)
def capture_outcomes(spark, folder):
    return C.capture_outcomes(B.captures(spark, folder)).groupBy("outcome").agg(F.count("*").alias("pages"))


@query("S4_decode_captures", "SELECT page_id, CASE WHEN page_id%5=0 THEN 'windows-1252' ELSE 'utf-8' END AS charset, 'ok' AS status, sha256(html) AS digest FROM pages WHERE page_id%5<>0 OR NOT regexp_matches(html,'[^\\x00-\\x7E\\xA0-\\xFF]')")
def decode_captures(spark, folder):
    """Every fifth page is re-encoded to Latin-1 where it fits, and must come back as it was."""
    legacy = F.col("page_id") % 5 == 0
    p = B.pages(spark, folder).filter(~legacy | ~F.col("html").rlike("[^\\x00-\\x7E\\xA0-\\xFF]"))
    encoded = p.select(
        "page_id",
        F.when(legacy, F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8")).alias("body"),
        F.when(legacy, "text/html; charset=ISO-8859-1").otherwise("text/html").alias("content_type"),
    )
    out = C.decode_captures(encoded)
    return out.select("page_id", "charset", F.col("decode_status").alias("status"), F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"))


@query(
    "S5_xml_repair",
    "SELECT doc_id, sha256('<d>' || text || '</d>') AS digest FROM documents",
)
def xml_repair(spark, folder):
    """Forbidden characters put into every document, raw and as references, are removed again."""
    d = B.table(spark, folder, "documents")
    dirty = F.concat(F.lit("<d>\x0b&#11;"), F.col("text"), F.lit("&#x1F;&#0;\x01</d>"))
    return d.select("doc_id", F.sha2(F.encode(E.repair_xml(dirty), "UTF-8"), 256).alias("digest"))


def feed_docs(spark, folder):
    """One RSS document per host and page decade, built from the pages."""
    b = B.batch(spark, folder, "old").withColumn("part", F.floor(F.col("page_id") / 1000))
    item = F.concat(
        F.lit("<item><title>"), text.escape_xml("title"), F.lit("</title><link>"), text.escape_xml("url"),
        F.lit('</link><guid isPermaLink="false">p'), F.col("page_id").cast("string"), F.lit("</guid><description>"),
        text.escape_xml(F.concat(F.lit("<p>About "), text.escape_html("title"), F.lit("</p>"))),
        F.lit("</description>"),
        F.when(F.col("image") != "", F.concat(F.lit('<enclosure type="image/png" url="'), F.col("image"), F.lit('"/>'))).otherwise(""),
        F.when(F.col("published").isNotNull(), F.concat(F.lit("<pubDate>"), dates.rfc1123(F.col("published")), F.lit("</pubDate>"))).otherwise(""),
        F.lit("</item>"),
    )
    grouped = b.groupBy("feed_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("x")))), lambda s: s["x"]), "").alias("body"))
    return grouped.select(
        F.concat_ws("#", "feed_id", "part").alias("doc_id"),
        F.concat(F.lit("https://"), F.col("feed_id"), F.lit("/feed.xml")).alias("url"),
        F.concat(F.lit("<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>x</title>"), F.col("body"), F.lit("</channel></rss>")).alias("body"),
    )


SQL_DOCS = f"WITH {B.SQL_BATCHES}, docs AS (SELECT *, feed_id || '#' || (page_id // 1000) AS doc_id, row_number() OVER (PARTITION BY feed_id, page_id // 1000 ORDER BY page_id) - 1 AS ord FROM batch_old)"


@query("S3_entries_scan", SQL_DOCS + " SELECT doc_id, ord, 'rss' AS format, CASE WHEN image<>'' AND published IS NOT NULL THEN 6 WHEN image<>'' OR published IS NOT NULL THEN 5 ELSE 4 END AS children FROM docs WHERE ord < 1000")
def entries_scan(spark, folder):
    e = E.explode_entries(E.feed_documents(feed_docs(spark, folder)))
    return e.select("doc_id", "ord", "format", F.size("children").alias("children"))


@query("S3_document_outcomes", SQL_DOCS + " SELECT doc_id, 'rss' AS format, least(count(*),1000) AS entries, CASE WHEN count(*)>1000 THEN (count(*)-1000) || ' more entries were left out' END AS warning FROM docs GROUP BY doc_id")
def document_outcomes(spark, folder):
    return E.document_outcomes(E.feed_documents(feed_docs(spark, folder))).drop("error")


@query(
    "P24_entry_fields",
    SQL_DOCS + " SELECT doc_id, ord, url AS link, 'p' || page_id AS id, CASE WHEN image<>'' THEN 1 ELSE 0 END AS images, CASE WHEN published IS NULL THEN '' ELSE strftime(make_timestamp(published*1000000),'%a, %d %b %Y %H:%M:%S +0000') END AS date FROM docs WHERE ord<1000",
)
def entry_fields(spark, folder):
    e = E.entry_fields(E.explode_entries(E.feed_documents(feed_docs(spark, folder))))
    return e.select("doc_id", "ord", F.col("raw_link").alias("link"), "id", F.size("images").alias("images"), F.col("dates")[0].alias("date"))


@query(
    "P27_feed_stories",
    SQL_DOCS
    + f" SELECT doc_id, ord, trim(regexp_replace(title,'\\s+',' ','g')) AS title, url, 'guid:' || sha256('p' || page_id) AS key, image, coalesce(published,0) AS published, "
    f"CASE WHEN image='' THEN '' ELSE '<p><img src=\"' || image || '\" alt=\"\"></p>' END || '<p>About ' || {B.escape_sql('title')} || '</p>' AS html FROM docs WHERE ord<1000",
)
def feed_stories(spark, folder):
    """Entries through P24-P30: title, link, identity, description, image and date."""
    return E.feed_stories(feed_docs(spark, folder)).select("doc_id", "ord", "title", "url", "key", "image", "published", "html")


def entry_rows(spark, folder):
    return E.entry_stories(E.entry_fields(E.explode_entries(E.feed_documents(feed_docs(spark, folder)))), Recipe())


@query("P25_entry_link", SQL_DOCS + " SELECT doc_id, ord, url, false AS bad FROM docs WHERE ord<1000")
def entry_link(spark, folder):
    return entry_rows(spark, folder).select("doc_id", "ord", "url", F.col("bad_link").alias("bad"))


@query(
    "P26_entry_description",
    SQL_DOCS + f" SELECT doc_id, ord, 'About ' || trim(regexp_replace(title,'\\s+',' ','g')) AS body, false AS emptied FROM docs WHERE ord<1000",
)
def entry_description(spark, folder):
    """The chosen description at text level."""
    return entry_rows(spark, folder).select("doc_id", "ord", F.col("text").alias("body"), "emptied")


@query("P28_entry_identity", SQL_DOCS + " SELECT doc_id, ord, 'guid:' || sha256('p' || page_id) AS key, CAST(NULL AS VARCHAR) AS reason FROM docs WHERE ord<1000")
def entry_identity(spark, folder):
    return entry_rows(spark, folder).select("doc_id", "ord", "key", "reason")


@query("P29_entry_image", SQL_DOCS + " SELECT doc_id, ord, image FROM docs WHERE ord<1000")
def entry_image(spark, folder):
    return entry_rows(spark, folder).select("doc_id", "ord", "image")


@query("P30_entry_dates", SQL_DOCS + " SELECT doc_id, ord, coalesce(published,0) AS published FROM docs WHERE ord<1000")
def entry_dates(spark, folder):
    return entry_rows(spark, folder).select("doc_id", "ord", "published")


@query(
    "C1_text_scalars",
    """SELECT doc_id, CASE WHEN length(source || lang)>4 THEN left(source || lang,3) || '…' ELSE source || lang END AS short, length(text) - length(replace(text,chr(10),'')) AS line_breaks,
 replace(replace(replace(replace(replace(text,'&','&amp;'),chr(39),'&#39;'),'<','&lt;'),'>','&gt;'),'"','&#34;') AS escaped, 'a' || doc_id || ' b' AS one_line, 'q' || chr(92) || '"' || doc_id || chr(92) || 'n' AS label FROM documents""",
)
def text_scalars(spark, folder):
    """Truncation, escaping and one-line functions over every document."""
    n = F.col("doc_id").cast("string")
    return B.spread(B.table(spark, folder, "documents")).select(
        "doc_id",
        text.ellipsize(F.concat("source", "lang"), 4).alias("short"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("line_breaks"),
        text.escape_html("text").alias("escaped"),
        text.one_line(F.concat(F.lit("a"), n, F.lit("\r\nb"))).alias("one_line"),
        text.escape_label(F.concat(F.lit('q"'), n, F.lit("\n"))).alias("label"),
    )


# ---------------------------------------------------------------- selection


@query(
    "P1_dom_nodes",
    """SELECT tag, count(*) AS nodes FROM (SELECT unnest(regexp_extract_all(regexp_replace(html,'(?s)<script>.*?</script>','<script>','g'),'<([a-z][a-z0-9]*)',1)) AS tag FROM pages) GROUP BY tag""",
)
def dom_nodes(spark, folder):
    return dom.dom_nodes(B.pages(spark, folder)).filter(F.col("tag") != "#text").groupBy("tag").agg(F.count("*").alias("nodes"))


@query("P2_base_resolve", "SELECT page_id, url AS base FROM pages")
def base_resolve(spark, folder):
    return nodes(spark, folder).select("page_id", pin(extract.page_base(F.col("nodes"), F.col("url"))).alias("base"))


@query(
    "P3_css_select",
    f"""WITH {B.SQL_NAV} SELECT 'nav li a' AS selector, count(*) AS matches, sum(length(title)) AS chars FROM nav
 UNION ALL SELECT 'article h1', count(*), sum(length(trim({B.H1_SQL}))) FROM pages
 UNION ALL SELECT 'div.ad', count(*), sum(length(trim({B.unescape_sql("regexp_extract(html,'(?s)<div class=\"ad\">(.*?)</div>',1)")}))) FROM pages
 UNION ALL SELECT 'nav li:nth-of-type(2) > a', count(*), sum(length(title)) FROM nav WHERE pos=1
 UNION ALL SELECT 'li:not(:first-child):has(a)', count(*), sum(length(title)) FROM nav WHERE pos>0""",
)
def css_select(spark, folder):
    chosen = ["nav li a", "article h1", "div.ad", "nav li:nth-of-type(2) > a", "li:not(:first-child):has(a)"]
    n = F.col("nodes")
    per_page = nodes(spark, folder).select(
        *[
            pin(F.aggregate(F.transform(css(n, s), lambda m: F.length(node_value(n, m))), F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("l")), lambda a, x: F.struct((a["c"] + 1).alias("c"), (a["l"] + x).alias("l")))).alias(f"s{i}")
            for i, s in enumerate(chosen)
        ]
    )
    total = per_page.agg(*[F.sum(f"s{i}.c").alias(f"c{i}") for i in range(5)], *[F.sum(f"s{i}.l").alias(f"l{i}") for i in range(5)])
    return total.select(F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in chosen]).alias("selector"), F.array(*[F.col(f"c{i}") for i in range(5)]).alias("matches"), F.array(*[F.col(f"l{i}") for i in range(5)]).alias("chars"))).alias("r")).select("r.*")


@query("P4_xpath_select", f"WITH {B.SQL_NAV} SELECT page_id, pos, href AS value FROM nav")
def xpath_select(spark, folder):
    n = F.col("nodes")
    found = nodes(spark, folder).select("page_id", pin(F.transform(xpath(n, "//nav//li/a/@href"), lambda m: node_value(n, m))).alias("v"))
    return found.select("page_id", F.posexplode("v").alias("pos", "value"))


@query(
    "P5_project_fields",
    f"WITH {B.SQL_NAV} SELECT page_id, min(pos) AS pos, arg_min(title, pos) AS title, link AS url FROM cards WHERE page_id%11<>0 AND page_id%13<>0 GROUP BY page_id, link",
)
def project_fields(spark, folder):
    p = extract.read_pages(C.read_captures(B.captures(spark, folder)), NAV)
    return p.select("page_id", F.explode("cards").alias("c")).select("page_id", F.col("c.pos").alias("pos"), F.col("c.title").alias("title"), F.col("c.url").alias("url"))


def twenty_recipes():
    """Twenty recipes that differ in cards, selector kind, title, and rules."""
    out = {}
    for r in range(20):
        items = {1: "nav li:not(:first-child)", 2: "nav ul > li:nth-child(odd)", 3: "//nav//li"}.get(r % 4, "nav li")
        kind, inside = ("xpath", ".//a") if r % 4 == 3 else ("css", "a")
        rules = RuleSet(exclude={"op": "contains_any", "field": "title", "keywords": ["the"]}) if r % 3 == 0 else RuleSet()
        out[f"r{r}"] = Recipe(kind=kind, items=items, title=Field(inside, "href" if r % 5 == 0 else ""), link=Field(inside), rules=rules)
    return out


@query(
    "P5_recipe_table",
    f"""WITH {B.SQL_NAV}, r AS (SELECT *, page_id%20 AS r FROM cards WHERE page_id%11<>0 AND page_id%13<>0),
 s AS (SELECT *, CASE WHEN r%5=0 THEN href ELSE title END AS t, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS p FROM r WHERE CASE r%4 WHEN 1 THEN pos>0 WHEN 2 THEN pos%2=0 ELSE true END),
 u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos)=1)
 SELECT 'r' || r AS feed_id, page_id, p AS pos, t AS title, link AS url FROM u WHERE NOT (r%3=0 AND contains(lower(t),'the'))""",
)
def recipe_rows(spark, folder):
    """Twenty feeds with recipes of their own, read in one plan."""
    captures = C.read_captures(B.captures(spark, folder)).withColumn("feed_id", F.concat(F.lit("r"), (F.col("page_id") % 20).cast("string")))
    recipes = recipe_table.compile_recipes(recipe_table.recipe_table(spark, twenty_recipes()))
    return extract.stories(recipe_table.read_pages(captures, recipes), ("feed_id", "page_id")).select("feed_id", "page_id", "pos", "title", "url")


@query("P6_resolve_url", f"WITH {B.SQL_NAV} SELECT page_id, pos, link FROM cards")
def resolve(spark, folder):
    p = B.table(spark, folder, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit(B.CARD), F.lit(1)).alias("h"))
    return p.select("page_id", "url", F.posexplode("h").alias("pos", "href")).select("page_id", "pos", urls.resolve_url("url", "href").alias("link"))


def broken_pages(spark, folder):
    """Every seventh page gets a script link on its first card and an empty title on its second."""
    c = B.captures(spark, folder)
    first = F.regexp_replace("html", '(?s)^(.*?)<li><a href="[^"]*">', '$1<li><a href="javascript:x()">')
    second = F.regexp_replace(first, '(?s)^(.*?</li><li><a href="[^"]*">)[^<]*', "$1")
    return c.withColumn("html", F.when(F.col("page_id") % 7 == 0, second).otherwise(F.col("html")))


@query(
    "P7_reject_cards",
    f"WITH {B.SQL_NAV} SELECT page_id, pos+1 AS card, CASE pos WHEN 0 THEN 'no usable address' ELSE 'no title' END AS reason FROM nav WHERE page_id%7=0 AND pos<2",
)
def reject_cards(spark, folder):
    return extract.rejected_cards(extract.read_pages(broken_pages(spark, folder), NAV))


@query(
    "P8_item_key",
    f"WITH {B.SQL_NAV} SELECT page_id, pos, 'title:' || sha256(title) AS key FROM (SELECT *, row_number() OVER (PARTITION BY page_id, title ORDER BY pos) AS n FROM nav) WHERE n=1",
)
def item_key(spark, folder):
    """Without a link selector the title is the identity."""
    p = extract.read_pages(B.captures(spark, folder), Recipe(items="nav li", title=Field("a")))
    return extract.stories(p).select("page_id", "pos", "key")


def doubled_pages(spark, folder):
    """Each page lists its navigation twice, so every card repeats."""
    c = B.captures(spark, folder)
    return c.withColumn("html", F.regexp_replace("html", "(?s)<nav>(.*?)</nav>", "<nav>$1</nav><nav>$1</nav>"))


@query(
    "P9_first_wins_dedup",
    f"WITH {B.SQL_NAV} SELECT page_id, min(pos) AS pos, link AS key, count(*)*2 AS seen FROM cards GROUP BY page_id, link",
)
def first_wins(spark, folder):
    p = extract.read_pages(doubled_pages(spark, folder), NAV)
    n = F.col("nodes")
    raw = doubled_pages(spark, folder).select("page_id", "url", markup.page_nodes("html").alias("nodes")).select("page_id", "url", pin(F.transform(css(n, "nav li a"), lambda m: markup.attr(m, "href"))).alias("h"))
    seen = raw.select("page_id", "url", F.explode("h").alias("href")).groupBy("page_id", urls.resolve_url("url", "href").alias("key")).agg(F.count("*").alias("seen"))
    return extract.stories(p).select("page_id", "pos", "key").join(seen, ["page_id", "key"])


@query(
    "P10_absolutize_content",
    f"WITH {B.SQL_NAV} SELECT page_id, string_agg(link, ' ' ORDER BY pos) AS links FROM cards GROUP BY page_id",
)
def absolutize(spark, folder):
    n = F.col("nodes")
    nav = nodes(spark, folder).select("page_id", "url", "nodes", pin(first_of(css(n, "nav"))).alias("nav"))
    block = pin(markup.absolute_addresses(markup.subtree(n, F.col("nav")), F.col("url")))
    out = nav.select("page_id", block.alias("b"))
    links = F.transform(F.filter("b", lambda m: m["tag"] == "a"), lambda m: markup.attr(m, "href"))
    return out.select("page_id", F.array_join(links, " ").alias("links"))


@query(
    "P11_sanitize_content",
    f"""WITH {B.SQL_NAV}, c AS (SELECT page_id, string_agg('<li><a href="' || {B.escape_sql('link')} || '" rel="nofollow">' || {B.escape_sql('title')} || '</a></li>', '' ORDER BY pos) AS items FROM cards GROUP BY page_id)
 SELECT page_id, sha256('<ul>' || items || '</ul>') AS digest, length('<ul>' || items || '</ul>') AS chars FROM c""",
)
def sanitize(spark, folder):
    """The navigation block: nav is unwrapped, links are absolute and marked nofollow."""
    n = F.col("nodes")
    nav = nodes(spark, folder).select("page_id", "url", "nodes", pin(first_of(css(n, "nav"))).alias("nav"))
    out = nav.select("page_id", pin(markup.sanitized(markup.absolute_addresses(markup.subtree(n, F.col("nav")), F.col("url")))).alias("h"))
    return out.select("page_id", F.sha2(F.encode("h", "UTF-8"), 256).alias("digest"), F.length("h").alias("chars"))


SQL_ARTICLE_TEXT = B.unescape_sql("trim(regexp_replace(regexp_replace(regexp_replace({0},'</?(h1|p|br)>',' ','g'),'<[^>]*>','','g'),'\\s+',' ','g'))")


def article_text_sql(source: str) -> str:
    return SQL_ARTICLE_TEXT.replace("{0}", source)


@query(
    "P12_cleanup_rules",
    f"SELECT page_id, {article_text_sql(chr(39).join(['regexp_replace(regexp_extract(html,', '(?s)<article>(.*)</article>', ',1),', '(?s)<h1>.*?</h1>', ',', '', ')']))} AS body FROM pages",
)
def cleanup(spark, folder):
    """The article without its heading, at text level."""
    r = Recipe(items="article", title=Field("h1"), content=Field("."), remove=("h1", ".share"))
    p = extract.read_pages(B.captures(spark, folder), r)
    return extract.stories(p).select("page_id", F.col("text").alias("body"))


@query("P13_emptied_by_cleanup", "SELECT page_id, 'the cleanup rules left nothing of the article' AS failure FROM pages WHERE page_id%4=0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id%4<>0")
def emptied(spark, folder):
    """Rules that remove everything a block shows are a failure; on other pages they match nothing."""
    c = B.captures(spark, folder).withColumn(
        "html", F.when(F.col("page_id") % 4 == 0, F.regexp_replace("html", "(?s)<article>.*</article>", '<article><div class="gone">text <b>more</b></div> </article>')).otherwise(F.col("html"))
    )
    return extract.article_bodies(c, Recipe(article=Field("article"), remove=(".gone",)), ("page_id", "url")).select("page_id", "failure")


def image_pages(spark, folder):
    """An img whose attributes rotate through placeholders, srcset lists and lazy attributes."""
    n = F.col("page_id").cast("string")
    tag = (
        F.when(F.col("page_id") % 6 == 0, F.concat(F.lit('<img src="data:image/gif;base64,AAAA" data-src="/i/'), n, F.lit('.jpg">')))
        .when(F.col("page_id") % 6 == 1, F.concat(F.lit('<img srcset="/s/'), n, F.lit("-small.png 320w, /s/"), n, F.lit('-large.png 960w">')))
        .when(F.col("page_id") % 6 == 2, F.concat(F.lit('<img src="data:,x" data-original="/o/'), n, F.lit('.webp" data-thumb="/t/x.png">')))
        .when(F.col("page_id") % 6 == 3, F.concat(F.lit('<img src="data:,x" data-lazy="true" data-img="/m/'), n, F.lit('.avif">')))
        .when(F.col("page_id") % 6 == 4, F.concat(F.lit('<img src="data:,x" data-lazy-srcset="/l/'), n, F.lit("-a.jpg,/l/"), n, F.lit('-b.jpg">')))
        .otherwise('<img src="javascript:x" data-image="/clip.mp4">')
    )
    return B.captures(spark, folder).withColumn("html", F.concat(F.lit("<article><h1>"), n, F.lit("</h1>"), tag, F.lit("</article>")))


@query(
    "P14_item_image",
    """WITH t AS (SELECT page_id, regexp_extract(url,'^https?://[^/?#]+') AS root FROM pages), i AS (SELECT page_id, CASE page_id%6 WHEN 0 THEN root || '/i/' || page_id || '.jpg'
 WHEN 1 THEN root || '/s/' || page_id || '-large.png' WHEN 2 THEN root || '/o/' || page_id || '.webp' WHEN 3 THEN root || '/m/' || page_id || '.avif'
 WHEN 4 THEN root || '/l/' || page_id || '-b.jpg' ELSE '' END AS image FROM t)
 SELECT page_id, image, CASE WHEN image='' THEN '' ELSE '<p><img src="' || image || '" alt=""></p>' END AS html FROM i""",
)
def item_image(spark, folder):
    p = extract.read_pages(image_pages(spark, folder), Recipe(items="article", title=Field("h1")))
    return extract.stories(p).select("page_id", "image", "html")


def srcset_value():
    n = F.col("page_id").cast("string")
    return F.concat(F.lit(" /w_4,h_3/"), n, F.lit(".jpg 1x,  /b/"), n, F.lit(".png 2x , https://c.example/"), n, F.lit(".gif,https://d.example/"), n, F.lit(", data:a,b 3x"))


@query(
    "P15_srcset_candidates",
    """SELECT page_id, '/w_4,h_3/' || page_id || '.jpg|/b/' || page_id || '.png|https://c.example/' || page_id || '.gif|https://d.example/' || page_id || '|data:a,b' AS candidates,
 'https://d.example/' || page_id AS chosen FROM pages""",
)
def srcset(spark, folder):
    p = B.table(spark, folder, "pages")
    value = srcset_value()
    return p.select("page_id", F.array_join(images.srcset_candidates(value), "|").alias("candidates"), images.srcset_address(F.col("url"), value).alias("chosen"))


@query(
    "P16_image_address_ok",
    """SELECT page_id, CASE page_id%8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN false ELSE false END AS ok FROM pages""",
)
def image_address(spark, folder):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 8
    value = (
        F.when(k == 0, F.concat(F.lit("/a/"), n, F.lit(".jpg")))
        .when(k == 1, F.concat(F.lit("https://c.example/render?id="), n))
        .when(k == 2, F.concat(F.lit("/v/"), n, F.lit(".mp4/")))
        .when(k == 3, n)
        .when(k == 4, F.concat(F.lit("/9j/"), n))
        .when(k == 5, F.concat(n, F.lit(".PNG")))
        .when(k == 6, F.concat(F.lit("/a.jpg,/"), n, F.lit(".jpg")))
        .otherwise(F.lit("/dir/"))
    )
    return B.table(spark, folder, "pages").select("page_id", images.is_image_address(value).alias("ok"))


@query(
    "P17_prepend_image",
    f"""WITH a AS (SELECT page_id, regexp_extract(html,'{B.ARTICLE}',1) AS body, replace(regexp_replace(url,'#.*$',''),'&','&amp;') || '.png' AS image FROM pages)
 SELECT page_id, CASE page_id%3 WHEN 0 THEN body WHEN 1 THEN '<p><img src="' || image || '" alt=""></p>' || body ELSE body || '<p><img src="' || image || '"/></p>' END AS html FROM a""",
)
def prepend_image(spark, folder):
    """Every page's article: without an image, with one to add, and with one it shows already."""
    k = F.col("page_id") % 3
    address = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit(".png"))
    body = F.regexp_extract("html", B.ARTICLE, 1)
    html = F.when(k == 2, F.concat(body, F.lit('<p><img src="'), text.escape_html(address), F.lit('"/></p>'))).otherwise(body)
    return B.table(spark, folder, "pages").select("page_id", images.with_image(html, F.when(k == 0, "").otherwise(address)).alias("html"))


# -------------------------------------------------------------------- dates


@query(
    "P18_date_absolute",
    """SELECT o_orderkey, CASE o_orderkey%8 WHEN 5 THEN epoch(o_orderdate)-19800 WHEN 7 THEN 0 ELSE epoch(o_orderdate) END::BIGINT AS parsed FROM orders""",
)
def date_absolute(spark, folder):
    """Order dates written in eight machine layouts, one of them no date at all."""
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 8
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(d, "EEE, d MMM yyyy HH:mm:ss Z"))
        .when(k == 3, F.concat(F.lit("  "), F.date_format(d, "yyyy-MM-dd HH:mm")))
        .when(k == 4, F.date_format(d, "EEE, dd MMM yyyy HH:mm 'GMT'"))
        .when(k == 5, F.date_format(d, "yyyy-MM-dd HH:mm:ss '+05:30'"))
        .when(k == 6, F.date_format(d, "dd.MM.yyyy HH:mm"))
        .otherwise(F.date_format(d, "yyyy"))
    )
    return B.table(spark, folder, "orders").select("o_orderkey", dates.parse_absolute(raw, "02.01.2006 15:04").alias("parsed"))


@query(
    "P19_date_zone_names",
    """SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN epoch(o_orderdate) WHEN 1 THEN epoch(o_orderdate)+18000 WHEN 2 THEN epoch(o_orderdate)+25200 WHEN 3 THEN epoch(o_orderdate)-10800 ELSE 0 END::BIGINT AS parsed FROM orders""",
)
def date_zone_names(spark, folder):
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 5
    zone = F.when(k == 0, "UT").when(k == 1, "EST").when(k == 2, "PDT").when(k == 3, "GMT+3").otherwise("XYZ")
    raw = F.concat(F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss "), zone)
    return B.table(spark, folder, "orders").select("o_orderkey", dates.parse_absolute(raw).alias("parsed"))


@query(
    "P20_date_month_name",
    """SELECT o_orderkey, CASE o_orderkey%4 WHEN 2 THEN epoch(o_orderdate)+54240 WHEN 3 THEN 0 ELSE epoch(o_orderdate) END::BIGINT AS parsed FROM orders""",
)
def date_month_name(spark, folder):
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.date_format(d, "d MMMM yyyy"))
        .when(k == 1, F.date_format(d, "EEEE, MMM. d'th', yyyy"))
        .when(k == 2, F.date_format(d, "MMMM dd yyyy 'at' '3:04 pm'"))
        .otherwise(F.concat(F.date_format(F.date_add(d, 1), "EEE"), F.date_format(d, " d MMM yyyy")))
    )
    return B.table(spark, folder, "orders").select("o_orderkey", dates.parse_month_name(raw).alias("parsed"))


@query(
    "P21_date_relative",
    """WITH e AS (SELECT event_id, cast(floor(value) AS BIGINT) AS n, date_trunc('second',ts) AS t FROM events)
 SELECT event_id, epoch(CASE event_id%7 WHEN 0 THEN t - to_seconds(n) WHEN 1 THEN t - to_minutes(n) WHEN 2 THEN t - to_hours(n) WHEN 3 THEN t - to_days(n::INT) WHEN 4 THEN t - to_days((7*n)::INT)
 WHEN 5 THEN t - to_months(n::INT) ELSE t - to_years(n::INT) END)::BIGINT AS parsed FROM e""",
)
def date_relative(spark, folder):
    e = B.table(spark, folder, "events")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("secs", "minutes", "hrs", "days", "weeks", "months", "years")]), (F.col("event_id") % 7 + 1).cast("int"))
    raw = F.concat(F.lit("About  "), F.floor("value").cast("string"), F.lit(" "), unit, F.lit(" AGO"))
    return e.select("event_id", dates.parse_relative(raw, F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("parsed"))


@query(
    "P22_published_precedence",
    """SELECT event_id, CASE event_id%4 WHEN 0 THEN epoch(date_trunc('second',ts)) WHEN 1 THEN epoch(date_trunc('day',ts)) WHEN 2 THEN epoch(date_trunc('second',ts)-to_hours(3)) ELSE 0 END::BIGINT AS published,
 event_id%4=2 AS estimated, CASE WHEN event_id%4=2 THEN '3 hours ago' ELSE '' END AS source FROM events""",
)
def published_precedence(spark, folder):
    e = B.table(spark, folder, "events")
    t, k = F.date_trunc("second", F.col("ts").cast("timestamp")), F.col("event_id") % 4
    exact = F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, "yesterday")
    shown = F.when(k == 0, "2 days ago").when(k == 1, F.date_format(t, "d MMMM yyyy")).when(k == 2, " 3 hours ago ").otherwise("soon")
    out = e.select("event_id", pin(dates.published(exact, shown, t)).alias("p"))
    return out.select("event_id", "p.published", "p.estimated", "p.source")


@query(
    "J10_zone_lookup",
    """SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN -18000 ELSE -14400 END::BIGINT AS zone_offset FROM orders""",
)
def zone_lookup(spark, folder):
    """EST and EDT on New York dates of any season take the zone's own nearest meaning."""
    o = B.by_rows(B.table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), 200000, "o_orderkey").select(
        "o_orderkey", F.lit("America/New_York").alias("tz"), F.when(F.col("o_orderkey") % 2 == 0, "EST").otherwise("EDT").alias("zone"), F.col("o_orderdate").cast("timestamp").alias("wall")
    )
    return dates.zone_lookup(o, dates.zone_table(spark, ["America/New_York", "Europe/Berlin"]), ["o_orderkey"]).select("o_orderkey", "zone_offset")


# ------------------------------------------------------- limits and outcomes


@query(
    "P23_size_limits",
    """SELECT page_id, CASE WHEN page_id%10=0 THEN 'a story is over the size limits' END AS error FROM pages""",
)
def size_limits(spark, folder):
    c = B.captures(spark, folder).withColumn(
        "html", F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("<nav><li><a href=/x>"), F.repeat(F.lit("t"), 2049), F.lit("</a></nav>"))).otherwise(F.col("html"))
    )
    return extract.read_pages(c, NAV).select("page_id", "error")


@query(
    "T4_page_card_limit",
    """SELECT page_id, CASE WHEN page_id%50=1 THEN 1001 ELSE 1000 END AS matches, CASE WHEN page_id%50=1 THEN 'more than 1000 cards matched' END AS error FROM pages""",
)
def page_card_limit(spark, folder):
    """Pages of 1000 and of 1001 cards: the larger ones fail whole."""
    n = F.when(F.col("page_id") % 50 == 1, 1001).otherwise(1000)
    big = F.concat(F.lit("<ul>"), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("<li><b>t"), i.cast("string"), F.lit("</b></li>"))), ""), F.lit("</ul>"))
    c = B.captures(spark, folder).withColumn("html", big)
    return extract.read_pages(c, Recipe(items="li", title=Field("b"))).select("page_id", "matches", "error")


EXCLUDE = RuleSet(exclude={"op": "contains_any", "field": "title", "keywords": ["The", "en "]})


@query(
    "A3_page_outcomes",
    f"""WITH {B.SQL_NAV}, u AS (SELECT page_id, feed_id, pos, title, link, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS n FROM cards WHERE page_id%11<>0 AND page_id%13<>0)
 SELECT page_id, feed_id, count(*) AS matches, count(*) FILTER (WHERE n=1) AS valid, count(*) FILTER (WHERE n=1 AND contains(lower(title),'the')) AS filtered,
 count(*) FILTER (WHERE n=1 AND NOT contains(lower(title),'the')) AS items FROM u GROUP BY page_id, feed_id""",
)
def page_outcomes(spark, folder):
    p = extract.read_pages(C.read_captures(B.captures(spark, folder)), Recipe(items="nav li", title=Field("a"), link=Field("a"), rules=RuleSet(exclude={"op": "contains_any", "field": "title", "keywords": ["The"]})))
    return extract.page_outcomes(p).drop("warnings", "warnings_omitted", "error")


@query(
    "F6_filter_examples",
    f"""WITH {B.SQL_NAV}, u AS (SELECT page_id, pos, title, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS k FROM cards WHERE page_id%11<>0 AND page_id%13<>0),
 d AS (SELECT page_id, title, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM u WHERE k=1 AND contains(lower(title),'the'))
 SELECT page_id, n, title, 'title holds some of the exclude keywords' AS reason FROM d WHERE n<=20""",
)
def filter_examples(spark, folder):
    p = extract.read_pages(C.read_captures(B.captures(spark, folder)), Recipe(items="nav li", title=Field("a"), link=Field("a"), rules=RuleSet(exclude={"op": "contains_any", "field": "title", "keywords": ["The"]})))
    return extract.filter_examples(p)


@query(
    "P33_field_warnings",
    f"""WITH {B.SQL_NAV} SELECT page_id, CASE pos WHEN 0 THEN 'Match 1 left out: no usable address; Link should be a web address, found URL "javascript:x()"'
 ELSE 'Match 2 left out: no title; Title should be some text, found an empty value' END AS warning FROM nav WHERE page_id%7=0 AND pos<2""",
)
def field_warnings(spark, folder):
    return extract.card_warnings(extract.read_pages(broken_pages(spark, folder), NAV)).select("page_id", "warning")


@query("D3_field_samples", """SELECT page_id, CASE page_id%3 WHEN 0 THEN 'URL "[URL omitted]"' WHEN 1 THEN '"/path' || page_id || '"' ELSE '"word ' || page_id || '"' END AS sample FROM pages""")
def field_samples(spark, folder):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/path"), n, F.lit("?secret=1#x"))).otherwise(F.concat(F.lit("  word \n "), n))
    return B.table(spark, folder, "pages").select("page_id", text.field_sample(raw).alias("sample"))


@query("P31_article_body", f"SELECT page_id, {article_text_sql(chr(39).join(['regexp_extract(html,', '(?s)<article>(.*)</article>', ',1)']))} AS body, CAST(NULL AS VARCHAR) AS failure FROM pages")
def article_body(spark, folder):
    out = extract.article_bodies(B.pages(spark, folder), Recipe(article=Field("article")), ("page_id", "url"))
    return out.select("page_id", F.col("text").alias("body"), "failure")


SQL_VISIBLE = B.unescape_sql(
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'(?s)^.*</head>',''),'(?s)<!--.*?-->','','g'),'</?(nav|ul|li|div|article|h1|p|br|footer)( [^>]*)?>',' ','g'),'<[^>]*>','','g'),'\\s+',' ','g'))"
)


@query("P32_visible_text", "SELECT page_id, replace(replace(" + SQL_VISIBLE + ",'&copy;','©'),'&middot;','·') AS body FROM pages")
def visible(spark, folder):
    return markup.with_visible_text(B.pages(spark, folder), "html", "body", markup.FILTER_BLOCKS).select("page_id", "body")


@query(
    "P36_image_media_type",
    """SELECT page_id, CASE page_id%6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/svg+xml' WHEN 4 THEN 'image/avif' ELSE 'image/jpeg' END AS kind FROM pages""",
)
def media_type(spark, folder):
    ending = F.element_at(F.array(*[F.lit(e) for e in (".png", ".gif?x=.png", ".webp#y", ".svg", ".avif", ".jpeg")]), (F.col("page_id") % 6 + 1).cast("int"))
    return B.table(spark, folder, "pages").select("page_id", images.image_media_type(F.concat(F.regexp_replace("url", "[?#].*$", ""), ending)).alias("kind"))


@query(
    "P37_card_discovery",
    f"WITH {B.SQL_NAV}, p AS (SELECT page_id, count(*) AS cards FROM nav GROUP BY page_id) SELECT page_id, 'nav > ul > li' AS selector, cards FROM p WHERE cards>1",
)
def card_discovery(spark, folder):
    found = discovery.discover_cards(B.pages(spark, folder))
    return found.filter(F.col("selector") == "nav > ul > li").select("page_id", "selector", F.col("count").alias("cards"))


@query(
    "P37_card_choice",
    f"""WITH {B.SQL_NAV}, p AS (SELECT page_id, count(*) AS n FROM nav GROUP BY page_id HAVING count(*)>1),
 own AS (SELECT page_id, n, unnest(['article.card.c' || page_id%3, 'article.card', 'article.c' || page_id%3, 'article']) AS form FROM p),
 forms AS (SELECT page_id, n, form AS selector FROM own UNION ALL SELECT page_id, n, form || ':has(h2)' FROM own
  UNION ALL SELECT page_id, n, '#list article.card.c' || page_id%3 FROM p UNION ALL SELECT page_id, n, 'div.cards > article.card.c' || page_id%3 FROM p),
 scored AS (SELECT page_id, selector, n, 12 + 4 - 0.3*5 AS score FROM forms UNION ALL SELECT page_id, 'a', n, 1 - 0.3*6 FROM p
  UNION ALL SELECT page_id, '#list a', n, 1 - 0.3*6 FROM p UNION ALL SELECT page_id, 'article.card.c' || page_id%3 || ' > a', n, 1 - 0.3*6 FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, n DESC, length(selector), selector) AS rank FROM scored)
 SELECT page_id, selector, n AS count, round(score,2)::DOUBLE AS score, rank, rank=1 AS chosen FROM r""",
)
def card_choice(spark, folder):
    """The pages' own links as cards with headings, classes, an id and a parent class: every form with its score and rank."""
    k = (F.col("page_id") % 3).cast("string")
    links = F.regexp_extract_all("html", F.lit(B.CARD), F.lit(0))
    card = F.concat(F.lit('<article class="card c'), k, F.lit('"><h2>$2</h2><a href="$1">more</a></article>'))
    cards = F.array_join(F.transform(links, lambda x: F.regexp_replace(x, F.lit(B.CARD), card)), "")
    html = F.concat(F.lit('<main><section id="list"><div class="cards">'), cards, F.lit("</div></section></main>"))
    return discovery.propose_cards(B.pages(spark, folder).select("page_id", html.alias("html")))


@query(
    "P38_auto_variant",
    f"WITH {B.SQL_NAV}, p AS (SELECT page_id, count(*) AS c FROM nav GROUP BY page_id) SELECT pages.page_id, CASE WHEN pages.page_id%6=0 THEN 'rendered' ELSE 'plain' END AS variant, CASE WHEN pages.page_id%6=0 THEN 2 ELSE 1 END AS attempts FROM pages JOIN p USING (page_id)",
)
def auto_variant(spark, folder):
    """The plain capture of every sixth page has lost its links."""
    c = B.captures(spark, folder)
    plain = c.withColumn("variant", F.lit("plain")).withColumn("html", F.when(F.col("page_id") % 6 == 0, F.regexp_replace("html", "</?a[^>]*>", "")).otherwise(F.col("html")))
    both = plain.unionByName(c.withColumn("variant", F.lit("rendered")))
    p = extract.read_pages(both, NAV, ("page_id", "variant", "url", "captured_at"))
    outcomes = extract.page_outcomes(p, ("page_id", "variant")).select("page_id", "variant", "valid", F.lit(True).alias("fetched"))
    return extract.choose_variant(outcomes)


@query(
    "A10_field_coverage",
    f"WITH {B.SQL_NAV} SELECT 'link' AS field, count(*) AS cards, count(*) AS matched FROM nav UNION ALL SELECT 'image', count(*), 0 FROM nav UNION ALL SELECT 'second', count(*), count(*) FILTER (WHERE pos=1) FROM nav",
)
def coverage(spark, folder):
    return extract.field_coverage(B.pages(spark, folder), Recipe(items="nav li"), {"link": "a", "image": "img", "second": "li:nth-of-type(2) > a"})


@query(
    "J8_structural_join",
    f"WITH {B.SQL_NAV} SELECT page_id, count(*) AS links FROM nav GROUP BY page_id",
)
def structural_join(spark, folder):
    n = dom.dom_nodes(B.pages(spark, folder)).filter(F.col("tag").isin("nav", "a"))
    pairs = dom.contains_join(n.filter(F.col("tag") == "nav"), n.filter(F.col("tag") == "a"))
    return pairs.groupBy("page_id").agg(F.count("*").alias("links"))


@query(
    "J8_nested_lists",
    """WITH RECURSIVE b AS (SELECT page_id, 2 + page_id % 40 AS deep FROM pages), l AS (SELECT page_id, unnest(range(1, deep + 1)) AS level, deep FROM b)
 SELECT page_id, 'ul' AS a_tag, 'li' AS d_tag, sum(deep - level + 1)::BIGINT AS pairs FROM l GROUP BY page_id
 UNION ALL SELECT page_id, 'li', 'li', sum(deep - level)::BIGINT FROM l GROUP BY page_id
 UNION ALL SELECT page_id, 'li', 'b', sum(deep - level + 1)::BIGINT FROM l GROUP BY page_id UNION ALL SELECT page_id, 'ul', 'b', sum(deep - level + 1)::BIGINT FROM l GROUP BY page_id""",
)
def nested_lists(spark, folder):
    """Lists within lists, up to 41 deep: every pair of an outer and an inner node by their tags."""
    deep = (2 + F.col("page_id") % 40).cast("int")
    html = F.concat(F.repeat(F.lit("<ul><li>"), deep), F.lit("<p>x</p>"), F.repeat(F.lit("<b>y</b></li></ul>"), deep))
    n = dom.dom_nodes(B.pages(spark, folder).select("page_id", html.alias("html"))).filter(F.col("tag").isin("ul", "li", "b"))
    pairs = dom.contains_join(n.filter(F.col("tag") != "b"), n.filter(F.col("tag") != "ul"))
    return pairs.groupBy("page_id", "a_tag", "d_tag").agg(F.count("*").alias("pairs"))


@query(
    "J9_keyword_index",
    """WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text),'[^\\p{L}]+')) AS keyword FROM conversations), k AS (SELECT keyword, replace(keyword,'µ','μ') AS word FROM w WHERE keyword<>''),
 d AS (SELECT replace(lower(trim(regexp_replace(text,'[\\s\\x{A0}]+',' ','g'))),'µ','μ') AS t FROM documents)
 SELECT keyword, count(t) AS hits FROM k LEFT JOIN d ON contains(t, word) GROUP BY keyword""",
)
def keyword_index(spark, folder):
    """Every word of the conversations as a keyword of its own over all documents."""
    words = B.table(spark, folder, "conversations").select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("keyword")).filter(F.col("keyword") != "").distinct()
    return keywords.keyword_hits(B.spread(B.table(spark, folder, "documents")).select(F.col("doc_id").alias("item_id"), "text"), words)


@query(
    "U3_selector_union",
    f"WITH {B.SQL_NAV}, c AS (SELECT page_id, count(*) AS n FROM nav GROUP BY page_id) SELECT page_id, n*2 AS matches, n AS links FROM c",
)
def selector_union(spark, folder):
    n = F.col("nodes")
    both = document_union(F.concat(css(n, "li a, li"), css(n, "nav a")))
    out = nodes(spark, folder).select("page_id", pin(both).alias("m"))
    return out.select("page_id", F.size("m").alias("matches"), F.size(F.filter("m", lambda x: x["tag"] == "a")).alias("links"))


# --------------------------------------------------------------------- text


@query(
    "F1_fold_text",
    "SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text,'[\\s\\x{A0}]+',' ','g'))),'µ','μ')) AS digest FROM documents",
)
def fold_text(spark, folder):
    return B.spread(B.table(spark, folder, "documents")).select("doc_id", F.sha2(F.encode(text.fold("text"), "UTF-8"), 256).alias("digest"))


@query(
    "F2_leaf_contains",
    "WITH f AS (SELECT doc_id, lower(trim(regexp_replace(text,'\\s+',' ','g'))) AS t FROM documents) SELECT doc_id, contains(t,'the of') OR contains(t,'de la') OR contains(t,'und') AS any_hit, contains(t,'the') AND contains(t,'on') AS all_hit, "
    + " OR ".join(f"contains(t,'w{i}x')" for i in range(3)) + " OR contains(t,'is and') AS many_hit FROM f",
)
def leaf_contains(spark, folder):
    from newsloom.functions.rules import leaf

    d = B.spread(B.table(spark, folder, "documents")).select("doc_id", pin(text.fold("text")).alias("t"))
    many = [f"w{i}x" for i in range(99)] + ["Is  and"]
    return d.select(
        "doc_id",
        leaf(F.col("t"), "contains_any", ["The of", "DE LA", "und"]).alias("any_hit"),
        leaf(F.col("t"), "contains_all", ["the", "on"]).alias("all_hit"),
        leaf(F.col("t"), "contains_any", many).alias("many_hit"),
    )


@query(
    "D1_redact_text",
    """SELECT doc_id, 'see [URL omitted] Cookie: [redacted]' || chr(10) || 'password=[redacted], doc ' || doc_id AS head, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,'(?i)\\b(?:https?|postgres(?:ql)?|wss?)://[^\\s<>"'']+','[URL omitted]','g'),
 '(?im)\\b(authorization|proxy-authorization|cookie|set-cookie)\\s*:\\s*[^\\r\\n]+','\\1: [redacted]','g'),
 '(?i)\\b(password|access[_-]?token|refresh[_-]?token|api[_-]?key)\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s,;]+)','\\1=[redacted]','g'),'[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{80}-\\x{9F}]','�','g')) AS digest FROM documents""",
)
def redact_text(spark, folder):
    d = B.spread(B.table(spark, folder, "documents"))
    made = F.concat(F.lit("see https://a.example/x?y Cookie: a=b; c\npassword = 'x y', doc "), F.col("doc_id").cast("string"))
    return d.select("doc_id", text.redact(made, 512).alias("head"), F.sha2(F.encode(text.redact("text"), "UTF-8"), 256).alias("digest"))


@query(
    "W6_first_n_per_group",
    "SELECT user_id, n, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n<=5",
)
def first_n(spark, folder):
    e = B.table(spark, folder, "events").select("user_id", "event_id", "value")
    return groups.first_n_per_group(e, ["user_id"], [F.col("value").desc(), F.col("event_id")], 5, ["event_id"]).select("user_id", "n", "event_id")
