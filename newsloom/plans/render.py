"""Published documents as aggregates over stored stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import rfc1123, rfc3339
from newsloom.functions.images import image_media_type, image_tag
from newsloom.functions.text import escape_html, escape_label, escape_xml
from newsloom.functions.urls import resolve_url, url_host
from newsloom.operators.feeds import is_due, is_quiet

# Document namespaces and limits.
CONTENT_NS = "http://purl.org/rss/1.0/modules/content/"
ATOM_NS = "http://www.w3.org/2005/Atom"
MEDIA_NS = "http://search.yahoo.com/mrss/"
XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
MAX_OUTLINES = 1000
FEED_TAG = "newsloom:feed"


def item_content() -> Column:
    """List-page description, or the full article with the image in front unless it already refers to it."""
    full, image = F.col("content_full"), F.col("image")
    has_image = (image == "") | F.contains(full, image) | F.contains(full, escape_html(image))
    return F.when(full == "", F.col("html")).when(has_image, full).otherwise(F.concat(image_tag(image), full))


def item_summary() -> Column:
    return F.when((F.col("content_full") != "") & (F.col("html") != ""), F.col("html")).otherwise("")


def _el(indent: str, name: str, value: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"{indent}<{name}{attrs}>"), value, F.lit(f"</{name}>\n"))


def _optional(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise("")


def changed_at() -> Column:
    return F.coalesce("last_changed", "last_success")


def etag(doc: Column) -> Column:
    return F.concat(F.lit('"'), F.sha2(F.encode(doc, "UTF-8"), 256), F.lit('"'))


def _joined_parts(items: DataFrame, part: Column) -> DataFrame:
    """Entry markup per feed in item order. Histories are retained first, so a feed's list is bounded."""
    # Negated time sorts newest first inside the collected structs; key breaks ties in byte order.
    keyed = items.select("feed_id", (-F.unix_micros("published")).alias("o"), "key", part.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("o", "key", "part")))
    return keyed.groupBy("feed_id").agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "").alias("entries"))


def render_rss(feeds: DataFrame, items: DataFrame, self_base: str = "", generator: str = "newsloom") -> DataFrame:
    """One RSS 2.0 document and its ETag per feed; no clock is read, so equal data gives equal bytes."""
    content = item_content()
    entry = F.concat(
        F.lit("    <item>\n"),
        _el("      ", "title", escape_xml("title")),
        _optional(F.col("url") != "", _el("      ", "link", escape_xml("url"))),
        _el("      ", "guid", escape_xml("guid"), ' isPermaLink="false"'),
        _el("      ", "description", escape_xml(content)),
        _optional(item_summary() != "", _el("      ", "content:encoded", escape_xml(content))),
        _optional(
            F.col("image") != "",
            F.concat(
                F.lit('      <media:content url="'),
                escape_xml("image"),
                F.lit('" type="'),
                image_media_type("image"),
                F.lit('" medium="image"></media:content>\n'),
            ),
        ),
        _el("      ", "pubDate", rfc1123(F.col("published"))),
        F.lit("    </item>\n"),
    )
    parts = _joined_parts(items, entry)
    self_link = (
        F.concat(
            F.lit('    <atom:link href="'),
            escape_xml(F.concat(F.lit(self_base), F.col("feed_id"), F.lit(".xml"))),
            F.lit('" rel="self" type="application/rss+xml"></atom:link>\n'),
        )
        if self_base
        else F.lit("")
    )
    minutes = F.floor(F.col("interval_s") / 60)
    doc = F.concat(
        F.lit(XML_HEAD),
        F.lit(f'<rss version="2.0" xmlns:content="{CONTENT_NS}" xmlns:atom="{ATOM_NS}" xmlns:media="{MEDIA_NS}">\n  <channel>\n'),
        _el("    ", "title", escape_xml("title")),
        _el("    ", "link", escape_xml("url")),
        self_link,
        _el("    ", "description", F.concat(F.lit("Updates from "), escape_xml("title"))),
        _el("    ", "generator", F.lit(generator)) if generator else F.lit(""),
        _optional(minutes > 0, _el("    ", "ttl", minutes.cast("string"))),
        _optional(changed_at().isNotNull(), _el("    ", "lastBuildDate", rfc1123(changed_at()))),
        F.coalesce("entries", F.lit("")),
        F.lit("  </channel>\n</rss>"),
    )
    return feeds.join(parts, "feed_id", "left").select("feed_id", doc.alias("doc")).withColumn("etag", etag(F.col("doc")))


def _valid_date(*candidates: Column) -> Column:
    checked = [F.when(F.year(c).between(1, 9999), c) for c in candidates]
    return F.coalesce(*checked, F.timestamp_seconds(F.lit(0)))


def render_atom(feeds: DataFrame, items: DataFrame, public_base: str = "https://reader.example") -> DataFrame:
    """One Atom 1.0 document per feed, or the reason it cannot be rendered."""
    state = feeds.select("feed_id", changed_at().alias("feed_changed"), F.col("url").alias("source"))
    joined = items.join(state, "feed_id")
    published = _valid_date(F.col("published"), F.col("first_seen"), F.col("last_seen"), F.col("feed_changed"))
    updated = F.greatest(
        published,
        _valid_date(F.col("last_changed"), F.col("last_seen"), F.col("first_seen"), F.col("published"), F.col("feed_changed")),
    )
    spaced = lambda c: F.col(c).rlike("\\s")
    link = F.when(spaced("url"), "").otherwise(resolve_url(F.col("source"), F.col("url")))
    picture = F.when(spaced("image"), "").otherwise(resolve_url(F.col("source"), F.col("image")))
    joined = (
        joined.withColumn("entry_published", published)
        .withColumn("entry_updated", updated)
        .withColumn("link", link)
        .withColumn("picture", picture)
    )
    content, summary = item_content(), item_summary()
    alternate = F.concat(F.lit('    <link rel="alternate" type="text/html" href="'), escape_xml("link"), F.lit('"></link>\n'))
    enclosure = F.concat(
        F.lit('    <link rel="enclosure" type="'), image_media_type("image"), F.lit('" href="'), escape_xml("picture"), F.lit('"></link>\n')
    )
    entry = F.concat(
        F.lit("  <entry>\n"),
        _el("    ", "id", escape_xml("guid")),
        _el("    ", "title", escape_xml("title"), ' type="text"'),
        _optional(F.col("link") != "", alternate),
        _optional((F.col("image") != "") & (F.col("picture") != ""), enclosure),
        _el("    ", "published", rfc3339(F.col("entry_published"))),
        _el("    ", "updated", rfc3339(F.col("entry_updated"))),
        _optional(summary != "", _el("    ", "summary", escape_xml(summary), ' type="html"')),
        _el("    ", "content", escape_xml(content), ' type="html"'),
        F.lit("  </entry>\n"),
    )
    bad_id = ~F.col("guid").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.col("guid").rlike("\\s")
    bad_link = (F.col("url") != "") & (F.col("link") == "")
    parts = joined.select(
        "feed_id", (-F.unix_micros("published")).alias("o"), "key", entry.alias("part"), "entry_updated", bad_id.alias("bad_id"), bad_link.alias("bad_link")
    ).groupBy("feed_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "key", "part"))), lambda s: s["part"]), "").alias("entries"),
        F.max("entry_updated").alias("newest"),
        F.bool_or("bad_id").alias("bad_id"),
        F.bool_or("bad_link").alias("bad_link"),
    )
    author = F.when(F.trim("title") != "", F.trim("title")).otherwise(url_host("url"))
    feed_urn = F.concat(F.lit("urn:sha256:"), F.sha2(F.concat(F.lit(FEED_TAG.encode()), F.lit(b"\x00"), F.encode(F.col("feed_id"), "UTF-8")), 256))
    doc = F.concat(
        F.lit(XML_HEAD + f'<feed xmlns="{ATOM_NS}">\n'),
        _el("  ", "id", feed_urn),
        _el("  ", "title", escape_xml("title"), ' type="text"'),
        _el("  ", "updated", rfc3339(F.greatest(_valid_date(changed_at()), F.coalesce("newest", _valid_date(changed_at()))))),
        F.lit("  <author>\n"),
        _el("    ", "name", escape_xml(author)),
        _el("    ", "uri", escape_xml("url")),
        F.lit("  </author>\n"),
        F.lit('  <link rel="alternate" type="text/html" href="'),
        escape_xml("url"),
        F.lit('"></link>\n'),
        F.lit('  <link rel="self" type="application/atom+xml" href="'),
        escape_xml(F.concat(F.lit(public_base.rstrip("/") + "/feeds/"), F.col("feed_id"), F.lit(".atom"))),
        F.lit('"></link>\n'),
        F.coalesce("entries", F.lit("")),
        F.lit("</feed>"),
    )
    failure = (
        F.when(resolve_url(F.col("url"), F.col("url")) == "", "the feed's address is no plain web address")
        .when(F.coalesce("bad_id", F.lit(False)), "an entry's id is no absolute address")
        .when(F.coalesce("bad_link", F.lit(False)), "an entry's link is no plain web address")
    )
    out = feeds.join(parts, "feed_id", "left").select("feed_id", failure.alias("failure"), doc.alias("doc"))
    out = out.withColumn("doc", F.when(F.col("failure").isNull(), F.col("doc")))
    return out.select("feed_id", "doc", etag(F.col("doc")).alias("etag"), "failure")


def render_opml(feeds: DataFrame, title: str, created: Column, atom: bool = False, public_base: str = "https://reader.example/feeds/") -> DataFrame:
    """All feeds as one OPML document. More than 1000 feeds give a refusal, never a cut list."""
    ending = ".atom" if atom else ".xml"
    named = F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title"))
    html_url = _optional(F.col("kind") != "feed", F.concat(F.lit(' htmlUrl="'), escape_xml("url"), F.lit('"')))
    line = F.concat(
        F.lit('    <outline type="rss" text="'),
        escape_xml(named),
        F.lit('" title="'),
        escape_xml(named),
        F.lit('" xmlUrl="'),
        escape_xml(F.concat(F.lit(public_base), F.col("feed_id"), F.lit(ending))),
        F.lit('"'),
        html_url,
        F.lit("></outline>\n"),
    )
    linked = feeds.filter(F.col("feed_id") != "")
    # The 1001 smallest are enough to know whether the list fits, so the collected list stays bounded.
    bounded = linked.orderBy("title", "feed_id").limit(MAX_OUTLINES + 1)
    one = bounded.select("title", "feed_id", line.alias("line")).agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "feed_id", "line"))), lambda s: s["line"]), "").alias("body"),
    )
    doc = F.concat(
        F.lit(XML_HEAD + '<opml version="2.0">\n  <head>\n'),
        _el("    ", "title", escape_xml(F.lit(title))),
        _el("    ", "dateCreated", rfc1123(created)),
        F.lit("  </head>\n  <body>\n"),
        F.col("body"),
        F.lit("  </body>\n</opml>\n"),
    )
    fits = F.col("n") <= MAX_OUTLINES
    return one.select(F.when(fits, doc).alias("doc"), F.when(~fits, f"more than {MAX_OUTLINES} feeds").alias("failure"))


def library_samples(feeds: DataFrame, now: Column, prefix: str = "newsloom") -> DataFrame:
    """Library gauges as (metric, labels, value); feeds carries an ``items`` count."""
    totals = feeds.agg(
        F.count("*").alias("feeds"),
        F.count_if("enabled").alias("feeds_enabled"),
        F.count_if(is_due(now)).alias("feeds_due"),
        F.count_if(is_quiet(now)).alias("feeds_quiet"),
        F.count_if(F.col("failures") > 0).alias("feeds_failing"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
    )
    names = ["feeds", "feeds_enabled", "feeds_due", "feeds_quiet", "feeds_failing", "items"]
    return totals.select(
        F.inline(
            F.array(*[F.struct(F.lit(f"{prefix}_{n}").alias("metric"), F.lit("").alias("labels"), F.col(n).cast("long").alias("value")) for n in names])
        )
    )


def feed_samples(feeds: DataFrame, prefix: str = "newsloom", most: int | None = None) -> DataFrame:
    """Six series for each feed, or for the first ``most`` by title."""
    first = feeds if most is None else feeds.orderBy("title", "feed_id").limit(most)
    labels = F.concat(F.lit('{feed="'), escape_label("title"), F.lit('",id="'), escape_label("feed_id"), F.lit('"}'))
    when = lambda c: F.coalesce(F.unix_timestamp(c), F.lit(0))
    series = {
        "feed_items": F.col("items"),
        "feed_failures": F.col("failures"),
        "feed_enabled": F.col("enabled").cast("int"),
        "feed_last_success_timestamp_seconds": when("last_success"),
        "feed_last_changed_timestamp_seconds": when("last_changed"),
        "feed_last_new_story_timestamp_seconds": when("last_new"),
    }
    return first.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f"{prefix}_{n}").alias("metric"), labels.alias("labels"), v.cast("long").alias("value"))
                    for n, v in series.items()
                ]
            )
        )
    )


def render_metrics(feeds: DataFrame, now: Column, prefix: str = "newsloom", most: int | None = None) -> DataFrame:
    """Exposition lines, one row each, with their metric; feeds beyond ``most`` are counted in a series of their own."""
    samples = library_samples(feeds, now, prefix).unionByName(feed_samples(feeds, prefix, most))
    if most is not None:
        omitted = feeds.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("value"))
        samples = samples.unionByName(omitted.select(F.lit(f"{prefix}_feeds_omitted").alias("metric"), F.lit("").alias("labels"), "value"))
    return samples.select("metric", F.concat("metric", "labels", F.lit(" "), F.col("value").cast("string")).alias("line"))


def changed_only(new_docs: DataFrame, published: DataFrame) -> DataFrame:
    """Documents whose bytes changed since the previous publication."""
    old = published.select("feed_id", F.col("etag").alias("_etag"), F.lit(True).alias("_known"))
    # A document that could not be rendered has no etag; it changed if one was published before.
    changed = F.col("_known").isNull() | ~F.col("_etag").eqNullSafe(F.col("etag"))
    return new_docs.join(old, "feed_id", "left").filter(changed).drop("_etag", "_known")


def publish_decision(new_docs: DataFrame, held: DataFrame) -> DataFrame:
    """What a reader holding (etag or last_modified) gets: the ETag decides first, else a strictly newer change time."""
    joined = new_docs.join(held.select("feed_id", F.col("etag").alias("_etag"), F.col("last_modified").alias("_since")), "feed_id", "left")
    by_etag = F.when(F.col("_etag").isNotNull(), F.col("_etag") != F.col("etag"))
    by_time = F.when(F.col("_since").isNotNull(), F.date_trunc("second", "last_changed") > F.col("_since"))
    return joined.withColumn("send", F.coalesce(by_etag, by_time, F.lit(True))).drop("_etag", "_since")

