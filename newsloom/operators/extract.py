"""Stories out of captured pages.

One page row goes in, one page row with an array of stories comes out, so the
whole extraction is a narrow stage: no shuffle, no group, and no page can make
another one wait. Callers explode the array once the markup is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, images, markup
from newsloom.functions.columns import first_of, let, pin
from newsloom.functions.markup import attr, is_text
from newsloom.functions.rules import RuleSet, decide
from newsloom.functions.scans import halving_steps, places_before
from newsloom.functions.selectors import Loose, css, node_value, xpath
from newsloom.functions.text import collapse, ellipsize, escape_html, field_sample, quoted, redact, sha, strip
from newsloom.functions.urls import MAX_URL, resolve_url

# Size limits of one story, one page and one page's diagnostics.
MAX_TITLE = 2048
MAX_HTML = 256 << 10
MAX_OUTPUT = 8 << 20
MAX_CARDS = 1000
MAX_WARNINGS = 20
MAX_EXAMPLES = 20

# What the library says about cards and pages.
NO_TITLE, NO_ADDRESS, SKIPPED = "no title", "no usable address", " left out: "
WANT_TEXT, WANT_URL, WANT_CONTENT, WANT_IMAGE, WANT_DATE = "some text", "a web address", "text or markup", "an image address", "a date or an age"
CLEANED_AWAY, CONTENT_OMITTED, IMAGE_OMITTED = ": the cleanup rules left nothing of the description", "; published without description", "; published without image"
NO_DATE, FIRST_SEEN_USED = ": unreadable date, ", "; dated by its first listing"
TOO_MANY, TOO_LONG, TOO_MUCH = "more than 1000 cards matched", "a story is over the size limits", "the page's stories are over 8 MiB together"
NO_BODY, EMPTY_BODY = "the article selector found nothing", "the cleanup rules left nothing of the article"


@dataclass(frozen=True)
class Field:
    selector: str = ""
    attr: str = ""


@dataclass(frozen=True)
class Recipe:
    """What to read from a page. Recipes are data; the plan is compiled from them."""

    items: str = ""
    title: Field = Field()
    link: Field = Field()
    date: Field = Field()
    content: Field = Field()
    image: Field = Field()
    kind: str = "css"
    date_layout: str = ""
    timezone: str = "UTC"
    remove: tuple[str, ...] = ()
    article: Field | None = None
    rules: RuleSet = field(default_factory=RuleSet)


# ------------------------------------------------------------ single fields


def page_base(nodes: Column, url: Column) -> Column:
    """First base[href] when it resolves to a safe address, else the page's own."""
    stated = F.coalesce(attr(first_of(css(nodes, "base[href]")), "href"), F.lit(""))
    return F.coalesce(F.nullif(resolve_url(url, stated), F.lit("")), url)


def _matches(nodes: Column, recipe: Recipe, spec: Field) -> Column:
    """Matches of a field's selector on the whole page and the steps they are halved by; XPath is evaluated per card instead."""
    if spec.selector in ("", ".") or recipe.kind == "xpath":
        matches = F.array().cast(markup.NODES)
    else:
        matches = css(nodes, spec.selector)
    return let(matches, lambda m: F.struct(m.alias("nodes"), halving_steps(m).alias("steps")))


def _found(nodes: Column, card: Column, recipe: Recipe, spec: Field, page_matches: Column) -> Column:
    """The first node a field selects inside a card, or NULL."""
    if spec.selector == "":
        return F.lit(None).cast(markup.NODE)
    if spec.selector == ".":
        return card
    if recipe.kind == "xpath":
        return first_of(xpath(nodes, spec.selector, card))
    # Matches stand in document order, so the first one after the card's start is found by halving.
    before = places_before(page_matches["nodes"], page_matches["steps"], lambda m: m["pre"] <= card["pre"])
    return let(F.get(page_matches["nodes"], before), lambda m: F.when(m["pre"] <= card["last"], m))


def _is_attribute(node: Column) -> Column:
    return F.coalesce(F.startswith(node["tag"], F.lit("@")), F.lit(False))


def _value(nodes: Column, node: Column, spec: Field, default_attr: str = "") -> Column:
    name = spec.attr or default_attr
    if name:
        picked = F.when(_is_attribute(node), node_value(nodes, node)).otherwise(attr(node, name))
    else:
        picked = node_value(nodes, node)
    return F.coalesce(F.when(node.isNotNull(), picked), F.lit(""))


def mismatch(name: str, expected: str, raw: Column, node: Column, attribute: Column | str) -> Column:
    """'<name> should be <expected>, found <what>' for a field that gave nothing usable."""

    def received(a: Column) -> Column:
        present = F.coalesce(F.map_contains_key(node["attrs"], a), F.lit(False))
        tail = F.when(present, F.lit(" is empty")).otherwise(F.lit(" is missing"))
        return (
            F.when(strip(raw) != "", field_sample(raw))
            .when(node.isNull(), F.lit("no match"))
            .when((a == "") | _is_attribute(node), F.lit("an empty value"))
            .otherwise(F.concat(F.lit("attribute "), quoted(a), tail))
        )

    held = F.lit(attribute) if isinstance(attribute, str) else attribute
    return F.concat(F.lit(f"{name} should be {expected}, found "), let(held, received))


# ----------------------------------------------------- descriptions, cleanup


def cleaned_block(nodes: Column, root: Column, recipe: Recipe) -> Column:
    """The block without what the cleanup rules select, rule after rule, never the block itself."""

    def apply(block: Column, rules: tuple[str, ...]) -> Column:
        if not rules:
            return block

        def one(bound: Column) -> Column:
            loose = Loose(bound)
            chosen = xpath(loose, rules[0], root) if recipe.kind == "xpath" else css(loose, rules[0])
            left = let(
                F.filter(chosen, lambda m: m["pre"] != root["pre"]),
                lambda gone: F.when(F.size(gone) == 0, bound).otherwise(
                    F.filter(bound, lambda n: ~F.exists(gone, lambda g: (g["pre"] <= n["pre"]) & (n["pre"] <= g["last"])))
                ),
            )
            return apply(left, rules[1:])

        return let(block, one)

    return apply(markup.subtree(nodes, root), recipe.remove)


def block_markup(nodes: Column, root: Column, base: Column, recipe: Recipe) -> Column:
    """struct(html, text, emptied) of a selected block after cleanup, resolution and sanitizing."""
    kept_blocks = tuple(t for t in markup.FILTER_BLOCKS if t in markup.PLAIN_TAGS)

    def published(block: Column) -> Column:
        return let(
            markup.without_subtrees(block, lambda n: n["tag"].isin(*markup.SKIP_CONTENT)),
            lambda shown: F.struct(
                markup.sanitized(shown).alias("html"),
                markup.readable_text(shown, kept_blocks).alias("text"),
                markup.shows_anything(shown).alias("shows"),
            ),
        )

    def outcome(whole: Column) -> Column:
        """``whole`` is the block with resolved addresses; rules read the page as it was written."""
        if not recipe.remove:
            return let(published(whole), lambda b: F.struct(b["html"].alias("html"), b["text"].alias("text"), F.lit(False).alias("emptied")))
        left = F.transform(cleaned_block(nodes, root, recipe), lambda n: n["pre"])
        block = let(
            left,
            lambda kept: F.when(F.size(kept) == F.size(whole), whole).otherwise(
                F.filter(whole, lambda n: F.array_contains(kept, n["pre"]))
            ),
        )
        return let(
            F.struct(published(block).alias("b"), markup.shows_anything(whole).alias("before")),
            lambda s: F.when(
                ~s["b"]["shows"] & s["before"],
                F.struct(F.lit("").alias("html"), F.lit("").alias("text"), F.lit(True).alias("emptied")),
            ).otherwise(F.struct(s["b"]["html"].alias("html"), s["b"]["text"].alias("text"), F.lit(False).alias("emptied"))),
        )

    return let(markup.absolute_addresses(markup.subtree(nodes, root), base), outcome)


# ---------------------------------------------------------------- the cards


def _card(nodes: Column, card: Column, position: Column, base: Column, observed: Column, sets: Column, recipe: Recipe) -> Column:
    """Everything one card says, as a struct."""

    def found(name: str) -> Column:
        return _found(nodes, card, recipe, getattr(recipe, name), sets[name])

    any_image = (
        first_of(F.filter(markup.descendants(nodes, card), lambda n: n["tag"] == "img"))
        if recipe.image.selector == ""
        else F.lit(None).cast(markup.NODE)
    )
    picked = F.struct(*[found(f).alias(f) for f in ("title", "link", "content", "image", "date")], any_image.alias("any_image"))

    def read(p: Column) -> Column:
        number = F.concat(F.lit("Match "), (position + 1).cast("string"))
        title = _value(nodes, p["title"], recipe.title)
        raw_link = _value(nodes, p["link"], recipe.link, "href")
        link = resolve_url(base, raw_link)

        raw_content = _value(nodes, p["content"], recipe.content)
        if recipe.content.selector == "":
            content = F.struct(F.lit("").alias("html"), F.lit("").alias("text"), F.lit(False).alias("emptied"))
        else:
            plain = F.struct(escape_html(raw_content).alias("html"), collapse(raw_content).alias("text"), F.lit(False).alias("emptied"))
            literal = F.lit(bool(recipe.content.attr)) | _is_attribute(p["content"])
            content = (
                F.when(p["content"].isNull(), F.struct(F.lit("").alias("html"), F.lit("").alias("text"), F.lit(False).alias("emptied")))
                .when(literal, plain)
                .otherwise(block_markup(nodes, p["content"], base, recipe))
            )

        raw_image = _value(nodes, p["image"], recipe.image)
        if recipe.image.selector == "":
            image = F.when(p["any_image"].isNotNull(), images.story_image(p["any_image"], base)).otherwise(F.lit(""))
        else:
            literal = F.lit(bool(recipe.image.attr)) | _is_attribute(p["image"])
            image = (
                F.when(p["image"].isNull(), F.lit(""))
                .when(literal, resolve_url(base, raw_image))
                .otherwise(images.story_image(p["image"], base))
            )

        raw_date = _value(nodes, p["date"], recipe.date)
        exact = (
            F.when(p["date"].isNotNull() & ~is_text(p["date"]) & ~_is_attribute(p["date"]), attr(p["date"], "datetime"))
            if recipe.date.attr == ""
            else F.lit(None).cast("string")
        )
        if recipe.date.selector == "":
            published = F.struct(F.lit(None).cast("timestamp").alias("published"), F.lit(False).alias("estimated"), F.lit("").alias("source"))
        else:
            published = dates.published(exact, F.nullif(raw_date, F.lit("")), observed, recipe.date_layout, recipe.timezone)
        return let(
            F.struct(
                position.alias("pos"),
                number.alias("number"),
                title.alias("title"),
                raw_link.alias("raw_link"),
                link.alias("url"),
                content.alias("content"),
                raw_content.alias("raw_content"),
                image.alias("image"),
                raw_image.alias("raw_image"),
                raw_date.alias("raw_date"),
                F.coalesce(exact, F.lit("")).alias("datetime"),
                published.alias("date"),
                F.struct(*[p[f].alias(f) for f in ("title", "link", "content", "image", "date")]).alias("nodes"),
            ),
            lambda s: _story(s, recipe),
        )

    return let(picked, read)


def _story(s: Column, recipe: Recipe) -> Column:
    n = s["nodes"]
    has_link = bool(recipe.link.selector)
    key = F.when(s["url"] != "", s["url"]).otherwise(F.lit("") if has_link else sha(s["title"], "title:"))
    reason = F.when(s["title"] == "", F.lit(NO_TITLE)).when(key == "", F.lit(NO_ADDRESS))

    def note(text: Column, condition: Column) -> Column:
        return F.when(condition, F.array(F.concat(s["number"], text))).otherwise(F.array().cast("array<string>"))

    skip = F.when(
        s["title"] == "",
        F.concat(F.lit(f"{SKIPPED}{NO_TITLE}; "), mismatch("Title", WANT_TEXT, s["title"], n["title"], recipe.title.attr)),
    ).otherwise(
        F.concat(
            F.lit(f"{SKIPPED}{NO_ADDRESS}; "),
            mismatch("Link", WANT_URL, s["raw_link"], n["link"], recipe.link.attr or "href"),
        )
    )
    warnings = [note(skip, reason.isNotNull())]
    valid = reason.isNull()
    if recipe.content.selector:
        warnings.append(note(F.lit(CLEANED_AWAY), valid & s["content"]["emptied"]))
        blank = ~s["content"]["emptied"] & (strip(s["content"]["html"]) == "")
        text = mismatch("Content", WANT_CONTENT, s["raw_content"], n["content"], recipe.content.attr)
        warnings.append(note(F.concat(F.lit(": "), text, F.lit(CONTENT_OMITTED)), valid & blank))
    if recipe.image.selector:
        held = F.filter(
            F.array(*[F.lit(a) for a in images.USUAL_ATTRIBUTES + images.USUAL_SRCSETS]),
            lambda a: strip(F.coalesce(F.try_element_at(n["image"]["attrs"], a), F.lit(""))) != "",
        )
        automatic = n["image"].isNotNull() & F.lit(recipe.image.attr == "") & ~_is_attribute(n["image"])
        attribute = F.when(automatic, F.coalesce(first_of(held), F.lit("src"))).otherwise(F.lit(recipe.image.attr))
        raw = F.when(automatic, F.coalesce(F.try_element_at(n["image"]["attrs"], first_of(held)), F.lit(""))).otherwise(s["raw_image"])
        text = mismatch("Image", WANT_IMAGE, raw, n["image"], attribute)
        warnings.append(note(F.concat(F.lit(": "), text, F.lit(IMAGE_OMITTED)), valid & (s["image"] == "")))
    if recipe.date.selector:
        from_attr = (strip(s["raw_date"]) == "") & F.lit(recipe.date.attr == "") & (s["datetime"] != "")
        text = mismatch(
            "Date",
            WANT_DATE,
            F.when(from_attr, s["datetime"]).otherwise(s["raw_date"]),
            n["date"],
            F.when(from_attr, F.lit("datetime")).otherwise(F.lit(recipe.date.attr)),
        )
        warnings.append(
            note(F.concat(F.lit(NO_DATE), text, F.lit(FIRST_SEEN_USED)), valid & s["date"]["published"].isNull())
        )
    html = images.with_image(s["content"]["html"], s["image"])
    return F.struct(
        s["pos"].alias("pos"),
        F.coalesce(key, F.lit("")).alias("key"),
        s["title"].alias("title"),
        s["url"].alias("url"),
        html.alias("html"),
        s["content"]["text"].alias("text"),
        s["image"].alias("image"),
        s["date"]["published"].alias("published"),
        s["date"]["estimated"].alias("estimated"),
        s["date"]["source"].alias("source"),
        reason.alias("reason"),
        F.concat(*warnings).alias("warnings"),
    )


def _first_wins(found: Column) -> Column:
    """Later valid cards repeating an earlier card's key are dropped silently; one sort finds each key's first card."""
    valid = F.filter(F.transform(found, lambda s, i: F.struct(s["key"].alias("key"), i.alias("i"), s["reason"].isNull().alias("valid"))), lambda k: k["valid"])

    def keep(keys: Column) -> Column:
        first = F.filter(keys, lambda k, j: (j == 0) | (F.get(keys, j - 1)["key"] != k["key"]))
        rejected = F.filter(F.transform(found, lambda s, i: F.when(s["reason"].isNotNull(), i)), lambda i: i.isNotNull())
        places = F.sort_array(F.concat(F.transform(first, lambda k: k["i"]), rejected))
        return F.transform(places, lambda i: F.get(found, i))

    # No element is null, and sort_array takes no lambda for each comparison.
    return let(F.sort_array(valid), keep)


def _with_verdict(s: Column, rules: RuleSet) -> Column:
    verdict = decide(rules, s["title"], s["text"], s["url"])
    return s.withField("drop_reason", F.when(s["reason"].isNull(), verdict).otherwise(F.lit(None).cast("string")))


def read_pages(captures: DataFrame, recipe: Recipe, keep: tuple[str, ...] = ("page_id", "feed_id", "url", "captured_at")) -> DataFrame:
    """captures(url, html, captured_at, ...) -> one row per page: matches, stories, rejects, outcome."""
    parsed = captures.select(*keep, markup.page_nodes("html").alias("nodes"))
    nodes = F.col("nodes")
    base = page_base(nodes, F.col("url"))
    cards = xpath(nodes, recipe.items) if recipe.kind == "xpath" else css(nodes, recipe.items)
    sets = F.struct(*[_matches(nodes, recipe, getattr(recipe, f)).alias(f) for f in ("title", "link", "content", "image", "date")])
    context = F.struct(base.alias("base"), cards.alias("cards"), sets.alias("sets"))

    def stories(c: Column) -> Column:
        # A page over the card limit fails whole, so its cards are not read.
        readable = F.when(F.size(c["cards"]) > MAX_CARDS, F.array().cast(markup.NODES)).otherwise(c["cards"])
        return F.struct(
            F.size(c["cards"]).alias("matches"),
            F.transform(
                readable,
                lambda card, i: _card(nodes, card, i, c["base"], F.col("captured_at"), c["sets"], recipe),
            ).alias("found"),
        )

    read = parsed.select(*keep, pin(let(context, stories)).alias("read"))
    return judge_pages(read.select(*keep, "read.matches", "read.found"), recipe.rules, keep)


def judge_pages(found: DataFrame, rules: RuleSet, keep: tuple[str, ...]) -> DataFrame:
    """Apply identity, limits and rules to every page's found stories."""
    unique = found.select(
        *keep, "matches", pin(F.transform(let(F.col("found"), _first_wins), lambda s: _with_verdict(s, rules))).alias("all")
    )
    return page_errors(unique, keep)


def page_errors(unique: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Pages with their judged stories (all) and the failure of the page, if any."""
    everything = F.col("all")
    valid = F.filter(everything, lambda s: s["reason"].isNull())
    too_big = F.exists(
        valid,
        lambda s: (F.octet_length(s["title"]) > MAX_TITLE)
        | (F.octet_length(s["html"]) > MAX_HTML)
        | (F.octet_length(s["url"]) > MAX_URL)
        | (F.octet_length(s["image"]) > images.MAX_IMAGE_ADDRESS),
    )
    output = F.aggregate(
        valid, F.lit(0).cast("long"), lambda t, s: t + (F.octet_length(s["title"]) + F.octet_length(s["html"])).cast("long")
    )
    error = (
        F.when(F.col("matches") > MAX_CARDS, F.lit(TOO_MANY))
        .when(too_big, F.lit(TOO_LONG))
        .when(output > MAX_OUTPUT, F.lit(TOO_MUCH))
        .when(
            F.size(valid) == 0,
            F.concat(F.lit("none of "), F.col("matches").cast("string"), F.lit(" matches is a story")),
        )
    )
    return unique.select(*keep, "matches", everything.alias("cards"), pin(error).alias("error"))


def stories(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "feed_id", "captured_at")) -> DataFrame:
    """Kept stories of pages that did not fail, one row each."""
    kept = F.filter("cards", lambda s: s["reason"].isNull() & s["drop_reason"].isNull())
    fields = ("pos", "key", "title", "url", "html", "text", "image", "published", "estimated", "source")
    return (
        pages.filter(F.col("error").isNull())
        .select(*keep, F.explode(kept).alias("story"))
        .select(*keep, *[F.col("story")[f].alias(f) for f in fields])
    )


def rejected_cards(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Cards without a title or a usable link, with their number and reason."""
    bad = F.filter("cards", lambda s: s["reason"].isNotNull())
    return pages.select(*keep, F.explode(bad).alias("card")).select(
        *keep, (F.col("card.pos") + 1).alias("card"), F.col("card.reason").alias("reason")
    )


def card_warnings(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return pages.select(*keep, F.posexplode(F.flatten(F.transform("cards", lambda s: s["warnings"]))).alias("n", "warning"))


def page_outcomes(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "feed_id")) -> DataFrame:
    """Per page: matches, valid, filtered, items, bounded warnings and the failure, if any."""
    valid = F.size(F.filter("cards", lambda s: s["reason"].isNull()))
    filtered = F.size(F.filter("cards", lambda s: s["drop_reason"].isNotNull()))
    warnings = F.flatten(F.transform("cards", lambda s: s["warnings"]))
    return pages.select(
        *keep,
        "matches",
        valid.alias("valid"),
        filtered.alias("filtered"),
        F.when(F.col("error").isNull(), valid - filtered).otherwise(0).alias("items"),
        F.slice(warnings, 1, MAX_WARNINGS).alias("warnings"),
        F.greatest(F.size(warnings) - MAX_WARNINGS, F.lit(0)).alias("warnings_omitted"),
        "error",
    )


def filter_examples(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The first 20 stories per page the rules dropped, with a redacted title and the reason."""
    dropped = F.slice(F.filter("cards", lambda s: s["drop_reason"].isNotNull()), 1, MAX_EXAMPLES)
    return pages.select(*keep, F.posexplode(dropped).alias("n", "s")).select(
        *keep,
        (F.col("n") + 1).alias("n"),
        ellipsize(collapse(redact(F.col("s.title"), 512)), 120).alias("title"),
        redact(F.col("s.drop_reason"), 512).alias("reason"),
    )


def article_bodies(articles: DataFrame, recipe: Recipe, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """article_pages(url, html) -> body or failure reason. Never touches identity, date or link."""
    spec = recipe.article or Field()
    parsed = articles.select(*dict.fromkeys((*keep, "url")), markup.page_nodes("html").alias("nodes"))
    nodes = F.col("nodes")
    first = first_of(xpath(nodes, spec.selector) if recipe.kind == "xpath" else css(nodes, spec.selector))
    nothing = F.struct(F.lit("").alias("html"), F.lit("").alias("text"), F.lit(None).cast("boolean").alias("emptied"))
    if spec.attr:
        # An attribute holds markup of its own: it is parsed and sanitized as it stands.
        stated = F.when(first.isNotNull(), F.coalesce(attr(first, spec.attr), F.lit("")))
        held = parsed.select(*keep, pin(stated).alias("stated"))
        inner = held.select(*keep, "stated", markup.page_nodes("stated").alias("nodes"))
        body = F.struct(markup.sanitized(nodes).alias("html"), markup.readable_text(nodes).alias("text"), F.lit(False).alias("emptied"))
        out = inner.select(*keep, pin(F.when(F.col("stated").isNull(), nothing).otherwise(body)).alias("out"))
    else:
        context = F.struct(page_base(nodes, F.col("url")).alias("base"), first.alias("node"))

        def outcome(c: Column) -> Column:
            return F.when(c["node"].isNull(), nothing).otherwise(block_markup(nodes, c["node"], c["base"], recipe))

        out = parsed.select(*keep, pin(let(context, outcome)).alias("out"))
    failure = (
        F.when(F.col("out.emptied").isNull(), F.lit(NO_BODY))
        .when(F.col("out.emptied"), F.lit(EMPTY_BODY))
        .when(F.octet_length("out.html") > MAX_HTML, F.lit(f"the article is over {MAX_HTML} bytes"))
    )
    body_html = F.when(failure.isNull(), F.col("out.html")).otherwise(F.lit(""))
    return out.select(*keep, body_html.alias("body"), F.col("out.text").alias("text"), failure.alias("failure"))


def choose_variant(outcomes: DataFrame) -> DataFrame:
    """page_id, variant ('plain'|'rendered'), valid, fetched -> the variant each page uses.

    The rendered capture is used only when the plain one was read and gave no valid story.
    """
    plain = F.max(F.when(F.col("variant") == "plain", F.struct("fetched", "valid")))
    rendered = F.max(F.when(F.col("variant") == "rendered", F.lit(1)))
    return outcomes.groupBy("page_id").agg(plain.alias("plain"), rendered.alias("rendered")).select(
        "page_id",
        F.when(F.col("plain.fetched") & (F.col("plain.valid") == 0) & F.col("rendered").isNotNull(), "rendered")
        .otherwise("plain")
        .alias("variant"),
        F.when(F.col("plain.fetched") & (F.col("plain.valid") == 0) & F.col("rendered").isNotNull(), 2).otherwise(1).alias("attempts"),
    )


def field_coverage(captures: DataFrame, recipe: Recipe, probes: dict[str, str]) -> DataFrame:
    """Cards matched and, per probe selector, cards in which it finds something."""
    parsed = captures.select(markup.page_nodes("html").alias("nodes"))
    nodes = F.col("nodes")

    def holds(matches: Column):
        return lambda card: F.exists(matches, lambda m: (card["pre"] < m["pre"]) & (m["pre"] <= card["last"]))

    def counts(c: Column) -> Column:
        held = [F.size(F.filter(c["cards"], holds(c[name]))).alias(name) for name in probes]
        return F.struct(F.size(c["cards"]).alias("cards"), *held)

    context = F.struct(css(nodes, recipe.items).alias("cards"), *[css(nodes, s).alias(n) for n, s in probes.items()])
    per_page = parsed.select(pin(let(context, counts)).alias("c"))
    total = per_page.agg(F.sum("c.cards").alias("cards"), *[F.sum(f"c.{n}").alias(n) for n in probes])
    return total.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col("cards"), F.col(n).alias("matched")) for n in probes]))
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
