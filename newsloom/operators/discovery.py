"""Proposing repeating-card selectors for a corpus of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import let, pin
from newsloom.functions.markup import page_nodes
from newsloom.functions.scans import running_max, running_sum

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# How likely an element is a card, by tag.
TAG_SCORES = {"article": 12, "li": 10, "tr": 10, "p": 4, "div": 2, "a": 1}


def _signature(nodes: Column, node: Column) -> Column:
    """``tag.class`` of the element under its parent and grandparent."""

    def name(n: Column) -> Column:
        classes = F.slice(F.filter(F.split(F.coalesce(F.try_element_at(n["attrs"], F.lit("class")), F.lit("")), "\\s+"), lambda c: c != ""), 1, 3)
        return F.concat(n["tag"], F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""))

    def above(n: Column) -> Column:
        return F.get(nodes, n["parent"])

    parent = above(node)
    return F.concat_ws(" > ", name(above(parent)), name(parent), name(node))


def discover_cards(captures: DataFrame, most_nodes: int | None = None, least_depth: int = 3) -> DataFrame:
    """page_id, selector, count, score: groups of alike elements that look like cards.

    Pages of any size are searched; with most_nodes, larger ones are left to ``too_large``.

    A group has more than one member, at most one heading and 1 to 12 links in each.
    Elements are grouped per page with partial aggregation, so only one row per
    (page, signature) is shuffled.
    """
    parsed = captures.select("page_id", page_nodes("html").alias("nodes"))
    nodes = F.col("nodes")
    # Only elements that hold a link can be cards; link and heading positions are found once per page.
    def profile(marks: Column) -> Column:
        def one(n: Column) -> Column:
            held = lambda field: F.size(F.filter(marks[field], lambda p: (n["pre"] <= p) & (p <= n["last"])))
            return F.struct(
                _signature(nodes, n).alias("selector"), n["tag"].alias("tag"), n["depth"].alias("depth"),
                held("links").alias("links"), held("heads").alias("heads"), held("images").alias("images"),
            )

        return F.transform(F.filter(nodes, lambda n: n["tag"].isin(*TAG_SCORES) & (n["depth"] >= least_depth)), one)

    def positions(*tags: str) -> Column:
        return F.transform(F.filter(nodes, lambda n: n["tag"].isin(*tags)), lambda n: n["pre"])

    marks = F.struct(positions("a").alias("links"), positions(*HEADINGS).alias("heads"), positions("img").alias("images"))
    searched = parsed if most_nodes is None else parsed.filter(F.size("nodes") <= most_nodes)
    profiled = searched.select("page_id", pin(let(marks, profile)).alias("found"))
    rows = profiled.select("page_id", F.explode("found").alias("f")).select("page_id", "f.*")
    base = F.lit(0.0)
    for tag, score in TAG_SCORES.items():
        base = F.when(F.col("tag") == tag, F.lit(float(score))).otherwise(base)
    grouped = rows.groupBy("page_id", "selector", "tag").agg(
        F.count("*").alias("count"),
        F.max("heads").alias("heads"),
        F.min("links").alias("min_links"),
        F.max("links").alias("max_links"),
        F.max("images").alias("images"),
        F.min("depth").alias("depth"),
    )
    good = (F.col("count") > 1) & (F.col("heads") <= 1) & (F.col("min_links") >= 1) & (F.col("max_links") <= 12)
    score = base + F.when(F.col("heads") > 0, 4).otherwise(0) + F.when(F.col("images") > 0, 3).otherwise(0) - 0.3 * F.col("depth")
    return grouped.filter(good).select("page_id", "selector", "count", F.round(score, 2).alias("score"))


def too_large(captures: DataFrame, most_nodes: int) -> DataFrame:
    """Pages with more nodes than a search with that limit looks at."""
    sized = captures.select("page_id", pin(F.size(page_nodes("html"))).alias("nodes"))
    return sized.filter(F.col("nodes") > most_nodes)


def best_cards(found: DataFrame) -> DataFrame:
    """The best proposal of each page."""
    best = F.max_by(F.struct("selector", "count", "score"), F.struct("score", "count", "selector"))
    return found.groupBy("page_id").agg(best.alias("b")).select("page_id", "b.*")


# Classes of a form and of an element's single-class forms, ancestors whose id is looked at, links of a card.
FORM_CLASSES, SINGLE_CLASSES, ID_REACH, MOST_LINKS = 3, 8, 3, 12
SIMPLE_NAME = "^-?[A-Za-z_][A-Za-z0-9_-]*$"
HEADING_SCORE, IMAGE_SCORE, DEPTH_SCORE = 4.0, 3.0, 0.3


def _element(n: Column) -> Column:
    """Its places, tag, usable id and classes, and what it holds by running counts."""
    classes = F.filter(F.split(F.coalesce(F.try_element_at(n["attrs"], F.lit("class")), F.lit("")), "\\s+"), lambda c: c.rlike(SIMPLE_NAME))
    held = F.coalesce(F.try_element_at(n["attrs"], F.lit("id")), F.lit(""))
    return F.struct(
        *[n[c].alias(c) for c in ("pre", "last", "depth", "parent", "tag")], F.array_distinct(classes).alias("classes"), F.when(held.rlike(SIMPLE_NAME), held).otherwise("").alias("id")
    )


def _segment(e: Column) -> Column:
    """The element by its tag and first classes."""
    return F.concat(e["tag"], F.array_join(F.transform(F.slice(e["classes"], 1, FORM_CLASSES), lambda c: F.concat(F.lit("."), c)), ""))


def _forms(nodes: Column, e: Column, heading: Column) -> Column:
    """Selectors that may stand for an element: by classes, by each class, by tag, with its heading, below an id, below its parent."""

    def above(x: Column) -> Column:
        return F.get(nodes, x["parent"])

    own = F.concat(F.array(_segment(e)), F.transform(F.slice(e["classes"], 1, SINGLE_CLASSES), lambda c: F.concat(e["tag"], F.lit("."), c)), F.array(e["tag"]))
    with_heading = F.when(heading.isNotNull(), F.transform(own, lambda f: F.concat(f, F.lit(":has("), heading, F.lit(")")))).otherwise(F.array().cast("array<string>"))
    first = _segment(e)
    near, ids = e, []
    for _ in range(ID_REACH):
        near = above(near)
        ids.append(F.when(F.coalesce(near["id"], F.lit("")) != "", F.concat(F.lit("#"), near["id"], F.lit(" "), first)))
    parent = above(e)
    below = F.when(F.size(parent["classes"]) > 0, F.concat(_segment(parent), F.lit(" > "), first))
    return F.array_distinct(F.filter(F.concat(own, with_heading, F.array(*ids, below)), lambda f: f.isNotNull()))


def card_forms(captures: DataFrame) -> DataFrame:
    """page_id, selector, pre, last, depth, links, heads, images: every element that may be a card, once for each form that stands for it.

    What an element holds is read off running counts of links, headings and images, so no element looks through its page.
    """
    parsed = captures.select("page_id", page_nodes("html").alias("nodes"))
    nodes = F.col("nodes")

    def count(test) -> Column:
        return running_sum(F.transform(nodes, lambda n: test(n).cast("int")))

    heads = running_max(F.transform(nodes, lambda n, i: F.when(n["tag"].isin(*HEADINGS), i)))
    counts = parsed.select(
        "page_id", pin(F.transform(nodes, _element)).alias("nodes"), pin(count(lambda n: n["tag"] == "a")).alias("a"), pin(count(lambda n: n["tag"].isin(*HEADINGS))).alias("h"),
        pin(count(lambda n: n["tag"] == "img")).alias("i"), pin(heads).alias("last_head"),
    )

    def card(e: Column) -> Column:
        held = lambda c: F.get(c, e["last"]) - F.coalesce(F.get(c, e["pre"] - 1), F.lit(0))
        # With one heading at most, the last one up to the element's end is the element's own, if it has any.
        heading = F.when(held("h") == 1, F.get(nodes, F.get("last_head", e["last"]))["tag"])
        return F.struct(
            _forms(nodes, e, heading).alias("forms"), *[e[c].alias(c) for c in ("pre", "last", "depth", "tag")], held("a").alias("links"), held("h").alias("heads"), held("i").alias("images")
        )

    likely = F.filter(nodes, lambda e: e["tag"].isin(*TAG_SCORES))
    rows = counts.select("page_id", F.explode(pin(F.transform(likely, card))).alias("c")).select("page_id", "c.*")
    return rows.select("page_id", F.explode("forms").alias("selector"), "pre", "last", "depth", "tag", "links", "heads", "images")


def propose_cards(captures: DataFrame) -> DataFrame:
    """page_id, selector, count, score, rank, chosen: every form that could repeat as a card, the best one first.

    A form counts if more than one element has it, none inside another, each with 1 to 12 links and at most one heading.
    Chosen are the forms of a page that stand in different places, taken greedily from the best: one whose elements meet
    those of a better one is left. Elements meet by form and page before anything is gathered.
    """
    members = card_forms(captures)
    # Elements of one form in page order: one lies in another if it begins before the end of an earlier one.
    order = Window.partitionBy("page_id", "selector").orderBy("pre")
    inside = F.col("pre") <= F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    base = F.lit(0.0)
    for tag, score in TAG_SCORES.items():
        base = F.when(F.col("tag") == tag, F.lit(float(score))).otherwise(base)
    worth = base + F.when(F.col("heads") == 1, HEADING_SCORE).otherwise(0.0) + F.when(F.col("images") > 0, IMAGE_SCORE).otherwise(0.0) - DEPTH_SCORE * F.col("depth")
    groups = members.withColumn("inside", F.coalesce(inside, F.lit(False))).withColumn("worth", worth).groupBy("page_id", "selector").agg(
        F.count("*").alias("count"), F.bool_or("inside").alias("nested"), F.max("heads").alias("heads"), F.min("links").alias("fewest"), F.max("links").alias("most"),
        F.round(F.max("worth"), 2).alias("score"), F.array_sort(F.collect_list(F.struct("pre", "last"))).alias("places"),
    )
    fit = groups.filter((F.col("count") > 1) & ~F.col("nested") & (F.col("heads") <= 1) & (F.col("fewest") >= 1) & (F.col("most") <= MOST_LINKS))
    entry = F.struct((-F.col("score")).alias("order"), (-F.col("count")).alias("fewer"), F.length("selector").alias("long"), "selector", "count", "score", "places")
    ranked = fit.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))

    def clash(mine: Column, taken: Column) -> Column:
        """Whether any place of one list reaches into the other; neither reaches into itself."""
        tag = lambda places, which: F.transform(places, lambda p: F.struct(p["pre"].alias("pre"), F.lit(which).alias("which"), p["last"].alias("last")))

        def met(e: Column) -> Column:
            ends = lambda which: running_max(F.transform(e, lambda x: F.when(x["which"] == which, x["last"])))
            both = F.struct(ends(0).alias("m"), ends(1).alias("t"))
            return let(both, lambda b: F.exists(F.transform(e, lambda x, k: F.coalesce(F.when(x["which"] == 0, F.get(b["t"], k)).otherwise(F.get(b["m"], k)) >= x["pre"], F.lit(False))), lambda hit: hit))

        return let(F.array_sort(F.concat(tag(mine, 0), tag(taken, 1))), met)

    def choose(acc: Column, p: Column) -> Column:
        def decide(blocked: Column) -> Column:
            taken = F.when(blocked, acc["taken"]).otherwise(F.concat(acc["taken"], p["places"]))
            return F.struct(taken.alias("taken"), F.concat(acc["chosen"], F.array(~blocked)).alias("chosen"))

        return let(clash(p["places"], acc["taken"]), decide)

    start = F.struct(F.array().cast("array<struct<pre:int,last:int>>").alias("taken"), F.array().cast("array<boolean>").alias("chosen"))
    picked = ranked.select("page_id", "all", pin(F.aggregate("all", start, choose)["chosen"]).alias("chosen"))
    rows = picked.select("page_id", "chosen", F.posexplode("all").alias("at", "p"))
    return rows.select("page_id", "p.selector", "p.count", "p.score", (F.col("at") + 1).alias("rank"), F.get("chosen", "at").alias("chosen"))
