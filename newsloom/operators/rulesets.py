"""Rules as data: trees stored as adjacency rows, evaluated for all feeds in one job."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import rules as R
from newsloom.functions.columns import let, pin
from newsloom.functions.text import fold

NODE_SCHEMA = "set_id string, side string, node_id int, parent_id int, depth int, op string, field string, ordinal int"
KEYWORD_SCHEMA = "set_id string, node_id int, keyword string"


def flatten_rules(sets: dict[str, R.RuleSet]) -> tuple[list[tuple], list[tuple]]:
    """Adjacency rows and keyword rows of rule sets; sizes are bounded per set (128 nodes, 500 keywords)."""
    nodes, keywords = [], []
    for set_id, rule_set in sets.items():
        counter = 0

        def walk(rule: dict, side: str, parent: int, depth: int, ordinal: int) -> None:
            nonlocal counter
            counter += 1
            me = counter
            nodes.append((set_id, side, me, parent, depth, rule.get("op"), rule.get("field"), ordinal))
            for keyword in rule.get("keywords") or []:
                keywords.append((set_id, me, keyword))
            for at, child in enumerate(rule.get("rules") or []):
                walk(child, side, me, depth + 1, at)

        for side in ("include", "exclude"):
            root = getattr(rule_set, side)
            if root is not None:
                walk(root, side, 0, 1, 0)
    return nodes, keywords


def rule_tables(spark: SparkSession, sets: dict[str, R.RuleSet]) -> tuple[DataFrame, DataFrame]:
    nodes, keywords = flatten_rules(sets)
    return spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(keywords, KEYWORD_SCHEMA)


def set_arrays(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row per rule set holding its nodes; bounded by the rule limits (128 nodes, 500 keywords)."""
    words = keywords.groupBy("set_id", "node_id").agg(F.collect_list(fold("keyword")).alias("keywords"))
    full = nodes.join(words, ["set_id", "node_id"], "left")
    node = F.struct("node_id", "parent_id", "depth", "side", "op", "field", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    return full.groupBy("set_id").agg(F.collect_list(node).alias("nodes"))


def evaluate_rules(items: DataFrame, nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """items(set_id, item_id, title, description, url) -> (set_id, item_id, include, exclude) verdicts.

    Every item meets its own set once, as an array, and the tree closes bottom-up inside the
    row: no item x keyword row exists and nothing is shuffled by item.
    """
    joined = items.join(set_arrays(nodes, keywords), "set_id")
    sides = joined.select("set_id", "item_id", pin(closed_sides(F.col("nodes"), F.col("title"), F.col("description"), F.col("url"))).alias("sides"))
    return sides.select("set_id", "item_id", "sides.include", "sides.exclude")


def closed_sides(nodes: Column, title: Column, description: Column, link: Column) -> Column:
    """struct(include, exclude): what the rule trees of an array of nodes, with folded keywords, say of a story; NULL for no tree."""

    def state(n: Column, value: Column) -> Column:
        return F.struct(*[n[f].alias(f) for f in ("node_id", "parent_id", "depth", "side", "op")], value.alias("value"))

    def close(values: Column, depth: Column) -> Column:
        def group_value(n: Column) -> Column:
            below = F.transform(F.filter(values, lambda c: c["parent_id"] == n["node_id"]), lambda c: c["value"])
            return F.when(n["op"] == "all", F.forall(below, lambda v: v)).otherwise(F.exists(below, lambda v: v))

        return F.transform(
            values, lambda n: state(n, F.when((n["depth"] == depth) & n["op"].isin(*R.GROUPS), group_value(n)).otherwise(n["value"]))
        )

    def judged(texts: Column) -> Column:
        def leaf_value(n: Column) -> Column:
            value = F.when(n["field"] == "title", texts["title"]).when(n["field"] == "description", texts["description"]).otherwise(texts["link"])

            def hit(keyword: Column) -> Column:
                return F.contains(value, keyword)

            return F.when(n["op"] == "contains_any", F.exists(n["keywords"], hit)).when(n["op"] == "contains_all", F.forall(n["keywords"], hit))

        leaves = F.transform(nodes, lambda n: state(n, leaf_value(n)))
        return F.aggregate(F.sequence(F.lit(R.MAX_DEPTH), F.lit(1), F.lit(-1)), leaves, close)

    def roots(tree: Column) -> Column:
        def root(side: str) -> Column:
            return F.get(F.transform(F.filter(tree, lambda n: (n["parent_id"] == 0) & (n["side"] == side)), lambda n: n["value"]), F.lit(0)).alias(side)

        return F.struct(root("include"), root("exclude"))

    folded = F.struct(fold(F.coalesce(title, F.lit(""))).alias("title"), fold(F.coalesce(description, F.lit(""))).alias("description"), fold(F.coalesce(link, F.lit(""))).alias("link"))
    return let(let(folded, judged), roots)


def keep_by_rules(verdicts: DataFrame) -> DataFrame:
    """Keep iff (no include side or it matches) and not (exclude side matches)."""
    return verdicts.withColumn("keep", F.coalesce("include", F.lit(True)) & ~F.coalesce("exclude", F.lit(False)))


def lint_rules(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """Violations per rule set: bounds over both sides together, and malformed nodes."""
    kids = nodes.groupBy("set_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    words = keywords.groupBy("set_id", "node_id").agg(
        F.count("*").alias("words"),
        F.count_if((F.trim("keyword") == "") | (F.char_length(F.trim("keyword")) > R.MAX_KEYWORD_LENGTH)).alias("bad_words"),
    )
    group, leaf = F.col("op").isin(*R.GROUPS), F.col("op").isin(*R.LEAVES)
    narrow = nodes.select(
        "set_id", "node_id", "depth", group.alias("group"), leaf.alias("leaf"),
        (F.coalesce("field", F.lit("")) != "").alias("has_field"), (~F.coalesce("field", F.lit("")).isin(*R.FIELDS)).alias("bad_field"),
    )
    # Both sides grow with the rule sets, however small a plan takes them to be: neither is ever broadcast.
    full = (
        narrow.join(kids.hint("merge"), ["set_id", "node_id"], "left")
        .join(words.hint("merge"), ["set_id", "node_id"], "left")
        .na.fill(0, ["children", "words", "bad_words"])
    )
    group, leaf = F.col("group"), F.col("leaf")
    flags = full.groupBy("set_id").agg(
        F.count("*").alias("nodes"),
        F.max("depth").alias("depth"),
        F.sum("words").alias("keywords"),
        F.sum("bad_words").alias("bad_keywords"),
        F.count_if(~group & ~leaf).alias("bad_ops"),
        F.count_if(group & ((F.col("children") == 0) | (F.col("words") > 0) | F.col("has_field"))).alias("bad_groups"),
        F.count_if(leaf & ((F.col("children") > 0) | (F.col("words") == 0))).alias("bad_leaves"),
        F.count_if(leaf & F.col("bad_field")).alias("bad_fields"),
    )
    checks = [
        ("nodes", F.col("nodes") > R.MAX_NODES),
        ("depth", F.col("depth") > R.MAX_DEPTH),
        ("keywords", F.col("keywords") > R.MAX_KEYWORDS),
        ("keyword text", F.col("bad_keywords") > 0),
        ("operator", F.col("bad_ops") > 0),
        ("group", F.col("bad_groups") > 0),
        ("leaf", F.col("bad_leaves") > 0),
        ("field", F.col("bad_fields") > 0),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks]), lambda v: v.isNotNull())
    return flags.select("set_id", "nodes", "depth", "keywords", F.array_join(found, ",").alias("violations"))


MAX_LINKS = 16


def effective_filters(feeds: DataFrame, links: DataFrame, filters: DataFrame, most: int = MAX_LINKS) -> DataFrame:
    """Per feed, own rules and library filters joined side by side as JSON parts in link order.

    feeds(feed_id, own_include, own_exclude); filters(filter_id, include, exclude): JSON of one rule or NULL.
    Parts whose root already uses the joining operator are spliced, as text, into the group. A feed whose links name an
    unknown filter, one filter twice or more than ``most`` has no rules but a failure.
    """
    known = filters.select("filter_id", "include", "exclude", F.lit(True).alias("_known"))
    linked = links.join(known, "filter_id", "left")
    parts = linked.groupBy("feed_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "include", "exclude"))).alias("parts"),
        F.count_if(F.col("_known").isNull()).alias("_missing"),
        (F.count("*") - F.count_distinct("filter_id")).alias("_repeated"),
        F.count("*").alias("_links"),
    )
    joined = feeds.join(parts, "feed_id", "left")
    failure = F.when(F.col("_missing") > 0, "unknown filter").when(F.col("_repeated") > 0, "repeated filter").when(F.col("_links") > most, "too many filters")

    def side(name: str, op: str):
        own = F.filter(F.array(F.col(f"own_{name}")), lambda v: v.isNotNull())
        shared = F.filter(
            F.transform(F.coalesce("parts", F.array().cast("array<struct<position:int,include:string,exclude:string>>")), lambda p: p[name]),
            lambda v: v.isNotNull(),
        )
        every = F.concat(own, shared)
        head = f'{{"op":"{op}","rules":['

        def inner(v):
            rules = F.get_json_object(v, "$.rules")
            return F.when((F.get_json_object(v, "$.op") == op) & rules.isNotNull(), F.substring(rules, F.lit(2), F.length(rules) - 2)).otherwise(v)

        spliced = F.transform(every, inner)
        return F.when(F.size(every) == 1, every[0]).when(F.size(every) > 1, F.concat(F.lit(head), F.array_join(spliced, ","), F.lit("]}")))

    sound = failure.isNull()
    return joined.select("feed_id", F.when(sound, side("include", "all")).alias("include"), F.when(sound, side("exclude", "any")).alias("exclude"), failure.alias("failure"))


def filter_usage(filters: DataFrame, links: DataFrame) -> DataFrame:
    """Library filters with the number of feeds using them; unused ones may be deleted."""
    used = links.groupBy("filter_id").agg(F.countDistinct("feed_id").alias("feeds"))
    return filters.select("filter_id", "name").join(used, "filter_id", "left").select(
        "filter_id", "name", F.coalesce("feeds", F.lit(0)).alias("feeds"), F.col("feeds").isNull().alias("deletable")
    )


def rule_json(rule: dict | None) -> str | None:
    """One rule as compact JSON with the operator first, as the splice expects."""
    if rule is None:
        return None
    ordered = {k: rule[k] for k in ("op", "rules", "field", "keywords") if k in rule}
    if "rules" in ordered:
        inner = ",".join(rule_json(r) for r in ordered["rules"])
        return f'{{"op":{json.dumps(rule["op"])},"rules":[{inner}]}}'
    return json.dumps(ordered, separators=(",", ":"), ensure_ascii=False)
