"""Recipe documents: reading, exporting and checking feed configurations."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.programs import problem
from newsloom.functions.rules import problems
from newsloom.functions.text import strip
from newsloom.functions.urls import is_http_url

FORMAT, VERSION = "newsloom.recipes", 1
MAX_FEEDS, MAX_BYTES, MAX_CONFIG = 1000, 2 << 20, 64 << 10
# Recipe enumerations.
MODES = ("static", "browser", "auto", "flaresolverr")
QUIET_CHOICES = (0, -1, 7, 30, 90, 365)

_S = T.StringType()
FIELD = T.StructType([T.StructField("selector", _S), T.StructField("attr", _S)])
FULL = T.StructType([T.StructField("selector", _S), T.StructField("attr", _S), T.StructField("browser", T.BooleanType())])
FILTERS = T.StructType([T.StructField("include", T.VariantType()), T.StructField("exclude", T.VariantType())])
RECIPE = T.StructType(
    [T.StructField(n, _S) for n in ("mode", "wait_selector")]
    + [T.StructField("settle_ms", T.IntegerType())]
    + [T.StructField(n, _S) for n in ("type", "items")]
    + [T.StructField(n, FIELD) for n in ("title", "link", "date", "content", "image")]
    + [T.StructField(n, _S) for n in ("date_layout", "timezone")]
    + [T.StructField("filters", FILTERS), T.StructField("full_content", FULL), T.StructField("remove", T.ArrayType(_S))]
    + [T.StructField(n, _S) for n in ("user_agent", "accept_language")]
    + [T.StructField("quiet_days", T.IntegerType())]
)
PORTABLE = T.StructType(
    [T.StructField("title", _S), T.StructField("url", _S), T.StructField("interval", T.IntegerType()), T.StructField("recipe", RECIPE)]
)
DOCUMENT = T.StructType(
    [T.StructField("format", _S), T.StructField("version", T.IntegerType()), T.StructField("feeds", T.ArrayType(PORTABLE))]
)


def unknown_keys(text: Column, feeds: Column) -> Column:
    """Keys of the document, its feeds (as JSON texts) and their recipes that the format does not know."""
    top = F.json_object_keys(text)
    feed_keys = F.flatten(F.transform(feeds, F.json_object_keys))
    none = F.array().cast("array<string>")
    recipe_keys = F.flatten(F.transform(feeds, lambda f: F.coalesce(F.json_object_keys(F.get_json_object(f, "$.recipe")), none)))
    known = lambda names: F.array(*[F.lit(n) for n in names])
    nested = {**{f: FIELD for f in ("title", "link", "date", "content", "image")}, "full_content": FULL, "filters": FILTERS}

    def inner(name: str) -> Column:
        """Unknown keys of an object inside the recipes, named by their place."""
        keys = F.flatten(F.transform(feeds, lambda f: F.coalesce(F.json_object_keys(F.get_json_object(f, f"$.recipe.{name}")), none)))
        return F.transform(F.array_except(F.coalesce(keys, none), known(nested[name].names)), lambda k: F.concat(F.lit(f"{name}."), k))

    return F.concat(
        F.array_except(top, known(DOCUMENT.names)),
        F.array_except(F.coalesce(feed_keys, F.array().cast("array<string>")), known(PORTABLE.names)),
        F.array_except(F.coalesce(recipe_keys, F.array().cast("array<string>")), known(RECIPE.names)),
        *[inner(name) for name in nested],
    )


def recipe_feeds(documents: DataFrame, text: str = "value") -> DataFrame:
    """Documents as text rows -> (doc rows with error) exploded to one paused feed each."""
    body = F.col(text)
    # A value of another type than its field's leaves the whole text in _bad.
    checked = T.StructType([*DOCUMENT.fields, T.StructField("_bad", _S)])
    # A column of its own: the list of feeds is parsed once, not for each place where keys may stand.
    split = documents.withColumn("_feeds", F.from_json(F.get_json_object(body, "$.feeds"), "array<string>"))
    parsed = split.withColumn("_doc", F.from_json(body, checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("_unknown", unknown_keys(body, F.col("_feeds"))).drop("_feeds")
    count = F.coalesce(F.size("_doc.feeds"), F.lit(0))
    # Inside brackets, anything after the first document is either a second element or a syntax error.
    wrapped = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")
    single = F.coalesce(F.size(wrapped) == 1, F.lit(False)) & F.json_object_keys(body).isNotNull()
    error = (
        F.when(F.octet_length(body) > MAX_BYTES, "the file is over 2 MiB")
        .when(~single, "the file is not one JSON document")
        .when(F.size("_unknown") > 0, F.concat(F.lit("unknown field "), F.get("_unknown", F.lit(0))))
        .when(F.col("_doc._bad").isNotNull(), "a value of another type than its field's")
        .when(F.coalesce(F.col("_doc.format") != FORMAT, F.lit(True)), "another format")
        .when(F.coalesce(F.col("_doc.version") != VERSION, F.lit(True)), "another version of the format")
        .when((count == 0) | (count > MAX_FEEDS), f"the file lists no feed or more than {MAX_FEEDS}")
    )
    return parsed.withColumn("error", error)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipe files under a path: one row per feed, imported paused; bad files give one error row."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return explode_feeds(recipe_feeds(files), ["file"])


def explode_feeds(documents: DataFrame, keep: list[str]) -> DataFrame:
    feeds = F.when(F.col("error").isNull(), F.col("_doc.feeds"))
    rows = documents.select(*keep, "error", F.posexplode_outer(feeds).alias("n", "feed"))
    return rows.select(
        *keep, "error", "n", "feed.title", "feed.url", F.col("feed.interval").alias("interval_s"), "feed.recipe", F.lit(False).alias("enabled")
    )


def export_recipes(feeds: DataFrame) -> DataFrame:
    """Feeds with effective rules as one portable document; too many or too large gives a refusal.

    feeds(feed_id, title, url, interval_s, mode, type, items, include, exclude): rule sides are JSON text.
    """
    rules = F.concat(
        F.lit(',"filters":{'),
        F.concat_ws(
            ",",
            F.when(F.col("include").isNotNull(), F.concat(F.lit('"include":'), F.col("include"))),
            F.when(F.col("exclude").isNotNull(), F.concat(F.lit('"exclude":'), F.col("exclude"))),
        ),
        F.lit("}"),
    )

    def quoted(name: str) -> Column:
        wrapped = F.to_json(F.struct(F.col(name).alias("v")))
        return F.regexp_extract(wrapped, '(?s)^\\{"v":(.*)\\}$', 1)

    recipe = F.concat(
        F.lit('{"mode":'), quoted("mode"), F.lit(',"type":'), quoted("type"), F.lit(',"items":'), quoted("items"),
        F.when(F.coalesce("include", "exclude").isNotNull(), rules).otherwise(""), F.lit("}"),
    )
    line = F.concat(
        F.lit('{"title":'), quoted("title"), F.lit(',"url":'), quoted("url"), F.lit(',"interval":'), F.col("interval_s").cast("string"), F.lit(',"recipe":'), recipe, F.lit("}"),
    )
    bounded = feeds.orderBy("title", "feed_id").limit(MAX_FEEDS + 1)
    one = bounded.select("title", "feed_id", line.alias("line")).agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "feed_id", "line"))), lambda s: s["line"]), ",").alias("body"),
    )
    doc = F.concat(F.lit(f'{{"format":"{FORMAT}","version":{VERSION},"feeds":['), F.col("body"), F.lit("]}"))
    fits = (F.col("n") <= MAX_FEEDS) & (F.octet_length(doc) <= MAX_BYTES)
    return one.select(F.when(fits, doc).alias("doc"), F.when(~fits, "too many or too large for one file").alias("failure"))


def export_recipe_files(feeds: DataFrame, per_file: int = MAX_FEEDS) -> DataFrame:
    """(file, doc): whole recipes with their effective rules in documents of about per_file feeds, which import again as they were.

    feeds(feed_id, title, url, interval_s, recipe STRUCT, include, exclude): rule sides are JSON text. A feed goes to a
    file by a hash of its id, so any number of feeds is exported and no file gathers more than its share.
    """
    files = max(1, -(-feeds.count() // per_file))
    rules = F.struct(F.parse_json("include").alias("include"), F.parse_json("exclude").alias("exclude"))
    recipe = F.col("recipe").withField("filters", F.when(F.coalesce("include", "exclude").isNotNull(), rules))
    entry = F.to_json(F.struct("title", "url", F.col("interval_s").alias("interval"), recipe.alias("recipe")))
    placed = feeds.select(F.pmod(F.xxhash64("feed_id"), F.lit(files)).alias("file"), F.struct("title", "feed_id", entry.alias("entry")).alias("e"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), ",")
    return placed.groupBy("file").agg(F.concat(F.lit(f'{{"format":"{FORMAT}","version":{VERSION},"feeds":['), body, F.lit("]}")).alias("doc"))


def lint_recipes(feeds: DataFrame, zones: DataFrame) -> DataFrame:
    """feeds(feed_id, title, url, interval_s, recipe STRUCT) -> one row per violated rule.

    ``zones(zone)`` is the known time zone table; rows are checked independently, nothing is grouped.
    """
    r = F.col("recipe")
    text = lambda c: F.coalesce(c, F.lit(""))
    is_feed = text(r["type"]) == "feed"
    xpath = text(r["type"]) == "xpath"
    selectors = [("items", text(r["items"]))] + [(n, text(r[n]["selector"])) for n in ("title", "link", "date", "content", "image")]
    attrs = [text(r[n]["attr"]) for n in ("title", "link", "date", "content", "image")]
    any_selector = F.exists(F.array(*[v for _, v in selectors], *attrs), lambda v: v != "")
    too_long = F.exists(F.array(*[v for _, v in selectors]), lambda v: F.octet_length(v) > 1000)
    absolute_field = F.exists(F.array(*[v for n, v in selectors if n != "items"]), lambda v: (v != "") & ~F.startswith(v, F.lit(".")))
    full, remove = r["full_content"], F.coalesce(r["remove"], F.array().cast("array<string>"))
    language = "(?:\\*|[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*) *(?:; *[qQ]=(?:0(?:\\.[0-9]{0,3})?|1(?:\\.0{0,3})?))?"
    agent, accept = text(r["user_agent"]), text(r["accept_language"])
    checks = [
        ("mode", "no such fetch mode", ~text(r["mode"]).isin("", *MODES)),
        ("settle", "settling takes 0 to 5000 ms", ~F.coalesce(r["settle_ms"], F.lit(0)).between(0, 5000)),
        ("wait", "the selector to wait for is over 1000 characters", F.octet_length(text(r["wait_selector"])) > 1000),
        ("type", "no such selector type", ~text(r["type"]).isin("css", "xpath", "feed")),
        ("required", "items and title need a selector", ~is_feed & ((strip(text(r["items"])) == "") | (strip(text(r["title"]["selector"])) == ""))),
        ("length", "a selector is over 1000 characters", too_long),
        ("relative", "an XPath field begins with a point", xpath & absolute_field),
        ("feed mode", "feed documents are fetched without rendering", is_feed & ~text(r["mode"]).isin("", "static")),
        ("feed fields", "feed documents have no selectors", is_feed & any_selector),
        ("full selector", "articles need a selector", full.isNotNull() & (strip(text(full["selector"])) == "")),
        ("full length", "a selector is over 1000 characters", full.isNotNull() & (F.octet_length(text(full["selector"])) > 1000)),
        ("full attr", "an attribute name is over 200 characters", full.isNotNull() & (F.octet_length(text(full["attr"])) > 200)),
        ("full render", "articles of feed documents are not rendered", is_feed & F.coalesce(full["browser"], F.lit(False))),
        ("cleanup count", "more than 20 cleanup rules", F.size(remove) > 20),
        ("cleanup text", "a cleanup rule is empty, padded, broken over lines or over 1000 characters", F.exists(remove, lambda v: (v == "") | (strip(v) != v) | v.rlike("[\\r\\n]") | (F.octet_length(v) > 1000))),
        ("cleanup xpath", "an XPath cleanup rule begins with ./", xpath & F.exists(remove, lambda v: ~F.startswith(v, F.lit("./")))),
        ("zone", "no such time zone", (text(r["timezone"]) != "") & F.col("_zone").isNull()),
        ("title", "the title is empty or over 200 characters", (strip(text(F.col("title"))) == "") | (F.octet_length("title") > 200)),
        ("url length", "the address is over 4096 characters", F.octet_length("url") > 4096),
        ("url", "the address is no plain web address", ~is_http_url("url")),
        ("interval", "the interval is not within a minute and a week", ~F.coalesce(F.col("interval_s").between(60, 604800), F.lit(False))),
        ("selector", "brackets, parentheses or quotes of a selector don't pair up", F.exists(F.array(*[v for _, v in selectors], text(full["selector"])), unbalanced) | F.exists(remove, unbalanced)),
        ("quiet", "no such choice of quiet days", ~F.coalesce(r["quiet_days"], F.lit(0)).isin(*QUIET_CHOICES)),
        ("agent", "the user agent is padded, not ASCII or over 256 characters", (F.octet_length(agent) > 256) | ~agent.rlike("^[ -~]*$") | (F.trim(agent) != agent)),
        ("language", "the languages are not a list of up to 10 ranges", (accept != "") & ((F.octet_length(accept) > 128) | ~accept.rlike(f"^{language}(?: *, *{language}){{0,9}}$"))),
        ("size", "the whole configuration is over 64 KiB", F.octet_length(F.to_json(F.struct("title", "url", "interval_s", "recipe"))) > MAX_CONFIG),
    ]
    found = F.filter(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(message).alias("message"))) for name, message, test in checks]),
        lambda v: v.isNotNull(),
    )
    zoned = feeds.join(zones.select(F.col("zone").alias("_zone")), F.col("recipe.timezone") == F.col("_zone"), "left")
    return zoned.select("feed_id", F.inline(found))


def _refusals(kinds: pa.Array, selectors: pa.Array, rules: pa.Array) -> pa.Array:
    """Selectors that can't be read and rule trees out of bounds, for every recipe of a batch."""
    out = []
    for kind, named, sides in zip(kinds.to_pylist(), selectors.to_pylist(), rules.to_pylist(), strict=True):
        found = []
        if kind in ("css", "xpath"):
            for at in named or []:
                text, place = (at["selector"] or "").strip(), at["place"]
                why = problem(text, kind, place not in ("items", "full_content")) if text not in ("", ".") else None
                found += [{"rule": "selector", "message": f"{place}: {why}"}] if why else []
        try:
            trees = [json.loads(s) if s else None for s in (sides["include"], sides["exclude"])]
            found += [{"rule": "filters", "message": name} for name in problems(*trees)]
        except ValueError:
            found.append({"rule": "filters", "message": "shape"})
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("rule", pa.string()), ("message", pa.string())])))


_refusals.__annotations__ = {"kinds": pa.Array, "selectors": pa.Array, "rules": pa.Array, "return": pa.Array}
refusals = F.arrow_udf(_refusals, returnType=T.ArrayType(T.StructType([T.StructField("rule", _S), T.StructField("message", _S)])))


def lint_contents(feeds: DataFrame) -> DataFrame:
    """feeds(feed_id, recipe STRUCT) -> (feed_id, rule, message) for selectors that can't be read and filters that can't be applied."""
    r = F.col("recipe")
    place = lambda name, c: F.struct(F.lit(name).alias("place"), c.alias("selector"))
    named = [place("items", r["items"]), *[place(n, r[n]["selector"]) for n in ("title", "link", "date", "content", "image")], place("full_content", r["full_content"]["selector"])]
    removed = F.transform(F.coalesce(r["remove"], F.array().cast("array<string>")), lambda v: place("remove", v))
    sides = F.struct(*[F.to_json(r["filters"][s]).alias(s) for s in ("include", "exclude")])
    return feeds.select("feed_id", F.explode(refusals(r["type"], F.concat(F.array(*named), removed), sides)).alias("x")).select("feed_id", "x.*")


def unbalanced(selector: Column) -> Column:
    """Brackets, parentheses or quotes that don't pair up outside of quoted text."""
    bare = F.regexp_replace(F.coalesce(selector, F.lit("")), "\"[^\"]*\"|'[^']*'", "")
    differ = lambda a, b: F.regexp_count(bare, F.lit(a)) != F.regexp_count(bare, F.lit(b))
    return differ("\\[", "\\]") | differ("\\(", "\\)") | bare.rlike("[\"']")


def looks_leftover(selector: Column) -> Column:
    """An XPath whose first complete expression ends before the text does, as a CSS selector's does.

    Quoted text, predicates and arguments are taken out; what is left of an XPath has neither a comma nor two names with
    only space between them, unless one is an operator, nor a name right after a leading point.
    """
    bare = F.regexp_replace(F.coalesce(selector, F.lit("")), "\"[^\"]*\"|'[^']*'", "")
    for _ in range(4):
        bare = F.regexp_replace(bare, "\\[[^\\[\\]]*\\]|\\([^()]*\\)", "")
    bare = F.regexp_replace(bare, "\\s+(?:and|or|div|mod)\\s+", "|")
    return bare.rlike("^\\s*\\.\\s*[A-Za-z_#-]") | bare.rlike("[,#>]") | bare.rlike("[A-Za-z0-9_*.-]\\s+[A-Za-z0-9_*.]")


def lint_leftovers(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new/stored(feed_id, field, selector) of XPath recipes: 'refused' when newly introduced, else 'warned'."""
    old = stored.select("feed_id", "field", F.trim("selector").alias("_stored"))
    joined = new.filter(looks_leftover(F.col("selector"))).join(old, ["feed_id", "field"], "left")
    kept = F.coalesce(F.col("_stored") == F.trim("selector"), F.lit(False))
    return joined.select("feed_id", "field", F.when(kept, "warned").otherwise("refused").alias("action"))


def known_zones(spark: SparkSession) -> DataFrame:
    from zoneinfo import available_timezones

    return spark.createDataFrame([(z,) for z in sorted(available_timezones())], "zone string")


