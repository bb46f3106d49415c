"""Page markup as a node list, and everything computed from it as Column expressions.

A page's nodes live in one array column in document order. ``last`` is the index
of a node's final descendant, so a subtree is a slice and "inside" is an interval
test. Nothing here shuffles: pages stay where they were read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.columns import let
from newsloom.functions.scans import running_max
from newsloom.functions.text import collapse, escape_html, strip
from newsloom.functions.tokens import read_batch
from newsloom.functions.urls import resolve_url

NODE = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in ("pre", "last", "depth", "parent", "sib", "rsib", "tsib", "rtsib")]
    + [
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)
NODES = T.ArrayType(NODE)


def _read(pages: pa.Array) -> pa.Array:
    return read_batch(pages)


_read.__annotations__ = {"pages": pa.Array, "return": pa.Array}

# Marked nondeterministic so that the optimizer neither copies the parse into a
# pushed-down filter nor runs it twice for two consumers.
page_nodes = F.arrow_udf(_read, returnType=NODES).asNondeterministic()


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def subtree(nodes: Column, node: Column) -> Column:
    return F.slice(nodes, node["pre"] + 1, node["last"] - node["pre"] + 1)


def descendants(nodes: Column, node: Column) -> Column:
    return F.slice(nodes, node["pre"] + 2, node["last"] - node["pre"])


def is_text(node: Column) -> Column:
    return node["tag"] == "#text"


def joined_text(nodes: Column) -> Column:
    return F.array_join(F.transform(F.filter(nodes, is_text), lambda n: n["text"]), "")


def inner_text(nodes: Column, node: Column) -> Column:
    return joined_text(subtree(nodes, node))


# Elements without readable text, and elements that end a run of text.
SKIPPED_TEXT = ("head", "script", "style", "template")
ENTRY_BLOCKS = tuple(
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li ol p pre "
    "section table td th tr ul".split()
)
FILTER_BLOCKS = tuple(
    "address article aside blockquote br caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)


def without_subtrees(nodes: Column, drop) -> Column:
    """``nodes`` minus every node for which ``drop`` holds and all inside it, in one sweep: the last place below a dropped node so far."""

    def sweep(held: Column) -> Column:
        last = running_max(F.transform(held, lambda n: F.when(drop(n), n["last"]).otherwise(-1)))
        return F.when(F.exists(held, drop), let(last, lambda run: F.filter(held, lambda n, i: F.get(run, i) < n["pre"]))).otherwise(held)

    return let(nodes, sweep)


def readable_text(nodes: Column, blocks: tuple[str, ...] = ENTRY_BLOCKS) -> Column:
    """Readable text of a node list: hidden parts skipped, block elements separate words."""

    def visible(kept: Column) -> Column:
        opens = F.transform(
            F.filter(kept, lambda n: is_text(n) | n["tag"].isin(*blocks)),
            lambda n: F.struct(
                n["pre"].alias("at"), F.lit(0).alias("closing"), F.when(is_text(n), n["text"]).otherwise(F.lit(" ")).alias("out")
            ),
        )
        closes = F.transform(
            F.filter(kept, lambda n: n["tag"].isin(*blocks) & (n["last"] > n["pre"])),
            lambda n: F.struct(n["last"].alias("at"), F.lit(1).alias("closing"), F.lit(" ").alias("out")),
        )
        return F.array_join(F.transform(F.array_sort(F.concat(opens, closes)), lambda e: e["out"]), "")

    return collapse(let(without_subtrees(nodes, lambda n: n["tag"].isin(*SKIPPED_TEXT)), visible))


def with_visible_text(df: DataFrame, html: str, name: str, blocks: tuple[str, ...] = ENTRY_BLOCKS) -> DataFrame:
    """Readable text of a markup column. The parse gets its own projection, as a lambda cannot hold one."""
    parsed = df.withColumn("_nodes", page_nodes(html))
    return parsed.withColumn(name, readable_text(F.col("_nodes"), blocks)).drop("_nodes")


# ---------------------------------------------------------------- sanitizing

# The user-content allowlist.
PLAIN_TAGS = tuple(
    "article aside figure section summary details h1 h2 h3 h4 h5 h6 hgroup blockquote br div hr p span wbr abbr "
    "acronym cite code dfn em figcaption mark s samp strong sub sup var q time b i pre small strike tt u rp rt ruby "
    "bdi bdo del ins dl dt dd ol ul li table caption col colgroup thead tr td th tbody tfoot meter progress".split()
)
NEEDS_ATTRIBUTE = ("a", "img", "area", "map")
SKIP_CONTENT = tuple("frame frameset iframe noembed noframes noscript nostyle object script style".split())
VOID_TAGS = tuple("area base br col embed hr img input link meta param source track wbr".split())
GLOBAL_ATTRIBUTES = ("dir", "id", "lang", "title")
TAG_ATTRIBUTES = {
    "a": ("href",),
    "area": ("alt", "coords", "href", "rel", "shape", "usemap"),
    "map": ("name",),
    "img": ("align", "alt", "height", "src", "usemap", "width"),
    "blockquote": ("cite",),
    "q": ("cite",),
    "del": ("cite", "datetime"),
    "ins": ("cite", "datetime"),
    "time": ("datetime",),
    "details": ("open",),
    "ol": ("type",),
    "ul": ("type",),
    "li": ("type", "value"),
    "table": ("height", "summary", "width"),
    "col": ("align", "height", "span", "valign", "width"),
    "colgroup": ("align", "height", "span", "valign", "width"),
    "tr": ("align", "valign"),
    "thead": ("align", "valign"),
    "tbody": ("align", "valign"),
    "tfoot": ("align", "valign"),
    "td": ("abbr", "align", "colspan", "headers", "height", "nowrap", "rowspan", "scope", "valign", "width"),
    "th": ("abbr", "align", "colspan", "headers", "height", "nowrap", "rowspan", "scope", "valign", "width"),
}
PLAIN_TEXT_VALUE = "^[\\p{L}\\p{N}\\s\\-_',\\[\\]!\\./\\\\()&]+$"
VALUE_RULES = {
    "dir": "^(?i:rtl|ltr)$",
    "id": "^[a-zA-Z0-9:\\-_.]+$",
    "lang": "^[a-zA-Z]{2,20}$",
    "title": PLAIN_TEXT_VALUE,
    "alt": PLAIN_TEXT_VALUE,
    "summary": PLAIN_TEXT_VALUE,
    "abbr": PLAIN_TEXT_VALUE,
    "width": "^[0-9]+%?$",
    "height": "^[0-9]+%?$",
    "colspan": "^[0-9]+$",
    "rowspan": "^[0-9]+$",
    "span": "^[0-9]+$",
    "value": "^[0-9]+$",
}


def _kept_attributes(node: Column) -> Column:
    allowed = F.array().cast("array<string>")
    for tag, names in TAG_ATTRIBUTES.items():
        allowed = F.when(node["tag"] == tag, F.array(*[F.lit(n) for n in names])).otherwise(allowed)

    def fits(key: Column, value: Column) -> Column:
        ok = F.when(key.isin("href", "src", "cite"), value != "")
        for name, pattern in VALUE_RULES.items():
            ok = ok.when(key == name, value.rlike(pattern))
        return ok.otherwise(F.lit(True))

    return let(
        allowed,
        lambda names: F.map_filter(
            F.coalesce(node["attrs"], F.create_map().cast("map<string,string>")),
            lambda k, v: (k.isin(*GLOBAL_ATTRIBUTES) | F.array_contains(names, k)) & fits(k, v),
        ),
    )


def _attribute_markup(attrs: Column) -> Column:
    return F.array_join(
        F.transform(
            F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape_html(e["value"]), F.lit('"'))
        ),
        "",
    )


def _open_tag(node: Column) -> Column:
    def render(attrs: Column) -> Column:
        shown = node["tag"].isin(*PLAIN_TAGS) | (node["tag"].isin(*NEEDS_ATTRIBUTE) & (F.size(attrs) > 0))
        follow = F.when(
            node["tag"].isin("a", "area") & F.map_contains_key(attrs, F.lit("href")), F.lit(' rel="nofollow"')
        ).otherwise(F.lit(""))
        close = F.when(node["tag"].isin(*VOID_TAGS), F.lit("/>")).otherwise(F.lit(">"))
        return F.when(shown, F.concat(F.lit("<"), node["tag"], _attribute_markup(attrs), follow, close)).otherwise(F.lit(""))

    return let(_kept_attributes(node), render)


def sanitized(nodes: Column) -> Column:
    """Serialise a node list through the allowlist, in document order.

    Every kept element contributes an opening and a closing event; sorting the
    events by position rebuilds nesting without any row-wise walk.
    """

    def serialise(kept: Column) -> Column:
        opens = F.transform(
            kept,
            lambda n: F.struct(
                n["pre"].alias("at"),
                F.lit(0).alias("rank"),
                F.when(is_text(n), escape_html(n["text"])).otherwise(_open_tag(n)).alias("out"),
                n["tag"].alias("tag"),
                n["last"].alias("last"),
                n["depth"].alias("depth"),
            ),
        )

        def with_closes(opened: Column) -> Column:
            closes = F.transform(
                F.filter(opened, lambda e: F.startswith(e["out"], F.lit("<")) & (e["tag"] != "#text") & ~e["tag"].isin(*VOID_TAGS)),
                lambda e: F.struct(
                    e["last"].alias("at"), (F.lit(100000) - e["depth"]).alias("rank"), F.concat(F.lit("</"), e["tag"], F.lit(">")).alias("out")
                ),
            )
            plain = F.transform(opened, lambda e: F.struct(e["at"].alias("at"), e["rank"].alias("rank"), e["out"].alias("out")))
            return F.array_join(F.transform(F.array_sort(F.concat(plain, closes)), lambda e: e["out"]), "")

        return let(opens, with_closes)

    return let(without_subtrees(nodes, lambda n: n["tag"].isin(*SKIP_CONTENT)), serialise)


def absolute_addresses(nodes: Column, base: Column) -> Column:
    """href and src of every node resolved (unsafe ones empty); an image shows its automatic address."""
    from newsloom.functions.images import content_image

    def fixed(node: Column) -> Column:
        image = node["tag"] == "img"
        listed = F.when(
            image & ~F.map_contains_key(node["attrs"], F.lit("src")),
            F.map_concat(node["attrs"], F.create_map(F.lit("src"), F.lit(""))),
        ).otherwise(node["attrs"])
        attrs = F.transform_values(
            listed,
            lambda k, v: F.when(image & (k == "src"), content_image(node, base))
            .when(k.isin("href", "src"), resolve_url(base, v))
            .otherwise(v),
        )
        touched = image | F.map_contains_key(node["attrs"], F.lit("href")) | F.map_contains_key(node["attrs"], F.lit("src"))
        return F.struct(
            *[F.when(touched, attrs).otherwise(node["attrs"]).alias(f) if f == "attrs" else node[f].alias(f) for f in NODE.names]
        )

    return F.transform(nodes, lambda n: F.when(is_text(n), n).otherwise(fixed(n)))


def shows_anything(nodes: Column) -> Column:
    """The block, its addresses resolved, shows text or an image with an address."""
    kept = without_subtrees(nodes, lambda n: n["tag"].isin(*SKIP_CONTENT))
    return F.exists(
        kept, lambda n: (is_text(n) & (strip(n["text"]) != "")) | ((n["tag"] == "img") & (F.coalesce(attr(n, "src"), F.lit("")) != ""))
    )
