"""Extraction for any number of feeds at once: recipes are rows, and one plan reads every page by its feed's row.

``compile_recipes`` turns the selectors, layouts, zones and rules of a recipe table into arrays, in tasks. ``read_pages``
joins captures to them and interprets the arrays, stage by stage: which nodes, which texts, which markup, which dates,
which verdict. Each stage is a projection over the page's cards, so pages stay where they were read, and the plan is
the same for one recipe and for a million.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.functions import dates, images, markup
from newsloom.functions import rules as R
from newsloom.functions.columns import first_of, let, pin
from newsloom.functions.markup import attr, is_text
from newsloom.functions.programs import PROGRAM, View, first_places, fresh, hits, let_sql, marked_sql, next_place_sql, program, running_max_sql
from newsloom.functions.selectors import SelectorError, node_value
from newsloom.functions.text import collapse, escape_html, fold_text, strip
from newsloom.functions.urls import resolve_url
from newsloom.operators import extract as X
from newsloom.operators.rulesets import closed_sides, flatten_rules

FIELDS = ("title", "link", "date", "content", "image")
RECIPES = T.StructType(
    [T.StructField("feed_id", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("items", T.StringType())]
    + [T.StructField(n, T.StringType()) for f in FIELDS for n in (f, f"{f}_attr")]
    + [T.StructField("date_layout", T.StringType()), T.StructField("timezone", T.StringType()), T.StructField("remove", T.ArrayType(T.StringType()))]
    + [T.StructField("include", T.StringType()), T.StructField("exclude", T.StringType())]
)
FIELD = T.StructType([T.StructField("stated", T.BooleanType()), T.StructField("attr", T.StringType()), T.StructField("program", PROGRAM)])
RULE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("node_id", "parent_id", "depth")]
    + [T.StructField(n, T.StringType()) for n in ("side", "op", "field")]
    + [T.StructField("keywords", T.ArrayType(T.StringType()))]
)
RECIPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("items", PROGRAM),
        T.StructField("fields", T.ArrayType(FIELD)),
        T.StructField("layout", dates.LAYOUT),
        T.StructField("timezone", T.StringType()),
        T.StructField("zones", T.ArrayType(dates.PERIOD)),
        T.StructField("remove", T.ArrayType(PROGRAM)),
        T.StructField("rules", T.ArrayType(RULE)),
        T.StructField("include_reason", T.StringType()),
        T.StructField("exclude_reason", T.StringType()),
    ]
)
COMPILED = T.StructType([T.StructField("feed_id", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("recipe", RECIPE), T.StructField("refused", T.StringType())])


# ------------------------------------------------------------------ compiling


def recipe_row(feed_id: str, recipe: X.Recipe, version: int = 1) -> dict:
    """A recipe as a row of RECIPES."""
    out = {"feed_id": feed_id, "version": version, "kind": recipe.kind, "items": recipe.items, "date_layout": recipe.date_layout, "timezone": recipe.timezone, "remove": list(recipe.remove)}
    for name in FIELDS:
        spec = getattr(recipe, name)
        out |= {name: spec.selector, f"{name}_attr": spec.attr}
    for side in ("include", "exclude"):
        rule = getattr(recipe.rules, side)
        out[side] = json.dumps(rule) if rule is not None else None
    return out


def recipe_table(spark: SparkSession, recipes: dict[str, X.Recipe]) -> DataFrame:
    rows = [recipe_row(feed, recipe) for feed, recipe in recipes.items()]
    return spark.createDataFrame([tuple(r[f] for f in RECIPES.names) for r in rows], RECIPES)


def compiled(row: dict, zones: dict[str, list]) -> dict:
    """The recipe of a row as arrays; SelectorError or ValueError for what can't be read."""
    kind = row["kind"] or "css"
    scoped = kind == "xpath"

    def read(name: str, selector: str | None, within: bool = scoped) -> dict:
        try:
            return program((selector or "").strip(), kind, within)
        except (SelectorError, IndexError) as bad:
            raise SelectorError(f"{name}: {bad}") from bad

    fields = [{"stated": bool(row[f]), "attr": (row[f"{f}_attr"] or "").lower(), "program": read(f, row[f])} for f in FIELDS]
    if not row["items"]:
        raise SelectorError("items: no selector")
    sides = {s: json.loads(row[s]) if row[s] else None for s in ("include", "exclude")}
    nodes, words = flatten_rules({"": R.RuleSet(**sides)})
    held: dict[int, list[str]] = {}
    for _, node, word in words:
        held.setdefault(node, []).append(fold_text(word))
    rules = [
        {"node_id": n, "parent_id": p, "depth": d, "side": side, "op": op, "field": at, "keywords": held.get(n, [])} for _, side, n, p, d, op, at, _ in nodes
    ]
    zone = row["timezone"] or "UTC"
    if zone not in zones:
        zones[zone] = dates.period_rows(zone)
    return {
        "kind": kind,
        "items": read("items", row["items"], False),
        "fields": fields,
        "layout": dates.layout_row(row["date_layout"]) if row["date_layout"] else None,
        "timezone": zone,
        "zones": zones[zone],
        "remove": [read("remove", r) for r in row["remove"] or []],
        "rules": rules,
        **{f"{s}_reason": R.reason_text(sides[s], s == "exclude") if sides[s] else None for s in sides},
    }


def _compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(COMPILED)
    zones: dict[str, list] = {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            try:
                made, refused = compiled(row, zones), None
            except Exception as bad:  # noqa: BLE001 - every row gets a recipe or the reason why it has none
                made, refused = None, str(bad) or type(bad).__name__
            out.append({"feed_id": row["feed_id"], "version": row["version"], "recipe": made, "refused": refused})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def compile_recipes(recipes: DataFrame) -> DataFrame:
    """feed_id, version, recipe and refused: what RECIPES rows say as arrays, or why they can't be read."""
    return recipes.select(*[F.col(f.name).cast(f.dataType) for f in RECIPES]).mapInArrow(_compile, COMPILED)


# -------------------------------------------------------------------- reading


#: Position of a field among the fields of a recipe.
TITLE, LINK, DATE, BODY, IMAGE = range(5)
_PAGE = View("nodes")


def _matched() -> Column:
    """Cards of a page, and for every field the next match from each place on; SQL over the columns nodes and recipe."""
    f, g = fresh(), fresh()
    paged = f"recipe.kind <> 'xpath' AND size({f}.program.paths) > 0"
    places = let_sql(hits(_PAGE, f"{f}.program"), lambda h: first_places(_PAGE, h))
    nexts = f"transform(recipe.fields, {f} -> CASE WHEN {paged} THEN {places} END)"
    pictures = f"CASE WHEN NOT get(recipe.fields, {IMAGE}).stated THEN {next_place_sql(f'transform(nodes, {g} -> {g}.tag = {chr(39)}img{chr(39)})')} END"
    return F.expr(f"named_struct('cards', {hits(_PAGE, 'recipe.items')}, 'nexts', {nexts}, 'pictures', {pictures})")


def _picked() -> Column:
    """What every card's fields select; a page over the card limit fails whole, so its cards are not read. SQL over nodes, recipe and m."""
    hit, position, f, k = (fresh() for _ in range(4))
    named = ", ".join(
        f"'{c}', " + {"tag": "concat('@', {h}.attr)", "text": "try_element_at({n}.attrs, {h}.attr)", "attrs": "cast(map() AS map<string,string>)"}.get(c, f"{{n}}.{c}") for c in markup.NODE.names
    )

    def field(card: str) -> str:
        place = f"get(get(m.nexts, {k}), {card}.pre + 1)"
        inside = f"CASE WHEN {place} <= {card}.last THEN get(nodes, {place}) END"

        def of_hit(h: str) -> str:
            return let_sql(f"get(nodes, {h}.at)", lambda n: f"CASE WHEN {h}.attr = '' THEN {n} WHEN {h}.attr IS NOT NULL THEN named_struct({named.format(h=h, n=n)}) END")

        scoped = let_sql(f"slice(nodes, {card}.pre + 1, {card}.last - {card}.pre + 1)", lambda below: let_sql(f"get({hits(View(below, f'{card}.pre'), f'{f}.program')}, 0)", of_hit))
        return f"CASE WHEN {f}.program.itself THEN {card} WHEN recipe.kind = 'xpath' THEN {scoped} ELSE {inside} END"

    def read(card: str) -> str:
        place = f"get(m.pictures, {card}.pre + 1)"
        found = f"transform(recipe.fields, ({f}, {k}) -> {field(card)})"
        return f"named_struct('pos', {position}, 'found', {found}, 'picture', CASE WHEN {place} <= {card}.last THEN get(nodes, {place}) END)"

    readable = f"CASE WHEN size(m.cards) <= {X.MAX_CARDS} THEN m.cards ELSE slice(m.cards, 1, 0) END"
    return F.expr(f"transform({readable}, ({hit}, {position}) -> {let_sql(f'get(nodes, {hit}.at)', read)})")


def _said(nodes: Column, recipe: Column, cards: Column) -> Column:
    """The raw values of every card's fields, and the block of its description."""

    def values(c: Column) -> Column:
        def value(n: Column, k: Column) -> Column:
            name = F.when((k == 1) & (F.get(recipe["fields"], k)["attr"] == ""), "href").otherwise(F.get(recipe["fields"], k)["attr"])
            named = F.coalesce(F.try_element_at(n["attrs"], name), F.lit(""))
            return F.when(n.isNull(), "").otherwise(F.when((name != "") & ~X._is_attribute(n), named).otherwise(F.coalesce(node_value(nodes, n), F.lit(""))))

        def block(n: Column) -> Column:
            whole = n.isNotNull() & (F.get(recipe["fields"], 3)["attr"] == "") & ~X._is_attribute(n)
            return F.when(whole, markup.subtree(nodes, n))

        return F.struct(c["pos"].alias("pos"), c["found"].alias("found"), c["picture"].alias("picture"), F.transform(c["found"], value).alias("raw"), block(F.get(c["found"], 3)).alias("block"))

    return F.transform(cards, values)


def _swept() -> Column:
    """For each card which nodes of its block the cleanup programs remove, rule after rule, never the block's own node; SQL over c and recipe."""
    c, gone, rule, n, h, g, m, i = (fresh() for _ in range(8))
    block = f"{c}.block"
    base = f"get({block}, 0).pre"
    view = View(block, base, gone)
    chosen = f"transform(filter({hits(view, rule)}, {h} -> {h}.at <> {base}), {g} -> {g}.at)"
    last = lambda flags: running_max_sql(view.flagged(flags, "last", "-1"))
    sweep = let_sql(marked_sql(view.places(), chosen), lambda flags: let_sql(last(flags), lambda run: f"transform({block}, ({m}, {i}) -> get({gone}, {i}) OR get({run}, {i}) >= {m}.pre)"))
    swept = f"aggregate(recipe.remove, transform({block}, {n} -> false), ({gone}, {rule}) -> {sweep})"
    return F.expr(f"transform(c, {c} -> CASE WHEN {block} IS NOT NULL AND size(recipe.remove) > 0 THEN {swept} END)")


_BLOCKS = tuple(t for t in markup.FILTER_BLOCKS if t in markup.PLAIN_TAGS)


def _shown(block: Column) -> Column:
    return markup.without_subtrees(block, lambda n: n["tag"].isin(*markup.SKIP_CONTENT))


def _cleaned(cards: Column, swept: Column, base: Column) -> Column:
    """Every description with resolved addresses, and what cleanup leaves of it; rules read the page as it was written."""

    def one(c: Column, k: Column) -> Column:
        def left(b: Column) -> Column:
            kept = F.when(b["gone"].isNull(), b["whole"]).otherwise(F.filter(b["whole"], lambda n, i: ~F.get(b["gone"], i)))
            return F.struct(*[c[f].alias(f) for f in ("pos", "found", "picture", "raw")], kept.alias("kept"), F.when(b["gone"].isNotNull(), b["whole"]).alias("whole"))

        return let(F.struct(markup.absolute_addresses(c["block"], base).alias("whole"), F.get(swept, k).alias("gone")), left)

    return F.transform(cards, one)


def _published(cards: Column, recipe: Column) -> Column:
    """Markup, text and whether cleanup emptied the description, in place of the blocks."""
    nothing = F.struct(F.lit("").alias("html"), F.lit("").alias("text"), F.lit(False).alias("emptied"))

    def one(c: Column) -> Column:
        node = F.get(c["found"], 3)
        raw = F.get(c["raw"], 3)
        literal = F.struct(escape_html(raw).alias("html"), collapse(raw).alias("text"), F.lit(False).alias("emptied"))

        def content(shown: Column) -> Column:
            empty = ~markup.shows_anything(shown) & F.coalesce(markup.shows_anything(c["whole"]), F.lit(False))
            full = F.struct(markup.sanitized(shown).alias("html"), markup.readable_text(shown, _BLOCKS).alias("text"), F.lit(False).alias("emptied"))
            return F.when(node.isNull(), nothing).when(c["kept"].isNull(), literal).when(empty, nothing.withField("emptied", F.lit(True))).otherwise(full)

        return F.struct(c["pos"].alias("pos"), c["found"].alias("found"), c["picture"].alias("picture"), c["raw"].alias("raw"), let(_shown(c["kept"]), content).alias("content"))

    return F.transform(cards, one)


def _addressed(cards: Column, recipe: Column, base: Column) -> Column:
    """Link and image addresses."""

    def one(c: Column) -> Column:
        node = F.get(c["found"], 4)
        stated = F.get(recipe["fields"], 4)
        as_value = (stated["attr"] != "") | X._is_attribute(node)
        pictured = F.coalesce(node, F.when(~stated["stated"], c["picture"]))
        image = F.when(as_value & node.isNotNull(), resolve_url(base, F.get(c["raw"], 4))).when(pictured.isNotNull(), images.story_image(pictured, base)).otherwise("")
        kept = [c[f].alias(f) for f in ("pos", "found", "raw", "content")]
        return F.struct(*kept, resolve_url(base, F.get(c["raw"], 1)).alias("url"), image.alias("image"))

    return F.transform(cards, one)


def _dated(cards: Column, recipe: Column, observed: Column) -> Column:
    def one(c: Column) -> Column:
        node, stated = F.get(c["found"], 2), F.get(recipe["fields"], 2)
        element = node.isNotNull() & ~is_text(node) & ~X._is_attribute(node)
        exact = F.when(element & (stated["attr"] == ""), attr(node, "datetime"))

        def read(e: Column) -> Column:
            found = dates.published(e, F.nullif(F.get(c["raw"], 2), F.lit("")), observed, recipe["layout"], recipe["timezone"], recipe["zones"])
            none = F.struct(F.lit(None).cast("timestamp").alias("published"), F.lit(False).alias("estimated"), F.lit("").alias("source"))
            kept = [c[f].alias(f) for f in ("pos", "found", "raw", "content", "url", "image")]
            return F.struct(*kept, F.coalesce(e, F.lit("")).alias("datetime"), F.when(stated["stated"], found).otherwise(none).alias("date"))

        return let(exact, read)

    return F.transform(cards, one)


def _stories(cards: Column, recipe: Column, asks: dict[str, bool]) -> Column:
    """Identity, warnings and the verdict of the feed's rules."""
    stated = lambda k: F.get(recipe["fields"], k)["stated"]
    attribute = lambda k: F.get(recipe["fields"], k)["attr"]

    def one(c: Column) -> Column:
        node = lambda k: F.get(c["found"], k)
        raw = lambda k: F.get(c["raw"], k)
        number = F.concat(F.lit("Match "), (c["pos"] + 1).cast("string"))
        title = raw(0)
        key = F.when(c["url"] != "", c["url"]).otherwise(F.when(stated(1), "").otherwise(X.sha(title, "title:")))

        def judged(k: Column) -> Column:
            reason = F.when(title == "", F.lit(X.NO_TITLE)).when(k == "", F.lit(X.NO_ADDRESS))
            valid = reason.isNull()
            link_attr = F.when(attribute(1) == "", "href").otherwise(attribute(1))
            empty_title = F.concat(F.lit(f"{X.SKIPPED}{X.NO_TITLE}; "), X.mismatch("Title", X.WANT_TEXT, title, node(0), attribute(0)))
            empty_link = F.concat(F.lit(f"{X.SKIPPED}{X.NO_ADDRESS}; "), X.mismatch("Link", X.WANT_URL, raw(1), node(1), link_attr))
            no_content = F.concat(F.lit(": "), X.mismatch("Content", X.WANT_CONTENT, raw(3), node(3), attribute(3)), F.lit(X.CONTENT_OMITTED))
            held = F.filter(
                F.array(*[F.lit(a) for a in images.USUAL_ATTRIBUTES + images.USUAL_SRCSETS]),
                lambda a: strip(F.coalesce(F.try_element_at(node(4)["attrs"], a), F.lit(""))) != "",
            )
            automatic = node(4).isNotNull() & (attribute(4) == "") & ~X._is_attribute(node(4))
            image_attr = F.when(automatic, F.coalesce(first_of(held), F.lit("src"))).otherwise(attribute(4))
            image_raw = F.when(automatic, F.coalesce(F.try_element_at(node(4)["attrs"], first_of(held)), F.lit(""))).otherwise(raw(4))
            no_image = F.concat(F.lit(": "), X.mismatch("Image", X.WANT_IMAGE, image_raw, node(4), image_attr), F.lit(X.IMAGE_OMITTED))
            from_attr = (strip(raw(2)) == "") & (attribute(2) == "") & (c["datetime"] != "")
            date_raw = F.when(from_attr, c["datetime"]).otherwise(raw(2))
            no_date = F.concat(F.lit(X.NO_DATE), X.mismatch("Date", X.WANT_DATE, date_raw, node(2), F.when(from_attr, "datetime").otherwise(attribute(2))), F.lit(X.FIRST_SEEN_USED))
            emptied = c["content"]["emptied"]
            parts = {
                "": [F.when(title == "", empty_title).when(~valid, empty_link)],
                "content": [F.when(valid & stated(3) & emptied, F.lit(X.CLEANED_AWAY)), F.when(valid & stated(3) & ~emptied & (strip(c["content"]["html"]) == ""), no_content)],
                "image": [F.when(valid & stated(4) & (c["image"] == ""), no_image)],
                "date": [F.when(valid & stated(2) & c["date"]["published"].isNull(), no_date)],
            }
            notes = F.array(*[note for part, some in parts.items() if not part or asks[part] for note in some])
            warnings = F.transform(F.filter(notes, lambda x: x.isNotNull()), lambda x: F.concat(number, x))
            return F.struct(
                c["pos"].alias("pos"),
                F.coalesce(k, F.lit("")).alias("key"),
                title.alias("title"),
                c["url"].alias("url"),
                images.with_image(c["content"]["html"], c["image"]).alias("html"),
                c["content"]["text"].alias("text"),
                c["image"].alias("image"),
                *[c["date"][f].alias(f) for f in ("published", "estimated", "source")],
                reason.alias("reason"),
                warnings.alias("warnings"),
            )

        return let(key, judged)

    return F.transform(cards, one)


def _verdicts(found: Column, recipe: Column) -> Column:
    """Each valid story with the reason why the feed's rules drop it."""

    def one(s: Column) -> Column:
        def drop(sides: Column) -> Column:
            out = F.when(~sides["include"], recipe["include_reason"]).when(sides["exclude"], recipe["exclude_reason"])
            return s.withField("drop_reason", F.when(s["reason"].isNull(), out))

        judged = F.when(F.size(recipe["rules"]) > 0, closed_sides(recipe["rules"], s["title"], s["text"], s["url"]))
        return let(judged, drop)

    return F.transform(found, one)


def used(compiled_recipes: DataFrame) -> dict[str, bool]:
    """Which parts of a page the recipes of a table ask for; stages that none asks for are left out of the plan."""
    r = F.col("recipe")
    asks = {
        "content": F.get(r["fields"], BODY)["stated"], "remove": F.size(r["remove"]) > 0, "image": F.get(r["fields"], IMAGE)["stated"],
        "date": F.get(r["fields"], DATE)["stated"], "rules": F.size(r["rules"]) > 0,
    }
    row = compiled_recipes.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in asks.items()]).first()
    return row.asDict()


def _without_content(cards: Column) -> Column:
    nothing = F.struct(F.lit("").alias("html"), F.lit("").alias("text"), F.lit(False).alias("emptied"))
    return F.transform(cards, lambda c: F.struct(*[c[f].alias(f) for f in ("pos", "found", "picture", "raw")], nothing.alias("content")))


def _without_date(cards: Column) -> Column:
    none = F.struct(F.lit(None).cast("timestamp").alias("published"), F.lit(False).alias("estimated"), F.lit("").alias("source"))
    return F.transform(cards, lambda c: F.struct(*[c[f].alias(f) for f in ("pos", "found", "raw", "content", "url", "image")], F.lit("").alias("datetime"), none.alias("date")))


def read_pages(captures: DataFrame, compiled_recipes: DataFrame, keep: tuple[str, ...] = ("page_id", "feed_id", "url", "captured_at"), asks: dict[str, bool] | None = None) -> DataFrame:
    """Every page read by its feed's recipe: matches, cards and error, as ``extract.read_pages`` gives for one recipe.

    Pages of feeds without a recipe, or with one that was refused, are left out. ``version`` says which recipe was used.
    ``asks`` is what ``used`` tells of the table, looked up if not given.
    """
    asks = used(compiled_recipes) if asks is None else asks
    known = compiled_recipes.filter(F.col("recipe").isNotNull()).select("feed_id", "version", "recipe")
    joined = captures.join(known, "feed_id")
    nodes, recipe = F.col("nodes"), F.col("recipe")
    kept = [*keep, "version", "recipe"]
    seen = [*dict.fromkeys([*kept, "url", "captured_at"])]
    rows = joined.select(*seen, markup.page_nodes("html").alias("nodes"))
    rows = rows.select(*seen, "nodes", pin(X.page_base(nodes, F.col("url"))).alias("base"), pin(_matched()).alias("m"))
    rows = rows.select(*seen, "nodes", "base", F.size("m.cards").alias("matches"), pin(_picked()).alias("c"))
    cards, base = F.col("c"), F.col("base")
    rows = rows.select(*seen, "base", "matches", pin(_said(nodes, recipe, cards)).alias("c"))

    def stage(value: Column, *more: Column) -> DataFrame:
        return rows.select(*seen, "base", "matches", pin(value).alias("c"), *more)

    if asks["content"]:
        gone = _swept() if asks["remove"] else F.lit(None).cast("array<array<boolean>>")
        rows = rows.select(*seen, "base", "matches", "c", pin(gone).alias("gone"))
        rows = stage(_cleaned(cards, F.col("gone"), base))
        rows = stage(_published(cards, recipe))
    else:
        rows = stage(_without_content(cards))
    rows = stage(_addressed(cards, recipe, base))
    rows = stage(_dated(cards, recipe, F.col("captured_at")) if asks["date"] else _without_date(cards))
    rows = stage(_stories(cards, recipe, asks))
    rows = stage(X._first_wins(cards))
    rows = stage(_verdicts(cards, recipe) if asks["rules"] else F.transform(cards, lambda s: s.withField("drop_reason", F.lit(None).cast("string"))))
    return X.page_errors(rows.select(*[c for c in kept if c != "recipe"], "matches", F.col("c").alias("all")), (*keep, "version"))
