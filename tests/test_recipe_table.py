"""Scans, selector programs and the recipe table against plain loops and against compiled selectors."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import markup, scans
from newsloom.functions.columns import pin
from newsloom.functions.programs import PROGRAM, View, hits, problem, program
from newsloom.functions.rules import RuleSet
from newsloom.functions.selectors import SelectorError, css, xpath
from newsloom.operators import extract, recipe_table
from newsloom.operators.extract import Field, Recipe
from newsloom.plans import bindings as B

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [0, 1, 2, 3, 17, 64, 200])
def test_scans(spark, size):
    rng = random.Random(size)
    values = [rng.choice([None, rng.randint(-9, 9)]) for _ in range(size)]
    flags = [rng.random() < 0.2 for _ in range(size)]
    keys = [rng.randint(0, 9) for _ in range(size)]
    df = spark.createDataFrame([(values, flags, keys, [v or 0 for v in values])], "v array<int>, f array<boolean>, k array<int>, z array<int>")
    row = df.select(
        scans.running_max(F.col("v")).alias("max"), scans.running_sum(F.col("z")).alias("sum"), scans.next_place(F.col("f"), 100).alias("next"),
        scans.among(F.col("k"), F.array(F.lit(3), F.lit(7), F.lit(3))).alias("among"), scans.grouped_places(F.col("k")).alias("places"),
        scans.marked(F.sequence(F.lit(1), F.lit(50)), F.col("k")).alias("marked"),
    ).first()
    top = [max((v for v in values[: i + 1] if v is not None), default=None) for i in range(size)]
    assert row["max"] == top and row["sum"] == [sum(v or 0 for v in values[: i + 1]) for i in range(size)]
    assert row["next"] == [next((j + 100 for j in range(i, size) if flags[j]), None) for i in range(size)]
    assert row["among"] == [k in (3, 7) for k in keys]
    assert [(p.place, p.size) for p in row["places"]] == [(keys[: i + 1].count(k), keys.count(k)) for i, k in enumerate(keys)]
    assert row["marked"] == [n in keys for n in range(1, 51)]


def random_page(rng, budget):
    out = []

    def grow(depth):
        nonlocal budget
        while budget > 0 and rng.random() < 0.8:
            budget -= 1
            tag = rng.choice(["div", "section", "b", "i", "em"])
            names = " ".join(rng.sample(["x", "y", "z"], rng.randint(0, 2)))
            out.append(f'<{tag} class="{names}" data-n="{rng.randint(0, 3)}">' + rng.choice(["", "one ", "Two "]))
            if depth < 7:
                grow(depth + 1)
            out.append(f"</{tag}>")

    while budget > 0:
        grow(0)
    return "".join(out)


CSS = [
    "div b", "div > b", ".x + .y", ".x ~ .y", "section .x .y", "div:not(.x)", "div:not(.x, .y) > i", ":is(b, i).z", "div:has(b)", "div:has(> .x)", "b:nth-child(2n+1)", "em:last-of-type",
    "section:nth-of-type(-n+2)", "[data-n='2'] i", "[data-n^='1'], .z", "div:contains('two')", "i:empty", "body > *", "div div div", "*", ".x.y", "b, i, b", ".nope",
]
XPATH = [
    "//div//b", "//div/b", "//section[@data-n='1']/i", "//b[2]", "//i[last()]", "//div[position()<3]", "//b/..", "//div[@class]/following-sibling::i", "//em[contains(@class,'x') or @data-n='3']",
    "//div[not(@data-n='0')]", "//b | //i", "//section/@data-n", "//div[contains(.,'Two')]", "//b[starts-with(normalize-space(.),'one')]", "//div/descendant::em", "/html/body/div", "//div[@data-n!='1']/*[1]",
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(k, random_page(rng, rng.randint(1, 90))) for k in range(12)]
    return spark.createDataFrame(rows, "page_id long, html string").select("page_id", markup.page_nodes("html").alias("nodes")).cache()


def test_programs_select_what_compiled_selectors_do(spark, pages):
    kinds = [("css", s) for s in CSS] + [("xpath", s) for s in XPATH]
    table = spark.createDataFrame([(n, program(s, kind)) for n, (kind, s) in enumerate(kinds)], f"n int, program {PROGRAM.simpleString()}")
    # One plan for all selectors: pages meet the table of programs.
    got = pages.join(table).select("page_id", "n", pin(F.expr(hits(View("nodes"), "program"))).alias("h")).collect()
    found = {(r.page_id, r.n): [h["at"] for h in r.h] for r in got}
    n = F.col("nodes")
    for at in range(0, len(kinds), 8):
        some = kinds[at : at + 8]
        want = pages.select("page_id", *[pin(F.transform(css(n, s) if kind == "css" else xpath(n, s), lambda m: m["pre"])).alias(f"s{k}") for k, (kind, s) in enumerate(some)]).collect()
        for row in want:
            for k, (_, s) in enumerate(some):
                assert found[row.page_id, at + k] == row[f"s{k}"], s
    assert sum(map(len, found.values())) > 1000


def test_many_anchors_equal_few(spark, pages):
    """Above and below the number of anchors that are compared one by one, against node pairs."""
    n = F.col("nodes")
    for selector, relation in (("div b", "below"), ("div > b", "child"), ("div + b", "next"), ("div ~ b", "later")):
        rows = pages.select(n.alias("nodes"), pin(F.transform(css(n, selector), lambda m: m["pre"])).alias("h")).collect()
        for row in rows:
            held = row.nodes
            divs = [d for d in held if d.tag == "div"]
            tests = {
                "below": lambda d, b: d.pre < b.pre <= d.last, "child": lambda d, b: b.parent == d.pre,
                "next": lambda d, b: b.parent == d.parent and b.sib == d.sib + 1, "later": lambda d, b: b.parent == d.parent and b.sib > d.sib,
            }
            assert row.h == [b.pre for b in held if b.tag == "b" and any(tests[relation](d, b) for d in divs)]


@pytest.mark.parametrize("bad, kind", [("li >", "css"), ("li:nope", "css"), ("a[", "css"), ("li:nth-child(x)", "css"), ("//li[", "xpath"), ("", "css"), ("//", "xpath")])
def test_unreadable_selectors_have_a_reason(bad, kind):
    assert bad == "" or problem(bad, kind)


@pytest.mark.parametrize("good, kind", [("li:matches('x+')", "css"), ("ul > li:has(a > b)", "css"), ("//b/ancestor::div", "xpath"), ("//li[a/b]", "xpath"), ("td, th", "css")])
def test_selectors_that_only_compile_are_readable(good, kind):
    assert problem(good, kind) is None


RECIPES = {
    "plain": Recipe(items="nav li", title=Field("a"), link=Field("a")),
    "titled": Recipe(items="nav li:not(:first-child)", title=Field("a", "href")),
    "ruled": Recipe(items="li", title=Field("a"), link=Field("a"), rules=RuleSet(include={"op": "any", "rules": [{"op": "contains_any", "field": "title", "keywords": ["THE", "an"]}, {"op": "contains_all", "field": "link", "keywords": ["e"]}]}, exclude={"op": "contains_any", "field": "link", "keywords": ["zz"]})),
    "article": Recipe(items="article", title=Field("h1"), content=Field(".")),
    "cleaned": Recipe(items="article", title=Field("h1"), content=Field("."), remove=("h1", "p:first-of-type", ".no")),
    "emptied": Recipe(items="article", title=Field("h1"), content=Field("p"), remove=("b", "p b")),
    "xpath": Recipe(kind="xpath", items="//nav//li", title=Field(".//a"), link=Field(".//a/@href")),
    "xpath content": Recipe(kind="xpath", items="//article", title=Field("./h1"), content=Field(".//p[1]"), remove=("./b",)),
    "dated": Recipe(items="article", title=Field("h1"), date=Field("h1"), image=Field("p"), link=Field("p")),
    "nothing": Recipe(items=".none", title=Field("a")),
}
KEEP = ("page_id", "feed_id", "url", "captured_at")


def plain(df):
    return {(r.feed_id, r.page_id): (r.matches, r.cards, r.error) for r in df.collect()}


def test_one_plan_for_all_recipes_gives_what_each_gives_alone(spark):
    captures = B.captures(spark, SF).filter("page_id < 16").withColumn("feed_id", F.explode(F.array(*[F.lit(n) for n in RECIPES]))).cache()
    table = recipe_table.compile_recipes(recipe_table.recipe_table(spark, RECIPES))
    together = plain(recipe_table.read_pages(captures, table, KEEP).drop("version"))
    alone = {}
    for name, recipe in RECIPES.items():
        alone |= plain(extract.read_pages(captures.filter(F.col("feed_id") == name), recipe, KEEP))
    assert together == alone and len(alone) == 16 * len(RECIPES)


CARDS = """<base href="https://s.example/a/"><ol><li class="k"><h3>One <b>x</b></h3><time datetime="2030-01-02T03:04:05Z">2 Jan</time><a href="1">go</a><div class="t"><p>Text <i>one</i></p><p class="ad">buy</p><img data-src="/1.png"></div></li>
<li class="k"><h3></h3><a href="2">go</a><div class="t"><p class="ad">only</p></div></li><li class="k"><h3>Three</h3><time>3 hours ago</time><a href="javascript:x">go</a></li>
<li class="k"><h3>Four</h3><time>nonsense</time><a href="4">go</a><div class="t"><p class="ad">x</p></div></li><li class="k"><h3>One again</h3><a href="1">go</a></li></ol>"""


FULL = {
    "all": Recipe(items="li.k", title=Field("h3"), link=Field("a"), date=Field("time"), content=Field(".t"), image=Field("img"), remove=(".ad",), timezone="Europe/Berlin"),
    "attributes": Recipe(items="li.k", title=Field("h3"), link=Field("a"), date=Field("time", "datetime"), content=Field(".t", "title"), image=Field("img", "data-src")),
    "xpath": Recipe(kind="xpath", items="//li", title=Field("./h3/text()"), link=Field("./a/@href"), date=Field("./time"), content=Field(".//div"), image=Field(".//img"), remove=(".//p[@class='ad']",)),
    "layout": Recipe(items="li.k", title=Field("h3"), date=Field("time"), date_layout="2 Jan", content=Field(".t")),
}


def test_dates_images_content_and_warnings_alike(spark):
    rows = [(1, name, "https://s.example/list", CARDS, datetime(2030, 1, 5, 12)) for name in FULL]
    df = spark.createDataFrame(rows, "page_id long, feed_id string, url string, html string, captured_at timestamp")
    together = plain(recipe_table.read_pages(df, recipe_table.compile_recipes(recipe_table.recipe_table(spark, FULL)), KEEP).drop("version"))
    for name, recipe in FULL.items():
        assert plain(extract.read_pages(df.filter(F.col("feed_id") == name), recipe, KEEP)) == {(name, 1): together[name, 1]}, name
    assert len(together) == 4


def test_recipes_that_cannot_be_read_say_why(spark):
    rows = [recipe_table.recipe_row(f, r) for f, r in {"a": Recipe(items="li >", title=Field("a")), "b": Recipe(items="", title=Field("a")), "c": Recipe(items="li", title=Field("a:nope")), "d": Recipe(items="li", title=Field("a"))}.items()]
    rows[3]["include"] = "{"
    table = spark.createDataFrame([tuple(r[f] for f in recipe_table.RECIPES.names) for r in rows], recipe_table.RECIPES)
    out = {r.feed_id: r for r in recipe_table.compile_recipes(table).collect()}
    assert all(out[f].recipe is None and out[f].refused for f in "abcd") and "title" in out["c"].refused


def test_the_plan_does_not_grow_with_the_recipes(spark):
    captures = B.captures(spark, SF)
    sizes = []
    for count in (1, 200):
        table = recipe_table.compile_recipes(recipe_table.recipe_table(spark, {f"f{k}": RECIPES["plain"] for k in range(count)}))
        sizes.append(len(recipe_table.read_pages(captures, table)._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 1.02 * sizes[0]


def test_refused_selector_kinds():
    with pytest.raises(SelectorError):
        program("li:matches('x')")
