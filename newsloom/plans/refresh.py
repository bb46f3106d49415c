"""One refresh of all feeds as a single job: extract, filter, merge, retain, render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.rules import RuleSet
from newsloom.operators import extract, history
from newsloom.operators.extract import Field, Recipe
from newsloom.plans import bindings as B
from newsloom.plans import render
from newsloom.sources.captures import read_captures

FRONT = Recipe(
    items="nav li",
    title=Field("a"),
    link=Field("a"),
    rules=RuleSet(exclude={"op": "contains_any", "field": "title", "keywords": ["the"]}),
)


def to_batch(stories: DataFrame) -> DataFrame:
    """Stories as a merge batch. A story listed by several captures of a feed keeps its first listing."""
    first = F.min_by(F.struct("title", "url", "html", "image", "published"), F.struct("page_id", "pos"))
    return stories.groupBy("feed_id", "key").agg(first.alias("s")).select("feed_id", "key", "s.*", F.lit("").alias("content_full"))


def refresh(captures: DataFrame, recipe: Recipe, items: DataFrame, feeds: DataFrame, now: Column, keep: int = history.MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(merged rows with flags, retained items) after one capture batch."""
    # Bodies of failed and unchanged fetches are no listings.
    pages = extract.read_pages(read_captures(captures), recipe)
    merged = history.merge_items(items, to_batch(extract.stories(pages)), feeds, now)
    return merged, history.retain_items(merged, keep)


def front_items(spark: SparkSession, folder: str, keep: int = history.MAX_ITEMS) -> DataFrame:
    """Stories of the navigation cards per host, filtered, merged into an empty history, the newest kept."""
    feeds = B.host_feeds(spark, folder, None)
    return refresh(B.captures(spark, folder), FRONT, B.empty_items(spark), feeds, B.at(B.FIRST), keep)[1]


def front_documents(spark: SparkSession, folder: str) -> DataFrame:
    return render.render_rss(B.host_feeds(spark, folder, None), front_items(spark, folder), "https://reader.example/feeds/")
