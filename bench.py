"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from newsloom.functions.rules import leaf  # noqa: E402
from newsloom.functions.text import fold  # noqa: E402
from newsloom.plans import bindings, catalog, refresh  # noqa: E402
from newsloom.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = [
    "P1_dom_nodes",
    "P5_project_fields",
    "P11_sanitize_content",
    "P31_article_body",
    "P32_visible_text",
    "P37_card_discovery",
    "P18_date_absolute",
    "P27_feed_stories",
    "A3_page_outcomes",
    "F2_leaf_contains",
    "F3_rule_tree",
    "D1_redact_text",
    "J1_merge_items",
    "W1_retain_items",
    "A5_last_new_backfill",
    "A9_change_summary",
    "W3_article_queue",
    "W4_failure_streaks",
    "ST3_alert_edges",
    "ST4_alert_batches",
    "K1_rss_documents",
    "K5_metrics_exposition",
]


def keywords(count: int):
    """No-match keyword rules over every document, as the matcher benchmark does."""

    def run(spark, folder):
        words = [f"nomatch{i:04d}x" for i in range(count)]
        docs = bindings.spread(spark.read.parquet(f"{folder}/documents.parquet"))
        return docs.select("doc_id", leaf(fold("text"), "contains_any", words).alias("hit"))

    return run


def main() -> None:
    spark = local_session(CPUS, int(CPUS))
    spark.range(1000).select(F.sum("id")).collect()
    jobs = {name: catalog.QUERIES[name] for name in HEADLINES}
    jobs["keywords_100"], jobs["keywords_500"] = keywords(100), keywords(500)
    jobs["refresh_all_feeds"] = refresh.front_documents
    times: dict[str, float] = {}
    for name, job in jobs.items():
        start = time.time()
        job(spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
