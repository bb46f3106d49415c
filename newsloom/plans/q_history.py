"""Queries over stored histories, filters, articles and published documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import rules as R
from newsloom.functions.rules import RuleSet
from newsloom.operators import articles as A
from newsloom.operators import history as H
from newsloom.operators import rulesets as RS
from newsloom.operators.groups import ranked
from newsloom.plans import bindings as B
from newsloom.plans import render
from newsloom.plans.registry import query

SQL_KEPT = B.SQL_MERGED + ",\nkept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published DESC, key) AS place FROM merged) WHERE place<=500)"
#: Retention short enough to remove stories of the test tables.
SQL_SHORT = SQL_KEPT.replace("place<=500", "place<=3")
DIGEST = "sha256(title || '|' || url || '|' || html || '|' || image || '|' || content_full)"


def digest():
    return F.sha2(F.encode(F.concat_ws("|", "title", "url", "html", "image", "content_full"), "UTF-8"), 256).alias("digest")


# -------------------------------------------------------------------- merge


@query(
    "J1_merge_items",
    f"WITH {B.SQL_MERGED} SELECT feed_id, key, guid, {DIGEST} AS digest, published, first_seen, last_seen, last_changed, inserted, changed FROM merged",
)
def merge_items(spark, folder):
    m = B.merged_items(spark, folder)
    return m.select("feed_id", "key", "guid", digest(), "published", "first_seen", "last_seen", "last_changed", "inserted", "changed")


@query("ST10_dedup_stream", f"WITH {B.SQL_MERGED} SELECT key, CASE WHEN inserted THEN 'new' ELSE 'changed' END AS kind FROM merged WHERE inserted OR changed")
def dedup(spark, folder):
    """What a refresh publishes: new stories and changed ones; unchanged ones nothing."""
    m = B.merged_items(spark, folder).filter(F.col("inserted") | F.col("changed"))
    return m.select("key", F.when(F.col("inserted"), "new").otherwise("changed").alias("kind"))


@query("W1_retain_items", f"WITH {SQL_SHORT} SELECT feed_id, key, published FROM kept")
def retain(spark, folder):
    return B.kept_items(spark, folder, 3).select("feed_id", "key", "published")


@query("U2_retention_except", f"WITH {SQL_SHORT} SELECT m.feed_id, m.key FROM merged m LEFT JOIN kept k ON m.feed_id=k.feed_id AND m.key=k.key WHERE k.key IS NULL")
def retention_except(spark, folder):
    m = B.merged_items(spark, folder)
    return H.retention_except(m, H.retain_items(m, 3)).select("feed_id", "key")


@query(
    "A9_change_summary",
    f"""WITH {SQL_SHORT}, f AS (SELECT m.feed_id, m.inserted, m.changed, k.key IS NULL AS gone FROM merged m LEFT JOIN kept k ON m.feed_id=k.feed_id AND m.key=k.key),
 g AS (SELECT feed_id, count(*) FILTER (WHERE inserted AND NOT gone) AS inserted, count(*) FILTER (WHERE changed AND NOT gone) AS changed, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE gone AND NOT inserted) AS rp FROM f GROUP BY feed_id)
 SELECT feed_id, inserted, changed, removed, inserted>0 OR changed>0 OR rp>0 AS output_changed, CASE WHEN inserted>0 OR changed>0 OR rp>0 THEN {B.T2} ELSE {B.T1} END AS last_changed, CASE WHEN inserted>0 THEN {B.T2} ELSE {B.T1} END AS last_new FROM g""",
)
def change_summary(spark, folder):
    m = B.merged_items(spark, folder)
    return H.change_summary(m, H.retain_items(m, 3), B.host_feeds(spark, folder), B.at(B.SECOND))


@query("J7_stale_results", f"WITH {B.SQL_BATCHES} SELECT feed_id, key FROM batch_new WHERE page_id%3<>1")
def stale(spark, folder):
    """Every third result was built with an older recipe version, and some feeds are gone."""
    b = B.batch(spark, folder, "new").withColumn("version", F.when(F.col("page_id") % 3 == 1, 0).otherwise(1))
    return H.drop_stale(b, B.host_feeds(spark, folder)).select("feed_id", "key")


@query("ST9_late_results", f"WITH {B.SQL_BATCHES} SELECT feed_id, count(*) AS late FROM batch_new WHERE page_id%3=1 GROUP BY feed_id")
def late(spark, folder):
    b = B.batch(spark, folder, "new").withColumn("version", F.when(F.col("page_id") % 3 == 1, 0).otherwise(1))
    current = H.drop_stale(b, B.host_feeds(spark, folder)).select("feed_id", "key")
    return b.join(current, ["feed_id", "key"], "left_anti").groupBy("feed_id").agg(F.count("*").alias("late"))


@query("S7_items_scan", f"WITH {SQL_KEPT} SELECT feed_id, key, place FROM kept")
def items_scan(spark, folder):
    return ranked(B.kept_items(spark, folder), ["feed_id"], H.item_order(), "place").select("feed_id", "key", "place")


@query("T3_item_order", f"WITH {B.SQL_MERGED} SELECT key, published FROM merged ORDER BY published DESC, key")
def item_order(spark, folder):
    return B.merged_items(spark, folder).orderBy(*H.item_order()).select("key", "published")


@query("A2_items_per_feed", f"WITH {B.SQL_STORED}, {B.SQL_HOSTS} SELECT h.feed_id, count(s.key) AS items FROM hosts h LEFT JOIN stored s USING (feed_id) GROUP BY h.feed_id")
def items_per_feed(spark, folder):
    return H.items_per_feed(B.host_feeds(spark, folder), B.stored_items(spark, folder))


@query("A5_last_new_backfill", f"WITH {B.SQL_FEEDS}, {B.SQL_EVENT_ITEMS} SELECT f.feed_id, coalesce(max(i.first_seen),0) AS last_new FROM feeds f LEFT JOIN eitems i USING (feed_id) GROUP BY f.feed_id")
def last_new(spark, folder):
    return H.last_new_backfill(B.event_feeds(spark, folder), B.event_items(spark, folder))


@query("A6_listed_items", f"WITH {B.SQL_RUNS}, {B.SQL_EVENT_ITEMS} SELECT feed_id, key FROM (SELECT *, max(last_seen) OVER (PARTITION BY feed_id) AS m FROM eitems) WHERE last_seen>=m")
def listed(spark, folder):
    return H.listed_items(B.event_items(spark, folder)).select("feed_id", "key")


@query("W7_story_gaps", f"WITH {B.SQL_RUNS}, {B.SQL_EVENT_ITEMS}, t AS (SELECT DISTINCT feed_id, first_seen FROM eitems) SELECT feed_id, first_seen, coalesce(first_seen - lag(first_seen) OVER (PARTITION BY feed_id ORDER BY first_seen),-1) AS gap_s FROM t")
def story_gaps(spark, folder):
    from newsloom.operators.runs import story_gaps as gaps

    return gaps(B.event_items(spark, folder)).select("feed_id", "first_seen", F.coalesce("gap_s", F.lit(-1)).alias("gap_s"))


@query(
    "M6_clear_bodies",
    f"""WITH {SQL_KEPT}, e AS (SELECT *, CASE length(feed_id)%3 WHEN 0 THEN 'all' WHEN 1 THEN 'listed' END AS scope, max(last_seen) OVER (PARTITION BY feed_id) AS newest FROM merged),
 c AS (SELECT *, content_full<>'' AND (coalesce(scope='all',false) OR (coalesce(scope='listed',false) AND length(feed_id)%2=1 AND last_seen>=newest)) AS cleared FROM e)
 SELECT feed_id, key, CASE WHEN cleared THEN '' ELSE content_full END AS content_full, CASE WHEN cleared THEN {B.T2}+1 ELSE last_changed END AS last_changed, cleared FROM c""",
)
def clear_bodies(spark, folder):
    """Edits of two thirds of the feeds; the newest reading run of some stored nothing."""
    feeds = B.host_feeds(spark, folder, B.SECOND)
    n = F.length("feed_id")
    edits = feeds.filter(n % 3 < 2).select("feed_id", F.when(n % 3 == 0, "all").otherwise("listed").alias("scope"))
    runs = feeds.select("feed_id", F.lit(7).alias("run_id"), F.lit(200).alias("status"), F.lit("").alias("error"), (n % 2).alias("count"))
    out = H.clear_bodies(B.merged_items(spark, folder), edits, runs, feeds, B.at(B.SECOND))
    return out.select("feed_id", "key", "content_full", "last_changed", "cleared")


# ------------------------------------------------------------------ filters

TREE = RuleSet(
    include={"op": "any", "rules": [{"op": "contains_any", "field": "link", "keywords": ["/en/", "/FR/"]}, {"op": "contains_all", "field": "title", "keywords": ["e", "Un"]}]},
    exclude={"op": "all", "rules": [{"op": "contains_any", "field": "title", "keywords": ["the"]}, {"op": "any", "rules": [{"op": "contains_any", "field": "link", "keywords": ["page", "utm"]}]}]},
)
SQL_TREE = """(contains(lower(url),'/en/') OR contains(lower(url),'/fr/') OR (contains(lower(title),'e') AND contains(lower(title),'un')))"""
SQL_TREE_X = """(contains(lower(title),'the') AND (contains(lower(url),'page') OR contains(lower(url),'utm')))"""


@query("F3_rule_tree", f"WITH {B.SQL_STORED} SELECT key, {SQL_TREE} AS include, {SQL_TREE_X} AS exclude FROM stored")
def rule_tree(spark, folder):
    """The data-driven form: trees as rows, evaluated level by level."""
    nodes, words = RS.rule_tables(spark, {"tree0": TREE, "tree1": TREE})
    own_set = F.concat(F.lit("tree"), (F.length("feed_id") % 2).cast("string"))
    items = B.stored_items(spark, folder).select(own_set.alias("set_id"), F.col("key").alias("item_id"), "title", F.lit("").alias("description"), "url")
    return RS.evaluate_rules(items, nodes, words).select(F.col("item_id").alias("key"), "include", "exclude")


@query("F4_include_exclude", f"WITH {B.SQL_STORED} SELECT key FROM stored WHERE {SQL_TREE} AND NOT {SQL_TREE_X}")
def include_exclude(spark, folder):
    """The compiled form of the same tree."""
    return H.apply_filter(B.stored_items(spark, folder), TREE).filter(F.col("reason").isNull()).select("key")


@query(
    "F5_filter_reason",
    f"WITH {B.SQL_STORED} SELECT key, CASE WHEN NOT {SQL_TREE} THEN 'no include rule applies' WHEN {SQL_TREE_X} THEN 'an exclude rule applies' END AS reason FROM stored",
)
def filter_reason(spark, folder):
    return H.apply_filter(B.stored_items(spark, folder), TREE).select("key", "reason")


DESCRIPTION = RuleSet(exclude={"op": "contains_any", "field": "description", "keywords": ["the of", "de la", "und die"]})
SQL_DESCRIPTION = B.unescape_sql("lower(trim(regexp_replace(regexp_replace(regexp_replace(html,'</?(h1|p|br)>',' ','g'),'<[^>]*>','','g'),'\\s+',' ','g')))")


@query(
    "F9_prune_history",
    f"WITH {B.SQL_STORED}, d AS (SELECT feed_id, key, {SQL_DESCRIPTION} AS t FROM stored) SELECT feed_id, count(*) AS removed FROM d WHERE contains(t,'the of') OR contains(t,'de la') OR contains(t,'und die') GROUP BY feed_id",
)
def prune(spark, folder):
    items = H.with_description(B.spread(B.stored_items(spark, folder)))
    return H.prune_history(items, DESCRIPTION)[1].groupBy("feed_id").agg(F.count("*").alias("removed"))


@query("J9_keyword_join", f"WITH {B.SQL_STORED}, w AS (SELECT DISTINCT lower(p_word) AS word FROM (SELECT unnest(string_split(n_name,' ')) AS p_word FROM nation)) SELECT s.key, count(*) AS hits FROM stored s, (SELECT unnest(['the','de','un','a ','ei']) AS word) k WHERE contains(lower(s.title),k.word) GROUP BY s.key")
def keyword_join(spark, folder):
    """Rules as data over a keyword set: hits per story without an item x keyword row."""
    words = F.array(*[F.lit(w) for w in ("the", "de", "un", "a ", "ei")])
    folded = B.stored_items(spark, folder).select("key", F.lower("title").alias("t"))
    hits = folded.select("key", F.size(F.filter(words, lambda w: F.contains(F.col("t"), w))).alias("hits"))
    return hits.filter(F.col("hits") > 0)


def filter_tables(spark, folder):
    feeds = B.host_feeds(spark, folder)
    filters = spark.createDataFrame(
        [(i, f"filter {i}", RS.rule_json(f.get("include")), RS.rule_json(f.get("exclude"))) for i, f in B.library_filters(spark).items()],
        "filter_id int, name string, include string, exclude string",
    )
    n = F.length("feed_id")
    ids = F.when(n % 4 == 0, F.array(F.lit(2), F.lit(4))).when(n % 4 == 1, F.array(F.lit(3), F.lit(1))).when(n % 4 == 2, F.array(F.lit(1)))
    links = feeds.select("feed_id", F.posexplode(ids).alias("position", "filter_id"))
    return feeds, links, filters


SQL_LINKS = B.SQL_HOSTS + """, links AS (SELECT feed_id, p AS position, CASE length(feed_id)%4 WHEN 0 THEN [2,4][p+1] WHEN 1 THEN [3,1][p+1] ELSE 1 END AS filter_id
 FROM hosts, (SELECT unnest([0,1]) AS p) WHERE length(feed_id)%4 IN (0,1) OR (length(feed_id)%4=2 AND p=0))"""


def _sql_text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def _combined_sql(bad_links: bool = False) -> str:
    """Expected effective rules per link pattern, from the driver-side combination."""
    lib = {i: RuleSet(f.get("include"), f.get("exclude")) for i, f in B.library_filters(None).items()}
    own = RuleSet(exclude={"op": "contains_any", "field": "link", "keywords": ["/x"]})
    rows = {}
    for k, ids in {0: [2, 4], 1: [3, 1], 2: [1], 3: []}.items():
        rows[k] = R.combine(own, [lib[i] for i in ids])
    inc = " ".join(f"WHEN {k} THEN {_sql_text(RS.rule_json(s.include))}" for k, s in rows.items())
    exc = " ".join(f"WHEN {k} THEN {_sql_text(RS.rule_json(s.exclude))}" for k, s in rows.items())
    if not bad_links:
        return f"WITH {B.SQL_HOSTS} SELECT feed_id, CASE length(feed_id)%4 {inc} END AS include, CASE length(feed_id)%4 {exc} END AS exclude FROM hosts"
    failure = "CASE WHEN length(feed_id)%5=1 THEN 'unknown filter' WHEN length(feed_id)%5=2 AND length(feed_id)%4<3 THEN 'repeated filter' END"
    return f"""WITH {B.SQL_HOSTS}, h AS (SELECT feed_id, {failure} AS failure FROM hosts)
 SELECT feed_id, CASE WHEN failure IS NULL THEN CASE length(feed_id)%4 {inc} END END AS include, CASE WHEN failure IS NULL THEN CASE length(feed_id)%4 {exc} END END AS exclude, failure FROM h"""


OWN = RS.rule_json({"op": "contains_any", "field": "link", "keywords": ["/x"]})


@query("F7_combine_filters", _combined_sql(True))
def combine_filters(spark, folder):
    """Some feeds link a filter that is gone, some link one twice."""
    feeds, links, filters = filter_tables(spark, folder)
    n = F.length("feed_id")
    gone = feeds.filter(n % 5 == 1).select("feed_id", F.lit(9).alias("position"), F.lit(99).alias("filter_id"))
    twice = links.filter((n % 5 == 2) & (F.col("position") == 0)).withColumn("position", F.lit(8))
    links = links.unionByName(gone).unionByName(twice)
    own = feeds.select("feed_id", F.lit(None).cast("string").alias("own_include"), F.lit(OWN).alias("own_exclude"))
    return RS.effective_filters(own, links, filters.drop("name"))


@query("J4_feed_filters", f"WITH {SQL_LINKS} SELECT feed_id, position, filter_id, 'filter ' || filter_id AS name FROM links")
def feed_filters(spark, folder):
    _, links, filters = filter_tables(spark, folder)
    return links.join(filters.select("filter_id", "name"), "filter_id").select("feed_id", "position", "filter_id", "name")


@query(
    "J5_filter_usage",
    f"WITH {SQL_LINKS}, f AS (SELECT unnest([1,2,3,4]) AS filter_id) SELECT f.filter_id, count(DISTINCT l.feed_id) AS feeds, count(l.feed_id)=0 AS deletable FROM f LEFT JOIN links l USING (filter_id) GROUP BY f.filter_id",
)
def filter_usage(spark, folder):
    _, links, filters = filter_tables(spark, folder)
    return RS.filter_usage(filters, links).drop("name")


@query(
    "F8_filter_bounds",
    """SELECT 'set' || c_custkey AS set_id, 2+c_custkey%130 AS nodes, CASE WHEN c_custkey%7=0 THEN 9 ELSE 2 END AS depth, (1+c_custkey%130)*(1+c_custkey%5) AS keywords,
 concat_ws(',', CASE WHEN 2+c_custkey%130>128 THEN 'nodes' END, CASE WHEN c_custkey%7=0 THEN 'depth' END, CASE WHEN (1+c_custkey%130)*(1+c_custkey%5)>500 THEN 'keywords' END, CASE WHEN c_custkey%3=0 THEN 'keyword text' END) AS violations FROM customer""",
)
def filter_bounds(spark, folder):
    """Rule sets of growing size made from the customers, some too deep or too large."""
    # A customer becomes some 250 rows.
    customers = B.by_rows(B.table(spark, folder, "customer").select("c_custkey"), 5000, "c_custkey")
    c = customers.select("c_custkey", F.concat(F.lit("set"), F.col("c_custkey").cast("string")).alias("set_id"))
    k = F.col("c_custkey")
    count = (1 + k % 130).cast("int")
    root = c.select("set_id", F.lit(1).alias("node_id"), F.lit(0).alias("parent_id"), F.lit(1).alias("depth"), F.lit("any").alias("op"), F.lit(None).cast("string").alias("field"))
    leaves = c.select("set_id", "c_custkey", F.explode(F.sequence(F.lit(1), count)).alias("i"))
    leaf = leaves.select("set_id", (F.col("i") + 1).alias("node_id"), F.lit(1).alias("parent_id"), F.when((k % 7 == 0) & (F.col("i") == 1), 9).otherwise(2).alias("depth"), F.lit("contains_any").alias("op"), F.lit("title").alias("field"))
    words = leaves.select("set_id", (F.col("i") + 1).alias("node_id"), "c_custkey", "i", F.explode(F.sequence(F.lit(0), (k % 5).cast("int"))).alias("w")).select(
        "set_id", "node_id", F.when((k % 3 == 0) & (F.col("i") == 1) & (F.col("w") == 0), " ").otherwise(F.concat(F.lit("w"), F.col("w").cast("string"))).alias("keyword")
    )
    return RS.lint_rules(root.unionByName(leaf), words)


# ----------------------------------------------------------------- articles


def candidates(spark, folder):
    """Listed stories of the event feeds, what is stored and what is remembered, all from the events."""
    r = B.runs(spark, folder)
    e = F.col("run_id")
    listed = r.select("feed_id", F.lit(1).alias("version"), F.concat(F.lit("k"), e.cast("string")).alias("key"), F.when(e % 10 == 9, "").otherwise(F.concat(F.lit("https://a.example/"), e.cast("string"))).alias("url"), e.alias("pos"))
    stored = r.filter(e % 3 != 0).select("feed_id", F.concat(F.lit("k"), e.cast("string")).alias("key"), (e % 3 == 1).alias("has_body"), F.timestamp_seconds(F.lit(B.NOW_S) - (e % 100) * 120).alias("first_seen"))
    memory = r.filter(e % 4 == 0).select(
        "feed_id", F.concat(F.lit("k"), e.cast("string")).alias("key"), F.when(e % 40 == 0, 0).otherwise(1).alias("version"),
        F.timestamp_seconds(F.lit(B.NOW_S) - (e % 17) * 600).alias("tried"), F.when(e % 5 != 0, F.timestamp_seconds(F.lit(B.NOW_S) - 3600 + (e % 5) * 1800)).alias("retry"),
        (e % 8 == 0).alias("unkept"), (e % 6).cast("int").alias("count"),
    )
    return listed, stored, memory


SQL_CAND = B.SQL_RUNS + f""", cand AS (SELECT feed_id, 'k'||run_id AS key, run_id AS pos, run_id%3<>0 AS stored, run_id%3=1 AS has_body, {B.NOW_S}-(run_id%100)*120 AS first_seen,
 run_id%4=0 AND run_id%40<>0 AS tried, {B.NOW_S}-(run_id%17)*600 AS tried_at, CASE WHEN run_id%5<>0 THEN {B.NOW_S}-3600+(run_id%5)*1800 ELSE 0 END AS retry, run_id%8=0 AS unkept FROM runs WHERE run_id%10<>9),
cls AS (SELECT *, CASE WHEN NOT has_body AND NOT tried THEN 0 WHEN NOT has_body AND (retry<={B.NOW_S} OR (stored AND {B.NOW_S}-first_seen<=3600)) THEN 1 WHEN has_body AND {B.NOW_S}-first_seen<=3600 THEN 2 END AS class,
 NOT has_body AND tried AND retry>{B.NOW_S} AND NOT (stored AND {B.NOW_S}-first_seen<=3600) AS waiting FROM cand)"""


@query("J2_article_candidates", f"WITH {SQL_CAND} SELECT key, CASE WHEN stored THEN has_body END AS has_body, CASE WHEN tried THEN tried_at ELSE 0 END AS tried FROM cand")
def article_candidates(spark, folder):
    return A.article_candidates(*candidates(spark, folder)).select("key", "has_body", "tried")


@query(
    "W3_article_queue",
    f"WITH {SQL_CAND}, q AS (SELECT feed_id, key, class, row_number() OVER (PARTITION BY feed_id ORDER BY class, CASE WHEN class=1 THEN unkept ELSE false END, CASE WHEN class=1 THEN tried_at END NULLS FIRST, pos) AS place FROM cls WHERE class IS NOT NULL) SELECT feed_id, key, class, place FROM q WHERE place<=10",
)
def article_queue(spark, folder):
    c = A.classify(A.article_candidates(*candidates(spark, folder)), B.at(B.NOW))
    return A.article_queue(c).select("feed_id", "key", "class", "place")


@query("A8_article_waiting", f"WITH {SQL_CAND} SELECT feed_id, count(*) FILTER (WHERE waiting) AS waiting FROM cls GROUP BY feed_id")
def article_waiting(spark, folder):
    return A.article_waiting(A.classify(A.article_candidates(*candidates(spark, folder)), B.at(B.NOW)))


@query(
    "U1_target_union",
    f"WITH {SQL_CAND}, q AS (SELECT feed_id, key, row_number() OVER (PARTITION BY feed_id ORDER BY class, pos) AS place FROM cls WHERE class IS NOT NULL) SELECT feed_id, key, place FROM q WHERE place<=4",
)
def target_union(spark, folder):
    c = A.classify(A.article_candidates(*candidates(spark, folder)), B.at(B.NOW))
    parts = [c.filter(F.col("class") == i) for i in range(3)]
    return A.target_union(*parts, 4).select("feed_id", "key", "place")


@query("U4_memory_intersect", f"WITH {B.SQL_RUNS} SELECT feed_id, 'k'||run_id AS key FROM runs WHERE run_id%4=0 AND run_id%10<>8")
def memory_intersect(spark, folder):
    listed, _, memory = candidates(spark, folder)
    return A.memory_intersect(memory, listed.filter(F.col("pos") % 10 != 8)).select("feed_id", "key")


@query(
    "ST6_article_memory",
    f"""WITH {B.SQL_RUNS}, s AS (SELECT feed_id, 'k'||run_id AS key, run_id%4=0 AND run_id%40<>0 AS had, run_id%6 AS cnt, CASE WHEN run_id%5<>0 THEN {B.NOW_S}-3600+(run_id%5)*1800 ELSE 0 END AS retry, {B.NOW_S}-(run_id%17)*600 AS tried, run_id%8=0 AS unkept,
 CASE kind WHEN 'error' THEN 'fault' WHEN 'view' THEN 'deferred' WHEN 'purchase' THEN 'stored' END AS outcome, run_id%2=0 AS kept, run_id FROM runs),
 n0 AS (SELECT *, coalesce(outcome='fault',false) AND (NOT had OR retry<={B.NOW_S}) AS fault FROM s),
 n AS (SELECT *, CASE WHEN had THEN cnt ELSE 0 END + CASE WHEN fault THEN 1 ELSE 0 END AS c2 FROM n0)
 SELECT key, CASE WHEN outcome IS NULL THEN tried ELSE {B.NOW_S} END AS tried, CASE WHEN outcome='stored' THEN 0 ELSE c2 END AS count,
  CASE WHEN outcome='stored' THEN 0 WHEN fault THEN {B.NOW_S}+least(3600*(1<<greatest(least(c2-1,5),0)::INT),86400) WHEN had THEN retry ELSE 0 END::BIGINT AS retry,
  CASE WHEN outcome IS NULL THEN unkept ELSE outcome='stored' END AS unkept
 FROM n WHERE (had OR outcome IS NOT NULL) AND (outcome IS NULL OR outcome<>'stored' OR NOT kept)""",
)
def article_memory(spark, folder):
    listed, _, memory = candidates(spark, folder)
    r = B.runs(spark, folder)
    tries = r.select(
        "feed_id", F.concat(F.lit("k"), F.col("run_id").cast("string")).alias("key"), F.lit(1).alias("version"),
        F.when(F.col("kind") == "error", "fault").when(F.col("kind") == "view", "deferred").when(F.col("kind") == "purchase", "stored").alias("outcome"),
        (F.col("run_id") % 2 == 0).alias("kept"),
    ).filter(F.col("outcome").isNotNull())
    return A.article_memory(memory, tries, listed, B.at(B.NOW)).select("key", "tried", "count", "retry", "unkept")


@query(
    "J3_attach_articles",
    f"""WITH {B.SQL_BATCHES} SELECT key, CASE WHEN page_id%4=0 OR page_id%8=3 OR page_id%5=0 THEN '' ELSE 'body ' || url END AS content_full, CASE WHEN page_id%4=0 THEN NULL WHEN page_id%8=3 THEN 'failed' WHEN page_id%5=0 THEN 'gone' END AS failure FROM batch_old""",
)
def attach_articles(spark, folder):
    """Every story but each fourth is queued; some pages failed, some are gone."""
    b = B.batch(spark, folder, "old")
    n = F.col("page_id")
    failure = F.when(n % 8 == 3, "failed").when(n % 5 == 0, "gone")
    bodies = b.select("url", F.when(failure.isNull(), F.concat(F.lit("body "), F.col("url"))).otherwise("").alias("body"), failure.alias("failure")).dropDuplicates(["url"])
    return A.attach_articles(b, bodies, b.filter(n % 4 != 0)).select("key", "content_full", "failure")


def progress(spark, folder):
    r = B.runs(spark, folder)
    stored = F.col("run_id") % 7 != 2
    key = F.concat(F.lit("k"), F.col("run_id").cast("string")).alias("key")
    before = r.select("feed_id", key, F.when(stored, F.col("run_id") % 14 == 0).alias("has_body"))
    after = r.select("feed_id", key, F.when(stored, F.col("run_id") % 7 == 0).alias("has_body"))
    run = r.select("feed_id", key, F.when(F.col("run_id") % 7 == 0, "fetched").otherwise("left").alias("state"))
    return A.article_progress(r.select("feed_id", key), before, after, run)


SQL_PROGRESS = B.SQL_RUNS + """, g AS (SELECT feed_id, count(*) FILTER (WHERE run_id%7<>0) AS left_n, count(*) FILTER (WHERE run_id%7=0) AS fetched, count(*) FILTER (WHERE run_id%14=0) AS had, count(*) FILTER (WHERE run_id%7=0) AS has, count(*) FILTER (WHERE run_id%7 NOT IN (0,2)) AS open_n FROM runs GROUP BY feed_id)"""


@query("A7_article_progress", f'WITH {SQL_PROGRESS} SELECT feed_id, left_n AS "left", fetched, had, has, open_n AS "open", left_n>0 AND fetched>0 AND has>had AND open_n>0 AS backlog FROM g')
def article_progress(spark, folder):
    return progress(spark, folder)


@query("ST7_draining", f"WITH {SQL_PROGRESS} SELECT r.feed_id, coalesce(left_n>0 AND fetched>0 AND has>had AND open_n>0, true) AS draining FROM (SELECT DISTINCT feed_id FROM runs) r LEFT JOIN g USING (feed_id)")
def draining(spark, folder):
    return A.draining(B.event_feeds(spark, folder), progress(spark, folder))


# ---------------------------------------------------------------- documents

IMG = "'<p><img src=\"' || image || '\" alt=\"\"></p>'"
SQL_CONTENT = f"CASE WHEN content_full='' THEN html WHEN image='' OR contains(content_full,image) THEN content_full ELSE {IMG} || content_full END"
RFC = "strftime(make_timestamp({0}*1000000),'%a, %d %b %Y %H:%M:%S +0000')"
ISO = "strftime(make_timestamp({0}*1000000),'%Y-%m-%dT%H:%M:%SZ')"


@query("P34_item_content", f"WITH {B.SQL_STORED} SELECT key, sha256({SQL_CONTENT}) AS digest FROM stored")
def item_content(spark, folder):
    return B.stored_items(spark, folder).select("key", F.sha2(F.encode(render.item_content(), "UTF-8"), 256).alias("digest"))


@query("P35_item_summary", f"WITH {B.SQL_STORED} SELECT key, length(CASE WHEN content_full<>'' AND html<>'' THEN html ELSE '' END) AS chars FROM stored")
def item_summary(spark, folder):
    return B.stored_items(spark, folder).select("key", F.length(render.item_summary()).alias("chars"))


def _nl(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


NAMES = B.escape_sql("'News & views: ' || feed_id")
SQL_RSS = f"""WITH {SQL_KEPT}, {B.SQL_HOSTS}, entries AS (SELECT feed_id, string_agg({_nl("    <item>" + chr(10) + "      <title>")} || {B.escape_sql('title')} || {_nl("</title>" + chr(10) + "      <link>")} || {B.escape_sql('url')} || {_nl("</link>" + chr(10) + '      <guid isPermaLink="false">')} || guid || {_nl("</guid>" + chr(10) + "      <description>")} || {B.escape_sql(SQL_CONTENT)} || {_nl("</description>" + chr(10))}
 || CASE WHEN content_full<>'' AND html<>'' THEN '      <content:encoded>' || {B.escape_sql(SQL_CONTENT)} || {_nl("</content:encoded>" + chr(10))} ELSE '' END
 || CASE WHEN image<>'' THEN '      <media:content url="' || image || {_nl('" type="image/png" medium="image"></media:content>' + chr(10))} ELSE '' END
 || '      <pubDate>' || {RFC.format('published')} || {_nl("</pubDate>" + chr(10) + "    </item>" + chr(10))}, '' ORDER BY published DESC, key) AS x FROM kept GROUP BY feed_id)
 SELECT h.feed_id, '"' || sha256('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || {_nl('<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/">' + chr(10) + "  <channel>" + chr(10) + "    <title>")}
 || {NAMES.replace('feed_id', 'h.feed_id')} || {_nl("</title>" + chr(10) + "    <link>")} || 'https://' || h.feed_id || '/news?a=1&amp;b=2' || {_nl("</link>" + chr(10) + '    <atom:link href="https://reader.example/feeds/')} || h.feed_id || {_nl('.xml" rel="self" type="application/rss+xml"></atom:link>' + chr(10) + "    <description>Updates from ")} || {NAMES.replace('feed_id', 'h.feed_id')}
 || {_nl("</description>" + chr(10) + "    <generator>newsloom</generator>" + chr(10) + "    <ttl>")} || length(h.feed_id) || {_nl("</ttl>" + chr(10) + "    <lastBuildDate>Thu, 01 Feb 2024 00:00:00 +0000</lastBuildDate>" + chr(10))} || coalesce(x,'') || {_nl("  </channel>" + chr(10) + "</rss>")}) || '"' AS etag FROM hosts h LEFT JOIN entries e ON h.feed_id=e.feed_id"""


def rss(spark, folder):
    return render.render_rss(B.host_feeds(spark, folder), B.kept_items(spark, folder), "https://reader.example/feeds/")


@query("K1_rss_documents", SQL_RSS)
def rss_documents(spark, folder):
    return rss(spark, folder).select("feed_id", "etag")


UPD = "greatest(published, last_changed)"
SQL_ATOM = f"""WITH {SQL_KEPT}, {B.SQL_HOSTS}, entries AS (SELECT feed_id, max({UPD}) AS newest, string_agg({_nl("  <entry>" + chr(10) + "    <id>")} || guid || {_nl("</id>" + chr(10) + '    <title type="text">')} || {B.escape_sql('title')} || {_nl("</title>" + chr(10) + '    <link rel="alternate" type="text/html" href="')} || {B.escape_sql('url')} || {_nl('"></link>' + chr(10))}
 || CASE WHEN image<>'' THEN '    <link rel="enclosure" type="image/png" href="' || image || {_nl('"></link>' + chr(10))} ELSE '' END
 || '    <published>' || {ISO.format('published')} || {_nl("</published>" + chr(10) + "    <updated>")} || {ISO.format(UPD)} || {_nl("</updated>" + chr(10))}
 || CASE WHEN content_full<>'' AND html<>'' THEN '    <summary type="html">' || {B.escape_sql('html')} || {_nl("</summary>" + chr(10))} ELSE '' END
 || '    <content type="html">' || {B.escape_sql(SQL_CONTENT)} || {_nl("</content>" + chr(10) + "  </entry>" + chr(10))}, '' ORDER BY published DESC, key) AS x FROM kept GROUP BY feed_id)
 SELECT h.feed_id, '"' || sha256('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || {_nl('<feed xmlns="http://www.w3.org/2005/Atom">' + chr(10) + "  <id>urn:sha256:")} || sha256('newsloom:feed' || chr(0) || h.feed_id) || {_nl("</id>" + chr(10) + '  <title type="text">')} || {NAMES.replace('feed_id', 'h.feed_id')} || {_nl("</title>" + chr(10) + "  <updated>")}
 || {ISO.format(f'greatest({B.T1}, coalesce(newest,{B.T1}))')} || {_nl("</updated>" + chr(10) + "  <author>" + chr(10) + "    <name>")} || {NAMES.replace('feed_id', 'h.feed_id')} || {_nl("</name>" + chr(10) + "    <uri>https://")} || h.feed_id || {_nl("/news?a=1&amp;b=2</uri>" + chr(10) + "  </author>" + chr(10) + '  <link rel="alternate" type="text/html" href="https://')} || h.feed_id
 || {_nl('/news?a=1&amp;b=2"></link>' + chr(10) + '  <link rel="self" type="application/atom+xml" href="https://reader.example/feeds/')} || h.feed_id || {_nl('.atom"></link>' + chr(10))} || coalesce(x,'') || '</feed>') || '"' AS etag, CAST(NULL AS VARCHAR) AS failure FROM hosts h LEFT JOIN entries e ON h.feed_id=e.feed_id"""


@query("K2_atom_documents", SQL_ATOM)
def atom_documents(spark, folder):
    return render.render_atom(B.host_feeds(spark, folder), B.kept_items(spark, folder)).select("feed_id", "etag", "failure")


@query(
    "K3_opml_document",
    f"""WITH {B.SQL_HOSTS}, o AS (SELECT count(*) AS n, string_agg('    <outline type="rss" text="' || {NAMES} || '" title="' || {NAMES} || '" xmlUrl="https://reader.example/feeds/' || feed_id || '.xml" htmlUrl="https://' || feed_id || '/news?a=1&amp;b=2"></outline>' || chr(10), '' ORDER BY feed_id) AS x FROM hosts)
 SELECT CASE WHEN n<=1000 THEN sha256('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || {_nl('<opml version="2.0">' + chr(10) + "  <head>" + chr(10) + "    <title>Library</title>" + chr(10) + "    <dateCreated>Thu, 08 Feb 2024 00:00:00 +0000</dateCreated>" + chr(10) + "  </head>" + chr(10) + "  <body>" + chr(10))} || x || {_nl("  </body>" + chr(10) + "</opml>" + chr(10))}) END AS digest, CASE WHEN n>1000 THEN 'more than 1000 feeds' END AS failure FROM o""",
)
def opml(spark, folder):
    doc = render.render_opml(B.host_feeds(spark, folder), "Library", B.at(B.NOW))
    return doc.select(F.sha2(F.encode("doc", "UTF-8"), 256).alias("digest"), "failure")


@query("K6_changed_documents", f"WITH {SQL_KEPT}, {B.SQL_HOSTS} SELECT feed_id FROM hosts WHERE length(feed_id)%3<>0")
def changed_documents(spark, folder):
    """Two thirds of the readers hold an outdated document or none."""
    new = rss(spark, folder)
    n = F.length("feed_id")
    held = new.filter(n % 3 != 1).select("feed_id", F.when(n % 3 == 0, F.col("etag")).otherwise('"old"').alias("etag"))
    return render.changed_only(new, held).select("feed_id")


@query(
    "flagship_feeds",
    f"""WITH {B.SQL_NAV}, u AS (SELECT feed_id, link, title, row_number() OVER (PARTITION BY feed_id, link ORDER BY page_id, pos) AS k FROM cards WHERE NOT contains(lower(title),'the') AND page_id%11<>0 AND page_id%13<>0),
 r AS (SELECT feed_id, link, title, row_number() OVER (PARTITION BY feed_id ORDER BY link) AS place FROM u WHERE k=1) SELECT feed_id, count(*) AS items, string_agg(link, ' ' ORDER BY link) AS links FROM r WHERE place<=500 GROUP BY feed_id""",
)
def flagship_check(spark, folder):
    from newsloom.plans.refresh import front_items

    items = front_items(spark, folder)
    return items.groupBy("feed_id").agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_list("url")), " ").alias("links"))


