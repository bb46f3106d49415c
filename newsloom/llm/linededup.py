"""Line dedup by log templates with DataFrame functions only.

A line, without white space around it, is cut into tokens at single spaces and goes down a tree of fixed depth: its
number of tokens, then its leading tokens, with tokens that hold a digit taken as variable. In a leaf, a token that enough documents share at its place is constant, all others and those with
digits are variable. A line whose constants are most of it stands for its template; any other line for itself with
digits made variable. Templates that recur across documents are dropped from all documents but the first.

By a count alone, the values of a variable word turn constant as the table grows. So the whole job (cleaned) also takes
for constant only the tokens with a share of their leaf, at several shares, as a leaf may hold several templates: each
share gives a line one more template, coarser than the last, and the line goes if any recurs. It also drops long lines that
are equal in two documents of different texts; equal texts are left to near-dedup, which takes the whole document.

Only leaves that enough lines reach are looked at in full, equal lines are counted once with a weight, and all counting
is partial before a shuffle, so neither a hot line nor a group of copies gathers anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import stored, table, whole_row
from newsloom.session import tune

#: Leading tokens of a leaf, documents a template must recur in, constants a generalised template needs: number and share.
DEPTH, LEAST_DOCS, LEAST_CONSTANTS, LEAST_SHARE = 3, 4, 5, 0.75
#: Shares of a leaf's lines at which tokens are constant, and bytes of a line that two documents don't hold by chance.
SHARES, LONG_LINE = (1 / 2, 1 / 8, 1 / 32), 40
ANY = "<*>"
_LAST = 2**63 - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\x0b\x0c\r"))


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), ANY).otherwise(token)


def _exploded(docs: DataFrame) -> DataFrame:
    """k, doc_id, pos, line and leaf of every line that isn't blank.

    Counting spaces and cutting off the leading tokens spares making the tokens of every line.
    """
    rows = docs.select("_k", "_x", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", _bare(F.col("line"))).filter(F.col("line") != "")
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    lead = F.regexp_replace(F.substring_index("line", " ", DEPTH), "[^ ]*[0-9][^ ]*", ANY)
    return rows.withColumn("leaf", F.xxhash64(spaces, lead))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_k", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _template(share: float) -> Column:
    """The template of the tokens t if those with more than a share of 0, and at least share, are constant."""
    constant = lambda x: (x["share"] > 0) & (x["share"] >= share)
    constants = F.size(F.filter("t", constant))
    general = (constants >= LEAST_CONSTANTS) & (constants >= LEAST_SHARE * F.size("t"))
    return F.when(general, F.transform("t", lambda x: F.when(constant(x), x["token"]).otherwise(ANY))).otherwise(F.transform("t", lambda x: x["token"]))


def dropped_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, whole: bool = False) -> DataFrame:
    """(k, dropped): the places of the lines that go, by a hash k of doc_id and text."""
    lines = _exploded(_keyed(docs.select("doc_id", F.col("text").cast("string"))).withColumn("_x", F.xxhash64("text")))
    busy = lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= (min(2, least_docs) if whole else least_docs)).select("leaf")
    seen = lines.select("_k", *(["_x"] if whole else []), "doc", "pos", "line", "leaf").join(busy, "leaf", "left_semi")
    seen = stored(seen.withColumn("h", F.xxhash64("line")), "lines")
    unique = seen.select("h", "_k").distinct().groupBy("h").agg(F.count("*").alias("n")).join(seen.groupBy("h").agg(F.first("leaf").alias("leaf"), F.first("line").alias("line")), "h")
    unique = stored(unique, "unique-lines")

    # Constants: tokens that enough documents hold at the same place of the same leaf.
    words = unique.select("h", "leaf", "n", F.posexplode(F.split("line", " ", -1)).alias("at", "token")).withColumn("token", _masked(F.col("token")))
    common = words.filter(F.col("token") != ANY).groupBy("leaf", "at", "token").agg(F.sum("n").alias("m")).filter(F.col("m") >= least_docs)
    if whole:
        common = common.join(unique.groupBy("leaf").agg(F.sum("n").alias("all")), "leaf")
    common = common.select("leaf", "at", "token", (F.col("m") / F.col("all") if whole else F.lit(1.0)).alias("share"))
    told = words.join(common, ["leaf", "at", "token"], "left").groupBy("h").agg(
        F.sort_array(F.collect_list(F.struct("at", "token", F.coalesce("share", F.lit(0.0)).alias("share")))).alias("t"), F.first("leaf").alias("leaf")
    )
    templates = told.select("h", F.explode(F.array_distinct(F.array(*[F.xxhash64(_template(share)) for share in (0.0, *(SHARES if whole else ()))]))).alias("template"))

    placed = stored(seen.select("h", "_k", "doc", "pos").join(templates, "h").select("_k", "doc", "pos", "template"), "templates")
    once = placed.select("template", "doc", "_k").distinct().groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "_k")).alias("first"))
    repeated = once.filter(F.col("docs") >= least_docs).select("template", F.col("first._k").alias("first"))
    gone = placed.join(repeated, "template").filter(F.col("_k") != F.col("first")).select("_k", "pos")
    if whole:
        long = seen.filter(F.octet_length("line") >= LONG_LINE)
        texts = long.groupBy("h").agg(F.min(F.struct("doc", "_k", "_x")).alias("first"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).filter(F.col("lo") != F.col("hi"))
        equal = long.join(texts.select("h", F.col("first._x").alias("first")), "h").filter(F.col("_x") != F.col("first"))
        gone = gone.unionByName(equal.select("_k", "pos"))
    return gone.groupBy("_k").agg(F.collect_set("pos").alias("_dropped"))


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, whole: bool = False) -> DataFrame:
    """docs with text without the dropped lines, and n_lines and n_dropped.

    whole also takes constants by their share of the leaf, and drops long lines from the second text that holds them.
    The first document of a template, by doc_id and null last, keeps it. A null text stays null with no lines, an empty
    text is one blank line; blank lines stay. Rows with the same doc_id and text are one document and treated alike. An
    empty table gives none. Other columns stay as they are, but for those named like the added ones.
    """
    tune(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    # Other columns travel as one struct, so that they can't clash with those added on the way.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest_of_row = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")] if others else []
    joined = _keyed(docs.select("doc_id", "text", *rest_of_row)).join(dropped_lines(docs, least_docs, whole), "_k", "left")
    lines = _lines(F.col("text").cast("string"))
    rest = F.filter(lines, lambda line, at: ~F.array_contains("_dropped", at))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    counts = [F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("_dropped"), F.lit(0))]
    columns = [text.alias("text") if c == "text" else F.col(c) if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns]
    known = F.col("text").isNotNull()
    return joined.select(*columns, *(F.when(known & (c >= 0), c).otherwise(0).cast("long").alias(n) for c, n in zip(counts, ("n_lines", "n_dropped"), strict=True)))


def cleaned(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs without the dropped lines; documents of which nothing but blank lines is left by that go."""
    out = dedup_lines(docs.select("doc_id", "text", whole_row(docs)), least_docs, whole=True)
    empty = (F.col("n_dropped") > 0) & (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == "")
    columns = [F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.filter(~F.coalesce(empty, F.lit(False))).select(*columns)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


SQL = r"""
WITH l0 AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT *, string_split(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), ' ') AS tokens FROM l0 WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
l2 AS (SELECT *, list_transform(tokens, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS masked FROM l1),
l3 AS (SELECT *, len(tokens) || ' ' || array_to_string(masked[1:3], ' ') AS leaf FROM l2),
busy AS (SELECT leaf FROM l3 GROUP BY leaf HAVING count(*) >= 4),
seen AS (SELECT l3.* FROM l3 SEMI JOIN busy USING (leaf)),
uniq AS (SELECT tokens AS line, any_value(leaf) AS leaf, any_value(masked) AS masked, count(DISTINCT doc_id) AS n FROM seen GROUP BY tokens),
words AS (SELECT line, leaf, n, unnest(masked) AS token, generate_subscripts(masked, 1) AS place FROM uniq),
common AS (SELECT leaf, place, token FROM words WHERE token <> '<*>' GROUP BY ALL HAVING sum(n) >= 4),
told AS (SELECT w.line, list(w.token ORDER BY w.place) AS tokens, list(c.token IS NOT NULL ORDER BY w.place) AS constant
  FROM words w LEFT JOIN common c ON w.leaf = c.leaf AND w.place = c.place AND w.token = c.token GROUP BY w.line),
tmpl AS (SELECT line, CASE WHEN len(list_filter(constant, lambda x: x)) >= greatest(5, 0.75 * len(tokens))
   THEN list_transform(tokens, lambda x, i: CASE WHEN constant[i] THEN x ELSE '<*>' END) ELSE tokens END AS template FROM told),
placed AS (SELECT s.doc_id, s.pos, t.template FROM seen s JOIN tmpl t ON t.line = s.tokens),
rep AS (SELECT template, min(doc_id) AS first FROM placed GROUP BY template HAVING count(DISTINCT doc_id) >= 4),
gone AS (SELECT p.doc_id, p.pos FROM placed p JOIN rep USING (template) WHERE p.doc_id <> rep.first),
cnt AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM l0 l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text
FROM documents d LEFT JOIN cnt c USING (doc_id)
"""
