"""Queries of joins, aggregations, windows, orders, sets, contracts and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contracts, relational

QUERIES: dict = {}
SQL: dict = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str, check: bool = True) -> DataFrame:
    """The chain of many-to-one left joins, each with its uniqueness contract."""
    out = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    steps = [
        (_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), ["l_orderkey"]),
        (_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), ["o_custkey"]),
        (_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"), ["c_nationkey"]),
        (_t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), ["n_regionkey"]),
        (_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"]),
        (_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), ["l_suppkey"]),
    ]
    for right, keys in steps:
        out = relational.one_match(out, right, keys, check=check)
    return out


_MANIFEST = """manifest AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderpriority, c_mktsegment, n_name, r_name, p_brand, s_name
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey)"""


@query(f"WITH {_MANIFEST} SELECT * FROM manifest")
def j1_j4_manifest(spark, sf_dir):
    return manifest(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "o_orderpriority", "c_mktsegment", "n_name", "r_name", "p_brand", "s_name")


@query(f"WITH {_MANIFEST} SELECT (SELECT count(*) FROM lineitem) AS n_before, count(*) AS n_after FROM manifest HAVING n_before <> n_after")
def v4_count_contract(spark, sf_dir):
    return contracts.count_change(_t(spark, sf_dir, "lineitem"), manifest(spark, sf_dir, check=False))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def j8_u3_unseen(spark, sf_dir):
    users = _t(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return relational.unseen(_t(spark, sf_dir, "customer").select("c_custkey"), users, ["c_custkey"])


@query("""WITH o AS (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
SELECT orders.o_orderkey, coalesce(n, 0) AS n_offers, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN s ELSE -1 END AS l_suppkey FROM orders LEFT JOIN o USING (o_orderkey)""")
def j9_assignment(spark, sf_dir):
    offers = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    out = relational.assigned(_t(spark, sf_dir, "orders").select("o_orderkey"), offers, ["o_orderkey"], ["l_suppkey"])
    return out.withColumn("l_suppkey", F.coalesce("l_suppkey", F.lit(-1)))


@query("""SELECT user_id, count(DISTINCT event_type) AS n_items FROM events WHERE value > 50 AND event_type IN ('view', 'click', 'purchase')
GROUP BY user_id HAVING n_items = (SELECT count(DISTINCT event_type) FROM events WHERE event_type IN ('view', 'click', 'purchase'))""")
def j10_division(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_type", "value")
    wanted = events.filter(F.col("event_type").isin("view", "click", "purchase"))
    return relational.holders_of_all(events.filter("value > 50"), "user_id", "event_type", wanted)


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS n_recorded FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def j12_a4_recorded(spark, sf_dir):
    out = relational.one_match(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("recorded")), ["doc_id"])
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.count("recorded").alias("n_recorded"))


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def j13_w5_last_row(spark, sf_dir):
    return relational.last_value(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["value", "event_id"], ["ts", "event_id"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def w4_w6_first_row(spark, sf_dir):
    return relational.first_row(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT a.user_id, first_predictor, last_outcome FROM (SELECT user_id, min(ts) AS first_predictor FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, max(ts) AS last_outcome FROM events WHERE event_type = 'purchase' GROUP BY 1) b USING (user_id) WHERE first_predictor < last_outcome")
def j21_precedes(spark, sf_dir):
    from ..operators.decisions import precedes

    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return precedes(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "user_id", "ts")


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'view'), 6) AS delta FROM events GROUP BY user_id")
def a1_p3_pivot_difference(spark, sf_dir):
    kinds = ["click", "purchase", "view"]
    wide = relational.pivot_mean(_t(spark, sf_dir, "events"), ["user_id"], "event_type", kinds, "value")
    return wide.select("user_id", *[F.round(k, 6).alias(k) for k in kinds], F.round(F.col("purchase") - F.col("view"), 6).alias("delta"))


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_segments, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segments, count(*) AS n FROM customer GROUP BY c_nationkey")
def a2_a3_distinct_lists(spark, sf_dir):
    return _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count_distinct("c_mktsegment").alias("n_segments"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ";").alias("segments"), F.count("*").alias("n")
    )


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS total, count(*) FILTER (value > 10) AS n_large FROM events GROUP BY event_type")
def a5_a6_summary(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("value") > 10).alias("n_large"))


@query("SELECT user_id, event_type, max(k) + 1 AS occurrences FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS k FROM events) GROUP BY ALL")
def a7_w3_occurrence(spark, sf_dir):
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    placed = _t(spark, sf_dir, "events").withColumn("k", F.row_number().over(order) - 1)
    return placed.groupBy("user_id", "event_type").agg((F.max("k") + 1).cast("long").alias("occurrences"))


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean_effect, round(median(p_retailprice), 6) AS median_effect, max(p_size) AS p_max FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size IS NULL) GROUP BY p_brand")
def a8_a9_combine_probes(spark, sf_dir):
    """Declared combination: mean or median effect, the largest p; groups with an
    unparseable member are dropped whole."""
    part = _t(spark, sf_dir, "part")
    out = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.median("p_retailprice").alias("d"), F.max("p_size").alias("p_max"), F.count_if(F.col("p_size").isNull()).alias("bad"))
    return out.filter("bad = 0").select("p_brand", F.round("m", 6).alias("mean_effect"), F.round("d", 6).alias("median_effect"), "p_max")


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey")
def a12_ordered_lists(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_partkey"].cast("string")), ";").alias("parts"))


# term families and their terms, searched in the documents
TERMS = (("license", "MIT License"), ("license", "Apache License"), ("license", "General Public License"), ("contact", "example.com"), ("contact", "@"), ("secret", "token"), ("secret", "password"), ("layout", "|"))
_TERMS = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{t}')" for g, t in TERMS) + ") AS v(term_group, term)), hits AS (SELECT term_group, term, d.doc_id AS accession, 1.0 AS score FROM documents d, terms WHERE contains(d.text, term))"


def hits(spark, sf_dir):
    """One pass over the texts: each document with the terms that it holds."""
    every = F.array(*[F.struct(F.lit(g).alias("term_group"), F.lit(t).alias("term")) for g, t in TERMS])
    found = F.filter(every, lambda x: F.contains(F.col("text"), x["term"]))
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("accession"), F.explode(found).alias("h")).select("h.term_group", "h.term", "accession", F.lit(1.0).alias("score"))


@query(f"WITH {_TERMS} SELECT accession, count(DISTINCT term_group) AS n_groups, CAST(sum(score) AS DOUBLE) AS score, string_agg(DISTINCT term_group, ';' ORDER BY term_group) AS groups FROM hits GROUP BY accession HAVING count(*) FILTER (term_group = 'license') > 0 AND count(DISTINCT term_group) >= 1 ORDER BY n_groups DESC, score DESC, accession LIMIT 50")
def o2_a13_u7_ranked_search(spark, sf_dir):
    out = relational.ranked_hits(hits(spark, sf_dir), ["license"], 1, 50)
    return out.select("accession", "n_groups", "score", F.array_join("groups", ";").alias("groups"))


@query(f"WITH {_TERMS}, a AS (SELECT accession, count(*) AS n FROM hits GROUP BY accession) SELECT term_group, term, count(*) AS hits, count(*) FILTER (n = 1) AS unique_hits, term_group = 'license' AS required FROM hits JOIN a USING (accession) GROUP BY ALL")
def o3_a14_term_audit(spark, sf_dir):
    return relational.term_audit(hits(spark, sf_dir), ["license"])


@query("SELECT user_id, CASE WHEN bool_and(s = 'cached') THEN 'cached' WHEN bool_and(s IN ('success', 'cached')) THEN 'success' WHEN bool_or(s IN ('success', 'cached')) THEN 'partial' ELSE 'failed' END AS status FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cached' ELSE 'success' END AS s FROM events) GROUP BY user_id")
def a20_status_rollup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "cached").otherwise("success"))
    return relational.status_rollup(e, ["user_id"], "s")


@query("SELECT count(*) AS n, count(text) FILTER (text <> '') AS n_text, count(lang) FILTER (lang <> '') AS n_lang, count(source) FILTER (source <> '') AS n_source FROM documents")
def a22_missingness(spark, sf_dir):
    return _t(spark, sf_dir, "documents").agg(F.count("*").alias("n"), *[F.count_if(F.col(c) != "").alias(f"n_{c}") for c in ("text", "lang", "source")])


@query("SELECT n_nationkey, n_name, array_to_string(list_filter(s, lambda x: x <> n_name), ';') AS siblings FROM nation JOIN (SELECT n_regionkey, list(DISTINCT n_name ORDER BY n_name) AS s FROM nation GROUP BY 1) USING (n_regionkey)")
def w9_siblings(spark, sf_dir):
    out = relational.siblings(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", "n_name")
    return out.select("n_nationkey", "n_name", F.array_join("siblings", ";").alias("siblings"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, CAST(150 AS BIGINT) AS next_offset FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def o5_page(spark, sf_dir):
    return relational.page(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100, 50)


@query("SELECT c_custkey, c_name, position FROM customer JOIN (VALUES (17, 0), (3, 1), (99, 2), (42, 3)) AS v(k, position) ON k = c_custkey")
def o6_j7_given_order(spark, sf_dir):
    return relational.in_given_order(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", [17, 3, 99, 42])


@query("SELECT o_custkey, max(o_totalprice) AS best, count(*) FILTER (o_totalprice = m) AS n_best FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY o_custkey")
def o8_ties(spark, sf_dir):
    placed = _t(spark, sf_dir, "orders").withColumn("k", F.rank().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))))
    return placed.filter("k = 1").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.count("*").alias("n_best"))


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark UNION ALL SELECT page_id, 'page' FROM pages")
def u1_u2_union(spark, sf_dir):
    frames = [_t(spark, sf_dir, n).select(F.col(c).alias("id"), F.lit(k).alias("kind")) for n, c, k in (("documents", "doc_id", "document"), ("benchmark", "item_id", "benchmark"), ("pages", "page_id", "page"))]
    return relational.union_same_header(frames)


@query("SELECT doc_id, 'missing' AS fault FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def u5_u6_set_report(spark, sf_dir):
    return relational.set_report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer")
def u4_intersection(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("user_id").intersect(_t(spark, sf_dir, "customer").select("c_custkey"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def u8_distinct_rows(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_type", "user_id").dropDuplicates()


@query("SELECT user_id FROM events WHERE value > 50 GROUP BY user_id HAVING count(DISTINCT event_type) FILTER (event_type IN ('view', 'click', 'purchase')) = 3")
def f12_complete(spark, sf_dir):
    return relational.complete(_t(spark, sf_dir, "events").filter("value > 50"), ["user_id"], "event_type", ["view", "click", "purchase"])


FILE_RULES = [("french", "http", r"/fr/"), ("paged", "http", r"[?&]page="), ("anchored", "https", r"#"), ("german", "https", r"/de/")]


@query("""SELECT page_id, CASE WHEN split_part(url, ':', 1) = 'http' AND regexp_matches(url, '/fr/') THEN 'french' WHEN split_part(url, ':', 1) = 'http' AND regexp_matches(url, '[?&]page=') THEN 'paged'
WHEN split_part(url, ':', 1) = 'https' AND regexp_matches(url, '#') THEN 'anchored' WHEN split_part(url, ':', 1) = 'https' AND regexp_matches(url, '/de/') THEN 'german' ELSE 'unclassified' END AS rule FROM pages""")
def f10_classify(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", F.substring_index("url", ":", 1).alias("scheme"))
    return tx.classify(pages, FILE_RULES, "scheme", "url").select("page_id", "rule")


@query("SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: regexp_matches(x, '^/[a-z]+$')))), ';') AS links FROM pages")
def s23_links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(tx.hrefs(F.col("html"), "^/[a-z]+$"), ";").alias("links"))


_TITLE = "'Trial' || (user_id % 2 + 1) || ' Subject ID ' || user_id || ' Day ' || day(ts)"


@query(f"""WITH t AS (SELECT event_id, {_TITLE} AS title FROM events)
SELECT event_id, 'Trial ' || regexp_extract(title, '(?i)\\btrial[\\s_-]*(\\d+)\\b', 1) AS cohort, regexp_extract(title, '(?i)\\bsubject[\\s_-]*id[\\s_:-]*([A-Za-z0-9]+)\\b', 1) AS subject, 'Day ' || regexp_extract(title, '(?i)\\bday[\\s_-]*(\\d+)\\b', 1) AS timepoint FROM t""")
def x3_x5_titles(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Trial"), F.col("user_id") % 2 + 1, F.lit(" Subject ID "), "user_id", F.lit(" Day "), F.dayofmonth("ts")).alias("title"))
    title = F.col("title")
    return e.select("event_id", tx.cohort(title).alias("cohort"), tx.subject(title).alias("subject"), tx.timepoint(title).alias("timepoint"))


@query("""WITH t AS (SELECT user_id, 'samples on days ' || (user_id % 7) || ', ' || (user_id % 5 + 7) || ' and 84; d' || (user_id % 3 + 20) AS s FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, array_to_string(list_sort(list_distinct([CAST(user_id % 7 AS INTEGER), CAST(user_id % 5 + 7 AS INTEGER), 84, CAST(user_id % 3 + 20 AS INTEGER)])), ';') AS days FROM t""")
def x6_days_mentioned(spark, sf_dir):
    u = _t(spark, sf_dir, "events").select("user_id").distinct()
    said = F.concat(F.lit("samples on days "), F.col("user_id") % 7, F.lit(", "), F.col("user_id") % 5 + 7, F.lit(" and 84; d"), F.col("user_id") % 3 + 20)
    return u.select("user_id", F.array_join(F.transform(tx.days_mentioned(said), lambda d: d.cast("string")), ";").alias("days"))


_LONGEST = ["License", "MIT License", "Apache License", "token", "General Public License"]


@query("""SELECT doc_id, list_filter(['General Public License', 'Apache License', 'MIT License', 'License', 'token'], lambda t: contains(lower(text), lower(t)))[1] AS term FROM documents""")
def x13_f6_longest_term(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.longest_term(F.col("text"), _LONGEST).alias("term"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING n > 1")
def x19_v16_copies(spark, sf_dir):
    return _t(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none FROM events")
def x2_f9_json_numbers(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", tx.number(F.get_json_object("props", "$.k")).alias("k"), tx.number(F.col("event_type")).alias("none"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, 'repeated' AS reason FROM lineitem GROUP BY ALL HAVING n > 1")
def v1_v6_key_faults(spark, sf_dir):
    return contracts.key_faults(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n", "reason")


@query("SELECT o_orderkey, c_nationkey, s_nationkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL")
def v2_disagreement(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return contracts.disagreement(o.join(li, "o_orderkey"), ["c_nationkey", "s_nationkey"]).select("o_orderkey", "c_nationkey", "s_nationkey").distinct()


@query("SELECT p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ';') IS NOT NULL AS several, count(DISTINCT p_size) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1")
def v7_several_values(spark, sf_dir):
    return contracts.several_values(_t(spark, sf_dir, "part"), "p_brand", "p_size").select("p_brand", F.lit(True).alias("several"), F.size("values").cast("long").alias("n"))
