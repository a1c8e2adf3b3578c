"""Further queries: predicates, scalar functions, lookups, groups and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contracts, decisions, relational

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


@query("SELECT c_custkey, c_acctbal FROM customer WHERE lower(c_mktsegment) = 'building' AND c_name <> '' AND c_nationkey IN (1, 2, 3, 4, 5) AND c_acctbal BETWEEN 0 AND 7000")
def f1_f4_predicates(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.filter((F.lower("c_mktsegment") == "building") & (F.col("c_name") != "") & F.col("c_nationkey").isin(1, 2, 3, 4, 5) & F.col("c_acctbal").between(0, 7000)).select("c_custkey", "c_acctbal")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[sc]ed under')")
def f5_regex_contains(spark, sf_dir):
    return _t(spark, sf_dir, "documents").filter(F.regexp_like("text", F.lit("(?i)licen[sc]ed under"))).select("doc_id")


@query("SELECT page_id FROM pages WHERE NOT (regexp_matches(url, 'page=') OR regexp_matches(url, '#'))")
def f11_exclusion(spark, sf_dir):
    bad = decisions.any_of([F.regexp_like("url", F.lit(p)) for p in ("page=", "#")])
    return _t(spark, sf_dir, "pages").filter(~bad).select("page_id")


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part b WHERE lower(b.p_name) = lower(part.p_name)) AS n FROM part WHERE lower(p_name) = lower((SELECT min(p_name) FROM part))")
def f14_one_feature(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    wanted = part.agg(F.min("p_name")).first()[0]
    own = part.filter(F.lower("p_name") == (wanted or "").lower())
    return own.withColumn("n", F.lit(own.count()).cast("long"))


@query("SELECT s_suppkey, coalesce('nation:' || n_name, 'accession:' || s_suppkey) AS group_id FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n_nationkey = s_nationkey")
def j17_default_group(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    out = relational.one_match(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), nation, ["s_nationkey"])
    return out.select("s_suppkey", F.coalesce(F.concat(F.lit("nation:"), "n_name"), F.concat(F.lit("accession:"), "s_suppkey")).alias("group_id"))


@query("SELECT accession, max_by(group_id, ord) AS group_id FROM (SELECT n_nationkey AS ord, 'r' || n_regionkey AS group_id, unnest(['SDY' || n_regionkey, 'GSE' || n_nationkey, 'GSE' || (n_nationkey + 1)]) AS accession FROM nation) GROUP BY accession")
def j18_registry(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    text = lambda p, c: F.concat(F.lit(p), c)
    links = n.select(
        F.col("n_nationkey").alias("ord"), text("r", F.col("n_regionkey")).alias("group_id"), text("SDY", F.col("n_regionkey")).alias("immport_accession"), text("GSE", F.col("n_nationkey")).alias("geo_accession"),
        F.array(text("GSE", F.col("n_nationkey") + 1)).alias("geo_subseries"), F.lit(None).cast("array<string>").alias("accessions"),
    )
    return relational.registry_groups(links)


@query("SELECT immport_id, geo_id, min_by('r' || n_nationkey, n_nationkey) AS group_id FROM (SELECT DISTINCT 'SDY' || n_regionkey AS immport_id, 'GSE' || (n_nationkey % 7) AS geo_id FROM nation) p JOIN nation l ON 'SDY' || l.n_regionkey = immport_id AND (geo_id = 'GSE' || l.n_nationkey OR geo_id = 'GSE' || (l.n_nationkey + 1)) GROUP BY ALL")
def j19_d13_link_gate(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    text = lambda p, c: F.concat(F.lit(p), c)
    pairs = n.select(text("SDY", F.col("n_regionkey")).alias("immport_id"), text("GSE", F.col("n_nationkey") % 7).alias("geo_id")).distinct()
    links = n.select(F.col("n_nationkey").alias("ord"), text("r", F.col("n_nationkey")).alias("group_id"), text("SDY", F.col("n_regionkey")).alias("immport_accession"), text("GSE", F.col("n_nationkey")).alias("geo_accession"), F.array(text("GSE", F.col("n_nationkey") + 1)).alias("geo_subseries"))
    return relational.verified_link(pairs, links)


@query("SELECT l_suppkey, n_name, round(avg(l_quantity), 6) AS quantity, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey WHERE p_size > 10 GROUP BY ALL")
def j14_j15_inner_chain(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = _t(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    place = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(F.broadcast(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")
    return line.join(part, "l_partkey").join(place, "l_suppkey").groupBy("l_suppkey", "n_name").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.count("*").alias("n"))


@query("SELECT criterion, string_agg(CAST(c_custkey AS VARCHAR), ';' ORDER BY c_custkey) AS datasets FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_nationkey = 3 THEN 'nation' END], lambda x: x IS NOT NULL)) AS criterion FROM customer) GROUP BY criterion")
def a15_criteria_to_datasets(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    failed = F.filter(F.array(F.when(F.col("c_acctbal") < 0, "balance"), F.when(F.col("c_nationkey") == 3, "nation")), lambda x: x.isNotNull())
    rows = c.select("c_custkey", F.explode(failed).alias("criterion"))
    return rows.groupBy("criterion").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ";").alias("datasets"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS members, count(DISTINCT n_name) AS n_members, count(DISTINCT n_name) >= 5 AS sufficient FROM nation GROUP BY n_regionkey")
def a16_d16_independence_summary(spark, sf_dir):
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("members"), F.count_distinct("n_name").alias("n_members")).withColumn("sufficient", F.col("n_members") >= 5)


@query("SELECT doc_id, n_chars, n_chars <> length(text) AS truncated FROM documents ORDER BY doc_id LIMIT 20")
def o7_head(spark, sf_dir):
    return _t(spark, sf_dir, "documents").orderBy("doc_id").limit(20).select("doc_id", "n_chars", (F.col("n_chars") != F.char_length("text")).alias("truncated"))


_KEYS = {"license": ["license", "licensed"], "contact": ["@", "example.com"], "layout": ["|"]}


@query("SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'licensed') AS license, contains(lower(text), '@') OR contains(lower(text), 'example.com') AS contact, CAST(contains(lower(text), '@') AS BIGINT) + CAST(contains(lower(text), 'example.com') AS BIGINT) AS n_contact FROM documents WHERE text IS NOT NULL")
def x7_x27_keyword_evidence(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", tx.keyword_evidence(F.col("text"), _KEYS).alias("e"))
    found = lambda k: F.try_element_at("e", F.lit(k))
    return d.select("doc_id", found("license")["detected"].alias("license"), found("contact")["detected"].alias("contact"), F.size(found("contact")["terms"]).cast("long").alias("n_contact"))


_LINK = "'acc=gse' || (page_id % 50) || ';GSE' || (page_id % 9) || ' ' || url"


@query(f"SELECT page_id, array_to_string(list_sort(list_distinct(['GSE' || (page_id % 50), 'GSE' || (page_id % 9)])), ';') AS found, regexp_replace('GSE' || (13000 + page_id), '[0-9]{{1,3}}$', 'nnn') AS folder, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM (SELECT * FROM pages WHERE NOT regexp_matches(upper(url), 'GSE[0-9]'))")
def x9_x10_x15_x16_accessions(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").filter(~F.regexp_like(F.upper("url"), F.lit("GSE[0-9]")))
    link = F.concat(F.lit("acc=gse"), F.col("page_id") % 50, F.lit(";GSE"), F.col("page_id") % 9, F.lit(" "), F.col("url"))
    return p.select("page_id", F.array_join(tx.accessions(link), ";").alias("found"), tx.series_directory(F.concat(F.lit("GSE"), 13000 + F.col("page_id"))).alias("folder"), tx.slug(F.col("url")).alias("slug"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false END AS state, CASE WHEN event_type IN ('view', 'purchase') THEN event_type ELSE 'x' END AS preferred, round(log2(value + 1), 6) AS l2 FROM events WHERE value >= 0")
def x2_x18_x20_scalars(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("value >= 0")
    kind = F.col("event_type")
    state = tx.tri_state(F.when(kind == "view", " YES").when(kind == "click", "0").otherwise("maybe"))
    return e.select("event_id", state.alias("state"), tx.preferred(F.when(kind.isin("view", "purchase"), kind).otherwise(""), F.lit("x")).alias("preferred"), F.round(F.log2(F.col("value") + 1), 6).alias("l2"))


@query("SELECT page_id, replace(replace(url, '|', '\\|'), chr(10), ' ') AS cell, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM pages")
def x22_escapes(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.markdown_cell(F.col("url")).alias("cell"), tx.html_escape(F.col("url")).alias("safe"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_partkey) AS parts, count(*) = 3 AS counted, count(DISTINCT l_partkey) = count(*) AS single FROM lineitem GROUP BY l_orderkey")
def x23_list_checks(spark, sf_dir):
    made = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ";").alias("parts"))
    faults = tx.list_faults(F.col("parts"), F.lit(3))
    return made.select("l_orderkey", "parts", (~F.array_contains(faults, "count")).alias("counted"), (~F.array_contains(faults, "duplicate")).alias("single"))


@query("SELECT eligibility, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'excluded' WHEN c_custkey % 4 = 0 THEN 'uncertain' ELSE 'eligible' END AS eligibility FROM customer) WHERE eligibility IN ('eligible', 'uncertain') GROUP BY 1")
def d17_eligible_filter(spark, sf_dir):
    spec = spark.createDataFrame([("balance", "scientific"), ("checked", "scientific")], "criterion string, section string")
    per = _t(spark, sf_dir, "customer").withColumn("dataset_id", F.col("c_custkey"))
    rows = decisions.evidence_rows(per, {"balance": F.col("c_acctbal") >= 0, "checked": F.when(F.col("c_custkey") % 4 != 0, True)})
    out = decisions.eligibility(spec, rows).filter(F.col("eligibility").isin("eligible", "uncertain"))
    return out.groupBy("eligibility").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS n_rows, count(*) FILTER (e.user_id IS NOT NULL) AS n_linked, count(*) FILTER (e.user_id IS NOT NULL) > 0 AS ready FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) e ON user_id = c_custkey GROUP BY c_nationkey")
def d18_readiness(spark, sf_dir):
    users = _t(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("linked", F.lit(True))
    out = relational.one_match(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), users, ["c_custkey"], check=False)
    return out.groupBy("c_nationkey").agg(F.count("*").alias("n_rows"), F.count("linked").alias("n_linked")).withColumn("ready", F.col("n_linked") > 0)


@query("SELECT p_brand, CASE WHEN count(*) FILTER (p_size > 40) > 0 AND count(*) FILTER (s) > 0 THEN true END AS verified FROM part LEFT JOIN (SELECT DISTINCT l_partkey, true AS s FROM lineitem) l ON l_partkey = p_partkey GROUP BY p_brand")
def d22_feature_verification(spark, sf_dir):
    """True if annotated and measured, else unknown."""
    sold = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("s", F.lit(True))
    both = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").join(sold, "p_partkey", "left")
    return both.groupBy("p_brand").agg(F.when((F.count_if(F.col("p_size") > 40) > 0) & (F.count("s") > 0), True).alias("verified"))


@query("SELECT query, CASE WHEN query IN ('Brand#11', 'Brand#12') THEN 'verified' WHEN n = 1 THEN 'verified' WHEN n > 1 THEN 'verified_multiple' ELSE 'needs_review' END AS status FROM (SELECT p_brand AS query, count(DISTINCT p_type) FILTER (p_size = m) AS n FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY p_brand)")
def d14_d24_verified_and_reviewed(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    resolved = decisions.resolve(part.select(F.col("p_brand").alias("query"), F.lit(1).alias("stage"), F.col("p_size").alias("strength"), F.col("p_type").alias("feature")))
    verified = decisions.verify_features(resolved, part.select(F.col("p_type").alias("feature")))
    reviews = spark.createDataFrame([("Brand#11", "x"), ("Brand#12", "y")], "query string, feature string")
    return decisions.confirmed(verified, reviews).select("query", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IS DISTINCT FROM '1-URGENT' THEN 'o_orderpriority differs' END AS reason FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'")
def v5_foreign_rows(spark, sf_dir):
    out = contracts.foreign_rows(_t(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT", ["o_orderkey"])
    return out.select("o_orderkey", F.col("reasons")[0].alias("reason"))


@query("SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_name, '(?i)^Customer#[0-9]*[02468]$')")
def v8_formats(spark, sf_dir):
    return _t(spark, sf_dir, "customer").filter(~F.regexp_like("c_name", F.lit("(?i)^Customer#[0-9]*[02468]$"))).select("c_custkey")


@query("SELECT c_nationkey AS k, 60 AS n_declared, count(*) AS n_actual FROM customer GROUP BY 1 HAVING count(*) <> 60")
def v15_declared_counts(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return contracts.declared_counts(c.distinct().withColumn("n_declared", F.lit(60)), c, "k")


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def v17_link_coverage(spark, sf_dir):
    users = _t(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    linked = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(users, "c_custkey", "left_semi")
    return contracts.link_coverage(linked, _t(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey")


@query("SELECT study, max(release) AS release, count(*) FILTER (release = m) = 1 AS single FROM (SELECT p_brand AS study, p_size AS release, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY study")
def s16_s17_newest(spark, sf_dir):
    from ..sources.repository import newest_manifest

    entries = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("study"), F.concat(F.lit("T-DR"), "p_size", F.lit("_Tab.zip")).alias("name"))
    return newest_manifest(entries, r"^T-DR(\d+)_Tab\.zip$").groupBy("study").agg(F.max("release").alias("release"), F.bool_and("unique").alias("single"))


@query("SELECT o_custkey, o_orderpriority AS kind, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY ALL")
def s20_latest_artifact(spark, sf_dir):
    from ..sources.repository import latest_artifacts

    log = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return latest_artifacts(log, ["o_custkey", "kind"], "at").select("o_custkey", "kind", "status")


@query("SELECT name, alias AS symbol FROM (SELECT upper(p_name) AS name, p_brand AS alias, row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def s12_first_wins(spark, sf_dir):
    from ..sources.repository import gene_index

    genes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("alias_symbol"), F.lit(None).cast("string").alias("prev_symbol"))
    names = _t(spark, sf_dir, "part").select(F.upper(F.trim("p_name")).alias("name")).distinct()
    return gene_index(genes).join(names, "name", "left_semi")


@query("SELECT c_nationkey, array_to_string(list_intersect(['geo', 'immport'], list(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'geo' ELSE 'other' END)), ';') AS required FROM customer GROUP BY c_nationkey")
def p6_required_groups(spark, sf_dir):
    have = F.collect_set(F.when(F.col("c_custkey") % 2 == 0, "geo").otherwise("other"))
    return _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(have.alias("g")).select("c_nationkey", F.array_join(F.array_intersect(F.array(F.lit("geo"), F.lit("immport")), "g"), ";").alias("required"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN [] WHEN o_custkey % 3 = 1 THEN [o_orderpriority] ELSE [o_orderpriority, 'none such'] END AS items FROM orders),
e AS (SELECT o_orderkey, unnest(CASE WHEN len(items) = 0 THEN [''] ELSE items END) AS item FROM d), k AS (SELECT DISTINCT o_orderpriority AS item FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT o_orderkey, e.item, CASE WHEN k.item IS NOT NULL THEN 'resolved' WHEN e.item = '' THEN 'not_applicable' ELSE 'unresolved' END AS status FROM e LEFT JOIN k USING (item)""")
def j11_explode_default(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    one, third = F.col("o_orderpriority"), F.col("o_custkey") % 3
    items = F.when(third == 0, F.array().cast("array<string>")).when(third == 1, F.array(one)).otherwise(F.array(one, F.lit("none such")))
    known = orders.select(one.alias("item")).filter("item <> '5-LOW'").distinct().withColumn("status", F.lit("resolved"))
    absent = {"status": F.when(F.col("item") == "", "not_applicable").otherwise("unresolved")}
    return relational.exploded_with_default(orders.select("o_orderkey", items.alias("items")), "items", "item", known, absent).select("o_orderkey", "item", "status")


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def j6_strict_chain(spark, sf_dir):
    """Rows to what they refer to, and on; a missing reference is an error."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    chain = relational.linked(relational.linked(lines, orders, ["l_orderkey"]), customers, ["o_custkey"])
    return chain.select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey")


@query("SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS \"A\", avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS \"R\" FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT CASE WHEN l_quantity IS NOT NULL THEN l_returnflag END) = 2")
def f13_complete_means(spark, sf_dir):
    return relational.complete_means(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", ["A", "R"])
