"""Queries of documents: nested synthesis and fusion documents, schema walks over
VARIANT, specifications with several rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contracts, criteria, decisions, documents
from ..sources import terms
from . import statistics as st

QUERIES: dict = {}
SQL: dict = {}


def query(text: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return keep


_GROUPED = f"""WITH {st._UNITS}, x AS (SELECT *, substr(cohort, 1, 1) AS g FROM scored),
y AS (SELECT *, (SELECT string_agg(b.cohort, ', ' ORDER BY b.cohort) FROM x b WHERE b.spec_id = a.spec_id AND b.g = a.g AND b.cohort <> a.cohort) AS sib FROM x a),
t AS (SELECT spec_id, count(*) FILTER (verdict = 'supports') AS s, count(*) FILTER (verdict = 'refutes') AS f, count(DISTINCT CASE WHEN verdict = 'supports' THEN g END) AS gs, count(DISTINCT g) AS ng, count(*) AS nu FROM x GROUP BY spec_id)"""


def _scored(spark, sf_dir):
    units = st._units(spark, sf_dir).withColumn("fdr", F.lit(None).cast("double"))
    return decisions.score(units, st.RULE).withColumn("group_key", F.substring("cohort", 1, 1))


@query(f"""{_GROUPED}
SELECT spec_id, CASE WHEN f > 0 AND s = 0 THEN 'contradictory' WHEN s > 0 AND f = 0 AND gs >= 2 THEN 'supportive' ELSE 'inconclusive' END AS overall_verdict, ng AS n_groups, nu AS n_units, cohort AS unit_id,
  CASE verdict WHEN 'supports' THEN 'supportive' WHEN 'refutes' THEN 'contradictory' ELSE 'inconclusive' END AS verdict,
  round(CASE WHEN p_value IS NULL THEN 0.30 WHEN verdict = 'inconclusive' THEN least(0.40, greatest(0.05, 1 - p_value)) ELSE 0.50 + 0.45 * greatest(0, least(1, 1 - p_value / 0.05)) END, 3) AS confidence,
  CASE WHEN verdict = 'supports' THEN 'significant at 0.05 in the expected direction' WHEN verdict = 'refutes' THEN 'significant at 0.05 against the expected direction'
    WHEN p_value IS NULL OR effect IS NULL THEN 'no usable estimate' WHEN p_value > 0.05 THEN 'not significant at 0.05' ELSE 'effect below 0' END AS rationale,
  CASE WHEN sib IS NULL THEN NULL ELSE 'Not independent of ' || sib || ': all belong to ' || g || ' and count once.' END AS caveat
FROM y JOIN t USING (spec_id)""")
def d7_synthesis(spark, sf_dir):
    """Regions as units, those of one first letter as one group; the documents are
    read back by unit."""
    scored = _scored(spark, sf_dir).withColumn("analysis_unit_id", F.col("cohort")).withColumn("gse_id", F.lit("GSE1")).withColumn("platform", F.lit(None).cast("string"))
    doc = documents.synthesis(scored, decisions.rollup(scored, ["spec_id"], st.RULE), ["spec_id"], st.RULE, strict=False)
    read = doc.select("spec_id", "overall_verdict", F.col("n_independent_groups").cast("long").alias("n_groups"), F.size("per_dataset").cast("long").alias("n_units"), F.explode("per_dataset").alias("u"))
    return read.select("spec_id", "overall_verdict", "n_groups", "n_units", F.col("u.analysis_unit_id").alias("unit_id"), "u.verdict", "u.confidence", "u.rationale", F.try_element_at("u.caveats", F.lit(2)).alias("caveat"))


@query(f"""WITH {st._UNITS}, rules(spec_id, role, alpha, direction, min_effect, least) AS (VALUES ('raw', 'primary', 0.05, 'up', 0.0, 2), ('delta', 'sensitivity', 0.2, 'either', 0.01, 1), ('adjusted', 'sensitivity', 0.4, 'down', 0.0, 1)),
v AS (SELECT u.*, role, least, CASE WHEN effect IS NULL OR p_value IS NULL OR p_value > alpha THEN 'inconclusive' WHEN direction <> 'either' AND direction <> CASE WHEN effect > 0 THEN 'up' ELSE 'down' END THEN 'refutes' WHEN abs(effect) >= min_effect THEN 'supports' ELSE 'inconclusive' END AS verdict FROM units u JOIN rules USING (spec_id)),
c AS (SELECT spec_id, role, count(*) FILTER (verdict = 'supports') AS n_supporting, count(*) FILTER (verdict = 'refutes') AS n_refuting, count(DISTINCT CASE WHEN verdict = 'supports' THEN cohort END) AS n_support_groups, max(least) AS least FROM v GROUP BY ALL),
o AS (SELECT *, CASE WHEN n_refuting > 0 AND n_supporting = 0 THEN 'refutes' WHEN n_supporting > 0 AND n_refuting = 0 AND n_support_groups >= least THEN 'supports' ELSE 'inconclusive' END AS verdict FROM c)
SELECT spec_id, role, n_supporting, n_refuting, n_support_groups, verdict, (SELECT max(verdict) FROM o WHERE role = 'primary') AS primary_verdict, (SELECT count(DISTINCT verdict) FROM o) AS n_verdicts, (SELECT count(DISTINCT verdict) FROM o) > 1 AS sensitive FROM o""")
def d19_sensitivity(spark, sf_dir):
    """One scan of the units, each specification under its own rule."""
    rules = spark.createDataFrame([("raw", "primary", 0.05, "up", 0.0, 2), ("delta", "sensitivity", 0.2, "either", 0.01, 1), ("adjusted", "sensitivity", 0.4, "down", 0.0, 1)], "spec_id string, role string, alpha double, direction string, min_effect double, min_groups int")
    units = st._units(spark, sf_dir).withColumn("fdr", F.lit(None).cast("double")).withColumn("group_key", F.col("cohort"))
    return documents.sensitivity(documents.score_by(units, rules, ["spec_id"]), [])


@query("""WITH e AS (SELECT 'S' || s_suppkey AS dataset_id, s_nationkey AS g, s_acctbal > 0 AS solvent, CASE WHEN s_acctbal < 8000 THEN s_acctbal < 4000 END AS small, 0 AS o FROM supplier
  UNION ALL SELECT 'C' || c_custkey, c_nationkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal > -1000 END, NULL, 1 FROM customer),
l AS (SELECT g, criterion, v, o FROM (SELECT g, 'solvent' AS criterion, solvent AS v, o FROM e UNION ALL SELECT g, 'small', small, o FROM e)),
f AS (SELECT g, criterion, coalesce(bool_or(v), false) AS y, coalesce(bool_or(NOT v), false) AS n, max(CASE WHEN v IS NOT NULL THEN 2 - o END) AS d, max(2 - o) AS a FROM l GROUP BY ALL),
c AS (SELECT g, string_agg(criterion, ',' ORDER BY criterion) FILTER (y AND n) AS conflicting, count(*) AS n_criteria, max(CASE WHEN criterion = 'solvent' THEN CASE WHEN y AND n THEN 'low' WHEN coalesce(d, a) = 2 THEN 'high' ELSE 'medium' END END) AS confidence,
  bool_or(CASE WHEN criterion = 'small' AND NOT (y AND n) THEN CASE WHEN n THEN false WHEN y THEN true END END) AS small FROM f GROUP BY g)
SELECT 'nation-' || g AS dataset_id, 'fused' AS repository, (SELECT count(*) FROM e WHERE e.g = c.g) AS n_sources, n_criteria, coalesce(conflicting, '') AS conflicting, confidence, small FROM c WHERE g % 5 <> 0""")
def d13_fused_documents(spark, sf_dir):
    """Suppliers and customers of a nation as linked datasets; the links of every
    fifth nation are not verified."""
    s = st._t(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("dataset_id"), F.col("s_nationkey").alias("g"), (F.col("s_acctbal") > 0).alias("solvent"), F.when(F.col("s_acctbal") < 8000, F.col("s_acctbal") < 4000).alias("small"), F.lit(0).alias("source_ord"))
    c = st._t(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("dataset_id"), F.col("c_nationkey").alias("g"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") > -1000).alias("solvent"), F.lit(None).cast("boolean").alias("small"), F.lit(1).alias("source_ord"))
    both = s.unionByName(c).withColumn("repository", F.when(F.col("source_ord") == 0, "a").otherwise("b"))
    facts = F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(k).alias("value")) for k in ("solvent", "small")])).alias("f")
    evidence = both.select("dataset_id", "repository", "source_ord", facts).select("dataset_id", "repository", "f.criterion", "source_ord", "f.value", F.when(F.col("source_ord") == 0, "high").otherwise("medium").alias("confidence"), F.col("repository").alias("source"))
    groups = both.select(F.concat(F.lit("nation-"), "g").alias("group_id"), "dataset_id", (F.col("g") % 5 != 0).alias("verified"))
    doc = documents.fused_documents(evidence, groups)
    return doc.select("dataset_id", "repository", "n_sources", "n_criteria", F.array_join("conflicting_criteria", ",").alias("conflicting"), F.col("criteria")["solvent"]["confidence"].alias("confidence"), F.col("criteria")["small"]["value"].alias("small"))


_CUSTOMERS = documents.Fields(
    required={
        "nation": documents.Text(pattern="[A-Z ]+"),
        "customers": documents.List(documents.Fields(required={"key": documents.Number(0, whole=True), "segment": documents.Text(among=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")), "balance": documents.Number(-500.0, 9000.0)}, closed=True)),
    }
)


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer JOIN nation ON n_nationkey = c_nationkey),
f AS (SELECT n_name AS nation, 'customers[' || i || '].segment: not one of AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD' AS fault FROM c WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')
  UNION ALL SELECT n_name, 'customers[' || i || '].balance: outside -500.0 to 9000.0' FROM c WHERE c_acctbal < -500 OR c_acctbal > 9000
  UNION ALL SELECT n_name, 'customers[' || i || '].balance: missing' FROM c WHERE c_acctbal IS NULL
  UNION ALL SELECT n_name, 'customers[' || i || '].vip: not allowed' FROM c WHERE c_custkey % 7 = 0
  UNION ALL SELECT DISTINCT n_name, 'nation: does not match [A-Z ]+' FROM c WHERE NOT regexp_full_match(n_name, '[A-Z ]+'))
SELECT nation, fault FROM f""")
def v12_document_walk(spark, sf_dir):
    """Documents of nations with all their customers, written and parsed as JSON;
    faults by path, with the place in the list."""
    c = st._t(spark, sf_dir, "customer").join(F.broadcast(st._t(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    entry = F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 7 == 0, True).alias("vip"))
    docs = c.groupBy("n_name").agg(F.array_sort(F.collect_list(entry)).alias("customers"))
    parsed = docs.select(F.col("n_name").alias("nation"), F.parse_json(F.to_json(F.struct(F.col("n_name").alias("nation"), "customers"))).alias("doc"))
    return documents.document_faults(parsed, _CUSTOMERS).select("nation", F.explode("faults").alias("fault"))


_HAS = lambda *terms: "(" + " OR ".join(f"contains(t, '{x}')" for x in terms) + ")"
_RULES = [
    criteria.yes_or_unknown("licensed", criteria.Says(("license", "copyright")), "A licence is named.", "No licence is named."),
    criteria.CriterionRule(
        "contact",
        (
            criteria.Case(criteria.Both((criteria.Says(("@",)), criteria.Matches(r"\+?[0-9][0-9 -]{6,}"))), True, "high", "Mail and number."),
            criteria.Case(criteria.Says(("@",)), None, "medium", "Mail alone."),
            criteria.Case(None, None, "low", "No contact."),
        ),
    ),
    criteria.CriterionRule("long", (criteria.Case(criteria.Sql("n_chars > 4000"), True, "high", "Long."), criteria.Case(criteria.Sql("n_chars < 200"), False, "medium", "Short."), criteria.Case(None, None, "low", "Between."))),
]


@query(f"""WITH d AS (SELECT doc_id, n_chars, lower(coalesce(text, '')) AS t FROM documents),
e AS (SELECT doc_id, 'licensed' AS criterion, CASE WHEN {_HAS("license", "copyright")} THEN 'true|high|A licence is named.' ELSE '|low|No licence is named.' END AS x FROM d
  UNION ALL SELECT doc_id, 'contact', CASE WHEN {_HAS("@")} AND regexp_matches(t, '\\+?[0-9][0-9 -]{{6,}}') THEN 'true|high|Mail and number.' WHEN {_HAS("@")} THEN '|medium|Mail alone.' ELSE '|low|No contact.' END FROM d
  UNION ALL SELECT doc_id, 'long', CASE WHEN n_chars > 4000 THEN 'true|high|Long.' WHEN n_chars < 200 THEN 'false|medium|Short.' ELSE '|low|Between.' END FROM d)
SELECT doc_id AS dataset_id, criterion, CAST(nullif(split_part(x, '|', 1), '') AS BOOLEAN) AS value, split_part(x, '|', 2) AS confidence, split_part(x, '|', 3) AS text FROM e""")
def x27_d23_criteria(spark, sf_dir):
    """Criteria of documents by terms, patterns and columns, with confidence."""
    return criteria.evidence_items(st._t(spark, sf_dir, "documents"), _RULES, "doc_id", "documents", "text").drop("sources")


@query("""WITH p AS (SELECT o_orderkey % 40 AS study, o_custkey AS subject, CAST(month(o_orderdate) AS INTEGER) AS day FROM orders WHERE o_orderkey % 3 = 0),
o AS (SELECT o_orderkey % 40 AS study, o_custkey AS subject, CAST(day(o_orderdate) AS INTEGER) AS day FROM orders WHERE o_orderkey % 7 = 0),
e AS (SELECT study, subject, max(p) AS p, max(o) AS o, min(a) AS a, max(b) AS b FROM (SELECT study, subject, 1 AS p, 0 AS o, day AS a, NULL AS b FROM p UNION ALL SELECT study, subject, 0, 1, NULL, day FROM o) GROUP BY ALL),
t AS (SELECT study, sum(p) AS np, sum(o) AS no, count(*) FILTER (p = 1 AND o = 1) AS nb, min(a) AS a, max(b) AS b FROM e GROUP BY study)
SELECT study, CASE WHEN nb > 0 THEN true WHEN np > 0 AND no > 0 THEN false END AS linked, CASE WHEN nb > 0 AND nb = no THEN 'high' WHEN nb > 0 THEN 'medium' WHEN np > 0 AND no > 0 THEN 'high' ELSE 'low' END AS linked_confidence,
  CASE WHEN a < b THEN true WHEN a >= b THEN false END AS timed FROM t""")
def d23_table_criteria(spark, sf_dir):
    """Orders as predictor and outcome tables of studies: linkage and timing from
    totals of their participants."""
    orders = st._t(spark, sf_dir, "orders").withColumn("study", F.col("o_orderkey") % 40).withColumnRenamed("o_custkey", "subject")
    predictor = orders.filter("o_orderkey % 3 = 0").withColumn("day", F.month("o_orderdate"))
    outcome = orders.filter("o_orderkey % 7 = 0").withColumn("day", F.dayofmonth("o_orderdate"))
    items = criteria.evidence_items(criteria.table_totals(predictor, outcome, "study", "subject", "day"), criteria.TABLE_RULES, "study", "tables")
    of = lambda c, f: F.max(F.when(F.col("criterion") == c, F.col(f)))
    return items.groupBy(F.col("dataset_id").alias("study")).agg(of("participant_linkage", "value").alias("linked"), of("participant_linkage", "confidence").alias("linked_confidence"), of("timepoints", "value").alias("timed"))


@query("""WITH v AS (SELECT DISTINCT lower(trim(p_brand)) AS term FROM part UNION SELECT DISTINCT lower(trim(w)) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE trim(w) <> ''),
m AS (SELECT p_partkey, max(length(term)) AS length FROM (SELECT p_partkey, lower(p_name || ' ' || p_brand) AS t FROM part), v WHERE contains(t, term) GROUP BY p_partkey)
SELECT p_partkey, length FROM m""")
def x13_term_vocabulary(spark, sf_dir):
    """The longest term of a whole vocabulary (all words and brands) in each text."""
    part = st._t(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("term")).unionByName(part.select(F.col("p_brand").alias("term")))
    vocabulary = words.select(F.lower(F.trim("term")).alias("term")).filter("term <> ''").distinct().withColumn("ord", F.xxhash64("term"))
    texts = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return terms.longest_match(texts, vocabulary, "p_partkey", "text").select("p_partkey", "length")


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: regexp_matches(x, '[0-9]')))), ' ') AS links,
  md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""")
def x24_x26_pages(spark, sf_dir):
    """Link targets with a digit, and pages escaped as text."""
    p = st._t(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(tx.hrefs(F.col("html"), "[0-9]"), " ").alias("links"), F.md5(tx.html_escape(F.col("html"))).alias("escaped"))


@query("""WITH p AS (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'BUILDING' THEN 'causal' WHEN 'FURNITURE' THEN 'guess' ELSE 'association' END AS relationship_type,
  CASE WHEN c_acctbal < 0 THEN 'downward' ELSE 'positive' END AS directionality, CASE WHEN c_nationkey = 3 THEN ' ' ELSE c_name END AS predictor, CASE WHEN c_nationkey <> 4 THEN c_mktsegment END AS outcome FROM customer),
f AS (SELECT c_custkey, concat_ws('; ', 'statement missing', CASE WHEN relationship_type = 'guess' THEN 'unknown relationship_type' END, CASE WHEN directionality = 'downward' THEN 'unknown directionality' END,
  CASE WHEN coalesce(trim(predictor), '') = '' THEN 'predictor blank' END, CASE WHEN coalesce(trim(outcome), '') = '' THEN 'outcome blank' END) AS reasons FROM p)
SELECT c_custkey, reasons FROM f""")
def v10_hypothesis_faults(spark, sf_dir):
    """Customers as parsed hypotheses, none of which has a statement."""
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", None).when(F.col("c_mktsegment") == "BUILDING", "causal").when(F.col("c_mktsegment") == "FURNITURE", "guess").otherwise("association")
    parsed = st._t(spark, sf_dir, "customer").select(
        "c_custkey",
        kind.alias("relationship_type"),
        F.when(F.col("c_acctbal") < 0, "downward").otherwise("positive").alias("directionality"),
        F.when(F.col("c_nationkey") == 3, " ").otherwise(F.col("c_name")).alias("predictor"),
        F.when(F.col("c_nationkey") != 4, F.col("c_mktsegment")).alias("outcome"),
    )
    return contracts.hypothesis_faults(parsed, ["relationship_type", "directionality", "predictor", "outcome", "statement"]).select("c_custkey", F.array_join("reasons", "; ").alias("reasons"))
