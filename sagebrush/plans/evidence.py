"""Queries of decisions: scoring, independence, rollup, eligibility, fusion,
resolution, cohort units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import contracts, decisions
from . import sql

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


RULE = decisions.Rule(alpha=0.05, direction="up", min_effect=0.02, min_independent_groups=2)
_R = f"({sql.corr('l_quantity', 'l_extendedprice')})"
_UNITS = f"""u AS (SELECT l_suppkey, count(*) AS n, {_R} AS effect, {sql.p_value(_R, "count(*)")} AS p FROM lineitem GROUP BY l_suppkey),
s AS (SELECT u.*, s_nationkey AS g, CASE WHEN effect IS NULL OR p IS NULL THEN 'inconclusive' WHEN p <= 0.05 AND effect > 0 AND abs(effect) >= 0.02 THEN 'supports' WHEN p <= 0.05 AND NOT effect > 0 THEN 'refutes' ELSE 'inconclusive' END AS verdict
  FROM u JOIN supplier ON s_suppkey = l_suppkey)"""


def scored_units(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    units = stats.pearson(lines, ["l_suppkey"], "x", "y").withColumn("fdr", F.lit(None).cast("double"))
    nation = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("group_key"))
    return decisions.score(units.join(nation, "l_suppkey"), RULE)


@query(f"""WITH {_UNITS} SELECT l_suppkey, n, round(effect, 6) AS effect, round(p, 6) AS p_value, verdict,
  round(CASE WHEN p IS NULL THEN 0.30 WHEN verdict = 'inconclusive' THEN least(0.40, greatest(0.05, 1 - p)) ELSE 0.50 + 0.45 * greatest(0, least(1, 1 - p / 0.05)) END, 3) AS confidence,
  CASE WHEN verdict = 'supports' THEN NULL WHEN verdict = 'refutes' THEN 'opposite direction' WHEN p IS NULL OR effect IS NULL THEN 'missing estimate' WHEN p > 0.05 THEN 'above alpha' ELSE 'below the floor' END AS obstacle FROM s""")
def d1_d6_d20_scores(spark, sf_dir):
    out = decisions.what_would_change(scored_units(spark, sf_dir), RULE).withColumn("confidence", decisions.confidence(RULE))
    return out.select("l_suppkey", "n", F.round("effect", 6).alias("effect"), F.round("p_value", 6).alias("p_value"), "verdict", "confidence", "obstacle")


@query(f"""WITH {_UNITS}, k AS (SELECT l_suppkey % 10 AS hypothesis, * FROM s),
c AS (SELECT hypothesis, count(*) AS n_rows, count(*) FILTER (verdict = 'supports') AS n_supporting, count(*) FILTER (verdict = 'refutes') AS n_refuting, count(DISTINCT CASE WHEN verdict = 'supports' THEN g END) AS n_support_groups, count(DISTINCT g) AS n_groups, bool_or(hypothesis = 3) AS gap FROM k GROUP BY 1)
SELECT hypothesis, n_rows, n_supporting, n_refuting, n_support_groups, n_groups, CASE WHEN gap THEN 'inconclusive' WHEN n_refuting > 0 AND n_supporting = 0 THEN 'refutes' WHEN n_supporting > 0 AND n_refuting = 0 AND n_support_groups >= 2 THEN 'supports' ELSE 'inconclusive' END AS verdict FROM c""")
def d4_d7_rollup(spark, sf_dir):
    rows = scored_units(spark, sf_dir).withColumn("hypothesis", F.col("l_suppkey") % 10).withColumn("gap", F.col("l_suppkey") % 10 == 3)
    return decisions.rollup(rows, ["hypothesis"], RULE, uncovered="gap")


_RECORDS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'S' || c_custkey % 3 END AS superseries, CASE WHEN c_custkey % 5 = 0 THEN 'B' || c_custkey % 4 END AS bioproject, CASE WHEN c_custkey % 4 = 0 THEN '' END AS study, CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END AS program, CASE WHEN c_custkey % 3 = 0 THEN 'lab' || c_nationkey END AS lab, CASE WHEN c_custkey % 11 = 0 THEN 'GPL1' END AS platform, 'GSE' || c_custkey AS gse_id, CASE WHEN c_custkey % 2 = 0 THEN 'Trial 1' END AS cohort, CASE WHEN c_custkey % 13 = 0 THEN 'given' END AS independence_group FROM customer"
_KEY = "coalesce('superseries:' || nullif(superseries, ''), 'bioproject:' || nullif(bioproject, ''), 'study:' || nullif(study, ''), 'program:' || nullif(program, ''), CASE WHEN nullif(lab, '') IS NOT NULL OR nullif(platform, '') IS NOT NULL THEN 'lab:' || coalesce(nullif(lab, ''), '?') || '|platform:' || coalesce(nullif(platform, ''), '?') END, 'accession:' || gse_id)"


@query(f"WITH r AS ({_RECORDS}), k AS (SELECT *, {_KEY} AS shared FROM r) SELECT id, shared, coalesce(nullif(independence_group, ''), CASE WHEN shared NOT LIKE 'accession:%' THEN shared END, CASE WHEN cohort IS NOT NULL THEN gse_id || '|cohort:' || cohort END, 'accession:' || gse_id) AS unit FROM k")
def d2_d3_independence(spark, sf_dir):
    c = F.col("c_custkey")
    r = _t(spark, sf_dir, "customer").select(
        c.alias("id"), F.when(c % 7 == 0, F.concat(F.lit("S"), c % 3)).alias("superseries"), F.when(c % 5 == 0, F.concat(F.lit("B"), c % 4)).alias("bioproject"), F.when(c % 4 == 0, "").alias("study"),
        F.when(c % 6 == 0, F.col("c_mktsegment")).alias("program"), F.when(c % 3 == 0, F.concat(F.lit("lab"), "c_nationkey")).alias("lab"), F.when(c % 11 == 0, "GPL1").alias("platform"),
        F.concat(F.lit("GSE"), c).alias("gse_id"), F.when(c % 2 == 0, "Trial 1").alias("cohort"), F.when(c % 13 == 0, "given").alias("independence_group"),
    )
    return r.select("id", decisions.independence_key("gse_id").alias("shared"), decisions.unit_key().alias("unit"))


@query("SELECT p_brand, n_results, n_estimands, n_types, n_estimands = 1 AS directions, n_estimands = 1 AND n_types = 1 AS pool FROM (SELECT p_brand, count(*) AS n_results, count(DISTINCT p_size % 2) AS n_estimands, count(DISTINCT CASE WHEN p_size < 25 THEN 'logFC' ELSE 'beta' END) AS n_types FROM part WHERE p_size % 5 <> 0 GROUP BY p_brand)")
def d9_comparable(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 2).alias("estimand"), F.when(F.col("p_size") < 25, "logFC").otherwise("beta").alias("effect_type"), F.when(F.col("p_size") % 5 == 0, "control").otherwise("primary").alias("role"))
    return decisions.comparable(part, ["p_brand"])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice - 1500 WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN p_retailprice - 1500 ELSE -(p_retailprice - 1500) END END AS oriented FROM part")
def d8_orient(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "beta").otherwise("logFC")
    test = F.when(size % 3 == 1, F.when(size % 2 == 0, "high").otherwise("low"))
    return _t(spark, sf_dir, "part").select("p_partkey", decisions.orient(F.col("p_retailprice") - 1500, kind, test, F.lit("high")).alias("oriented"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'correlation out of range;' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN 'p out of range;' ELSE '' END || CASE WHEN p_size % 11 = 0 THEN 'unknown role;' ELSE '' END AS faults FROM part WHERE p_size > 40 OR p_size % 7 = 0 OR p_size % 11 = 0")
def v9_d10_result_faults(spark, sf_dir):
    size = F.col("p_size")
    rows = _t(spark, sf_dir, "part").select(
        "p_partkey", (size / 40.0).cast("double").alias("effect"), F.lit("pearson_r").alias("effect_type"), F.when(size % 7 == 0, 2.0).otherwise(0.5).alias("p_value"), F.lit(None).cast("double").alias("fdr"), F.lit(12).alias("n"),
        F.lit(None).cast("string").alias("contrast"), F.when(size % 11 == 0, "odd").otherwise("primary").alias("role"),
    )
    return contracts.result_faults(rows).select("p_partkey", F.concat(F.array_join("reasons", ";"), F.lit(";")).alias("faults"))


_CRITERIA = (("large", "scientific", "c_acctbal > 0", "c_acctbal IS NULL"), ("segment", "scientific", "c_mktsegment <> 'MACHINERY'", "c_custkey % 9 = 0"), ("active", "operational", "c_custkey % 3 <> 0", "c_custkey % 8 = 0"))


@query("""WITH e AS (SELECT c_custkey AS dataset_id, CASE WHEN c_acctbal IS NULL THEN NULL ELSE c_acctbal > 0 END AS a, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment <> 'MACHINERY' END AS b, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 3 <> 0 END AS c FROM customer),
k AS (SELECT *, CASE WHEN a IS FALSE OR b IS FALSE THEN 'excluded' WHEN a IS NULL OR b IS NULL THEN 'uncertain' ELSE 'eligible' END AS eligibility FROM e)
SELECT dataset_id, eligibility, CASE WHEN eligibility = 'excluded' THEN 'not_applicable' WHEN eligibility = 'uncertain' THEN 'needs_scientific_resolution' WHEN c IS FALSE THEN 'blocked' WHEN c IS NULL THEN 'needs_data_check' ELSE 'ready' END AS execution,
  array_to_string(list_filter([CASE WHEN c IS NULL THEN 'active' END, CASE WHEN a IS NULL THEN 'large' END, CASE WHEN b IS NULL THEN 'segment' END], lambda x: x IS NOT NULL), ';') AS unresolved FROM k""")
def d11_d23_eligibility(spark, sf_dir):
    spec = spark.createDataFrame([(c, s) for c, s, _, _ in _CRITERIA], "criterion string, section string")
    per = _t(spark, sf_dir, "customer").withColumn("dataset_id", F.col("c_custkey"))
    rows = decisions.evidence_rows(per, {c: F.when(~F.expr(unknown), F.expr(test)) for c, _, test, unknown in _CRITERIA})
    out = decisions.eligibility(spec, rows)
    return out.select("dataset_id", "eligibility", "execution", F.array_join("unresolved", ";").alias("unresolved"))


@query("""WITH e AS (SELECT c_custkey AS dataset_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal > 4000 END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment <> 'MACHINERY' END AS b FROM customer),
k AS (SELECT *, (a IS TRUE OR b IS TRUE) AND (a IS FALSE OR b IS FALSE) AS conflict FROM e)
SELECT dataset_id, CASE WHEN conflict THEN NULL WHEN a IS FALSE OR b IS FALSE THEN false WHEN a IS TRUE OR b IS TRUE THEN true END AS value, conflict,
  CASE WHEN conflict THEN 'low' WHEN a IS NOT NULL THEN 'high' WHEN b IS NOT NULL THEN 'medium' ELSE 'high' END AS confidence, 'geo;immport' AS sources FROM k""")
def d12_a17_a18_fusion(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    one = c.select(F.col("c_custkey").alias("dataset_id"), F.lit(0).alias("source_ord"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") > 4000).alias("value"), F.lit("High").alias("confidence"), F.lit("geo").alias("source"))
    two = c.select(F.col("c_custkey").alias("dataset_id"), F.lit(1).alias("source_ord"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment") != "MACHINERY").alias("value"), F.lit("medium").alias("confidence"), F.lit("immport").alias("source"))
    out = decisions.fuse(one.unionByName(two).withColumn("criterion", F.lit("x")))
    return out.select("dataset_id", "value", "conflict", "confidence", F.array_join("sources", ";").alias("sources"))


@query("""WITH c AS (
  SELECT DISTINCT p_brand AS query, 1 AS stage, 0.0 AS strength, p_type AS feature FROM part WHERE p_size = 50 AND p_brand LIKE '%1'
  UNION SELECT p_brand, 2, p_size, p_type FROM part WHERE p_brand NOT LIKE '%2'
  UNION SELECT p_brand, 3, floor(p_retailprice / 40), p_type FROM part WHERE p_brand NOT LIKE '%3'),
top AS (SELECT query, stage, feature FROM c WHERE strength = (SELECT max(strength) FROM c AS d WHERE d.query = c.query AND d.stage = c.stage)),
n AS (SELECT query, count(*) FILTER (stage = 1) AS n1, count(*) FILTER (stage = 2) AS n2, count(*) FILTER (stage = 3) AS n3 FROM top GROUP BY query),
pick AS (SELECT query, CASE WHEN n1 > 0 THEN 1 WHEN n2 = 1 THEN 2 WHEN n3 = 1 THEN 3 WHEN n2 = 0 THEN 3 WHEN n3 = 0 THEN 2 WHEN n3 < n2 THEN 3 ELSE 2 END AS stage FROM n)
SELECT query, stage, string_agg(feature, ';' ORDER BY feature) AS features, CASE WHEN count(*) = 1 THEN 'candidate' ELSE 'tied' END AS status
FROM top JOIN pick USING (query, stage) GROUP BY query, stage""")
def d14_resolution(spark, sf_dir):
    """An exact stage that decides even tied, and two looser ones of which ties fall through."""
    part, brand = _t(spark, sf_dir, "part"), F.col("p_brand")
    stage = lambda k, kept, strength: part.filter(kept).select(brand.alias("query"), F.lit(k).alias("stage"), strength.cast("double").alias("strength"), F.col("p_type").alias("feature"))
    rows = stage(1, (F.col("p_size") == 50) & brand.endswith("1"), F.lit(0)).unionByName(stage(2, ~brand.endswith("2"), F.col("p_size")))
    rows = rows.unionByName(stage(3, ~brand.endswith("3"), F.floor(F.col("p_retailprice") / 40)))
    return decisions.resolve(rows).select("query", "stage", F.array_join("features", ";").alias("features"), "status")


@query("""WITH r AS (SELECT p_partkey, p_size AS s, CASE WHEN p_size % 2 = 0 THEN 'partial_r' ELSE 'logFC' END AS kind FROM part),
f AS (SELECT p_partkey, list_filter([
  CASE WHEN s % 5 = 0 THEN 'neither p nor fdr' END, CASE WHEN s % 6 = 0 THEN 'n below 1' END, CASE WHEN kind = 'logFC' AND s % 3 = 0 THEN 'contrast missing' END,
  CASE WHEN kind <> 'logFC' AND s % 4 = 0 THEN 'contrast not allowed' END, CASE WHEN kind = 'logFC' AND s % 3 <> 0 AND s % 7 = 0 THEN 'contrast without reference_group' END,
  CASE WHEN s % 9 = 0 THEN 'analysis_unit_id blank' END, CASE WHEN s % 11 = 0 THEN 'unknown analysis type' END,
  CASE WHEN s % 13 = 0 THEN 'dichotomised outside a group contrast' END, CASE WHEN kind = 'partial_r' AND s % 8 = 0 THEN 'partial correlation without covariates' END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT p_partkey, array_to_string(l, ';') AS faults FROM f WHERE len(l) > 0""")
def v9_result_validity(spark, sf_dir):
    s, text = F.col("p_size"), lambda v: F.lit(v).cast("string")
    group = s % 2 != 0
    full = F.create_map(F.lit("test_group"), F.lit("a"), F.lit("reference_group"), F.lit("b"), F.lit("test_is_higher_outcome"), F.lit("true"))
    part = F.create_map(F.lit("test_group"), F.lit("a"), F.lit("test_is_higher_outcome"), F.lit("false"))
    rows = _t(spark, sf_dir, "part").select(
        "p_partkey",
        F.lit(0.5).alias("effect"),
        F.when(group, "logFC").otherwise("partial_r").alias("effect_type"),
        F.when(s % 5 != 0, 0.2).alias("p_value"),
        F.lit(None).cast("double").alias("fdr"),
        F.when(s % 6 != 0, 12).alias("n"),
        F.when(group & (s % 3 != 0), F.when(s % 7 == 0, part).otherwise(full)).when(~group & (s % 4 == 0), full).alias("contrast"),
        F.lit("secondary").alias("role"),
        F.when(s % 9 == 0, " ").otherwise("u1").alias("analysis_unit_id"),
        F.when(s % 11 == 0, "guess").otherwise("correlation").alias("analysis_type"),
        (s % 13 == 0).alias("dichotomised"),
        F.when(s % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(text("age"))).alias("covariates"),
    )
    return contracts.result_faults(rows).select("p_partkey", F.array_join("reasons", ";").alias("faults"))


@query("""WITH s AS (SELECT user_id % 10 AS series, CASE WHEN user_id % 3 <> 0 THEN 'Batch ' || (user_id % 4) END AS cohort, user_id AS subject, event_type AS timepoint, event_id AS gsm FROM events),
ok AS (SELECT series, cohort FROM s WHERE cohort IS NOT NULL GROUP BY ALL HAVING count(DISTINCT subject) >= 3), u AS (SELECT series, count(*) AS k FROM ok GROUP BY 1),
p AS (SELECT s.*, coalesce(k, 0) >= 2 AS split, ok.cohort IS NOT NULL AS usable FROM s LEFT JOIN u USING (series) LEFT JOIN ok ON ok.series = s.series AND ok.cohort = s.cohort),
o AS (SELECT series, count(*) AS n_left_out FROM p WHERE split AND NOT usable GROUP BY 1)
SELECT series, CASE WHEN split THEN cohort END AS unit_cohort, count(DISTINCT subject) AS n_subjects, count(DISTINCT timepoint) AS n_timepoints, count(DISTINCT gsm) AS n_samples, coalesce(any_value(n_left_out), 0) AS n_left_out
FROM p LEFT JOIN o USING (series) WHERE NOT split OR usable GROUP BY series, unit_cohort""")
def d15_a11_cohort_units(spark, sf_dir):
    u = F.col("user_id")
    s = _t(spark, sf_dir, "events").select((u % 10).alias("series"), F.when(u % 3 != 0, F.concat(F.lit("Batch "), u % 4)).alias("cohort"), u.alias("subject"), F.col("event_type").alias("timepoint"), F.col("event_id").alias("gsm"))
    out = decisions.cohort_units(s, 3)
    return out.select("series", "unit_cohort", *[F.size(c).cast("long").alias(a) for c, a in (("subjects", "n_subjects"), ("timepoints", "n_timepoints"), ("gsms", "n_samples"))], "n_left_out")


@query("SELECT lang FROM (SELECT DISTINCT lang FROM documents) WHERE upper(lang) NOT IN ('EN', 'DE')")
def d5_coverage_gaps(spark, sf_dir):
    need = _t(spark, sf_dir, "documents").select("lang").distinct()
    return decisions.coverage_gaps(need, spark.createDataFrame([("EN",), ("De",)], "lang string"), "lang")


@query("SELECT c_nationkey AS hypothesis, count(*) FILTER (c_custkey % 40 = 0 AND c_mktsegment <> '') AS n_primary FROM customer GROUP BY 1 HAVING n_primary <> 1")
def d19_one_primary(spark, sf_dir):
    specs = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("hypothesis"), (F.col("c_custkey") % 40 == 0).alias("is_primary"), F.col("c_mktsegment").alias("basis"))
    return decisions.primary_faults(specs)
