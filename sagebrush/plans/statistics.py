"""Queries of the flagship path and of the statistics, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import permutation, stats
from ..operators import decisions, relational
from . import sql

QUERIES: dict = {}
SQL: dict = {}
RULE = decisions.Rule(alpha=0.05, direction="up", min_independent_groups=2)


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user with mean values by event type and the cohort (region)."""
    events = _t(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    wide = relational.pivot_mean(events, ["user_id"], "event_type", ["view", "click", "purchase"], "value")
    customer = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    nation = F.broadcast(_t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows
    region = F.broadcast(_t(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    joined = wide.join(customer, "user_id").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("user_id", F.col("r_name").alias("cohort"), "view", "click", "purchase", (F.col("click") - F.col("view")).alias("delta"))


_SUBJECTS = """
subjects AS (SELECT e.user_id, r.r_name AS cohort, e.v, e.c, e.p, e.c - e.v AS d FROM (
  SELECT user_id, avg(value) FILTER (event_type = 'view') AS v, avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'purchase') AS p
  FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id) e
  JOIN customer cu ON cu.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = cu.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All specifications in one aggregation: raw, delta and adjusted."""
    s = subjects(spark, sf_dir)
    r = s.groupBy("cohort").agg(
        stats.pairs("view", "purchase").alias("n"), stats.pairs("delta", "purchase").alias("n_delta"), stats.correlation("view", "purchase").alias("raw"), stats.correlation("delta", "purchase").alias("delta"),
        F.count_if(F.col("view").isNotNull() & F.col("purchase").isNotNull() & F.col("click").isNotNull()).alias("n_all"),
        stats.correlation("view", "click").alias("xz"), stats.correlation("purchase", "click").alias("yz"),
    )
    rows = F.array(
        F.struct(F.lit("raw").alias("spec_id"), F.col("n").alias("n"), F.col("raw").alias("effect"), stats.p_value(F.col("raw"), F.col("n")).alias("p_value")),
        F.struct(F.lit("delta").alias("spec_id"), F.col("n_delta").alias("n"), F.col("delta").alias("effect"), stats.p_value(F.col("delta"), F.col("n_delta")).alias("p_value")),
        F.struct(F.lit("adjusted").alias("spec_id"), F.col("n_all").alias("n"), F.col("adj").alias("effect"), stats.p_value(F.col("adj"), F.col("n_all"), 1).alias("p_value")),
    )
    r = r.withColumn("adj", stats.partial(F.col("raw"), F.col("xz"), F.col("yz")))
    return r.select("cohort", F.explode(rows).alias("u")).select("u.spec_id", "cohort", "u.n", "u.effect", "u.p_value")


_UNITS = f"""{_SUBJECTS},
r AS (SELECT cohort, count(*) FILTER (v IS NOT NULL AND p IS NOT NULL) AS n, count(*) FILTER (d IS NOT NULL AND p IS NOT NULL) AS nd, count(*) FILTER (v IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL) AS na,
  {sql.corr("v", "p")} AS raw, {sql.corr("d", "p")} AS delta, {sql.corr("v", "c")} AS xz, {sql.corr("p", "c")} AS yz FROM subjects GROUP BY cohort),
a AS (SELECT *, {sql.partial("raw", "xz", "yz")} AS adj FROM r),
units AS (SELECT 'raw' AS spec_id, cohort, n, raw AS effect, {sql.p_value("raw", "n")} AS p_value FROM a
  UNION ALL SELECT 'delta', cohort, nd, delta, {sql.p_value("delta", "nd")} FROM a
  UNION ALL SELECT 'adjusted', cohort, na, adj, {sql.p_value("adj", "na", 1)} FROM a),
scored AS (SELECT *, CASE WHEN effect IS NULL OR p_value IS NULL THEN 'inconclusive' WHEN p_value <= 0.05 AND effect > 0 THEN 'supports' WHEN p_value <= 0.05 THEN 'refutes' ELSE 'inconclusive' END AS verdict FROM units),
roll AS (SELECT spec_id, count(*) FILTER (verdict = 'supports') AS s, count(*) FILTER (verdict = 'refutes') AS f, count(DISTINCT CASE WHEN verdict = 'supports' THEN cohort END) AS g FROM scored GROUP BY spec_id)"""


@query(f"""WITH {_UNITS}
SELECT spec_id, cohort, n, round(effect, 6) AS effect, round(p_value, 6) AS p_value, verdict,
  round(CASE WHEN p_value IS NULL THEN 0.30 WHEN verdict = 'inconclusive' THEN least(0.40, greatest(0.05, 1 - p_value)) ELSE 0.50 + 0.45 * greatest(0, least(1, 1 - p_value / 0.05)) END, 3) AS confidence,
  CASE WHEN f > 0 AND s = 0 THEN 'refutes' WHEN s > 0 AND f = 0 AND g >= 2 THEN 'supports' ELSE 'inconclusive' END AS overall
FROM scored JOIN roll USING (spec_id)""")
def flagship_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir).withColumn("fdr", F.lit(None).cast("double"))
    scored = decisions.score(units, RULE).withColumn("group_key", F.col("cohort"))
    overall = decisions.rollup(scored, ["spec_id"], RULE).select("spec_id", F.col("verdict").alias("overall"))
    out = scored.join(F.broadcast(overall), "spec_id")  # one row per specification
    return out.select("spec_id", "cohort", "n", F.round("effect", 6).alias("effect"), F.round("p_value", 6).alias("p_value"), "verdict", decisions.confidence(RULE).alias("confidence"), "overall")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


@query(f"""SELECT l_suppkey, count(*) AS n, round({sql.corr("l_quantity", "l_extendedprice")}, 6) AS effect,
  round({sql.p_value(f"({sql.corr('l_quantity', 'l_extendedprice')})", "count(*)")}, 6) AS p_value FROM lineitem GROUP BY l_suppkey""")
def m1_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.pearson(_lines(spark, sf_dir), ["l_suppkey"], "x", "y")
    return out.select("l_suppkey", "n", F.round("effect", 6).alias("effect"), F.round("p_value", 6).alias("p_value"))


_RANKED = f"""ranked AS (SELECT l_suppkey AS k, {sql.average_rank("l_suppkey", "l_quantity")} AS x, {sql.average_rank("l_suppkey", "l_extendedprice")} AS y, {sql.average_rank("l_suppkey", "l_discount")} AS z FROM lineitem)"""


@query(f"""WITH {_RANKED}, r AS (SELECT k, count(*) AS n, {sql.corr("x", "y")} AS r FROM ranked GROUP BY k)
SELECT k AS l_suppkey, n, round(r, 6) AS effect, round({sql.p_value("r", "n")}, 6) AS p_value,
  round(CASE WHEN n > 3 AND abs(r) < 1 THEN tanh(atanh(r) - 1.96 / sqrt(n - 3)) END, 6) AS lo, round(CASE WHEN n > 3 AND abs(r) < 1 THEN tanh(atanh(r) + 1.96 / sqrt(n - 3)) END, 6) AS hi FROM r""")
def m2_m6_spearman_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.spearman(_lines(spark, sf_dir), ["l_suppkey"], "x", "y")
    lo, hi = stats.fisher_interval(F.col("effect"), F.col("n"))
    return out.select("l_suppkey", "n", F.round("effect", 6).alias("effect"), F.round("p_value", 6).alias("p_value"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(f"""WITH r AS (SELECT l_suppkey AS k, count(*) AS n, {sql.corr("l_quantity", "l_extendedprice")} AS xy, {sql.corr("l_quantity", "l_discount")} AS xz, {sql.corr("l_extendedprice", "l_discount")} AS yz FROM lineitem GROUP BY k),
a AS (SELECT k, n, {sql.partial("xy", "xz", "yz")} AS r FROM r)
SELECT k AS l_suppkey, n, round(r, 6) AS effect, round({sql.p_value("r", "n", 1)}, 6) AS p_value FROM a""")
def m3_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.adjusted(_lines(spark, sf_dir), ["l_suppkey"], "x", "y", "z")
    return out.select("l_suppkey", "n", F.round("effect", 6).alias("effect"), F.round("p_value", 6).alias("p_value"))


@query(f"""WITH {_RANKED}, r AS (SELECT k, count(*) AS n, {sql.corr("x", "y")} AS xy, {sql.corr("x", "z")} AS xz, {sql.corr("y", "z")} AS yz FROM ranked GROUP BY k),
a AS (SELECT k, n, {sql.partial("xy", "xz", "yz")} AS r FROM r)
SELECT k AS l_suppkey, n, round(r, 6) AS effect, round({sql.p_value("r", "n", 0)}, 6) AS p_residuals, round({sql.p_value("r", "n", 1)}, 6) AS p_partial FROM a""")
def m4_m5_adjusted_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conventions of the degrees of freedom, n - 2 and n - 3."""
    out = stats.adjusted_ranks(_lines(spark, sf_dir), ["l_suppkey"], "x", "y", "z")
    out = out.withColumn("p_two", stats.p_value(F.col("effect"), F.col("n"), 0))
    return out.select("l_suppkey", "n", F.round("effect", 6).alias("effect"), F.round("p_two", 6).alias("p_residuals"), F.round("p_value", 6).alias("p_partial"))


@query(f"""WITH d AS (SELECT lang, n_chars AS v, quality = 1 AS f FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL AND lang IS NOT NULL),
r AS (SELECT *, {sql.average_rank("lang", "v")} AS r, count(*) OVER (PARTITION BY lang, v) AS t FROM d),
g AS (SELECT lang, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0, sum(r) FILTER (f) AS r1, sum(t * t - 1) AS ties, avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m0 FROM r GROUP BY lang),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, CAST(n1 AS DOUBLE) * n0 AS nn, n1 + n0 AS n FROM g)
SELECT lang, n1, n0, u, round((nn - 2 * u) / nullif(nn, 0), 6) AS rank_biserial, round(m1, 6) AS mean1, round(m0, 6) AS mean0,
  round((greatest(u, nn - u) - nn / 2 - 0.5) / nullif(sqrt(nn / 12 * ((n + 1) - ties / (n * (n - 1.0)))), 0), 6) AS z FROM u""")
def m7_m8_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, sf_dir, "labels"), "doc_id").filter("lang IS NOT NULL")
    out = stats.mann_whitney(docs.withColumn("good", F.col("quality") == 1), ["lang"], "n_chars", "good")
    return out.select("lang", "n1", "n0", "u", F.round("rank_biserial", 6).alias("rank_biserial"), F.round("mean1", 6).alias("mean1"), F.round("mean0", 6).alias("mean0"), F.round("z", 6).alias("z"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).select("vec_id", F.col("label").cast("double").alias("label"), F.col("pos").cast("int").alias("pos"), F.col("v").cast("double").alias("v"))


_FEATURES = "f AS (SELECT vec_id, CAST(label AS DOUBLE) AS label, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"
_SWEEP = f"""{_FEATURES}, s AS (SELECT pos, count(*) AS n, {sql.corr("v", "label")} AS r FROM f GROUP BY pos),
p AS (SELECT pos, n, r, {sql.p_value("r", "n")} AS p FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY p, pos) AS rn, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
q AS (SELECT *, least(1, min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bh_adjust(stats.pearson(_features(spark, sf_dir), ["pos"], "v", "label"), "p_value", "pos")


@query(f"WITH {_SWEEP} SELECT pos, n, round(r, 6) AS effect, round(p, 6) AS p_value, round(q, 6) AS q_value FROM q")
def m9_m11_feature_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).select("pos", "n", F.round("effect", 6).alias("effect"), F.round("p_value", 6).alias("p_value"), F.round("q_value", 6).alias("q_value"))


@query(f"""WITH {_SWEEP} SELECT count(*) AS n_features, count(*) FILTER (p < 0.05) AS p05, count(*) FILTER (p < 0.01) AS p01, count(*) FILTER (q < 0.05) AS q05, count(*) FILTER (q < 0.10) AS q10, round(count(*) * 0.05, 6) AS expected FROM q""")
def m11_sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.col("p_value"), F.col("q_value")
    return _sweep(spark, sf_dir).agg(F.count("*").alias("n_features"), F.count_if(p < 0.05).alias("p05"), F.count_if(p < 0.01).alias("p01"), F.count_if(q < 0.05).alias("q05"), F.count_if(q < 0.10).alias("q10"), F.round(F.count("*") * 0.05, 6).alias("expected"))


def _sets(spark: SparkSession) -> DataFrame:
    """Feature sets: ranges of positions."""
    return spark.createDataFrame([(f"set{k}", p) for k in range(4) for p in range(k * 12, k * 12 + 20)], "set_name string, pos int")


_SETS = "sets AS (SELECT 'set' || k AS set_name, CAST(k * 12 + j AS INTEGER) AS pos FROM range(0, 4) AS a(k), range(0, 20) AS b(j))"


@query(f"""WITH {_FEATURES}, {_SETS}, z AS (SELECT vec_id, pos, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z FROM f WINDOW w AS (PARTITION BY pos))
SELECT set_name, vec_id, round(avg(z), 6) AS score, count(*) AS n_members FROM z JOIN sets USING (pos) WHERE z IS NOT NULL GROUP BY ALL""")
def m10_w7_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.composite(stats.z_scores(_features(spark, sf_dir), "pos", "v"), F.broadcast(_sets(spark)), "pos", "vec_id")
    return out.select("set_name", "vec_id", F.round("score", 6).alias("score"), "n_members")


@query(f"""WITH {_SWEEP}, {_SETS} SELECT set_name, count(*) AS n_set, count(*) FILTER (rn - 1 < m * 0.05) AS in_top, round(count(*) * 0.05, 6) AS expected FROM q JOIN sets USING (pos) GROUP BY set_name""")
def m12_w8_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.enrichment(_sweep(spark, sf_dir), F.broadcast(_sets(spark)), "p_value", "pos")
    return out.withColumn("expected", F.round("expected", 6))


_PERM = 2000


@query(f"""WITH b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS v, label = 0 AS f FROM embeddings),
s AS (SELECT count(*) FILTER (f) AS n1, avg(v) FILTER (f) - avg(v) FILTER (NOT f) AS seen FROM b),
x AS (SELECT perm, v, row_number() OVER (PARTITION BY perm ORDER BY md5('s|' || perm || '|' || vec_id), vec_id) AS k FROM b, range(1, {_PERM} + 1) AS t(perm)),
d AS (SELECT perm, avg(v) FILTER (k <= n1) - avg(v) FILTER (k > n1) AS d FROM x, s GROUP BY perm)
SELECT count(*) AS n_perm, count(*) FILTER (round(d, 9) >= round(seen, 9)) AS n_at_least, round(any_value(seen), 6) AS observed, round((count(*) FILTER (round(d, 9) >= round(seen, 9)) + 1) / (count(*) + 1.0), 6) AS p_value FROM d, s""")
def m13_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one cohort, 2,000 permutations."""
    base = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("v"), (F.col("label") == 0).alias("f"))
    out = stats.permutation_p(base, "vec_id", "v", "f", _PERM)
    return out.select("n_perm", "n_at_least", F.round("observed", 6).alias("observed"), F.round("p_value", 6).alias("p_value"))


@query(f"""WITH {_FEATURES}, {_SETS},
subj AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, {sql.average_rank("", "label")} AS y FROM embeddings WHERE label IS NOT NULL),
xr AS (SELECT pos, vec_id, {sql.average_rank("pos", "v")} AS x FROM f WHERE label IS NOT NULL),
perms AS (SELECT perm, vec_id, row_number() OVER (PARTITION BY perm ORDER BY md5('s|' || perm || '|' || vec_id), vec_id) AS k
  FROM subj, range(1, {_PERM} + 1) AS t(perm) UNION ALL SELECT 0, vec_id, i FROM subj),
r AS (SELECT perm, pos, round(abs(corr(x, s.y)), 9) AS r FROM perms p JOIN subj s ON s.i = p.k JOIN xr ON xr.vec_id = p.vec_id GROUP BY perm, pos),
top AS (SELECT *, row_number() OVER (PARTITION BY perm ORDER BY r DESC, pos) AS k, count(*) OVER (PARTITION BY perm) AS m FROM r WHERE NOT isnan(r)),
c AS (SELECT perm, set_name, count(*) AS n_set, count(*) FILTER (k - 1 < m * 0.05) AS n FROM top JOIN sets USING (pos) GROUP BY perm, set_name),
o AS (SELECT set_name, n_set, n AS observed FROM c WHERE perm = 0)
SELECT set_name, o.n_set, observed, count(*) AS n_perm, count(*) FILTER (n >= observed) AS n_at_least, round((count(*) FILTER (n >= observed) + 1) / (count(*) + 1.0), 6) AS p_value
FROM c JOIN o USING (set_name) WHERE perm > 0 GROUP BY ALL""")
def m13_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of vectors as features, the label as outcome, 2,000 permutations."""
    outcome = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"))
    out = permutation.permutation_enrichment(_features(spark, sf_dir).drop("label"), outcome, _sets(spark), "pos", "vec_id", "v", "label", n=_PERM)
    return out.withColumn("p_value", F.round("p_value", 6))


@query(f"""WITH {_SUBJECTS}, h AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS half FROM subjects WHERE v IS NOT NULL AND c IS NOT NULL AND p IS NOT NULL),
k AS (SELECT half, {sql.average_rank("half", "v")} AS x, {sql.average_rank("half", "p")} AS y, {sql.average_rank("half", "c")} AS z FROM h),
r AS (SELECT half, count(*) AS n, {sql.corr("x", "y")} AS xy, {sql.corr("x", "z")} AS xz, {sql.corr("y", "z")} AS yz FROM k GROUP BY half),
a AS (SELECT half, n, {sql.partial("xy", "xz", "yz")} AS r FROM r)
SELECT half, n, round(r, 6) AS effect, (SELECT count(DISTINCT sign(r)) FROM a) = 1 AS sign_consistent FROM a""")
def m14_split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = subjects(spark, sf_dir).withColumn("half", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    out = stats.adjusted_ranks(halves, ["half"], "view", "purchase", "click")
    signs = out.agg((F.count_distinct(F.signum("effect")) == 1).alias("sign_consistent"))
    return out.join(F.broadcast(signs)).select("half", "n", F.round("effect", 6).alias("effect"), "sign_consistent")


_LOO = f"""{_SUBJECTS}, b AS (SELECT cohort, user_id, d AS x, p AS y FROM subjects WHERE d IS NOT NULL AND p IS NOT NULL),
w AS (SELECT a.cohort, a.user_id AS dropped, b.x, b.y FROM b a JOIN b ON a.cohort = b.cohort AND a.user_id <> b.user_id),
k AS (SELECT cohort, dropped, {sql.average_rank("cohort, dropped", "x")} AS x, {sql.average_rank("cohort, dropped", "y")} AS y FROM w),
r AS (SELECT cohort, dropped, count(*) AS n, {sql.corr("x", "y")} AS r FROM k GROUP BY ALL),
p AS (SELECT *, round({sql.p_value("r", "n")}, 9) AS p FROM r)"""


@query(f"""WITH {_LOO} SELECT cohort, round(p, 6) AS worst_p, round(r, 6) AS worst_r, dropped, p <= 0.05 AS survives
FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p DESC, dropped) AS k FROM p WHERE p IS NOT NULL) WHERE k = 1""")
def m15_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.leave_one_out(subjects(spark, sf_dir), ["cohort"], "user_id", "delta", "purchase")
    return out.select("cohort", F.round("worst_p", 6).alias("worst_p"), F.round("worst_r", 6).alias("worst_r"), "dropped", "survives")


@query(f"""WITH b AS (SELECT p_brand, avg(p_retailprice) AS m, abs(avg(p_size) - 25) AS e FROM part GROUP BY p_brand),
s AS (SELECT count(m) AS n, min(m) AS lo, max(m) AS hi, median(m) AS mid, {sql.corr("e", "m")} AS c FROM b)
SELECT n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mid, 6) AS mid, round(c, 6) AS coupling, NOT (hi - lo > 100 OR (n > 10 AND coalesce(c, 0) > 0.4)) AS log_scale FROM s""")
def m16_a21_log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), (F.avg("p_size") - 25).alias("e"))
    out = stats.log_scale_check(brands, "e", "m")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mid", "coupling")], "log_scale")


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY l_returnflag""")
def m17_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.ols(["l_returnflag"], _lines(spark, sf_dir), "x", "y")
    return out.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"WITH {_SWEEP} SELECT CAST(least(floor(p * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM q GROUP BY bin")
def m18_p_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.p_histogram(_sweep(spark, sf_dir), "p_value")


@query(f"WITH {_SWEEP} SELECT pos, round(-log10(p), 6) AS observed, round(-log10((row_number() OVER (ORDER BY p, pos) - 0.5) / count(*) OVER ()), 6) AS expected FROM q WHERE p > 0")
def m18_qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.qq_points(_sweep(spark, sf_dir), "p_value", "pos").select("pos", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"))


@query("""SELECT event_type, count(value) AS n, min(value) AS lo, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS hi FROM events GROUP BY event_type""")
def m19_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.quartiles(_t(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", "lo", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")], "hi")


_TWO = """a AS (SELECT p_brand AS feature, avg(p_retailprice) AS effect, avg(p_size) AS p FROM part GROUP BY p_brand),
b AS (SELECT p_brand AS feature, avg(p_retailprice) AS effect, avg(p_size) + 0.001 AS p FROM part WHERE p_brand <> 'Brand#11' GROUP BY p_brand)"""


def _two_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part")
    make = lambda d, shift: d.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("effect"), (F.avg("p_size") + shift).alias("p"))
    return make(part, 0.0), make(part.filter("p_brand <> 'Brand#11'"), 0.001)


@query(f"""WITH {_TWO} SELECT count(*) FILTER (a.feature IS NULL OR b.feature IS NULL) AS n_unmatched, count(*) AS n_features, round(max(abs(a.effect - b.effect)), 6) AS max_diff_effect, round(max(abs(a.p - b.p)), 6) AS max_diff_p, false AS reproduced
FROM a FULL JOIN b ON a.feature = b.feature""")
def m20_j16_a19_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.compare_results(*_two_tables(spark, sf_dir), "feature", ["effect", "p"])
    return out.select("n_unmatched", "n_features", F.round("max_diff_effect", 6).alias("max_diff_effect"), F.round("max_diff_p", 6).alias("max_diff_p"), "reproduced")


@query(f"""WITH {_TWO} SELECT count(*) AS n_shared FROM (SELECT feature FROM a ORDER BY p, feature LIMIT 10) JOIN (SELECT feature FROM b ORDER BY p, feature LIMIT 10) USING (feature)""")
def o4_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_overlap(*_two_tables(spark, sf_dir), "feature", "p", 10)


@query(f"""WITH {_SUBJECTS}, r AS (SELECT cohort, count(*) FILTER (v IS NOT NULL AND p IS NOT NULL) AS n, {sql.corr("v", "p")} AS r FROM subjects GROUP BY cohort)
SELECT cohort, n, round(r, 6) AS effect, round({sql.p_value("r", "n")}, 6) AS p_value FROM r""")
def m21_baseline_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.pearson(subjects(spark, sf_dir), ["cohort"], "view", "purchase")
    return out.select("cohort", "n", F.round("effect", 6).alias("effect"), F.round("p_value", 6).alias("p_value"))
