"""Statistics against published numbers and plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sagebrush.functions import stats


def one(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@pytest.mark.parametrize(("t", "dof", "p"), [(1.757, 13, 0.10242827), (0.0906, 8, 0.93003780), (2.63, 8, 0.03017818), (3.04, 13, 0.00948064), (1.514, 163, 0.13196247)])
def test_p_values(spark, t, dof, p):
    r = t / math.sqrt(dof + t * t)
    got = one(spark, r=r, n=dof + 2).select(stats.p_value(F.col("r"), F.col("n"))).first()[0]
    assert abs(got - p) < 1e-8


# published r, n and p of the two arms: raw, difference, adjusted
@pytest.mark.parametrize(("r", "n", "k", "p"), [(0.438, 15, 0, 0.103), (0.032, 10, 0, 0.930), (0.645, 15, 0, 0.00943), (0.681, 10, 0, 0.03), (0.545, 15, 1, 0.0438), (-0.117753, 165, 0, 0.131987)])
def test_published_p_values(spark, r, n, k, p):
    got = one(spark, r=r, n=n).select(stats.p_value(F.col("r"), F.col("n"), k)).first()[0]
    assert abs(got - p) < max(6e-4, 0.01 * p)


def test_undefined_is_null(spark):
    rows = [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 3.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 5.0), ("gap", None, 1.0), ("gap", 2.0, None)]
    out = {r["k"]: r for r in stats.pearson(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert out["one"]["effect"] is None and out["flat"]["effect"] is None and out["gap"]["n"] == 0
    assert out["two"]["effect"] == pytest.approx(1.0) and all(r["p_value"] is None for r in out.values())


def test_ranks_and_bh(spark):
    p = [0.01, 0.04, 0.04, 0.2, 0.9, 0.001]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(9, None)], "i int, p double")
    got = {r["i"]: r["q_value"] for r in stats.bh_adjust(frame, "p", "i").collect()}
    order = sorted(range(6), key=lambda i: p[i])
    want, low = {}, 1.0
    for rank in range(6, 0, -1):
        low = min(low, p[order[rank - 1]] * 6 / rank)
        want[order[rank - 1]] = low
    assert got.pop(9) is None and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    ranks = {r["i"]: r["r"] for r in frame.dropna().withColumn("g", F.lit(1)).withColumn("r", stats.average_rank(["g"], "p")).collect()}
    assert ranks == {0: 2, 1: 3.5, 2: 3.5, 3: 5, 4: 6, 5: 1}


def test_mann_whitney(spark):
    a, b = [1.0, 4.0, 4.0, 9.0], [2.0, 4.0, 7.0, 11.0, 12.0]
    rows = [("g", v, True) for v in a] + [("g", v, False) for v in b]
    r = stats.mann_whitney(spark.createDataFrame(rows, "k string, v double, f boolean"), ["k"], "v", "f").withColumn("p", stats.normal_tail("z")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u"] == u and r["rank_biserial"] == pytest.approx(1 - 2 * u / 20)
    sd = math.sqrt(20 / 12 * (10 - (27 - 3) / 72))
    assert r["z"] == pytest.approx((max(u, 20 - u) - 10 - 0.5) / sd) and r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)))


def test_both_dof_conventions(spark):
    rows = [("a", float(i % 7), float(i * i % 11), float(i % 5)) for i in range(40)]
    frame = spark.createDataFrame(rows, "k string, x double, y double, z double")
    n2, n3 = (stats.adjusted_ranks(frame, ["k"], "x", "y", "z", c).first() for c in (0, 1))
    assert n2["effect"] == n3["effect"] and n2["p_value"] < n3["p_value"]


def spearman_p(rows):
    def ranks(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    x, y = (ranks(c) for c in zip(*rows, strict=True))
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    r = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    # Simpson's rule over the density of t with n - 2 degrees of freedom
    v, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
    f = lambda u: math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + u * u / v) ** (-(v + 1) / 2)
    h = t / 2000
    return 1 - 2 * h / 3 * sum((1 if k in (0, 2000) else 4 if k % 2 else 2) * f(k * h) for k in range(2001))


def test_leave_one_out(spark):
    points = [(1.0, 1.0), (2.0, 2.0), (3.0, 2.5), (4.0, 4.5), (5.0, 4.0), (6.0, 7.0), (7.0, 1.0), (8.0, 9.0)]
    r = stats.leave_one_out(spark.createDataFrame([("g", i, *p) for i, p in enumerate(points)], "k string, s long, x double, y double"), ["k"], "s", "x", "y").first()
    each = {i: spearman_p([p for j, p in enumerate(points) if j != i]) for i in range(len(points))}
    worst = max(each.values())
    assert r["worst_p"] == pytest.approx(worst, abs=1e-6) and r["dropped"] == min(i for i, p in each.items() if abs(p - worst) < 1e-9) and r["survives"] == (worst <= 0.05)


def test_compare_results(spark):
    one_, two = (spark.createDataFrame([(f, e) for f, e in rows], "f string, e double") for rows in ([("a", 1.0), ("b", 2.0)], [("a", 1.0 + 1e-7), ("b", 2.0)]))
    assert stats.compare_results(one_, two, "f", ["e"]).first()["reproduced"]
    assert not stats.compare_results(one_, two.filter("f = 'a'"), "f", ["e"]).first()["reproduced"]


def test_ranks_need_one_sort_each_and_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANKED_ROWS", 50, raising=False)
    df = spark.range(2000).select((F.col("id") % 300).alias("k"), (F.col("id") * 7 % 11).cast("double").alias("x"), (F.col("id") * 5 % 13).cast("double").alias("y"))
    got = stats.ranked(df, ["k"], ["x", "y"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("== Initial Plan ==")].count("Sort [") == 2
    assert got.groupBy(F.spark_partition_id()).count().count() > 30  # 8 shuffle partitions
    rows = got.collect()
    for r in rows[::50]:
        own = [o["x"] for o in rows if o["k"] == r["k"]]
        assert r["r_x"] == sum(v < r["x"] for v in own) + (own.count(r["x"]) + 1) / 2


@pytest.mark.parametrize("n1", [0, 1, 150, 299, 300])
def test_permutation_p(spark, n1):
    """Against sorting every permutation; only subjects by the cut are ordered."""
    rows = [(f"s{i}", (i * 37 % 101) / 7, i < n1) for i in range(300)] + [("gap", None, True), ("none", 1.0, None)]
    df = spark.createDataFrame(rows, "s string, v double, f boolean")
    frame = stats.permutation_p(df, "s", "v", "f", 40, "q")
    got = frame.first()
    mean = lambda v: sum(v) / len(v) if v else math.nan
    values = {s: v for s, v, f in rows if v is not None and f is not None}
    seen = mean(list(values.values())[:n1]) - mean(list(values.values())[n1:])
    k = 0
    for perm in range(1, 41):
        order = sorted(values, key=lambda s: (hashlib.md5(f"q|{perm}|{s}".encode()).hexdigest(), s))
        d = mean([values[s] for s in order[:n1]]) - mean([values[s] for s in order[n1:]])
        k += round(d, 9) >= round(seen, 9)
    assert (got["n_perm"], got["n_at_least"]) == (40, k) and got["p_value"] == (k + 1) / 41
    assert (got["observed"] is None) if math.isnan(seen) else got["observed"] == pytest.approx(seen)
    assert "_d" in frame._jdf.queryExecution().analyzed().toString()
