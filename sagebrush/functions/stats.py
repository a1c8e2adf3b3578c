"""Association statistics as Spark expressions and plans.

Undefined values (too few rows, no variance, |r| = 1 for a p-value) are NULL,
never an error or NaN.  All of it aggregates by key; nothing is collected.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import least_of_later, numbered, pairs_above
from .shared import stored

#: Rows that a task ranks, whatever the number of shuffle partitions.
RANKED_ROWS = 1 << 18
#: Rows of subjects and permutations that a task hashes.
SPREAD_ROWS = 1 << 24


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def _clamped(r: Column) -> Column:
    """Within [-1, 1]; NULL stays NULL, which least and greatest would skip."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation(a: str, b: str) -> Column:
    """Pearson r over the rows with both, clamped to [-1, 1]; NULL without variance."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return _clamped(finite(r))


def pairs(a: str, b: str) -> Column:
    return F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(1)))


def partial(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """Correlation of x and y with z held fixed; null where z leaves nothing of x
    or y but rounding errors (as in groups of two)."""
    left = (1 - rxz * rxz) * (1 - ryz * ryz)
    return _clamped(finite(F.when(left > 1e-12, (rxy - rxz * ryz) / F.sqrt(left))))


def p_value(r: Column, n: Column, covariates: int = 0) -> Column:
    """Two-sided p of a correlation with n - 2 - covariates degrees of freedom, by
    the finite series for whole degrees of freedom; one term for every two."""
    dof = (n - F.lit(2 + covariates)).cast("int")
    c2 = 1 - r * r
    even = dof % 2 == 0
    terms = F.when(even, F.floor(dof / 2)).otherwise(F.floor((dof - 1) / 2)).cast("int")
    ratio = lambda j: F.when(even, (2.0 * j - 3.0) / (2.0 * j - 2.0)).otherwise((2.0 * j - 2.0) / (2.0 * j - 1.0))
    first = F.when(even, F.lit(1.0)).otherwise(F.sqrt(c2))
    series = F.aggregate(
        F.when(terms >= 2, F.sequence(F.lit(2), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda a, j: F.struct((a["term"] * c2 * ratio(j)).alias("term"), (a["sum"] + a["term"] * c2 * ratio(j)).alias("sum")),
        lambda a: a["sum"],
    )
    total = F.when(terms >= 1, series).otherwise(F.lit(0.0))
    tail = F.when(even, 1 - F.abs(r) * total).otherwise(1 - (2 / math.pi) * (F.asin(F.abs(r)) + F.abs(r) * total))
    return F.when((dof >= 1) & (F.abs(r) < 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def fisher_interval(r: Column, n: Column, covariates: int = 0) -> tuple[Column, Column]:
    """95 % interval of a correlation; NULL for fewer than 4 + covariates rows."""
    spread = F.lit(1.96) / F.sqrt((n - F.lit(3 + covariates)).cast("double"))
    z = F.atanh(r)
    defined = (n > 3 + covariates) & (F.abs(r) < 1)
    return F.when(defined, F.tanh(z - spread)), F.when(defined, F.tanh(z + spread))


def average_rank(keys: list[str], value: str) -> Column:
    """Rank with ties at their mean; both windows need one sort."""
    order = W.partitionBy(*keys).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(order.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2.0


def ranked(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds r_<column>: average ranks among the rows that have all columns.  A task
    sorts once for each column, so rows are dealt over as many tasks as hold some
    RANKED_ROWS each; a single key is not split."""
    whole = df.dropna(subset=columns)
    if keys:
        parts = -(-whole.count() // RANKED_ROWS)
        whole = whole.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
    return whole.withColumns({f"r_{c}": average_rank(keys, c) for c in columns})


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    out = df.groupBy(*keys).agg(pairs(x, y).alias("n"), correlation(x, y).alias("effect"))
    return out.withColumn("p_value", p_value(F.col("effect"), F.col("n")))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return pearson(ranked(df, keys, [x, y]), keys, f"r_{x}", f"r_{y}")


def adjusted(df: DataFrame, keys: list[str], x: str, y: str, z: str, dof_covariates: int = 1) -> DataFrame:
    """Partial correlation over rows with all three.  ``dof_covariates`` 1 takes
    n - 3 degrees of freedom, 0 takes n - 2 (residuals correlated as they are)."""
    whole = df.dropna(subset=[x, y, z])
    three = whole.groupBy(*keys).agg(F.count("*").alias("n"), correlation(x, y).alias("xy"), correlation(x, z).alias("xz"), correlation(y, z).alias("yz"))
    out = three.withColumn("effect", partial(F.col("xy"), F.col("xz"), F.col("yz"))).drop("xy", "xz", "yz")
    return out.withColumn("p_value", p_value(F.col("effect"), F.col("n"), dof_covariates))


def adjusted_ranks(df: DataFrame, keys: list[str], x: str, y: str, z: str, dof_covariates: int = 1) -> DataFrame:
    """Rank correlation with the ranks of a covariate held fixed."""
    return adjusted(ranked(df, keys, [x, y, z]), keys, f"r_{x}", f"r_{y}", f"r_{z}", dof_covariates)


def bh_adjust(df: DataFrame, p: str, tie: str, keys: list[str] | None = None, out: str = "q_value", parts: int | None = None) -> DataFrame:
    """Benjamini-Hochberg q within ``keys``; rows without p get none.  Windows span
    ranges of p, of which counts and minima are carried on."""
    keys, df = keys or [], stored(df)
    tested = numbered(df.filter(F.col(p).isNotNull()), [p, tie], keys, parts=parts).withColumn("_v", F.col(p) * F.col("_m") / F.col("_rn"))
    least = least_of_later(tested, "_v", "_rn", keys).withColumn(out, F.least(F.lit(1.0), "_least"))
    none = df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return least.select(*none.columns).unionByName(none)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Two-sided normal p; one value per group, after aggregation."""
    return z.map(lambda v: None if pd.isna(v) else min(1.0, math.erfc(v / math.sqrt(2))))


def mann_whitney(df: DataFrame, keys: list[str], value: str, flag: str) -> DataFrame:
    """U of the flagged rows, rank-biserial 1 - 2U/(n1 n0), group means, and z
    with tie and continuity correction."""
    whole = df.dropna(subset=[value, flag]).withColumn("_r", average_rank(keys, value)).withColumn("_t", F.count("*").over(W.partitionBy(*keys, value)))
    on = F.col(flag)
    out = whole.groupBy(*keys).agg(
        F.count_if(on).alias("n1"),
        F.count_if(~on).alias("n0"),
        F.sum(F.when(on, F.col("_r"))).alias("_r1"),
        F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("_ties"),
        F.avg(F.when(on, F.col(value))).alias("mean1"),
        F.avg(F.when(~on, F.col(value))).alias("mean0"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5, sd)
    return out.withColumn("u", u).withColumn("rank_biserial", F.try_divide(n1 * n0 - 2 * u, n1 * n0)).withColumn("z", z).drop("_r1", "_ties")


def z_scores(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Adds z; features without variance are left out."""
    own = W.partitionBy(feature)
    sd = F.stddev_samp(value).over(own)
    return df.withColumn("_sd", sd).withColumn("_mean", F.avg(value).over(own)).filter("_sd > 0").withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_sd")).drop("_sd", "_mean")


def composite(scores: DataFrame, members: DataFrame, feature: str, subject: str, set_name: str = "set_name") -> DataFrame:
    """Mean z over the members of each set that were measured."""
    return scores.join(members, feature).groupBy(set_name, subject).agg(F.avg("z").alias("score"), F.count("*").alias("n_members"))


def leave_one_out(df: DataFrame, keys: list[str], subject: str, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Spearman without each subject in turn; the worst p, its r, the subject (the
    first of equals) and whether the finding survives.  Dropping a subject moves the
    ranks above it down by one and those of its ties by a half, so what its
    correlation needs comes from sums over the ranks above; n log n rows in all."""
    base = df.dropna(subset=[x, y]).select(*keys, F.col(subject).alias("_s"), F.col(x).alias("_x"), F.col(y).alias("_y0"))
    own = ranked(base, keys, ["_x", "_y0"]).withColumnsRenamed({"r__x": "_rx", "r__y0": "_ry"})
    own = pairs_above(own, keys, "_rx", "_ry")
    after = lambda other, by: (F.sum(other).over(W.partitionBy(*keys).orderBy(F.desc(by)).rangeBetween(W.unboundedPreceding, W.currentRow)), F.sum(other).over(W.partitionBy(*keys, by)))
    moved = lambda other, by: after(other, by)[0] - after(other, by)[1] + (after(other, by)[1] - F.col(other)) / 2
    ties = lambda r: F.count("*").over(W.partitionBy(*keys, r)).cast("double")
    cube = lambda t: t * t * t - t
    rows = own.withColumns({
        "_n": F.count("*").over(W.partitionBy(*keys)),
        "_tx": ties("_rx"), "_ty": ties("_ry"),
        "_xy": F.sum(F.col("_rx") * F.col("_ry")).over(W.partitionBy(*keys)),
        "_ax": moved("_ry", "_rx"), "_ay": moved("_rx", "_ry"),
    })
    # the sum of t**3 - t over groups of ties is that of t**2 - 1 over their rows
    for c in ("x", "y"):
        t = F.col(f"_t{c}")
        rows = rows.withColumn(f"_c{c}", F.sum(t * t - 1).over(W.partitionBy(*keys)) - cube(t) + cube(t - 1))
    m = (F.col("_n") - 1).cast("double")
    square = lambda c: (m * m * m - m - F.col(f"_c{c}")) / 12
    product = F.col("_xy") - F.col("_rx") * F.col("_ry") - F.col("_ax") - F.col("_ay") + F.col("_above") - m * (m + 1) * (m + 1) / 4
    room = square("x") * square("y")
    each = rows.withColumn("effect", _clamped(F.when((m >= 2) & (room > 1e-9), product / F.sqrt(room)))).withColumn("_m", m)
    each = each.filter((F.col("_m") >= 3) & (F.abs("effect") < 1)).withColumn("_a", F.abs("effect")).select(*keys, "_s", "_m", "_a", "effect")
    # p falls as |r| grows and all subjects of a group have one n, so p is asked of the
    # least |r| alone, and then up to which |r| it is the same to nine digits
    of = lambda r: F.round(p_value(r, F.col("_m")), 9)
    half = lambda s: (s["lo"] + s["hi"]) / 2
    step = lambda s, _: F.when(of(half(s)) >= of(F.col("_a")), F.struct(half(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
    up_to = F.aggregate(F.sequence(F.lit(1), F.lit(45)), F.struct(F.col("_a").alias("lo"), F.lit(1.0).alias("hi")), step, lambda s: s["lo"])
    least = F.row_number().over(W.partitionBy(*keys).orderBy("_a")) == 1
    each = each.withColumn("_least", least).withColumns({"_p": F.when(F.col("_least"), of(F.col("_a"))), "_to": F.when(F.col("_least"), up_to)})
    whole = W.partitionBy(*keys)
    each = each.withColumns({"_p": F.max("_p").over(whole), "_to": F.max("_to").over(whole)}).filter("_a <= _to")
    worst = each.groupBy(*keys).agg(F.max("_p").alias("worst_p"), F.min(F.struct("_s", "effect")).alias("w"))
    return worst.select(*keys, "worst_p", F.col("w.effect").alias("worst_r"), F.col("w._s").alias("dropped"), (F.col("worst_p") <= alpha).alias("survives"))


def enrichment(features: DataFrame, members: DataFrame, p: str, feature: str, share: float = 0.05) -> DataFrame:
    """Members of each set among the first share of the features by p, and how
    many to expect."""
    placed = numbered(features.filter(F.col(p).isNotNull()), [p, feature]).withColumn("_k", F.col("_rn") - 1)
    return placed.join(members, feature).groupBy("set_name").agg(F.count("*").alias("n_set"), F.count_if(F.col("_k") < F.col("_m") * share).alias("in_top"), (F.count("*") * F.lit(share)).alias("expected"))


def permutation_p(df: DataFrame, subject: str, value: str, flag: str, n: int, seed: str = "s") -> DataFrame:
    """Difference of means under relabelling: each permutation orders subjects by
    a hash of (seed, permutation, subject) and flags the first n1.  p is
    (k + 1) / (n + 1).  Counts and sums by the first two digits of the hash, added up
    before the shuffle, tell where the first n1 end; only subjects with those digits
    are ordered, one in 256."""
    base = df.dropna(subset=[value, flag]).select(subject, F.col(value).cast("double").alias("_v"), flag)
    on = F.col(flag)
    shape = stored(base.agg(F.count_if(on).alias("n1"), (F.avg(F.when(on, F.col("_v"))) - F.avg(F.when(~on, F.col("_v")))).alias("seen")))  # one row
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.col(subject).cast("string")))
    parts = max(-(-base.count() * n // SPREAD_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = base.repartition(parts, subject)  # a small table may be one file, and each row becomes n
    spread = base.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_h", hashed).withColumn("_d", F.substring("_h", 1, 2))
    bins = spread.groupBy("perm", "_d").agg(F.count("*").alias("_c"), F.sum("_v").alias("_s"))
    upto = F.sum("_c").over(W.partitionBy("perm").orderBy("_d"))
    bins = stored(bins.withColumn("_to", upto).join(F.broadcast(shape.select("n1"))))  # 256 rows of each permutation at most
    first, split = F.col("_to") <= F.col("n1"), (F.col("_to") > F.col("n1")) & (F.col("_to") - F.col("_c") < F.col("n1"))
    ends = bins.filter(split).select("perm", "_d", (F.col("n1") - F.col("_to") + F.col("_c")).alias("_room"))  # one row of each permutation at most
    own = F.row_number().over(W.partitionBy("perm").orderBy("_h", subject))
    inside = spread.join(F.broadcast(ends), ["perm", "_d"]).withColumn("_in", own <= F.col("_room"))
    whole = bins.filter(~split).select("perm", first.alias("_in"), "_c", "_s").unionByName(inside.select("perm", "_in", F.lit(1).cast("long").alias("_c"), F.col("_v").alias("_s")))
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("_s"))), F.sum(F.when(c, F.col("_c"))))
    each = whole.groupBy("perm").agg((mean(F.col("_in")) - mean(~F.col("_in"))).alias("d")).join(F.broadcast(shape.select("seen")))
    return each.agg(F.count("*").alias("n_perm"), F.count_if(F.round("d", 9) >= F.round("seen", 9)).alias("n_at_least"), F.first("seen").alias("observed")).withColumn("p_value", (F.col("n_at_least") + 1) / (F.col("n_perm") + 1))


def log_scale_check(df: DataFrame, effect: str, mean: str) -> DataFrame:
    """Whether mean expression looks logged: a range of at most 100 and no
    correlation over 0.4 of |effect| and mean (asked of more than 10 pairs)."""
    sized = df.withColumn("_e", F.abs(effect))
    out = sized.agg(F.count(mean).alias("n"), F.min(mean).alias("lo"), F.max(mean).alias("hi"), F.median(mean).alias("mid"), correlation("_e", mean).alias("coupling"), pairs("_e", mean).alias("n_pairs"))
    raw = ((F.col("hi") - F.col("lo")) > 100) | ((F.col("n_pairs") > 10) & (F.coalesce("coupling", F.lit(0.0)) > 0.4))
    return out.withColumn("log_scale", F.when(F.col("n") > 0, ~raw))


def ols(keys: list[str], df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x; NULL without variance of x."""
    both = df.dropna(subset=[x, y]).groupBy(*keys).agg(F.try_divide(F.covar_samp(x, y), F.var_samp(x)).alias("slope"), F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    return both.withColumn("intercept", F.col("_y") - F.col("slope") * F.col("_x")).drop("_x", "_y")


def p_histogram(df: DataFrame, p: str, bins: int = 50) -> DataFrame:
    return df.filter(F.col(p).isNotNull()).groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def qq_points(df: DataFrame, p: str, tie: str) -> DataFrame:
    """Observed and expected -log10 p by rank."""
    whole = numbered(df.filter(F.col(p) > 0), [p, tie])
    i, m = F.col("_rn"), F.col("_m")
    return whole.select(tie, (-F.log10(p)).alias("observed"), (-F.log10((i - 0.5) / m)).alias("expected"))


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = lambda f: F.percentile(value, f)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lo"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(value).alias("hi"))


def compare_results(left: DataFrame, right: DataFrame, feature: str, columns: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Whether two result tables hold the same features and values."""
    one = left.select(feature, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    two = right.select(feature, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    both = one.join(two, feature, "full_outer")
    lone = F.count_if(F.col("_l").isNull() | F.col("_r").isNull())
    diffs = {c: F.max(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}"))) for c in columns}
    out = both.agg(lone.alias("n_unmatched"), F.count("*").alias("n_features"), *[d.alias(f"max_diff_{c}") for c, d in diffs.items()])
    same = F.col("n_unmatched") == 0
    for c in columns:
        same = same & (F.coalesce(f"max_diff_{c}", F.lit(0.0)) < tolerance)
    return out.withColumn("reproduced", same)


def top_overlap(left: DataFrame, right: DataFrame, feature: str, p: str, k: int) -> DataFrame:
    """How many of the first k features by p two tables share."""
    first = lambda d: d.filter(F.col(p).isNotNull()).orderBy(p, feature).limit(k).select(feature)
    return first(left).join(first(right), feature).agg(F.count("*").alias("n_shared"))
