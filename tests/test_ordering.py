"""Row numbers across ranges, leave-one-out without pairs, permuted enrichment,
scans of single probes: against plain versions."""

import gzip
import hashlib
import io
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrush.functions import permutation, stats
from sagebrush.functions.ordering import numbered, pairs_above
from sagebrush.operators.relational import ContractError
from sagebrush.sources import series_scan


def test_numbers_and_q_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), f"f{i:04}", rng.choice([1.0, 1.0, rng.random(), rng.random() ** 4, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, f string, p double")
    for keys in ([], ["k"]):
        got = {r["f"]: r["q"] for r in stats.bh_adjust(df, "p", "f", keys, out="q", parts=64).collect()}
        assert len(got) == len(rows)
        for key in {r[0] for r in rows} if keys else {0}:
            family = sorted((p, f) for k, f, p in rows if p is not None and (not keys or k == key))
            least = 1.0
            for i in range(len(family), 0, -1):
                least = min(least, family[i - 1][0] * len(family) / i)
                assert math.isclose(got[family[i - 1][1]], least, rel_tol=1e-12)
        assert all(got[f] is None for _, f, p in rows if p is None)
    plan = stats.bh_adjust(df, "p", "f", parts=64)._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((\w+)", plan)
    assert windows and set(windows) == {"_b"}
    whole = numbered(df.filter("p IS NOT NULL"), ["p", "f"], parts=64).collect()
    assert [r["f"] for r in sorted(whole, key=lambda r: r["_rn"])] == [f for _, f in sorted((p, f) for _, f, p in rows if p is not None)]
    sizes = [sum(r["_b"] == b for r in whole) for b in {r["_b"] for r in whole}]
    assert max(sizes) < len(whole) / 8  # ties of p are cut by the feature
    assert stats.bh_adjust(df.limit(0), "p", "f").collect() == []


@pytest.mark.parametrize("values", [2, 5, 1000])
def test_pairs_above(spark, values):
    rng = random.Random(values)
    rows = [(k, i % 40, rng.randrange(values), rng.randrange(values)) for k in "ab" for i in range(60)]
    got = pairs_above(spark.createDataFrame(rows, "k string, i int, x int, y int"), ["k"], "x", "y").collect()
    half = lambda a, b: 1 if b > a else 0.5 if b == a else 0
    want = sorted((k, i, x, y, sum(half(x, x2) * half(y, y2) for k2, _, x2, y2 in rows if k2 == k) - 0.25) for k, i, x, y in rows)
    assert sorted((r["k"], r["i"], r["x"], r["y"], r["_above"]) for r in got) == want


def slow_leave_one_out(df, keys, subject, x, y):
    """Each subject's Spearman from its own copy of the others."""
    base = df.dropna(subset=[x, y]).select(*keys, subject, x, y)
    without = base.select(*keys, F.col(subject).alias("dropped")).join(base, keys).filter(F.col("dropped") != F.col(subject))
    each = stats.spearman(without, [*keys, "dropped"], x, y).filter("p_value IS NOT NULL").select(*keys, "dropped", F.round("p_value", 9).alias("p"), "effect")
    best = {}
    for r in each.collect():
        k = tuple(r[c] for c in keys)
        best[k] = min(best.get(k, (9, "", 0)), (-r["p"], r["dropped"], r["effect"]))
    return {k: (-p, s, e) for k, (p, s, e) in best.items()}


def test_leave_one_out(spark):
    rng = random.Random(4)
    rows = [(g, f"s{i:03}", rng.choice([rng.gauss(0, 1), float(rng.randrange(3))]), rng.choice([rng.gauss(0, 1) + i / 9, float(rng.randrange(4)), None])) for g, n in (("a", 40), ("b", 9), ("c", 3), ("d", 2), ("e", 1)) for i in range(n)]
    rows += [("f", f"s{i}", 1.0, float(i)) for i in range(6)]  # no variance
    df = spark.createDataFrame(rows, "g string, subject string, x double, y double")
    got = {(r["g"],): r for r in stats.leave_one_out(df, ["g"], "subject", "x", "y").collect()}
    want = slow_leave_one_out(df, ["g"], "subject", "x", "y")
    assert got.keys() == want.keys()
    for k, (p, s, e) in want.items():
        assert got[k]["dropped"] == s and abs(got[k]["worst_p"] - p) < 2e-9 and abs(got[k]["worst_r"] - e) < 1e-9


def enrichment(cells, outcome, sets, n, seed, share=0.05):
    """Plain permutation enrichment with a covariate."""
    subjects = sorted(outcome)
    rank = lambda v: permutation.average_ranks(np.array([v]))[0]
    design = np.column_stack([np.ones(len(subjects)), rank([outcome[s][1] for s in subjects])])
    rest = lambda v: v - design @ np.linalg.lstsq(design, v, rcond=None)[0]
    y = rank([outcome[s][0] for s in subjects])
    x = {f: rest(rank([v[s] for s in subjects])) for f, v in cells.items() if all(s in v for s in subjects) and len(set(v[s] for s in subjects)) > 1}
    counts = []
    for perm in range(n + 1):
        order = sorted(subjects, key=lambda s: (hashlib.md5(f"{seed}|{perm}|{s}".encode()).hexdigest(), s)) if perm else subjects
        place = {s: k for k, s in enumerate(order)}
        yp = rest(np.array([y[place[s]] for s in subjects]))
        r = {f: round(abs(float(np.corrcoef(v, yp)[0, 1])), 9) for f, v in x.items()}
        top = sorted(r, key=lambda f: (-r[f], f))[: math.ceil(len(r) * share)]
        counts.append({name: len(m & set(top)) for name, m in sets.items()})
    return {name: (len(m & set(x)), counts[0][name], sum(c[name] >= counts[0][name] for c in counts[1:])) for name, m in sets.items() if m & set(x)}


@pytest.mark.parametrize("block", [1 << 26, 8 * 30 * 50])
def test_permutation_enrichment(spark, monkeypatch, block):
    monkeypatch.setattr(permutation, "BLOCK_BYTES", block)  # of the driver: how many rounds
    rng = random.Random(8)
    outcome = {f"s{i:02}": (rng.gauss(0, 1), rng.randrange(20, 60)) for i in range(30)}
    cells = {f"f{k:03}": {s: rng.gauss(0, 1) + (outcome[s][0] if k < 12 else 0) for s in outcome} for k in range(120)}
    cells["flat"] = {s: 1.0 for s in outcome}
    cells["short"] = {s: 1.0 * k for k, s in enumerate(outcome) if k}
    sets = {"hit": {f"f{k:03}" for k in range(0, 20)}, "miss": {f"f{k:03}" for k in range(60, 90)}, "none": {"flat", "gone"}, "mixed": {"f001", "f100", "short"}}
    long = spark.createDataFrame([(f, s, v) for f, d in cells.items() for s, v in d.items()] + [("f000", "other", 5.0)], "f string, s string, v double").repartition(5)
    people = spark.createDataFrame([(s, *v) for s, v in outcome.items()] + [("x", None, 3)], "s string, y double, age int")
    members = spark.createDataFrame([(n, f) for n, m in sets.items() for f in m], "set_name string, f string")
    got = permutation.permutation_enrichment(long, people, members, "f", "s", "v", "y", "age", n=200, seed="q").collect()
    want = enrichment(cells, outcome, sets, 200, "q")
    assert {r["set_name"]: (r["n_set"], r["observed"], r["n_at_least"]) for r in got} == want
    assert all(r["p_value"] == (r["n_at_least"] + 1) / 201 and r["n_perm"] == 200 for r in got)


def matrix(n_rows=3000, end=("!series_matrix_table_end",), extra=()):
    yield from ("!Series_geo_accession\t\"GSE1\"\n", '!Sample_geo_accession\t"GSM1"\t"GSM2"\t"GSM3"\n', "!series_matrix_table_begin\n", '"ID_REF"\t"GSM1"\t"GSM2"\t"GSM3"\n')
    for k in range(n_rows):
        yield f'"p{k}"\t{k}.5\t{k}\t-{k}e1\n'
    yield from extra
    yield from (f"{e}\n" for e in end)


def test_scan_stops_at_its_line(spark, tmp_path):
    seen = []

    def counted():
        for line in matrix():
            seen.append(line)
            yield line

    rows = list(series_scan.scan("m", counted(), frozenset(["p7"]), whole=False))
    assert [r[2:6] for r in rows] == [("GSM1", 0, "7.5", 7.5), ("GSM2", 1, "7", 7.0), ("GSM3", 2, "-7e1", -70.0)]
    assert len(seen) == 12  # of 3,005 lines
    for name in ("a", "b"):
        with gzip.open(tmp_path / f"{name}.txt.gz", "wt") as f:
            f.writelines(matrix(400 if name == "a" else 20))
    cells = series_scan.read_probes(spark, str(tmp_path))
    one = cells.filter("probe_id = 'p30'")
    assert " Filter " not in one._jdf.queryExecution().executedPlan().toString()  # the reader has it
    got = one.collect()
    assert sum(r["fault"] is None for r in got) == 3 and [r["fault"] for r in got if r["fault"]] == ["no row of the probe"]
    assert cells.filter("fault IS NULL").count() == 3 * 420
    assert series_scan.probe_lookup(spark, str(tmp_path), ["p3", "p30", "px"]).groupBy("probe_id").count().orderBy("probe_id").collect() == [("p3", 6), ("p30", 3)]
    assert cells.filter("probe_id = 'p1' AND probe_id = 'p2'").collect() == []
    assert series_scan.feature_values(spark, str(tmp_path / "a.txt.gz"), "p30").select(F.sum("value")).first()[0] == 30.5 + 30 - 300
    with pytest.raises(ContractError, match="no row of the probe"):
        series_scan.feature_values(spark, str(tmp_path), "p30")


@pytest.mark.parametrize(
    ("lines", "fault"),
    [
        (matrix(5, end=()), "no end marker"),
        (matrix(5, end=("!series_matrix_table_end",) * 2), "end marker repeated"),
        (matrix(5, extra=['"p2"\t1\t2\t3\n']), "several rows of the probe"),
        (matrix(2, extra=['"p2"\t1\t2\n']), "width of p2"),
        (matrix(2, extra=['"p2"\t1\tNA\t3\n']), "value of GSM2 is not numeric"),
        (matrix(2, extra=['"p2"\t1\tinf\t3\n']), "value of GSM2 is not numeric"),
        (matrix(1), "no row of the probe"),
        (["!Series\n"], "no begin marker"),
        (["!Sample_geo_accession\tGSM1\tGSM2\n", "!series_matrix_table_begin\n", "ID_REF\tGSM2\tGSM1\n", "p2\t1\t2\n", "!series_matrix_table_end\n"], "columns differ from the header's samples"),
    ],
)
def test_scan_faults(lines, fault):
    rows = list(series_scan.scan("m", lines, frozenset(["p2"]), whole=True))
    assert [r[6] for r in rows if r[6]] == [fault] and all(r[1] == "p2" for r in rows)


def test_lookup_skips_blanks():
    text = io.StringIO("".join(matrix(2, extra=["p2\tNA\t\t3\n"])))
    assert [r[2] for r in series_scan.scan("m", text, frozenset(["p2"]), whole=False)] == ["GSM3"]


def test_values_that_change_when_computed_again(spark):
    """As sums of doubles do in their last digits, by the order of their parts."""
    noisy = F.udf(lambda i: i / 100 + random.random() * 1e-13, "double").asNondeterministic()
    df = spark.range(50).select(F.format_string("f%03d", "id").alias("f"), noisy("id").alias("p"))
    assert sorted((r["f"], r["_rn"], r["_m"]) for r in numbered(df, ["p", "f"], parts=64).collect()) == [(f"f{i:03}", i + 1, 50) for i in range(50)]
    assert sorted((r["f"], round(r["q_value"], 9)) for r in stats.bh_adjust(df, "p", "f", parts=64).collect()) == [(f"f{i:03}", round(min(j / 100 * 50 / (j + 1) for j in range(i, 50)), 9)) for i in range(50)]


def test_enrichment_of_a_large_cohort(spark):
    n = 100_001  # more than one matrix of permutations held before
    value = lambda k, s: float((s * (k + 7)) % 1009)
    outcome = {f"{s:06}": (float(s * 31 % 997), s % 50) for s in range(n)}
    cells = {f"f{k}": {name: value(k, s) for s, name in enumerate(outcome)} for k in range(3)}
    name = F.format_string("%06d", "id").alias("s")
    people = spark.range(n).select(name, (F.col("id") * 31 % 997).cast("double").alias("y"), (F.col("id") % 50).cast("int").alias("age"))
    long = spark.range(n).select(name, F.explode(F.array(*[F.struct(F.lit(f"f{k}").alias("f"), (F.col("id") * (k + 7) % 1009).cast("double").alias("v")) for k in range(3)])).alias("c")).select("s", "c.*")
    members = spark.createDataFrame([("a", "f0"), ("b", "f1"), ("b", "f2")], "set_name string, f string")
    got = permutation.permutation_enrichment(long, people, members, "f", "s", "v", "y", "age", n=3, share=0.3).collect()
    assert {r["set_name"]: (r["n_set"], r["observed"], r["n_at_least"]) for r in got} == enrichment(cells, outcome, {"a": {"f0"}, "b": {"f1", "f2"}}, 3, "s", 0.3)


@pytest.mark.parametrize("block", [1 << 24, 8 * 7 * 16])
def test_enrichment_by_blocks(spark, monkeypatch, block):
    """Blocks of 7 subjects; the driver gets neither subjects nor permuted outcomes."""

    def to_arrow(df, whole=DataFrame.toArrow):
        table = whole(df)
        assert not table.num_rows
        return table

    monkeypatch.setattr(DataFrame, "toArrow", to_arrow)
    monkeypatch.setattr(SparkContext, "broadcast", lambda *_: pytest.fail("a matrix goes through the driver"))
    monkeypatch.setattr(permutation, "SUBJECTS", 7, raising=False)
    monkeypatch.setattr(permutation, "BLOCK_BYTES", block)
    rng = random.Random(4)
    outcome = {f"s{i:02}": (float(rng.randrange(6)), rng.randrange(20, 30)) for i in range(40)}
    cells = {f"f{k:03}": {s: float(rng.randrange(50)) + (8 * outcome[s][0] if k < 9 else 0) for s in outcome} for k in range(70)}
    sets = {"hit": {f"f{k:03}" for k in range(12)}, "miss": {f"f{k:03}" for k in range(30, 50)}, "mixed": {"f001", "f060", "twice"}}
    rows = [(f, s, v) for f, d in cells.items() for s, v in d.items()]
    rows += [("twice", s if i else "s01", float(i)) for i, s in enumerate(outcome)]  # as many rows as subjects, not one of each
    rows += [("covariate", s, float(v[1])) for s, v in outcome.items()]
    long = spark.createDataFrame(rows, "f string, s string, v double").repartition(5)
    people = spark.createDataFrame([(s, *v) for s, v in outcome.items()], "s string, y double, age int")
    members = spark.createDataFrame([(n, f) for n, m in sets.items() for f in m] + [("same", "covariate")], "set_name string, f string")
    got = {r["set_name"]: (r["n_set"], r["observed"], r["n_at_least"]) for r in permutation.permutation_enrichment(long, people, members, "f", "s", "v", "y", "age", n=60, seed="q", share=0.1).collect()}
    assert got.pop("same") == (1, 0, 60)  # the covariate leaves nothing of it
    assert got == enrichment(cells, outcome, sets, 60, "q", 0.1)


def test_equal_halves_of_digests():
    class Mark:
        def copy(self):
            return Mark()

        def update(self, name):
            self.name = name

        def digest(self):
            return b"a" * 8 + self.name[-1:] * 8

    blocks = [pa.table({"name": ["x3", "x1"]}), pa.table({"name": ["x2", "y1"]})]
    assert permutation._places(blocks, Mark()).tolist() == [3, 0, 2, 1]
