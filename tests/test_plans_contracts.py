"""Contracts of plans and hypotheses, paths below accessions, wide matrices."""

import pytest
from pyspark.sql import functions as F

from sagebrush.functions.text import below_accession, shown_effect, shown_p, text_of
from sagebrush.operators.contracts import hypothesis_faults, recommended
from sagebrush.operators.decisions import derived_criteria
from sagebrush.operators.relational import ContractError, complete_means
from sagebrush.sources.repository import wide_feature


def test_contracts_of_plans(spark):
    rows = [(1, "causal", None, "x", "y"), (2, "maybe", "positive", " ", "y"), (3, None, "up", "x", None)]
    parsed = spark.createDataFrame(rows, "id int, relationship_type string, directionality string, predictor string, outcome string")
    found = {r.id: r.reasons for r in hypothesis_faults(parsed, ["predictor", "outcome"]).collect()}
    assert found == {2: ["unknown relationship_type", "predictor blank"], 3: ["unknown directionality", "outcome blank"]}
    assert hypothesis_faults(parsed, ["population"]).count() == 3
    plan = spark.createDataFrame([("a", "download"), ("b", "skip"), ("c", None)], "unit string, download_recommendation string")
    assert [r.unit for r in recommended(plan, ["unit"]).collect()] == ["a"]
    with pytest.raises(ContractError):
        recommended(plan.filter("unit <> 'a'"), ["unit"])
    with pytest.raises(ContractError):
        recommended(plan.union(plan), ["unit"])


def test_paths_and_matrices(spark):
    paths = spark.createDataFrame([("x/gse1/a/b.txt", "GSE1"), ("x/GSE1", "GSE1"), ("x/y", "GSE1"), (None, "GSE1")], "p string, a string")
    assert [r[0] for r in paths.select(below_accession(F.col("p"), F.col("a"))).collect()] == ["a/b.txt", None, None, None]
    wide = spark.createDataFrame([("p1", "1.5", "2"), ("p2", "3", "4"), ("p2", "3", "4")], "probe_id string, `s.1` string, s2 string")
    assert sorted(tuple(r) for r in wide_feature(wide, "p1").collect()) == [("s.1", 1.5), ("s2", 2.0)]
    for probe in ("p2", "p3"):
        with pytest.raises(ContractError):
            wide_feature(wide, probe)
    long = spark.createDataFrame([("u", "g", 1.0), ("u", "g", 3.0), ("u", "h", 5.0), ("v", "g", 1.0), ("w", "g", None), ("w", "h", 1.0)], "k string, g string, v double")
    assert [tuple(r) for r in complete_means(long, "k", "g", "v", ["g", "h"]).collect()] == [("u", 2.0, 5.0)]


def test_shown_numbers_and_criteria(spark):
    ps = [0.0, 0.0005, 0.001, 0.00123, 0.0456, 0.09996, 0.1, 0.1234, 0.9996, 1.0]
    rows = spark.createDataFrame([(p,) for p in [*ps, None]], "p double").select("p", shown_p(F.col("p")).alias("s"), shown_effect(F.col("p")).alias("e")).collect()
    assert [r.s for r in rows] == ["<0.001" if p < 0.001 else f"{p:.3g}" for p in ps] + ["n/a"]
    assert [r.e for r in rows] == [f"{p:+.3f}" for p in ps] + ["n/a"]
    many = spark.createDataFrame([(" a ", None, ""), (None, "b", "c")], "x string, y string, z string")
    assert [r[0] for r in many.select(text_of("x", "y", "z")).collect()] == ["a", "b c"]
    specs = spark.createDataFrame([(1, [(" in ", None), ("two", "out")]), (2, None)], "id int, scientific_criteria array<struct<description string, exclusion string>>")
    found = {r.id: (r.inclusion_criteria, r.exclusion_criteria) for r in derived_criteria(specs).collect()}
    assert found == {1: (["in", "two"], ["", "out"]), 2: ([], [])}
