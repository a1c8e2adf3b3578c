"""Decision rules, contracts and resolution, branch by branch."""

import pytest
from pyspark.sql import functions as F

from sagebrush.operators import contracts, decisions, relational


def scored(spark, rows, rule):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, effect double, fdr double, p_value double, n int")
    return decisions.score(frame, rule)


def test_score_branches(spark):
    rule = decisions.Rule(min_effect=0.3)
    rows = [(0.5, 0.01, None, 20), (-0.1, 0.01, None, 20), (0.1, 0.01, None, 20), (0.5, 0.2, 0.01, 20), (0.5, None, 0.01, 9), (None, 0.01, None, 20), (0.5, None, None, 20), (float("nan"), 0.01, None, 20), (0.0, 0.01, None, 20), (0.5, 0.05, None, 20)]
    got = [(r["verdict"], r["small_n"]) for r in scored(spark, rows, rule).orderBy("i").collect()]
    assert [v for v, _ in got] == ["supports", "refutes", "inconclusive", "inconclusive", "supports", "inconclusive", "inconclusive", "inconclusive", "refutes", "supports"]
    assert got[4][1] and not got[0][1]
    either = scored(spark, [(-0.5, 0.01, None, 20)], decisions.Rule(direction="either")).first()
    assert either["verdict"] == "supports"


def test_confidence(spark):
    rule = decisions.Rule()
    rows = [(0.5, 0.0, None, 20), (0.5, 0.05, None, 20), (0.5, 0.025, None, 20), (0.5, 0.9, None, 20), (0.5, 0.2, None, 20), (0.5, None, None, 20)]
    got = [r["c"] for r in scored(spark, rows, rule).withColumn("c", decisions.confidence(rule)).orderBy("i").collect()]
    assert got == [0.95, 0.5, 0.725, 0.1, 0.4, 0.3]


@pytest.mark.parametrize(
    ("verdicts", "gap", "want"),
    [
        ([("supports", "a"), ("supports", "b")], False, "supports"), ([("supports", "a"), ("supports", "a")], False, "inconclusive"), ([("supports", "a"), ("refutes", "b")], False, "inconclusive"),
        ([("refutes", "a"), ("inconclusive", "b")], False, "refutes"), ([("inconclusive", "a")], False, "inconclusive"), ([("supports", "a"), ("supports", "b")], True, "inconclusive"), ([("refutes", "a")], True, "inconclusive"),
    ],
)
def test_rollup(spark, verdicts, gap, want):
    rows = spark.createDataFrame([("h", v, g, gap) for v, g in verdicts], "h string, verdict string, group_key string, gap boolean")
    assert decisions.rollup(rows, ["h"], decisions.Rule(), uncovered="gap").first()["verdict"] == want


def test_platform_comes_before_cohort(spark):
    row = "superseries string, bioproject string, study string, program string, lab string, platform string, gse_id string, cohort string, independence_group string"
    frame = spark.createDataFrame([(None,) * 5 + ("GPL1", "GSE1", "Trial 1", None), (None,) * 5 + (None, "GSE1", "Trial 1", None), (None,) * 6 + ("GSE1", None, None), ("S",) + (None,) * 5 + ("GSE1", None, "own")], row)
    assert [r[0] for r in frame.select(decisions.unit_key()).collect()] == ["lab:?|platform:GPL1", "GSE1|cohort:Trial 1", "accession:GSE1", "own"]


def test_rules_are_checked():
    for bad in ({"alpha": 0}, {"alpha": 1}, {"direction": "left"}, {"min_independent_groups": 0}):
        with pytest.raises(ValueError):
            decisions.Rule(**bad)


def test_eligibility_and_fusion(spark):
    spec = spark.createDataFrame([("a", "scientific"), ("b", "scientific"), ("c", "operational")], "criterion string, section string")
    rows = [("ok", "a", True), ("ok", "b", True), ("ok", "c", True), ("out", "a", False), ("out", "b", None), ("open", "a", True), ("stop", "a", True), ("stop", "b", True), ("stop", "c", False), ("look", "a", True), ("look", "b", True)]
    out = {r["dataset_id"]: (r["eligibility"], r["execution"]) for r in decisions.eligibility(spec, spark.createDataFrame(rows, "dataset_id string, criterion string, value boolean")).collect()}
    assert out == {"ok": ("eligible", "ready"), "out": ("excluded", "not_applicable"), "open": ("uncertain", "needs_scientific_resolution"), "stop": ("eligible", "blocked"), "look": ("eligible", "needs_data_check")}
    facts = [("d", "conflict", 0, True, "high", "x"), ("d", "conflict", 1, False, "high", "y"), ("d", "no", 0, None, "high", "x"), ("d", "no", 1, False, "medium", "y"), ("d", "yes", 0, True, "odd", "x"), ("d", "none", 0, None, "medium", "x")]
    fused = {r["criterion"]: (r["value"], r["conflict"], r["confidence"]) for r in decisions.fuse(spark.createDataFrame(facts, "dataset_id string, criterion string, source_ord int, value boolean, confidence string, source string")).collect()}
    assert fused == {"conflict": (None, True, "low"), "no": (False, False, "medium"), "yes": (True, False, "low"), "none": (None, False, "medium")}


def test_resolution_and_review(spark):
    c = spark.createDataFrame([("q1", 1, 5, "f1"), ("q1", 2, 9, "f2"), ("q2", 2, 5, "f3"), ("q2", 2, 5, "f4"), ("q2", 2, 4, "f5"), ("q3", 3, 1, "f6")], "query string, stage int, strength int, feature string")
    res = decisions.resolve(c)
    assert {r["query"]: (r["features"], r["status"]) for r in res.collect()} == {"q1": (["f1"], "candidate"), "q2": (["f3", "f4"], "tied"), "q3": (["f6"], "candidate")}
    # a tie of the exact stage stands, other ties fall through, and the narrowest remains
    more = [("x", 1, 1, "a"), ("x", 1, 1, "b"), ("x", 3, 1, "c"), ("y", 2, 7, "a"), ("y", 2, 7, "b"), ("y", 3, 2, "c")]
    more += [("z", 2, 7, "a"), ("z", 2, 7, "b"), ("z", 2, 7, "c"), ("z", 3, 2, "d"), ("z", 3, 2, "e"), ("w", 2, 1, "a"), ("w", 2, 1, "b"), ("w", 3, 1, "c"), ("w", 3, 1, "d")]
    got = decisions.resolve(spark.createDataFrame(more, c.schema)).collect()
    assert {r["query"]: (r["stage"], r["features"], r["status"]) for r in got} == {
        "x": (1, ["a", "b"], "tied"), "y": (3, ["c"], "candidate"), "z": (3, ["d", "e"], "tied"), "w": (2, ["a", "b"], "tied"),
    }
    present = spark.createDataFrame([("f1",), ("f3",), ("f4",)], "feature string")
    verified = decisions.verify_features(res, present)
    assert {r["query"]: r["status"] for r in verified.collect()} == {"q1": "verified", "q2": "verified_multiple", "q3": "needs_review"}
    assert {r["query"]: r["status"] for r in decisions.verify_features(res, present, predictor=False).collect()}["q2"] == "needs_review"
    done = decisions.confirmed(verified, spark.createDataFrame([("q3", "f6")], "query string, feature string"))
    assert {r["query"]: r["status"] for r in done.collect()}["q3"] == "verified"


def test_joins_keep_their_contracts(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    assert relational.one_match(left, right, ["k"]).count() == 4
    with pytest.raises(relational.ContractError):
        relational.one_match(left, right.union(right), ["k"])
    with pytest.raises(relational.ContractError):
        relational.one_match(left, right, ["k"], one_to_one=True)
    with pytest.raises(relational.ContractError):
        relational.linked(left, right, ["k"])
    assert relational.linked(left, right, ["k"], "drop").count() == 2 and relational.linked(left, right, ["k"], "left").count() == 4
    with pytest.raises(relational.ContractError):
        only = spark.createDataFrame([("c", "operational")], "criterion string, section string")
        decisions.eligibility(only, spark.createDataFrame([("d", "c", True)], "dataset_id string, criterion string, value boolean"))


def test_contract_queries(spark):
    assert contracts.header_faults([" A", "b ", "B"], ["a", "c"]) == ["missing c", "repeated b"]
    assert contracts.rule_faults([{"id": "x", "repositories": ["r"], "filename_regex": "("}, {"id": "x", "repositories": ["r"], "filename_regex": "a"}]) == ["rule 0: pattern does not compile", "rule 1: id repeated"]
    assert contracts.search_faults({"a": ["t"]}, ["a", "b"], ["f"], []) == ["unknown facet f", "unknown group b"]
    rows = spark.createDataFrame([("S1", "e1"), ("S2", "e2"), ("S1", " ")], "study string, id string")
    assert contracts.foreign_rows(rows, "study", "S1", ["id"]).count() == 2
    assert contracts.bad_accessions(spark.createDataFrame([("GSM1",), ("gsm2",), ("GSE1",), (None,)], "a string"), "a", "GSM").count() == 2
    results = [(0.5, "pearson_r", 0.1, None, 12, None, "primary"), (1.5, "pearson_r", 0.1, None, 12, None, "primary"), (1.5, "logFC", 0.1, None, 12, None, "negative_control"), (None, "odd", 2.0, None, 0, "c", "x")]
    bad = contracts.result_faults(spark.createDataFrame(results, "effect double, effect_type string, p_value double, fdr double, n int, contrast string, role string")).collect()
    assert sorted(len(r["reasons"]) for r in bad) == [1, 1, 6]
    none = spark.createDataFrame([(0.5, "beta", None, None, None, None, "primary")], "effect double, effect_type string, p_value double, fdr double, n int, contrast string, role string")
    assert contracts.result_faults(none).first()["reasons"] == ["neither p nor fdr", "n below 1"]
    units = spark.createDataFrame([("u", "supportive", 0.5, "GSE1"), (" ", "maybe", 2.0, "X1")], "analysis_unit_id string, verdict string, confidence double, gse_id string")
    assert [len(r["reasons"]) for r in contracts.document_faults(units).collect()] == [4]
    with pytest.raises(relational.ContractError):
        contracts.fail(contracts.key_faults(rows, ["study"]), "study")


def test_registry_and_links(spark):
    links = spark.createDataFrame([(0, "g1", "SDY1", "GSE1", ["GSE2"], None), (1, "g2", "SDY1", "GSE3", None, ["GSE1"]), (2, "", "SDY9", None, None, None)], "ord int, group_id string, immport_accession string, geo_accession string, geo_subseries array<string>, accessions array<string>")
    assert {r["accession"]: r["group_id"] for r in relational.registry_groups(links).collect()} == {"SDY1": "g2", "GSE1": "g2", "GSE2": "g1", "GSE3": "g2"}
    pairs = spark.createDataFrame([("SDY1", "GSE2"), ("SDY1", "GSE3"), ("SDY1", "GSE9")], "immport_id string, geo_id string")
    assert {r["geo_id"]: r["group_id"] for r in relational.verified_link(pairs, links).collect()} == {"GSE2": "g1", "GSE3": "g2"}


def test_cohort_units(spark):
    rows = [("s1", c, f"{c}{i}", "Day 0", f"g{c}{i}") for c in ("A", "B") for i in range(3)] + [("s1", None, "x", "Day 0", "gx"), ("s2", "A", "p", "Day 7", "gp")]
    out = {(r["series"], r["unit_cohort"]): (len(r["gsms"]), r["n_left_out"]) for r in decisions.cohort_units(spark.createDataFrame(rows, "series string, cohort string, subject string, timepoint string, gsm string")).collect()}
    assert out == {("s1", "A"): (3, 1), ("s1", "B"): (3, 1), ("s2", None): (1, 0)}


def test_page_and_order(spark):
    frame = spark.range(250).select(F.col("id").alias("k"))
    page = relational.page(frame, ["k"], 200, 500).collect()
    assert len(page) == 50 and page[0]["total"] == 250 and page[0]["next_offset"] is None
    assert {r["k"]: r["position"] for r in relational.in_given_order(frame, "k", [5, 3]).collect()} == {5: 0, 3: 1}


def test_gates_of_a_report(spark):
    left_out = spark.createDataFrame([("GSE1", "match", "no days"), ("GSE2", " ", None)], "accession string, stage string, reason string")
    assert [(r["accession"], r["reasons"]) for r in contracts.left_out_faults(left_out).collect()] == [("GSE2", ["stage blank", "reason blank"])]
    probes = spark.createDataFrame([("p1", "GPL table", None), ("p2", "  ", "kinetics"), ("p3", None, None)], "probe_id string, confirmed_by string, evidence string")
    assert sorted(r["probe_id"] for r in contracts.unconfirmed(probes).collect()) == ["p2", "p3"]
