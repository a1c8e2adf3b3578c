"""Criteria with confidence, lenient readers, keys and lists of independence."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sagebrush.functions import text as tx
from sagebrush.operators import criteria, decisions
from sagebrush.operators.relational import ContractError
from sagebrush.sinks import files
from sagebrush.sources import repository


def test_vaccine_study_rules(spark):
    rules = criteria.vaccine_study_rules(("yf-17d", "yellow fever vaccine"), ("eif2ak4", "gcn2"), ("cd8", "cytotoxic t cell"))
    assert len(rules) == 9
    texts = {
        "a": "Human volunteers got YF-17D; gene expression of EIF2AK4, CD8 tetramer frequency at baseline and day 7",
        "b": "Microarray of mice, CD8 cells at day 60",
        "c": None,
        "d": "d0 and D-28",
    }
    got = criteria.evidence_items(spark.createDataFrame(list(texts.items()), "id string, t string"), rules, "id", "geo", "t").collect()
    by = {(r["dataset_id"], r["criterion"]): (r["value"], r["confidence"]) for r in got}
    assert len(got) == 36 and all(r["sources"] == ["geo"] and r["text"] for r in got)
    of = lambda d: [by[d, r.criterion] for r in rules]
    yes, low, medium = (True, "high"), (None, "low"), (None, "medium")
    assert of("a") == [yes, yes, yes, yes, medium, yes, low, yes, low]
    assert of("b") == [low, low, yes, medium, low, medium, low, yes, low]
    assert of("c") == [low] * 9 and of("d")[5] == yes
    with pytest.raises(ContractError, match="last case"):
        criteria.CriterionRule("x", (criteria.Case(criteria.Says(("a",)), True, "high", "s"),))
    with pytest.raises(ContractError, match="two rules"):
        criteria.evidence_items(spark.createDataFrame([("a", "b")], "id string, t string"), [rules[0], rules[0]], "id", "geo", "t")


def test_table_rules(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "study string, subject string, day int")
    predictor = rows(("s1", "a", 0), ("s1", "b", 3), ("s2", "a", 7), ("s3", "x", 1), ("s4", "x", None))
    outcome = rows(("s1", "a", 28), ("s2", "a", 7), ("s2", "b", 5), ("s3", "y", 9), ("s5", "y", 9))
    totals = criteria.table_totals(predictor, outcome, "study", "subject", "day")
    got = criteria.evidence_items(totals, criteria.TABLE_RULES, "study", "tables").collect()
    of = lambda c: {r["dataset_id"]: (r["value"], r["confidence"]) for r in got if r["criterion"] == c}
    assert of("participant_linkage") == {"s1": (True, "high"), "s2": (True, "medium"), "s3": (False, "high"), "s4": (None, "low"), "s5": (None, "low")}
    assert of("timepoints") == {"s1": (True, "high"), "s2": (False, "high"), "s3": (True, "high"), "s4": (None, "low"), "s5": (None, "low")}


def test_eligibility_without_all_pairs(spark):
    spec = spark.createDataFrame([("human", "scientific"), ("timed", "scientific"), ("open", "operational")], "criterion string, section string")
    rows = [("a", "human", True), ("a", "timed", True), ("a", "open", True), ("b", "human", False), ("c", "human", True), ("d", "human", True), ("d", "timed", True), ("d", "open", None), ("e", "other", True), ("f", "human", True), ("f", "timed", True), ("f", "open", False)]
    out = decisions.eligibility(spec, spark.createDataFrame(rows, "dataset_id string, criterion string, value boolean"))
    got = {r["dataset_id"]: (r["eligibility"], r["execution"], r["failed"], r["unresolved"]) for r in out.collect()}
    assert got == {
        "a": ("eligible", "ready", [], []),
        "b": ("excluded", "not_applicable", ["human"], ["open", "timed"]),
        "c": ("uncertain", "needs_scientific_resolution", [], ["open", "timed"]),
        "d": ("eligible", "needs_data_check", [], ["open"]),
        "e": ("uncertain", "needs_scientific_resolution", [], ["human", "open", "timed"]),
        "f": ("eligible", "blocked", [], []),
    }


def test_independence_fields(spark):
    rows = [(None, "", "Smith", ["GPL2", "GPL1"]), ("L", "C", "S", []), (None, None, None, None), (None, "C", None, ["GPL9", None])]
    df = spark.createDataFrame(rows, "lab string, contact string, submitter string, platform array<string>").withColumns({c: F.lit(None).cast("string") for c in ("superseries", "bioproject", "study", "program")}).withColumn("accession", F.lit("GSE1"))
    got = [r[0] for r in decisions.independence_fields(df).select(decisions.independence_key()).collect()]
    assert got == ["lab:Smith|platform:GPL1,GPL2", "lab:L|platform:?", "accession:GSE1", "lab:C|platform:GPL9"]


def test_resolution_of_all_queries(spark):
    candidates = spark.createDataFrame([("q1", 1, 1, "f1")], "query string, stage int, strength int, feature string")
    out = decisions.resolve_all(spark.createDataFrame([("q1",), ("q2",)], "query string"), candidates)
    assert {r["query"]: (r["features"], r["status"]) for r in out.collect()} == {"q1": (["f1"], "candidate"), "q2": ([], "needs_review")}


@pytest.mark.parametrize(
    ("text", "days"),
    [
        ("days 3, 7 and 14; d80", [3, 7, 14, 80]),
        ("Day 0 / day 28", [0, 28]),
        ("day-7, d_3, day:5", [3, 5, 7]),
        ("days 1/2/3 later", [1, 2, 3]),
        ("day 7 post, 12 people", [7]),
        ("d7 and 9", [7]),
        ("no day, 5", []),
        ("birthday 5 holidays", []),
        ("day 12345678901", []),
        ("", []),
        ("DAYS 28and 56", [28, 56]),
    ],
)
def test_days_mentioned(spark, text, days):
    assert spark.createDataFrame([(text,)], "t string").select(tx.days_mentioned(F.col("t"))).first()[0] == days


def test_lenient_zip_and_results(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/t.txt", b"A\tB\n1\t\xff2\n3\n4\t5\t6\n")
        z.writestr("Tab/t.txt", "A\tB\n9\t9\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("other.txt", "A\n1\n")
    got = repository.read_zip_table(repository.binary_files(spark, str(tmp_path)), "t.txt").orderBy("row_no").collect()
    assert [r["fields"] for r in got] == [{"A": "1", "B": "�2"}, {"A": "3", "B": None}, {"A": "4", "B": "5"}]
    (tmp_path / "r.csv").write_text("ID,logFC,P.Value\np1,1.5,0.01\n")
    (tmp_path / "r.tsv").write_text("gene\testimate, x\testimate\np1\ta,b\t2.5\n")
    assert repository.read_results(spark, str(tmp_path / "r.csv")).first()["effect"] == 1.5
    assert repository.read_results(spark, str(tmp_path / "r.tsv")).first()["effect"] == 2.5


def test_series_folders_and_matrix_csv(spark, tmp_path):
    paths = ["/c/GSE1/matrix/GSE1_series_matrix.txt.gz", "/c/GSE1/GSE1-GPL5_series_matrix.txt", "/c/GSE2/GSE1_series_matrix.txt", "/c/other/GSE3_series_matrix.txt", "/c/GSE1/GSE2/GSE2_series_matrix.txt.gz", "/c/GSE1/GSE1_family.soft.gz"]
    got = repository.series_matrices(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sorted((r["accession"], r["path"]) for r in got) == [("GSE1", paths[1]), ("GSE1", paths[0]), ("GSE2", paths[4])]
    path = files.write_matrix_csv(spark.createDataFrame([("p2", 1.0), ("p1", None)], "ID_REF string, GSM1 double"), str(tmp_path), "GSE1-GPL5")
    assert path.endswith("/GSE1_GPL5") and spark.read.csv(path, header=True).collect() == [("p1", None), ("p2", "1.0")]
