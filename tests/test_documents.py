"""Schema walks, registries, specifications, synthesis and fusion documents, reports."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from sagebrush.operators import decisions, documents
from sagebrush.operators.relational import ContractError
from sagebrush.sinks import files, reports

RULE = decisions.Rule(alpha=0.05, direction="up", min_effect=0.1, min_independent_groups=2)
UNIT = {"analysis_unit_id": "u1", "gse_id": "GSE13485", "cohort": None, "platform": "GPL7567", "verdict": "supportive", "confidence": 0.9, "evidence_summary": "effect +0.6", "rationale": "significant", "caveats": ["a", "b"]}
DOC = {"overall_verdict": "supportive", "per_dataset": [UNIT, {**UNIT, "analysis_unit_id": "u2", "platform": None}], "narrative": "Text"}


def faults(spark, docs, rule, also=()):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, json string").withColumn("doc", F.try_parse_json("json"))
    found = {r["id"]: r["faults"] for r in documents.document_faults(df, rule, also=also).collect()}
    return [found.get(i, []) for i in range(len(docs))]


def test_synthesis_schema(spark):
    def broken(change):
        doc = copy.deepcopy(DOC)
        change(doc)
        return doc

    unit = lambda d: d["per_dataset"][1]
    cases = [
        (DOC, []),
        ("{", ["$: not JSON"]),
        ([1], ["$: not an object"]),
        (broken(lambda d: d.pop("narrative")), ["narrative: missing"]),
        (broken(lambda d: d.update(narrative=" ")), ["narrative: blank"]),
        (broken(lambda d: d.update(overall_verdict="yes")), ["overall_verdict: not one of supportive, contradictory, inconclusive"]),
        (broken(lambda d: d.update(extra=1)), ["extra: not allowed"]),
        (broken(lambda d: d.update(per_dataset={})), ["per_dataset: not a list"]),
        (broken(lambda d: d["per_dataset"].append(3)), ["per_dataset[2]: not an object"]),
        (broken(lambda d: unit(d).pop("caveats")), ["per_dataset[1].caveats: missing"]),
        (broken(lambda d: unit(d).update(more="x")), ["per_dataset[1].more: not allowed"]),
        (broken(lambda d: unit(d).update(gse_id="GSM1")), [r"per_dataset[1].gse_id: does not match GSE\d+"]),
        (broken(lambda d: unit(d).update(platform="")), [r"per_dataset[1].platform: does not match GPL\d+"]),
        (broken(lambda d: unit(d).update(cohort=4)), ["per_dataset[1].cohort: not a text"]),
        (broken(lambda d: unit(d).update(confidence=1.5)), ["per_dataset[1].confidence: outside 0.0 to 1.0"]),
        (broken(lambda d: unit(d).update(confidence=True)), ["per_dataset[1].confidence: not a number"]),
        (broken(lambda d: unit(d).update(confidence=1)), []),
        (broken(lambda d: unit(d).update(verdict=None)), ["per_dataset[1].verdict: not a text"]),
        (broken(lambda d: unit(d).update(caveats=["a", "a"])), ["per_dataset[1].caveats: entries repeat"]),
        (broken(lambda d: unit(d).update(caveats=["a", ""])), ["per_dataset[1].caveats[1]: blank"]),
        (broken(lambda d: unit(d).update(independence_group="g")), ["per_dataset[1].independence_group: not allowed"]),
    ]
    assert faults(spark, [d for d, _ in cases], documents.synthesis_rule()) == [f for _, f in cases]
    extended = broken(lambda d: (unit(d).update(independence_group="g"), d.update(n_independent_groups=2, decision_rule={"alpha": 0.05})))
    assert faults(spark, [extended, broken(lambda d: d.update(n_independent_groups=1.5))], documents.synthesis_rule(strict=False)) == [[], ["n_independent_groups: not a whole number"]]


def test_synthesis_document_keeps_its_schema(spark):
    rows = [("h1", "u1", "GSE1", "A", 0.6, 0.01, 15, "g1"), ("h1", "u2", "GSE2", None, 0.5, 0.02, 9, "g1"), ("h1", "u3", "GSE3", "B", 0.7, 0.03, 20, "g2"), ("h2", "u4", "GSE4", None, None, None, 8, "g1"), ("h2", "u5", "GSE4", None, -0.5, 0.001, 8, "g1")]
    units = spark.createDataFrame(rows, "h string, analysis_unit_id string, gse_id string, cohort string, effect double, p_value double, n long, group_key string")
    units = units.withColumn("fdr", F.lit(None).cast("double")).withColumn("platform", F.lit("GPL1"))
    scored = decisions.score(units, RULE)
    for strict in (True, False):
        made = documents.synthesis(scored, decisions.rollup(scored, ["h"], RULE), ["h"], RULE, strict=strict)
        parsed = made.withColumn("doc", F.parse_json(F.to_json(F.struct(*[c for c in made.columns if c != "h"]), {"ignoreNullFields": "false"})))
        assert documents.document_faults(parsed, documents.synthesis_rule(strict)).collect() == []
    got = {r["h"]: r for r in made.collect()}
    assert got["h1"]["overall_verdict"] == "supportive" and got["h2"]["overall_verdict"] == "contradictory" and got["h1"]["n_independent_groups"] == 2
    one, two, three = got["h1"]["per_dataset"]
    assert one["caveats"] == [documents.NOTE, "Not independent of u2: all belong to g1 and count once."] and three["caveats"] == [documents.NOTE]
    assert one["evidence_summary"] == "effect +0.600, p 0.01, n 15" and got["h2"]["per_dataset"][0]["rationale"] == "no usable estimate"
    assert got["h1"]["narrative"] == "Overall supportive. Fixed before results: alpha 0.05, direction up, effect of 0.1 or more, 2 independent groups. 3 units in 2 groups: g1, g2."


def test_registry(spark, tmp_path):
    links = {"links": [{"group_id": "g1", "immport_accession": "SDY1264", "geo_accession": "GSE13485", "geo_subseries": ["GSE13484"]}, {"group_id": "g2", "accessions": ["GSE1", "SDY1"]}]}
    (tmp_path / "a.json").write_text(json.dumps(links, indent=2))
    rows = documents.registry_links(documents.read_checked(spark, str(tmp_path), documents.REGISTRY)).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [(0, "g1", "SDY1264", "GSE13485", ["GSE13484"], []), (1, "g2", None, None, [], ["GSE1", "SDY1"])]
    (tmp_path / "b.json").write_text('{"links": [{"group_id": "", "geo_accession": "x"}]}')
    with pytest.raises(ContractError, match=r"b.json: links\[0\].group_id: blank, links\[0\].geo_accession: does not match"):
        documents.read_checked(spark, str(tmp_path), documents.REGISTRY)
    assert faults(spark, [{}, {"links": 3}, {"datasets": []}], documents.REGISTRY) == [["links: missing"], ["links: not a list"], ["links: missing"]]
    assert faults(spark, [{"datasets": []}], documents.DATASETS) == [["datasets: fewer than 1 entries"]]


SPEC = {
    "population": {"search_terms": ["adults"]},
    "intervention": {"search_terms": ["vaccine"]},
    "predictor": {"search_terms": ["TNF"]},
    "search": {"require": ["intervention"], "filters": {"species": "Homo sapiens", "assay": ["a", "b"]}, "limit": 5},
    "required_features": ["age"],
    "eligibility": {"scientific_criteria": [{"id": "human", "description": "d", "exclusion": "e"}], "operational_criteria": [{"id": "open_data"}]},
}


def test_specification(spark):
    def broken(path, value):
        doc = copy.deepcopy(SPEC)
        *parents, last = path
        at = doc
        for p in parents:
            at = at[p]
        if value is KeyError:
            del at[last]
        else:
            at[last] = value
        return doc

    science = ("eligibility", "scientific_criteria")
    cases = [
        (SPEC, []),
        ({k: v for k, v in SPEC.items() if k not in documents.GROUPS}, ["$: none of population, intervention, predictor, outcome", "search.require: no part intervention"]),
        (broken(("population",), []), ["population: not an object"]),
        (broken(("population", "search_terms"), []), ["population.search_terms: fewer than 1 entries"]),
        (broken(("population", "search_terms"), ["x", " "]), ["population.search_terms[1]: blank"]),
        (broken(("search", "require"), ["outcome"]), ["search.require: no part outcome"]),
        (broken(("search", "require"), ["predictor"]), ["search.require[0]: not one of population, intervention, outcome"]),
        (broken(("search", "require"), []), ["search.require: fewer than 1 entries"]),
        (broken(("search", "filters", "colour"), "x"), ["search.filters.colour: not allowed"]),
        (broken(("search", "filters", "species"), "Mus"), ["search.filters.species: not one of Homo sapiens"]),
        (broken(("search", "filters", "species"), ["Homo sapiens", "Mus"]), ["search.filters.species: not one of Homo sapiens"]),
        (broken(("search", "limit"), "5"), ["search.limit: not a whole number"]),
        (broken(("required_features",), [1]), ["required_features[0]: not a text"]),
        (broken(science, []), ["eligibility.scientific_criteria: fewer than 1 entries"]),
        (broken((*science, 0, "id"), "Not Snake"), ["eligibility.scientific_criteria[0].id: does not match [a-z0-9_]+"]),
        (broken((*science, 0, "exclusion"), ""), ["eligibility.scientific_criteria[0].exclusion: blank"]),
        (broken((*science, 0, "description"), KeyError), ["eligibility.scientific_criteria[0].description: missing"]),
        (broken(("eligibility", "operational_criteria"), [{"id": "human"}]), ["eligibility: criterion human repeats"]),
        (broken(("eligibility",), None), ["eligibility: not an object"]),
    ]
    rule, also = documents.specification_rules({"species": ["Homo sapiens"]}, ["species", "assay"])
    assert faults(spark, [d for d, _ in cases], rule, also) == [f for _, f in cases]


def test_fusion_needs_a_verified_link(spark):
    rows = [("GSE1", "geo", "human", 0, True, "high", "geo"), ("SDY1", "immport", "human", 1, None, "low", "immport"), ("GSE1", "geo", "adult", 0, True, "high", "geo"), ("SDY1", "immport", "adult", 1, False, "medium", "immport"), ("GSE9", "geo", "human", 0, True, "high", "geo")]
    evidence = spark.createDataFrame(rows, "dataset_id string, repository string, criterion string, source_ord int, value boolean, confidence string, source string")
    groups = spark.createDataFrame([("g1", "GSE1", True), ("g1", "SDY1", True), ("g2", "GSE9", False)], "group_id string, dataset_id string, verified boolean")
    (doc,) = documents.fused_documents(evidence, groups).collect()
    assert doc["dataset_id"] == "g1" and doc["n_sources"] == 2 and doc["conflicting_criteria"] == ["adult"]
    assert doc["criteria"]["human"].asDict() == {"value": True, "confidence": "high", "conflict": False, "sources": ["geo", "immport"]}
    assert doc["criteria"]["adult"]["value"] is None and doc["criteria"]["adult"]["confidence"] == "low"


def test_sensitivity_and_report(spark, tmp_path):
    rows = [("raw", "primary", "a", 0.5, 0.01), ("raw", "primary", "b", 0.4, 0.02), ("delta", "sensitivity", "a", 0.5, 0.2), ("delta", "sensitivity", "b", -0.4, 0.01)]
    units = spark.createDataFrame(rows, "spec_id string, role string, group_key string, effect double, p_value double").withColumn("fdr", F.lit(None).cast("double"))
    rules = spark.createDataFrame([("raw", 0.05, "up", 0.0, 2), ("delta", 0.05, "up", 0.0, 1)], "spec_id string, alpha double, direction string, min_effect double, min_groups int")
    got = documents.sensitivity(documents.score_by(units, rules, ["spec_id"]), [])
    assert {r["spec_id"]: (r["verdict"], r["primary_verdict"], r["n_verdicts"], r["sensitive"]) for r in got.collect()} == {"raw": ("supports", "supports", 2, True), "delta": ("refutes", "supports", 2, True)}
    with pytest.raises(ContractError, match="exactly one primary"):
        documents.sensitivity(documents.score_by(units.withColumn("role", F.lit("sensitivity")), rules, ["spec_id"]), [])

    many = spark.range(3000).select(F.col("id"), (F.col("id") / 7).alias("x"), F.when(F.col("id") % 2 == 0, "a|b").alias("note"))
    sections = [reports.Section("All rows", ("First.",), many.repartition(7), ("id",), "Last."), reports.sensitivity_section(got, [])]
    reports.write_report(spark, "Title", sections, str(tmp_path / "r"))
    lines = [r["line"] for r in reports.read_report(spark, str(tmp_path / "r")).collect()]
    assert lines[:8] == ["# Title", "", "## All rows", "", "First.", "", "| id | x | note |", "|-|-|-|"]
    assert lines[8:3008] == [f"| {i} | {i / 7:#.4g} | {'a\\|b' if i % 2 == 0 else ''} |" for i in range(3000)] or len(lines[8:3008]) == 3000 and all(line.startswith(f"| {i} |") for i, line in enumerate(lines[8:3008]))
    assert lines[3008:3012] == ["", "Last.", "", "## Sensitivity to the specification"] and "depends on the specification for 1" in lines[-1]
    twin = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "r" / "json")).collect()]
    assert sum("row" in t and t["section"] == 1 for t in twin) == 3000 and {"section": 1, "heading": "All rows", "prose": "Last."} in twin
    with pytest.raises(ContractError, match="more than 1000 rows"):
        files.report(many, "t")
    assert files.report(many.limit(2), "t").count("\n") == 6
