"""Text functions, file readers and sinks on fixtures of our own."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from sagebrush.functions import text as tx
from sagebrush.operators.relational import ContractError
from sagebrush.sinks import files as sinks
from sagebrush.sources import repository as repo
from sagebrush.sinks.store import SnapshotStore
from sagebrush.streaming import append_unseen


def test_sample_titles(spark):
    titles = {
        "Trial1 Subject ID 1901 Day 0": ("Trial 1", "1901", "Day 0"), "batch_3 participant P07 day-14": ("Batch 3", "P07", "Day 14"), "Subject 4 day -14": (None, "4", "Day -14"),
        "Subject 4 -3 hr": (None, "4", "Hour -3"), "Subject 4 time-3hr": (None, "4", "Hour 3"), "Donor 138 24 hours d7": (None, "138", "Day 7"), "nothing": (None, None, None), "": (None, None, None),
    }
    t = F.col("t")
    out = spark.createDataFrame([(k,) for k in titles], "t string").select("t", tx.cohort(t), tx.subject(t), tx.timepoint(t)).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == titles


def test_scalar_functions(spark):
    row = spark.createDataFrame([("days 3, 7 and 14; d80", "see acc=GSE456 and gse12", "NaN", " 4.5 ", "Hepatitis B vaccine", '{"a": {"b": [1, "x"]}}')], "a string, b string, c string, d string, e string, f string")
    r = row.select(
        tx.days_mentioned(F.col("a")).alias("days"), tx.accessions(F.col("b")).alias("acc"), tx.number(F.col("c")).alias("nan"), tx.number(F.col("d")).alias("num"), tx.longest_term(F.col("e"), ["hepatitis", "Hepatitis B"]).alias("long"),
        tx.whole_word(F.col("e"), "b").alias("word"), tx.whole_word(F.col("e"), "hep").alias("part"), tx.flattened(F.col("f")).alias("flat"), tx.series_directory(F.lit("GSE13485")).alias("dir"), tx.tri_state(F.lit("No")).alias("tri"),
        tx.listed(F.lit("a; b;;c")).alias("list"), tx.list_faults(F.lit("a;a"), F.lit(3)).alias("faults"), tx.preferred(F.lit(""), F.lit("r")).alias("pref"), tx.first_json(F.lit('x ```{"k": 1}```')).alias("json"), tx.repository_of(F.lit("sdy1")).alias("repo"),
        tx.contains_any(F.col("e"), ["VACCINE"]).alias("any"), tx.html_escape(F.lit("<&>")).alias("html"), tx.slug(F.lit("Trial 1!")).alias("slug"), tx.is_accession(F.lit(" gsm1 "), "GSM").alias("is"), tx.accession_numbers(F.lit("GSE10 9"), "GSE").alias("nums"),
    ).first()
    assert r["days"] == [3, 7, 14, 80] and r["acc"] == ["GSE12", "GSE456"] and r["nan"] is None and r["num"] == 4.5 and r["long"] == "Hepatitis B"
    assert r["word"] and not r["part"] and r["flat"] == "a b 1 x" and r["dir"] == "GSE13nnn" and r["tri"] is False and r["list"] == ["a", "b", "c"]
    assert r["faults"] == ["count", "duplicate"] and r["pref"] == "r" and r["json"] == '{"k": 1}' and r["repo"] == "immport" and r["any"] and r["html"] == "&lt;&amp;&gt;" and r["slug"] == "trial_1" and r["is"] and r["nums"] == [9, 10]


MATRIX = '!Series_geo_accession\t"GSE1"\n!Sample_geo_accession\t"GSM1"\t"GSM2"\n!Sample_platform_id\t"GPL1"\t"GPL1"\n!Sample_characteristics_ch1\t"a"\t"b"\n!Sample_characteristics_ch1\t"c"\t"d"\n!series_matrix_table_begin\n"ID_REF"\t"GSM1"\t"GSM2"\n"p1"\t8.05\tNA\n"p2"\t1\t2\n!series_matrix_table_end\n'


def test_series_matrix(spark, tmp_path):
    (tmp_path / "GSE1_series_matrix.txt.gz").write_bytes(gzip.compress(MATRIX.encode()))
    (tmp_path / "bad_series_matrix.txt").write_text(MATRIX.replace("!series_matrix_table_end\n", "").replace('"p2"', '"p1"').replace('"GSM1"\t"GSM2"\n"p1"', '"GSM2"\t"GSM1"\n"p1"'))
    m = repo.read_series_matrices(repo.binary_files(spark, str(tmp_path), "*matrix*")).cache()
    good = m.filter(F.col("path").contains("GSE1_"))
    assert good.filter("kind = 'error'").isEmpty()
    cells = {(r["probe_id"], r["gsm_accession"]): r["value"] for r in repo.expression(good).collect()}
    assert cells == {("p1", "GSM1"): 8.05, ("p1", "GSM2"): None, ("p2", "GSM1"): 1.0, ("p2", "GSM2"): 2.0}
    meta = {(r["gsm_accession"], r["attribute"], r["occurrence"]): r["value"] for r in repo.sample_metadata(good).collect()}
    assert meta[("GSM2", "characteristics_ch1", 1)] == "d" and meta[("GSM1", "platform_id", 0)] == "GPL1"
    faults = {r["value"] for r in m.filter("kind = 'error'").collect()}
    assert faults == {"columns differ from the header's samples", "probe blank or repeated", "no end marker"}
    assert sinks.wide(repo.expression(good), "probe_id", "gsm_accession", ["GSM1", "GSM2"], "value").count() == 2


def test_tables_from_directories_and_archives(spark, tmp_path):
    (tmp_path / "subject.txt").write_text(" SUBJECT_ACCESSION\tGENDER \tEXTRA\n S1 \tF\tx\nS2\t\ty\n")
    rows = repo.read_table(spark, str(tmp_path / "subject.txt"), ["subject_accession", "gender"]).collect()
    assert [tuple(r) for r in rows] == [("S1", "F"), ("S2", None)]
    with pytest.raises(ContractError):
        repo.read_table(spark, str(tmp_path / "subject.txt"), ["absent"])
    with zipfile.ZipFile(tmp_path / "SDY1-DR5_Tab.zip", "w") as z:
        z.writestr("SDY1-DR5_Tab/Tab/arm.txt", "ARM\tNAME\nA1\tone\nA2\n")
        z.writestr("SDY1-DR5_Tab/other.txt", "x")
    zipped = repo.read_zip_tables(repo.binary_files(spark, str(tmp_path), "*.zip"))
    assert [(r["arm"], r["name"]) for r in repo.table_of(zipped, "arm", ["arm", "name"]).collect()] == [("A1", "one")]
    assert zipped.filter("error = 'ragged row'").count() == 1


def test_platform_genes_and_results(spark, tmp_path):
    (tmp_path / "GPL1.soft.gz").write_bytes(gzip.compress(b"^PLATFORM\n!platform_table_begin\nID\tSymbol\np1\tTNF\n!platform_table_end\nrest\n"))
    p = repo.read_platforms(repo.binary_files(spark, str(tmp_path), "*.soft.gz")).first()
    assert p["probe_id"] == "p1" and p["attrs"]["Symbol"] == "TNF"
    genes = spark.createDataFrame([(0, "TNF", "TNFA|DIF", None), (1, "DIF", None, "TNFA")], "row_no int, symbol string, alias_symbol string, prev_symbol string")
    assert {r["name"]: r["symbol"] for r in repo.gene_index(genes).collect()} == {"TNF": "TNF", "TNFA": "TNF", "DIF": "TNF"}
    raw = spark.createDataFrame([("a", "1.5", "0.01", "NA")], "_c0 string, logFC string, `P.Value` string, `adj.p.val` string")
    r = repo.normalize_results(raw).first()
    assert (r["feature_id"], r["effect"], r["p_value"], r["fdr"], r["mean_expression"]) == ("a", 1.5, 0.01, None, None)
    with pytest.raises(ContractError):
        repo.normalize_results(spark.createDataFrame([("a", 1.0)], "what string, logFC double"))
    both = spark.createDataFrame([("sym", "probe", 1.0)], "gene string, probe_id string, logFC double")
    assert repo.normalize_results(both).first()["feature_id"] == "probe"
    with pytest.raises(ContractError):
        repo.normalize_results(spark.createDataFrame([(" ", 1.0)], "ID string, logFC double"))


def test_selection_of_sources(spark):
    found = spark.createDataFrame([("SDY1", 5, "z", True), ("SDY1", 6, "y", True), ("SDY1", 6, "x", False), ("SDY2", 1, "w", True)], "accession string, release int, path string, is_zip boolean")
    assert {r["accession"]: r["path"] for r in repo.newest_sources(found).collect()} == {"SDY1": "x", "SDY2": "w"}
    entries = spark.createDataFrame([("SDY1", "SDY1-DR5_Tab.zip"), ("SDY1", "SDY1-DR11_Tab.zip"), ("SDY1", "notes.txt")], "study string, name string")
    top = repo.newest_manifest(entries, r"^SDY\d+-DR(\d+)_Tab\.zip$").first()
    assert top["name"] == "SDY1-DR11_Tab.zip" and top["unique"]
    twice = spark.createDataFrame([("u", "p", 0), ("u", "q", 1), ("", "q", 2), (None, "q", 3)], "fileUUID string, path string, ord int")
    assert sorted(r["ord"] for r in repo.distinct_entries(twice, "ord").collect()) == [0, 2]
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "name string, at int, status string")
    assert {r["name"]: r["status"] for r in repo.latest_artifacts(log, ["name"], "at").collect()} == {"a": "new", "b": "x"}
    copies = spark.createDataFrame([("t", "legacy", "1"), ("t", "canonical", "2"), ("s", "study", "1"), ("s", "study", "1")], "name string, place string, content string")
    assert {r["name"]: (r["place"], r["alike"]) for r in repo.resolve_bundle(copies).collect()} == {"t": ("canonical", False), "s": ("study", True)}
    assert [r["gse_accession"] for r in repo.series_links(spark.createDataFrame([("acc=GSE456, gse9",)], "value string")).collect()] == ["GSE456", "GSE9"]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(2, None), (1, "a")], "k int, v string")
    sinks.write_tsv(frame.coalesce(1), str(tmp_path / "t"), ["k", "v"], ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text.replace("k\tv\n", "") == "1\ta\n2\t\n"
    sinks.write_tsv(spark.createDataFrame([(10,), (9,), (100,)], "k int").coalesce(1), str(tmp_path / "o"), ["k"], ["k"])
    assert "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))).replace("k\n", "") == "9\n10\n100\n"
    assert sinks.content_hash(frame) == sinks.content_hash(frame.orderBy("k").repartition(3)) != sinks.content_hash(frame.limit(1))
    record = sinks.provenance(frame, "t")
    sinks.append_log(spark, record, str(tmp_path / "log"))
    sinks.append_log(spark, record, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and record["rows"] == 2
    sinks.split_ready(frame.withColumn("ready", F.col("v").isNotNull()), "ready", str(tmp_path / "lists"))
    assert spark.read.json(str(tmp_path / "lists/ready")).count() == 1
    assert "| 1 | a |" in sinks.report(frame, "Title")


def test_stream_appends_each_key_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(rows, "k int, v string").write.mode("append").parquet(source)
        append_unseen(spark.readStream.schema("k int, v string").parquet(source), store, ["k"], str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["k"] for r in SnapshotStore(spark, store, ["k"]).read().collect()) == [1, 2, 3]


def test_series_type(spark):
    rows = spark.createDataFrame([("This  SuperSeries is\n composed of the SubSeries",), ("A series",), (None,)], "s string")
    assert [r[0] for r in rows.select(tx.series_type(F.col("s"))).collect()] == ["superseries", "series", "series"]
