"""Study links of folders and archives, rollups of steps, requested metadata, names."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sagebrush.functions.text import same_name
from sagebrush.operators.relational import ContractError, requested_metadata, status_rollup
from sagebrush.sources.repository import binary_files, study_links

GOOD = "name\tstudy_accession\tvalue\nGEO\tsdy{0}\tGSE7, gse5 GSE7\nother\tSDY{0}\tnone\n"


def test_study_links(spark, tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as out:
            for member, text in members.items():
                out.writestr(member, text)

    for n, text in ((1, GOOD.format(1)), (2, GOOD.format(9)), (3, "name\tvalue\n"), (5, "name\tstudy_accession\tvalue\n")):
        (tmp_path / f"SDY{n}").mkdir()
        (tmp_path / f"SDY{n}" / "study_link.txt").write_text(text)
    (tmp_path / "SDY4").mkdir()
    archive("SDY6.zip", {"a/Tab/study_link.txt": GOOD.format(6), "a/study_link.txt": "x"})
    archive("SDY7.zip", {"a/Tab/study_link.txt": GOOD.format(7), "b/Tab/study_link.txt": GOOD.format(7)})
    archive("SDY8.zip", {"a/study_link.txt": GOOD.format(8)})
    (tmp_path / "SDY9.zip").write_bytes(b"PK broken")
    sources = spark.createDataFrame([(f"SDY{n}", 2, n > 5, f"file:{tmp_path}/SDY{n}" + (".zip" if n > 5 else "")) for n in range(1, 10)], "accession string, release int, is_zip boolean, path string")
    links, status = study_links(sources, binary_files(spark, str(tmp_path)))
    assert sorted((r.study_accession, r.gse_accession, r.link_name, r.data_release) for r in links.collect()) == [(s, g, "GEO", 2) for s in ("SDY1", "SDY6") for g in ("GSE5", "GSE7")]
    found = {r.study_accession: (r.status, r.n_faults, r.first_fault) for r in status.collect()}
    assert found["SDY1"] == found["SDY5"] == found["SDY6"] == ("success", 0, None)
    assert found["SDY2"] == ("failed", 2, "row 1 of SDY9") and found["SDY3"] == ("failed", 1, "missing study_accession")
    assert found["SDY4"] == ("missing", 0, None) and found["SDY8"] == ("missing", 0, "missing")
    assert found["SDY7"] == ("failed", 1, "several members") and found["SDY9"] == ("failed", 1, "not readable")


def test_rollups(spark):
    sets = {1: ["cached"], 2: ["cached", "success"], 3: ["failed"], 4: ["failed", "source_missing"], 5: ["success", "source_missing"], 6: ["success", "failed"], 7: [None], 8: ["source_missing"]}
    df = spark.createDataFrame([(k, s) for k, v in sets.items() for s in v], "k int, s string")
    one = lambda kind: "".join(r.status[0] for r in status_rollup(df, ["k"], "s", kind).orderBy("k").collect())
    assert one("steps") == "csffppff" and one("failures") == "csfpspss" and one("run") == "ssfppppp"
    with pytest.raises(ContractError):
        status_rollup(df, ["k"], "s", "other")


def test_requested_metadata(spark):
    rows = [("GSM1", "title", 0, 1, "a"), ("GSM1", "x", 1, 3, "c"), ("GSM1", "x", 0, 2, "b"), ("GSM2", "title", 0, 1, "d")]
    meta = spark.createDataFrame(rows, "gsm_accession string, attribute string, occurrence int, attribute_order int, value string")
    got = requested_metadata(meta, ["GSM2", " GSM1 "]).orderBy("sample_position", "position").collect()
    assert [(r.sample_position, r.position, r.value) for r in got] == [(0, 1, "d"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c")]
    assert sorted(r.value for r in requested_metadata(meta, ["GSM1"], ["x"]).collect()) == ["b", "c"]
    for samples, attributes in (([], None), (["GSM1", "GSM1"], None), (["GSM3"], None), (["GSM1"], [" "]), (["GSM1"], ["y"]), (["GSM1"], [])):
        with pytest.raises(ContractError):
            requested_metadata(meta, samples, attributes)


def test_same_name(spark):
    names = spark.createDataFrame([(t,) for t in (" STRASSE", "Straße", "Élan", "elan", "", None)], "t string")
    assert [r[0] for r in names.select(same_name(F.col("t"), ["straße", "éLAN "])).collect()] == [True, True, True, False, False, False]
