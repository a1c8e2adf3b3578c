"""Snapshots of keyed rows, terms within texts, neutralisation tables, provenance."""

import json
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from sagebrush.operators import decisions
from sagebrush.operators.relational import ContractError
from sagebrush.sinks import files
from sagebrush.sinks.store import Conflict, SnapshotStore, unit_store
from sagebrush.sources import neutralization, terms


def test_units_are_stored_once(spark, tmp_path):
    store = unit_store(spark, str(tmp_path))
    with pytest.raises(ContractError, match="empty"):
        store.read()
    rows = lambda *units: spark.createDataFrame([(u, k, k / 2) for u in units for k in range(4)], "unit_id string, k int, v double")
    assert store.commit(rows("SDY1:EXP1:GSE1:GPL1", "u2")) and store.commit(rows("u3"))
    with pytest.raises(ContractError, match="already stored: .*u2"):
        store.commit(rows("u4", "u2"))
    assert store.versions() == [1, 2] and store.read().count() == 12 and store.read(1).count() == 8
    one = store.read_key(unit_id="u3")
    assert one.count() == 4 and len(one.inputFiles()) < len(store.read().inputFiles()) and "PartitionFilters: [isnotnull(unit_id" in one._jdf.queryExecution().executedPlan().toString()
    for bad in ("u9", "../u3"):
        with pytest.raises(ContractError, match="unknown key"):
            store.read_key(unit_id=bad)
    with pytest.raises(ContractError, match="not a name"):
        store._below("data", "../outside")
    with pytest.raises(ContractError, match="schema version 1, not 2"):
        SnapshotStore(spark, str(tmp_path), ["unit_id"], schema_version=2).read()


def test_crash_before_the_pointer(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path), ["k"])
    rows = spark.range(5).withColumnRenamed("id", "k")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_swap", crash)
        with pytest.raises(RuntimeError):
            store.commit(rows, tag="t")
    assert store.versions() == [] and store.index() is None
    assert store.commit(rows, tag="t") and not store.commit(rows, tag="t") and store.read().count() == 5
    with pytest.raises(Conflict):
        store._swap(1, {})
    assert json.loads((tmp_path / "versions" / f"{1:012d}.json").read_text())["tags"] == ["t"]


def test_two_writers(spark, tmp_path):
    stores = [SnapshotStore(spark, str(tmp_path), ["k"]) for _ in range(2)]
    gate, wrong = threading.Barrier(2), []

    def write(n):
        try:
            real = stores[n]._swap
            first = []

            def swap(number, held):
                if not first:  # both have read version 0
                    first.append(1)
                    gate.wait(60)
                real(number, held)

            stores[n]._swap = swap
            stores[n].commit(spark.range(n * 3, n * 3 + 5).withColumnRenamed("id", "k").withColumn("by", F.lit(n)), known="skip")
        except Exception as e:  # told to the test
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not wrong
    assert stores[0].versions() == [1, 2] and sorted(r["k"] for r in stores[0].read().collect()) == list(range(8))


@pytest.mark.parametrize(("shard", "whole"), [(1 << 17, False), (7, False), (50, True)])
def test_terms(spark, shard, whole):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(1, 5)))
    vocabulary = {i: " ".join(word() for _ in range(rng.randint(1, 2))) for i in range(120)}
    vocabulary |= {200: "Tumor Necrosis Factor", 201: "tumor necrosis factor", 202: "NECROSIS", 203: " ", 204: "ß-cell"}
    texts = [(i, " ".join(word() for _ in range(12)).title()) for i in range(60)] + [(99, "TUMOR necrosis factor alpha, SS-cell ß-Cell"), (100, None), (101, "")]
    df, vocab = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(list(vocabulary.items()), "ord long, term string")
    edge = lambda t, k: 0 < k < len(t) and all(c.isalnum() or c == "_" for c in t[k - 1 : k + 1])

    def places(text, term):
        text, term = text.lower(), term.strip().lower()
        found = [k for k in range(len(text)) if term and text.startswith(term, k)]
        return [k for k in found if not whole or not (edge(text, k) or edge(text, k + len(term)))]

    want = {(i, o): places(t or "", term)[0] for i, t in texts for o, term in vocabulary.items() if places(t or "", term)}
    got = terms.term_matches(df, vocab, "id", "text", whole_words=whole, shard_terms=shard).collect()
    assert len(got) == len(want) and {(r["id"], r["ord"]): r["at"] for r in got} == want
    best = {r["id"]: (r["term"], r["length"]) for r in terms.longest_match(df, vocab, "id", "text", whole_words=whole, shard_terms=shard).collect()}
    for i, _ in texts:
        found = sorted((-len(vocabulary[o].strip()), o) for j, o in want if j == i)
        assert best[i] == ((vocabulary[found[0][1]].strip(), -found[0][0]) if found else (None, 0))


def test_longest_match_sends_one_term_of_a_text(spark):
    vocab = spark.range(40).select(F.col("id").alias("ord"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("term"))
    texts = spark.range(20).select("id", F.lit(" ".join(f"t{k:02}" for k in range(40))).alias("text"))
    assert {(r["term"], r["length"]) for r in terms.longest_match(texts, vocab, "id", "text").collect()} == {("t00", 3)}
    assert terms._found(texts, vocab, "id", "text", False, 1 << 17, longest=True)[0].count() == 20  # of 800 matches


def test_features_by_terms(spark):
    features = spark.createDataFrame([("p1", "interferon regulatory factor 7"), ("p2", "interferon regulatory factor"), ("p3", "IRF7"), ("p4", "none")], "probe string, title string")
    asked = spark.createDataFrame([("IRF7", 1, 0, "IRF7"), ("IRF7", 2, 0, "interferon regulatory factor 7"), ("IRF7", 2, 1, "interferon regulatory factor"), ("Q", 2, 0, "interferon regulatory factor")], "query string, stage int, ord int, term string")
    got = terms.resolve_features(features, asked, "probe", "title")
    assert {tuple(r) for r in got.collect()} == {("IRF7", 1, 4, "p3"), ("IRF7", 2, 30, "p1"), ("IRF7", 2, 28, "p2"), ("Q", 2, 28, "p1"), ("Q", 2, 28, "p2")}
    assert {r["query"]: (r["features"], r["status"]) for r in decisions.resolve(got).collect()} == {"IRF7": (["p3"], "candidate"), "Q": (["p1", "p2"], "tied")}
    many = spark.range(100_000).select(F.col("id").alias("ord"), F.concat(F.lit("gene"), "id", F.lit("x")).alias("term"))
    text = spark.createDataFrame([(1, "GENE5X and gene99999x, gene99999"), (2, "gene100000x")], "id int, text string")
    assert {tuple(r) for r in terms.term_matches(text, many, "id", "text").select("id", "ord").collect()} == {(1, 5), (1, 99999)}


def titers(*rows, header=neutralization.REQUIRED, extra=()):
    head = "\t".join([*header, *extra]).upper()
    line = lambda study, rid, tail=(): "\t".join([rid, study, "EXP1", f"ES{rid}", "BS1", "SUB1", "7", "Days", "80", "80", "titer", "titer", "a", "b", *tail])
    return "\n".join([head, *[r if isinstance(r, str) else line(*r) for r in rows]]) + "\n"


def sources(spark, tmp_path, tables):
    rows = []
    for study, (kind, text) in tables.items():
        place = tmp_path / study
        if kind == "zip":
            place = tmp_path / f"{study}_Tab.zip"
            with zipfile.ZipFile(place, "w") as z:
                for k, t in enumerate(text):
                    z.writestr(f"{study}-{k}/Tab/{neutralization.TABLE}", t)
                z.writestr("Tab/other.txt", "x")
        else:
            place.mkdir()
            if text is not None:
                (place / neutralization.TABLE).write_text(text)
        rows.append((study, str(place), kind == "zip"))
    return spark.createDataFrame(rows, "accession string, path string, is_zip boolean")


def test_neutralization_export(spark, tmp_path):
    found = sources(spark, tmp_path, {"SDY1": ("dir", titers(("SDY1", "r2"), ("sdy1", "r1"))), "SDY2": ("zip", [titers(("SDY2", "r1"))]), "SDY3": ("dir", None), "SDY4": ("zip", [])})
    out = neutralization.export(found)
    assert out.columns == list(neutralization.REQUIRED) and out.count() == 3
    status = {r["accession"]: (r["status"], r["n_rows"]) for r in neutralization.study_status(neutralization.read_tables(found)).collect()}
    assert status == {"SDY1": ("exported", 2), "SDY2": ("exported", 1), "SDY3": ("skipped", 0), "SDY4": ("skipped", 0)}


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("\n", "line 1: no header"),
        (titers(), "line 1: no rows"),
        (titers(("SDY1", "r1"), header=neutralization.REQUIRED[:-1]), "line 1: missing columns: virus_strain_reported"),
        (titers(("SDY1", "r1"), extra=("result_id",)), "line 1: repeated column name"),
        (titers(("SDY1", "r1"), extra=(" ",)), "line 1: empty column name"),
        (titers(("SDY1", "r1"), ("SDY1", "r2", ("more",))), "line 3: line 3 has more fields than its header"),
        (titers(("SDY9", "r1")), "line 2: another study: SDY9"),
        (titers(("SDY1", "")), "line 2: empty result_id"),
    ],
)
def test_neutralization_faults(spark, tmp_path, text, reason):
    found = sources(spark, tmp_path, {"SDY1": ("dir", text), "SDY2": ("zip", [titers(("SDY2", "r1"))])})
    (row,) = [r for r in neutralization.study_status(neutralization.read_tables(found)).collect() if r["accession"] == "SDY1"]
    assert row["status"] == "failed" and row["reasons"] == [reason]
    with pytest.raises(ContractError, match="SDY1"):
        neutralization.export(found)
    assert [r["study_accession"] for r in neutralization.export(found, strict=False).collect()] == ["SDY2"]


def test_neutralization_unions(spark, tmp_path):
    found = sources(spark, tmp_path, {"SDY1": ("dir", titers(("SDY1", "r1", ("c",)), extra=("comments",))), "SDY2": ("dir", titers(("SDY2", "r1"), "r2\tSDY2\tEXP1\tE\tB"))})
    with pytest.raises(ContractError, match="columns that not all studies have: comments"):
        neutralization.export(found)
    out = neutralization.export(found, strict=False)
    assert out.columns == [*neutralization.REQUIRED, "comments"]
    assert [(r["result_id"], r["comments"], r["value_preferred"]) for r in out.collect()] == [("r1", "c", "80"), ("r2", "", ""), ("r1", "", "80")]
    twice = sources(spark, tmp_path / "b" if (tmp_path / "b").mkdir() is None else None, {"SDY1": ("dir", titers(("SDY1", "r1"), ("SDY1", "r1")))})
    with pytest.raises(ContractError, match="result ids repeat"):
        neutralization.export(twice)
    none = sources(spark, tmp_path / "c" if (tmp_path / "c").mkdir() is None else None, {"SDY1": ("dir", None)})
    with pytest.raises(ContractError, match="no results"):
        neutralization.export(none)
    several = sources(spark, tmp_path / "d" if (tmp_path / "d").mkdir() is None else None, {"SDY1": ("zip", [titers(("SDY1", "r1"))] * 2)})
    with pytest.raises(ContractError, match="2 members"):
        neutralization.export(several)


def test_provenance_of_a_write(spark, tmp_path):
    df = spark.range(50).select("id", F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("v")).repartition(6)
    inside = tmp_path / "in"
    inside.mkdir()
    for k in range(3):
        (inside / f"{k}.txt").write_text(f"file {k}")
    got = files.write_observed(df, str(tmp_path / "out"), ["id", "v"], ["id"], str(inside), {"mode": "newest"})
    assert got["rows"] == 50 and got["blank"] == {"id": 0, "v": 10} and got["selection"] == {"mode": "newest"} and got["inputs"]["files"] == 3 and got["inputs"]["bytes"] == 18
    assert got["sha256"] == files.content_hash(df) == files.write_observed(df.coalesce(1), str(tmp_path / "out2"), ["id", "v"], ["id"])["sha256"]
    (inside / "1.txt").write_text("other!")
    assert files.input_record(spark, str(inside))["sha256"] != got["inputs"]["sha256"]
