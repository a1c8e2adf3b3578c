"""Sharding and quality rules against plain Python."""

import re
import zlib

from pyspark.sql import functions as F

from sagebrush.llm import quality, sharding
from sagebrush.llm.queries import op7_quality_rules, op9_sharding

SF = "/root/testdata/sf0.001"


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = set()
    for at in windows.values():
        if len(at) > 1:
            hit.update(i + j for i in at for j in range(8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
        len(words) < 20 or 100 * len(hit) > 30 * len(words),
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op7_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute_quality(texts[r["doc_id"]]), r["doc_id"]


def test_quality_edge_cases(spark):
    passage = "a b c d e f g h"
    texts = [None, "", " \n\t\x0b ", passage * 1, f"{passage} {passage}", " ".join(["x"] * 30), "y " * 5000, "é ü ß|#\n\nlast", f"{passage} q {passage} r s\n{passage} q"]
    docs = spark.createDataFrame([(i, t, "mine", True) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept boolean")
    for r in quality.quality(docs).collect():
        assert tuple(r[c] for c in COLUMNS) == brute_quality(texts[r["doc_id"]]), r
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_line_verdicts(spark):
    good = "\n".join(f"Sentence {i} holds word{i} and thing{i}, as prose number {i} does." for i in range(6))
    nav = "\n".join("Home | About | News | Shop | Contact | Help" for _ in range(12))
    docs = spark.createDataFrame([(1, good), (2, nav + "\n" + good[:60]), (3, good + "\nHome | About | News | Shop")], "doc_id long, text string")
    kept = {r["doc_id"]: (r["kept"], r["n_failed_lines"], r["clean_text"]) for r in quality.quality(docs).collect()}
    assert kept[1][0] and kept[1][1] == 0 and kept[1][2] == good
    assert not kept[2][0]
    assert kept[3] == (True, 1, good)


def check_shards(docs, rows, n, spread):
    assert len(rows) == docs.count()
    bytes_, slots = {}, {}
    for r in rows:
        bytes_[r["shard"]] = bytes_.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(bytes_) <= set(range(n))
    mean = sum(bytes_.values()) / n
    assert max(abs(bytes_.get(k, 0) - mean) for k in range(n)) <= spread * mean + max(r["size"] for r in rows), bytes_


def test_sharding_sizes_and_slots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op9_sharding(spark, "/root/testdata/sf0.01").collect()
    check_shards(docs, rows, 40, 0.01)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_sharding_hot_group_is_split(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("copy of one text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    check_shards(docs, sharding.shard_documents(docs, 7).collect(), 7, 0.01)


def test_sharding_edge_cases(spark):
    schema = "doc_id long, text string, shard string, size int"
    rows = [(None, None, "x", 1), (None, "", "x", 1), (1, None, None, None), (1, "b", "x", 1), (1, "b", "x", 1), (-5, "ü" * 5000, "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    out = sharding.shard_documents(docs, 3).collect()
    check_shards(docs, out, 3, 3.0)
    assert sharding.shard_documents(docs.limit(0), 3).count() == 0
    only = spark.createDataFrame([(i, "same", "x", 1) for i in range(100)], schema)
    check_shards(only, sharding.shard_documents(only, 4).collect(), 4, 0.01)


def test_splitters_against_sorting(spark):
    """Shards are ranges of (hash, id), cut where a sort of all rows would cut them."""
    texts = [f"text {i % 700} " + "x" * (i * 37 % 900) for i in range(3000)] + ["hot"] * 1500
    docs = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(7)
    n, overhead, tolerance = 9, 16, 0.002
    rows = {r["doc_id"]: r for r in sharding.shard_documents(docs, n, overhead, tolerance).collect()}
    keys = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("d")).collect()
    order = [rows[r["doc_id"]] for r in sorted(keys, key=lambda r: (r["h"], r["d"]))]
    shards = [r["shard"] for r in order]
    assert shards == sorted(shards) and set(shards) == set(range(n))
    total, below, cut = sum(r["size"] for r in order), 0, {}
    for r in order:
        cut.setdefault(r["shard"], below)
        below += r["size"]
    heaviest = max(r["size"] for r in order)
    for k in range(1, n):
        assert abs(cut[k] - total * k / n) <= tolerance * total / n + heaviest, k
