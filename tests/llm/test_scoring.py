"""Scores against a plain dictionary model, and odd texts."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sagebrush.llm import scoring
from sagebrush.llm.queries import op12_scoring

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]  # None is the end


def model(train):
    """p(w, context of up to two) of the smoothed n-grams, the counts, N and V."""
    counts = Counter()
    for text in train:
        t = tokens(text)
        counts[(0,)] += 1
        for i, w in enumerate(t):
            counts[(w,)] += 1
            counts[((t[i - 1] if i else 0), w)] += 1
            if i:
                counts[((t[i - 2] if i > 1 else 0), t[i - 1], w)] += 1
    n = sum(c for k, c in counts.items() if len(k) == 1 and k != (0,))
    v = sum(len(k) == 1 and k != (0,) for k in counts)

    def p(w, context):
        if not context:
            return (counts[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        return (counts[(*context, w)] + scoring.STRENGTH * p(w, context[1:])) / (counts[context] + scoring.STRENGTH)

    return p, counts, n


def brute(rows, train):
    p, counts, n = model([t for i, t in rows if train(i)])
    out = []
    for i, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for k, w in enumerate(t):
            context = tuple(t[k - 2 : k]) if k > 1 else (0, *t[:k])
            base += math.log10(p(w, ()))
            score += math.log10(p(w, context))
        out.append((i, len(t), sum(counts[(w,)] > 0 for w in t), n, base, score))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0], r[1], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-12), (a, b)


def learns(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 != 1


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op12_scoring(spark, SF)
    assert all(r["held_out"] == (not learns(r["doc_id"])) for r in got.collect())
    same(got.drop("held_out").collect(), brute(rows, learns))
    held = got.filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > 0.9 * held[0]  # log-probabilities: nearer to 0


@pytest.mark.parametrize(("batch", "lane"), [(1, 1), (2, 3), (5, 2), (64, 7), (10**6, 1000)])
def test_cuts_change_nothing(spark, batch, lane):
    texts = ["a b a b a b c", "a b", "", None, "A  b\na\tb", "c c c c c c c c c c", "a b a b a b c", "x", "x y z a b a", "äß 世界 a", " \n"]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = scoring.score(df, scoring.learns(), batch_tokens=batch, shard_bytes=40, lane=lane)
    same(got.collect(), brute(rows, learns))


def test_long_text_and_run(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(1, long), (2, "z" * 3_000_000 + " a"), (3, "w1 w2 w3")]
    got = scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), batch_tokens=100_000)
    same(got.collect(), brute(rows, lambda i: True))


def test_odd_tables(spark):
    none = scoring.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True))
    assert none.collect() == []
    df = spark.createDataFrame([("q", "a b", 1, "c"), (None, None, 2, "d")], "id string, body string, n_tokens long, score string")
    got = scoring.score(df, F.lit(False), "id", "body").collect()  # nothing to learn from
    same(got, [("q", 3, 0, 0, 0.0, 0.0), (None, 1, 0, 0, 0.0, 0.0)])


def test_estimates_sum_to_one():
    p, counts, _ = model(["a b a c", "b a", ""])
    known = {k[0] for k in counts if len(k) == 1 and k != (0,)}
    for context in [(), ("a",), ("b", "a"), (0,), (0, "b"), ("c", "b"), ("unknown",)]:
        assert math.isclose(sum(p(w, context) for w in [*known, "unknown"]), 1)
