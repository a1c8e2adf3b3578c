"""Decontamination and line dedup against brute force."""

import functools
import random

import numpy as np

from sagebrush.llm import decontamination as dc
from sagebrush.llm import line_dedup as ld
from sagebrush.llm.winnow import minima


def brute_hits(doc, items):
    words = dc.split_words(doc)
    hit, ids = set(), set()
    for i, text in items:
        w = dc.split_words(text)
        m = min(13, len(w))
        windows = {tuple(w[a : a + m]) for a in range(len(w) - m + 1)} if m else set()
        for a in range(len(words) - m + 1 if m else 0):
            if tuple(words[a : a + m]) in windows:
                hit.update(range(a, a + m))
                ids.add(str(i))
    return len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)


def test_decontaminate_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = "aa bb cc dd É ß 7".split()
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    long_ = text(40)
    items = [(1, long_), (2, text(13)), (3, text(12)), (4, text(6)), (5, text(3)), (6, ""), (7, None), (8, "Zz"), (9, long_), (10, "aa " * 20)]
    docs = [None, "", "!!", long_, f"x {long_.upper()} y", text(500) + " " + " ".join(long_.split()[5:20]), text(30), "aa " * 60, "zz", " ".join(long_.split()[:12]), text(2000)]
    docs += [" ".join(["q"] * 300) + " " + items[1][1], docs[3]]
    frame = spark.createDataFrame([(k if k != 4 else None, t, "other", 5) for k, t in enumerate(docs)], "doc_id long, text string, item string, n_hit int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    rows = dc.decontaminate(frame, bench).collect()
    assert len(rows) == len(docs)
    for r in rows:
        k = 4 if r["doc_id"] is None else r["doc_id"]
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == brute_hits(docs[k], items), k
        assert sum(s["end"] - s["start"] for s in r["hit_spans"]) == r["n_hit"]
    assert dc.decontaminate(frame, bench.limit(0)).filter("contaminated").count() == 0
    assert dc.decontaminate(frame.limit(0), bench).count() == 0


def test_minima_guarantee():
    rnd = np.random.default_rng(3)
    h = rnd.integers(1, 20, 200).astype(np.uint64)
    valid = np.zeros(200, bool)
    valid[:192] = True
    flags = minima(h, valid, 9)
    expected = np.zeros(200, bool)
    for j in range(192):
        expected[j : j + 9] |= h[j : j + 9] == h[j : j + 9].min()
    assert (flags == expected).all()


def brute_dedup(docs, least):
    """docs: (id, key, text), in order.  A span of lines counts if it has the
    words and would not without its first or without its last line with a word, or
    if it is one line with enough words and the next one."""
    seen, placed = {}, []
    for i, key, text in docs:
        words = [tuple(x.split()) for x in text.split("\n")]
        solid = [k for k, w in enumerate(words) if w]
        for a, s in enumerate(solid):
            n = 0
            for b in range(a, len(solid)):
                w = words[solid[b]]
                n += len(w)
                one_more = b == a + 1 and len(words[s]) >= least
                if n >= least and (n - len(w) < least or n - len(words[s]) < least or one_more):
                    placed.append((i, key, s, solid[b], tuple(words[k] for k in solid[a : b + 1])))
                elif n - len(words[s]) >= least and b > a + 1:
                    break
    gone, out = {}, []
    for i, key, s, e, content in sorted(placed, key=lambda x: (docs_order(docs)[x[:2]], x[2])):
        if seen.setdefault(content, (i, key, s)) != (i, key, s):
            gone.setdefault((i, key), set()).update(range(s, e + 1))
    for i, key, text in docs:
        lines = text.split("\n")
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone.get((i, key), ())), len(gone.get((i, key), ()))))
    return out


@functools.cache
def _order(keys):
    return {k: n for n, k in enumerate(keys)}


def docs_order(docs):
    return _order(tuple((i, key) for i, key, _ in docs))


def test_dedup_equals_brute_force(spark):
    rnd = random.Random(11)
    pool = [" ".join(rnd.choice("alpha beta gamma delta é".split()) for _ in range(rnd.choice([0, 1, 3, 7, 12]))) for _ in range(14)]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(120)]
    docs += [(200, ""), (201, "\n\n"), (202, "one " * 500), (203, "one " * 499 + "one"), (204, "\n".join(["same words here now"] * 40))]
    rows = ld.dedup_lines(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_lines int"), min_words=9).collect()
    expected = {i: (t, n) for i, t, n in brute_dedup([(i, 0, t) for i, t in docs], 9)}
    assert len(rows) == len(docs) and sum(n for _, n in expected.values()) > 50
    for r in rows:
        assert (r["clean_text"], r["n_removed"]) == expected[r["doc_id"]], r["doc_id"]
        assert r["n_lines"] == dict(docs)[r["doc_id"]].count("\n") + 1


def test_dedup_edge_cases(spark):
    run = "\n".join(f"line {i} of the passage with several words" for i in range(9))
    rows = [(1, None), (2, run), (None, run), (2, run), (3, "intro\n" + run + "\nend"), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r["doc_id"], r["clean_text"]) for r in ld.dedup_lines(docs).collect()), key=str)
    assert out == sorted([(1, None), (2, ""), (2, ""), (None, run), (3, "intro\nend"), (4, "short")], key=str)
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_dedup_tells_letter_case(spark):
    run = "\n".join(f"line {i} of the passage with several words" for i in range(9))
    docs = [(1, run), (2, run.upper()), (3, run.title() + "\nend"), (4, "intro\n" + run.upper())]
    out = {r["doc_id"]: (r["clean_text"], r["n_removed"]) for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {i: (t, n) for i, t, n in brute_dedup([(i, 0, t) for i, t in docs], 50)}
    assert out[2] == (docs[1][1], 0) and out[3] == (docs[2][1], 0) and out[4] == ("intro", 9)


def brute_runs(docs, least):
    """docs: (id, text), in order; every span of lines with the words counts."""
    first, spans = {}, []
    for i, text in docs:
        words = [tuple(x.split()) for x in text.split("\n")]
        for s in range(len(words)):
            for e in range(s, len(words)):
                if words[s] and words[e] and sum(map(len, words[s : e + 1])) >= least:
                    content = tuple(w for w in words[s : e + 1] if w)
                    first.setdefault(content, (i, s))
                    spans.append((i, s, e, content))
    gone = {i: set() for i, _ in docs}
    for i, s, e, content in spans:
        if first[content] != (i, s):
            gone[i].update(range(s, e + 1))
    return {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in docs}


def test_whole_runs_leave_no_stub(spark):
    rnd = random.Random(12)
    pool = [" ".join(rnd.choice("alpha beta gamma delta é".split()) for _ in range(rnd.choice([0, 1, 3, 7, 12]))) for _ in range(14)]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(120)]
    run = "\n".join(f"t{i} u{i} v{i} w{i} x{i}" for i in range(7)) + "\nlast line"
    docs += [(200, run), (201, "intro\n" + run + "\nend"), (202, run), (203, "\n".join(["same words here now"] * 40)), (204, "")]
    rows = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=9).collect()
    got = {r["doc_id"]: (r["clean_text"], r["n_removed"]) for r in rows}
    assert got == brute_runs(docs, 9) and got[201] == ("intro\nend", 8) and got[202] == ("", 8)
    assert {i: (t, n) for i, t, n in brute_dedup([(i, 0, t) for i, t in docs], 9)} == got


def test_clashing_and_extra_columns(spark):
    """Columns with the names that the operators use inside stay as they are."""
    run = "\n".join(f"line {i} of the passage with several words" for i in range(9))
    names = "_id _key _gone _parts _hash _hits _of _bucket _bits _flag id key fp n_lines item"
    rows = [(k, t, *range(len(names.split()))) for k, t in ((1, run), (2, "intro\n" + run), (None, None), (3, ""), (3, "x"))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names.split()])
    out = ld.dedup_lines(docs)
    assert sorted(((r["doc_id"], r["clean_text"]) for r in out.collect()), key=str) == sorted([(None, None), (1, run), (2, "intro"), (3, ""), (3, "x")], key=str)
    kept = [c for c in docs.columns if c != "n_lines"]
    assert sorted(map(str, out.select(*kept).collect())) == sorted(map(str, docs.select(*kept).collect()))
    bench = spark.createDataFrame([(1, run)], "item_id long, text string")
    hit = dc.decontaminate(docs, bench)
    assert sorted(map(str, hit.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert sorted((r["doc_id"], r["n_hit"]) for r in hit.filter("contaminated").collect()) == [(1, 72), (2, 72)]


def test_split_by_keys(spark):
    from pyspark.sql import functions as F

    from sagebrush.llm.tables import split_by_keys

    docs = spark.range(5000).withColumn("h", F.xxhash64("id"))
    keys = docs.filter("id % 7 = 0").select(F.col("h").alias("k"))
    near, rest = split_by_keys(docs, "h", keys, "k")
    near, rest = {r["id"] for r in near.collect()}, {r["id"] for r in rest.collect()}
    assert near >= set(range(0, 5000, 7)) and len(near) < 730 and near | rest == set(range(5000)) and not near & rest
