"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from sagebrush.llm import spelling
from sagebrush.llm.queries import op13_spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(rows, every=199, length=6, least=5):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= length and n >= least}


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def brute(words):
    """(word, form, root, n, n_near, form_n) by making all edits of each word."""
    letters = sorted({c for w in words for c in w})
    form, out = {}, []
    near = {w: {e for e in edits(w, letters) if e in words and e != w} for w in words}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, op13_spelling(spark, SF).collect()))
    assert got == brute(brute_words(rows)) and any(r[1] for r in got) and any(r[4] > 1 for r in got)


def made_up(seed, n, letters, least, most):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(least, most))): rng.choice([5, 7, 30, 200, 2000]) for _ in range(n)}
    for w in rng.sample(sorted(words), n // 4):  # variants of variants
        for _ in range(3):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            if len(w) > 2:
                words.setdefault(w, rng.choice([5, 30, 2000]))
    return words


@pytest.mark.parametrize(("letters", "least", "most", "sizes"), [("ab", 6, 9, {}), ("abcdé", 3, 7, {"shard_words": 50, "cell": 4}), ("abc", 11, 12, {"shard_words": 10**6, "cell": 10**6}), ("aö世", 6, 8, {"shard_words": 20, "cell": 1})])
def test_small_alphabets(spark, letters, least, most, sizes):
    words = made_up(3, 300, letters, least, most)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), **sizes)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(words)


def test_common_ending_and_long_words(spark):
    words = {f"{a}{b}{c}ation" * 1: 5 + i for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefgh" for b in "abcdefgh" for c in "abcd")}
    long = "q" * 20_000
    words |= {long: 500, long[:-1] + "r": 5, "s" + long: 7}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), cell=40).collect()}
    assert got["aaaation"]["n_near"] == 7 + 7 + 3 and len(got) == len(words)
    assert got[long]["n_near"] == 2 and got[long[:-1] + "r"]["form"] == long and got["s" + long]["root"] == long


def test_chain_of_forms(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 625, "abgggg": 3125, "aggggg": 15625, "bggggg": 15625}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert all(got[w]["root"] == "aggggg" for w in words if w != "bggggg") and got["bggggg"]["root"] == "bggggg" and got["bggggg"]["n_near"] == 1


def test_odd_rows(spark):
    rows = [(1, "Été Maßnahme maßnahmen " * 5), (2, None), (3, ""), (None, "letters " * 9), (1, "Maßnahme " * 30), (4, "x" * 50), (5, "İstanbul ÷÷÷÷÷÷ ×××××× " * 5)]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    want = brute_words([("" if i is None else i, t) for i, t in rows], every=3)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(df, drop_every=3).collect()} == want
    plain = brute_words(rows, every=0)
    got = spelling.variants(spelling.vocabulary(df))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(plain)
    assert "maßnahmen" in plain and "÷÷÷÷÷÷" in plain
    none = spelling.variants(spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string")))
    assert none.collect() == [] and set(none.columns) == {"word", "n", "n_near", "form", "form_n", "root"}
