"""Language ID by held-out accuracy and a plain Viterbi; SentencePiece against
the library and by round trip."""

import hashlib
import random
import subprocess
import sys
import unicodedata

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sagebrush.llm import language, pieces
from sagebrush.llm.queries import op6_language_id, op8_sentencepiece, tokenizer_path

SF = "/root/testdata/sf0.01"


def plain_viterbi(s, penalty):
    n, k = s.shape
    best, back = [list(map(float, s[0]))], []
    for t in range(1, n):
        row, from_ = [], []
        for j in range(k):
            options = [(best[-1][i] - (penalty if i != j else 0), i) for i in range(k)]
            top = max(options, key=lambda o: o[0])
            row.append(top[0] + float(s[t, j]))
            from_.append(top[1])
        best.append(row)
        back.append(from_)
    return max(best[-1])


def value(s, labels, penalty):
    return float(sum(s[t, lab] for t, lab in enumerate(labels))) - penalty * sum(a != b for a, b in zip(labels, labels[1:], strict=False))


def test_paths_are_best():
    rng = np.random.default_rng(6)
    lengths = [1, 2, 0, 17, 40, 5, 60, 0, 33]
    at = np.concatenate(([0], np.cumsum(lengths)))
    for scale in (0.5, 2, 6):
        scores = rng.normal(0, scale, (at[-1], 3)).astype(np.float32)
        scores[at[4] : at[5], 1] += 2
        for find in (language.viterbi, language.best_labels):
            labels = find(scores, at, 4.0)
            for a, b in zip(at, at[1:], strict=False):
                if b > a:
                    assert abs(value(scores[a:b], labels[a:b], 4.0) - plain_viterbi(scores[a:b], 4.0)) < 1e-3


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixed_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    by = {lang: [r["text"] for r in docs.filter((F.col("lang") == lang) & (F.length("text") > 3000) & ~F.col("text").contains("|")).orderBy("doc_id").limit(1).collect()] for lang in ("de", "es")}
    first, second = " ".join(by["de"][0].split()[:40]), " ".join(by["es"][0].split()[:90])
    texts = [None, "", "123 ... 🎉", "— “ ”", first + "\n" + second, "русский текст", first + " русский"]
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    out = {r["doc_id"]: r for r in language.identify(frame, model).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and [out[i]["score"] for i in (0, 1, 2, 3)] == [0.0] * 4
    # whatever has letters gets a learned language
    assert out[5]["lang_pred"] in model.languages and out[5]["score"] > 0
    assert out[4]["lang_pred"] == "es" and {s["lang"] for s in out[4]["spans"]} == {"de", "es"} and out[4]["score"] < 0.8
    assert out[6]["lang_pred"] == "de"
    none = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(frame, none).collect()} == {"und"}
    assert language.identify(frame.limit(0), model).count() == 0


def runs_of_letters(text):
    """Runs of letters and marks, by each character's category."""
    return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text).split(" ")


def brute_language(text, model, penalty):
    """Label and score of a text: words, trigram sums and all paths in plain Python."""
    rows, voting = [], []
    for word in filter(None, runs_of_letters(text or "")):
        raw = [language.wd._LOWER[b] for b in word.encode()]
        padded = [0, 0, *map(int, raw), 0]
        codes = [(padded[t] << 16) | (padded[t + 1] << 8) | padded[t + 2] for t in range(len(raw) + 1)]
        slots = [((c * 2654435761) & 0xFFFFFFFF) >> 16 for c in codes]
        script = next((int(language.SCRIPTS[b]) for b in word.encode() if language.SCRIPTS[b]), 0)
        open_ = model.allowed[script] if model.allowed[script].any() else np.ones(len(model.languages), bool)
        votes = any(c.isalpha() for c in word)
        score = [float(np.add.reduce(model.scores[k][slots])) if open_[k] else -1e4 for k in range(len(model.languages))]
        rows.append(score if votes else [0.0] * len(score))
        voting.append(votes)
    if not any(voting):
        return "und", 0.0
    best, back = list(rows[0]), []
    for row in rows[1:]:
        top = max(range(len(best)), key=lambda i: best[i])
        from_ = [k if best[k] >= best[top] - penalty else top for k in range(len(best))]
        best = [max(best[k], best[top] - penalty) + row[k] for k in range(len(best))]
        back.append(from_)
    at = max(range(len(best)), key=lambda i: best[i])
    labels = [at]
    for from_ in reversed(back):
        labels.append(from_[labels[-1]])
    labels = [lab for lab, v in zip(reversed(labels), voting, strict=True) if v]
    counts = [labels.count(k) for k in range(len(best))]
    return model.languages[counts.index(max(counts))], max(counts) / len(labels)


def test_labels_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs.filter(~language.held_out()))
    odd = [None, "", "“Bonjour” “tout” “monde”", "русский текст", "中文文本", "— … “ ”", "¿Qué? ¡Sí!", "12 a3b", "🎉🎉 ok 🎉", "naïve—café", "々", "ªº", "Ωmega and the rest", "𐌰𐌱𐌲", "ℝ ℂ ℵ", "ⁿ", "〱〻", "٣٤ ① 12", "\u0301", "क्षत्रिय", "a·b×c÷d"]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in language.identify(frame, model).collect():
        want = brute_language(texts[r["doc_id"]], model, language.PENALTY)
        assert (r["lang_pred"], round(r["score"], 9)) == (want[0], round(want[1], 9)), texts[r["doc_id"]]
    for i in (2, 3, 4, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 19, 20):
        assert brute_language(odd[i], model, language.PENALTY)[0] in model.languages
    for i in (17, 18):  # digits and marks alone
        assert brute_language(odd[i], model, language.PENALTY) == ("und", 0.0)


def test_ids_equal_library(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    parts = [" ", "a", "th", "er", "\n", ".", "é", "ing", "▁", "ß", "  ", "日", "🎉", "\t", "x" * 60, "\0", "0x1f"]
    texts = [None, "", " ", "hello  world", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(70))) for _ in range(300)), "word " * 3000, "ab" * 900]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = pieces.encode(frame, path)
    for r in encoded.collect():
        text = texts[r["doc_id"]] or ""
        ids = sp.encode(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids), text
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, np.int32).tobytes()).hexdigest()
        assert r["round_trip"] == ("▁" not in text)
    for r in pieces.decode(encoded, path).collect():
        assert r["text"] == sp.decode(sp.encode(texts[r["doc_id"]] or ""))
    assert pieces.encode(frame.limit(0), path).count() == 0


def test_long_chunks_are_cut():
    own = pieces.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rnd = random.Random(8)
    base64 = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300_000))
    chinese = "".join(chr(rnd.randrange(0x4E00, 0x5000)) for _ in range(50_000)) + "我们的中国人民" * 2000
    letters = "".join(rnd.choice(["the", "ing", "a", "er", "q", "zz", "tion"]) for _ in range(20_000))
    for text in (base64, chinese, letters, "x" * 3000, "\0" * 100, "é" * 99 + "ab" * 200):
        ids, at = own.encode([text, "a b"])
        assert ids[: at[1]].tolist() == sp.encode(text)
    assert max(map(len, own.cut(base64))) < 200 and max(map(len, own.cut(chinese))) < 200


def test_long_texts_go_by_parts(monkeypatch):
    """Texts of over RUN characters, and runs that nothing cuts, with small bounds."""
    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(4)
    words = ["the", "ing", "a", "er", "st", "tion", "on", "an", "e"]
    letters = lambda n: "".join(rnd.choice(words) for _ in range(n))
    texts = ["short one", letters(900), "a" * 1001, "", "ab" * 700 + " end", "日本" * 300 + letters(300) + "🎉" * 90, " ".join(letters(3) for _ in range(400)), "=" * 777, "é\n" * 200, " " * 500]
    for run, index, batch in ((50, 64, 120), (200, 1000, 300), (100, 37, 5000)):
        monkeypatch.setattr(pieces, "RUN", run)
        monkeypatch.setattr(pieces, "INDEX", index)
        monkeypatch.setattr(pieces, "BATCH", batch)
        own = pieces.Vocabulary(path)
        ids, at = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == sp.encode(texts)
        assert [x.decode() for x in own.decoded(ids, at)] == [sp.decode(x) for x in sp.encode(texts)]
        assert [t for held in pieces._runs(texts) for t in held] == texts


GROWTH = """
import random, resource, sys
from sagebrush.llm import pieces
own = pieces.Vocabulary(sys.argv[1])
rnd = random.Random(3)
own.encode(["".join(rnd.choices("abcdefghij 0123456789", k=120_000))] * 9)
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
alphabet = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "chinese": "".join(map(chr, range(0x4E00, 0x5200))), "letters": "aeinorst"}[sys.argv[2]]
text = "".join(rnd.choices(alphabet, k=int(sys.argv[3])))
ids, at = own.encode([text])
assert own.decoded(ids, at) == [text.encode()]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


@pytest.mark.parametrize(("kind", "most"), [("base64", 150), ("chinese", 150), ("letters", 250)])
def test_memory_of_long_lines(kind, most):
    """A line of 2,000,000 characters grows a process by less than ``most`` MB."""
    out = subprocess.run([sys.executable, "-c", GROWTH, tokenizer_path("piece_bpe_32k.model"), kind, "2000000"], capture_output=True, text=True, check=True)
    assert int(out.stdout) < most


def test_registered_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op8_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids = np.array(sp.encode(texts[r["doc_id"]] or ""), np.int32)
        assert (r["n_tokens"], r["ids_sha256"], r["round_trip"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 50)
    own = pieces.Vocabulary(tokenizer_path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for i in range(12):
        texts = [f"word{k} common thing{k * i}" for k in range(9)]
        ids, at = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == sp.encode(texts)
        assert len(own.number) <= 80
