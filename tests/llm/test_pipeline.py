"""The pipeline, stage by stage, against brute force."""

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sagebrush.llm import language
from sagebrush.llm.queries import tokenizer_path
from tests.llm.test_language_pieces import brute_language
from tests.llm.test_ngram_join import brute
from tests.llm.test_winnowing import brute_dedup, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # what the data lacks: a document without letters, a near copy, null
    first = docs.orderBy(F.desc("n_chars")).first()
    near = first["text"].split(" ")
    near[7] = "changed"
    odd = spark.createDataFrame([(9001, "12 34", "en", "s", 5), (9002, " ".join(near).replace("\n", " "), first["lang"], "s", 9), (9003, None, "en", None, None)], docs.schema)
    docs = docs.unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = spark.createDataFrame(cp.language_id(spark, docs, SF).collect(), docs.schema)
    model = language.train(docs.filter(~language.held_out()))
    known = {i: brute_language(t, model, language.PENALTY) for i, t in texts.items()}
    expected = {i for i, (lang, score) in known.items() if lang != "und" and score >= 0.5}
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(kept) == expected and not {9001, 9003} & expected and all(texts[i] == t for i, t in kept.items())
    assert len(expected) > 0.95 * len(texts)

    two = spark.createDataFrame(cp.line_dedup_stage(spark, one, SF).collect(), docs.schema)
    want = {i: t for i, t, n in brute_dedup([(i, 0, kept[i]) for i in sorted(kept)], 50) if n == 0 or t.strip()}
    got = {r["doc_id"]: r["text"] for r in two.collect()}
    assert got == want and len(want) < len(kept)
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect() if r["doc_id"] < 9000 and r["text"] != kept[r["doc_id"]])

    three = spark.createDataFrame(cp.near_duplicates(spark, two, SF).collect(), docs.schema)
    groups = brute(list(want.items()))
    stay = {i for i, (n, c) in groups.items() if n == 0 or c == i}
    assert {r["doc_id"] for r in three.collect()} == stay

    four = spark.createDataFrame(cp.decontaminate(spark, three, SF).collect(), docs.schema)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in stay if not brute_hits(want[i], items)[3]}
    assert {r["doc_id"] for r in four.collect()} == clean and len(clean) < len(stay)
    assert four.columns == list(cp.COLUMNS)

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in cp.sentencepiece_ids(spark, four, SF).collect():
        assert r["ids"] == sp.encode(want[r["doc_id"]]) and r["round_trip"]


def test_run_equals_stages(spark):
    """run() against plain versions of its stages, each on the rows of the one before."""
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.filter("crc32(cast(doc_id AS string)) % 5 <> 0"))
    of_language = lambda t: brute_language(t, model, language.PENALTY)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in texts.items() if (x := of_language(t))[0] != "und" and x[1] >= 0.5}
    lines = {i: t for i, t, n in brute_dedup([(i, 0, kept[i]) for i in sorted(kept)], 50) if n == 0 or t.strip()}
    single = {i: lines[i] for i, (n, c) in brute(list(lines.items())).items() if n == 0 or c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in single.items() if not brute_hits(t, items)[3]}
    assert len(texts) >= len(kept) >= len(lines) > len(single) > len(clean) > 50
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = cp.run(spark, SF).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in out} == {i: sp.encode(t) for i, t in clean.items()}
    assert len(out) == len(clean) and all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] for r in out)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_duplicates_by_row(spark):
    """Null and repeated ids: a row goes only for a similar one that stays."""
    a, b = "one two three four five six seven", "a text of its own with nothing else like it"
    long_ = " ".join(f"w{i}" for i in range(99))
    rows = [(None, a), (3, a), (5, a), (5, b), (None, "alone and without any id at all"), (None, long_), (None, long_ + " end"), (None, long_), (7, None), (None, ""), (8, "in"), (5, "in")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, SF).collect()]
    of_long = [x for x in got if x[1] and x[1].startswith(long_)]
    assert len(of_long) == 1 and of_long[0] in rows
    assert sorted(set(got) - set(of_long), key=str) == sorted([(3, a), (5, b), (None, rows[4][1]), (7, None), (None, ""), (5, "in")], key=str) and len(got) == 7
