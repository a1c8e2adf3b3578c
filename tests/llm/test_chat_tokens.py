"""Chat formatting by round trip; token counts against the library."""

import random
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sagebrush.llm import chat, token_counts
from sagebrush.llm.queries import op5_token_counts, tokenizer_path


def test_round_trip_of_trees(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nno", "<\\|x", "<\\\\|im_end|>", "", None, "a\nb", "$1 \\1"]
    rows = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", nasty[0], 0.2), (1, 3, 1, "assistant", nasty[1], 0.9), (1, 4, 3, "us%er\n<|r", nasty[2], 0.9), (1, 5, 4, "assistant", nasty[5], None)]
    rows += [(2, 1, 99, None, nasty[4], None), (2, 2, 1, "assistant", nasty[6], None), (None, 1, None, "assistant", nasty[3], 1.0)]
    rows += [(3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "assistant", "cycle", 0.0), (3, 3, 2, "user", "tail", 0.0)]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "tree long, node long, parent long, role string, text string, score double, formatted string")
    found = {(r["tree"], r["leaf"]): r for r in chat.read_back(chat.format_trees(messages, branches=9)).collect()}
    assert set(found) == {(1, 2), (1, 5), (2, 2), (None, 1)}
    turns = lambda *k: [(t["role"], t["text"]) for t in found[k]["turns"]]
    assert turns(1, 5) == [("user", "root"), ("assistant", nasty[1]), ("us%er\n<|r", nasty[2]), ("assistant", nasty[5])]
    assert turns(2, 2) == [("", ""), ("assistant", nasty[6])]
    assert found[(1, 5)]["loss_texts"] == [nasty[1], nasty[5]]
    assert found[(1, 5)]["rank"] == 1 and found[(1, 2)]["rank"] == 2
    best = chat.format_trees(messages).collect()
    assert {(r["tree"], r["leaf"]) for r in best} == {(1, 5), (2, 2), (None, 1)}
    assert chat.format_trees(messages.limit(0)).count() == 0


def test_repeated_nodes(spark):
    rows = [(1, 1, None, "user", "root", 0.0)] * 2 + [(1, 2, 1, "assistant", "b", 0.5), (1, 2, 1, "assistant", "a", 0.5), (1, None, 1, "user", "lost", 0.0)]
    out = chat.read_back(chat.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), branches=5)).collect()
    assert [[(t["role"], t["text"]) for t in r["turns"]] for r in out] == [[("user", "root"), ("assistant", "a")]]


def test_branches_are_ranked(spark):
    """All branches of a wide tree, by the mean score of their nodes."""
    rows = [("t", 0, None, "user", "q", 0.0)]
    for k in range(1, 8):
        rows += [("t", k, 0, "assistant", f"answer {k}", k / 10), ("t", 10 + k, k, "user", f"more {k}", None)]
    frame = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = {r["rank"]: r for r in chat.read_back(chat.format_trees(frame, branches=99)).collect()}
    assert [out[k]["leaf"] for k in range(1, 8)] == [17, 16, 15, 14, 13, 12, 11]
    assert all(abs(out[k]["score"] - (8 - k) / 30) < 1e-12 for k in out)
    assert [t["text"] for t in out[1]["turns"]] == ["q", "answer 7", "more 7"] and out[1]["loss_texts"] == ["answer 7"]


def test_long_chain(spark):
    rows = [(7, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    out = chat.read_back(chat.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"))).collect()
    assert [t["text"] for t in out[0]["turns"]] == [str(i) for i in range(70)]


def test_only_chosen_branches_are_expanded(spark):
    """A broom: a handle of 40 turns, 60 leaves; the best leaf's path alone is made.
    NaN counts as 0."""
    rows = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(40)]
    rows += [(1, 100 + k, 39, "assistant", f"end {k}", float("nan") if k == 5 else k / 100) for k in range(60)]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    states = chat.climbs(frame)
    assert all(s.count() == 100 for s in states)
    best = chat.best_leaves(states, 60).orderBy("rank").collect()
    assert [r["leaf"] for r in best] == [100 + k for k in [*range(59, 5, -1), 4, 3, 2, 1, 0, 5]]
    assert all(abs(r["path_score"] - (40 + (0 if r["leaf"] == 105 else r["leaf"] - 100) / 100) / 41) < 1e-12 for r in best)
    assert chat.paths(states, chat.best_leaves(states, 2)).count() == 2 * 41
    out = chat.read_back(chat.format_trees(frame)).collect()
    assert [[t["text"] for t in r["turns"]] for r in out] == [[*map(str, range(40)), "end 59"]]


def test_counts_equal_library(spark):
    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op5_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(tok.encode(text, add_special_tokens=False).ids))


def test_counts_edge_cases(spark):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [None, "", "x" * 5000, "日本語" * 900, "a  b\n\n c <|endoftext|> d" * 200, "<|endoftext|>" * 300, "word " * 2000, "\n" * 3000, "é ü \x1c" * 700]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), chunk_chars=700, overlap_chars=16).collect()
    for r in rows:
        assert r["n_tokens"] == len(tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids), texts[r["doc_id"]]
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


_TOK = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["the ", " ", "\n", "it's", "<|endoftext|>", "naïve", "日本", "  ", "123", "don't ", "\t", "x" * 30, "!?"]), max_size=80))
def test_splice_equals_whole(parts):
    text = "".join(parts)
    encode = lambda t: _TOK.encode(t, add_special_tokens=False).offsets
    assert token_counts.spliced_count(encode, text, 40, 8) == len(encode(text))


def test_text_without_spaces_stays_in_chunks():
    """Boundaries at signs and digits bound what is encoded at once."""
    rng = random.Random(5)
    chinese = "".join("，" if i % 17 == 16 else chr(rng.randrange(0x4E00, 0x9FA0)) for i in range(150_000))
    base64 = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=300_000))
    for text in (chinese, base64, "<|endoftext|>".join(base64[i : i + 40] for i in range(0, len(base64), 40))):
        seen = []

        def encode(part):
            seen.append(len(part))
            return _TOK.encode(part, add_special_tokens=False).offsets

        found = token_counts.spliced_count(encode, text)
        assert max(seen) <= token_counts.CHUNK_CHARS + 2 * token_counts.OVERLAP_CHARS
        assert found == len(_TOK.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["the", "'", "’s", "'s", "\n", "<|endoftext|>", "<|endof", "text|>", "日本", "12", "，", "x" * 30, "!?", "é", "e\u0301", "_", "+/"]), max_size=120))
def test_splice_without_spaces(parts):
    text = "".join(parts)
    encode = lambda t: _TOK.encode(t, add_special_tokens=False).offsets
    for overlap, special in ((8, 13), (30, 13)):
        assert token_counts.spliced_count(encode, text, 60, overlap, special) == len(encode(text))
