"""Token counts by overlap resynchronisation.

A document of at most ``chunk_chars`` is encoded whole.  A longer one is encoded
as overlapping chunks with offsets; neighbouring chunks are spliced at a common
stable boundary inside their overlap, and the overlap is widened where there is
none.  A boundary is proven stable if both encodings start a token there and
either (a) the character before is no white space and the one at it is, or (b) the
character before is a letter and the one at it a digit, a sign or a symbol other than an
apostrophe.  The byte-level pre-tokenizer never lets a token run from the first into
the second, so what is left of the boundary cannot change what is right of it.
Special strings hold no white space, but may hold (b), so such a boundary must be as far
from the edges of both chunks as the longest special string is long: then both see it
whole.  Memory is bounded by the chunk and the longest run without such a boundary
(text without spaces has them at signs and digits); one run of letters is one
pre-token, which the library too can only encode whole.

Null text counts as empty (0 bytes, 0 tokens).  Each input row gives one output
row; repeated rows, null ids and further columns are kept as they come.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import ucd_3_2_0  # an early version: classes that every later one shares

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_CHARS, OVERLAP_CHARS, BATCH_CHARS = 1 << 15, 1 << 10, 1 << 19
SPECIAL_CHARS = 64
_WHITE = frozenset(" \t\n\r")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def stable(text: str, p: int) -> bool:
    return 0 < p < len(text) and text[p] in _WHITE and not text[p - 1].isspace()


def stable_class(text: str, p: int) -> bool:
    """Case (b): a letter before a digit, sign or symbol."""
    if not 0 < p < len(text) or text[p] in "'\u2019":
        return False
    kind = ucd_3_2_0.category(text[p])
    return ucd_3_2_0.category(text[p - 1])[0] == "L" and (kind == "Nd" or kind[0] in "PS")


def _starts(encode, text: str) -> np.ndarray:
    return np.fromiter((a for a, _ in encode(text)), np.int64)


def spliced_count(encode, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, special: int = SPECIAL_CHARS) -> int:
    """Number of tokens of ``text``; ``encode`` gives (start, end) of the tokens
    of a string, ``special`` is at least the length of the longest special string.
    The same as len(encode(text)) for encoders with the boundary property above."""
    total, start, cut = 0, 0, 0  # tokens from cut on are not yet counted; the chunk begins at start <= cut
    tokens = _starts(encode, text[: chunk + overlap])
    end = min(len(text), chunk + overlap)
    while end < len(text):
        nxt = end - overlap if end - overlap > cut else cut
        width = overlap
        while True:  # both chunks see nxt .. nxt + width
            right_end = min(len(text), nxt + chunk + width)
            right = _starts(encode, text[nxt:right_end])
            common = np.intersect1d(tokens + start, right + nxt)
            common = common[(common > max(nxt, cut)) & (common < end)].tolist()
            inner = lambda p: nxt + special <= p <= end - special  # noqa: E731, B023
            p = next((p for p in common if stable(text, p) or (inner(p) and stable_class(text, p))), None)
            if p is not None:
                break
            if end == len(text):
                return total + int((tokens + start >= cut).sum())
            width *= 2  # no proven boundary: both look further
            end = min(len(text), nxt + width)
            tokens = _starts(encode, text[start:end])
        total += int(((tokens + start >= cut) & (tokens + start < p)).sum())
        start, cut, tokens, end = nxt, p, right, right_end
    return total + int((tokens + start >= cut).sum())


def _counts(texts: list[str], path: str, chunk: int, overlap: int) -> Iterator[int]:
    tok = tokenizer(path)
    encode = lambda text: tok.encode(text, add_special_tokens=False).offsets
    special = max([SPECIAL_CHARS, *(len(t.content) for t in tok.get_added_tokens_decoder().values())])
    held: list[str] = []
    size = 0

    def out():
        nonlocal held, size
        # the fast form leaves the offsets out
        found = [len(x) for x in tok.encode_batch_fast(held, add_special_tokens=False)] if held else []
        held, size = [], 0
        return found

    for text in texts:
        if len(text) > chunk:
            yield from out()
            yield spliced_count(encode, text, chunk, overlap, special)
        else:
            held.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from out()
    yield from out()


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """All columns of ``docs`` but the text, with n_bytes and n_tokens.  Columns
    of these names are replaced."""
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens")])
    names = [c for c in kept.columns if c != text_col]
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(text_col).fill_null("")
                n = np.fromiter(_counts(texts.to_pylist(), path, chunk_chars, overlap_chars), np.int64, len(texts))
                columns = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pc.binary_length(texts).cast(pa.int64()), pa.array(n)], [*names, "n_bytes", "n_tokens"])

    return kept.mapInArrow(run, schema)
