"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed as k-grams; of every window of
consecutive k-grams the smallest hash is kept as a fingerprint, with its
position.  A window spans 13 words, so every shared run of 13 words leaves the
same fingerprint on both sides.  The fingerprints are joined, and each pair of
a document and an item on one diagonal (document position minus item position)
is extended word by word in both directions; runs of 13 equal words or more are
hits.  Items of fewer than 13 words are one window each and get fingerprints of
their own length.

Cost: one pass over the texts for fingerprints, a join of fingerprints, and a
join of the hits back to the texts by the texts' hashes; texts without hits (by a
bitmap) are not shuffled.  A bitmap of 512 KB of the benchmark's
fingerprints (fixed size, whatever the benchmark) keeps documents from sending
fingerprints that cannot join; where it is full everything goes to the join.
Rows joined are the true matches of fingerprints, so no group is expanded into
pairs of documents.

Null or wordless texts have no words and no hits.  Ids take no part: equal texts
share their candidates, and each candidate is verified against the row's own
text.  Items without an id are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd
from .tables import own_names, split_by_keys, stored
from .winnow import minima

WINDOW, K = 13, 5
_BITS = 22
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)


def _shape(m: int) -> tuple[int, int]:
    """(k, w) of the fingerprints of items whose windows have m words."""
    k = min(K, m)
    return k, m - k + 1


def _selected(words: wd.Words, shapes: dict[int, set[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the fingerprints of a run of texts."""
    hashes, owner = words.hashes(), words.owner()
    at, fps = [], []
    for k, widths in shapes.items():
        grams = wd.kgrams(hashes, k) ^ np.uint64(k)
        grams |= np.uint64(1) << np.uint64(63)  # 0 marks windows that don't count
        keep = np.zeros(len(grams), bool)
        for w in widths:
            span = k + w - 1
            valid = np.zeros(len(grams), bool)
            if len(owner) >= span:
                valid[: len(owner) - span + 1] = owner[: len(owner) - span + 1] == owner[span - 1 :]
            keep |= minima(grams, valid, w)
        found = np.flatnonzero(keep)
        at.append(found)
        fps.append(grams[found])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, fps = np.concatenate(at), np.concatenate(fps)
    order = np.argsort(at, kind="stable")
    return at[order], fps[order]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, lengths: list[int], bitmap: np.ndarray | None = None) -> DataFrame:
    """(id, pos, fp) of texts, for windows of the given numbers of words; of a
    benchmark item only those of its own window length (``bitmap`` None)."""
    item_side = bitmap is None
    shapes: dict[int, set[int]] = {}
    for m in lengths:
        k, w = _shape(m)
        shapes.setdefault(k, set()).add(w)
    flags = None if item_side else np.unpackbits(bitmap, bitorder="little").astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, words in wd.doc_steps(batch.column(1), wd.ALNUM):
                count = np.diff(words.at)
                if item_side:  # each item has the fingerprints of its own shape only
                    parts = []
                    for m in lengths:
                        k, w = _shape(m)
                        at, fps = _selected(words, {k: {w}})
                        mine = np.minimum(count, WINDOW)[np.searchsorted(words.at, at, "right") - 1] == m
                        parts.append((at[mine], fps[mine]))
                    at, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(at, kind="stable")
                    at, fps = at[order], fps[order]
                else:
                    at, fps = _selected(words, shapes)
                    keep = flags[(fps & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
                    at, fps = at[keep], fps[keep]
                owner = np.searchsorted(words.at, at, "right") - 1
                has, lengths_of = np.unique(owner, return_counts=True)
                ends = np.concatenate(([0], np.cumsum(lengths_of)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).take(pa.array(has)), wd.lists((at - words.at[owner]).astype(np.int32), ends, pa.int32()), wd.lists(fps.view(np.int64), ends, pa.int64())],
                    ["id", "pos", "fp"],
                )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("fp", T.ArrayType(T.LongType()))])
    rows = docs.select(id_col, text_col).mapInArrow(run, schema)
    return rows.select("id", F.explode(F.arrays_zip("pos", "fp")).alias("x")).select("id", "x.pos", "x.fp")


def _bitmap(fps: DataFrame) -> np.ndarray:
    """2**22 flags as bytes: at most 128 rows of 4 KB reach the driver."""
    slot = F.col("fp").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    rows = fps.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros((1 << _BITS) // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def split_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_TO_LOWER))


def extend(doc: list[bytes], item: list[bytes], diagonal: int) -> list[tuple[int, int]]:
    """Runs of equal words on a diagonal, as [start, end) in the document, that
    hold a whole window of the item."""
    least, out = min(WINDOW, len(item)), []
    q = max(0, -diagonal)
    last = min(len(item), len(doc) - diagonal)
    while q < last:
        if doc[q + diagonal] != item[q]:
            q += 1
            continue
        start = q
        while q < last and doc[q + diagonal] == item[q]:
            q += 1
        if q - start >= least:
            out.append((start + diagonal, q + diagonal))
    return out


NEW = ("n_words", "n_hit", "item_ids", "hit_spans", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted as strings), hit_spans (word
    ranges [start, end)) and contaminated.  Columns of these names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in NEW])
    names = docs.columns
    key, hits, of = own_names(docs, "_key", "_hits", "_of")
    items = stored(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("item_text")).filter("item_text IS NOT NULL AND item IS NOT NULL"))
    sizes = items.select(F.size(F.filter(F.split(F.lower("item_text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")).alias("n")).select(F.least("n", F.lit(WINDOW)).alias("m")).filter("m > 0")
    lengths = sorted(r["m"] for r in sizes.distinct().collect())  # at most 13 rows
    item_fps = stored(fingerprints(items, "item", "item_text", lengths).select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "fp"))
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    found = fingerprints(texts, "key", "text", lengths, _bitmap(item_fps))
    diagonals = found.join(item_fps, "fp").select("id", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    by_text = stored(
        diagonals.groupBy("id", "item")
        .agg(F.collect_list("diagonal").alias("diagonals"))
        .join(items, "item")
        .groupBy(F.col("id").alias(of))
        .agg(F.collect_list(F.struct("item", "item_text", "diagonals")).alias(hits))
    )
    near, rest = split_by_keys(docs.withColumn(key, F.xxhash64(text_col)), key, by_text, of)
    joined = near.join(by_text.hint("shuffle_hash"), F.col(key) == F.col(of), "left").select(*names, hits)
    joined = joined.unionByName(rest.select(*names, F.lit(None).cast(by_text.schema[hits].dataType).alias(hits)))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(span)), T.StructField("contaminated", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(words.at) for _, _, words in wd.doc_steps(texts, wd.ALNUM))])
            hit, ids, spans = np.zeros(len(n), np.int64), [[] for _ in n], [[] for _ in n]
            found = batch.column(hits)
            for k in np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False)):
                doc, runs = split_words(texts[int(k)].as_py()), []
                for h in found[int(k)].as_py():
                    item = split_words(h["item_text"])
                    own = [r for d in h["diagonals"] for r in extend(doc, item, d)]
                    if own:
                        ids[k].append(h["item"])
                        runs += own
                ids[k] = sorted(set(ids[k]))
                for a, b in sorted(runs):
                    if spans[k] and a <= spans[k][-1]["end"]:
                        spans[k][-1]["end"] = max(b, spans[k][-1]["end"])
                    else:
                        spans[k].append({"start": a, "end": b})
                hit[k] = sum(s["end"] - s["start"] for s in spans[k])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n), pa.array(hit), pa.array(ids, pa.list_(pa.string())), pa.array(spans, kind), pa.array((hit > 0) & (20 * hit >= n))], [*names, *NEW]
            )

    return joined.mapInArrow(run, schema)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
