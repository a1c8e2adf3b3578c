"""Line dedup by winnowing over line hashes.

A document is a sequence of lines, each hashed by its words (white space does
not count, letter case does).  A window starts at each line with a word and
reaches to the first line by which it has ``min_words`` words.  The smallest line
hash of each window is a fingerprint, so every run of lines with that many words
that occurs twice leaves a common fingerprint at both places.  Positions are
joined by fingerprint; those whose fingerprint occurs once are done.  The others
are extended both ways: to the windows around them that start at a line and
reach on, and those that end at a line and reach back, matched by their whole
content.  A line is deleted if it lies in a window whose content occurs earlier,
in the order (id, line): the first occurrence of everything stays, and later
runs go whole, from their first line to their last.

A group of m copies costs m rows in each step, never pairs: positions meet in
counts and minima by key, which are combined before the shuffle.

Null text stays null and has no lines.  Rows with one id and different texts are
documents of their own, in the order of the texts' hashes; rows that are equal
in id and text count as one document.  A null id comes first.  Runs within one
document count as repeated too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd
from .tables import own_names, split_by_keys, stored

MIN_WORDS = 50
_Q = 0xA0761D6478BD642F | 1
_Q_INVERSE = pow(_Q, -1, 1 << 64)


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and word counts of the lines of a run of texts, and the index of
    the first line of each text."""
    words = wd.Words(data, offsets, wd.SOLID)
    h = words.hashes(wd.EXACT_VALUES)
    breaks = np.flatnonzero(data == 10)
    # each text begins a line, and each line end does
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    line_at = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    first = np.searchsorted(words.starts, starts)
    bounds = np.append(first, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    if len(h):
        np.cumsum(h * wd.powers(_Q, len(h)), out=sums[1:])
        at = np.minimum(first, len(h) - 1)
        hashes = wd.mix((sums[bounds[1:]] - sums[bounds[:-1]]) * wd.powers(_Q_INVERSE, len(h))[at])
    else:
        hashes = np.zeros(len(starts), np.uint64)
    return hashes, np.diff(bounds).astype(np.int32), line_at


def windows(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each window of one document."""
    total = np.cumsum(counts)
    starts = np.flatnonzero(counts > 0)
    ends = np.searchsorted(total, total[starts] - counts[starts] + min_words)
    inside = ends < len(counts)
    return starts[inside], ends[inside]


def covering_windows(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows, those that end at each line with a word and reach back until
    they have the words, and windows of one line with the next one, as blank lines
    may lie between: together they cover each run of lines with that many words."""
    starts, ends = windows(counts, min_words)
    total, solid = np.cumsum(counts), np.flatnonzero(counts > 0)
    back = np.searchsorted(total - counts, total[solid] - min_words, "right") - 1
    alone = np.isin(solid[:-1], starts[starts == ends])
    first = np.concatenate((starts, back[back >= 0], solid[:-1][alone]))
    last = np.concatenate((ends, solid[back >= 0], solid[1:][alone]))
    order = np.unique(first.astype(np.int64) * len(counts) + last)
    return order // max(1, len(counts)), order % max(1, len(counts))


def _fingerprints(hashes: np.ndarray, counts: np.ndarray, min_words: int) -> np.ndarray:
    """Lines that hold the smallest hash of some window."""
    starts, ends = windows(counts, min_words)
    if not len(starts):
        return np.zeros(0, np.int32)
    shown = np.append(np.where(counts > 0, hashes, np.uint64(2**64 - 1)), np.uint64(2**64 - 1))
    lowest = np.minimum.reduceat(shown, np.ravel(np.column_stack((starts, ends + 1))))[::2]
    if len(starts) < 2 or (ends - starts).max() < 64:
        picked = [s + np.flatnonzero(shown[s : e + 1] == m) for s, e, m in zip(starts, ends, lowest, strict=True)]
        return np.unique(np.concatenate(picked)).astype(np.int32)
    picked = np.zeros(len(counts), bool)
    for s, e, m in zip(starts, ends, lowest, strict=True):
        picked[s : e + 1] |= shown[s : e + 1] == m
    return np.flatnonzero(picked).astype(np.int32)


def _scan(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wd.flat(batch.column(2))
            for i, j in wd.steps(offsets):
                hashes, counts, at = line_table(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                chosen = [_fingerprints(hashes[a:b], counts[a:b], min_words) for a, b in zip(at, at[1:], strict=False)]
                ends = np.concatenate(([0], np.cumsum([len(c) for c in chosen])))
                places = np.concatenate(chosen)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in (0, 1)), wd.lists(hashes.view(np.int64), at, pa.int64()), wd.lists(counts, at, pa.int32()), wd.lists(places, ends, pa.int32()), wd.lists(hashes[places + np.repeat(at[:-1], np.diff(ends))].view(np.int64), ends, pa.int64())],
                    ["id", "key", "hashes", "counts", "chosen", "fps"],
                )

    return run


def _around(min_words: int):
    """Windows that hold one of the repeated positions, with their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"row": [], "first": [], "last": [], "h1": [], "h2": []}
            for k in range(batch.num_rows):
                hashes = np.array(batch.column("hashes")[k].values, dtype=np.int64).view(np.uint64)
                counts = np.array(batch.column("counts")[k].values, dtype=np.int32)
                at = np.sort(np.array(batch.column("at")[k].values, dtype=np.int32))
                starts, ends = covering_windows(counts, min_words)
                near = np.searchsorted(at, starts) < np.searchsorted(at, ends, "right")
                starts, ends = starts[near], ends[near]
                shown = hashes[counts > 0]  # lines without words don't count
                rank = np.concatenate(([0], np.cumsum(counts > 0)))
                a, b = rank[starts], rank[ends + 1]
                for name, base in (("h1", _Q), ("h2", 0xE7037ED1A0B428DB | 1)):
                    sums = np.zeros(len(shown) + 1, np.uint64)
                    np.cumsum(wd.mix(shown ^ np.uint64(base)) * wd.powers(base, len(shown)), out=sums[1:])
                    back = wd.powers(pow(base, -1, 1 << 64), len(shown))
                    out[name].append(wd.mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)).view(np.int64))
                out["row"].append(np.full(len(starts), k))
                out["first"].append(starts.astype(np.int32))
                out["last"].append(ends.astype(np.int32))
            if not out["row"]:
                continue
            flat = {k: np.concatenate(v) for k, v in out.items()}
            rows = pa.array(flat.pop("row"))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("key").take(rows), *(pa.array(v) for v in flat.values())], ["id", "key", *flat])

    return run


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, key, spans): the line ranges [first, last] that repeat earlier ones;
    key is the hash of the text."""
    kind = docs.schema[id_col].dataType
    ids = [T.StructField("id", kind), T.StructField("key", T.LongType())]
    scanned = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col)).mapInArrow(
        _scan(min_words), T.StructType([*ids, T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("chosen", T.ArrayType(T.IntegerType())), T.StructField("fps", T.ArrayType(T.LongType()))])
    )
    lines = stored(scanned.filter(F.size("chosen") > 0))
    marks = lines.select("id", "key", F.explode(F.arrays_zip("chosen", "fps")).alias("x")).select("id", "key", F.col("x.chosen").alias("at"), F.col("x.fps").alias("fp"))
    repeated = marks.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    places = marks.join(repeated, "fp", "left_semi").groupBy("id", "key").agg(F.collect_set("at").alias("at"))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))
    joined = lines.alias("l").join(places.alias("p"), same("l", "p")).select("l.id", "l.key", "l.hashes", "l.counts", "p.at").dropDuplicates(["id", "key"])
    long, int_ = T.LongType(), T.IntegerType()
    spans = stored(joined.mapInArrow(_around(min_words), T.StructType([*ids, T.StructField("first", int_), T.StructField("last", int_), T.StructField("h1", long), T.StructField("h2", long)])))
    first = spans.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "first")).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = spans.join(first, ["h1", "h2"]).filter(~(F.struct("id", "key", "first").eqNullSafe(F.col("origin"))))
    return later.groupBy("id", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


NEW = ("clean_text", "n_lines", "n_removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with clean_text, n_lines and n_removed.  A text that loses nothing
    stays as it is and is not shuffled.  Columns of these names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in NEW])
    of, key, gone, parts, hash_ = own_names(docs, "_id", "_key", "_gone", "_parts", "_hash")
    runs = stored(repeated_runs(docs, id_col, text_col, min_words).select(F.col("id").alias(of), F.col("key").alias(key), _lines(F.col("spans")).alias(gone)))
    hit, rest = split_by_keys(docs.withColumn(hash_, F.xxhash64(text_col)), hash_, runs, key)
    joined = hit.join(runs.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(of)) & (F.col(hash_) == F.col(key)), "left")
    joined = joined.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(text_col, "\n")))
    # both lists are in order, so what stays is what array_except keeps of the numbered lines
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(F.col(parts), i))
    n_lines = F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    changed = joined.select(
        *docs.columns,
        F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")).alias("clean_text"),
        n_lines.alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
    return changed.unionByName(rest.select(*docs.columns, F.col(text_col).alias("clean_text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed")))


def _lines(spans):
    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"])))))
