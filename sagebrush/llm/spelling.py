"""Spelling variant grouping: words at edit distance one, by their halves.

An edit of one code point leaves one half of a word as it is: of a word of length l
the first l // 2 code points begin, or the others end, each word at distance one.

1. A word holds its two halves (segments).  Segments are dealt over shards by hash.
2. Each shard has an Aho-Corasick automaton of its segments.  Words are scanned by
   the shards that have a segment they can match: those of their beginnings and ends
   of the two lengths that a word as long, or one shorter, has.
3. A hit counts if its offset is right (a first half at the begin, a second half at
   the end) and the lengths differ by one at most.  What is left of the scanned word
   beside the segment is then looked up among what is left of the words that hold
   it, by the hash of what remains when one code point goes, and the distance is
   verified code point by code point.  So a segment of many words costs their number
   times their length, not their pairs.

Segments held or met by more than CELL words are split into a grid of parts of about
CELL words each, so no shard has to hold a common ending; words beyond count, like
all others, only once for each part of the other side.

Null and empty texts have no words.  Repeated rows and ids count each.  Words may be
of any length.  Ties of forms go to the smallest word in code-point order, which is
that of UTF-8 bytes.  Columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, shuffled, written, written_and_counted

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent.
RATIO = 5
#: One run in so many loses a code point (the query's test of robustness).
DROP_EVERY = 199
#: Words of a shard's segments, and of each side of a part of a common segment.
SHARD_WORDS = 1 << 16
CELL = 1 << 15
#: Distinct words that a task counts before it sends them.
_HELD = 1 << 18
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE = 0x9E3779B97F4A7C15


def _counting(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                mark = zlib.crc32(f"{name or ''}:".encode())
                for run_, n in Counter(_RUNS.findall(text.translate(_LOWER))).items():
                    h = zlib.crc32(run_.encode(), mark) if every else 1
                    if every and h % every == 0:
                        at = h % len(run_)
                        run_ = run_[:at] + run_[at + 1 :]
                    total[run_] += n
                if len(total) > _HELD:
                    yield out()
        if total:
            yield out()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = 0) -> DataFrame:
    """(word, n): lower-cased runs of letters of least_length code points that occur
    least_count times; ``drop_every`` k deletes a code point of each run whose crc32
    with its id is divisible by k."""
    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(_counting(drop_every), "word string, n long")
    return counted.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


_powers = np.ones(1, np.uint64)


def _rests(text: str) -> tuple[int, list[int]]:
    """Hash of a text, and of what remains of it without each of its code points."""
    global _powers
    n = len(text)
    if len(_powers) <= n:
        powers = np.full(max(64, 2 * n) + 1, _BASE | 1, np.uint64)
        powers[0] = 1
        _powers = np.multiply.accumulate(powers)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers[:n], out=sums[1:])
    # what is before the place, moved up by one, and what is behind it
    return int(sums[n] * _powers[1]), (sums[:-1] * _powers[1] + (sums[n] - sums[1:])).tolist()


class Shard:
    """Automaton of segments.  A payload tells for each side (0: first half, 1:
    second half) and length of the words that hold it, by the hash of what is beside
    the segment, whole and with each code point left out, the words."""

    def __init__(self, held: Iterator[tuple[int, str, str]]):
        self.automaton = ahocorasick.Automaton()
        for side, segment, word in held:
            payload = self.automaton.get(segment, None)
            if payload is None:
                payload = (len(segment), defaultdict(list))
                self.automaton.add_word(segment, payload)
            whole, rests = _rests(word[len(segment) :] if side == 0 else word[: -len(segment)])
            payload[1][side, len(word), -1, whole].append(word)
            for at, rest in enumerate(rests):
                payload[1][side, len(word), at, rest].append(word)
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, word: str) -> set[str]:
        """Words at distance one with an equal half, no longer than this one."""
        found: set[str] = set()
        if not len(self.automaton):
            return found
        n = len(word)
        for end, (size, beside) in self.automaton.iter(word):
            for side in (0, 1):
                if (end + 1 != size) if side == 0 else (end + 1 != n):  # the offset is wrong
                    continue
                fits = [length for length in (n - 1, n) if (length // 2 if side == 0 else length - length // 2) == size]
                if not fits:
                    continue
                _, rests = _rests(word[size:] if side == 0 else word[: n - size])
                for at, rest in enumerate(rests):
                    if n in fits:
                        found.update(w for w in beside.get((side, n, at, rest), ()) if near(w, word))
                    if n - 1 in fits:  # rests are moved up by one, as whole is
                        found.update(w for w in beside.get((side, n - 1, -1, rest), ()) if near(w, word))
        return found


def _meeting(held: pa.Table, scanned: pa.Table) -> pa.Table:
    shard = Shard(zip(held["side"].to_pylist(), held["half"].to_pylist(), held["holder"].to_pylist(), strict=True))
    pairs = [(w, word) for word in scanned["word"].to_pylist() for w in shard.scan(word) if (len(w), w) < (len(word), word)]
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string())})


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS, cell: int = CELL) -> DataFrame:
    """(a, b): each pair of words at distance one once, of (word, ...) with distinct
    words of two code points at least.  a is the shorter one."""
    n = F.char_length("word")
    begin = lambda k: F.substring(F.col("word"), F.lit(1), k)
    end = lambda k: F.substring(F.col("word"), n - k + 1, k)
    entry = lambda side, segment: F.struct(F.lit(side).alias("side"), segment.alias("segment"))
    half = lambda length: F.floor(length / 2).cast("int")
    held = words.select("word", F.explode(F.array(entry(0, begin(half(n))), entry(1, end(n - half(n))))).alias("e")).select("word", "e.*")
    ways = F.array_distinct(F.array(*[entry(0, begin(half(m))) for m in (n, n - 1)], *[entry(1, end(m - half(m))) for m in (n, n - 1)]))
    met = words.select("word", F.explode(ways).alias("e")).select("word", "e.*").filter("segment != ''")
    sizes = held.select("side", "segment", F.lit(1).alias("h"), F.lit(0).alias("m")).unionByName(met.select("side", "segment", F.lit(0).alias("h"), F.lit(1).alias("m")))
    sizes = sizes.groupBy("side", "segment").agg(F.sum("h").alias("h"), F.sum("m").alias("m")).filter("h > 0 AND m > 0")
    grid = written(sizes.select("side", "segment", "h", *[F.ceil(F.col(c) / cell).cast("int").alias(f"{c}_parts") for c in ("h", "m")]))
    n_shards = max(1, -(-(grid.agg(F.sum("h")).first()[0] or 0) // shard_words))
    grid = grid.drop("h")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows by the parts of their side, for each part of the other side."""
        placed = shuffled(rows, grid, ["side", "segment"]).withColumn(own, F.pmod(F.xxhash64("word", F.lit(7)), F.col(f"{own}_parts")))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts").cast("long") - 1)))
        return placed.withColumn("shard", F.pmod(F.xxhash64("side", "segment", "h", "m"), F.lit(n_shards)))

    holders = dealt(held, "h", "m").select("shard", "side", F.col("segment").alias("half"), F.col("word").alias("holder"))
    scanners = dealt(met, "m", "h").select("shard", "word").distinct()
    pairs = holders.groupBy("shard").cogroup(scanners.groupBy("shard")).applyInArrow(_meeting, "a string, b string")
    return pairs.distinct()


def variants(words: DataFrame, ratio: int = RATIO, **sizes: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n): the near word of largest n
    (ties: the smallest), if it is ``ratio`` times as frequent, and the end of the
    chain of forms.  Forms grow ``ratio`` times, so chains are short."""
    base = written(words.select("word", "n"))
    pairs = written(near_pairs(base, **sizes))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("e")).select("e.*")
    known = shuffled(both, base.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other"))).alias("best"))
    taken = F.col("n_near").isNotNull() & (-F.col("best.neg") >= ratio * F.col("n"))
    made = shuffled(base, best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.neg")).alias("form_n"))
    out, left = written_and_counted(made.withColumn("root", F.coalesce("form", "word")).withColumn("open", F.col("form").isNotNull()), F.col("open"))
    dropped(pairs, base)
    while left:  # each round doubles the steps that a root is ahead
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("goes_on"))
        step = shuffled(out, ahead, "root", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("next", "root").alias("root"), (F.col("open") & F.coalesce("goes_on", F.lit(False))).alias("open"))
        before = out
        out, left = written_and_counted(step, F.col("open"))
        dropped(before)
    return out.drop("open")
