"""N-gram Jaccard join: components of documents whose sets of 5-word shingles
have a Jaccard similarity of at least 0.8.

Shingles are hashed into GROUPS groups, and the group counts of a document are
a point; the overlap of two sets is at most the sum of the smaller coordinates.
An R-tree over such points prunes by that bound: a leaf has the largest count
of its points in each group, and two leaves (or points) whose summed minima stay
below the overlap that the threshold needs are never compared.

A tree over all points alone would not scale: counts of unrelated texts of one
length lie so close in every single coordinate that a leaf's rectangle bounds
nothing (README gives figures), so its upper levels are made of exact cells
instead.  Texts with one set of shingles are one class.  Two classes that link
share one of the n - ceil(0.8 n) + 1 rarest shingles of each, whatever the order
of rarity; so each class sends those to the cells of its shingles.

1. A count sketch of all shingles, sized by their number, gives the order of rarity.
2. A cell is streamed in the order of sizes.  A member meets the members of
   compatible size before it, if there are at most WINDOW; pairs are counted over
   cells, and as two sets that link share many of their rarest shingles, not just
   one, pairs with too few common cells go.  A member with more of them before it
   (a cluster, or a common passage) is deferred: it sends one edge to a pivot,
   and one to the first of its run in the cell, so that blocks are flat.  So m
   members send at most WINDOW * m pairs.  A cell of more than CELL_ROWS members
   is dealt over several tasks: there every member is deferred, with an edge to a
   node that stands for the cell.  Only those members are met in their block whose
   shingle can be the rarest common one of a link: the smaller set lacks a ninth of
   its shingles at most, and the larger needs such a one within its reach.
3. Each class verifies the pair with the most common cells exactly; the verified
   edges are a forest and give first components.  Other pairs are verified only
   between different components, and their links join those.
4. Deferred members: components joined by the edges of runs form blocks.  In
   blocks that hold several components the points go into an R-tree: runs of LEAF
   points are leaves, runs of FAN leaves are parents, both with the largest count
   in each group.  Pairs of parents, of leaves and of points are let through by
   the bound, level by level, and the surviving pairs of points are compared
   exactly.  Of a block's largest component, no two nodes are paired.  A link that
   was not met as a pair lies inside a block, so none is lost.

A cell is never held: a task keeps the last WINDOW + 1 members of it.  All joins
are shuffled, so nothing that grows with the input passes through the driver.

Null, empty or wordless texts have no shingles and are their own components.
A text of fewer than five words is one shingle.  Repeated rows and ids are
fine; null ids take part and get the smallest id that they reach, null if none.
Ids may be of any type that can be ordered.  Shingles are told apart by 64-bit
hashes, classes by a 64-bit hash of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd
from .components import components
from .tables import dropped, shuffled, stored, written, written_and_counted

SHINGLE = 5
PERCENT = 80
GROUPS = 256
LEAF = 32
LEAF_BYTES = 1 << 20
FAN = 32
#: Over how many keys the pairs of a block's nodes are dealt.
SPREAD = 16
#: Bits of the sketch's slots: so many that one has some 2**8 shingles, between these.
SKETCH_BITS = (20, 24)
_COUNT_BITS = 20
WINDOW = 32
#: Bits of the bitmap of classes: eight flags for each class, between these.
_BITMAP_BITS = (25, 28)
#: Rows of a cell that one task streams.
CELL_ROWS = 1 << 18
_BLOCK = "block"  # marks the nodes of the graph of runs


def shingle_sets(words: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other,
    and the offsets of the texts."""
    hashes, at = words.hashes(), words.at
    count = np.diff(at)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    owner = words.owner()
    full = np.zeros(n, np.uint64)
    grams = wd.kgrams(hashes, SHINGLE)
    full[: len(grams)] = grams
    take = np.arange(n) - at[owner] <= count[owner] - SHINGLE
    for k in range(1, SHINGLE):
        short = at[:-1][count == k]
        if len(short):
            full[short] = wd.kgrams(hashes, k)[short] ^ np.uint64(k)
            take[short] = True
    full, owner = full[take], owner[take]
    ends = np.searchsorted(owner, np.arange(len(at)))
    for a, b in zip(ends, ends[1:], strict=False):
        full[a:b].sort()
    distinct = np.ones(len(full), bool)
    distinct[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
    return full[distinct], np.searchsorted(owner[distinct], np.arange(len(at)))


def class_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(wd.mix(sets ^ np.uint64(0x2545F4914F6CDD1D)), out=sums[1:])
    return wd.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _slots(sets: np.ndarray, size: int) -> np.ndarray:
    return (sets & np.uint64(size - 1)).astype(np.int64)


def _bits(needed: int, bounds: tuple[int, int]) -> int:
    return min(bounds[1], max(bounds[0], int(needed).bit_length()))


def _sketch(docs: DataFrame, shingles: int = 0, salts: int = 512) -> np.ndarray:
    """Occurrences of shingles by slot, over all documents that have so many.  Each
    task sums its own, tasks are summed by part of the sketch (more than ``salts`` of
    them in two steps), and the driver gets 2**20 to 2**24 counts.  It gives an order of
    rarity, and decides nothing else."""
    size, part = 1 << _bits(shingles >> 8, SKETCH_BITS), 1 << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, words in wd.doc_steps(batch.column(0), wd.SOLID):
                total += np.bincount(_slots(shingle_sets(words)[0], size), minlength=size)
        parts = total.reshape(-1, part)
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), salt, np.int32)), pa.array([p.astype(np.uint32).tobytes() for p in parts], pa.binary())], ["part", "salt", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(part, np.uint64)
        for x in rows.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pa.table([rows.column("part").slice(0, 1), rows.column("salt").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["part", "salt", "counts"])

    schema = "part int, salt int, counts binary"
    sums = docs.mapInArrow(run, schema)
    if docs.rdd.getNumPartitions() > salts:
        sums = sums.groupBy("part", "salt").applyInArrow(add, schema)
    found = {r["part"]: bytes(r["counts"]) for r in sums.groupBy("part").applyInArrow(add, schema).select("part", "counts").collect()}
    empty = bytes(4 * part)
    return np.frombuffer(b"".join(found.get(p, empty) for p in range(size // part)), np.uint32)


def _tokens(docs: DataFrame, sketch: np.ndarray, cell_rows: int | None = None) -> DataFrame:
    """(cls, n, token, part, rank): the rarest shingles of each document; a token starts
    with the sketch count, so its order is the order of rarity, and rank is how many
    of the document's are rarer.  part is 0, or one of the parts over which a cell of
    more than ``cell_rows`` is dealt, from 1."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    most = np.uint64(cell_rows or CELL_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for _, _, words in wd.doc_steps(batch.column(0), wd.SOLID):
                sets, at = shingle_sets(words)
                cls = class_ids(sets, at)
                seen = counts[_slots(sets, len(counts))].astype(np.uint64)
                tokens = np.minimum(seen, np.uint64((1 << _COUNT_BITS) - 1)) << np.uint64(63 - _COUNT_BITS)
                tokens |= sets >> np.uint64(_COUNT_BITS + 1)
                n = np.diff(at)
                keep = np.where(n > 0, prefix(n), 0)
                # copies inside a batch would send the same rows
                first = np.zeros(len(cls), bool)
                first[np.unique(cls, return_index=True)[1]] = True
                keep[~first] = 0
                out, rows, ranks = [], [], []
                for a, b, k in zip(at, at[1:], keep, strict=False):
                    if k:
                        order = np.argsort(tokens[a:b], kind="stable")[:k]
                        out.append(tokens[a:b][order])
                        rows.append(seen[a:b][order])
                        ranks.append(np.searchsorted(out[-1], out[-1]))
                if out:
                    owner, seen = np.repeat(cls, keep), np.concatenate(rows)
                    parts = np.where(seen > most, 1 + owner.view(np.uint64) % (seen // most + np.uint64(1)), 0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(owner),
                            pa.array(np.repeat(n, keep).astype(np.int32)),
                            pa.array(np.concatenate(out).view(np.int64)),
                            pa.array(parts.astype(np.int32)),
                            pa.array(np.concatenate(ranks).astype(np.int32)),
                        ],
                        ["cls", "n", "token", "part", "rank"],
                    )

    made = docs.mapInArrow(run, "cls long, n int, token long, part int, rank int")
    if not (sketch > most).any():  # no cell can be so large
        return made
    # a slot counts several shingles, so cells that may be large are counted
    made = written(made)
    large = made.filter("part > 0").groupBy("token").agg(F.count("*").alias("k")).filter(F.col("k") > int(most))
    parts = F.when(F.col("k").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("cls"), F.ceil(F.col("k") / int(most))))
    return shuffled(made, large, "token", "left").select("cls", "n", "token", parts.cast("int").alias("part"), "rank")


def prefix(n):
    """How many of its rarest shingles a set of n sends."""
    return n + (-PERCENT * n) // 100 + 1


def _first_common(n, rank):
    """Whether a shingle of that rank can be the rarest common one of a set of n and a
    larger set, or one of its size, that link: all that they share are from it on."""
    return rank <= n + (-2 * PERCENT * n) // (100 + PERCENT)


def _reach(n, rank):
    """The size of the largest set that a set of n can link with, if the shingle of
    that rank is the rarest common one."""
    return ((100 + PERCENT) * (n - rank)) // PERCENT - n


def _cell_node(token: np.ndarray) -> np.ndarray:
    """The nodes that stand for whole cells in the graph of runs."""
    return wd.mix(token.view(np.uint64) ^ np.uint64(0x51ED270B0B5E5A2D)).view(np.int64)


def _meet(window: int):
    """Rows sorted by (token, part, n, cls): kind 0, a pair; kind 1, an edge of a
    deferred member to its pivot, the one with the fewest rarer shingles so far; kind 2,
    an edge of a run around deferred members to its first.  a is behind b in the order
    of (n, cls).  In cells that are dealt over parts, kind 1 for all members of a part
    and kind 2 to the cell's node.  open, with kind 2: a may link with a member that it
    does not meet here, the cell's shingle being the rarest common one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(5)]  # the last rows of the cell that is open
        pivot = None  # (token, part, n, cls, rank)
        sizes_of = (None, np.zeros(0, np.int64))  # of the open cell: its sizes that a larger set may link with
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held[0])
            token, part, n, cls, place = (np.concatenate((h, np.asarray(batch.column(i)).astype(np.int64))) for i, h in enumerate(held))
            again = np.zeros(len(token), bool)  # copies met in different batches
            again[1:] = (token[1:] == token[:-1]) & (cls[1:] == cls[:-1])
            old -= int(again[:old].sum())
            token, part, n, cls, place = (x[~again] for x in (token, part, n, cls, place))
            rows = np.arange(len(token))
            same = lambda s: (token[s:] == token[: len(token) - s]) & (part[s:] == part[: len(token) - s])
            fits = lambda s: same(s) & (100 * n[: len(token) - s] >= PERCENT * n[s:])
            dealt = part > 0
            first = _first_common(n, place)
            deferred = dealt.copy()
            if len(token) > window + 1:
                deferred[window + 1 :] |= fits(window + 1)
            a, b = [], []
            for s in range(1, min(window, len(token) - 1) + 1):
                met = rows[s:][fits(s) & ~deferred[s:]]
                met = met[met >= old]
                if s > 1 and not len(met):
                    break
                a.append(met)
                b.append(met - s)
            kind = [np.zeros(len(x), np.int8) for x in a]
            late = rows[deferred]
            late = late[late >= old]
            if len(late):
                names, sizes = np.empty(len(late), np.int64), np.empty(len(late), np.int64)
                for k, i in enumerate(late.tolist()):
                    at = i if dealt[i] else i - window - 1
                    if pivot is None or pivot[:2] != (token[i], part[i]) or 100 * pivot[2] < PERCENT * n[i] or place[at] < pivot[4]:
                        pivot = (token[i], part[i], n[at], cls[at], place[at])
                    sizes[k], names[k] = pivot[2:4]
                chain = np.zeros(len(token) + window + 2, bool)
                for s in range(window + 1):
                    chain[late[~dealt[late]] - s] = True
                chain = np.flatnonzero(chain[: len(token)])
                # the member before the first of each run of them stands for the run
                begins = np.append(True, np.diff(chain) > 1)[: len(chain)]
                a.append(chain)
                b.append((chain[begins] - 1)[np.cumsum(begins) - 1])
                kind.append(np.full(len(chain), 2, np.int8))
            i, j = np.concatenate(a) if a else rows[:0], np.concatenate(b) if b else rows[:0]
            kind = np.concatenate(kind) if kind else np.zeros(0, np.int8)
            # of two that link the smaller is first; a larger one that is not needs one within its reach
            open_ = first | dealt
            begin = np.flatnonzero(np.append(True, ~same(1)))
            ends = np.append(begin[1:], len(token))
            for c in np.unique(np.append(np.searchsorted(begin, late, "right") - 1, len(begin) - 1)):
                cell = slice(begin[c], ends[c])
                found = np.unique(n[cell][first[cell]])
                if sizes_of[0] == (token[cell.start], part[cell.start]):
                    found = np.union1d(found, sizes_of[1])
                least = -((-PERCENT * n[cell]) // 100)
                open_[cell] |= deferred[cell] & (np.searchsorted(found, least) < np.searchsorted(found, np.minimum(n[cell], _reach(n[cell], place[cell])), "right"))
            sizes_of = ((token[cell.start], part[cell.start]), found)  # the last one is open
            out = [cls[i], cls[j], n[i], n[j], kind, open_[i] & (kind == 2)]
            if len(late):
                pivots = (cls[late], names, n[late], sizes, np.ones(len(late), np.int8), np.zeros(len(late), bool))
                far = late[dealt[late]]
                nodes = (cls[far], _cell_node(token[far]), n[far], n[far], np.full(len(far), 2, np.int8), np.ones(len(far), bool))
                out = [np.concatenate(x) for x in zip(out, pivots, nodes, strict=True)]
            out = [x[out[0] != out[1]] for x in out]
            keep = max(0, len(token) - window - 1)
            tail = (token[keep:] == token[-1]) & (part[keep:] == part[-1])
            held = [x[keep:][tail] for x in (token, part, n, cls, place)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b", "na", "nb", "kind", "open"])

    return run


def _needed(na: Column, nb: Column) -> Column:
    """Least number of common cells of two sets that link: of their common
    shingles in the order of rarity, the i-th has a rank of at most i plus the
    number of shingles that the other set lacks.  One less, as two shingles may
    have one token."""
    least = F.ceil(F.lit(PERCENT) * (na + nb) / F.lit(100 + PERCENT))
    sent = lambda n: n - F.ceil(F.lit(PERCENT) * n / F.lit(100)) + 1
    return F.greatest(F.lit(1), F.least(sent(na) - (na - least), sent(nb) - (nb - least)) - 1)


def candidates(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, n, chain, open, best): pairs and edges to pivots to verify, with their
    common cells, the best of each a marked; and edges of runs (chain), which make
    the blocks; open, if a may have a link there that is not a pair."""
    order = ("token", "part", "n", "cls")
    met = tokens.select("token", "part", F.col("n").cast("long").alias("n"), "cls", "rank").repartition("token", "part").sortWithinPartitions(*order)
    rows = met.mapInArrow(_meet(window), "a long, b long, na long, nb long, kind byte, open boolean").groupBy("a", "b", "na", "nb", "kind").agg(F.count("*").alias("c"), F.max("open").alias("open"))
    own = W.partitionBy("a")
    rows = rows.withColumn("late", F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("c"))).over(own), F.lit(0)))
    rows = rows.filter((F.col("kind") > 0) | (F.col("c") + F.col("late") >= _needed(F.col("na"), F.col("nb"))))
    pairs = rows.groupBy("a", "b", (F.col("kind") == 2).alias("chain")).agg(F.sum("c").alias("n"), F.max("open").alias("open"))
    rank = F.row_number().over(own.orderBy("chain", F.desc("n"), "b"))
    return written(pairs.withColumn("best", (rank == 1) & ~F.col("chain")))


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """2**25 to 2**28 flags of the values of a column of hashes, by how many there
    are: at most 8192 rows of 4 KB reach the driver, in one job.  A fuller bitmap only
    lets more rows pass."""
    size = 1 << _bits(8 * keys.agg(F.approx_count_distinct(column)).first()[0], _BITMAP_BITS)
    slot = F.col(column).bitwiseAND(F.lit(size - 1)) + 1
    rows = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in rows.collect():
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def _flagged(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = keys & (8 * len(bits) - 1)
    return ((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)


def _blobs(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def packed(sets: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The points of the sets, and the rest of their shingles.  A shingle's group
    is the first 8 bits of its hash; in the order of hashes the counts of groups
    and the other 56 bits of each make up the set, in 7 bytes a shingle."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    points = np.bincount(owner * GROUPS + (sets >> np.uint64(56)).astype(np.int64), minlength=n * GROUPS)
    wide = points.max(initial=0) > 65535
    points = points.astype(np.uint32 if wide else np.uint16)
    rest = np.ascontiguousarray(sets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).ravel()
    return _blobs(points, np.arange(n + 1) * GROUPS), _blobs(rest, at * 7)


def unpacked(point: np.ndarray, rest: bytes) -> np.ndarray:
    out = np.zeros((len(rest) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(rest, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel() | np.repeat(np.arange(GROUPS, dtype=np.uint64) << np.uint64(56), point)


def _sets(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(cls, n, point, rest) of the classes that the bitmap lets through."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, words in wd.doc_steps(batch.column(0), wd.SOLID):
                sets, at = shingle_sets(words)
                cls, n = class_ids(sets, at), np.diff(at)
                near = np.flatnonzero(_flagged(shared.value, cls) & (n > 0))
                new = [k for k, c in zip(near.tolist(), cls[near].tolist(), strict=True) if not (c in seen or seen.add(c))]
                if len(seen) > 1 << 20:  # bounds memory; the rest of the copies meet by key
                    seen.clear()
                if new:
                    point, rest = packed(sets, at)
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n), point, rest], ["cls", "n", "point", "rest"]).take(pa.array(new))

    return texts.mapInArrow(run, "cls long, n long, point binary, rest binary").dropDuplicates(["cls"])


def _points(column: pa.Array) -> np.ndarray:
    found = column.to_pylist()
    if all(len(x) == 2 * GROUPS for x in found):
        return np.frombuffer(b"".join(found), np.uint16).reshape(-1, GROUPS)
    return np.array([np.frombuffer(x, np.uint16 if len(x) == 2 * GROUPS else np.uint32) for x in found], np.uint32)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets: the bound first, then the sets themselves."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            left, right = _points(part.column("pa")), _points(part.column("pb"))
            size = np.asarray(part.column("na")) + np.asarray(part.column("nb"))
            keep = enough(np.minimum(left, right).sum(axis=1, dtype=np.int64), size)
            for k in np.flatnonzero(keep):
                one, two = unpacked(left[k], part.column("ra")[int(k)].as_py()), unpacked(right[k], part.column("rb")[int(k)].as_py())
                keep[k] = enough(len(np.intersect1d(one, two, assume_unique=True)), size[k])
            yield part.select(["x", "y"]).filter(pa.array(keep))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the x and y of the pairs (a, b, x, y) whose sets reach the threshold."""
    side = lambda k: sets.select(F.col("cls").alias(k), *[F.col(c).alias(c[0] + k) for c in ("n", "point", "rest")])
    sizes = (F.lit(100) * F.col("nb") >= F.lit(PERCENT) * F.col("na")) & (F.lit(100) * F.col("na") >= F.lit(PERCENT) * F.col("nb"))
    both = shuffled(shuffled(pairs, side("a"), "a"), side("b"), "b").filter(sizes)
    return both.select("x", "y", "na", "nb", "pa", "pb", "ra", "rb").mapInArrow(_verify, "x long, y long").toDF("a", "b")


def enough(minima, sizes):
    """Whether an overlap of ``minima`` reaches the threshold for two sets of
    ``sizes`` in all."""
    return (100 + PERCENT) * minima >= PERCENT * sizes


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            low = np.minimum(_points(part.column("pa")), _points(part.column("pb"))).sum(axis=1, dtype=np.int64)
            yield part.select(["l1", "l2"]).filter(pa.array(enough(low, np.asarray(part.column("na")) + np.asarray(part.column("nb")))))


def _leaves(leaf: int, fan: int):
    """Rows sorted by (block, comp, n, cls) as leaves: runs of one block of at
    most ``leaf`` members and LEAF_BYTES of sets (a larger set alone), with the
    largest count of the members' points in each group.  ``fan`` leaves have one
    number of a parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            block = np.asarray(batch.column("block"))
            size = np.cumsum(7 * np.asarray(batch.column("n")) + 2 * GROUPS)
            i = 0
            while i < batch.num_rows:
                j = min(i + leaf, int(np.searchsorted(size, size[i] + LEAF_BYTES, "right")))
                j = max(i + 1, min(j, i + int((block[i:j] == block[i]).sum())))
                part = batch.slice(i, j - i)
                n, comp = np.asarray(part.column("n")), np.asarray(part.column("comp"))
                top = _points(part.column("point")).max(axis=0).astype(np.uint32)
                alone = bool((comp == np.asarray(part.column("main"))).all())
                one = [[int(block[i])], [number], [number // fan], [alone], [int(n.min())], [int(n.max())], [top.tobytes()]]
                one += [[part.column(c).to_pylist()] for c in ("n", "comp", "point", "rest")]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, _LEAF_TYPES, strict=True)], _LEAF_NAMES)
                number += 1
                i = j

    return run


_NODE_SCHEMA = "block long, node long, parent long, alone boolean, lo long, hi long, top binary"
_LEAF_NAMES = ["block", "node", "parent", "alone", "lo", "hi", "top", "ns", "comps", "points", "rests"]
_LEAF_TYPES = [*[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 2, pa.binary(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.binary())] * 2]
_LEAF_SCHEMA = f"{_NODE_SCHEMA}, ns array<long>, comps array<long>, points array<binary>, rests array<binary>"


def _parents(rows: pa.Table) -> pa.Table:
    """The parent of the few leaves of a block that have its number."""
    top = np.max([np.frombuffer(x, np.uint32) for x in rows.column("top").to_pylist()], axis=0)
    one = {
        "block": rows.column("block")[0].as_py(),
        "node": rows.column("parent")[0].as_py(),
        "parent": -1,
        "alone": all(rows.column("alone").to_pylist()),
        "lo": min(rows.column("lo").to_pylist()),
        "hi": max(rows.column("hi").to_pylist()),
        "top": top.tobytes(),
    }
    return pa.Table.from_pylist([one], pa.schema(list(zip(_LEAF_NAMES, _LEAF_TYPES, strict=False))[:7]))


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between the components of two leaves, as a forest: points first,
    then the sets of pairs whose components are not joined yet."""
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            x, y = ({c: batch.column(f"{c}{k}")[row].values for c in ("ns", "comps", "points", "rests")} for k in (1, 2))
            n1, n2, c1, c2 = (np.asarray(t[c]) for c in ("ns", "comps") for t in (x, y))
            p1, p2 = _points(x["points"]), _points(y["points"])
            parent: dict[int, int] = {}

            def root(c: int, parent=parent) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            for i in range(len(n1)):
                low = np.minimum(p1[i], p2).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(enough(low, n1[i] + n2) & (c1[i] != c2))
                one = unpacked(p1[i], x["rests"][i].as_py()) if len(near) else None
                for j in near.tolist():
                    a, b = root(int(c1[i])), root(int(c2[j]))
                    if a != b and enough(len(np.intersect1d(one, unpacked(p2[j], y["rests"][j].as_py()), assume_unique=True)), n1[i] + n2[j]):
                        parent[max(a, b)] = min(a, b)
                        out.append((int(c1[i]), int(c2[j])))
        ends = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _fitting(x: str, y: str) -> Column:
    """Whether the sizes of two nodes let some of their points link."""
    return (F.lit(100) * F.col(f"hi{y}") >= F.lit(PERCENT) * F.col(f"lo{x}")) & (F.lit(100) * F.col(f"hi{x}") >= F.lit(PERCENT) * F.col(f"lo{y}"))


def _let_through(pairs: DataFrame) -> DataFrame:
    """(l1, l2) of pairs of nodes that the bound lets through; the smallest sizes
    ask for the least overlap."""
    pairs = pairs.filter(_fitting("1", "2") & ~(F.col("alone1") & F.col("alone2")))
    return pairs.select(F.col("node1").alias("l1"), F.col("node2").alias("l2"), F.col("lo1").alias("na"), F.col("lo2").alias("nb"), F.col("top1").alias("pa"), F.col("top2").alias("pb")).mapInArrow(_bounded, "l1 long, l2 long")


def tree_links(points: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(a, b): components of points (cls, n, point, rest, comp, block, main) that a
    link inside a block joins, by an R-tree of each block, of points, leaves and
    parents.  ``main`` is the component of most members of the block: two nodes
    that hold nothing else are not paired.  Pairs of points stay inside a task; it
    sends a forest of components."""
    order = ("block", "comp", "n", "cls")
    made = points.repartitionByRange(*order).sortWithinPartitions(*order).select("block", "comp", "main", "n", "point", "rest")
    # a run of leaves may reach over blocks; each block has a parent of its own there
    leaves = stored(made.mapInArrow(_leaves(leaf, fan), _LEAF_SCHEMA).withColumn("parent", F.xxhash64("block", "parent")))
    nodes = leaves.select("block", "node", "parent", "alone", "lo", "hi", "top")
    parents = stored(nodes.groupBy("block", "parent").applyInArrow(_parents, _NODE_SCHEMA))
    side = lambda df, k, *more: df.select(*[F.col(c).alias(f"{c}{k}") for c in ("node", "parent", "alone", "lo", "hi", "top", *more)], "block")
    # the rows of a block meet under SPREAD keys; of two nodes the pair is taken once
    dealt = side(parents, "1").withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = shuffled(dealt, side(parents, "2").withColumn("key", F.pmod("node2", F.lit(SPREAD)).cast("int")), ["block", "key"])
    above = _let_through(met.filter("node1 <= node2")).toDF("parent1", "parent2")
    below = shuffled(shuffled(above, side(nodes, "1"), "parent1"), side(nodes, "2").drop("block"), "parent2").filter("parent1 <> parent2 OR node1 <= node2")
    whole = lambda k: leaves.select(F.col("node").alias(f"l{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("ns", "comps", "points", "rests")])
    near = shuffled(shuffled(_let_through(below), whole("1"), "l1"), whole("2"), "l2").drop("l1", "l2")
    return near.mapInArrow(_inside, "a long, b long")


def profiles(docs: DataFrame, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """(id, cls, n) of each row, with the hash of its text as key if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in wd.doc_steps(batch.column(1), wd.SOLID):
                sets, at = shingle_sets(words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(class_ids(sets, at)), pa.array(np.diff(at)), *(c.slice(i, j - i) for c in batch.columns[2:])], schema.fieldNames())

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), *([T.StructField("key", T.LongType())] if keyed else [])])
    return docs.select(id_col, text_col, *([F.xxhash64(text_col)] if keyed else [])).mapInArrow(run, schema)


def _labelled(df: DataFrame, labels: DataFrame, node: str | Column, to: str) -> DataFrame:
    """df with the label of a node, null where it has none."""
    named = labels.select(F.col("node").alias("_n"), F.col("label").alias(to))
    return df.join(named.hint("merge"), (F.col(node) if isinstance(node, str) else node) == F.col("_n"), "left").drop("_n")


def _in_graph_of_runs(c: str) -> Column:
    return F.xxhash64(F.col(c), F.lit(_BLOCK))


def _component(df: DataFrame, labels: DataFrame, merged: DataFrame) -> DataFrame:
    """df with comp, the component of cls by the first links and those between their components."""
    named = _labelled(df, labels, "cls", "_first").withColumn("_first", F.coalesce("_first", "cls"))
    return _labelled(named, merged, "_first", "comp").withColumn("comp", F.coalesce("comp", "_first")).drop("_first")


def _found_in_blocks(chain: DataFrame, sets: DataFrame, labels: DataFrame, merged: DataFrame) -> DataFrame | None:
    """(a, b): components that links inside blocks join, by the R-tree."""
    ends = chain.filter("open").select(F.col("a").alias("cls")).union(chain.select("b")).distinct()
    members = written(_component(_labelled(ends, labels, _in_graph_of_runs("cls"), "block"), labels, merged))
    several = members.groupBy("block", "comp").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("k"))
    within, n_within = written_and_counted(shuffled(members, several.filter("k > 1").select("block", "main"), "block"), F.lit(True))
    links = written(tree_links(shuffled(sets, within, "cls"))) if n_within else None
    dropped(members, within)
    return links


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of each row of docs; if keyed, also key, the
    hash of the text, and group, which tells components apart where ids don't."""
    rows = stored(profiles(docs, id_col, text_col, keyed))
    texts = docs.select(text_col)
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    met = candidates(_tokens(texts, _sketch(texts, shingles)))
    pairs, chain = met.filter("NOT chain"), met.filter("chain").select("a", "b", "open")
    sets = stored(_sets(texts, _bitmap(met.select(F.explode(F.array("a", "b")).alias("cls")), "cls")))
    ends = lambda x, y: (F.col(x).alias("x"), F.col(y).alias("y"))
    # written, as two Python steps in one stage would hold two workers for each task
    forest = written(_linked(pairs.filter("best").select("a", "b", *ends("a", "b")), sets))
    # one run finds the components of the forest and those of the graph of runs
    labels = components(forest.union(chain.select(_in_graph_of_runs("a"), _in_graph_of_runs("b"))))
    open_ = _labelled(_labelled(pairs.filter("NOT best").select("a", "b"), labels, "a", "x"), labels, "b", "y")
    open_ = open_.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y")
    found = written(_linked(open_, sets))
    merged = components(found)
    # all links of pairs are known by now, so few nodes of a block are left to pair
    in_blocks = _found_in_blocks(chain, sets, labels, merged)
    dropped(met, forest, found)
    classes = _component(rows.filter("n > 0").groupBy("cls").agg(F.min("id").alias("d")), labels, merged)
    last = [] if in_blocks is None else [components(in_blocks)]
    for more in last:
        classes = _labelled(classes, more, "comp", "whole").withColumn("comp", F.coalesce("whole", "comp"))
    classes = stored(classes.select("cls", "d", F.col("comp").alias("group")))
    dropped(labels, merged, *last, *([] if in_blocks is None else [in_blocks]))
    smallest = classes.groupBy("group").agg(F.min("d").alias("component"))
    final = shuffled(classes.select("cls", "group"), smallest, "group")
    joined = rows.join(final.hint("merge"), "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), *(["key", "group"] if keyed else []))
