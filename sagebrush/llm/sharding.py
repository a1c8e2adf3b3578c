"""Balanced shards by histogram sort, with DataFrame operations only.

Rows are ordered by (hash of the text, id), so equal texts are neighbours.  The
splitters between shards are refined in rounds: each round counts the exact
bytes of the rows in the cells of a grid inside the intervals that still hold a
splitter, and narrows each splitter to one cell, until the cell is light enough
(``tolerance`` of a shard) or holds one key.  A group of equal texts that is
heavier than that is refined further by id.  Then the rows are exchanged once,
by cell, and numbered within it; the offsets of cells are sums of exact counts.

Each round sends at most (n_shards - 1) * 4096 counts to the driver, whatever
the size of the input.

Law: the sizes of shards differ by about ``tolerance`` of a shard, or by the
heaviest single (text, id).  Null text has size ``overhead`` and counts as the
empty text for the hash.  Rows with the same text and id are interchangeable
and stay in one shard.  Ids that are no whole numbers are ordered by their hash.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Bits that a round narrows a splitter by.
BITS = 12
#: A cell of the last exchange holds about this share of the rows at most.
CELLS = 4096


def _splitters(keys: DataFrame, n_shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """(hash, id) boundaries, ascending; a row belongs behind a boundary if it
    is >= the boundary.  id None: the whole group of that hash is behind."""
    total = keys.agg(F.sum("size").alias("s")).first()["s"]
    if not total:
        return []
    allowed = max(1.0, tolerance * total / n_shards)
    # an open splitter: its prefix (levels of BITS bits over the hash, then the id), bytes below the prefix
    open_ = {k: ((), 0) for k in range(1, n_shards)}
    found: dict[int, tuple[int, int | None]] = {}
    depth = 0
    # the last level of each 64-bit key has the bits that are left
    widths = [BITS] * (64 // BITS) + [64 % BITS] if 64 % BITS else [BITS] * (64 // BITS)
    levels = [("h", sum(widths[:i]), w) for i, w in enumerate(widths)] + [("d", sum(widths[:i]), w) for i, w in enumerate(widths)]
    while open_ and depth < len(levels):
        key, shift, width = levels[depth]
        prefixes = sorted({p for p, _ in open_.values()})
        # number of the interval that a row lies in, by its bits so far
        inside = keys
        digit = _digit(key, shift, width)
        if depth:
            packed = {p: i for i, p in enumerate(prefixes)}
            inside = keys.withColumn("_p", F.coalesce(*[F.when(_matches(p, levels), F.lit(i)) for p, i in packed.items()])).filter("_p IS NOT NULL")
        else:
            packed = {(): 0}
            inside = keys.withColumn("_p", F.lit(0))
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in inside.groupBy("_p", digit.alias("_c")).agg(F.sum("size").alias("s")).collect():
            counts.setdefault(r["_p"], []).append((r["_c"], r["s"]))
        for cells in counts.values():
            cells.sort()
        still = {}
        for k, (prefix, below) in open_.items():
            target, at = total * k / n_shards, below
            cells = counts.get(packed[prefix], [])
            for cell, size in cells:
                if at + size > target:
                    here = (*prefix, cell)
                    low, high = target - at, at + size - target
                    if min(low, high) <= allowed or depth + 1 == len(levels):
                        found[k] = _boundary(here if low <= high else _after(here, levels), levels)
                    else:
                        still[k] = (here, at)
                    break
                at += size
            else:
                found[k] = _boundary(_after(prefix, levels), levels) if prefix else (1 << 64, None)
        open_ = still
        depth += 1
    return [found[k] for k in sorted(found)]


def _digit(key: str, shift: int, width: int) -> Column:
    # keys are signed; flipping the sign bit makes the unsigned order the signed one
    flipped = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(F.shiftleft(flipped, shift), 64 - width)


def _matches(prefix: tuple[int, ...], levels: list) -> Column:
    """Whether the leading bits of a row's keys are the prefix: one comparison of
    a range for each of the two keys."""
    test = None
    for key in ("h", "d"):
        part = [(v, w) for v, (k, _, w) in zip(prefix, levels, strict=False) if k == key]
        if part:
            low, bits = 0, 0
            for v, w in part:
                low, bits = (low << w) | v, bits + w
            first, last = low << (64 - bits), ((low + 1) << (64 - bits)) - 1
            here = F.col(key).between(F.lit(first - (1 << 63)).cast("long"), F.lit(last - (1 << 63)).cast("long"))
            test = here if test is None else test & here
    return test


def _after(prefix: tuple[int, ...], levels: list) -> tuple[int, ...]:
    """The next prefix of the same length; carries into the earlier levels."""
    out = list(prefix)
    for i in reversed(range(len(out))):
        out[i] += 1
        if out[i] < 1 << levels[i][2]:
            return tuple(out)
        out[i] = 0
    return (1 << levels[0][2],)  # behind everything


def _boundary(prefix: tuple[int, ...], levels: list) -> tuple[int, int | None]:
    h = d = None
    for name in ("h", "d"):
        value, bits = 0, 0
        part = [(v, w) for v, (k, _, w) in zip(prefix, levels, strict=False) if k == name]
        for v, w in part:
            value, bits = (value << w) + v, bits + w
        if part:
            value <<= 64 - bits
            if name == "h":
                h = value
            else:
                d = value
    return h, d


def _behind(boundary: tuple[int, int | None]) -> Column:
    h, d = boundary
    if h >= 1 << 64:
        return F.lit(False)
    h -= 1 << 63
    if d is None:
        return F.col("h") >= F.lit(h)
    if d >= 1 << 64:
        return F.col("h") > F.lit(h)
    return (F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("d") >= F.lit(d - (1 << 63))))


def shard_documents(docs: DataFrame, n_shards: int = 40, overhead: int = 16, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, size, text_crc32, shard, slot; one row for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    keys = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(number, F.lit(-(1 << 63))).alias("d"),
            F.xxhash64(text).alias("h"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
        )
    )
    bounds = _splitters(keys, n_shards, tolerance)
    shard = F.lit(0)
    for b in bounds:
        shard = shard + _behind(b).cast("int")
    # exchange cells: the shard and the first bits of the hash; a hot cell (copies of one text) is dealt out by id
    placed = keys.select("*", shard.alias("shard"), _digit("h", 0, BITS).alias("cell"), F.pmod(F.xxhash64("d"), F.lit(CELLS)).cast("int").alias("salt"))
    coarse = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).collect()  # at most 4096 + n_shards rows
    mean = max(1, sum(r["n"] for r in coarse) // CELLS)
    hot = {(r["shard"], r["cell"]): min(CELLS, -(-r["n"] // (4 * mean))) for r in coarse if r["n"] > 8 * mean}
    if hot:
        cells = F.create_map(*[x for (s, c), n in hot.items() for x in (F.lit(f"{s}:{c}"), F.lit(n))])
        parts = F.coalesce(F.try_element_at(cells, F.concat_ws(":", "shard", "cell")), F.lit(1))
        placed = placed.withColumn("sub", F.pmod(F.col("salt"), parts))
    else:
        placed = placed.withColumn("sub", F.lit(0))
    placed = placed.drop("salt")
    # counts of cells: at most 4096 + n_shards + 2 * 4096 rows, so their running sum is a small window
    counts = placed.groupBy("shard", "cell", "sub").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    starts = counts.select("shard", "cell", "sub", (F.sum("n").over(W.partitionBy("shard").orderBy("cell", "sub")) - F.col("n")).alias("start"))
    numbered = placed.withColumn("rank", F.row_number().over(W.partitionBy("shard", "cell", "sub").orderBy("h", "d", "size")))
    return numbered.join(F.broadcast(starts), ["shard", "cell", "sub"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank") - 1).cast("long").alias("slot")
    )
