"""Row numbers, and what is carried along an order, without one task for all rows.

Rows are cut into ranges of the order by literal splitters; windows span a range,
and counts or minima of whole ranges (one row each) are carried between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

_SAMPLED = 40


def splitters(df: DataFrame, order: list[str], parts: int) -> list[tuple]:
    """Up to parts - 1 ascending rows that cut df into ranges of like size: even
    places of a fixed number of rows, those of the smallest hashes."""
    rows = df.select(*order).distinct().orderBy(F.xxhash64(*order)).limit(parts * _SAMPLED).orderBy(*order).collect()
    return [tuple(rows[k * len(rows) // parts]) for k in range(1, parts)] if len(rows) >= parts else [tuple(r) for r in rows]


def _range_of(df: DataFrame, order: list[str], cuts: list[tuple]) -> Column:
    if not cuts:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in order]
    row = F.struct(*[F.col(c).cast(k).alias(f"c{i}") for i, (c, k) in enumerate(zip(order, kinds, strict=True))])
    listed = F.array(*[F.struct(*[F.lit(v).cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(cut, kinds, strict=True))]) for cut in cuts])
    return F.size(F.filter(listed, lambda s: s <= row))


def _carried(rows: DataFrame, keys: list[str], each: Column, along) -> DataFrame:
    """(keys, _b, carried, whole) from one row for each range: along(ranges, b) makes
    what range b gets of all ranges of its key, an array of (_b, x)."""
    ranges = rows.groupBy(*keys, "_b").agg(each.alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "x"))).alias("_all"))
    given = F.transform("_all", lambda r: F.struct(r["_b"].alias("_b"), along(F.col("_all"), r["_b"]).alias("carried")))
    return ranges.select(*keys, F.explode(given).alias("_r"), F.aggregate("_all", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["x"].cast("long"), F.lit(0).cast("long"))).alias("whole")).select(*keys, "_r.*", "whole")


def _join(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    named = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), "carried", "whole")
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same).drop("_kb", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, order: list[str], keys: list[str] | None = None, out: str = "_rn", total: str = "_m", parts: int | None = None) -> DataFrame:
    """Adds the row number in ``order`` (ascending, without ties) within ``keys``, the
    number of rows of the key, and _b, the range of the order.  Splitters, counts of
    ranges and rows come from one stored table: computed again, sums of doubles may
    differ in their last digits, and a row at a splitter would change its range."""
    keys, df = keys or [], stored(df)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_b", _range_of(df, order, splitters(df, order, parts)))
    before = lambda ranges, b: F.aggregate(F.filter(ranges, lambda r: r["_b"] < b), F.lit(0).cast("long"), lambda a, r: a + r["x"])
    whole = _join(placed, _carried(placed, keys, F.count("*"), before), keys)
    own = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    return whole.withColumn(out, own + F.col("carried")).withColumnRenamed("whole", total).drop("carried")


def least_of_later(rows: DataFrame, value: str, number: str, keys: list[str] | None = None, out: str = "_least") -> DataFrame:
    """Of numbered() rows, adds the smallest value among a row and all behind it."""
    keys = keys or []
    later = lambda ranges, b: F.array_min(F.transform(F.filter(ranges, lambda r: r["_b"] > b), lambda r: r["x"]))
    whole = _join(rows, _carried(rows, keys, F.min(value), later), keys).drop("whole")
    own = F.min(value).over(W.partitionBy(*keys, "_b").orderBy(number).rowsBetween(W.currentRow, W.unboundedFollowing))
    return whole.withColumn(out, F.least(own, "carried")).drop("carried")


def pairs_above(df: DataFrame, keys: list[str], x: str, y: str, out: str = "_above") -> DataFrame:
    """Adds, for each row, how many rows of its key have both a greater x and a
    greater y, ties in one of them counted by half and in both by a quarter (itself
    not counted).  A row stands once for each bit of its rank in y: rows above it
    share the higher bits and have the next one set where it has it clear, so running
    counts along x do, and no rows are paired."""
    ranked = df.withColumn("_y", F.dense_rank().over(W.partitionBy(*keys).orderBy(y)) - 1).withColumn("_id", F.struct(*df.columns))
    ranked = ranked.withColumn("_bits", F.ceil(F.log2(F.max("_y").over(W.partitionBy(*keys)) + 1)).cast("int"))
    # at bit k: what is above in y shares y >> (k + 1) and has bit k, which the row lacks
    level = F.explode(F.when(F.col("_bits") > 0, F.sequence(F.lit(0), F.col("_bits") - 1)).otherwise(F.array(F.lit(-1))))
    bits = ranked.select(*keys, x, y, "_y", F.col("_id"), level.alias("_k"))
    # the row of bit -1 stands for a key with one value of y, which nothing is above
    bit = F.when(F.col("_k") >= 0, F.expr("shiftright(_y, _k)").bitwiseAND(F.lit(1))).otherwise(0)
    bits = bits.withColumn("_bit", bit).withColumn("_high", F.when(F.col("_k") >= 0, F.expr("shiftright(_y, _k + 1)")).otherwise(0))
    set_ = F.count_if(F.col("_bit") == 1)
    same = [*keys, "_k", "_high"]
    greater = set_.over(W.partitionBy(*same).orderBy(F.desc(x)).rangeBetween(W.unboundedPreceding, W.currentRow)) - set_.over(W.partitionBy(*same, x))
    counted = bits.withColumn("_n", F.when(F.col("_bit") == 0, greater).otherwise(0)).groupBy("_id").agg(F.count("*").alias("_times"), F.count_if(F.col("_k") <= 0).alias("_copies"), F.sum("_n").alias("_n"))
    strict = (F.col("_n") / F.col("_copies")).alias("_strict")  # rows alike in all columns have one sum
    out_rows = counted.select(F.col("_id.*"), strict, F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))).alias("_one")).drop("_one")
    above = lambda own, tie: F.count("*").over(W.partitionBy(*keys, tie).orderBy(F.desc(own)).rangeBetween(W.unboundedPreceding, W.currentRow)) - F.count("*").over(W.partitionBy(*keys, x, y))
    halves = (above(x, y) + above(y, x)) / 2 + (F.count("*").over(W.partitionBy(*keys, x, y)) - 1) / 4
    return out_rows.withColumn(out, F.col("_strict") + halves).drop("_strict")
