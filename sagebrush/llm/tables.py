"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder, stored

#: Bits of the bitmap by which rows that need no join are passed by.
FLAG_BITS = 25
_BUCKET_BITS = 15  # of Spark's bitmaps: 4 KB each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that is never turned into a broadcast, as both sides grow with the
    input."""
    return left.join(right.hint("merge"), on, how)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a compressed table in shared_folder().  Small parts are
    read together, so what follows has as many tasks as its rows need.  For narrow
    rows: a reader holds some thousand of them at a time."""
    path = f"{shared_folder(df.sparkSession)}/table_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """written(), and how many rows meet a condition, in one job."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get["n"]


def dropped(*tables: DataFrame) -> None:
    """Delete the files of written() tables, once all that reads them is stored."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def split_by_keys(df: DataFrame, key: str, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose hash in ``key`` is among the hashes of ``keys`` (and few
    others), and the rest, without a shuffle of df.  The keys pass as a bitmap of
    2**FLAG_BITS flags: at most 1024 rows of 4 KB, whatever the input, so it may be
    broadcast.  A fuller bitmap only sends more rows to the first part."""
    slot = F.col(column).bitwiseAND(F.lit((1 << FLAG_BITS) - 1))
    bucket, bits, flag = own_names(df, "_bucket", "_bits", "_flag")
    flags = keys.select((slot + 1).alias("s")).groupBy((F.bitmap_bucket_number("s") - 1).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias(bits))
    flags = F.broadcast(stored(flags))
    slot = F.col(key).bitwiseAND(F.lit((1 << FLAG_BITS) - 1))
    position = slot.bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, position.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    marked = df.withColumn(bucket, F.shiftright(slot, _BUCKET_BITS)).join(flags, bucket, "left").withColumn(flag, F.coalesce(set_, F.lit(False)))
    return marked.filter(flag).select(*df.columns), marked.filter(~F.col(flag)).select(*df.columns)
