"""Sinks: tab-separated tables, wide exports, logs and reports, with provenance.

Writers go through Spark's commit protocol, so a failed task leaves no half
file.  Bytes of compressed output need not repeat between runs; content_hash()
is what provenance compares.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.relational import ContractError


def write_tsv(df: DataFrame, path: str, columns: list[str], order: list[str], compression: str = "none") -> None:
    """Fixed columns and row order (of the values, not of their texts), blanks for NULL."""
    _write_sorted(df.orderBy(*order), path, columns, compression)


def _write_sorted(df: DataFrame, path: str, columns: list[str], compression: str) -> None:
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    out.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", compression=compression, quote="")


def content_hash(df: DataFrame) -> str:
    """SHA-256 over sums of row hashes: the same for the same rows in any order
    and any partitioning, and aggregated where the rows are."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    digest = F.sha2(row, 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    totals = df.agg(F.count("*"), *parts).first()
    return hexdigest(json.dumps([str(t) for t in totals] + sorted(df.columns)))


def hexdigest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def provenance(df: DataFrame, output: str) -> dict:
    return {"output": output, "rows": df.count(), "columns": df.columns, "sha256": content_hash(df), "finished": datetime.datetime.now(datetime.timezone.utc).isoformat()}


def write_observed(df: DataFrame, path: str, columns: list[str], order: list[str], inputs: str | None = None, selection: dict | None = None, compression: str = "none") -> dict:
    """write_tsv(), and the provenance of what it wrote: rows, the columns' blanks,
    the hash and the duration come from the writing job itself, by an observation of
    its rows.  ``inputs`` is a path whose files are hashed where they are read."""
    began = time.monotonic()
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)])
    digest = F.sha2(row, 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in range(8)]
    blanks = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"blank_{k}") for k, c in enumerate(columns)]
    seen = Observation()
    # observed behind the sort, which reads its input once more to cut ranges
    _write_sorted(df.orderBy(*order).observe(seen, F.count("*").alias("rows"), *parts, *blanks), path, columns, compression)
    got = seen.get
    totals = [str(got["rows"]), *[str(got[f"h{k}"]) for k in range(8)]]
    record = {"output": path, "rows": got["rows"], "columns": columns, "blank": {c: got[f"blank_{k}"] for k, c in enumerate(columns)}, "sha256": hexdigest(json.dumps(totals + sorted(columns))), "selection": selection or {}}
    if inputs:
        record["inputs"] = input_record(df.sparkSession, inputs)
    return record | {"duration_sec": round(time.monotonic() - began, 3), "finished": datetime.datetime.now(datetime.timezone.utc).isoformat()}


def input_record(spark, path: str) -> dict:
    """Number, bytes and one hash of the files below a path, in any order of reading."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = files.select(F.sha2("content", 256).alias("h"), F.col("length"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    n, size, *sums = one.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), *parts).first()
    return {"path": path, "files": n, "bytes": size, "sha256": hexdigest(json.dumps([n, *map(str, sums)]))}


def append_log(spark, record: dict, path: str) -> None:
    """One record of an append-only JSON log."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").write.mode("append").text(path)


def wide(cells: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """Long cells to a wide table with the named columns, for export."""
    return cells.groupBy(row).pivot(column, columns).agg(F.first(value))


def write_matrix_csv(matrix: DataFrame, folder: str, name: str) -> str:
    """A wide matrix as CSV under a name in which hyphens are underscores; its column
    of ids is probe_id.  Returns the path."""
    first, *samples = matrix.columns
    path = f"{folder}/{name.replace('-', '_')}"
    matrix.withColumnRenamed(first, "probe_id").orderBy("probe_id").write.mode("overwrite").csv(path, header=True, emptyValue="")
    return path


def split_ready(df: DataFrame, ready: str, folder: str) -> None:
    """Two lists, by a flag."""
    df.filter(F.col(ready)).drop(ready).write.mode("overwrite").json(f"{folder}/ready")
    df.filter(~F.coalesce(F.col(ready), F.lit(False))).drop(ready).write.mode("overwrite").json(f"{folder}/excluded")


def pending(resolved: DataFrame) -> DataFrame:
    """Items that still need a review."""
    return resolved.filter(~F.col("status").isin("verified", "verified_multiple"))


def report(verdicts: DataFrame, title: str, most: int = 1000) -> str:
    """Markdown of a small verdict table, as one text; one of more than ``most`` rows
    is an error, as reports.write_report() writes those of any length."""
    rows = verdicts.orderBy(*verdicts.columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"more than {most} rows; write_report() has no bound")
    number = lambda v: "" if v is None else f"{v:.3g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(verdicts.columns) + " |", "|" + "-|" * len(verdicts.columns)]
    return "\n".join(lines + ["| " + " | ".join(number(v) for v in r) + " |" for r in rows]) + "\n"
