"""Reader of neutralisation result tables: one table for each study, in a folder or
in the Tab folder of an archive, all under one contract.

Files are parsed where they are read; each line becomes a map under the normalised
header, or a fault.  A study is exported, skipped (it has no table) or failed, with
its reasons; rows of studies without faults make the export.  A file of no bytes is
no table, as Spark passes such files by.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import ContractError
from .repository import binary_files

#: The table's name and the columns that it must have.
TABLE = "neut_ab_titer_result.txt"
REQUIRED = (
    "result_id",
    "study_accession",
    "experiment_accession",
    "expsample_accession",
    "biosample_accession",
    "subject_accession",
    "study_time_collected",
    "study_time_collected_unit",
    "value_preferred",
    "value_reported",
    "unit_preferred",
    "unit_reported",
    "virus_strain_preferred",
    "virus_strain_reported",
)
_NOT_EMPTY = ("result_id", "expsample_accession", "biosample_accession")
_SCHEMA = "accession string, path string, line_no long, header array<string>, fields map<string,string>, fault string, missing boolean"


def _header(line: str) -> tuple[list[str], str | None]:
    names = [c.strip().strip('"').lower() for c in line.rstrip("\r\n").split("\t")]
    if not all(names):
        return names, "empty column name"
    if len(set(names)) < len(names):
        return names, "repeated column name"
    lacking = sorted(set(REQUIRED) - set(names))
    return names, f"missing columns: {', '.join(lacking)}" if lacking else None


def parsed(accession: str, path: str, lines: Iterator[str]) -> Iterator[tuple]:
    """Rows of _SCHEMA of one table; a line with more fields than the header is a
    fault, one with fewer has blanks."""
    first = next(lines, None)
    if first is None or not first.strip():
        yield accession, path, 1, None, None, "no header", False
        return
    names, fault = _header(first)
    if fault:
        yield accession, path, 1, names, None, fault, False
        return
    k = 1
    for k, line in enumerate(lines, 2):
        values = [v.strip() for v in line.rstrip("\r\n").split("\t")]
        if len(values) > len(names):
            yield accession, path, k, names, None, f"line {k} has more fields than its header", False
            continue
        values += [""] * (len(names) - len(values))
        yield accession, path, k, names, list(zip(names, values, strict=True)), None, False
    if k == 1:
        yield accession, path, 1, names, None, "no rows", False


def _of_source(accession: str, path: str, is_zip: bool, content: bytes | None) -> Iterator[tuple]:
    if content is None:
        yield accession, path, None, None, None, None, True
    elif not is_zip:
        yield from parsed(accession, path, iter(io.TextIOWrapper(io.BytesIO(content), "utf-8", newline="")))
    else:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            yield accession, path, None, None, None, "not an archive", False
            return
        found = [m for m in archive.namelist() if m.split("/")[-1] == TABLE and "Tab" in m.split("/")[:-1]]
        if len(found) != 1:
            yield accession, path, None, None, None, f"{len(found)} members {TABLE}" if found else None, not found
            return
        with archive.open(found[0]) as raw:
            yield from parsed(accession, f"{path}!{found[0]}", iter(io.TextIOWrapper(raw, "utf-8", newline="")))


def read_tables(sources: DataFrame) -> DataFrame:
    """Lines and faults of (accession, path, is_zip), the source chosen of each
    study: a folder (whose table may lack) or an archive."""
    spark = sources.sparkSession
    chosen = sources.select(F.upper("accession").alias("accession"), F.regexp_replace("path", r"^file:/+", "/").alias("path"), "is_zip")
    wanted = chosen.withColumn("_file", F.when(F.col("is_zip"), F.col("path")).otherwise(F.concat(F.regexp_replace("path", "/+$", ""), F.lit(f"/{TABLE}"))))
    folders = [r["f"] for r in wanted.select(F.regexp_replace("_file", r"/[^/]*$", "").alias("f")).distinct().collect()]  # of a list of sources
    files = None
    for f in folders:
        one = binary_files(spark, f).select(F.regexp_replace("path", r"^file:/+", "/").alias("_file"), "content")
        files = one if files is None else files.unionByName(one)
    both = wanted.join(files.distinct(), "_file", "left") if files is not None else wanted.withColumn("content", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_()]
        names = ["accession", "path", "line_no", "header", "fields", "fault", "missing"]
        for batch in batches:
            for row in range(batch.num_rows):
                held = list(_of_source(*(batch.column(c)[row].as_py() for c in range(4))))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    lines = both.select("accession", "path", "is_zip", "content").mapInArrow(run, _SCHEMA)
    # what a row's own values break
    of = lambda c: F.try_element_at("fields", F.lit(c))
    found = F.when(F.upper(of("study_accession")) != F.col("accession"), F.concat(F.lit("another study: "), of("study_accession")))
    for c in _NOT_EMPTY:
        found = F.coalesce(found, F.when(of(c) == "", F.lit(f"empty {c}")))
    return lines.withColumn("fault", F.coalesce("fault", F.when(F.col("fields").isNotNull(), found)))


def study_status(lines: DataFrame) -> DataFrame:
    """(accession, status, n_rows, n_faults, reasons): exported, skipped or failed; of
    the reasons the first 20 are given."""
    reasons = F.array_sort(F.collect_set(F.when(F.col("fault").isNotNull(), F.concat_ws(" ", F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(":")), "fault"))))
    out = lines.groupBy("accession").agg(F.count("fields").alias("n_rows"), F.count("fault").alias("n_faults"), F.max("missing").alias("_m"), reasons.alias("reasons"))
    status = F.when(F.size("reasons") > 0, "failed").when(F.col("_m"), "skipped").otherwise("exported")
    return out.select("accession", status.alias("status"), "n_rows", "n_faults", F.slice("reasons", 1, 20).alias("reasons"))


def columns_of(lines: DataFrame) -> list[str]:
    """The union of all headers: the required columns, then others by name."""
    names = {r["c"] for r in lines.filter("fields IS NOT NULL").select("accession", "header").distinct().select(F.explode("header").alias("c")).distinct().collect()}
    return [*REQUIRED, *sorted(names - set(REQUIRED))]


def headers_differ(lines: DataFrame) -> DataFrame:
    """Columns that some exported studies have and others lack."""
    per = lines.filter("fields IS NOT NULL").select("accession", F.explode("header").alias("column")).distinct()
    n = lines.filter("fields IS NOT NULL").select("accession").distinct().agg(F.count("*").alias("n"))
    return per.groupBy("column").agg(F.count("*").alias("k"), F.array_sort(F.collect_set("accession")).alias("studies")).crossJoin(n).filter("k < n").select("column", "studies")  # n is one row


def export(sources: DataFrame, strict: bool = True) -> DataFrame:
    """The rows of all studies under the union of their columns, blank where a study
    lacks one, sorted.  If strict, a failed study or differing headers are errors;
    else failed studies are left out (see study_status()).  No rows, or a result id
    that a study has twice, is an error always."""
    lines = read_tables(sources)
    status = study_status(lines)
    failed = status.filter("status = 'failed'").orderBy("accession")
    if strict:
        wrong = failed.limit(3).collect()
        if wrong:
            raise ContractError("; ".join(f"{r['accession']}: {', '.join(r['reasons'])}" for r in wrong))
        if differ := headers_differ(lines).limit(5).collect():
            raise ContractError(f"columns that not all studies have: {', '.join(r['column'] for r in differ)}")
    good = lines.filter("fields IS NOT NULL").join(failed.select("accession"), "accession", "left_anti")
    value: dict[str, Column] = {c: F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit("")) for c in columns_of(good)}
    out = good.select(*[v.alias(c) for c, v in value.items()])
    if out.isEmpty():
        raise ContractError("no results were found")
    twice = out.groupBy("study_accession", "result_id").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ContractError(f"result ids repeat: {', '.join(r['result_id'] for r in twice)}")
    return out.orderBy("study_accession", "expsample_accession", "result_id")
