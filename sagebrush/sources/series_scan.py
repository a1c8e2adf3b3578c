"""Scan of series matrices for single probes, as a Spark data source.

``probe_id = '...'`` and ``probe_id IN (...)`` reach the reader: it compares the
beginning of each line and splits only lines of those probes.  With check "first" it
stops at the last of them; with "whole" it goes on to the end marker and reports what
breaks the rules of the file or of the row in ``fault`` (one row for each fault and
probe).  Without such a filter all rows are split.

Files are read through Arrow's file systems, one file a task, as streams.
"""

from __future__ import annotations

import gzip
import io
import math
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from ..operators.relational import ContractError

SCHEMA = "path string, probe_id string, gsm_accession string, ordinal int, value_str string, value double, fault string"
BEGIN, END = "!series_matrix_table_begin", "!series_matrix_table_end"


def _fields(line: str) -> list[str]:
    return [v.strip().strip('"') for v in line.rstrip("\r\n").split("\t")]


def _number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def scan(path: str, lines: Iterable[str], probes: frozenset[str] | None, whole: bool) -> Iterator[tuple]:
    """Rows of SCHEMA.  ``probes`` None takes all.  A blank or NA has no cell if not
    whole, and is a fault otherwise, as is what is no finite number."""
    lines = iter(lines)
    fault = lambda probe, what: (path, probe, None, None, None, None, what)
    asked = sorted(probes) if probes is not None else [None]
    samples: list[str] = []
    for line in lines:
        if line.startswith(BEGIN):
            break
        if line.startswith("!Sample_geo_accession"):
            samples = [v.upper() for v in _fields(line)[1:]]
    else:
        yield from (fault(p, "no begin marker") for p in asked)
        return
    header = _fields(next(lines, ""))
    columns = [v.upper() for v in header[1:]]
    if whole:
        for wrong, what in ((header[0] != "ID_REF", "first column is not ID_REF"), (columns != samples, "columns differ from the header's samples"), (len(set(samples)) < len(samples), "sample accession repeated")):
            if wrong:
                yield from (fault(p, what) for p in asked)
    starts = tuple(s for p in probes for s in (f"{p}\t", f'"{p}"\t')) if probes is not None else None
    left, found, ends = set(probes or ()), {}, 0
    for line in lines:
        if line.startswith(END):
            ends += 1
            if not whole:
                break
            continue
        if starts is not None and not line.startswith(starts):
            continue
        probe, *values = _fields(line)
        if not probe or ends:
            continue
        found[probe] = found.get(probe, 0) + 1
        if whole and len(values) != len(columns):
            yield fault(probe, f"width of {probe}")
        elif found[probe] == 1:
            for k, (gsm, text) in enumerate(zip(columns, values, strict=False)):
                value = _number(text)
                if value is not None:
                    yield path, probe, gsm, k, text, value, None
                elif whole:
                    yield fault(probe, f"value of {gsm} is not numeric")
        left.discard(probe)
        if not whole and probes is not None and not left:
            return
    if whole:
        if ends != 1:
            yield from (fault(p, "no end marker" if not ends else "end marker repeated") for p in asked)
        yield from (fault(p, "no row of the probe") for p in sorted(left))
        yield from (fault(p, "several rows of the probe") for p, k in sorted(found.items()) if k > 1)


def _open(path: str) -> io.TextIOBase:
    files, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    raw = io.BufferedReader(files.open_input_stream(inside, compression=None))
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw, "utf-8", newline="")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.whole = options["path"], options.get("check", "whole") == "whole"
        self.probes: frozenset[str] | None = None
        self.named = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("probe_id",):
                asked = frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}
                self.probes = asked if self.probes is None else self.probes & asked
            elif isinstance(f, IsNotNull) and f.attribute == ("probe_id",):
                self.named = True
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, inside = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = files.get_file_info(inside)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(inside, recursive=True))
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [InputPartition(prefix + f.path) for f in found if f.is_file] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None and self.probes != frozenset():
            with _open(partition.value) as lines:
                rows = scan(partition.value, lines, self.probes, self.whole)
                yield from (r for r in rows if r[1] is not None or not self.named)


class SeriesMatrix(DataSource):
    """Options: path (a file or a folder), check (whole or first)."""

    @classmethod
    def name(cls) -> str:
        return "series_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_probes(spark: SparkSession, path: str, check: str = "whole") -> DataFrame:
    """All cells below a path; filter by probe_id to have only its lines split."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesMatrix)
    return spark.read.format("series_matrix").option("check", check).load(path)


def feature_values(spark: SparkSession, path: str, probe: str) -> DataFrame:
    """The checked cells of one probe; anything wrong with a file or row is an error."""
    rows = read_probes(spark, path).filter(F.col("probe_id") == probe)
    wrong = [f"{r['path']}: {r['fault']}" for r in rows.filter("fault IS NOT NULL").select("path", "fault").orderBy("path", "fault").limit(5).collect()]
    if wrong:
        raise ContractError("; ".join(wrong))
    return rows.drop("fault")


def probe_lookup(spark: SparkSession, path: str, probes: list[str]) -> DataFrame:
    """The cells of some probes, each file left at the last of their lines; blanks
    and NA are skipped, and a probe that a file lacks has no rows."""
    return read_probes(spark, path, "first").filter(F.col("probe_id").isin(probes)).drop("fault")
