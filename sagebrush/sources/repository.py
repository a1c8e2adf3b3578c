"""Readers of repository tables, series matrices, platform and gene tables.

Tables are read as strings; blanks are NULL inside and empty text at the sinks.
Files that can't be split (ZIP, gzip) are read one per task, as streams of rows.
"""

from __future__ import annotations

import csv
import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import header_faults
from ..operators.relational import ContractError, first_row

_ROWS = 2000


def normalized(df: DataFrame, required: list[str], source: str = "table", upper: bool = False) -> DataFrame:
    """Required columns with trimmed values; headers are trimmed and lower-cased
    (or upper-cased).  Missing or repeated headers are errors."""
    faults = header_faults(df.columns, required)
    if faults:
        raise ContractError(f"{source}: {'; '.join(faults)}")
    case = str.upper if upper else str.lower
    named = df.toDF(*[case(c.strip()) for c in df.columns])
    return named.select(*[F.nullif(F.trim(F.col(case(r))), F.lit("")).alias(case(r)) for r in required])


def read_table(spark: SparkSession, path: str, required: list[str], sep: str = "\t", upper: bool = False) -> DataFrame:
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote="", enforceSchema=False)
    return normalized(raw, required, path, upper)


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def read_zip_tables(files: DataFrame, below: str = "Tab") -> DataFrame:
    """(path, table, row_no, fields) of all members of archives below a directory
    of the given name; fields maps the lower-cased header to the value.  A member
    of a name that occurs twice in an archive has error set instead."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                archive = zipfile.ZipFile(io.BytesIO(content))
                members = [m for m in archive.namelist() if not m.endswith("/") and below in m.split("/")[:-1]]
                names = [m.rsplit("/", 1)[-1] for m in members]
                for member, name in zip(members, names, strict=True):
                    table = name.rsplit(".", 1)[0].lower()
                    if names.count(name) > 1:
                        yield path, table, 0, None, "member is not unique"
                        continue
                    with archive.open(member) as raw:
                        lines = io.TextIOWrapper(raw, "utf-8", newline="")
                        header = [h.strip().lower() for h in next(lines, "").rstrip("\r\n").split("\t")]
                        for k, line in enumerate(lines, 1):
                            values = line.rstrip("\r\n").split("\t")
                            error = None if len(values) == len(header) else "ragged row"
                            yield path, table, k, list(zip(header, [v.strip() or None for v in values], strict=False)), error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), ["path", "table", "row_no", "fields", "error"], [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()])

    return files.select("path", "content").mapInArrow(run, "path string, table string, row_no long, fields map<string,string>, error string")


def read_zip_table(files: DataFrame, name: str) -> DataFrame:
    """(path, row_no, fields) of the first member of each archive with this file name,
    in any folder; archives without one have no rows.  Lenient: bytes that are no
    UTF-8 are replaced, short rows have nulls, fields beyond the header are dropped."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                archive = zipfile.ZipFile(io.BytesIO(content))
                member = next((m for m in archive.namelist() if m.rsplit("/", 1)[-1] == name), None)
                if member is None:
                    continue
                with archive.open(member) as raw:
                    reader = csv.DictReader(io.TextIOWrapper(raw, "utf-8", errors="replace", newline=""), delimiter="\t")
                    for k, row in enumerate(reader, 1):
                        yield path, k, [(c, v) for c, v in row.items() if c is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), ["path", "row_no", "fields"], [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())])

    return files.select("path", "content").mapInArrow(run, "path string, row_no long, fields map<string,string>")


def table_of(rows: DataFrame, table: str, required: list[str]) -> DataFrame:
    """One table of read_zip_tables(), with its path and row number."""
    own = rows.filter((F.col("table") == table) & F.col("error").isNull())
    return own.select("path", "row_no", *[F.try_element_at("fields", F.lit(c)).alias(c) for c in required])


def _text(content: bytes, path: str):
    raw = io.BytesIO(content)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, "utf-8", newline="")


def read_series_matrices(files: DataFrame) -> DataFrame:
    """Long rows of series matrices: kind meta (key, gsm, attribute_order, value)
    before the table marker, kind cell (key the probe, ordinal) inside it, and
    kind error with the broken rule in value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _matrix(path, _text(content, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), ["path", "kind", "key", "gsm", "ord", "value"], [pa.string()] * 4 + [pa.int64(), pa.string()])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, key string, gsm string, ord long, value string")


def _matrix(path: str, lines) -> Iterator[tuple]:
    clean = lambda line: [v.strip().strip('"') for v in line.rstrip("\r\n").split("\t")]
    fault = lambda what: (path, "error", None, None, None, what)
    gsms: list[str] = []
    attributes: list[tuple[int, str, list[str]]] = []
    columns, ended, probes = None, False, set()
    began = False
    for k, line in enumerate(lines):
        if not began:
            if line.startswith("!series_matrix_table_begin"):
                began = True
                if len(set(gsms)) != len(gsms):
                    yield fault("sample accession repeated")
                for order, key, values in attributes:
                    if len(values) != len(gsms):
                        yield fault(f"width of {key}")
                    else:
                        yield from ((path, "meta", key, g, order, v) for g, v in zip(gsms, values, strict=True))
            elif line.startswith("!"):
                key, *values = clean(line[1:])
                if key == "Sample_geo_accession":
                    gsms = [v.upper() for v in values]
                if key.startswith("Sample_"):
                    attributes.append((k, key.removeprefix("Sample_"), values))
                elif key in ("Series_geo_accession", "Series_platform_id"):
                    yield from ((path, "series", key.removeprefix("Series_"), None, k, v) for v in values)
            continue
        if line.startswith("!series_matrix_table_end"):
            if ended:
                yield fault("end marker repeated")
            ended = True
            continue
        if ended or not line.strip():
            continue
        first, *values = clean(line)
        if columns is None:
            columns = [v.upper() for v in values]
            if first != "ID_REF":
                yield fault("first column is not ID_REF")
            if columns != gsms:
                yield fault("columns differ from the header's samples")
            continue
        if not first or first in probes:
            yield fault("probe blank or repeated")
            continue
        probes.add(first)
        if len(values) != len(columns):
            yield fault(f"width of {first}")
            continue
        yield from ((path, "cell", first, g, k, v) for k, (g, v) in enumerate(zip(columns, values, strict=True)))
    if not began:
        yield fault("no begin marker")
    elif not ended:
        yield fault("no end marker")


def sample_metadata(matrix: DataFrame) -> DataFrame:
    """(path, gsm, attribute, occurrence, attribute_order, value)."""
    order = W.partitionBy("path", "gsm", "key").orderBy("ord")
    return matrix.filter("kind = 'meta'").select("path", F.col("gsm").alias("gsm_accession"), F.col("key").alias("attribute"), (F.row_number().over(order) - 1).alias("occurrence"), F.col("ord").alias("attribute_order"), "value")


def expression(matrix: DataFrame) -> DataFrame:
    """(path, probe_id, gsm, ordinal, value_str, value); blank and NA are NULL."""
    text = F.col("value")
    value = F.when(~text.isin("", "NA"), text).try_cast("double")
    return matrix.filter("kind = 'cell'").select("path", F.col("key").alias("probe_id"), F.col("gsm").alias("gsm_accession"), F.col("ord").alias("ordinal"), text.alias("value_str"), F.when(~F.isnan(value), value).alias("value"))


def one_feature(cells: DataFrame, probe: str) -> DataFrame:
    """The cells of one probe, pushed down as an equality filter."""
    return cells.filter(F.col("probe_id") == probe)


def read_platforms(files: DataFrame) -> DataFrame:
    """(path, probe_id, attrs) of the tables between platform markers; the columns
    vary, so attrs is a map."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inside, header = False, None
                for line in _text(content, path):
                    if line.startswith("!platform_table_begin"):
                        inside = True
                    elif line.startswith("!platform_table_end"):
                        break
                    elif inside:
                        values = line.rstrip("\r\n").split("\t")
                        if header is None:
                            header = values
                        else:
                            fields = dict(zip(header, values, strict=False))
                            yield path, fields.get("ID"), list(fields.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), ["path", "probe_id", "attrs"], [pa.string(), pa.string(), pa.map_(pa.string(), pa.string())])

    return files.select("path", "content").mapInArrow(run, "path string, probe_id string, attrs map<string,string>")


def gene_index(genes: DataFrame) -> DataFrame:
    """(name, symbol): symbols, aliases and previous symbols; symbols before
    aliases before previous ones, then by row; the first wins."""
    many = lambda c, o: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.upper(F.trim(x)).alias("name"), F.lit(o).alias("o")))
    rows = genes.select("row_no", "symbol", F.explode(F.concat(many(F.col("symbol"), 0), many(F.col("alias_symbol"), 1), many(F.col("prev_symbol"), 2))).alias("x"))
    return first_row(rows.select(F.col("x.name").alias("name"), "symbol", F.col("x.o").alias("o"), "row_no"), ["name"], ["row_no", "o"]).select("name", "symbol")


#: The headers of external tools, the preferred first.
LIMMA = {
    "feature_id": ("probe_id", "GeneID", "ID", "feature_id", "gene"),
    "effect": ("logFC", "log2FoldChange", "coef", "estimate"),
    "mean_expression": ("AveExpr", "baseMean"),
    "p_value": ("P.Value", "PValue", "pvalue", "p_value"),
    "fdr": ("adj.P.Val", "padj", "FDR", "fdr"),
}


def normalize_results(df: DataFrame) -> DataFrame:
    """A result table under the common names: exact headers first, in the order of
    preference, then whatever the case; an unnamed first column may hold the ids.
    Rows without an id are refused."""
    found = {}
    for out, names in LIMMA.items():
        exact = [n for n in names if n in df.columns]
        loose = [c for n in names for c in df.columns if c.lower() == n.lower()]
        found[out] = (exact or loose or [None])[0]
    if found["feature_id"] is None and df.columns and df.columns[0].startswith("_c"):
        found["feature_id"] = df.columns[0]
    for need in ("feature_id", "effect"):
        if found[need] is None:
            raise ContractError(f"no column for {need}")
    col = lambda c: F.col(f"`{c}`")
    number = lambda c: F.lit(None).cast("double") if found[c] is None else F.when(~F.isnan(col(found[c]).try_cast("double")), col(found[c]).try_cast("double"))
    out = df.select(F.trim(col(found["feature_id"])).alias("feature_id"), *[number(c).alias(c) for c in ("effect", "mean_expression", "p_value", "fdr")])
    if not out.filter(F.coalesce("feature_id", F.lit("")) == "").isEmpty():
        raise ContractError("a row has no id")
    return out


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """normalize_results() of a file with tabs or commas, whichever its first line
    has more of."""
    first = spark.read.text(path).first()
    if first is None:
        raise ContractError(f"{path} is empty")
    sep = "\t" if first[0].count("\t") >= max(1, first[0].count(",")) else ","
    return normalize_results(spark.read.csv(path, sep=sep, header=True, inferSchema=False, enforceSchema=False))


def series_matrices(files: DataFrame) -> DataFrame:
    """(accession, path) of the series matrices in folders named by a series: the
    innermost such folder names the series, and the file must begin with it."""
    found = F.regexp_extract_all("path", F.lit(r"/(GSE\d+)(?=/)"), F.lit(1))
    named = files.withColumn("accession", F.try_element_at(found, F.lit(-1))).withColumn("_name", F.element_at(F.split("path", "/"), -1))
    return named.filter(F.col("_name").startswith(F.col("accession")) & F.regexp_like("_name", F.lit(r"^GSE\d+(?:-GPL\d+)?_series_matrix\.txt(?:\.gz)?$"))).select("accession", "path")


def newest_sources(files: DataFrame) -> DataFrame:
    """(accession, release, path, is_zip): the highest release of each study, an
    extracted directory before an archive."""
    return first_row(files, ["accession"], [F.desc("release"), "is_zip", "path"])


def newest_manifest(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries of each study that match and have the highest release; a study
    with several has unique false."""
    own = entries.filter(F.regexp_like("name", F.lit(pattern))).withColumn("release", F.regexp_extract("name", pattern, 1).cast("int"))
    top = own.withColumn("_k", F.rank().over(W.partitionBy("study").orderBy(F.desc("release")))).filter("_k = 1").drop("_k")
    return top.withColumn("unique", F.count("*").over(W.partitionBy("study")) == 1)


def distinct_entries(entries: DataFrame, order: str) -> DataFrame:
    """Manifest entries by their id, or path where they have none; the first stays."""
    return first_row(entries.withColumn("_id", F.coalesce(F.nullif(F.col("fileUUID"), F.lit("")), F.col("path"))), ["_id"], [order]).drop("_id")


def latest_artifacts(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of an append-only log, the last record of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")


def series_links(links: DataFrame, value: str = "value") -> DataFrame:
    """One row per series accession in a link's value."""
    return links.withColumn("gse_accession", F.explode(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(value), F.lit(r"\b(GSE\d+)\b"), F.lit(1))))))


#: The file of a study's links and the columns it must have.
LINK_FILE, LINK_COLUMNS = "study_link.txt", ("name", "study_accession", "value")


def link_tables(files: DataFrame) -> DataFrame:
    """(path, row_no, fields, fault) of link tables: files of that name, or archives
    with one below Tab.  Row 0 is the header; it has the fault of a file that can't be
    read, of an archive without such a member (``missing``) or with several."""

    def table(content: bytes) -> Iterator[tuple]:
        raw = io.BytesIO(content)
        if content[:2] == b"PK":
            archive = zipfile.ZipFile(raw)
            members = [m for m in archive.namelist() if m.rsplit("/", 1)[-1] == LINK_FILE and "Tab" in m.split("/")[:-1]]
            if len(members) != 1:
                yield 0, None, "several members" if members else "missing"
                return
            raw = archive.open(members[0])
        reader = csv.reader(io.TextIOWrapper(raw, "utf-8", newline=""), delimiter="\t")
        header = [h.strip().lower() for h in next(reader, [])]
        faults = header_faults(header, list(LINK_COLUMNS))
        yield 0, None, "; ".join(faults) or None
        if not faults:
            for k, row in enumerate(reader, 1):
                yield k, list(zip(header, (v.strip() for v in row), strict=False)), None if len(row) == len(header) else "ragged row"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for row in table(content):
                        yield path, *row
                except (zipfile.BadZipFile, UnicodeError, csv.Error):
                    yield path, 0, None, "not readable"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), ["path", "row_no", "fields", "fault"], [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()])

    return files.select("path", "content").mapInArrow(run, "path string, row_no long, fields map<string,string>, fault string")


def study_links(sources: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series links of studies whose sources are folders or archives (as of
    newest_sources()), all in one scan of ``files``: the links (study_accession,
    gse_accession, link_name, link_value, data_release, input_source), and for each
    study status (success, missing or failed) and faults.  The table is optional; a
    row of another study is a fault, and a study with faults has no links."""
    at = F.when(F.col("is_zip"), F.col("path")).otherwise(F.concat("path", F.lit(f"/{LINK_FILE}")))
    asked = sources.select(F.col("accession").alias("study_accession"), F.col("release").alias("data_release"), at.alias("input_source"))
    rows = link_tables(files.filter(F.endswith("path", F.lit(f"/{LINK_FILE}")) | F.lower("path").endswith(".zip"))).withColumnRenamed("path", "input_source")
    field = lambda c: F.try_element_at("fields", F.lit(c))
    found = asked.join(rows, "input_source", "left").withColumn("owner", F.upper(field("study_accession")))
    foreign = F.when(F.coalesce(F.col("row_no") > 0, F.lit(False)) & ~F.col("owner").eqNullSafe(F.upper("study_accession")), F.concat(F.lit("row "), "row_no", F.lit(" of "), F.coalesce("owner", F.lit("no study"))))
    found = found.withColumn("fault", F.coalesce("fault", foreign))
    absent = F.bool_and(F.col("row_no").isNull() | F.coalesce(F.col("fault") == "missing", F.lit(False)))
    status = found.groupBy("study_accession").agg(
        F.when(absent, "missing").when(F.count("fault") > 0, "failed").otherwise("success").alias("status"),
        F.count_if(F.col("fault").isNotNull() & (F.col("fault") != "missing")).alias("n_faults"),
        F.min_by("fault", F.struct(F.col("fault").isNull(), "row_no")).alias("first_fault"),
    )
    good = found.filter("row_no > 0").join(status.filter("status = 'success'").select("study_accession"), "study_accession", "left_semi")
    named = good.select("study_accession", "data_release", "input_source", field("name").alias("link_name"), field("value").alias("link_value"))
    return series_links(named, "link_value"), status


def inventory(spark: SparkSession, root: str, excluded: list[str]) -> DataFrame:
    """(path, name, length) of files below a root but those of excluded patterns."""
    files = binary_files(spark, root).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    keep = F.lit(True)
    for p in excluded:
        keep = keep & ~F.regexp_like("path", F.lit(p))
    return files.filter(keep)


def resolve_bundle(found: DataFrame) -> DataFrame:
    """(name, place, content) of copies of bundle tables, place canonical, legacy
    or study: the first in that order, and whether all copies are alike."""
    rank = F.when(F.col("place") == "canonical", 0).when(F.col("place") == "legacy", 1).otherwise(2)
    hashed = found.withColumn("_h", F.sha2(F.col("content").cast("binary"), 256)).withColumn("_k", rank)
    return hashed.groupBy("name").agg(F.min_by("place", F.struct("_k", "_h")).alias("place"), (F.count_distinct("_h") == 1).alias("alike"), F.min_by("_h", F.struct("_k", "_h")).alias("sha256"))


def units_of(matches: DataFrame) -> DataFrame:
    """(study, experiment, gse, gpl, pos, gsm) to one row per unit with its
    samples in the requested order."""
    return matches.groupBy("study", "experiment", "gse", "gpl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gsm"))), lambda x: x["gsm"]), ";").alias("gsm_accessions"), F.count("*").alias("requested_sample_count"))


def typed(value: Column) -> Column:
    return value.try_cast("double")


SCHEMA_LOG = T.StructType([T.StructField("output", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("sha256", T.StringType()), T.StructField("finished", T.StringType())])


def wide_feature(matrix: DataFrame, probe: str) -> DataFrame:
    """(sample, value) of one probe of a wide matrix whose first column holds the
    ids; without such a row, or with several, an error."""
    first, *samples = matrix.columns
    row = matrix.filter(F.col(f"`{first}`") == probe)
    n = row.limit(2).count()
    if n != 1:
        raise ContractError(f"{'no row' if not n else 'several rows'} of {probe}")
    return row.select(*[F.col(f"`{s}`").try_cast("double").alias(s) for s in samples]).unpivot([], [f"`{s}`" for s in samples], "sample", "value")
