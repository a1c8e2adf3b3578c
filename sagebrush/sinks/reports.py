"""Reports of any length: Markdown lines with numbers, written in order from the
tasks, and the same report as JSON.

A report is a list of sections; a section is a heading, lines of prose and at most
one table (a DataFrame).  Nothing is collected and no row is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_cell


@dataclass(frozen=True)
class Section:
    """``order`` are the columns that sort the table; ``note`` stands below it."""

    heading: str
    prose: tuple[str, ...] = ()
    table: DataFrame | None = None
    order: tuple[str, ...] = ()
    note: str | None = None


def _cell(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    col = F.col(f"`{c}`")
    text = F.format_string("%.4g", col) if kind in ("double", "float") else F.array_join(col, ", ") if kind == "array<string>" else col.cast("string")
    return F.coalesce(markdown_cell(F.when(col.isNotNull(), text)), F.lit(""))


def report_lines(spark: SparkSession, title: str, sections: list[Section]) -> DataFrame:
    """(section, part, row, line): the lines of a report under their sort keys; rows
    of a table are sorted by their own columns, as JSON of equal width is not needed:
    ``row`` is a struct of texts and numbers of its section alone."""
    fixed, tables = [(0, 0, f"# {title}")], []
    for k, s in enumerate(sections, 1):
        fixed += [(k, 0, ""), (k, 0, f"## {s.heading}"), *[(k, 1, line) for p in s.prose for line in ("", p)]]
        if s.table is not None:
            fixed += [(k, 2, ""), (k, 2, "| " + " | ".join(s.table.columns) + " |"), (k, 2, "|" + "-|" * len(s.table.columns))]
            tables.append((k, s))
        fixed += [(k, 4, line) for line in ("", s.note)] if s.note else []
    rows = [(k, part, i, line) for i, (k, part, line) in enumerate(fixed)]
    lines = spark.createDataFrame(rows, "section int, part int, row long, line string")
    for k, s in tables:
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(s.table, c) for c in s.table.columns]), F.lit(" |"))
        # a global sort cuts ranges; a number grows along them
        placed = s.table.select(cells.alias("line"), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(s.order or s.table.columns)]).orderBy(*[f"_o{i}" for i in range(len(s.order or s.table.columns))])
        lines = lines.unionByName(placed.select(F.lit(k).alias("section"), F.lit(3).alias("part"), F.monotonically_increasing_id().alias("row"), "line"))
    return lines


def write_report(spark: SparkSession, title: str, sections: list[Section], path: str) -> None:
    """``path``/markdown (text files whose names sort as the lines do) and
    ``path``/json (one object for each prose line and each row of a table)."""
    report_lines(spark, title, sections).orderBy("section", "part", "row").select("line").write.mode("overwrite").text(f"{path}/markdown")
    head = [(k, s.heading, p) for k, s in enumerate(sections, 1) for p in (*s.prose, *([s.note] if s.note else []))]
    twin = spark.createDataFrame(head, "section int, heading string, prose string").withColumn("row", F.lit(None).cast("string"))
    for k, s in enumerate(sections, 1):
        if s.table is not None:
            row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in s.table.columns]), {"ignoreNullFields": "false"})
            twin = twin.unionByName(s.table.select(F.lit(k).alias("section"), F.lit(s.heading).alias("heading"), F.lit(None).cast("string").alias("prose"), row.alias("row")))
    value = F.to_json(F.struct("section", "heading", "prose", F.parse_json("row").alias("row")))
    twin.select(value.alias("value")).write.mode("overwrite").text(f"{path}/json")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a written report, numbered in order."""
    text = spark.read.text(f"{path}/markdown").select("value", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return text.orderBy("_f", "_b", "_i").select(F.col("value").alias("line"))


def sensitivity_section(verdicts: DataFrame, keys: list[str]) -> Section:
    """Primary and other specifications side by side, and whether they agree."""
    differ = verdicts.filter("sensitive").select(*keys).distinct().count()
    note = f"The verdict depends on the specification for {differ} of the questions; the primary one was declared first and counts." if differ else "All specifications agree."
    order = [*keys, "_first", "spec_id"]
    table = verdicts.withColumn("_first", F.when(F.col("role") == "primary", 0).otherwise(1)).orderBy(*order).drop("_first")
    return Section("Sensitivity to the specification", ("The same subjects under other definitions of the predictor.",), table, tuple([*keys, "role", "spec_id"]), note)
