"""Text functions: sample titles, timepoints, accessions, keyword evidence."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The formats of sample titles, first match wins.
COHORTS = (("Trial", r"\btrial[\s_-]*(\d+)\b"), ("Cohort", r"\bcohort[\s_-]*([A-Za-z0-9]+)\b"), ("Batch", r"\bbatch[\s_-]*([A-Za-z0-9]+)\b"), ("Study", r"\bstudy[\s_-]*(\d+)\b"))
SUBJECTS = (r"\bsubject[\s_-]*id[\s_:-]*([A-Za-z0-9]+)\b", r"\b(?:subject|donor|participant)[\s_-]*([A-Za-z0-9]+)\b")
DAYS = (r"\bday[\s_]+(-\d+)\b", r"\bday[\s_-]*(\d+)\b", r"\bd(\d+)\b")
HOURS = (r"\btime[\s_]+(-\d+)\s*(?:hr|hours?|h)\b", r"(?<!\w)(-\d+)\s*(?:hr|hours?|h)\b", r"\btime[\s_-]*(\d+)\s*(?:hr|hours?|h)\b", r"\b(\d+)\s*(?:hr|hours?|h)\b")


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match, NULL without one."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", 1), F.lit(""))


def first_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[first_group(text, p) for p in patterns])


def cohort(title: Column) -> Column:
    return F.coalesce(*[F.concat(F.lit(f"{label} "), first_group(title, p)) for label, p in COHORTS])


def subject(title: Column) -> Column:
    return first_of(title, SUBJECTS)


def timepoint(title: Column) -> Column:
    """'Day n' before 'Hour n'; a minus is a sign only behind a separator."""
    return F.coalesce(F.concat(F.lit("Day "), first_of(title, DAYS)), F.concat(F.lit("Hour "), first_of(title, HOURS)))


def timepoint_order(point: Column) -> tuple[Column, Column]:
    """Sort keys: days before hours, then by number."""
    return F.when(point.startswith("Day"), 0).when(point.startswith("Hour"), 1).otherwise(2), F.expr("0") + F.try_element_at(F.split(point, " "), F.lit(2)).try_cast("double")


def days_mentioned(text: Column) -> Column:
    """Sorted distinct day numbers of free text, lists such as 'days 3, 7 and 14' too.
    The text is cut before each word for days; what follows 'day' and a space is read
    as a list, what follows it otherwise (or a lone d) as one number."""
    mark = F.regexp_replace(F.lower(text), r"\bd(?:ays?)?(?=[\s:_-]*\d)", "\n$0\r")
    plain = F.regexp_replace(mark, r"(?<=\d)\s*and\b", ",")

    def numbers(part: Column) -> Column:
        word, rest = F.substring_index(part, "\r", 1), F.substring_index(part, "\r", -1)
        run = F.split(rest, r"[^\d\s,/]", 2)[0]
        one = F.regexp_extract_all(rest, F.lit(r"^\s*[-_:]?\s*(\d+)\b"), F.lit(1))
        listed = F.when(word.startswith("da") & F.regexp_like(rest, F.lit(r"^\s")), F.split(run, r"[\s,/]+"))
        return F.coalesce(F.array_union(listed, one), one)

    parts = F.filter(F.split(plain, "\n"), lambda x: F.contains(x, F.lit("\r")))
    found = F.transform(F.flatten(F.transform(parts, numbers)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether a text holds any of the terms, whatever the case."""
    return F.coalesce(F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(text), t)), F.lit(False))


def matched_terms(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.coalesce(F.contains(F.lower(text), t), F.lit(False)))


def keyword_evidence(text: Column, rules: dict[str, list[str]]) -> Column:
    """Detected flag and matched terms of each named assay or criterion."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in rules]), F.array(*[F.struct((F.size(matched_terms(text, t)) > 0).alias("detected"), matched_terms(text, t).alias("terms")) for t in rules.values()]))


def longest_term(text: Column, terms: list[str]) -> Column:
    """The longest term within a text; of equal lengths the first."""
    listed = F.array(*[F.struct(F.lit(len(t)).alias("l"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(terms)])
    return F.array_max(F.filter(listed, lambda x: F.contains(F.lower(text), F.lower(x["t"]))))["t"]


def whole_word(text: Column, word: str) -> Column:
    return F.regexp_like(text, F.lit(rf"(?i)(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"))


def same_name(text: Column, names: list[str]) -> Column:
    """Whether the trimmed text is one of the names, letters of any case being alike
    and a sharp s equal to two s."""
    fold = lambda c: F.replace(F.lower(F.trim(c)), F.lit("ß"), F.lit("ss"))
    return F.coalesce(fold(text).isin(*[fold(F.lit(n)) for n in names]), F.lit(False))


def accessions(text: Column, prefix: str = "GSE") -> Column:
    """Sorted distinct accessions of a prefix in a text, upper case."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(rf"\b({prefix}\d+)\b"), F.lit(1))))


def accession_numbers(text: Column, prefix: str = "GSE") -> Column:
    """Sorted distinct numbers, with or without the prefix."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.upper(text), F.lit(rf"\b(?:{prefix})?(\d+)\b"), F.lit(1)), lambda x: x.cast("long"))))


def is_accession(value: Column, prefix: str) -> Column:
    return F.coalesce(F.regexp_like(F.trim(value), F.lit(rf"(?i)^{prefix}\d+$")), F.lit(False))


def series_directory(accession: Column) -> Column:
    """GSE13485 lies in GSE13nnn."""
    return F.regexp_replace(accession, r"\d{1,3}$", "nnn")


def repository_of(accession: Column) -> Column:
    up = F.upper(accession)
    return F.when(up.startswith("SDY"), "immport").when(up.startswith("GSE") | up.startswith("GSM"), "geo").otherwise("unknown")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def tri_state(text: Column) -> Column:
    """NULL is unknown."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def number(text: Column) -> Column:
    """Finite number of a text, else NULL."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def preferred(first: Column, second: Column) -> Column:
    """The first unless it is blank."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def first_json(text: Column) -> Column:
    """The JSON object within fenced or free text."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def listed(text: Column) -> Column:
    """Values of a ;-separated list."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def list_faults(text: Column, count: Column) -> Column:
    """What is wrong with a ;-separated list and its count."""
    got = listed(text)
    faults = F.array(F.when(F.size(got) != count, "count"), F.when(F.size(F.array_distinct(got)) != F.size(got), "duplicate"))
    return F.filter(faults, lambda x: x.isNotNull())


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


@F.pandas_udf(T.StringType())
def flattened(text: pd.Series) -> pd.Series:
    """Keys and values of JSON of any depth as one text; other text as it is."""

    def walk(x):
        if isinstance(x, dict):
            for k, v in x.items():
                yield str(k)
                yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)
        elif x is not None:
            yield str(x)

    def one(t):
        if t is None:
            return None
        try:
            return " ".join(walk(json.loads(t)))
        except ValueError:
            return t

    return text.map(one)


def hrefs(html: Column, pattern: str) -> Column:
    """Distinct link targets that match a pattern, sorted."""
    links = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(links, lambda x: F.regexp_like(x, F.lit(pattern)))))


def classify(df: DataFrame, rules: list[tuple[str, str, str]], repository: str, name: str, out: str = "rule") -> DataFrame:
    """The first rule (id, repository, filename pattern) that holds, else unclassified."""
    found = F.coalesce(*[F.when((F.col(repository) == r) & F.regexp_like(F.col(name), F.lit(p)), F.lit(i)) for i, r, p in rules], F.lit("unclassified"))
    return df.withColumn(out, found)


def series_type(summary: Column) -> Column:
    """superseries where the summary says so, in any case and spacing, else series."""
    plain = F.regexp_replace(F.lower(F.coalesce(summary, F.lit(""))), r"\s+", " ")
    return F.when(plain.contains("this superseries is composed of"), "superseries").otherwise("series")


def below_accession(path: Column, accession: Column) -> Column:
    """What of a path lies below its first component that is the accession,
    whatever the case; null if there is none, or nothing below it."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    at = F.array_position(F.transform(parts, F.upper), F.upper(accession))
    rest = F.slice(parts, at.cast("int") + 1, F.greatest(F.size(parts), F.lit(0)))
    return F.when(at > 0, F.nullif(F.array_join(rest, "/"), F.lit("")))


def shown_effect(x: Column) -> Column:
    """A number with its sign and three decimals; n/a for null."""
    return F.coalesce(F.when(x.isNotNull(), F.format_string("%+.3f", x)), F.lit("n/a"))


def shown_p(p: Column) -> Column:
    """A p-value of 0 to 1 to three significant digits, without zeros at the end;
    n/a for null.  A digit 5 that ends the decimal form is rounded up."""
    digits = F.when(p >= 0.1, F.format_string("%.3f", p)).when(p >= 0.01, F.format_string("%.4f", p)).otherwise(F.format_string("%.5f", p))
    return F.when(p.isNull(), "n/a").when(p < 0.001, "<0.001").otherwise(F.regexp_replace(digits, r"\.?0+$", ""))


def text_of(*columns: str) -> Column:
    """The trimmed values of several columns as one text to match; nulls and blanks
    are left out."""
    return F.concat_ws(" ", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns])
