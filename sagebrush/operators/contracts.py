"""Contracts as queries: each gives the offending rows with a reason; fail()
turns any of them into an error."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .relational import ContractError


def fail(violations: DataFrame, what: str) -> None:
    """Raise with a few of the offenders, if there are any."""
    bad = violations.limit(3).collect()
    if bad:
        raise ContractError(f"{what}: {[r.asDict() for r in bad]}")


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))


def key_faults(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are blank or repeated."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | blank(k)
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.withColumn("reason", F.when(empty, "blank").when(F.col("n") > 1, "repeated")).filter("reason IS NOT NULL")


def header_faults(columns: list[str], required: list[str]) -> list[str]:
    """Required columns that are missing and names that repeat, once trimmed and
    lower-cased."""
    low = [c.strip().lower() for c in columns]
    return [f"missing {r}" for r in required if r.lower() not in low] + [f"repeated {c}" for c in dict.fromkeys(low) if low.count(c) > 1]


def disagreement(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose non-blank values of some columns differ."""
    values = F.array_distinct(F.filter(F.array(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]), lambda x: x.isNotNull()))
    return df.filter(F.size(values) > 1)


def count_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row if a join changed the number of rows."""
    n = before.agg(F.count("*").alias("n_before"))
    return n.join(F.broadcast(after.agg(F.count("*").alias("n_after")))).filter("n_before <> n_after")


def foreign_rows(df: DataFrame, column: str, expected: str, required: list[str]) -> DataFrame:
    """Rows of another study, or with blank required ids."""
    reasons = F.array(F.when(~F.col(column).eqNullSafe(F.lit(expected)), f"{column} differs"), *[F.when(blank(c), f"{c} blank") for c in required])
    return df.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull())).filter("size(reasons) > 0")


def several_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value (a sample on two platforms)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).filter("size(values) > 1")


def bad_accessions(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(~F.coalesce(F.regexp_like(F.trim(column), F.lit(rf"(?i)^{prefix}\d+$")), F.lit(False)))


#: The kinds of analyses, effects and roles of a result.
ANALYSES = ("group_contrast", "regression", "correlation")
CONTRASTS = ("logFC", "cohens_d")
CORRELATIONS = ("pearson_r", "spearman_rho", "partial_r")
EFFECTS = (*CORRELATIONS, *CONTRASTS, "beta")
ROLES = ("primary", "secondary", "sensitivity", "positive_control", "negative_control")
CONTRAST_KEYS = ("test_group", "reference_group", "test_is_higher_outcome")


def result_faults(results: DataFrame) -> DataFrame:
    """Analysis results that may not enter a synthesis, with all reasons.  What
    asks for analysis_unit_id, analysis_type, covariates, dichotomised,
    predictor_name and outcome_name is judged where the table has the column; of a
    contrast that is a map, the keys are."""
    has, col, no = set(results.columns), F.col, lambda c: F.coalesce(c, F.lit(False))
    within = lambda c: ~F.coalesce(col(c).between(0, 1), F.lit(True)) | no(F.isnan(c))
    among = lambda c, values: no(col(c).isin(*values))
    contrast = among("effect_type", CONTRASTS)
    reasons = [
        (col("effect").isNull() | F.isnan("effect"), "no effect"),
        (~among("effect_type", EFFECTS), "unknown effect type"),
        (among("effect_type", CORRELATIONS) & (F.abs("effect") > 1), "correlation out of range"),
        (within("p_value"), "p out of range"),
        (within("fdr"), "fdr out of range"),
        (col("p_value").isNull() & col("fdr").isNull(), "neither p nor fdr"),
        (~no(col("n") >= 1), "n below 1"),
        (contrast & col("contrast").isNull(), "contrast missing"),
        (~contrast & col("contrast").isNotNull(), "contrast not allowed"),
        (~among("role", ROLES), "unknown role"),
    ]
    if isinstance(results.schema["contrast"].dataType, MapType):
        reasons += [(contrast & no(~F.map_contains_key("contrast", k)), f"contrast without {k}") for k in CONTRAST_KEYS]
        said = F.try_element_at("contrast", F.lit(CONTRAST_KEYS[2]))
        reasons.append((no(F.map_contains_key("contrast", CONTRAST_KEYS[2])) & ~no(F.lower(said.cast("string")).isin("true", "false")), "contrast direction not boolean"))
    reasons += [(blank(c), f"{c} blank") for c in ("analysis_unit_id", "predictor_name", "outcome_name") if c in has]
    if "analysis_type" in has:
        reasons.append((~among("analysis_type", ANALYSES), "unknown analysis type"))
        if "dichotomised" in has:
            reasons.append((no(col("dichotomised")) & ~no(col("analysis_type") == "group_contrast"), "dichotomised outside a group contrast"))
    if "covariates" in has:
        reasons.append((no(col("effect_type") == "partial_r") & (F.coalesce(F.size("covariates"), F.lit(0)) <= 0), "partial correlation without covariates"))
    found = F.array(*[F.when(test, said) for test, said in reasons])
    return results.withColumn("reasons", F.filter(found, lambda x: x.isNotNull())).filter("size(reasons) > 0")


def declared_counts(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Tables whose declared number of rows is not the actual one."""
    got = actual.groupBy(key).agg(F.count("*").alias("n_actual"))
    return declared.join(got, key, "left").withColumn("n_actual", F.coalesce("n_actual", F.lit(0))).filter("n_declared <> n_actual")


def divergent_copies(files: DataFrame, name: str, content: str) -> DataFrame:
    """Names whose copies have different contents."""
    return files.groupBy(name).agg(F.count_distinct(F.sha2(F.col(content).cast("binary"), 256)).alias("n_contents")).filter("n_contents > 1")


def link_coverage(linked: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Studies with linked samples and no series link: their run is partial."""
    return linked.select(key).distinct().join(links.select(key).distinct(), key, "left_anti")


def rule_faults(rules: list[dict]) -> list[str]:
    """Faults of file rules: fields, repeated ids, patterns that don't compile."""
    out, seen = [], set()
    for k, r in enumerate(rules):
        for f in ("id", "repositories", "filename_regex"):
            if not r.get(f):
                out.append(f"rule {k}: {f} missing")
        if r.get("id") in seen:
            out.append(f"rule {k}: id repeated")
        seen.add(r.get("id"))
        try:
            re.compile(r.get("filename_regex") or "")
        except re.error:
            out.append(f"rule {k}: pattern does not compile")
    return out


def search_faults(groups: dict[str, list[str]], require: list[str], facets: list[str], known_facets: list[str]) -> list[str]:
    """Unknown facets, and required groups that have no terms."""
    return [f"unknown facet {f}" for f in facets if f not in known_facets] + [f"unknown group {r}" for r in require if r not in groups]


def document_faults(units: DataFrame) -> DataFrame:
    """Units of a synthesis document that break its schema."""
    reasons = F.array(
        F.when(blank("analysis_unit_id"), "id blank"),
        F.when(~F.coalesce(F.col("verdict").isin("supportive", "contradictory", "inconclusive"), F.lit(False)), "unknown verdict"),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range"),
        F.when(~F.coalesce(F.regexp_like("gse_id", F.lit(r"^GSE\d+$")), F.lit(False)), "gse_id malformed"),
    )
    return units.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull())).filter("size(reasons) > 0")


def left_out_faults(left_out: DataFrame) -> DataFrame:
    """Datasets that a report leaves out without saying which, where and why."""
    reasons = F.array(*[F.when(blank(c), f"{c} blank") for c in ("accession", "stage", "reason")])
    return left_out.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull())).filter("size(reasons) > 0")


def unconfirmed(identities: DataFrame) -> DataFrame:
    """Features whose gene no named source confirms; they block a report, whatever
    weaker evidence there is."""
    return identities.filter(blank("confirmed_by"))


#: What a parsed hypothesis may say.
RELATIONSHIPS = ("association", "causal", "difference")
DIRECTIONS = ("positive", "negative", "non-directional")


def hypothesis_faults(parsed: DataFrame, fields: list[str]) -> DataFrame:
    """Parsed hypotheses that break their schema, with all reasons.  A field that
    is no column is missing in each row; relationship_type and directionality may
    be null, predictor and outcome may not be blank."""
    has = set(parsed.columns)
    reasons = [F.lit(f"{f} missing") for f in fields if f not in has]
    for c, known in (("relationship_type", RELATIONSHIPS), ("directionality", DIRECTIONS)):
        if c in has:
            reasons.append(F.when(~F.coalesce(F.col(c).isin(*known), F.lit(True)), f"unknown {c}"))
    reasons += [F.when(blank(c), f"{c} blank") for c in ("predictor", "outcome") if c in has]
    return parsed.withColumn("reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull())).filter("size(reasons) > 0")


def recommended(plan: DataFrame, keys: list[str]) -> DataFrame:
    """The units of a plan that are to be downloaded; none, or one listed twice,
    is an error."""
    chosen = plan.filter(F.col("download_recommendation") == "download")
    if chosen.isEmpty():
        raise ContractError("no unit is marked for download")
    fail(chosen.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), "a unit is listed twice")
    return chosen
