"""Decision operators: row scoring, independence, rollup, eligibility, fusion,
feature resolution, cohort units.  Every rule is fixed before numbers are seen
and bound as literals; a NaN counts as missing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import ContractError


@dataclass(frozen=True)
class Rule:
    alpha: float = 0.05
    min_effect: float = 0.0
    direction: str = "up"
    min_independent_groups: int = 2

    def __post_init__(self):
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must lie between 0 and 1")
        if self.direction not in ("up", "down", "either"):
            raise ValueError("direction must be up, down or either")
        if self.min_independent_groups < 1:
            raise ValueError("at least one independent group is needed")


def _clean(c: str) -> Column:
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def score(rows: DataFrame, rule: Rule) -> DataFrame:
    """Adds verdict and small_n.  The statistic is fdr, else p_value; an effect
    against the direction refutes even below the floor; effect 0 counts as down."""
    stat = F.coalesce(_clean("fdr"), _clean("p_value"))
    effect = _clean("effect")
    significant = stat <= rule.alpha
    aligned = F.lit(True) if rule.direction == "either" else F.when(effect > 0, "up").otherwise("down") == rule.direction
    verdict = (
        F.when(effect.isNull() | stat.isNull(), "inconclusive")
        .when(significant & aligned & (F.abs(effect) >= rule.min_effect), "supports")
        .when(significant & ~aligned, "refutes")
        .otherwise("inconclusive")
    )
    return rows.withColumn("verdict", verdict).withColumn("small_n", F.coalesce(F.col("n") < 10, F.lit(False)))


def confidence(rule: Rule) -> Column:
    """Of a scored row, three decimals: how far under alpha a decided row lies;
    an undecided one stays at .40 or below."""
    stat = F.coalesce(_clean("fdr"), _clean("p_value"))
    undecided = F.col("verdict") == "inconclusive"
    value = (
        F.when(stat.isNull(), F.when(undecided, 0.30).otherwise(0.50))
        .when(undecided, F.least(F.lit(0.40), F.greatest(F.lit(0.05), 1 - stat)))
        .otherwise(0.50 + 0.45 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - stat / rule.alpha)))
    )
    return F.round(value, 3)


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def independence_key(accession: str = "accession", lab: str = "lab", platform: str = "platform") -> Column:
    """Rows with one key are not independent of each other."""
    shared = [F.concat(F.lit(f"{k}:"), _given(k)) for k in ("superseries", "bioproject", "study", "program")]
    either = _given(lab).isNotNull() | _given(platform).isNotNull()
    by_lab = F.when(either, F.concat(F.lit("lab:"), F.coalesce(_given(lab), F.lit("?")), F.lit("|platform:"), F.coalesce(_given(platform), F.lit("?"))))
    return F.coalesce(*shared, by_lab, F.concat(F.lit("accession:"), F.coalesce(_given(accession), F.lit("unknown"))))


def independence_fields(df: DataFrame, labs: tuple[str, ...] = ("lab", "contact", "submitter"), platform: str = "platform") -> DataFrame:
    """df with the lab and platform that independence_key() asks for: the first of
    lab, contact and submitter that is given, and of a list of platforms one text,
    sorted."""
    named = [_given(c) for c in labs if c in df.columns]
    out = df.withColumn("lab", F.coalesce(*named) if named else F.lit(None).cast("string"))
    if df.schema[platform].dataType.typeName() == "array":
        kept = F.array_sort(F.filter(platform, lambda p: p.isNotNull()))
        out = out.withColumn(platform, F.nullif(F.array_join(kept, ","), F.lit("")))
    return out


def unit_key(explicit: str = "independence_group", gse: str = "gse_id", cohort: str = "cohort") -> Column:
    """At the grain of analysis units: an explicit group, a shared key, or series
    and cohort.  A platform alone makes a shared key, before any cohort."""
    shared = independence_key(gse)
    named = F.when(~shared.startswith("accession:"), shared)
    own = F.when(_given(cohort).isNotNull(), F.concat(F.coalesce(_given(gse), F.lit("unknown")), F.lit("|cohort:"), _given(cohort)))
    return F.coalesce(_given(explicit), named, own, F.concat(F.lit("accession:"), F.coalesce(_given(gse), F.lit("unknown"))))


def rollup(scored: DataFrame, keys: list[str], rule: Rule, group: str = "group_key", uncovered: str | None = None) -> DataFrame:
    """One verdict per key.  Groups are counted, not rows; what nothing measures
    leaves the question open whatever the rows say."""
    supports, refutes = F.col("verdict") == "supports", F.col("verdict") == "refutes"
    gaps = [F.max(F.coalesce(F.col(uncovered), F.lit(False))).alias("_gap")] if uncovered else [F.lit(False).alias("_gap")]
    out = scored.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if(supports).alias("n_supporting"),
        F.count_if(refutes).alias("n_refuting"),
        F.count_distinct(F.when(supports, F.col(group))).alias("n_support_groups"),
        F.count_distinct(group).alias("n_groups"),
        *gaps,
    )
    verdict = (
        F.when(F.col("_gap"), "inconclusive")
        .when((F.col("n_refuting") > 0) & (F.col("n_supporting") == 0), "refutes")
        .when((F.col("n_supporting") > 0) & (F.col("n_refuting") == 0) & (F.col("n_support_groups") >= rule.min_independent_groups), "supports")
        .otherwise("inconclusive")
    )
    return out.withColumn("verdict", verdict).drop("_gap")


def coverage_gaps(required: DataFrame, available: DataFrame, name: str) -> DataFrame:
    """Required measurements that nothing provides, whatever the case."""
    have = available.select(F.lower(name).alias("_n")).distinct()
    return required.join(have, F.lower(name) == F.col("_n"), "left_anti")


def orient(effect: Column, effect_type: Column, test_group: Column, higher_group: Column) -> Column:
    """Contrasts point to the group with the higher outcome; others stay.  NULL
    where a contrast has no groups (a fault, see contracts.result_faults)."""
    contrast = effect_type.isin("logFC", "cohens_d")
    return F.when(~contrast, effect).when(test_group.isNotNull() & higher_group.isNotNull(), F.when(test_group == higher_group, effect).otherwise(-effect))


def comparable(results: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the results of a key may be pooled (one estimand, one effect type)
    or have their directions compared (one estimand); controls don't count."""
    use = results.filter("role <> 'control'")
    out = use.groupBy(*keys).agg(F.count("*").alias("n_results"), F.count_distinct("estimand").alias("n_estimands"), F.count_distinct("effect_type").alias("n_types"))
    return out.withColumn("directions", F.col("n_estimands") == 1).withColumn("pool", (F.col("n_estimands") == 1) & (F.col("n_types") == 1))


def what_would_change(scored: DataFrame, rule: Rule) -> DataFrame:
    """Why an undecided or refuting row is not a support."""
    stat = F.coalesce(_clean("fdr"), _clean("p_value"))
    why = (
        F.when(F.col("verdict") == "supports", None)
        .when(F.col("verdict") == "refutes", "opposite direction")
        .when(stat.isNull() | _clean("effect").isNull(), "missing estimate")
        .when(stat > rule.alpha, "above alpha")
        .otherwise("below the floor")
    )
    return scored.withColumn("obstacle", why)


def eligibility(spec: DataFrame, evidence: DataFrame) -> DataFrame:
    """spec (criterion, section scientific or operational) against evidence
    (dataset_id, criterion, value; NULL is unknown).  A criterion without
    evidence is unknown; a specification without scientific criteria is refused."""
    if spec.filter("section = 'scientific'").isEmpty():
        raise ContractError("a specification needs scientific criteria")
    sci, ops = F.col("section") == "scientific", F.col("section") == "operational"
    no, open_ = F.col("value") == F.lit(False), F.col("value").isNull()
    # evidence meets its criteria; criteria without any are told from the whole list
    asked = spec.select("section", F.struct("section", "criterion").alias("c")).agg(F.collect_set("c").alias("_asked"))  # one row
    met = evidence.select("dataset_id", F.col("criterion").alias("_c"), "value").join(spec, F.col("_c") == F.col("criterion"), "left")
    known = met.groupBy("dataset_id").agg(
        F.count_if(sci & no).alias("n_failed"),
        F.count_if(sci & open_).alias("_sci_open"),
        F.count_if(ops & no).alias("n_blocked"),
        F.count_if(ops & open_).alias("_ops_open"),
        F.array_sort(F.collect_list(F.when(sci & no, F.col("criterion")))).alias("failed"),
        F.collect_list(F.when(open_ & F.col("section").isNotNull(), F.col("criterion"))).alias("_open"),
        F.collect_set(F.when(F.col("section").isNotNull(), F.struct("section", "criterion"))).alias("_have"),
    ).crossJoin(asked).withColumn("_none", F.array_except("_asked", "_have"))
    none = lambda part: F.size(F.filter("_none", lambda x: x["section"] == part))
    out = known.select(
        "dataset_id",
        "n_failed",
        (F.col("_sci_open") + none("scientific")).alias("n_unresolved"),
        "n_blocked",
        (F.col("_ops_open") + none("operational")).alias("n_unchecked"),
        "failed",
        F.array_sort(F.concat("_open", F.transform("_none", lambda x: x["criterion"]))).alias("unresolved"),
    )
    verdict = F.when(F.col("n_failed") > 0, "excluded").when(F.col("n_unresolved") > 0, "uncertain").otherwise("eligible")
    execution = F.when(verdict == "excluded", "not_applicable").when(verdict == "uncertain", "needs_scientific_resolution").when(F.col("n_blocked") > 0, "blocked").when(F.col("n_unchecked") > 0, "needs_data_check").otherwise("ready")
    return out.withColumn("eligibility", verdict).withColumn("execution", execution)


def fuse(evidence: DataFrame) -> DataFrame:
    """(dataset_id, criterion, source_ord, value, confidence, source) of several
    sources to one: true and false make an open conflict of low confidence; a
    decided value wins over unknown; the highest confidence among the deciders."""
    rank = F.when(F.lower("confidence") == "high", 2).when(F.lower("confidence") == "medium", 1).otherwise(0)
    yes, no = F.coalesce(F.bool_or(F.col("value")), F.lit(False)), F.coalesce(F.bool_or(~F.col("value")), F.lit(False))
    out = evidence.withColumn("_r", rank).groupBy("dataset_id", "criterion").agg(
        yes.alias("_yes"), no.alias("_no"), F.max(F.when(F.col("value").isNotNull(), F.col("_r"))).alias("_decided"), F.max("_r").alias("_any"), F.array_sort(F.collect_list(F.struct("source_ord", "source"))).alias("_s")
    )
    conflict = F.col("_yes") & F.col("_no")
    best = F.when(conflict, 0).otherwise(F.coalesce("_decided", "_any"))
    return out.select(
        "dataset_id", "criterion",
        F.when(conflict, None).when(F.col("_no"), False).when(F.col("_yes"), True).alias("value"),
        conflict.alias("conflict"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), best + 1).alias("confidence"),
        F.array_distinct(F.transform("_s", lambda x: x["source"])).alias("sources"),
    )


def resolve(candidates: DataFrame, exact_stage: int = 1) -> DataFrame:
    """(query, stage, strength, feature) to one row per query.  Of each stage only
    the features of the greatest strength count.  The exact stage decides wherever
    it has any, even tied.  Of the others the first with a single feature does; if
    all are tied, the narrowest tie stands, the earlier stage's first."""
    near = candidates.distinct().withColumn("_m", F.max("strength").over(W.partitionBy("query", "stage"))).filter("strength = _m")
    each = near.groupBy("query", "stage").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    order = F.struct(F.col("stage") != exact_stage, F.size("features"), F.col("stage"))
    out = each.groupBy("query").agg(F.min_by(F.struct("stage", "features"), order).alias("_d")).select("query", "_d.stage", "_d.features")
    return out.withColumn("status", F.when(F.size("features") == 1, "candidate").otherwise("tied"))


def resolve_all(queries: DataFrame, candidates: DataFrame, exact_stage: int = 1) -> DataFrame:
    """resolve() with a row for each query; one without a candidate needs a review."""
    out = queries.select("query").distinct().join(resolve(candidates, exact_stage), "query", "left")
    return out.withColumn("features", F.coalesce("features", F.array().cast("array<string>"))).withColumn("status", F.coalesce("status", F.lit("needs_review")))


def verify_features(resolved: DataFrame, present: DataFrame, predictor: bool = True) -> DataFrame:
    """Features that are measured.  Several of a predictor are verified_multiple;
    several of an outcome need a review, as does none."""
    rows = resolved.select("query", "status", F.explode("features").alias("feature")).join(present.select("feature").distinct(), "feature", "left_semi")
    left = rows.groupBy("query").agg(F.array_sort(F.collect_set("feature")).alias("verified"))
    out = resolved.join(left, "query", "left")
    n = F.coalesce(F.size("verified"), F.lit(0))
    many = "verified_multiple" if predictor else "needs_review"
    return out.withColumn("status", F.when(n == 1, "verified").when(n > 1, many).otherwise("needs_review"))


def confirmed(resolved: DataFrame, reviews: DataFrame) -> DataFrame:
    """A reviewer's confirmed feature overrides, where there is one."""
    said = reviews.select("query", F.col("feature").alias("_f"))
    out = resolved.join(said, "query", "left")
    return out.withColumn("verified", F.when(F.col("_f").isNotNull(), F.array("_f")).otherwise(F.col("verified"))).withColumn("status", F.when(F.col("_f").isNotNull(), "verified").otherwise(F.col("status"))).drop("_f")


def cohort_units(samples: DataFrame, min_subjects: int = 3) -> DataFrame:
    """(series, cohort, subject, timepoint, gsm) to analysis units: with two or
    more cohorts of enough subjects, one unit each; else one for the series.
    Samples without a usable cohort are left out of split series."""
    sizes = samples.filter("cohort IS NOT NULL").groupBy("series", "cohort").agg(F.count_distinct("subject").alias("n")).filter(F.col("n") >= min_subjects)
    usable = sizes.groupBy("series").agg(F.count("*").alias("n_usable"))
    placed = samples.join(sizes.select("series", "cohort", F.lit(True).alias("_ok")), ["series", "cohort"], "left").join(usable, "series", "left")
    split = F.coalesce("n_usable", F.lit(0)) >= 2
    kept = placed.filter(~split | F.col("_ok")).withColumn("unit_cohort", F.when(split, F.col("cohort")))
    left_out = placed.filter(split & F.col("_ok").isNull()).groupBy("series").agg(F.count("*").alias("n_left_out"))
    units = kept.groupBy("series", "unit_cohort").agg(
        F.array_sort(F.collect_set("subject")).alias("subjects"), F.array_sort(F.collect_set("timepoint")).alias("timepoints"), F.array_sort(F.collect_set("gsm")).alias("gsms")
    )
    return units.join(left_out, "series", "left").withColumn("n_left_out", F.coalesce("n_left_out", F.lit(0)))


def evidence_rows(per_study: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """One aggregate row per study to (dataset_id, criterion, value) rows."""
    items = F.array(*[F.struct(F.lit(k).alias("criterion"), v.cast("boolean").alias("value")) for k, v in criteria.items()])
    return per_study.select("dataset_id", F.explode(items).alias("_e")).select("dataset_id", "_e.criterion", "_e.value")


def precedes(predictor: DataFrame, outcome: DataFrame, subject: str, day: str) -> DataFrame:
    """Subjects whose first predictor day comes before their last outcome day."""
    a = predictor.groupBy(subject).agg(F.min(day).alias("first_predictor"))
    b = outcome.groupBy(subject).agg(F.max(day).alias("last_outcome"))
    return a.join(b, subject).filter("first_predictor < last_outcome")


def primary_faults(specs: DataFrame) -> DataFrame:
    """Hypotheses without exactly one primary specification with a stated basis."""
    main = F.count_if(F.col("is_primary") & (F.coalesce(F.trim("basis"), F.lit("")) != ""))
    return specs.groupBy("hypothesis").agg(main.alias("n_primary")).filter("n_primary <> 1")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def derived_criteria(specs: DataFrame, criteria: str = "scientific_criteria") -> DataFrame:
    """Specifications with inclusion_criteria and exclusion_criteria, the trimmed
    descriptions and exclusions of their criteria in order; what is null is empty."""
    of = lambda field: F.coalesce(F.transform(F.filter(criteria, lambda c: c.isNotNull()), lambda c: F.coalesce(F.trim(c[field]), F.lit(""))), F.array().cast("array<string>"))
    return specs.withColumns({"inclusion_criteria": of("description"), "exclusion_criteria": of("exclusion")})
