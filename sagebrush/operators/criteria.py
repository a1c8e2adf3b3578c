"""Evidence for criteria from metadata texts and from table totals, with confidence.

A rule has cases in order; the first that holds gives value (null is unknown),
confidence and text.  All rules of all datasets are decided in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import ContractError

CONFIDENCES = ("low", "medium", "high")


@dataclass(frozen=True)
class Says:
    """The text has one of the terms, whatever the case."""

    terms: tuple[str, ...]

    def holds(self, text: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t.lower())) for t in self.terms], F.lit(False))


@dataclass(frozen=True)
class Matches:
    """The lower-cased text has a match of the pattern."""

    pattern: str

    def holds(self, text: Column) -> Column:
        return F.regexp_like(text, F.lit(self.pattern))


@dataclass(frozen=True)
class Sql:
    """A condition on other columns, such as totals of a study's tables."""

    condition: str

    def holds(self, text: Column) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(False))


@dataclass(frozen=True)
class Both:
    parts: tuple

    def holds(self, text: Column) -> Column:
        return reduce(lambda a, b: a & b, [p.holds(text) for p in self.parts])


@dataclass(frozen=True)
class Case:
    """``when`` None holds always."""

    when: object | None
    value: bool | None
    confidence: str
    says: str


@dataclass(frozen=True)
class CriterionRule:
    criterion: str
    cases: tuple[Case, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not self.cases or self.cases[-1].when is not None:
            raise ContractError(f"{self.criterion}: the last case must hold always")
        if any(c.confidence not in CONFIDENCES for c in self.cases):
            raise ContractError(f"{self.criterion}: unknown confidence")


def evidence_items(datasets: DataFrame, rules: list[CriterionRule], id_col: str, source: str, text_col: str | None = None) -> DataFrame:
    """(dataset_id, criterion, value, confidence, text, sources) of each dataset and
    rule; a null text says nothing."""
    if len({r.criterion for r in rules}) < len(rules):
        raise ContractError("a criterion has two rules")
    text = F.coalesce(F.lower(F.col(text_col)), F.lit("")) if text_col else F.lit("")
    items = []
    for rule in rules:
        cases = [F.struct(F.lit(c.value).cast("boolean").alias("value"), F.lit(c.confidence).alias("confidence"), F.lit(c.says).alias("text")) for c in rule.cases]
        chosen = cases[-1]
        for case, item in zip(reversed(rule.cases[:-1]), reversed(cases[:-1]), strict=True):
            chosen = F.when(case.when.holds(text), item).otherwise(chosen)
        items.append(F.struct(F.lit(rule.criterion).alias("criterion"), chosen.alias("e")))
    rows = datasets.select(F.col(id_col).alias("dataset_id"), F.explode(F.array(*items)).alias("i"))
    return rows.select("dataset_id", "i.criterion", "i.e.value", "i.e.confidence", "i.e.text", F.array(F.lit(source)).alias("sources"))


def yes_or_unknown(criterion: str, when: object, yes: str, no: str) -> CriterionRule:
    """True of high confidence, else unknown of low."""
    return CriterionRule(criterion, (Case(when, True, "high", yes), Case(None, None, "low", no)))


#: Terms and days by which metadata of vaccine studies are judged.
HUMAN = ("homo sapiens", "human", "humans", "participants", "subjects", "volunteers")
TRANSCRIPTOMICS = ("rna-seq", "rna seq", "expression profiling", "gene expression", "microarray", "transcriptomic", "transcriptome", "mrna")
CYTOMETRY = ("flow cytometry", "facs", "cytometry", "cd38", "hla-dr", "tetramer")
QUANTITIES = ("frequency", "percentage", "percent", "magnitude", "response", "activation", "cd38", "hla-dr", "tetramer")
BASELINE = ("baseline", "pre-vaccination", "prevaccination", "day 0", "d0")
DAYS_AFTER = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 14, 15, 21, 28, 30, 60, 80, 84)


def vaccine_study_rules(vaccine: tuple[str, ...], feature: tuple[str, ...], outcome: tuple[str, ...]) -> list[CriterionRule]:
    """The nine criteria of a study of a vaccine, a measured feature and a cellular
    outcome, judged by metadata alone; what only tables can show stays unknown."""
    measured = Says(TRANSCRIPTOMICS)
    after = Matches(r"\b(?:day|d)\s*[-_ ]?(?:" + "|".join(map(str, DAYS_AFTER)) + r")\b")
    return [
        yes_or_unknown("human_study", Says(HUMAN), "The metadata speak of human participants.", "Whether humans were studied is not said."),
        yes_or_unknown("vaccination", Says(vaccine), "The vaccine is named.", "The vaccine is not named."),
        yes_or_unknown("transcriptomics", measured, "An expression assay is named.", "No expression assay is named."),
        CriterionRule(
            "feature_measurable",
            (
                Case(Says(feature), True, "high", "The feature is named."),
                Case(measured, None, "medium", "Expression was measured; the platform must show the feature."),
                Case(None, None, "low", "Nothing tells whether the feature was measured."),
            ),
        ),
        CriterionRule(
            "quantitative_outcome",
            (
                Case(Both((Says(outcome), Says(CYTOMETRY), Says(QUANTITIES))), None, "medium", "A quantitative outcome is likely; values by participant must be seen."),
                Case(None, None, "low", "No quantitative outcome is established."),
            ),
        ),
        CriterionRule(
            "timepoints",
            (
                Case(Both((Says(BASELINE), after)), True, "high", "Days before and after vaccination are named."),
                Case(after, None, "medium", "Days after vaccination are named, none before."),
                Case(None, None, "low", "No usable days are named."),
            ),
        ),
        CriterionRule("participant_linkage", (Case(None, None, "low", "Only tables can link participants."),)),
        yes_or_unknown("predictor_access", measured, "Expression data belong to the study.", "Access to predictor data is not established."),
        CriterionRule("outcome_access", (Case(None, None, "low", "Access to outcome data is not established."),)),
    ]


#: The criteria that totals of a study's tables decide: n_subjects with predictor,
#: with outcome and with both; whether outcomes link; first and last days.
TABLE_RULES = [
    CriterionRule(
        "participant_linkage",
        (
            Case(Sql("n_both > 0 AND n_both = n_outcome"), True, "high", "All participants with an outcome have a predictor."),
            Case(Sql("n_both > 0"), True, "medium", "Some participants with an outcome have a predictor."),
            Case(Sql("n_predictor > 0 AND n_outcome > 0"), False, "high", "No participant has both."),
            Case(None, None, "low", "One of the tables is empty."),
        ),
    ),
    CriterionRule("quantitative_outcome", (Case(Sql("n_outcome > 0"), True, "high", "Participants have outcome values."), Case(None, None, "low", "No outcome values are there."))),
    CriterionRule(
        "timepoints",
        (Case(Sql("first_predictor < last_outcome"), True, "high", "The predictor comes before the outcome."), Case(Sql("first_predictor >= last_outcome"), False, "high", "The predictor doesn't come before the outcome."), Case(None, None, "low", "Days are missing.")),
    ),
    yes_or_unknown("predictor_access", Sql("n_predictor > 0"), "Predictor values are there.", "No predictor values are there."),
    yes_or_unknown("outcome_access", Sql("n_outcome > 0"), "Outcome values are there.", "No outcome values are there."),
]


def table_totals(predictor: DataFrame, outcome: DataFrame, study: str, subject: str, day: str) -> DataFrame:
    """One row for each study of either table, with what TABLE_RULES ask for."""
    a = predictor.select(study, subject, F.col(day).alias("_a"), F.lit(None).cast(predictor.schema[day].dataType).alias("_b"), F.lit(1).alias("_p"), F.lit(0).alias("_o"))
    b = outcome.select(study, subject, F.lit(None).cast(predictor.schema[day].dataType).alias("_a"), F.col(day).alias("_b"), F.lit(0).alias("_p"), F.lit(1).alias("_o"))
    each = a.unionByName(b).groupBy(study, subject).agg(F.max("_p").alias("p"), F.max("_o").alias("o"), F.min("_a").alias("first"), F.max("_b").alias("last"))
    return each.groupBy(study).agg(
        F.sum("p").alias("n_predictor"), F.sum("o").alias("n_outcome"), F.count_if((F.col("p") == 1) & (F.col("o") == 1)).alias("n_both"), F.min("first").alias("first_predictor"), F.max("last").alias("last_outcome")
    )
