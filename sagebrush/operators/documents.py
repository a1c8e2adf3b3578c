"""JSON documents as VARIANT columns: rules held as data, faults named by path, and
nested documents built by aggregation.

A rule tree becomes one expression over the document, so a table of documents is
checked in a scan; arrays are walked by higher-order functions, with the place of
each element in the path of its faults (``per_dataset[2].gse_id: ...``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import shown_effect, shown_p
from .decisions import Rule, confidence, fuse
from .relational import ContractError

_NONE = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Text:
    """A text; not blank unless ``blank``, one of ``among``, or of a whole pattern."""

    among: tuple[str, ...] = ()
    pattern: str | None = None
    blank: bool = False
    null: bool = False


@dataclass(frozen=True)
class Number:
    low: float | None = None
    high: float | None = None
    whole: bool = False
    null: bool = False


@dataclass(frozen=True)
class Flag:
    null: bool = False


@dataclass(frozen=True)
class List:
    of: object
    least: int = 0
    unique: bool = False
    null: bool = False


@dataclass(frozen=True)
class Fields:
    """An object.  Fields of ``optional`` may lack; others than those named are
    faults if closed."""

    required: dict[str, object] = field(default_factory=dict)
    optional: dict[str, object] = field(default_factory=dict)
    closed: bool = False
    null: bool = False


@dataclass(frozen=True)
class Any:
    null: bool = True


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _if(test: Column, at: Column, what: str) -> Column:
    """One fault or none."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.concat(at, F.lit(f": {what}")))).otherwise(F.expr(_NONE))


def fields_of(v: Column) -> Column:
    """An object as a map of variants; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def text_of(v: Column, path: str = "$") -> Column:
    """The text at a path, null if it is none."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def _under(at: Column, name: str) -> Column:
    return F.when(at == "$", F.lit(name)).otherwise(F.concat(at, F.lit(f".{name}")))


def faults_of(rule: object, v: Column, at: Column | None = None) -> Column:
    """Array of the faults of a variant under a rule; empty if there are none."""
    at = F.lit("$") if at is None else at
    if isinstance(rule, Any):
        found = F.expr(_NONE)
    elif isinstance(rule, Fields):
        found = _object_faults(rule, v, at)
    elif isinstance(rule, List):
        items = items_of(v)
        inside = F.flatten(F.transform(items, lambda x, i: faults_of(rule.of, x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
        texts = F.transform(items, lambda x: F.to_json(x))
        more = [_if(F.size(items) < rule.least, at, f"fewer than {rule.least} entries")] if rule.least else []
        more += [_if(F.size(F.array_distinct(texts)) < F.size(texts), at, "entries repeat")] if rule.unique else []
        found = F.when(items.isNull(), _if(F.lit(True), at, "not a list")).otherwise(F.concat(F.coalesce(inside, F.expr(_NONE)), *more))
    elif isinstance(rule, Text):
        value = F.try_variant_get(v, "$", "string")
        more = [_if(F.trim(value) == "", at, "blank")] if not (rule.blank or rule.among or rule.pattern) else []
        more += [_if(~value.isin(*rule.among), at, f"not one of {', '.join(rule.among)}")] if rule.among else []
        more += [_if(~F.regexp_like(value, F.lit(f"^(?:{rule.pattern})$")), at, f"does not match {rule.pattern}")] if rule.pattern else []
        found = F.when(_kind(v) != "STRING", _if(F.lit(True), at, "not a text")).otherwise(F.concat(F.expr(_NONE), *more))
    elif isinstance(rule, Flag):
        found = _if(_kind(v) != "BOOLEAN", at, "not true or false")
    elif isinstance(rule, Number):
        value = F.try_variant_get(v, "$", "double")
        is_number = _kind(v) == "BIGINT" if rule.whole else F.regexp_like(_kind(v), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
        outside = F.lit(False)
        outside = outside | (value < rule.low) if rule.low is not None else outside
        outside = outside | (value > rule.high) if rule.high is not None else outside
        found = F.when(~is_number, _if(F.lit(True), at, "not a whole number" if rule.whole else "not a number")).otherwise(_if(outside, at, f"outside {rule.low} to {rule.high}"))
    else:
        raise TypeError(f"no rule: {rule!r}")
    if rule.null:
        return F.when(F.is_variant_null(v), F.expr(_NONE)).otherwise(found)
    return found


def _object_faults(rule: Fields, v: Column, at: Column) -> Column:
    held = fields_of(v)
    parts = []
    for name, inner in {**rule.required, **rule.optional}.items():
        below = _under(at, name)
        missing = _if(F.lit(True), below, "missing") if name in rule.required else F.expr(_NONE)
        has = F.map_contains_key(held, F.lit(name))
        parts.append(F.when(has, faults_of(inner, F.try_element_at(held, F.lit(name)), below)).otherwise(missing))
    if rule.closed:
        known = [*rule.required, *rule.optional]
        extra = F.array_sort(F.filter(F.map_keys(held), lambda k: ~k.isin(*known)))
        parts.append(F.transform(extra, lambda k: F.concat(F.when(at == "$", F.lit("")).otherwise(F.concat(at, F.lit("."))), k, F.lit(": not allowed"))))
    return F.when(held.isNull(), _if(F.lit(True), at, "not an object")).otherwise(F.concat(F.expr(_NONE), *parts))


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, doc, fault) of JSON files, one document each; what is no JSON has no
    doc and a fault."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    doc = F.try_parse_json("value")
    return files.select(F.col("_metadata.file_path").alias("path"), doc.alias("doc"), F.when(doc.isNull(), "not JSON").alias("fault"))


def document_faults(docs: DataFrame, rule: object, doc: str = "doc", also: tuple = ()) -> DataFrame:
    """Documents with faults, in ``faults``.  ``also`` makes further faults of the
    document, across its fields."""
    found = F.concat(faults_of(rule, F.col(doc)), *[f(F.col(doc)) for f in also])
    return docs.withColumn("faults", F.when(F.col(doc).isNull(), F.array(F.lit("$: not JSON"))).otherwise(found)).filter("size(faults) > 0")


def read_checked(spark: SparkSession, path: str, rule: object, pattern: str = "*.json") -> DataFrame:
    """(path, doc) of documents that all keep the rule; else an error that names
    the first faults."""
    docs = read_documents(spark, path, pattern)
    wrong = document_faults(docs, rule).orderBy("path").limit(5).collect()
    if wrong:
        raise ContractError("; ".join(f"{r['path']}: {', '.join(r['faults'])}" for r in wrong))
    return docs.select("path", "doc")


#: A registry of verified links, and a list of datasets to parse.
REGISTRY = Fields(required={"links": List(Fields(required={"group_id": Text()}, optional={"immport_accession": Text(pattern=r"SDY\d+", null=True), "geo_accession": Text(pattern=r"GSE\d+", null=True), "geo_subseries": List(Text(pattern=r"GSE\d+"), null=True), "accessions": List(Text(), null=True)}))})
DATASETS = Fields(required={"datasets": List(Fields(required={"study_accession": Text(pattern=r"(?i)SDY\d+"), "id": Text()}), least=1)})


def registry_links(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(ord, group_id, immport_accession, geo_accession, geo_subseries, accessions)
    of checked registries."""
    links = docs.select(F.posexplode(F.try_variant_get(doc, "$.links", "array<variant>")).alias("ord", "link"))
    many = lambda name: F.coalesce(F.try_variant_get("link", f"$.{name}", "array<string>"), F.expr(_NONE)).alias(name)
    return links.select("ord", *[text_of(F.col("link"), f"$.{c}").alias(c) for c in ("group_id", "immport_accession", "geo_accession")], many("geo_subseries"), many("accessions"))


#: The words of documents for the verdicts of rows.
VERDICTS = {"supports": "supportive", "refutes": "contradictory", "inconclusive": "inconclusive"}
_VERDICT = Text(among=tuple(VERDICTS.values()))
UNIT_FIELDS = {
    "analysis_unit_id": Text(),
    "gse_id": Text(pattern=r"GSE\d+"),
    "cohort": Text(blank=True, null=True),
    "platform": Text(pattern=r"GPL\d+", null=True),
    "verdict": _VERDICT,
    "confidence": Number(0.0, 1.0),
    "evidence_summary": Text(),
    "rationale": Text(),
    "caveats": List(Text(), unique=True),
}


def synthesis_rule(strict: bool = True) -> Fields:
    """Of synthesis documents; what only the extended form has is a fault in the
    strict one."""
    unit = Fields(required=UNIT_FIELDS, optional={} if strict else {"independence_group": Text()}, closed=True)
    more = {} if strict else {"n_independent_groups": Number(0, whole=True), "decision_rule": Any()}
    return Fields(required={"overall_verdict": _VERDICT, "per_dataset": List(unit), "narrative": Text()}, optional=more, closed=True)


def _said(verdict: Column) -> Column:
    return F.coalesce(*[F.when(verdict == k, v) for k, v in VERDICTS.items()], F.lit("inconclusive"))


NOTE = "Confidence is a rule of thumb on the distance from alpha, not a probability."


def synthesis(scored: DataFrame, overall: DataFrame, keys: list[str], rule: Rule, group: str = "group_key", strict: bool = True) -> DataFrame:
    """One document for each key, as columns overall_verdict, per_dataset and
    narrative: scored units (analysis_unit_id, gse_id, cohort, platform, effect,
    p_value, fdr, n, verdict and their group) with the verdicts of rollup().  Units
    that share a group say so in their caveats, as they count once."""
    same = W.partitionBy(*keys, group)
    siblings = F.array_sort(F.array_remove(F.collect_set("analysis_unit_id").over(same), F.col("analysis_unit_id")))
    fdr = F.col("fdr").isNotNull()
    stat = F.concat(F.when(fdr, "FDR ").otherwise("p "), shown_p(F.coalesce("fdr", "p_value")))
    summary = F.when(F.col("effect").isNull() & F.col("p_value").isNull() & ~fdr, F.lit("no estimate")).otherwise(F.concat_ws(", ", F.concat(F.lit("effect "), shown_effect(F.col("effect"))), stat, F.concat(F.lit("n "), F.col("n").cast("string"))))
    rows = scored.withColumn("_siblings", siblings)
    shared = F.concat(F.lit("Not independent of "), F.array_join("_siblings", ", "), F.lit(": all belong to "), F.col(group), F.lit(" and count once."))
    why = (
        F.when(F.col("verdict") == "supports", f"significant at {rule.alpha:g} in the expected direction")
        .when(F.col("verdict") == "refutes", f"significant at {rule.alpha:g} against the expected direction")
        .when(F.coalesce("fdr", "p_value").isNull() | F.col("effect").isNull(), "no usable estimate")
        .when(F.coalesce("fdr", "p_value") > rule.alpha, f"not significant at {rule.alpha:g}")
        .otherwise(f"effect below {rule.min_effect:g}")
    )
    entry = F.struct(
        "analysis_unit_id", F.coalesce("gse_id", "analysis_unit_id").alias("gse_id"), "cohort", "platform", _said(F.col("verdict")).alias("verdict"), confidence(rule).alias("confidence"), summary.alias("evidence_summary"), why.alias("rationale"),
        F.when(F.size("_siblings") > 0, F.array(F.lit(NOTE), shared)).otherwise(F.array(F.lit(NOTE))).alias("caveats"), *([] if strict else [F.col(group).alias("independence_group")]),
    )
    units = rows.select(*keys, F.col(group).alias("_g"), entry.alias("u")).groupBy(*keys).agg(F.array_sort(F.collect_list("u")).alias("per_dataset"), F.array_sort(F.collect_set("_g")).alias("_groups"), F.count("*").alias("_n"))
    out = units.join(overall.select(*keys, F.col("verdict").alias("_v")), keys)
    plan = f"Fixed before results: alpha {rule.alpha:g}, direction {rule.direction}, effect of {rule.min_effect:g} or more, {rule.min_independent_groups} independent groups."
    narrative = F.concat(F.lit("Overall "), _said(F.col("_v")), F.lit(f". {plan} "), F.col("_n").cast("string"), F.lit(" units in "), F.size("_groups").cast("string"), F.lit(" groups: "), F.array_join("_groups", ", "), F.lit("."))
    made = out.withColumn("overall_verdict", _said(F.col("_v"))).withColumn("narrative", narrative)
    if not strict:
        told = F.struct(F.lit(rule.alpha).alias("alpha"), F.lit(rule.direction).alias("direction"), F.lit(rule.min_effect).alias("min_effect"), F.lit(rule.min_independent_groups).alias("min_independent_groups"))
        made = made.withColumn("n_independent_groups", F.size("_groups")).withColumn("decision_rule", told)
    return made.select(*keys, "overall_verdict", "per_dataset", "narrative", *([] if strict else ["n_independent_groups", "decision_rule"]))


def fused_documents(evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """One document for each group of linked datasets: (dataset_id, repository,
    criterion, source_ord, value, confidence, source) with (group_id, dataset_id,
    verified).  Only groups whose link is verified are fused."""
    linked = evidence.join(groups.filter("verified").select("group_id", "dataset_id").distinct(), "dataset_id")
    sets = linked.groupBy("group_id").agg(F.array_sort(F.collect_set(F.struct("dataset_id", "repository"))).alias("linked_datasets"))
    one = fuse(linked.drop("dataset_id", "repository").withColumnRenamed("group_id", "dataset_id")).withColumnRenamed("dataset_id", "group_id")
    told = one.groupBy("group_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("criterion", F.struct("value", "confidence", "conflict", "sources"))))).alias("criteria"),
        F.array_sort(F.collect_list(F.when(F.col("conflict"), F.col("criterion")))).alias("conflicting_criteria"),
        F.count("*").alias("n_criteria"),
    )
    out = sets.join(told, "group_id")
    return out.select(F.col("group_id").alias("dataset_id"), F.lit("fused").alias("repository"), "linked_datasets", "criteria", F.size("linked_datasets").cast("long").alias("n_sources"), "n_criteria", "conflicting_criteria")


def score_by(rows: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts under a table of rules (keys, alpha, direction, min_effect,
    min_groups): as decisions.score(), with the rule of each row's key."""
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    both = rows.join(rules, keys)
    stat, effect = F.coalesce(clean("fdr"), clean("p_value")), clean("effect")
    aligned = (F.col("direction") == "either") | (F.when(effect > 0, "up").otherwise("down") == F.col("direction"))
    verdict = F.when(effect.isNull() | stat.isNull() | (stat > F.col("alpha")), "inconclusive").when(~aligned, "refutes").when(F.abs(effect) >= F.col("min_effect"), "supports").otherwise("inconclusive")
    return both.withColumn("verdict", verdict)


def sensitivity(scored: DataFrame, keys: list[str], spec: str = "spec_id", role: str = "role", group: str = "group_key") -> DataFrame:
    """One row for each specification: its verdict by groups, that of the primary one
    of its key, and how many verdicts the specifications of the key have.  A key
    without exactly one primary is an error."""
    yes, no = F.col("verdict") == "supports", F.col("verdict") == "refutes"
    each = scored.groupBy(*keys, spec, role).agg(F.count_if(yes).alias("n_supporting"), F.count_if(no).alias("n_refuting"), F.count_distinct(F.when(yes, F.col(group))).alias("n_support_groups"), F.max("min_groups").alias("_least"))
    supports = (F.col("n_supporting") > 0) & (F.col("n_refuting") == 0) & (F.col("n_support_groups") >= F.col("_least"))
    each = each.withColumn("verdict", F.when((F.col("n_refuting") > 0) & (F.col("n_supporting") == 0), "refutes").when(supports, "supports").otherwise("inconclusive")).drop("_least")
    by_key = each.groupBy(*keys).agg(F.count_if(F.col(role) == "primary").alias("_n"), F.max(F.when(F.col(role) == "primary", F.col("verdict"))).alias("primary_verdict"), F.count_distinct("verdict").alias("n_verdicts"))
    if not by_key.filter("_n <> 1").isEmpty():
        raise ContractError("each key needs exactly one primary specification")
    told = by_key.drop("_n")
    return (each.join(told, keys) if keys else each.crossJoin(told)).withColumn("sensitive", F.col("n_verdicts") > 1)  # without keys, told is one row


#: The parts of a test specification.
GROUPS = ("population", "intervention", "predictor", "outcome")
_LISTS = ("required_features", "required_data", "preferred_sample_types", "preferred_predictor_timepoint", "preferred_outcome_timepoint")


def specification_rules(vocabulary: dict[str, list[str]], facets: list[str], groups: tuple[str, ...] = GROUPS) -> tuple[Fields, tuple]:
    """The rule of a test specification and what holds across its fields, for
    document_faults().  A facet with a vocabulary takes its values only."""
    criterion = {"id": Text(pattern="[a-z0-9_]+")}
    scientific = Fields(required={**criterion, "description": Text(), "exclusion": Text()})
    filters = Fields(optional={f: Any() for f in facets}, closed=True, null=True)
    search = Fields(required={"require": List(Text(among=tuple(g for g in groups if g != "predictor")), least=1)}, optional={"filters": filters, **{f: Number(whole=True) for f in ("limit", "per_term", "min_groups")}})
    rule = Fields(
        required={"search": search, "eligibility": Fields(required={"scientific_criteria": List(scientific, least=1)}, optional={"operational_criteria": List(Fields(required=criterion), null=True)})},
        optional={**{g: Fields(required={"search_terms": List(Text(), least=1)}) for g in groups}, **{f: List(Text(blank=True), null=True) for f in _LISTS}},
    )

    def some_group(doc: Column) -> Column:
        return _if(~F.exists(F.array(*[F.lit(g) for g in groups]), lambda g: F.map_contains_key(fields_of(doc), g)), F.lit("$"), f"none of {', '.join(groups)}")

    def known_groups(doc: Column) -> Column:
        asked = F.coalesce(F.try_variant_get(doc, "$.search.require", "array<string>"), F.expr(_NONE))
        unknown = F.filter(asked, lambda g: g.isin(*groups) & ~F.map_contains_key(fields_of(doc), g))
        return F.transform(unknown, lambda g: F.concat(F.lit("search.require: no part "), g))

    def facet_faults(doc: Column, facet: str) -> Column:
        held, at = F.try_variant_get(doc, f"$.search.filters.{facet}", "variant"), F.lit(f"search.filters.{facet}")
        listed = F.coalesce(items_of(held), F.when(held.isNotNull(), F.array(held)))
        return F.coalesce(F.flatten(F.transform(listed, lambda x: faults_of(Text(among=tuple(vocabulary[facet])), x, at))), F.expr(_NONE))

    def known_values(doc: Column) -> Column:
        return F.concat(F.expr(_NONE), *[facet_faults(doc, f) for f in facets if vocabulary.get(f)])

    def unique_criteria(doc: Column) -> Column:
        of = lambda part: F.coalesce(F.transform(items_of(F.try_variant_get(doc, f"$.eligibility.{part}", "variant")), lambda c: text_of(c, "$.id")), F.expr(_NONE))
        ids = F.filter(F.concat(of("scientific_criteria"), of("operational_criteria")), lambda x: x.isNotNull())
        twice = F.array_sort(F.array_distinct(F.filter(ids, lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1)))
        return F.transform(twice, lambda x: F.concat(F.lit("eligibility: criterion "), x, F.lit(" repeats")))

    return rule, (some_group, known_groups, known_values, unique_criteria)
