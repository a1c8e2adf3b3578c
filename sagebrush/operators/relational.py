"""Joins with declared cardinality, keep-first and keep-last, divisions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A declared rule of a table or a join does not hold."""


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def one_match(left: DataFrame, right: DataFrame, keys: list[str], *, how: str = "left", one_to_one: bool = False, check: bool = True) -> DataFrame:
    """A join whose right keys (and left ones, if one_to_one) must be unique, so
    it can't change the number of rows.  The check is a partial aggregation of
    the keys alone and stops at the first offender."""
    if check:
        for side, df in (("right", right), ("left", left)) if one_to_one else (("right", right),):
            bad = repeated_keys(df.dropna(subset=keys), keys).limit(1).collect()
            if bad:
                raise ContractError(f"{side} key {keys} is not unique: {bad[0].asDict()}")
    return left.join(right, keys, how)


def linked(left: DataFrame, right: DataFrame, keys: list[str], unmatched: str = "strict") -> DataFrame:
    """A join with unique right keys whose rows without a match are an error
    (``strict``), left out (``drop``) or kept with NULLs (``left``).  A chain of
    such joins walks references from table to table."""
    if unmatched not in ("strict", "drop", "left"):
        raise ValueError(unmatched)
    if unmatched == "strict":
        lost = left.join(right.select(*keys), keys, "left_anti").limit(1).collect()
        if lost:
            raise ContractError(f"no match for {keys}: {lost[0].asDict()}")
    return one_match(left, right, keys, how="left" if unmatched == "left" else "inner")


def exploded_with_default(left: DataFrame, items: str, key: str, right: DataFrame, absent: dict[str, Column]) -> DataFrame:
    """One row for each item of a list (one with an empty key where it has none),
    with the columns of right by that key, and ``absent`` where right has no row."""
    each = left.withColumn(key, F.explode(F.when(F.size(items) > 0, F.col(items)).otherwise(F.array(F.lit("")))))
    found = one_match(each, right.withColumn("_found", F.lit(True)), [key])
    return found.withColumns({c: F.when(F.col("_found"), F.col(c)).otherwise(v) for c, v in absent.items()}).drop("_found")


def first_row(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, in a total order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def last_value(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Values of the last row of each key, by aggregation: combined before the shuffle."""
    picked = F.max_by(F.struct(*columns), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_v.{c}") for c in columns])


def holders_of_all(df: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """Keys that have every wanted item (relational division)."""
    need = wanted.select(item).distinct()
    total = need.count()
    return df.join(F.broadcast(need) if total <= 10_000 else need, item, "left_semi").groupBy(key).agg(F.count_distinct(item).alias("n_items")).filter(F.col("n_items") == total)


def assigned(requests: DataFrame, offers: DataFrame, keys: list[str], target: list[str]) -> DataFrame:
    """Each request with its one offer; status ok, missing or ambiguous."""
    choices = offers.select(*keys, *target).distinct().groupBy(*keys).agg(F.count("*").alias("n_offers"), F.min(F.struct(*target)).alias("_t"))
    out = requests.join(choices, keys, "left")
    n = F.coalesce("n_offers", F.lit(0))
    status = F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("ok")
    return out.withColumn("status", status).select(*requests.columns, n.alias("n_offers"), "status", *[F.when(n == 1, F.col(f"_t.{t}")).alias(t) for t in target])


def unseen(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that a cache does not hold."""
    return requests.join(cache.select(*keys).distinct(), keys, "left_anti")


def pivot_mean(df: DataFrame, keys: list[str], on: str, values: list, value: str) -> DataFrame:
    """Mean by the named values of a column: one aggregation, no extra job for the names."""
    return df.groupBy(*keys).pivot(on, values).agg(F.avg(value))


def complete(df: DataFrame, keys: list[str], item: str, wanted: list) -> DataFrame:
    """Keys that have all of a short list of items."""
    need = F.array(*[F.lit(w) for w in wanted])
    return df.groupBy(*keys).agg(F.collect_set(F.when(F.col(item).isin(wanted), F.col(item))).alias("_s")).filter(F.size(F.array_except(need, "_s")) == 0).select(*keys)


def siblings(df: DataFrame, group: str, item: str) -> DataFrame:
    """Adds the other items of a row's group, sorted."""
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("_s"))
    return df.join(sets, group).withColumn("siblings", F.array_remove("_s", F.col(item))).drop("_s")


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """A page of at most 100 rows of a total order, with total and next_offset."""
    limit = max(1, min(100, limit))
    total = df.count()
    after = offset + limit if offset + limit < total else None
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long")).withColumn("next_offset", F.lit(after).cast("long"))


def in_given_order(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the given ids with their position in the list."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{key} {df.schema[key].dataType.simpleString()}, position int")
    return df.join(wanted, key)


def requested(df: DataFrame, key: str, wanted: list[str], position: str) -> DataFrame:
    """Rows whose key is requested, with its position in the request; blanks, names
    asked for twice and names that no row has are errors."""
    names = [w.strip() for w in wanted]
    if not names or not all(names) or len(set(names)) < len(names):
        raise ContractError(f"{key}: names must be given, not blank, and once each")
    asked = df.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{key} string, {position} int")
    missing = sorted(r[0] for r in asked.join(df.select(key).distinct(), key, "left_anti").select(key).limit(10).collect())
    if missing:
        raise ContractError(f"{key}: no rows of {missing}")
    return df.join(asked, key)


def requested_metadata(metadata: DataFrame, samples: list[str], attributes: list[str] | None = None) -> DataFrame:
    """Attribute rows (gsm_accession, attribute, occurrence, attribute_order, value) of
    the requested samples, in their order, of all attributes or the requested ones;
    ``position`` numbers the rows."""
    found = requested(metadata, "gsm_accession", samples, "sample_position")
    if attributes is not None:
        found = requested(found, "attribute", attributes, "_asked").drop("_asked")
    order = W.partitionBy("gsm_accession").orderBy("attribute_order", "occurrence")
    return found.withColumn("position", F.row_number().over(order))


def ranked_hits(hits: DataFrame, require: list[str], min_groups: int, limit: int) -> DataFrame:
    """(term_group, term, accession, score) to accessions: any term of a group
    counts as the group; required groups and a least number of groups; most
    groups, then score, then accession."""
    merged = hits.groupBy("accession").agg(F.array_sort(F.collect_set("term_group")).alias("groups"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    kept = merged.filter((F.size(F.array_except(F.array(*[F.lit(r) for r in require]).cast("array<string>"), "groups")) == 0) & (F.size("groups") >= min_groups))
    return kept.withColumn("n_groups", F.size("groups").cast("long")).orderBy(F.desc("n_groups"), F.desc("score"), "accession").limit(max(1, min(1000, limit)))


def term_audit(hits: DataFrame, require: list[str]) -> DataFrame:
    """Hits and unique hits (accessions that no other term finds) of each term."""
    pairs = hits.select("term_group", "term", "accession").distinct()
    alone = pairs.groupBy("accession").agg(F.count("*").alias("n_terms"))
    return pairs.join(alone, "accession").groupBy("term_group", "term").agg(F.count("*").alias("hits"), F.count_if(F.col("n_terms") == 1).alias("unique_hits")).withColumn("required", F.col("term_group").isin(require) if require else F.lit(False))


def status_rollup(df: DataFrame, keys: list[str], status: str, kind: str = "steps") -> DataFrame:
    """One status of a set of steps; NULL (of a left join) is no step.

    ``steps``: cached if all are, success if all are one of the two, failed if none
    is (source_missing counts as failed), else partial; without steps failed.
    ``failures``: only failed ones count against success, so source_missing doesn't;
    without steps success.  ``run``: success though all is cached, failed if all
    failed, else partial; without steps partial."""
    step = F.col(status)
    good, cached, failed = F.bool_and(step.isin("success", "cached")), F.bool_and(step == "cached"), F.bool_and(step == "failed")
    if kind == "steps":
        found = F.when(cached, "cached").when(good, "success").when(F.bool_or(step.isin("success", "cached")), "partial").otherwise("failed")
    elif kind == "failures":
        found = F.when(cached, "cached").when(~F.coalesce(F.bool_or(step == "failed"), F.lit(False)), "success").when(failed, "failed").otherwise("partial")
    elif kind == "run":
        found = F.when(good, "success").when(failed, "failed").otherwise("partial")
    else:
        raise ContractError(f"unknown kind of rollup: {kind}")
    return df.groupBy(*keys).agg(found.alias("status"))


def union_same_header(frames: list[DataFrame]) -> DataFrame:
    """Union of frames that must have the same columns in the same order."""
    out = frames[0]
    for f in frames[1:]:
        if f.columns != out.columns:
            raise ContractError(f"headers differ: {f.columns} and {out.columns}")
        out = out.union(f)
    return out


def set_report(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Members that are missing from or unknown to a set; empty if equal."""
    e, f = expected.select(key).distinct(), found.select(key).distinct()
    return e.join(f, key, "left_anti").withColumn("fault", F.lit("missing")).unionByName(f.join(e, key, "left_anti").withColumn("fault", F.lit("unknown")))


def registry_groups(links: DataFrame) -> DataFrame:
    """(accession, group_id) from link rows (ord, group_id, immport_accession,
    geo_accession, geo_subseries, accessions); a later link overwrites."""
    every = F.concat(F.array("immport_accession", "geo_accession"), F.coalesce("geo_subseries", F.array().cast("array<string>")), F.coalesce("accessions", F.array().cast("array<string>")))
    rows = links.filter("group_id <> ''").select("ord", "group_id", F.explode(every).alias("accession")).filter("accession <> ''")
    return rows.groupBy("accession").agg(F.max_by("group_id", "ord").alias("group_id"))


def verified_link(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The first link by ord that names both the ImmPort id and, as series or
    subseries, the GEO id of a pair of documents."""
    met = pairs.join(links, pairs["immport_id"] == links["immport_accession"])
    met = met.filter((F.col("geo_id") == F.col("geo_accession")) | F.array_contains(F.coalesce("geo_subseries", F.array().cast("array<string>")), F.col("geo_id")))
    return met.groupBy("immport_id", "geo_id").agg(F.min_by("group_id", "ord").alias("group_id"))


def complete_means(values: DataFrame, key: str, item: str, value: str, items: list) -> DataFrame:
    """(key, one column of each item): the mean of an item's values, of keys that
    have a value of every item.  One aggregation, combined before its shuffle."""
    own = lambda i: F.when(F.col(item) == i, F.col(value))
    means = values.filter(F.col(item).isin(*items)).groupBy(key).agg(*[F.avg(own(i)).alias(str(i)) for i in items])
    return means.dropna(subset=[str(i) for i in items])
