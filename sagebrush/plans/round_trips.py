"""Queries of readers, sinks and gates.  What readers need is derived from the given
tables by Spark: files are written to the folder that the machines share and read
back, or laid out as contents of files that hold a stretch of ids each."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import contracts, decisions, relational
from ..sinks import files as sinks
from ..sources import repository as repo

QUERIES: dict = {}
SQL: dict = {}
#: Ids of one derived file.
STRETCH = 50


def query(text: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one if that is unset and
    there are no other machines."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}"


def _stretches(rows: DataFrame, key: str, **parts: Column) -> DataFrame:
    """(stretch, one list of texts for each part), in order of the key."""
    held = F.array_sort(F.collect_list(F.struct(key, *[c.alias(n) for n, c in parts.items()])))
    grouped = rows.groupBy(F.floor(F.col(key) / STRETCH).alias("stretch")).agg(held.alias("_rows"))
    return grouped.select("stretch", *[F.col("_rows")[n].alias(n) for n in parts])


def _tabbed(*values: Column | str) -> Column:
    return F.concat_ws("\t", *values)


@query("SELECT s_suppkey, nullif(trim(s_name), '') AS s_name, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def k1_s1_s3_table_round_trip(spark, sf_dir):
    """A sorted table of tabs with blanks for NULL, read back under its contract."""
    path = _folder(spark, "tsv")
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit(" "), "s_name").alias("S_Name "), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal"))
    sinks.write_tsv(rows, path, rows.columns, ["s_suppkey"])
    back = repo.read_table(spark, path, ["s_suppkey", "s_name", "s_acctbal"])
    return back.select(F.col("s_suppkey").cast("long"), "s_name", tx.number(F.col("s_acctbal")).alias("s_acctbal"))


@query("SELECT event_id AS EVENT_ID, event_type AS EVENT_TYPE, round(value, 2) AS VALUE, (SELECT count(*) FROM events) AS N_WRITTEN, (SELECT count(*) FILTER (user_id % 3 = 0) FROM events) AS N_BLANK FROM events")
def k2_k5_s4_gzip_round_trip(spark, sf_dir):
    """The same in gzip with upper-case headers; rows and blanks are counted by the
    job that writes."""
    path = _folder(spark, "gzip")
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 2).alias("value"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id"))
    record = sinks.write_observed(rows, path, rows.columns, ["event_id"], compression="gzip")
    back = repo.read_table(spark, path, rows.columns, upper=True)
    count = lambda n: F.lit(n).cast("long")
    return back.select(F.col("EVENT_ID").cast("long"), "EVENT_TYPE", F.col("VALUE").cast("double"), count(record["rows"]).alias("N_WRITTEN"), count(record["blank"]["user_id"]).alias("N_BLANK"))


@F.pandas_udf(T.BinaryType())
def _zipped(member: pd.Series, text: pd.Series) -> pd.Series:
    def one(name: str, content: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(name, content)
        return out.getvalue()

    return pd.Series([one(m, t) for m, t in zip(member, text, strict=True)])


def _archives(spark, sf_dir, below: str) -> DataFrame:
    held = _stretches(_t(spark, sf_dir, "part"), "p_partkey", lines=_tabbed(F.col("p_partkey").cast("string"), "p_name", "p_brand"))
    text = F.concat(F.lit("Part_Key\tname\tbrand\n"), F.array_join("lines", "\n"))
    return held.select(F.concat(F.lit("a"), "stretch").alias("path"), _zipped(F.lit(f"x/{below}/part.txt"), text).alias("content"))


@query("SELECT 'a' || CAST(p_partkey // 50 AS VARCHAR) AS path, p_partkey % 50 + 1 AS row_no, CAST(p_partkey AS VARCHAR) AS part_key, p_brand AS brand FROM part")
def s2_zip_tables(spark, sf_dir):
    """Members of archives below Tab, with the row numbers of each."""
    return repo.table_of(repo.read_zip_tables(_archives(spark, sf_dir, "Tab")), "part", ["part_key", "brand"])


@query("SELECT 'a' || CAST(p_partkey // 50 AS VARCHAR) AS path, p_partkey % 50 + 1 AS row_no, CAST(p_partkey AS VARCHAR) AS part_key, p_name AS name FROM part")
def s5_lenient_zip_table(spark, sf_dir):
    """The first member of a name, in any folder."""
    rows = repo.read_zip_table(_archives(spark, sf_dir, "elsewhere"), "part.txt")
    return rows.select("path", "row_no", F.try_element_at("fields", F.lit("Part_Key")).alias("part_key"), F.try_element_at("fields", F.lit("name")).alias("name"))


def _matrices(spark, sf_dir) -> DataFrame:
    """Series matrices of suppliers: balances with a blank where they are negative,
    and the nations' numbers."""
    rows = _t(spark, sf_dir, "supplier")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    balance = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("string")).otherwise("NA")
    held = _stretches(
        rows, "s_suppkey", gsm=quoted(F.concat(F.lit("gsm"), "s_suppkey")), title=quoted(F.col("s_name")), nation=quoted(F.concat(F.lit("nation: "), "s_nationkey")),
        even=quoted(F.concat(F.lit("even: "), F.col("s_suppkey") % 2 == 0)), balance=balance, number=F.col("s_nationkey").cast("string"),
    )
    line = lambda head, c: _tabbed(F.lit(head), F.array_join(c, "\t"))
    lines = [
        _tabbed(F.lit("!Series_geo_accession"), F.concat(F.lit('"GSE'), "stretch", F.lit('"'))), line("!Sample_title", "title"), line("!Sample_geo_accession", "gsm"),
        line("!Sample_characteristics_ch1", "nation"), line("!Sample_characteristics_ch1", "even"), F.lit("!series_matrix_table_begin"), line('"ID_REF"', "gsm"),
        line('"balance"', "balance"), line('"number"', "number"), F.lit("!series_matrix_table_end"),
    ]
    return held.select(F.concat(F.lit("GSE"), "stretch").alias("path"), F.concat_ws("\n", *lines).cast("binary").alias("content"))


@query("""SELECT 'GSE' || CAST(s_suppkey // 50 AS VARCHAR) AS path, 'GSM' || CAST(s_suppkey AS VARCHAR) AS gsm_accession, a.attribute, a.occurrence, a.attribute_order,
  CASE a.attribute_order WHEN 1 THEN s_name WHEN 2 THEN 'gsm' || CAST(s_suppkey AS VARCHAR) WHEN 3 THEN 'nation: ' || CAST(s_nationkey AS VARCHAR) ELSE 'even: ' || CAST(s_suppkey % 2 = 0 AS VARCHAR) END AS value
FROM supplier, (VALUES ('title', 0, 1::BIGINT), ('geo_accession', 0, 2), ('characteristics_ch1', 0, 3), ('characteristics_ch1', 1, 4)) a(attribute, occurrence, attribute_order)""")
def s6_sample_metadata(spark, sf_dir):
    """Attributes of samples before the table, repeated ones numbered."""
    return repo.sample_metadata(repo.read_series_matrices(_matrices(spark, sf_dir)))


@query("""SELECT 'GSE' || CAST(s_suppkey // 50 AS VARCHAR) AS path, probe_id, 'GSM' || CAST(s_suppkey AS VARCHAR) AS gsm_accession, s_suppkey % 50 AS ordinal,
  CASE WHEN probe_id = 'number' THEN CAST(s_nationkey AS DOUBLE) WHEN s_acctbal >= 0 THEN s_acctbal END AS value FROM supplier, (VALUES ('balance'), ('number')) p(probe_id)""")
def s7_expression(spark, sf_dir):
    """Cells of the tables in the order of the header's samples; NA is NULL."""
    return repo.expression(repo.read_series_matrices(_matrices(spark, sf_dir))).drop("value_str")


@query("SELECT 'GPL' || CAST(p_partkey // 50 AS VARCHAR) AS path, CAST(p_partkey AS VARCHAR) AS probe_id, p_name AS symbol, CASE WHEN p_partkey // 50 % 2 = 0 THEN p_type END AS kind FROM part")
def s11_platforms(spark, sf_dir):
    """Tables between markers, whose columns differ between files."""
    held = _stretches(_t(spark, sf_dir, "part"), "p_partkey", lines=_tabbed(F.col("p_partkey").cast("string"), "p_name", "p_type"))
    last = F.when(F.col("stretch") % 2 == 0, "KIND").otherwise("OTHER")
    text = F.concat_ws("\n", F.lit("^PLATFORM"), F.lit("!platform_table_begin"), _tabbed(F.lit("ID"), F.lit("SYMBOL"), last), F.array_join("lines", "\n"), F.lit("!platform_table_end"), F.lit("behind\tthe\tend"))
    rows = repo.read_platforms(held.select(F.concat(F.lit("GPL"), "stretch").alias("path"), text.cast("binary").alias("content")))
    return rows.select("path", "probe_id", F.try_element_at("attrs", F.lit("SYMBOL")).alias("symbol"), F.try_element_at("attrs", F.lit("KIND")).alias("kind"))


@query("SELECT p_brand || '-' || CAST(p_partkey AS VARCHAR) AS feature_id, p_retailprice - 1000 AS effect, CAST(NULL AS DOUBLE) AS mean_expression, CASE WHEN p_size % 4 > 0 THEN p_size / 64.0 END AS p_value, CAST(NULL AS DOUBLE) AS fdr FROM part")
def s13_m22_results(spark, sf_dir):
    """A comma-separated result table whose first column has no name."""
    path = _folder(spark, "results")
    id_ = F.concat("p_brand", F.lit("-"), "p_partkey")
    rows = _t(spark, sf_dir, "part").select(id_.alias("_c0"), (F.col("p_retailprice") - 1000).alias("logFC"), F.when(F.col("p_size") % 4 > 0, (F.col("p_size") / 64).cast("string")).otherwise("NA").alias("P.VALUE"))
    rows.write.csv(path, header=True)
    return repo.read_results(spark, path)


@query("""WITH e AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'u' || CAST(user_id AS VARCHAR) ELSE '' END AS id, event_type AS path FROM events)
SELECT min(event_id) AS event_id, arg_min(id, event_id) AS "fileUUID", arg_min(path, event_id) AS path FROM e GROUP BY coalesce(nullif(id, ''), path)""")
def s18_manifest_entries(spark, sf_dir):
    """Entries told apart by id, by path where they have none; the first stays."""
    uuid_ = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("u"), "user_id")).otherwise("")
    entries = _t(spark, sf_dir, "events").select("event_id", uuid_.alias("fileUUID"), F.col("event_type").alias("path"))
    return repo.distinct_entries(entries, "event_id")


@query("""WITH c AS (SELECT p_name AS name, p_size % 3 AS k, sha256(p_brand) AS h FROM part)
SELECT name, CASE min(k) WHEN 0 THEN 'canonical' WHEN 1 THEN 'legacy' ELSE 'study' END AS place, count(DISTINCT h) = 1 AS alike, arg_min(h, (k, h)) AS sha256 FROM c GROUP BY name""")
def s24_bundles(spark, sf_dir):
    """The copy of each table that counts, and whether all copies are alike."""
    place = F.element_at(F.array(F.lit("canonical"), F.lit("legacy"), F.lit("study")), (F.col("p_size") % 3 + 1).cast("int"))
    return repo.resolve_bundle(_t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), place.alias("place"), F.col("p_brand").alias("content")))


@query("SELECT event_type AS sample, max(value) AS value FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY event_type")
def k3_s10_wide_feature(spark, sf_dir):
    """Users by types of events as a wide matrix in CSV; the first user read back."""
    events = _t(spark, sf_dir, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").limit(100).collect()]
    first = events.agg(F.min("user_id")).first()[0]
    cells = events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    path = sinks.write_matrix_csv(sinks.wide(cells, "user_id", "event_type", kinds, "value"), _folder(spark, "wide"), "by-user")
    return repo.wide_feature(spark.read.csv(path, header=True), str(first)).filter("value IS NOT NULL")


@query("SELECT p_brand AS study, p_partkey, p_size > 25 AS is_ready FROM part")
def k11_ready_and_excluded(spark, sf_dir):
    """Two lists by a flag, read back; without a flag a study is excluded."""
    folder = _folder(spark, "lists")
    sinks.split_ready(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("study"), "p_partkey", F.when(F.col("p_size") != 7, F.col("p_size") > 25).alias("ready")), "ready", folder)
    read = lambda name: spark.read.schema("study string, p_partkey long").json(f"{folder}/{name}").withColumn("is_ready", F.lit(name == "ready"))
    return read("ready").unionByName(read("excluded"))


@query("SELECT c_custkey AS k, c_name, s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def j20_one_to_one(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return relational.one_match(customers, _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), ["k"], one_to_one=True)


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 20")
def f15_recommended(spark, sf_dir):
    plan = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 20, "download").when(F.col("p_size") > 5, "skip").alias("download_recommendation"))
    return contracts.recommended(plan, ["p_partkey"]).drop("download_recommendation")


@query("SELECT p_partkey, trim(p_name) || '|' || CASE WHEN p_size > 9 THEN p_brand ELSE '' END AS included, '|' || p_type AS excluded FROM part")
def p5_derived_criteria(spark, sf_dir):
    one = lambda d, e: F.struct(d.alias("description"), e.alias("exclusion"))
    none = F.lit(None).cast("string")
    criteria = F.array(one(F.concat(F.lit(" "), "p_name"), none), one(F.when(F.col("p_size") > 9, F.col("p_brand")), F.col("p_type")))
    found = decisions.derived_criteria(_t(spark, sf_dir, "part").select("p_partkey", criteria.alias("scientific_criteria")))
    return found.select("p_partkey", F.array_join("inclusion_criteria", "|").alias("included"), F.array_join("exclusion_criteria", "|").alias("excluded"))


@query("""SELECT c_custkey, concat_ws(', ', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'accession blank' END, CASE WHEN c_nationkey = 3 THEN 'stage blank' END, CASE WHEN c_acctbal < 0 THEN 'reason blank' END) AS reasons
FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_nationkey = 3 OR c_acctbal < 0""")
def v14_left_out(spark, sf_dir):
    """Datasets that a report leaves out without saying which, where or why."""
    rows = _t(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_name")).alias("accession"), F.when(F.col("c_nationkey") == 3, " ").otherwise("load").alias("stage"), F.when(F.col("c_acctbal") >= 0, "small").alias("reason")
    )
    return contracts.left_out_faults(rows).select("c_custkey", F.array_join("reasons", ", ").alias("reasons"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 0")
def d21_unconfirmed(spark, sf_dir):
    """Features without a named confirmation: NULL or blank."""
    source = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 7 == 0, "  ").otherwise(F.col("p_brand"))
    return contracts.unconfirmed(_t(spark, sf_dir, "part").select("p_partkey", "p_name", source.alias("confirmed_by"))).drop("confirmed_by")


@query("""WITH h AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'causal' WHEN event_type = 'error' THEN 'maybe' END AS r, CASE WHEN user_id % 3 = 0 THEN 'up' ELSE 'positive' END AS d, CASE WHEN value > 9 THEN 'x' ELSE ' ' END AS p FROM events),
f AS (SELECT event_id, concat_ws(', ', CASE WHEN r = 'maybe' THEN 'unknown relationship_type' END, CASE WHEN d = 'up' THEN 'unknown directionality' END, CASE WHEN p = ' ' THEN 'predictor blank' END) AS reasons FROM h)
SELECT * FROM f WHERE reasons <> ''""")
def v10_hypotheses(spark, sf_dir):
    """Parsed hypotheses with values that the schema doesn't have."""
    kind = F.when(F.col("event_type") == "click", "causal").when(F.col("event_type") == "error", "maybe")
    parsed = _t(spark, sf_dir, "events").select("event_id", kind.alias("relationship_type"), F.when(F.col("user_id") % 3 == 0, "up").otherwise("positive").alias("directionality"), F.when(F.col("value") > 9, "x").otherwise(" ").alias("predictor"), F.lit("y").alias("outcome"))
    return contracts.hypothesis_faults(parsed, ["predictor", "outcome"]).select("event_id", F.array_join("reasons", ", ").alias("reasons"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 'superseries' ELSE 'series' END AS kind, 'k ' || (props->>'$.k') AS flat, CAST(json_extract(props, '$.k') AS BIGINT) AS inner_k FROM events")
def x8_x12_x25_json_and_series(spark, sf_dir):
    """Kinds of series by their summaries, JSON as text, JSON within free text."""
    summary = F.when(F.col("event_type") == "click", "x This  SuperSeries\n is composed of y").when(F.col("event_type") == "error", "THIS SUPERSERIES IS COMPOSED OF").when(F.col("event_type") == "view", "This SuperSeries was composed of")
    fenced = F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```"))
    return _t(spark, sf_dir, "events").select("event_id", tx.series_type(summary).alias("kind"), tx.flattened("props").alias("flat"), F.get_json_object(tx.first_json(fenced), "$.k").cast("long").alias("inner_k"))


@query("""SELECT c_custkey, printf('%+.3f', c_acctbal) AS effect, CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN '<0.001' ELSE regexp_replace(printf(CASE WHEN p >= 0.1 THEN '%.3f' WHEN p >= 0.01 THEN '%.4f' ELSE '%.5f' END, p), '\\.?0+$', '') END AS p
FROM (SELECT *, CASE WHEN c_nationkey <> 4 THEN (c_custkey % 10007) / 10007.0::DOUBLE END AS p FROM customer)""")
def x21_shown_numbers(spark, sf_dir):
    p = F.when(F.col("c_nationkey") != 4, (F.col("c_custkey") % 10007) / F.lit(10007.0))
    return _t(spark, sf_dir, "customer").select("c_custkey", tx.shown_effect(F.col("c_acctbal")).alias("effect"), tx.shown_p(p).alias("p"))


@query("""WITH p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN list_position(list_transform(parts, lambda x: upper(x)), 'FR') > 0 THEN nullif(array_to_string(parts[list_position(list_transform(parts, lambda x: upper(x)), 'FR') + 1:], '/'), '') END AS below FROM p""")
def x24_below_accession(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.below_accession(F.col("url"), F.lit("fr")).alias("below"))


@query("""SELECT p_partkey, trim(p_name) || CASE WHEN p_size > 9 THEN ' ' || p_brand ELSE '' END AS joined, regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9_])RING($|[^A-Za-z0-9_])') AS has_ring,
  lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) AS slug, array_to_string(list_sort(list_distinct([p_size, p_size * 10])), ',') AS numbers, CASE p_size % 4 WHEN 0 THEN 'immport' WHEN 1 THEN 'geo' WHEN 2 THEN 'geo' ELSE 'unknown' END AS repository FROM part""")
def x11_x14_x17_x26_texts(spark, sf_dir):
    """Columns as one text, whole words, slugs, numbers of accessions, repositories."""
    part = _t(spark, sf_dir, "part").withColumns({"name": F.concat(F.lit("  "), "p_name"), "brand": F.when(F.col("p_size") > 9, F.col("p_brand")).otherwise(" ")})
    both = F.concat(F.lit("gse"), F.col("p_size") * 10, F.lit(", "), "p_size", F.lit("; GSE"), "p_size")
    names = F.array(*[F.lit(n) for n in ("sdy7", "GSE7", "gsm7", "E-7")])
    return part.select(
        "p_partkey", tx.text_of("name", "brand").alias("joined"), tx.whole_word(F.col("p_name"), "ring").alias("has_ring"), tx.slug(F.col("p_brand")).alias("slug"),
        F.array_join(tx.accession_numbers(both), ",").alias("numbers"), tx.repository_of(F.element_at(names, (F.col("p_size") % 4 + 1).cast("int"))).alias("repository"),
    )


@query("""SELECT user_id, kind, CASE kind WHEN 'failures' THEN CASE WHEN bool_and(s = 'cached') THEN 'cached' WHEN NOT bool_or(s = 'failed') THEN 'success' WHEN bool_and(s = 'failed') THEN 'failed' ELSE 'partial' END
  ELSE CASE WHEN bool_and(s IN ('success', 'cached')) THEN 'success' WHEN bool_and(s = 'failed') THEN 'failed' ELSE 'partial' END END AS status
FROM (SELECT user_id, CASE WHEN event_type = 'error' AND value > 10 THEN 'failed' WHEN event_type = 'view' THEN 'cached' WHEN event_type = 'click' THEN 'source_missing' ELSE 'success' END AS s FROM events), (VALUES ('failures'), ('run')) k(kind) GROUP BY user_id, kind""")
def a20_other_rollups(spark, sf_dir):
    """A source that lacks a file is no failure in one rollup, and no success in the other."""
    step = F.when((F.col("event_type") == "error") & (F.col("value") > 10), "failed").when(F.col("event_type") == "view", "cached").when(F.col("event_type") == "click", "source_missing").otherwise("success")
    events = _t(spark, sf_dir, "events").select("user_id", step.alias("s"))
    one = lambda kind: relational.status_rollup(events, ["user_id"], "s", kind).withColumn("kind", F.lit(kind))
    return one("failures").unionByName(one("run"))


@query("SELECT c_custkey, lower(trim(c_mktsegment)) IN ('building', 'machinery') AS chosen FROM customer")
def f7_same_name(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", tx.same_name(F.concat(F.lit(" "), F.initcap("c_mktsegment")), ["Building ", "mAchinery"]).alias("chosen"))


@query("""SELECT s_suppkey, attribute, CAST(position AS BIGINT) AS position, CASE attribute WHEN 'title' THEN s_name ELSE 'nation: ' || CAST(s_nationkey AS VARCHAR) END AS value
FROM supplier, (VALUES ('title', 1), ('characteristics_ch1', 2)) a(attribute, position) WHERE s_suppkey IN (3, 1)
UNION ALL SELECT s_suppkey, 'characteristics_ch1', 3, 'even: false' FROM supplier WHERE s_suppkey IN (3, 1)""")
def j22_requested_metadata(spark, sf_dir):
    """Two attributes of the two samples that a caller names."""
    rows = relational.requested_metadata(repo.sample_metadata(repo.read_series_matrices(_matrices(spark, sf_dir))), ["GSM3", "GSM1"], ["title", "characteristics_ch1"])
    return rows.select(F.substring("gsm_accession", 4, 20).cast("long").alias("s_suppkey"), "attribute", F.col("position").cast("long"), "value")


@query("""WITH g AS (SELECT s_suppkey // 50 AS g, s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT 'SDY' || CAST(g AS VARCHAR) AS study_accession, 'GSE' || CAST(x AS VARCHAR) AS gse_accession, 'l' || CAST(k AS VARCHAR) AS link_name, 'success' AS status FROM g, unnest(list_distinct([n, n + 1])) u(x)""")
def s14_study_links(spark, sf_dir):
    """Links of studies in archives and folders; one further study has no table."""
    held = _stretches(_t(spark, sf_dir, "supplier"), "s_suppkey", name=F.concat(F.lit("l"), "s_suppkey"), value=F.concat(F.lit("see gse"), "s_nationkey", F.lit(", GSE"), F.col("s_nationkey") + 1, F.lit(" and GSE"), "s_nationkey"))
    study = F.concat(F.lit("SDY"), "stretch")
    lines = F.zip_with("name", "value", lambda n, v: F.concat_ws("\t", n, F.lower(study), v))
    text = F.concat(F.lit("Name\tStudy_Accession\tvalue\n"), F.array_join(lines, "\n"))
    packed = F.col("stretch") % 2 == 0
    tables = held.select(study.alias("accession"), F.lit(3).alias("release"), packed.alias("is_zip"), F.when(packed, F.concat(study, F.lit(".zip"))).otherwise(study).alias("path"), F.when(packed, _zipped(F.lit("x/Tab/study_link.txt"), text)).otherwise(text.cast("binary")).alias("content"))
    files = tables.select(F.when(F.col("is_zip"), F.col("path")).otherwise(F.concat("path", F.lit("/study_link.txt"))).alias("path"), "content")
    lone = spark.createDataFrame([("SDYx", 3, False, "SDYx")], "accession string, release int, is_zip boolean, path string")
    links, status = repo.study_links(tables.drop("content").unionByName(lone), files)
    return links.join(status, "study_accession").select("study_accession", "gse_accession", "link_name", "status")
