"""The corpus pipeline: language ID, line dedup, near duplicates, benchmark
decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet in the shared folder and reads it again as the next stage's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.llm import decontamination, language, line_dedup, ngram_join, pieces
from sagebrush.llm.queries import tokenizer_path
from sagebrush.llm.tables import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a text's words that its language must have.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly of one learned language."""
    model = language.train(docs.filter(~language.held_out()).select("text", "lang"))
    known = language.identify(docs.select(*COLUMNS), model)
    return known.filter((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; documents of which nothing is
    left go, as all of their text stands elsewhere."""
    clean = line_dedup.dedup_lines(docs.select(*COLUMNS))
    stays = (F.col("n_removed") == 0) | F.regexp_like("clean_text", F.lit(r"[^\x20\x09-\x0D]"))
    return clean.filter(stays).select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id, null
    last; of rows with that id, that with the smallest hash of the text."""
    groups = ngram_join.similar_groups(docs.select("doc_id", "text"), keyed=True)
    first = groups.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("f")).select("f.doc_id", "f.key")
    stay = first.unionByName(groups.filter("n_shingles = 0").select("doc_id", "key")).toDF("_id", "_text")
    kept = docs.select(*COLUMNS).join(stay.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left_semi")
    # rows with one id and text are one document
    return kept.withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    judged = decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.filter("NOT contaminated").select(*COLUMNS)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text, with a digest and the round trip's result."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", sentencepiece_ids),
]

#: SQL can't express the trained stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus_pipeline_{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        made = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(made)
        docs = spark.read.parquet(made)
        if before:  # its rows are in the next table now
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = made
    return docs
