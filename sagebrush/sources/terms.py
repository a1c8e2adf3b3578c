"""Terms of a vocabulary within texts, for vocabularies of any size.

A term table is dealt over shards of a bounded number of terms; each shard is an
Aho-Corasick automaton that all texts are scanned with once, so a text costs its
length for each shard, whatever the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of an automaton; what a task holds and what is sent to it.
SHARD_TERMS = 1 << 17


def _scanning(terms: list[tuple[int, str]], whole_words: bool, longest: bool):
    """Scans texts for the terms; all that are found, or the longest of each text alone."""
    sizes = {ord_: len(term) for ord_, term in terms}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for ord_, term in terms:
            low = term.lower()
            automaton.add_word(low, (*automaton.get(low, ()), (ord_, len(low))))
        automaton.make_automaton()
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                low = (text or "").lower()
                first: dict[int, int] = {}
                for end, found in automaton.iter(low):
                    begin = end + 1 - found[0][1]
                    if whole_words and (_joins(low, begin) or _joins(low, end + 1)):
                        continue
                    for ord_, _ in found:
                        first.setdefault(ord_, begin)
                if longest and first:
                    best = min(first, key=lambda o: (-sizes[o], o))
                    first = {best: first[best]}
                out += [(row, ord_, begin) for ord_, begin in first.items()]
            rows = pa.array([r for r, _, _ in out], pa.int64())
            kept = [batch.column(k).take(rows) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([o for _, o, _ in out], pa.int64()), pa.array([b for _, _, b in out], pa.int64())], [*batch.schema.names[:-1], "ord", "at"])

    return run


def _joins(text: str, at: int) -> bool:
    """Whether a word goes on over this place."""
    word = lambda c: c.isalnum() or c == "_"
    return 0 < at < len(text) and word(text[at - 1]) and word(text[at])


def _found(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, whole_words: bool, shard_terms: int, longest: bool) -> tuple[DataFrame, DataFrame]:
    """(id, ord, at) of each shard's terms in texts, and (ord, term)."""
    named = terms.select(F.col("ord").cast("long").alias("ord"), F.trim("term").alias("term")).filter("term <> ''")
    shards = -(-max(1, named.count()) // shard_terms)
    rows = texts.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    found = None
    for k in range(shards):  # each brings shard_terms terms to the driver and the tasks
        held = [(r["ord"], r["term"]) for r in named.filter(F.pmod(F.xxhash64("ord"), F.lit(shards)) == k).collect()]
        if held:
            one = rows.mapInArrow(_scanning(held, whole_words, longest), f"`{id_col}` {kind}, ord long, at long")
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.select(id_col, F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("at")).limit(0)
    return found, named


def term_matches(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, whole_words: bool = False, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(id, ord, term, at): each term of (ord, term) that stands in a text, whatever
    the case, with its first place.  Terms are trimmed, blank ones left out; ``ord``
    must be unique.  With ``whole_words``, only between bounds of words."""
    found, named = _found(texts, terms, id_col, text_col, whole_words, shard_terms, longest=False)
    return found.join(named, "ord").select(id_col, "ord", "term", "at")


def longest_match(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, whole_words: bool = False, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(id, term, length): the longest term in each text, of equal lengths the first
    by ord; texts without one have length 0 and no term.  A scan returns one term of
    a text for each shard, however many it finds."""
    found, named = _found(texts, terms, id_col, text_col, whole_words, shard_terms, longest=True)
    best = found.join(named, "ord").groupBy(id_col).agg(F.max(F.struct(F.char_length("term").alias("l"), (-F.col("ord")).alias("o"), F.col("term"))).alias("b"))
    out = texts.select(id_col).join(best, id_col, "left")
    return out.select(id_col, F.col("b.term").alias("term"), F.coalesce(F.col("b.l").cast("long"), F.lit(0).cast("long")).alias("length"))


def resolve_features(features: DataFrame, vocabularies: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """Candidates for decisions.resolve(), (query, stage, strength, feature), of
    (query, stage, ord, term): a feature whose text has a term of a query is a
    candidate of it, as strong as its longest term of the stage."""
    known = vocabularies.select("query", "stage", F.trim("term").alias("term")).distinct()
    # one row for each text of a term, as several queries may share it
    terms = known.select(F.lower("term").alias("term")).filter("term <> ''").distinct().withColumn("ord", F.xxhash64("term"))
    met = term_matches(features, terms, id_col, text_col, **how).select(F.col(id_col).alias("feature"), F.col("term").alias("_t"))
    asked = known.select("query", "stage", F.lower("term").alias("_t"))
    return met.join(asked, "_t").groupBy("query", "stage", "feature").agg(F.max(F.char_length("_t")).alias("strength")).select("query", "stage", "strength", "feature")
