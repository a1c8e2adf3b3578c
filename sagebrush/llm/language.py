"""Language ID: script ranges, then Viterbi over per-word scores.

The model has, for each language, log probabilities of byte trigrams of words
(with word edges, hashed into SLOTS slots) and the scripts that its words use.
A word's script, from the range of its first letter that has one, narrows its
candidates; where no language uses the script, all are open;
its score for a candidate is the sum of its trigrams' log probabilities.  The
labels of a text's words are the best path of these scores with a penalty for
each switch, so mixed texts fall into spans.  The document's language is the
label of most words, its score their share.

Texts whose best path provably has no switch skip the dynamic program: a detour
from the best single language pays two penalties (one at either end), so if no
run of words gains that much over it, it is the best path.  The others run in
lock step, sorted by length.

Training sums counts over all labelled rows; a task sends one vector per
language, and the driver gets SLOTS counts for each language.  Prediction is one
pass without a shuffle; a worker holds STEP bytes of text at a time (a longer
text alone).

Punctuation, symbols, pictures and digits separate words.  Null texts and texts
without letters get ``und`` with score 0, and only they, unless no row is
labelled: then all is ``und``.  Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd

SLOTS = 1 << 16
STEP = 1 << 20
PENALTY = 15.0
UND = "und"
#: Least share of a language's training words for a script to be one of its own.
SCRIPT_SHARE = 0.01
_N_SCRIPTS = 16


def _scripts() -> np.ndarray:
    """Script of a letter by the first byte of its UTF-8 form; 0: of none."""
    out = np.zeros(256, np.int64)
    for script, (first, last) in enumerate([
        (0x41, 0x7A), (0xC3, 0xCA), (0xCD, 0xCF), (0xD0, 0xD4), (0xD5, 0xD6), (0xD7, 0xD7), (0xD8, 0xDB),
        (0xE0, 0xE0), (0xE1, 0xE1), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED),
    ]):
        # Latin, Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, others of E1, kana, Han, Hangul
        out[first : last + 1] = max(1, script)
    return out


SCRIPTS = _scripts()


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # (languages, SLOTS) float32
    allowed: np.ndarray  # (scripts, languages) bool


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _trigrams(words: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams of all words, and where each word's begin.  A word
    of b bytes has b + 1: one that ends at each byte, one at the edge behind."""
    n = len(words.data)
    low = np.zeros(n + 3, np.uint32)  # two edges before, one behind
    inside = wd.LETTER[words.data]
    low[2 : n + 2][inside] = wd._LOWER[words.data[inside]]
    length = words.ends - words.starts + 1
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(begin - words.starts, length)
    last = low[at + 2]
    last[begin[1:] - 1] = 0  # the edge, also where the next text begins at once
    if len(last):
        last[-1] = 0
    first, middle = low[at], low[at + 1]
    # nothing from before the word's first byte
    first[begin] = middle[begin] = 0
    second = begin[length > 1] + 1
    first[second] = 0
    code = (first << np.uint32(16)) | (middle << np.uint32(8)) | last
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), begin


def _word_scripts(words: wd.Words) -> np.ndarray:
    """Script of each word: that of its first letter that has one, 0 if none has."""
    by_byte = SCRIPTS[words.data]
    at = np.flatnonzero(by_byte)
    first = np.searchsorted(at, words.starts)
    place = np.append(at, len(words.data))[first]
    return np.where(place < words.ends, np.append(by_byte, 0)[place], 0)


def _words(raw: np.ndarray, cuts: np.ndarray) -> wd.Words:
    return wd.Words(raw, cuts, wd.LETTER, wd.letters(raw))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """From all rows with a text and a language."""
    width = SLOTS + _N_SCRIPTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1)
            data, offsets = wd.flat(batch.column(0))
            for i, j in wd.steps(offsets):
                words = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                slots, begin = _trigrams(words)
                names = np.array(langs.slice(i, j - i).to_pylist(), dtype=object)
                per_word = np.repeat(np.arange(j - i), np.diff(words.at))
                per_slot = np.repeat(per_word, words.ends - words.starts + 1)
                scripts = _word_scripts(words)
                for name in set(names):
                    mine = names == name
                    total = totals.setdefault(name, np.zeros(width, np.int64))
                    total[:SLOTS] += np.bincount(slots[mine[per_slot]], minlength=SLOTS)
                    total[SLOTS:] += np.bincount(scripts[mine[per_word]], minlength=_N_SCRIPTS)
        salt = TaskContext.get().partitionId() % 512
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([salt] * len(totals), pa.int32()), pa.array([t.astype(np.float32).tobytes() for t in totals.values()], pa.binary())], ["lang", "salt", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in rows.column("counts").to_pylist():
            total += np.frombuffer(x, np.float32)
        return pa.table([rows.column("lang").slice(0, 1), rows.column("salt").slice(0, 1), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["lang", "salt", "counts"])

    schema = "lang string, salt int, counts binary"
    labelled = docs.select(text_col, F.col(lang_col).alias("lang")).filter(F.col(text_col).isNotNull() & F.col("lang").isNotNull())
    sums = labelled.mapInArrow(count, schema).groupBy("lang", "salt").applyInArrow(add, schema).groupBy("lang").applyInArrow(add, schema)
    rows = sorted((r["lang"], np.frombuffer(bytes(r["counts"]), np.float32).astype(np.float64)) for r in sums.collect())
    rows = [(name, c) for name, c in rows if c[:SLOTS].sum()]
    if not rows:
        return Model([], np.zeros((0, SLOTS), np.float32), np.zeros((_N_SCRIPTS, 0), bool))
    counts = np.array([c[:SLOTS] for _, c in rows]) + 0.5
    scripts = np.array([c[SLOTS:] for _, c in rows])
    scores = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model([name for name, _ in rows], scores, (scripts >= SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True)).T)


def word_scores(words: wd.Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) scores, and which words have a vote."""
    slots, begin = _trigrams(words)
    out = np.zeros((len(words.starts), len(model.languages)), np.float32)
    if not len(begin):
        return out, np.zeros(0, bool)
    for k in range(len(model.languages)):
        out[:, k] = np.add.reduceat(model.scores[k][slots], begin)
    scripts = _word_scripts(words)
    allowed = model.allowed[scripts]
    allowed[~allowed.any(axis=1)] = True
    out[~allowed] = -1e4
    voting = np.ones(len(out), bool)
    for k in np.flatnonzero(scripts == 0):  # of no known script: few
        word = words.data[words.starts[k] : words.ends[k]].tobytes().decode("utf-8", "replace")
        voting[k] = any(c.isalpha() for c in word)
    out[~voting] = 0
    return out, voting


def _segment_extremes(gain: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest sum of a run, of a prefix and of a suffix of each segment."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    total = np.concatenate(([0.0], np.cumsum(gain)))
    begin = total[at[:-1]]
    upto = total[1:] - begin[owner]  # sums of prefixes
    before = upto - gain
    # the smallest prefix so far, restarted for each segment by a falling offset
    fall = (np.abs(upto).max() * 2 + 1) * owner
    lowest = np.minimum.accumulate(before - fall) + fall
    most = lambda x: np.maximum.reduceat(x, at[:-1])
    return most(upto - lowest), most(upto), most((total[at[1:]] - begin)[owner] - before)


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word on the best path of each segment; segments of ``at``
    run in lock step."""
    labels = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int32)
    count = np.diff(at)
    order = np.argsort(-count, kind="stable")
    for k in range(0, len(order), 512):
        own = order[k : k + 512]
        length, first = count[own], at[own]
        if not length[0]:
            break
        active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]
        state = scores[first[: active[0]]].astype(np.float64)
        back = []
        for t in range(1, len(active)):
            m = active[t]
            now = state[:m]
            arg = now.argmax(axis=1)
            switch = now[np.arange(m), arg] - penalty
            stay = now >= switch[:, None]
            back.append((stay, arg))
            state[:m] = np.where(stay, now, switch[:, None]) + scores[first[:m] + t]
        label = state.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            labels[first[:m] + t] = label[:m]
            if t:
                stay, arg = back[t - 1]
                label[:m] = np.where(stay[np.arange(m), label[:m]], label[:m], arg)
    return labels


def best_labels(scores: np.ndarray, at: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """viterbi(), but only for the texts that may have a switch."""
    labels = np.zeros(len(scores), np.int64)
    filled = np.flatnonzero(np.diff(at))
    if not len(filled):
        return labels
    starts = at[:-1][filled]
    bounds = np.append(starts, len(scores))
    single = np.add.reduceat(scores.astype(np.float64), starts).argmax(axis=1)
    owner = np.repeat(np.arange(len(filled)), np.diff(bounds))
    labels = single[owner]
    if scores.shape[1] < 2:
        return labels
    others = scores.astype(np.float64)
    chosen = others[np.arange(len(others)), labels].copy()
    others[np.arange(len(others)), labels] = -np.inf
    run, prefix, suffix = _segment_extremes(others.max(axis=1) - chosen, bounds)
    open_ = np.flatnonzero((run >= 2 * penalty) | (prefix >= penalty) | (suffix >= penalty))
    if len(open_):
        keep = np.isin(owner, open_)
        sizes = np.diff(bounds)[open_]
        labels[keep] = viterbi(scores[keep], np.concatenate(([0], np.cumsum(sizes))), penalty)
    return labels


NEW = ("lang_pred", "score", "spans")


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score and spans (word ranges [start, end) of runs of
    letters, with their language).  Columns of these names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in NEW])
    names = docs.columns
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        languages = np.array([*own.languages, UND], dtype=object)
        n_lang = len(own.languages)
        for batch in batches:
            data, offsets = wd.flat(batch.column(text_col))
            for i, j in wd.steps(offsets, STEP):
                raw, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = _words(raw, cuts)
                at, n = words.at, j - i
                owner = words.owner()
                pred, score = np.full(n, n_lang), np.zeros(n)
                labels, voting = np.zeros(len(owner), np.int64), np.zeros(len(owner), bool)
                if n_lang and len(owner):
                    scores, voting = word_scores(words, own)
                    labels = best_labels(scores, at, penalty)
                    votes = np.bincount(owner[voting] * n_lang + labels[voting], minlength=n * n_lang).reshape(n, n_lang)
                    total = votes.sum(axis=1)
                    has = total > 0
                    pred[has] = votes[has].argmax(axis=1)
                    score[has] = votes[has].max(axis=1) / total[has]
                # bytes beyond ASCII need not be letters
                plain = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(wd.LETTER[raw] & (raw < 128), out=plain[1:])
                for k in np.flatnonzero((plain[cuts[1:]] == plain[cuts[:-1]]) & (pred < n_lang)):
                    if not any(c.isalpha() for c in raw[cuts[k] : cuts[k + 1]].tobytes().decode("utf-8", "replace")):
                        pred[k], score[k] = n_lang, 0.0
                mine = pred[owner] < n_lang
                begin = np.ones(len(owner), bool)
                begin[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
                begin &= mine
                first = np.flatnonzero(begin)
                end = np.append(first[1:], len(owner))
                end = np.minimum(end, at[owner[first] + 1])
                fields = [pa.array((first - at[owner[first]]).astype(np.int32)), pa.array((end - at[owner[first]]).astype(np.int32)), pa.array(languages[labels[first]], pa.string())]
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[first], np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "lang"]))
                part = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(languages[pred], pa.string()), pa.array(score), spans], [*names, *NEW])

    return docs.mapInArrow(run, schema)
