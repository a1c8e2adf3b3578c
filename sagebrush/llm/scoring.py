"""Language-model scoring with a weighted backoff automaton.

The model: n-grams of up to three tokens of the training texts, smoothed by
Dirichlet priors.  With c the training count of an n-gram and p1 the estimate of the
base score, (c + 0.5) / (N + 0.5 (V + 1)):

    p2(w | v)    = (c(v w) + STRENGTH p1(w)) / (c(v) + STRENGTH)
    p3(w | u v)  = (c(u v w) + STRENGTH p2(w | v)) / (c(u v) + STRENGTH)

A context without training count leaves the lower estimate as it is.  Each estimate
sums to 1 over the V known tokens and one unknown.  As an automaton: seen n-grams of
up to two tokens are states, seen n-grams are arcs with these weights, and a state
without an arc for a token takes its failure arc, of weight
STRENGTH / (c + STRENGTH), to the state of its suffix.  One traversal of a text from
left to right carries the state and adds up the logarithms.

No machine holds the automaton.  A batch of texts (about BATCH tokens, of one input
partition) only meets the part whose n-grams it has:

1. Each batch lists its distinct n-grams as sorted 64-bit hashes with their training
   counts, cut by hash range into packed pieces, one for each shard that it has.
2. Each shard adds up the counts of equal n-grams of all batches and answers each
   batch in the order of its list.  All n-grams count, there is no cut-off.
3. The answers meet the batch's tokens again; states, arcs and failure arcs are
   built from them, and all texts of the batch are traversed.

Hash ranges are even whatever the texts are, as a batch sends an n-gram once however
often it has it, so copies and frequent words make no hot shard.  A text may span
batches: the token before a cut is carried into the next one, and a state is a
function of the last two tokens, so sums over parts are those of the whole text.
The first and the third step read docs each; they must come in the same partitions
and order both times, as files do (each batch has a checksum, and a difference is
an error, not a wrong result).

Null and empty texts have one token, the end.  Without training texts every token
has the base estimate 0.5 / 0.5.  Repeated rows are scored each and, if training
texts, counted each; ids may be null, repeated or of any type; columns other than
id and text are not read.  Tokens and n-grams are told apart by 64-bit hashes.
Memory: a batch, or the longest run without white space if that is longer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as wd
from .tables import dropped, written

#: Weight of the lower order's estimate, in training counts.
STRENGTH = 2.0
#: Tokens of a batch, and bytes of text for each shard.
BATCH = 3 << 19
SHARD_BYTES = 1 << 24
#: Tokens of a text that are traversed in one go beside other texts' tokens.
LANE = 1024
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
#: Stand for the end and the begin of a text; no hash of a word by intent.
END, BEGIN = (np.uint64(x) for x in (0x8C5D1F0B6A3E9427, 0x3B7A94E05DC2F681))
_ORDER_SALTS = tuple(np.uint64(x) for x in (0x1D8E4E27C47D124F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True

_PACKED = "batch long, shard int, n long, keys binary, counts binary"
_ANSWER = "batch long, shard int, n long, check long, counts binary, total long, distinct long"


def learns(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is not 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 1


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel().astype(np.uint64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n), dtype=np.uint64)


@dataclass
class Batch:
    """Tokens of a run of texts.  ``pos`` is a token's place in its text (0, 1, or 2
    for all later ones), ``text`` the text's number in the partition.  The first
    ``lead`` tokens belong to the batch before; ``before`` is what precedes them."""

    number: int
    tokens: np.ndarray
    pos: np.ndarray
    text: np.ndarray
    train: np.ndarray
    lead: int
    before: np.uint64


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which texts are cut in pieces of about STEP_BYTES, always at white
    space, and which text each piece belongs to."""
    at, owner = [0], []
    for k in range(len(offsets) - 1):
        begin, end = int(offsets[k]), int(offsets[k + 1])
        while end - begin > wd.STEP_BYTES:
            cut, size = None, wd.STEP_BYTES
            while cut is None and begin + size < end:
                found = np.flatnonzero(_SPACES[data[begin : begin + size]])
                cut, size = (begin + int(found[-1]) + 1 if len(found) else None), 2 * size
            if cut is None or cut >= end:
                break
            at.append(cut)
            owner.append(k)
            begin = cut
        at.append(end)
        owner.append(k)
    return np.array(at, np.int64), np.array(owner, np.int64)


def _streams(batches: Iterator[pa.RecordBatch], ids: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, number of the text of each, whether it is a training text), with
    END behind each text; ids get the first column's values."""
    seen = 0
    for batch in batches:
        data, offsets = wd.flat(batch.column(1))
        train = batch.column(2).to_numpy(zero_copy_only=False)
        ids.append(batch.column(0))
        at, owner = _pieces(data, offsets)
        last = np.append(owner[1:] != owner[:-1], True)
        for i, j in wd.steps(at):
            found = wd.Words(data[at[i] : at[j]], at[i : j + 1] - at[i], wd.SOLID)
            closes = np.flatnonzero(last[i:j])  # pieces that end their text
            hashes, where = found.hashes(), found.at[closes + 1]
            tokens = np.insert(hashes, where, END)
            text = np.insert(owner[i:j][found.owner()], where, owner[i:j][closes])
            yield tokens, text + seen, train[text].astype(bool)
        seen += batch.num_rows


def _batches(rows: Iterator[pa.RecordBatch], ids: list, most: int) -> Iterator[Batch]:
    number, held, size = 0, [], 0
    past: tuple = (None, np.uint64(0), np.uint64(0), 0)  # text, its last two tokens, its tokens so far

    def close() -> Batch:
        nonlocal number, past
        tokens, text, train = (np.concatenate(x) for x in zip(*held, strict=True))
        lead, before = 0, BEGIN
        same, two, one, n = past
        if text[0] == same:  # goes on from the batch before
            tokens, text, train = np.append(one, tokens), np.append(same, text), np.append(False, train)
            lead, before = 1, two if n > 1 else BEGIN
        starts = np.append(0, np.flatnonzero(text[1:] != text[:-1]) + 1)
        pos = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
        if lead:
            pos[: starts[1] if len(starts) > 1 else len(pos)] += n - 1
        made = Batch(number, tokens, np.minimum(pos, 2).astype(np.int8), text.astype(np.int32), train, lead, before)
        past = (text[-1], tokens[-2] if len(tokens) > 1 else before, tokens[-1], int(pos[-1]) + 1)
        number += 1
        return made

    for tokens, text, train in _streams(rows, ids):
        for k in range(0, len(tokens), most):
            held.append((tokens[k : k + most], text[k : k + most], train[k : k + most]))
            size += len(held[-1][0])
            if size >= most:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _ngrams(batch: Batch) -> list[np.ndarray]:
    """Hashes of the token, the two tokens and the three that end at each place; a
    first token has begin before it, a second one's three start with begin."""
    one = batch.tokens
    prev = np.append(batch.before, one[:-1])
    prev[batch.pos == 0] = BEGIN
    prev2 = np.append(batch.before, prev[:-1])
    prev2[batch.pos < 2] = BEGIN
    two = wd.mix(prev * _MULTIPLIER + one + _ORDER_SALTS[1])
    three = wd.mix((wd.mix(prev2 * _MULTIPLIER + prev)) * _MULTIPLIER + one + _ORDER_SALTS[2])
    return [wd.mix(one + _ORDER_SALTS[0]), two, three]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first place of each, and which each place has."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    which = np.empty(len(values), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new].astype(np.int32), which


def _cuts(keys: np.ndarray, n_shards: int) -> np.ndarray:
    bounds = [(k << 64) // n_shards for k in range(1, n_shards)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)]]).astype(np.int64)


def _listing(n_shards: int, most: int):
    """Each batch's distinct n-grams with their training counts, by shard.  Pieces of
    the three orders are rows of their own: shard, shard + n_shards, and so on."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in _batches(rows, [], most):
            own = batch.train.copy()
            own[: batch.lead] = False
            for order, values in enumerate(_ngrams(batch)):
                keys, _, which = _distinct(values)
                counts = np.bincount(which[own], minlength=len(keys))
                cuts = _cuts(keys, n_shards)
                made = [(task << 24 | batch.number, order * n_shards + s, b - a, _pack_sorted(keys[a:b]), _pack(counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["batch", "shard", "n", "keys", "counts"])

    return run


def _checksum(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(0)).view(np.int64))


def _adding(n_shards: int):
    """A shard's answers: the total count of each n-gram of each batch, and one row
    (batch -1) with the shard's tokens and distinct tokens of training texts."""

    def run(group: pa.Table) -> pa.Table:
        shard, sizes = group["shard"][0].as_py(), group["n"].to_pylist()
        lists = [_unpack_sorted(k.as_py(), n) for k, n in zip(group["keys"], sizes, strict=True)]
        counts = np.concatenate([_unpack(c.as_py(), n) for c, n in zip(group["counts"], sizes, strict=True)]).astype(np.int64)
        keys, _, which = _distinct(np.concatenate(lists))
        total = np.bincount(which, counts, len(keys)).astype(np.int64)
        ends = np.cumsum([0, *sizes])
        rows = [(b, shard, n, _checksum(k), _pack(total[which[i : i + n]]), 0, 0) for b, n, k, i in zip(group["batch"].to_pylist(), sizes, lists, ends, strict=False)]
        if shard < n_shards:
            rows.append((-1, shard, 0, 0, b"", int(total.sum()), int((total > 0).sum())))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["batch", "shard", "n", "check", "counts", "total", "distinct"])

    return run


def _token_rows(id_type: pa.DataType, most: int):
    """Each batch's tokens, as places in a list of its distinct tokens."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids = TaskContext.get().partitionId(), []
        for b in _batches(rows, ids, most):
            keys, _, which = _distinct(b.tokens)
            starts = np.append(0, np.flatnonzero(b.text[1:] != b.text[:-1]) + 1)
            first, last = int(b.text[0]), int(b.text[-1])
            names = pa.concat_arrays([x.cast(id_type) for x in ids]).slice(first, last - first + 1)
            listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            shape = np.array([task, first, b.lead, int(b.pos[0]), len(b.tokens), len(keys)], np.int64)
            values = [
                pa.array([task << 24 | b.number], pa.int64()),
                pa.array([_pack_sorted(keys)], pa.binary()),
                pa.array([_pack(which)], pa.binary()),
                pa.array([_pack(np.diff(starts, append=len(b.tokens)))], pa.binary()),
                pa.array([shape.tolist()], pa.list_(pa.int64())),
                pa.array([int(b.before.view(np.int64))], pa.int64()),
                listed,
            ]
            yield pa.RecordBatch.from_arrays(values, ["batch", "keys", "tokens", "lengths", "shape", "before", "ids"])

    return run


class Automaton:
    """The part of the automaton that a batch needs.  n-grams of each order are
    numbered by hash; what is behind the last single token's number is begin."""

    def __init__(self, batch: Batch, counts: list[np.ndarray], grams: list[tuple], total: int, distinct: int, n_texts: int):
        (_, _, self.one), (_, first2, self.two), (_, first3, self.three) = grams
        c1, c2, c3 = counts
        base = total + 0.5 * (distinct + 1)
        p1 = (c1 + 0.5) / base
        c1 = np.append(c1, n_texts)  # begin, as a context, was met once in each text
        begin, pos = len(c1) - 1, batch.pos
        prev = np.where(pos[first2] == 0, begin, self.one[first2 - 1])  # of a lead met once only the state behind it is asked for
        self.suffix = self.one[first2]
        p2 = (c2 + STRENGTH * p1[self.suffix]) / (c1[prev] + STRENGTH)
        prev = self.two[first3 - 1]
        behind = pos[first3] > 0
        lower = p2[self.two[first3]]
        p3 = np.where(behind, (c3 + STRENGTH * lower) / (c2[prev] + STRENGTH), lower)
        self.seen = [c1 > 0, c2 > 0, (c3 > 0) & behind]
        self.weight = [np.log10(p1), np.log10(p2), np.log10(p3)]
        self.failing = [np.log10(STRENGTH / (c + STRENGTH)) for c in (c1, c2)]
        self.begin = begin

    def state(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, number) of the state behind the tokens at these places."""
        long, short = self.seen[1][self.two[at]], self.seen[0][self.one[at]]
        return np.where(long, 2, np.where(short, 1, 0)), np.where(long, self.two[at], self.one[at])

    def traverse(self, starts: np.ndarray, lengths: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """log10 probability of each lane of tokens; lanes go side by side, one token
        a step.  ``fresh`` lanes start in the state of begin, others behind the
        token before them."""
        order = np.argsort(-lengths, kind="stable")
        start, length = starts[order], lengths[order]
        size, number = self.state(np.maximum(start - 1, 0))
        begins = fresh[order]
        size[begins], number[begins] = (1 if self.seen[0][self.begin] else 0), self.begin
        total = np.zeros(len(start))
        active = len(start)
        for step in range(int(length[0]) if active else 0):
            active = int(np.searchsorted(-length, -step, "left"))
            at = start[:active] + step
            size, number, sums = size[:active], number[:active], total[:active]
            one, two, three = self.one[at], self.two[at], self.three[at]
            fails = (size == 2) & ~self.seen[2][three]
            sums[fails] += self.failing[1][number[fails]]
            number = np.where(fails, self.suffix[np.where(size == 2, number, 0)], number)
            goes3 = (size == 2) & ~fails
            size = np.where(fails, 1, size)
            pair = self.seen[1][two]
            fails = (size == 1) & ~pair
            sums[fails] += self.failing[0][number[fails]]
            goes2 = (size == 1) & pair
            sums += np.where(goes3, self.weight[2][three], np.where(goes2, self.weight[1][two], self.weight[0][one]))
            known = self.seen[0][one]
            size, number = np.where(pair, 2, np.where(known, 1, 0)), np.where(pair, two, one)
        out = np.zeros(len(starts))
        out[order] = total
        return out


def _scoring(n_shards: int, total: int, distinct: int, n_texts: int, id_type: pa.DataType, lane: int):
    def run(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: tokens[c][0].as_py() for c in ("keys", "tokens", "lengths", "shape", "before")}
        ids = tokens["ids"].combine_chunks().flatten()
        task, first, lead, pos0, n, n_keys = row["shape"]
        lengths = _unpack(row["lengths"], len(ids)).astype(np.int64)
        keys = _unpack_sorted(row["keys"], n_keys)
        starts = np.cumsum(lengths) - lengths
        pos = (np.arange(n) - np.repeat(starts, lengths)).astype(np.int32)
        pos[: lengths[0]] += pos0
        batch = Batch(0, keys[_unpack(row["tokens"], n).astype(np.int64)], np.minimum(pos, 2).astype(np.int8), np.repeat(np.arange(len(ids), dtype=np.int32), lengths), np.zeros(0, bool), lead, np.int64(row["before"]).view(np.uint64))
        del row
        grams, counts = [_distinct(values) for values in _ngrams(batch)], []
        for _, places, which in grams if lead else []:  # of a lead the context isn't known: take another place if there is one
            same = np.flatnonzero(which == which[0])
            places[which[0]] = same[min(1, len(same) - 1)]
        order = np.argsort(answers["shard"].to_numpy())
        shard, size, check, packed = (answers[c].to_numpy()[order] for c in ("shard", "n", "check", "counts"))
        for k, (distinct_keys, _, _) in enumerate(grams):
            mine = np.flatnonzero(shard // n_shards == k)
            joined = np.bitwise_xor.reduce(check[mine]) if len(mine) else 0
            if size[mine].sum() != len(distinct_keys) or joined != _checksum(distinct_keys):
                raise ValueError("docs came in other partitions the second time; store them first")
            counts.append(np.concatenate([_unpack(packed[i], size[i]) for i in mine]).astype(np.int64))
        automaton = Automaton(batch, counts, grams, total, distinct, n_texts)
        # a lane is a run of one text's tokens; a lead isn't scored
        begins, count = starts.copy(), lengths.copy()
        begins[0], count[0] = begins[0] + lead, count[0] - lead
        lanes = -(-count // lane)
        owner = np.repeat(np.arange(len(ids)), lanes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begins[owner] + within * lane
        fresh = (within == 0) & (pos[at] == 0) if len(at) else np.zeros(0, bool)
        score = np.bincount(owner, automaton.traverse(at, np.minimum(lane, count[owner] - within * lane), fresh), len(ids))
        places = np.arange(n) >= lead
        text = batch.text[places]
        known = np.bincount(text, automaton.seen[0][automaton.one[places]], len(ids)).astype(np.int64)
        base = np.bincount(text, automaton.weight[0][automaton.one[places]], len(ids))
        arrays = [pa.array(np.full(len(ids), task)), pa.array(first + np.arange(len(ids))), ids.cast(id_type), pa.array(count), pa.array(known), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(arrays, ["task", "row", "id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH, shard_bytes: int = SHARD_BYTES, lane: int = LANE) -> DataFrame:
    """One row for each row of docs: id, n_tokens, n_known, train_tokens, base_score,
    score.  The model learns from the rows where ``train`` is true.  The sizes of
    batches, shards and lanes change no result."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    id_type, named = to_arrow_type(rows.schema["id"].dataType), rows.schema["id"].dataType.simpleString()
    # the numbers of rows and bytes are all that reaches the driver here
    shape = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if("train").alias("texts")).first()
    n_shards = max(1, math.ceil(shape["bytes"] / shard_bytes))
    listed = rows.mapInArrow(_listing(n_shards, batch_tokens), _PACKED)
    answers = written(listed.groupBy("shard").applyInArrow(_adding(n_shards), _ANSWER))
    seen = answers.filter("batch = -1").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    tokens = rows.mapInArrow(_token_rows(id_type, batch_tokens), f"batch long, keys binary, tokens binary, lengths binary, shape array<long>, before long, ids array<{named}>")
    pieces = tokens.groupBy("batch").cogroup(answers.filter("batch >= 0").select("batch", "shard", "n", "check", "counts").groupBy("batch"))
    parts = written(pieces.applyInArrow(_scoring(n_shards, seen["n"], seen["v"], shape["texts"], id_type, lane), f"task long, row long, id {named}, n_tokens long, n_known long, base_score double, score double"))
    dropped(answers)
    whole = parts.groupBy("task", "row").agg(F.first("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return whole.select(id_col, "n_tokens", "n_known", F.lit(seen["n"]).cast("long").alias("train_tokens"), "base_score", "score")
