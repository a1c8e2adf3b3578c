"""SentencePiece encoding and decoding by suffix-array matching.

Texts fall into chunks that no merge can cross (runs of ▁ with what follows, up
to the next ▁, and characters that are in no piece stand alone).  The distinct
chunks of a batch are concatenated and their suffixes sorted (ranks by prefix
doubling, up to the longest piece, ending at chunk ends); every piece of the
vocabulary is binary-searched for its range of occurrences, and each occurrence
is an edge (position, length, rank).  Edges are laid out by position, and then
relaxed.  For a BPE model that relaxation is by merge rank, not by path score:
in each round every chunk takes its best edge over two neighbouring symbols (the
highest score, then the leftmost), until it has none.  A best-path relaxation
over the same edges would be right for unigram models only; on this vocabulary
its segmentations differ from the library's.

Characters without a piece become byte pieces.  Decoding joins the pieces'
bytes, turns ▁ into spaces and takes the first space away.

Chunks of more than LONG characters (Chinese, Base64) are cut further between any
two characters that stand side by side in no piece, which no merge can cross.
Chunks already encoded are remembered, up to MEMO of them per worker.  Texts of over
RUN characters are encoded alone, some chunks at a time, so that memory is bounded by
BATCH characters, the text with its ids, and the longest run of characters of which
each two neighbours occur in some piece: one of over RUN is indexed window by window,
its edges kept as lists by position.  No shuffle; each input row gives one output row.  Null text counts as empty: no ids, decoded as empty.
``round_trip`` is false where the text cannot come back (it holds a literal ▁).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
BATCH = 1 << 20
INDEX = 1 << 18
MEMO = 1 << 18
LONG = 48
RUN = 1 << 17
_NONE = np.iinfo(np.int32).max


def gathered(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rows of a list of lists, one after the other, and their lengths."""
    count = at[rows + 1] - at[rows]
    shift = at[rows] - (np.cumsum(count) - count)
    return flat[np.repeat(shift, count) + np.arange(int(count.sum()))], count


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = [b""] * n
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not (sp.is_control(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.raw[i] = piece.replace(SPACE, " ").encode()
        # pieces by falling score; equal scores have equal ranks
        self.pieces = sorted(self.ids, key=lambda p: (-sp.get_score(self.ids[p]), p))
        score = np.array([sp.get_score(self.ids[p]) for p in self.pieces])
        self.rank = np.append(np.unique(-score, return_inverse=True)[1], _NONE).astype(np.int64)
        self.id_of = np.array([*(self.ids[p] for p in self.pieces), -1], np.int32)
        self.longest = max(map(len, self.pieces))
        known = set("".join(self.pieces))
        apart = re.escape("".join(c for c in "\n\r\t" if c not in known))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces):
            raise ValueError("a piece crosses the begin of a word")
        self.chunks = re.compile(f"[{apart}]|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.size = np.array([len(p) for p in self.pieces])
        self.codes = np.zeros((len(self.pieces), self.longest), np.uint32)
        flat = np.frombuffer("".join(self.pieces).encode("utf-32-le"), np.uint32)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.codes[np.repeat(np.arange(len(self.size)), self.size), at] = flat
        self.bytes_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.bytes_at = np.concatenate(([0], np.cumsum([len(r) for r in self.raw])))
        # chunks known so far: number of each, and their ids one after the other
        self.number: dict[str, int] = {}
        self.ids_flat, self.ids_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # --- the index of a batch

    def edges(self, flat: np.ndarray) -> np.ndarray:
        """(position, length) -> piece there (by falling score; the last entry
        is none), laid out by position.  Code 0 separates chunks."""
        n, width = len(flat), self.longest
        table = np.full((n, width + 1), len(self.pieces), np.int32)
        alphabet = np.unique(flat)
        letter = np.zeros(n + width + 4, np.uint16)  # 0: a separator, or behind the end
        letter[:n] = np.searchsorted(alphabet, flat) + (alphabet[0] != 0)
        windows = np.lib.stride_tricks.sliding_window_view(letter, width)[:n]
        wide = letter.astype(np.uint64)
        key = (wide[:n] << np.uint64(48)) | (wide[1 : n + 1] << np.uint64(32)) | (wide[2 : n + 2] << np.uint64(16)) | wide[3 : n + 3]
        step = 4
        while True:  # prefix doubling: ranks by the first ``step`` characters
            suffixes = np.argsort(key, kind="stable")
            if step >= width:
                break
            ordered = key[suffixes]
            rank = np.zeros(n + step, np.uint64)
            rank[suffixes] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
            key = (rank[:n] << np.uint64(32)) | rank[step : n + step]
            step *= 2
        as_text = lambda x: np.ascontiguousarray(x, dtype=">u2").view(f"S{2 * width}").ravel()
        shown = as_text(windows[suffixes])
        spot = np.minimum(np.searchsorted(alphabet, self.codes), len(alphabet) - 1)
        filled = self.codes > 0
        usable = np.flatnonzero(((alphabet[spot] == self.codes) | ~filled).all(axis=1))
        code, filled = spot[usable] + (alphabet[0] != 0), filled[usable]
        first = np.searchsorted(shown, as_text(np.where(filled, code, 0)), "left")
        last = np.searchsorted(shown, as_text(np.where(filled, code, 0xFFFF)), "right")
        count = last - first
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        places = suffixes[np.repeat(first, count) + inside]
        table[places, np.repeat(self.size[usable], count)] = np.repeat(usable, count)
        return table

    def split(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, by merges over the edges, and how many each has."""
        flat = np.frombuffer("\0".join(chunks).encode("utf-32-le"), np.uint32)
        size = np.array([len(c) for c in chunks])
        first = np.cumsum(size + 1) - size - 1
        # a NUL in a text has no piece either
        table = self.edges(flat)
        width = self.longest
        chunk = np.repeat(np.arange(len(chunks)), size)
        begin = first[chunk] + np.arange(len(chunk)) - np.repeat(np.cumsum(size) - size, size)
        long_ = np.flatnonzero(size > LONG)
        open_ = size[chunk] <= LONG
        begin, chunk = begin[open_], chunk[open_]
        stop = first + size
        done = [np.zeros(0, np.int64)]
        while len(begin):  # the begins of the symbols of chunks still open
            last = np.append(chunk[1:] != chunk[:-1], True)
            end = np.where(last, stop[chunk], np.append(begin[1:], 0))
            reach = np.append(end[1:], 0) - begin
            pair = np.where(last | (reach > width), _NONE, self.rank[table[begin, np.clip(reach, 0, width)]])
            heads = np.flatnonzero(np.append(True, last[:-1]))
            best = np.minimum.reduceat((pair << 32) | np.arange(len(begin)), heads)
            merged = (best >> 32) < _NONE
            keep = np.repeat(merged, np.diff(np.append(heads, len(begin))))
            done.append(begin[~keep])
            keep[(best[merged] & 0xFFFFFFFF) + 1] = False
            begin, chunk = begin[keep], chunk[keep]
        done += [first[k] + np.array(self._long(chunks[k], table, int(first[k]))) for k in long_]
        starts = np.sort(np.concatenate(done))
        at = np.searchsorted(starts, np.append(first, len(flat) + 1))
        end = np.append(starts[1:], 0)
        end[at[1:][size > 0] - 1] = stop[size > 0]
        length = end - starts
        ids = self.id_of[np.where(length <= width, table[starts, np.minimum(length, width)], len(self.pieces))]
        count = np.diff(at)
        missing = np.flatnonzero(ids < 0)
        if len(missing):  # characters without a piece
            codes, which = np.unique(flat[starts[missing]], return_inverse=True)
            forms = [[self.byte_ids[b] for b in chr(c).encode()] for c in codes]
            times = np.ones(len(ids), np.int64)
            times[missing] = np.array([len(f) for f in forms])[which]
            np.add.at(count, np.searchsorted(at, missing, "right") - 1, times[missing] - 1)
            ids = np.repeat(ids, times)
            ids[ids < 0] = np.fromiter(chain.from_iterable(forms[k] for k in which), np.int32)
        return ids, count

    def _long(self, chunk: str, table: np.ndarray, offset: int) -> list[int]:
        """Begins of the symbols of one long chunk, by a queue of merges."""
        n = len(chunk)
        end = list(range(1, n + 1))  # of the symbol that begins at a position
        before, alive = list(range(-1, n - 1)), [True] * n
        queue: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < n and end[end[a]] - a <= self.longest:
                rank = int(self.rank[table[offset + a, end[end[a]] - a]])
                if rank != _NONE:
                    heapq.heappush(queue, (rank, a, end[end[a]]))

        for a in range(n):
            offer(a)
        while queue:
            _, a, b = heapq.heappop(queue)
            if not alive[a] or end[a] >= n or end[end[a]] != b:
                continue
            alive[end[a]] = False
            end[a] = b
            if b < n:
                before[b] = a
            offer(a)
            offer(before[a])
        return [a for a in range(n) if alive[a]]

    def edge_lists(self, chunk: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges of two and more characters of one long run: where the list of a
        position begins, and the lengths and pieces of all lists.  The run is indexed
        in windows that reach over the next one by a piece."""
        at, sizes, found = np.zeros(len(chunk) + 1, np.int64), [], []
        for a in range(0, len(chunk), INDEX):
            window = chunk[a : a + INDEX + self.longest - 1]
            table = self.edges(np.frombuffer(window.encode("utf-32-le"), np.uint32))[:INDEX, 2:]
            place, size = np.nonzero(table < len(self.pieces))
            at[a + 1 : a + 1 + len(table)] = np.bincount(place, minlength=len(table))
            sizes.append((size + 2).astype(np.uint8))
            found.append(table[place, size])
        return np.cumsum(at), np.concatenate(sizes), np.concatenate(found)

    def run_ids(self, chunk: str) -> np.ndarray:
        """The ids of one long run, by a queue of merges over its lists of edges.
        Merges are numbers of rank, position and length; those that two characters
        offer are sorted beforehand, so the queue holds later ones only."""
        at, sizes, found = self.edge_lists(chunk)
        n, most = len(chunk), len(self.pieces)
        pairs = np.flatnonzero(sizes == 2)
        spot = np.searchsorted(at, pairs, "right") - 1
        ready = memoryview(np.sort((self.rank[found[pairs]] << 40 | spot) << 6 | 2))
        del pairs, spot
        at, sizes, found, rank = (memoryview(x) for x in (at, sizes, found, self.rank))
        end, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        alive, chosen = bytearray(b"\1") * n, array("i", [most]) * n
        queue: list[int] = []

        def piece(a: int, size: int) -> int:
            return next((found[k] for k in range(at[a], at[a + 1]) if sizes[k] == size), most)

        def offer(a: int) -> None:
            if a >= 0 and end[a] < n:
                p = piece(a, end[end[a]] - a)
                if p < most:
                    heapq.heappush(queue, (rank[p] << 40 | a) << 6 | end[end[a]] - a)

        k, m = 0, len(ready)
        while k < m or queue:
            if queue and (k >= m or queue[0] < ready[k]):
                merge = heapq.heappop(queue)
            else:
                merge, k = ready[k], k + 1
            a, size = merge >> 6 & (1 << 40) - 1, merge & 63
            if not alive[a] or end[a] >= n or end[end[a]] - a != size:
                continue
            b = a + size
            alive[end[a]] = 0
            end[a], chosen[a] = b, piece(a, size)
            if b < n:
                before[b] = a
            offer(a)
            offer(before[a])
        starts = np.flatnonzero(np.frombuffer(alive, np.uint8))
        which = np.frombuffer(chosen, np.int32)[starts]
        ids = self.id_of[which]
        alone = np.flatnonzero(which == most)
        codes, form = np.unique(np.frombuffer(chunk.encode("utf-32-le"), np.uint32)[starts[alone]], return_inverse=True)
        forms = [[self.ids[chr(c)]] if chr(c) in self.ids else [self.byte_ids[b] for b in chr(c).encode()] for c in codes]
        if not forms:
            return ids
        times = np.ones(len(ids), np.int64)
        times[alone] = np.array([len(f) for f in forms])[form]
        ids = np.repeat(ids, times)
        ids[ids < 0] = np.fromiter(chain.from_iterable(forms[f] for f in form), np.int32)
        return ids

    # --- texts

    def cut(self, chunk: str) -> Iterator[str]:
        """A long chunk, cut where no piece can lie across."""
        a = 0
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in self.pairs:
                yield chunk[a:k]
                a = k
        yield chunk[a:]

    def long_text(self, text: str) -> np.ndarray:
        """The ids of one long text, by parts, as chunks don't depend on each other."""
        found, held, size = [np.zeros(0, np.int32)], [], 0
        for match in self.chunks.finditer(SPACE + text.replace(" ", SPACE)):
            for c in self.cut(match[0]) if len(match[0]) > LONG else (match[0],):
                if size + len(c) > BATCH or len(c) > RUN:
                    found.append(self.chunk_ids([held])[0])
                    held, size = [], 0
                if len(c) > RUN:
                    found.append(self.run_ids(c))
                else:
                    held.append(c)
                    size += len(c)
        return np.concatenate([*found, self.chunk_ids([held])[0]])

    def learn(self, asked: set[str]) -> None:
        """Number new chunks; when there are too many, only those asked for stay."""
        new = list(asked - self.number.keys())
        if len(self.number) + len(new) > MEMO:
            kept = list(asked & self.number.keys())
            at = np.fromiter((self.number[c] for c in kept), np.int64, len(kept))
            self.ids_flat, count = gathered(self.ids_flat, self.ids_at, at)
            self.ids_at = np.concatenate(([0], np.cumsum(count)))
            self.number = dict(zip(kept, range(len(kept)), strict=True))
        parts, counts, at = [self.ids_flat], [np.diff(self.ids_at)], 0
        while at < len(new):
            size, to = 0, at
            while to < len(new) and size < INDEX:
                size += len(new[to])
                to += 1
            ids, count = self.split(new[at:to])
            parts.append(ids)
            counts.append(count)
            at = to
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.ids_flat = np.concatenate(parts)
            self.ids_at = np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and their offsets."""
        if any(len(t) > RUN for t in texts):
            ids = [self.long_text(t) if len(t) > RUN else self.encode([t])[0] for t in texts]
            return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        found = [self.chunks.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        for k, chunks in enumerate(found):
            if chunks and max(map(len, chunks)) > LONG:
                found[k] = list(chain.from_iterable(self.cut(c) if len(c) > LONG else (c,) for c in chunks))
        return self.chunk_ids(found)

    def chunk_ids(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given by their chunks, and the offsets of the texts."""
        self.learn(set(chain.from_iterable(found)))
        n = np.array([len(f) for f in found])
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
        ids, count = gathered(self.ids_flat, self.ids_at, numbers)
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, total[np.concatenate(([0], np.cumsum(n)))]

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """UTF-8 of texts given as encode() returns them."""
        data, cuts = bytearray(), np.zeros(len(at), np.int64)
        for k in range(0, len(ids), BATCH):
            part, count = gathered(self.bytes_flat, self.bytes_at, ids[k : k + BATCH])
            a, b = np.searchsorted(at, [k + 1, k + BATCH + 1])
            cuts[a:b] = len(data) + np.cumsum(count)[at[a:b] - k - 1]
            data += part.tobytes()
        ends, data = cuts.tolist(), bytes(data)
        return [data[a:b].removeprefix(b" ") for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids) -> str:
        look = self.raw.__getitem__
        return b"".join(map(look, ids)).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _runs(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        if held and (size >= BATCH or len(t) > RUN):
            yield held
            held, size = [], 0
        if len(t) > RUN:
            yield [t]
        else:
            held.append(t)
            size += len(t)
    if held:
        yield held


NEW = ("ids", "n_tokens", "ids_sha256", "round_trip")


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs without the text, with ids (if ``keep_ids``), n_tokens, ids_sha256
    (of the ids as 4-byte little-endian integers) and round_trip (whether
    decoding gives the text back).  Columns of these names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in NEW])
    names = [c for c in docs.columns if c != text_col]
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(text_col).fill_null("").to_pylist()):
                part = batch.slice(at, len(texts))
                at += len(texts)
                ids, cuts = own.encode(texts)
                count = np.diff(cuts)
                digest = [hashlib.sha256(np.ascontiguousarray(ids[a:b])).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
                same = [x == t.encode() for x, t in zip(own.decoded(ids, cuts), texts, strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))] * keep_ids
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), *lists, pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], [*names, *(f.name for f in added)]
                )

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *added]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The other columns, and text; null ids give null."""
    names = [c for c in encoded.columns if c not in (ids_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    return encoded.mapInArrow(run, T.StructType([*(encoded.schema[c] for c in names), T.StructField("text", T.StringType())]))
