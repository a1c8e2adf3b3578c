"""Permutation enrichment of feature sets.

Features are ranked by the absolute rank correlation with an outcome, a covariate
held fixed if there is one.  For each permutation of the outcome's labels they are
ranked anew, and the members of each set among the first share of the features are
counted; p is (k + 1) / (n + 1), with k the permutations that have at least as many
as the true labels.

Subjects are numbered in their order and cut into blocks, and so are the features'
ranks and each permuted outcome.  A block of features meets the same subjects of a block
of permutations in one task (BLOCK_BYTES of each), which sends sums of products; the sums
of all blocks of subjects give the correlations, one row of a feature and a block of
permutations, stored once.  Only the order of a permutation is made in one piece: its
task holds names and outcomes of the subjects in Arrow and some 45 bytes a subject, for
one permutation after another.  A first pass over the correlations counts |r| by bins for
each permutation, which tells the bin of the last feature of the first share; the
second pass returns members of sets above that bin, and all features in it, which
are ranked exactly.  So no permutation copies the table, no task has all features or all
permutations, and the driver has neither subjects nor features.

Ranks are whole numbers when doubled and centred, and so are their products: sums of a
block are exact below 2^53 (some 10^6 subjects), and correlations come from exact sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.relational import ContractError
from .ordering import numbered
from .shared import stored
from .stats import RANKED_ROWS, average_rank

#: Bytes of features, and of permuted outcomes, that a task multiplies.
BLOCK_BYTES = 1 << 24
#: Subjects of a block, at most.
SUBJECTS = 1 << 13
#: Permutations that a task orders, one at a time, after it got the names.
ORDERED = 16
BINS = 256
_SIDE = 1 << 10
#: Groups that the features of a block are cut in, and least ranges of subjects.
_CUTS = 16


def average_ranks(rows: np.ndarray) -> np.ndarray:
    """Ranks along the last axis, ties at their mean."""
    order = np.argsort(rows, axis=-1, kind="stable")
    ordered = np.take_along_axis(rows, order, -1)
    place = np.broadcast_to(np.arange(rows.shape[-1]), rows.shape)
    new = np.ones(rows.shape, bool)
    new[..., 1:] = ordered[..., 1:] != ordered[..., :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=-1)
    ends = np.ones(rows.shape, bool)
    ends[..., :-1] = new[..., 1:]
    last = np.flip(np.minimum.accumulate(np.flip(np.where(ends, place, rows.shape[-1]), -1), axis=-1), -1)
    ranks = np.empty(rows.shape)
    np.put_along_axis(ranks, order, (first + last) / 2 + 1, -1)
    return ranks


def _packing(group: pa.Table) -> pa.Table:
    """A block of subjects in their order, as one Arrow stream of names and ranks."""
    rows = group.sort_by("_i").drop_columns(["_j", "_i"]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return pa.table({"_j": group["_j"].combine_chunks()[:1], "block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _places(blocks: list[pa.Table], mark) -> np.ndarray:
    """The place of each subject by the digest of the mark and its name."""
    digests = np.empty((sum(b.num_rows for b in blocks), 16), np.uint8)
    at = 0
    for block in blocks:
        found = []
        for name in block["name"].cast(pa.binary()).to_numpy():
            whole = mark.copy()
            whole.update(name)
            found.append(whole.digest())
        digests[at : at + len(found)] = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)
        at += len(found)
    halves = digests.view(">u8")
    first = halves[:, 0].astype(np.uint64)
    order = np.argsort(first)
    ordered = first[order]
    if (ordered[1:] == ordered[:-1]).any():
        order = np.lexsort((halves[:, 1], first))  # stable, so equal digests stay in order
    places = np.empty(at, np.int32)
    places[order] = np.arange(at, dtype=np.int32)
    return places


def _permuting(seed: str, n: int, each: int):
    """(perm, _j, outcome) of a group that holds all blocks of subjects and the number
    of a run of permutations; 0 is the order as it is.  The place of a subject is its
    place by the MD5 of seed, permutation and subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, runs = {}, set()
        for batch in batches:
            runs.update(batch.column("_run").to_pylist())
            held.update((j.as_py(), pa.ipc.open_stream(b.as_buffer()).read_all()) for j, b in zip(batch.column("_j"), batch.column("block"), strict=True))
        numbers = sorted(held)
        blocks = [held[j] for j in numbers]
        outcome = np.concatenate([b["y"].to_numpy() for b in blocks]).astype(np.int32)
        ends = np.cumsum([b.num_rows for b in blocks])[:-1]
        (number,) = runs
        for perm in range(number * each, min(n + 1, (number + 1) * each)):
            mine = outcome[_places(blocks, hashlib.md5(f"{seed}|{perm}|".encode()))] if perm else outcome
            parts = [part.tobytes() for part in np.split(mine, ends)]
            yield pa.RecordBatch.from_arrays([pa.array([perm] * len(parts), pa.int32()), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], ["perm", "_j", "outcome"])

    return run


def _building(feature: str, size: int, n_people: int, f_blocks: int):
    """(_f, _j, feature, ranks) of features that have each subject of a block once."""

    def run(group: pa.Table) -> pa.Table:
        f, j = group["_g"][0].as_py() % f_blocks, group["_j"][0].as_py()
        width = min(size, n_people - j * size)
        coded = group["_feature"].combine_chunks().dictionary_encode()
        row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + group["_at"].to_numpy()
        names = coded.dictionary
        once = (np.bincount(row, minlength=len(names) * width).reshape(-1, width) == 1).all(axis=1)
        ranks = np.zeros(len(names) * width, np.int32)
        ranks[row] = group["_x"].to_numpy()
        kept = np.flatnonzero(once)
        lists = pa.array([ranks[k * width : (k + 1) * width].tobytes() for k in kept], pa.binary())
        return pa.table({"_f": pa.array([f] * len(kept), pa.int32()), "_j": pa.array([j] * len(kept), pa.int32()), feature: names.take(pa.array(kept)), "ranks": lists})

    return run


def _matrix(rows: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.int32).reshape(len(rows), -1).astype(float)


def _multiplying(feature: str, out: pa.Schema):
    """Sums of products of one block of subjects: features and, without a feature's
    name, the covariate with themselves, the covariate and the permuted outcomes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return out.empty_table()
        x, y = _matrix(left["ranks"]), _matrix(right.sort_by("perm")["outcome"])
        of_covariate = left["covariate"].to_numpy().nonzero()[0]
        xz = x @ x[of_covariate[0]] if len(of_covariate) else np.zeros(len(x))
        xy = x @ y.T
        sums = [pa.array(np.full(len(x), x.shape[1])), pa.array((x * x).sum(axis=1)), pa.array(xz), pa.array([v.tobytes() for v in xy], pa.binary())]
        return pa.Table.from_arrays([left["_f"], left["_p"], left["covariate"], left[feature], *sums], schema=out)

    return run


def _adding(feature: str, n_people: int, yy: int, out: pa.Schema):
    """|r| to nine digits of each feature and permutation of a block, from the sums of all
    blocks of subjects; -1 for a feature of which the covariate leaves nothing."""
    kind = np.int64 if n_people**3 < 2**63 else float  # no sum exceeds n^3
    least = 1e-18 if SUBJECTS * n_people**2 < 2**53 else 1e-14  # what rounding errors leave

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            block = {c: batch.column(c)[0].as_py() for c in ("_f", "_p")}
            for covariate, name, *more, xy in zip(*[batch.column(c).to_pylist() for c in ("covariate", feature, "subjects", "xx", "xz", "xy")], strict=True):
                total = sums.setdefault((covariate, name), [0, 0, 0, 0])
                for k, v in enumerate((*map(int, more), np.frombuffer(xy).astype(kind))):
                    total[k] = total[k] + v
        sums = {key: total for key, total in sums.items() if total[0] == n_people and total[1] > 0}  # complete, and varies
        of_covariate = [total for (covariate, _), total in sums.items() if covariate]
        for (covariate, name), (_, xx, xz, xy) in sums.items():
            if covariate:
                continue
            if of_covariate:
                _, zz, _, yz = of_covariate[0]
                yz = yz.astype(object)
                rest = np.array([yy * zz - v * v for v in yz], object)
                left = xx * zz - xz * xz
                good = rest > least * yy * zz
                whole = np.abs((xy.astype(object) * zz - xz * yz).astype(float)) / np.sqrt(np.where(good, rest, 1).astype(float)) / np.sqrt(float(max(left, 1)))
                r = np.where(good, whole, 0.0) if left > least * xx * zz else np.full(len(xy), -1.0)
            else:
                r = np.abs(xy.astype(float)) / np.sqrt(float(xx)) / np.sqrt(float(yy)) if yy else np.zeros(len(xy))
            r = np.minimum(np.round(r, 9), 1.0)
            yield pa.RecordBatch.from_arrays([pa.array([block["_p"]], pa.int32()), pa.array([name], out.field(feature).type), pa.array([r.tobytes()], pa.binary())], schema=out)

    return run


def _bin(r: np.ndarray) -> np.ndarray:
    return np.minimum((r * BINS).astype(np.int64), BINS - 1)


def _numbered(people: DataFrame, subject: str, asked: list[str], n_people: int) -> DataFrame:
    """(subject, _name, _i, y and z): the number of each subject in their order, and
    average ranks of what is asked, doubled and less their mean, which are whole."""
    parts = max(_CUTS, -(-n_people // RANKED_ROWS))
    out = numbered(people, [subject], parts=parts).withColumn("_i", F.col("_rn") - 1).drop("_rn", "_m", "_b")
    for c, name in zip(asked, ("y", "z"), strict=False):
        twice = numbered(people.select(F.col(c).alias("_c"), F.col(subject).alias("_s")), ["_c", "_s"], parts=parts)
        ranks = twice.groupBy("_c").agg((F.min("_rn") + F.max("_rn") - (n_people + 1)).alias(f"_{name}"))
        out = out.join(ranks, F.col(c) == F.col("_c")).drop("_c")
    return out.select(subject, F.col(subject).cast("string").alias("_name"), "_i", *[F.col(f"_{name}").alias(name) for _, name in zip(asked, ("y", "z"), strict=False)])


def permutation_enrichment(cells: DataFrame, outcome: DataFrame, members: DataFrame, feature: str, subject: str, value: str, y: str, covariate: str | None = None, n: int = 2000, seed: str = "s", share: float = 0.05) -> DataFrame:
    """(set_name, n_set, observed, n_perm, n_at_least, p_value) of (feature, subject,
    value), (subject, y, covariate) and (set_name, feature).  Subjects without y or
    covariate are left out, as are features that lack a value of one of the others
    or don't vary.  Ties of |r| go to the smaller feature.  Sets without a ranked
    member have no row."""
    asked = [y, *([covariate] if covariate else [])]
    people = stored(outcome.dropna(subset=[subject, *asked]).select(F.col(subject).alias("_subject"), *[F.col(c).cast("double").alias(f"_asked{k}") for k, c in enumerate(asked)]))
    if people.groupBy(F.col("_subject").cast("string").alias("_name")).agg(F.count("*").alias("_c")).filter("_c > 1").head(1):
        raise ContractError("a subject has several outcomes")
    vectors = stored(_correlations(cells, people, len(asked), feature, subject, value, n, seed))
    ranked = members.select("set_name", feature).distinct()
    counts = _counts(vectors, feature, ranked, n, share)
    seen = counts.filter("perm = 0").select("set_name", F.col("n_top").alias("observed"))
    sizes = ranked.join(vectors.filter("_p = 0").select(feature), feature, "left_semi").groupBy("set_name").agg(F.count("*").alias("n_set"))
    base = sizes.join(seen, "set_name", "left").withColumn("observed", F.coalesce("observed", F.lit(0).cast("long")))
    above = base.join(counts.filter("perm > 0"), "set_name").filter(F.col("n_top") >= F.col("observed")).groupBy("set_name").agg(F.count("*").alias("_k"))
    # a permutation without any member has no row, and counts where none was observed
    k = F.when(F.col("observed") == 0, F.lit(n).cast("long")).otherwise(F.coalesce("_k", F.lit(0).cast("long")))
    out = base.join(above, "set_name", "left").withColumn("n_at_least", k).withColumn("n_perm", F.lit(n).cast("long"))
    return out.withColumn("p_value", (F.col("n_at_least") + 1) / (F.col("n_perm") + 1)).select("set_name", "n_set", "observed", "n_perm", "n_at_least", "p_value")


def _side(n_people: int) -> tuple[int, int]:
    """Subjects of a block, and features or permutations of one."""
    size = max(1, min(SUBJECTS, n_people))
    return size, max(1, min(_SIDE, BLOCK_BYTES // (8 * size)))


def _correlations(cells: DataFrame, people: DataFrame, n_asked: int, feature: str, subject: str, value: str, n: int, seed: str) -> DataFrame:
    """(_p, feature, r): |r| of a feature and of the p-th side of permutations, as doubles."""
    spark = cells.sparkSession
    n_people = people.count()
    size, side = _side(n_people)
    kind = cells.schema[feature].dataType.simpleString()
    n_features = cells.select(feature).distinct().count()
    blocks, chunks = -(-n_people // size), -(-(n + 1) // side)
    f_blocks = max(1, -(-n_features // side))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    who = stored(_numbered(people, "_subject", [f"_asked{k}" for k in range(n_asked)], n_people))
    of_block = F.expr(f"cast(_i div {size} as int)").alias("_j")

    # features, ranked and cut
    known = cells.dropna(subset=[feature, subject, value]).select(F.col(feature).alias("_feature"), F.col(subject).alias("_subject"), F.col(value).cast("double").alias("_v")).join(who.select("_subject", "_i"), "_subject")
    dealt = known.select("_feature", "_i", "_v").repartition(max(least, n_features * n_people // RANKED_ROWS), "_feature")  # a single feature spills
    placed = dealt.select("_feature", of_block, F.expr(f"cast(_i % {size} as int)").alias("_at"), (average_rank(["_feature"], "_v") * 2 - (n_people + 1)).cast("int").alias("_x"))
    cut = placed.withColumn("_g", F.pmod(F.xxhash64("_feature"), F.lit(f_blocks * _CUTS)).cast("int")).repartition(max(least, n_features * n_people // RANKED_ROWS), "_g", "_j")
    left = cut.groupBy("_g", "_j").applyInArrow(_building(feature, size, n_people, f_blocks), f"_f int, _j int, `{feature}` {kind}, ranks binary").withColumn("covariate", F.lit(False))

    # outcomes, permuted and cut; each run of permutations gets all names
    columns = ["y", "z"][:n_asked]
    packed = who.select(of_block, "_i", F.col("_name").alias("name"), *[F.col(c).cast("int").alias(c) for c in columns]).groupBy("_j").applyInArrow(_packing, "_j int, block binary")
    packed = stored(packed)
    each = max(ORDERED, (1 << 18) // max(1, n_people))
    runs = -(-(n + 1) // each)
    sent = packed.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).repartitionByRange(runs, "_run")
    permuted = sent.groupBy("_run").applyInArrow(_permuting(seed, n, each), "perm int, _j int, outcome binary")
    if n_asked > 1:
        left = left.unionByName(packed.mapInArrow(_covariate, "_j int, ranks binary").select(F.explode(F.sequence(F.lit(0), F.lit(f_blocks - 1))).alias("_f"), "_j", F.lit(None).cast(kind).alias(feature), "ranks", F.lit(True).alias("covariate")))

    # sums of products of blocks, then of all subjects
    keys = ["_f", "_j", "_p"]
    parts = max(least, f_blocks * blocks * chunks // 8)
    left = left.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(parts, *keys)
    right = permuted.withColumn("_p", F.expr(f"cast(perm div {side} as int)")).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(f_blocks - 1)))).repartition(parts, *keys)
    arrow = left.select(feature).limit(0).toArrow().schema.field(0).type
    given = pa.schema([("_f", pa.int32()), ("_p", pa.int32()), ("covariate", pa.bool_()), (feature, arrow), ("subjects", pa.int64()), ("xx", pa.float64()), ("xz", pa.float64()), ("xy", pa.binary())])
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_multiplying(feature, given), f"_f int, _p int, covariate boolean, `{feature}` {kind}, subjects long, xx double, xz double, xy binary")
    yy = int(who.agg(F.sum((F.col("y") * F.col("y")).cast("decimal(38,0)"))).head()[0] or 0)
    out = pa.schema([("_p", pa.int32()), (feature, arrow), ("r", pa.binary())])
    return sums.groupBy("_f", "_p").applyInArrow(_adding(feature, n_people, yy, out), f"_p int, `{feature}` {kind}, r binary")


def _covariate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranks = [pa.ipc.open_stream(b.as_buffer()).read_all()["z"].to_numpy().astype(np.int32).tobytes() for b in batch.column("block")]
        yield pa.RecordBatch.from_arrays([batch.column("_j"), pa.array(ranks, pa.binary())], ["_j", "ranks"])


def _counts(vectors: DataFrame, feature: str, members: DataFrame, n: int, share: float) -> DataFrame:
    """(perm, set_name, n_top): members of sets among the first share of the features."""
    kind = vectors.schema[feature].dataType.simpleString()

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, r in zip(batch.column("_p").to_pylist(), batch.column("r"), strict=True):
                r = np.frombuffer(r.as_buffer())
                total = totals.setdefault(p, np.zeros((len(r), BINS), np.int64))
                if r[0] >= 0:
                    total[np.arange(len(r)), _bin(r)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["_p", "counts"])

    def adding(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in group["counts"]).reshape(-1, BINS)
        top = np.ceil(total.sum(axis=1) * share).astype(np.int64)  # features of the first share
        from_above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
        last = BINS - 1 - np.argmax((from_above >= np.maximum(top, 1)[:, None])[:, ::-1], axis=1)
        over = np.where(last + 1 < BINS, np.take_along_axis(from_above, np.minimum(last + 1, BINS - 1)[:, None], 1)[:, 0], 0)
        size = len(total)
        return pa.table({"_p": pa.array([group["_p"][0].as_py()] * size, pa.int32()), "k": pa.array(np.arange(size), pa.int32()), "last": pa.array(last, pa.int32()), "room": pa.array(top - over, pa.int64())})

    bounds = vectors.select("_p", "r").mapInArrow(counting, "_p int, counts binary").groupBy("_p").applyInArrow(adding, "_p int, k int, last int, room long").orderBy("_p", "k").collect()  # a row of each permutation
    if not bounds:
        return members.sparkSession.createDataFrame([], "perm long, set_name string, n_top long")
    last, room = (np.array([b[c] for b in bounds], np.int64) for c in ("last", "room"))
    side = 1 + max(b["k"] for b in bounds)

    def choosing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (p, r) in enumerate(zip(batch.column("_p").to_pylist(), batch.column("r"), strict=True)):
                r = np.frombuffer(r.as_buffer())
                perm = p * side + np.flatnonzero((r >= 0) & (_bin(np.maximum(r, 0)) >= last[p * side : p * side + len(r)]))
                mine = r[perm - p * side]
                names = batch.column(feature).take(pa.array(np.full(len(perm), at)))
                yield pa.RecordBatch.from_arrays([pa.array(perm, pa.int64()), names, pa.array(mine), pa.array(_bin(mine) > last[perm]), pa.array(room[perm])], ["perm", feature, "r", "sure", "room"])

    near = vectors.mapInArrow(choosing, f"perm long, `{feature}` {kind}, r double, sure boolean, room long")
    # ranked where only some of the bin belong to the first share; members alone matter elsewhere
    placed = near.filter("NOT sure AND room > 0").withColumn("_n", F.row_number().over(W.partitionBy("perm").orderBy(F.desc("r"), feature))).filter("_n <= room").select("perm", feature)
    chosen = near.filter("sure").select("perm", feature).unionByName(placed)
    return chosen.join(members, feature).groupBy("perm", "set_name").agg(F.count("*").alias("n_top"))
