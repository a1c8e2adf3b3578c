"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sagebrush.llm import ngram_join as nj


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(x)] = find(y)
    out = {}
    for x, (i, s) in enumerate(sets):
        out[i] = (len(s), min(sets[y][0] for y in range(len(sets)) if find(y) == find(x)))
    return out


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**9)}"
    return words


def fixture():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice(["ta", "ro", "né", "ki"]) for _ in range(rnd.randint(1, 4)))
    docs = []
    for _ in range(4):
        base = [word() for _ in range(rnd.choice([30, 90, 300]))]
        for n in range(45):
            docs.append(" ".join(edited(rnd, base, rnd.choice([0, 0, 1, 1, 2, 3, max(1, len(base) // 40)]))))
    chain = [word() for _ in range(120)]
    for _ in range(25):  # each a little further from the first
        chain = chain[2:] + [word(), word()]
        docs.append(" ".join(chain))
    passage = " ".join(word() for _ in range(25))
    docs += [f"{passage} " + " ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    docs += ["", "a", "A", "a b c d", "a b  c\td", "a b c d e", "x y", " \n", "b a"]
    return [(i * 7 % 1009, d) for i, d in enumerate(docs)]


def test_equals_all_pairs(spark):
    docs = fixture()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_groups(frame).collect()}
    want = brute(docs)
    assert got == want, {k: (got[k], want[k]) for k in want if got[k] != want[k]}


def test_deferred_members(spark, monkeypatch):
    """With a small window most members are deferred and met through the tree."""
    monkeypatch.setattr(nj.candidates, "__defaults__", (2,))
    docs = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert nj.candidates(nj._tokens(frame.select("text"), nj._sketch(frame.select("text")))).filter("chain").count() > 50
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_groups(frame).collect()}
    assert got == brute(docs)


def test_cells_dealt_over_tasks(spark, monkeypatch):
    """Cells of more than a few rows go to several tasks, and lose no link."""
    monkeypatch.setattr(nj, "CELL_ROWS", 8)
    docs = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tokens = nj._tokens(frame.select("text"), nj._sketch(frame.select("text")))
    assert tokens.groupBy("token").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0] > 3
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_groups(frame).collect()}
    assert got == brute(docs)


def test_hot_groups(spark, monkeypatch):
    """A third of the rows are near copies, another third shares a passage."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ta", "ro", "né", "ki", "lu"]) for _ in range(rnd.randint(2, 5)))
    base, passage = [word() for _ in range(80)], " ".join(word() for _ in range(30))
    docs = [" ".join(edited(rnd, base, rnd.choice([0, 1, 1, 2, 3, 4]))) for _ in range(300)]
    docs += [f"{passage} " + " ".join(word() for _ in range(rnd.randint(4, 12))) for _ in range(300)]
    docs += [" ".join(word() for _ in range(40)) for _ in range(300)]
    docs = list(enumerate(docs))
    rnd.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    for window in (nj.WINDOW, 3):
        monkeypatch.setattr(nj.candidates, "__defaults__", (window,))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_groups(frame).collect()}
        assert got == brute(docs)


def cut_and_edited(seed, count):
    """Copies of one text with edits, of many lengths; some link with nothing."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ta", "ro", "né", "ki", "lu"]) for _ in range(rnd.randint(2, 5)))
    base = [word() for _ in range(150)]
    docs = []
    for _ in range(count):
        a, b = rnd.choice([0, 0, rnd.randint(0, 15)]), rnd.choice([150, 150, rnd.randint(125, 150)])
        docs.append(" ".join(edited(rnd, base[a:b], rnd.choice([0, 1, 2, 3, 4, 5, 6, 7]))))
    return list(enumerate(docs))


def test_copies_of_many_sizes(spark, monkeypatch):
    """Members that can't have a link in their block are left out, and no link is
    lost, wherever batches end."""
    docs = cut_and_edited(5, 350)
    want = brute(docs)
    assert 1 < len({c for _, c in want.values()}) < 350
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for window, rows in ((2, 10000), (nj.WINDOW, 10000), (3, 7), (2, 61)):
        monkeypatch.setattr(nj.candidates, "__defaults__", (window,))
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_groups(frame).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert got == want, (window, rows)


def test_few_components_reach_the_tree(spark, monkeypatch):
    """Near copies of one text are joined through a central one, so that the tree has
    few components to pair; those without a link are not in it."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["ta", "ro", "né", "ki", "lu"]) for _ in range(rnd.randint(2, 5)))
    base = [word() for _ in range(150)]
    docs = [(i, " ".join(edited(rnd, base, rnd.choice([0, 1, 2, 3, 4, 5, 6])))) for i in range(600)]
    seen, real = [], nj.tree_links
    monkeypatch.setattr(nj, "tree_links", lambda points, *more: seen.append(points.agg(F.count("*"), F.countDistinct("comp")).first()) or real(points, *more))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    # 463 components of 480 members before links of pairs were used
    assert all(members < 350 and components < 120 for members, components in seen), seen


def test_first_common_bounds():
    """What the rank of the rarest common shingle tells, against the threshold itself."""
    for larger in range(1, 40):
        for smaller in range(1, larger + 1):
            most = [c for c in range(1, smaller + 1) if 100 * c >= 80 * (larger + smaller - c)]
            for a in range(larger):
                for b in range(smaller):
                    if most and most[0] <= min(larger - a, smaller - b):
                        assert nj._first_common(smaller, b) and smaller <= nj._reach(larger, a)


def test_bitmap_takes_few_jobs(spark):
    """Not one for each partition."""
    context, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup("bitmap", "")
        bits = nj._bitmap(spark.range(5000).select(F.xxhash64("id").alias("k")), "k")
        jobs = context.statusTracker().getJobIdsForGroup("bitmap")
        keys = np.array([r["k"] for r in spark.range(5000).select(F.xxhash64("id").alias("k")).collect()], np.int64)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert nj._flagged(bits, keys).all() and int(np.unpackbits(bits).sum()) <= 5000
    assert len(jobs) <= 8


def test_sketch_in_one_step_or_two(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").repartition(5)
    assert (nj._sketch(docs) == nj._sketch(docs, salts=2)).all() and nj._sketch(docs).sum() > 0


def test_packed_sets_keep_all_bits():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 700, 3)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    points, rests = nj.packed(np.concatenate(sets), at)
    for k, x in enumerate(sets):
        assert (nj.unpacked(np.frombuffer(points[k].as_py(), np.uint16), rests[k].as_py()) == x).all()


def test_string_ids_and_clashing_columns(spark):
    same = "one two three four five six seven"
    rows = [("b", same, 1, 2), ("a", same, 1, 2), ("c", "other", 1, 2), (None, same, 1, 2), ("d", None, 1, 2)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, cls int, comp int")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.similar_groups(frame).collect()}
    assert got == {("b", 3, "a"), ("a", 3, "a"), ("c", 1, "c"), (None, 3, "a"), ("d", 0, "d")}


def test_edge_cases(spark):
    same = "one two three four five six seven"
    rows = [(None, same), (5, same), (5, same), (5, "other text"), (9, None), (None, None), (None, "alone " * 9), (3, same + " ")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 3, 3), (5, 3, 3), (5, 3, 3), (5, 1, 5), (9, 0, 9), (None, 0, None), (None, 1, None), (3, 3, 3)], key=str)
    assert nj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_tree_joins_what_links_join(spark, monkeypatch):
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(1 << 64, size=n, dtype=np.uint64)
    base = fresh(150)
    sets = [np.unique(np.concatenate((base[rng.random(150) > p], fresh(int(150 * p))))) for p in rng.random(120) * 0.3]
    rows = []
    for i, x in enumerate(sets):
        point, rest = nj.packed(x, np.array([0, len(x)]))
        point = np.frombuffer(point[0].as_py(), np.uint16).astype(np.uint16 if i % 2 else np.uint32)
        rows.append((i, len(x), bytearray(point.tobytes()), bytearray(rest[0].as_py()), i, i % 2, i % 2))
    frame = spark.createDataFrame(rows, "cls long, n long, point binary, rest binary, comp long, block long, main long").repartition(3)

    def reached(edges):
        label = list(range(120))
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    linked = [(a, b) for b in range(120) for a in range(b % 2, b, 2) if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))]
    assert 10 < len(set(reached(linked))) < 110
    assert reached([(r["a"], r["b"]) for r in nj.tree_links(frame).collect()]) == reached(linked)
    assert reached([(r["a"], r["b"]) for r in nj.tree_links(frame, leaf=4, fan=2).collect()]) == reached(linked)
    met, real = [], nj._let_through  # every pair of nodes is met once, though blocks share runs of leaves
    monkeypatch.setattr(nj, "_let_through", lambda pairs: met.append(pairs.select("node1", "node2").collect()) or real(pairs))
    small = frame.withColumn("block", F.col("cls") % 11).withColumn("main", F.lit(-1).cast("long"))
    nj.tree_links(small, leaf=2, fan=4).collect()
    assert len(met) == 2 and all(len(pairs) == len({frozenset(p) for p in pairs}) > 11 for pairs in met)


def test_tree_prunes(spark):
    """Groups of points that differ in their counts are not compared."""
    rows = []
    for i in range(64):
        point = np.zeros(nj.GROUPS, np.uint16)
        point[(i // 32) * 128 : (i // 32) * 128 + 100] = 1
        rest = np.zeros((100, 7), np.uint8)
        rest[:, 0] = i
        rows.append((i, 100, bytearray(point.tobytes()), bytearray(rest.tobytes()), i, 0, 0))
    frame = spark.createDataFrame(rows, "cls long, n long, point binary, rest binary, comp long, block long, main long").coalesce(1)
    order = ("block", "comp", "n", "cls")
    leaves = frame.sortWithinPartitions(*order).select("block", "comp", "main", "n", "point", "rest").mapInArrow(nj._leaves(nj.LEAF, nj.FAN), nj._LEAF_SCHEMA)
    side = lambda k: leaves.select(*[F.col(c).alias(f"{c}{k}") for c in ("node", "alone", "lo", "hi", "top")])
    pairs = side("1").crossJoin(side("2")).filter("node1 <= node2")
    assert pairs.count() == 3 and nj._let_through(pairs).count() == 2
    assert nj.tree_links(frame).count() == 0


def test_components_of_paths_and_stars(spark):
    from sagebrush.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (500, 500)]
    for parts in (1, 13):
        got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
        assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_full_sketch_deals_no_small_cells(spark):
    """A sketch whose slots are all over the bound: cells are dealt by exact counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    full = np.full(1 << 20, 1 << 20, np.uint32)
    assert {r["part"] for r in nj._tokens(docs, full).select("part").distinct().collect()} == {0}
    few = nj._tokens(docs, full, cell_rows=10)
    sizes = {r["token"]: (r["k"], r["parts"]) for r in few.groupBy("token").agg(F.count("*").alias("k"), F.max("part").alias("parts")).collect()}
    assert any(p for _, p in sizes.values()) and all((p > 0) == (k > 10) for k, p in sizes.values())


def test_sizes_follow_counts():
    assert [nj._bits(n >> 8, nj.SKETCH_BITS) for n in (0, 1 << 27, 1 << 30, 1 << 50)] == [20, 20, 23, 24]
