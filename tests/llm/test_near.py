"""Near-duplicate operators and nearest neighbours against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import ann, common, jaccard, neardup_vectors, queries


def closed(n, links):
    """Smallest member of each node's component."""
    root = {x: x for x in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


def shingles(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in closed(ids, links).items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=3))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 6, 12, 40, 90, 400]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    for _ in range(30):  # a passage that many texts share
        out.append(" ".join([word() for _ in range(rng.choice([4, 10, 80]))] + passage + [word() for _ in range(rng.choice([0, 5]))]))
    base = [word() for _ in range(100)]
    for _ in range(45):  # more near copies than the bound of frequent shingles below
        w = list(base)
        w[rng.randrange(100)] = word()
        out.append(" ".join(w))
    out += [out[-1]] * 8 + ["", " \n\t ", None, "one", "one", "ONE", "One\x0bTwo", "x y z"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,frequent,rounds,hot", [(1, 32, 1, 2048), (2, 4, 1, 2), (3, 2, 3, 5), (4, 8, 1, 3)])
def test_jaccard_join_is_exact(spark, seed, frequent, rounds, hot):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("clash"), "t": F.lit(1), "sig": F.lit(None)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, frequent=frequent, rounds=rounds, hot=hot).collect()}
    assert got == brute(docs)


def test_a_frame_that_many_texts_share_forms_few_pairs(spark, monkeypatch):
    """A page frame with bodies that occur elsewhere too: no shingle is rare, every list is long, and nearly nothing links."""
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    frame = words(70)
    bodies = [words(30) for _ in range(600)]
    texts = [[*frame, *b] for b in bodies] + [[*words(60), *b] for b in bodies]
    texts += [[*t[:-1], "other"] for t in texts[:20]]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    longest, parted = [], jaccard._parted

    def watched(left, sets, hot):
        out = parted(left, sets, hot)
        longest.append([df.groupBy("sig").count().agg(F.max("count")).first()[0] for df in (left, out)])
        return out

    monkeypatch.setattr(jaccard, "_parted", watched)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, hot=50, frequent=1, most_bits=10).collect()}  # maps that are full
    ((before, after),) = longest
    assert got == brute(docs)
    assert before > 500 and after <= 3, longest


def test_a_long_list_is_few_tasks(spark):
    """Skew handling doesn't split the join of a long list with itself, by the square of its size: the driver keeps every task."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    frame, sets = draw(70), []
    for _ in range(200):  # of the frame's sets, two at a time link
        body = draw(30)
        sets += [np.sort(np.concatenate([frame, body])), np.sort(np.concatenate([frame, body[1:], draw(1)]))]
    rows = [(k, len(h), bytearray(h.tobytes()), jaccard.sketch(h)) for k, h in enumerate(sets)]
    lists = [(1, k, 100, 0, 100) for k in range(400)] + [(2 + k // 2, k, 100, k // 2 * 2, 100) for k in range(0, 400, 40) for k in (k, k + 1)]
    adaptive = "spark.sql.adaptive."
    own = {"spark.sql.shuffle.partitions": "24", "spark.sql.autoBroadcastJoinThreshold": "-1", f"{adaptive}coalescePartitions.enabled": "false", f"{adaptive}advisoryPartitionSizeInBytes": "1k", f"{adaptive}skewJoin.skewedPartitionThresholdInBytes": "1k", f"{adaptive}skewJoin.skewedPartitionFactor": "1.5"}
    before, context = {k: spark.conf.get(k) for k in own}, spark.sparkContext
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        context.setJobGroup("a long list", "")
        _, roots = jaccard._links(spark.createDataFrame(rows, "node long, n long, tokens binary, sketch array<long>"), spark.createDataFrame(lists, "sig long, node long, n long, a long, an long"), 1, 2048)
        got = {r["node"]: r["root"] for r in roots.collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("a long list") for s in tracker.getJobInfo(j).stageIds}
    tasks = [x.numTasks for s in stages if (x := tracker.getStageInfo(s))]
    assert got == {k: k - 1 for k in range(1, 400, 2)}
    assert len(tasks) > 10 and max(tasks) <= 100, sorted(tasks)[-5:]


def test_jaccard_nulls_and_empty(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")]
    got = sorted(map(str, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(map(str, spark.createDataFrame([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3)], "doc_id long, n_shingles long, component_id long").collect()))
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_meet():
    """Sets that link share a signature, whichever shingles are frequent."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(2, 120))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        change = int(rng.integers(0, n // 8 + 1))
        y = np.concatenate([x[change:], rng.integers(0, 1 << 63, int(rng.integers(0, change + 1)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 80 * (len(x) + len(y) - shared):
            continue
        many = rng.random(1 << 13) < rng.choice([0, 0.3, 0.9, 1])
        freq = jaccard.Frequencies(13, np.full(1 << 10, 255, np.uint8), np.packbits(many))
        if len(x) > 1 and len(y) > 1:
            assert len(np.intersect1d(jaccard.signatures(x, freq), jaccard.signatures(y, freq)))


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, small):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), small=small)[0].collect()))
    want = closed({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != v}
    assert common.components(spark.createDataFrame([], "a long, b long"), small=small)[0].count() == 0


def vectors(seed, n=400, d=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, d))
    x = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape), base[:20] * 3, np.repeat(base[:1], 50, 0), rng.standard_normal((n // 4, d))])
    rows = [(k * 3, v.astype(np.float32).tolist(), int(rng.integers(3))) for k, v in enumerate(x)]
    return rows + [(9001, None, 1), (9002, [0.0] * d, 1), (9003, [float("nan")] + [1.0] * (d - 1), 1), (9004, [None] + [1.0] * (d - 1), 1), (9005, rows[0][1], None), (9006, rows[0][1][:5], rows[0][2]), (9007, [], 1)]


def test_vector_dedup(spark):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in neardup_vectors.deduplicate(df, window=64, missed=1e-9).collect()}
    ok = [(i, np.array(v), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for k, (a, x, y) in enumerate(ok) for b, z, w in ok[k + 1 :] if y == w and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= 0.93]
    n, root = defaultdict(int), closed({r[0] for r in rows}, links)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], root[i], root[i] == i) for i in root}
    assert neardup_vectors.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_vector_dedup_large_group(spark, parts):
    """Each link counts in a group of many more near vectors than a block has, and the last rows of a label link as the first do."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((2, 16))
    x = np.concatenate([base[:1] + 0.27 * rng.standard_normal((1500, 16)), base[1:] + 0.1 * rng.standard_normal((300, 16))])
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    root = closed(range(len(x)), np.argwhere(np.triu(near)).tolist())
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = neardup_vectors.deduplicate(df, window=64, missed=1e-9).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert near.sum() > 600_000
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {k: (int(near[k].sum()), root[k]) for k in range(len(x))}


def test_nearest(spark):
    rows = vectors(2)
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=7, least=9, data_block=200, query_block=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    ok = {i: np.array(v, np.float64) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in ok if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        best = sorted(((-float(v @ ok[q]), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:7]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(ok[i] @ ok[q])) < 1e-9 for i, s in found)
        hit += len({i for _, i in best} & {i for i, _ in found})
        total += len(best)
    assert hit / total >= 0.9
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 12, int(rng.integers(1, 900)), dtype=np.uint64)) for _ in range(2))
        bits = sum(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(jaccard.sketch(x), jaccard.sketch(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))


def test_tight_labels_need_no_all_pairs(spark, monkeypatch):
    """Rows around one direction, nearly no link: keys beside the mean part them, and few rows are in doubt."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    x[:, 0] = 0
    x = np.sqrt(0.2) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] = np.sqrt(0.8)
    for k in range(0, 100, 2):
        x[k + 1] = x[k] + rng.normal(size=32) * 0.02 * (1 + k % 7)
    asked = []
    rest = neardup_vectors._rest
    monkeypatch.setattr(neardup_vectors, "_rest", lambda placed, unsafe, *more: asked.append(unsafe.count()) or rest(placed, unsafe, *more))
    got = neardup_vectors.deduplicate(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), window=64).collect()
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = z @ z.T >= 0.93
    want = closed(range(3000), [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert sum(asked) < 30
    assert {(r["vec_id"], r["n_links"]) for r in got} == {(k, int(n) - 1) for k, n in enumerate(near.sum(1))}
    assert {(r["vec_id"], r["component_id"]) for r in got} == {(k, want[k]) for k in range(3000)}


def test_nearest_as_shipped(spark):
    """Recall of the query itself against brute force, and how many rows it verifies."""
    folder = "/root/testdata/sf0.1"
    best = ann.Block.candidates
    own = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"]) and any(r["embedding"])}
    ids, x = np.array(sorted(own)), np.array([own[k] for k in sorted(own)], float)
    got = {}
    for r in queries.op10_nearest(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [k for k in range(len(ids)) if ids[k] % 20 == 0]
    hits = 0
    for k in asked:
        score = x @ x[k]
        score[k] = -np.inf
        hits += len(got[ids[k]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert len(got) == len(asked) and hits / (20 * len(asked)) >= 0.94
    block = ann.Block(ids, x, 176, 5)
    seen = [len(best(block, x[k], 0.8, max(160, int(np.ceil(0.15 * len(ids)))))) / len(ids) for k in asked]
    assert np.mean(seen) < 0.2


def test_collisions_by_cells(monkeypatch):
    """Small blocks count exactly as windows over projections do; in larger ones a query counts few rows, of a byte each, and finds what it is to."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(255, 16))
    x[40:60] = x[7]
    block = ann.Block(np.arange(255), x, 64, 5)
    p = np.concatenate([x, np.sqrt(np.maximum(0, block.longest**2 - (x * x).sum(1)))[:, None]], 1) / block.longest @ block.directions
    for q in rng.normal(size=(20, 16)):
        found = block.candidates(q, 0.8, 40)
        apart = np.abs(p - np.append(q, 0) / np.sqrt(q @ q) @ block.directions)
        assert found.tolist() == np.flatnonzero((apart <= block.width).sum(1) >= 52).tolist() and len(found) >= 40
    x = rng.normal(size=(8000, 64))
    block = ann.Block(np.arange(8000), x, 176, 5)
    assert block.cell.dtype == np.uint8 and block.cell.shape == (176, 8000)
    counted = []
    count = ann.Block.collisions
    monkeypatch.setattr(ann.Block, "collisions", lambda self, low, span, rows: counted.append(rows) or count(self, low, span, rows))
    block.candidates(x[0], 0.8, 1200)
    counted.clear()
    hits = 0
    for k in range(1, 101):
        found = block.candidates(x[k], 0.8, 1200)
        assert len(found) >= 1200
        hits += len(set(found) & set(np.argsort(-(x @ x[k]))[:20]))
    assert sum(counted) < 2.2 * 100 * 8000
    assert hits / 2000 >= 0.9
