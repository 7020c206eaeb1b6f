"""Operators on whole tables (divergence, manifest, mixing) against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import divergence, merkle, mixing

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, tree int, w double"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def odd(spark):
    """Null columns, empty and long texts, ties, repeated rows, a null id with most rows, and columns with the operators' own names."""
    rng = random.Random(4)
    words = ["Ab", "é", "ÉA", "zz", "the", "x1y", "a_b", "İ", "q" * 300]
    rows = [(None, None, None, None, None)] * 40 + [(1, "Ab ab", "xx", "s", 3), (1, "Ab ab", "xx", "s", 3), (1, "ab Ab", "xx", "s", 3), (2, "É A", None, "s", 3), (3, "", "", "", 0), (4, "word " * 30000, "xx", "big", 150000)]
    rows += [(k, " ".join(rng.choices(words, k=rng.randrange(12))), f"l{k % 11}", rng.choice(["hot", "hot", "a", "b", None]), k) for k in range(5, 200)]
    return spark.createDataFrame([(*r, "clash", 7, 0.5) for r in rows], SCHEMA)


# ---- divergence


def plain_audit(rows, least=10, top=10):
    counts, docs, groups, out = defaultdict(Counter), defaultdict(Counter), defaultdict(set), []
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        own = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(r["text"] or ""))
        groups[lang].add(source)
        counts[lang, source].update(own)
        docs[lang].update(set(own))
    differ = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        terms = [t for t, d in docs[lang].items() if d >= least]

        def shares(count, terms=terms):
            n = sum(count[t] for t in terms)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(terms)) for t in terms}

        of = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(differ(of[s][t], of[x][t]) for t in terms), x.encode(), x) for x in sources if x != s)
            best = sorted((-differ(of[s][t], whole[t]), t.encode(), t) for t in terms if counts[lang, s][t] and of[s][t] > whole[t])[:top]
            out += [(lang, s, part, x[2], -x[0], k) for part, found in (("pair", pairs), ("term", best)) for k, x in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("more", [{}, {"columns": 40, "tile": 3}])
def test_divergence_is_the_plain_audit(spark, more):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(map(tuple, divergence.audit(docs, **more).collect())) == plain_audit(docs.collect())


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_divergence_of_odd_rows(odd, least):
    assert sorted(map(tuple, divergence.audit(odd, least, top=2, tile=2).collect())) == plain_audit(odd.collect(), least, 2)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_divergence_cuts_long_texts_between_words(monkeypatch):
    import numpy as np

    text = (" ".join(random.Random(2).choices(["Ab", "cde", "é", "x"], k=500)) + "Q" * 90).encode()
    data = np.frombuffer(text, np.uint8)
    whole = divergence.summed(data, np.array([0, len(data)]), np.array([3])).sort_by("term").to_pydict()
    monkeypatch.setattr(divergence, "PIECE", 37)
    cut = divergence._long_text(data, 3).sort_by("term").to_pydict()
    assert whole == cut and set(cut["docs"]) == {1} and whole["term"] == sorted(set(whole["term"]))


def test_shares_beyond_64_bits():
    import numpy as np

    count = np.array([0, 7, 6 * 10**12])
    assert divergence.shares(count, 10**13, 10**6).tolist() == [1 + 10**9 * (c + 2) // (10**13 + 2 * 10**6) for c in count.tolist()]


# ---- manifest


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))


def plain_manifest(rows):
    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
    trees = [tree([plain_leaf(r, r["text"]) for r in by[x]]) for x in langs]
    top, out = tree([t[-1][0] for t in trees]), []
    for at, x in enumerate(langs):
        for k, r in enumerate(by[x]):
            tampered = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            value, beside = plain_leaf(r, lower(r["text"]) if tampered else r["text"]), []
            for levels, i in ((trees[at], k), (top, at)):
                for level in levels[:-1]:
                    run = level[i // 8 * 8 : i // 8 * 8 + 8]
                    before, after = run[: i % 8], run[i % 8 + 1 :]
                    beside += before + after
                    value, i = digest([*before, value, *after]), i // 8
            out.append((r["doc_id"], trees[at][0][k], trees[at][-1][0], top[-1][0], digest(beside), value, value == top[-1][0]))
    return sorted(out, key=str)


def manifest(df, rows):
    return merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"text": merkle.lowered("text")}, merkle.third("doc_id"), rows)


@pytest.mark.parametrize("rows", [1 << 15, 7])
def test_manifest_is_the_plain_one(spark, odd, rows):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd):
        got = manifest(df, rows).collect()
        assert sorted(map(tuple, got), key=str) == plain_manifest(df.collect())
        assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark, odd):
    assert manifest(odd.limit(0), 5).count() == 0
    one = odd.where("doc_id = 7")
    assert [tuple(r) for r in manifest(one, 5).collect()] == plain_manifest(one.collect())
    untouched = merkle.manifest(odd, ["doc_id", "text"], "doc_id", "lang").collect()
    assert len(untouched) == odd.count() and all(r["verified"] for r in untouched)


def test_forests_unite_in_any_order():
    rng = random.Random(8)
    sizes = {0: 700, 1: 1, 2: 65}
    leaves = {(t, 0, k): merkle.joined([f"{t} {k}".encode()]) for t, n in sizes.items() for k in range(n)}
    want = merkle.unite(leaves, sizes, 3)[0]
    assert set(want) == {(merkle.TOP, 1, 0)}
    for _ in range(5):
        parts = defaultdict(dict)
        for k, v in leaves.items():
            parts[rng.randrange(6)][k] = v
        forests = list(parts.values())
        while len(forests) > 1:
            rng.shuffle(forests)
            forests.append(merkle.unite(forests.pop() | forests.pop(), sizes, 3)[0])
        assert merkle.unite(forests[0], sizes, 3)[0] == want
    # a consecutive part leaves few open nodes
    part = {k: v for k, v in leaves.items() if k[0] == 0 and 100 <= k[2] < 600}
    assert len(merkle.unite(part, sizes, 3)[0]) <= 2 * 7 * 4


# ---- mixing


def plain_targets(totals, weights, most=3):
    """Gives what is above a limit to the others, again and again."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole, full = sum(totals.values()), set()
    while True:
        left, over = whole - sum(most * totals[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: most * totals[s] if s in full else left * weight[s] / over for s in names}
        new = {s for s in names if target[s] > most * totals[s] + 1e-9}
        if not new:
            return target
        full |= new


def plain_seats(weights, seats):
    """Highest quotients, one seat at a time."""
    heap = [(-w, k, 1) for k, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    out = [0] * len(weights)
    for _ in range(seats if heap else 0):
        _, k, n = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * n + 1), k, n + 1))
    return out


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 40):
        for seats in (0, 1, 5, 1000):
            weights = [rng.choice([0.0, 1.0, 2.0, rng.random() * 1000]) for _ in range(n - 1)] + [5000.0]
            df = spark.createDataFrame([(k, w, seats) for k, w in enumerate(weights)], "k int, w double, seats long").coalesce(1)
            got = {r["k"]: r["quota"] for r in mixing.apportion(df, [], "w", "seats", ["k"]).collect()}
            assert [got[k] for k in range(n)] == plain_seats(weights, seats)


def check_mix(rows, got, most=3):
    totals, taken = defaultdict(int), defaultdict(int)
    for r in got:
        totals[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= most * r["size"]
    target = plain_targets(totals, (1, 2, 3), most)
    assert sorted((str(r["doc_id"]), str(r["source"]), len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))) for r in rows) == sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got)
    for r in got:
        assert r["source_size"] == totals[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t + 3, (s, taken[s], t)


@pytest.mark.parametrize("more", [{}, {"shard_words": 3000, "shard_rows": 4, "run": 8}])
def test_mixing_meets_targets(spark, odd, more):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd):
        got = mixing.mix(df, **more).collect()
        check_mix(df.collect(), got)
        again = mixing.mix(df.repartition(3), **more).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_takes_whole_quotas_of_blocks(spark):
    """Each shard's words, laid out in the drawn order, block by block."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.mix(docs, shard_words=2000).withColumn("draw", F.xxhash64(F.lit("mix"), F.lit("order"), "doc_id", "size", F.lit(0).cast("long"))).withColumn("phase", F.xxhash64(F.lit("mix"), F.lit("phase"), "source", "shard")).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r["source"], r["shard"]].append(r)
    own = defaultdict(list)
    for (source, k), rows in sorted(shards.items()):
        rows.sort(key=lambda r: (r["draw"], r["doc_id"]))
        held, size, quota = rows[0]["shard_size"], rows[0]["block"], rows[0]["shard_blocks"]
        own[source].append((k, held, quota))
        blocks = max(1, -(-held // size))
        phase = rows[0]["phase"] % blocks
        times = [((b + 1) * quota + phase) // blocks - (b * quota + phase) // blocks for b in range(blocks)]
        assert sum(times) == quota and max(times) <= 3
        at = 0
        for r in rows:
            assert r["taken"] == sum(times[x // size] for x in range(at, at + r["size"]))
            at += r["size"]
    for shares in own.values():
        seats = plain_seats([h for _, h, _ in shares], sum(q for _, _, q in shares))
        assert seats == [q for _, _, q in shares] or any(q == 3 * -(-h // got[0]["block"]) for _, h, q in shares)


def test_mixing_of_empty_tables_and_own_weights(spark, odd):
    assert mixing.mix(odd.limit(0)).count() == 0
    empty = odd.where("doc_id = 3")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(empty).collect()] == [(0, 0.0, 0)]
    weights = spark.createDataFrame([("hot", 3.0), ("a", 1.0)], "source string, weight double")
    got = mixing.mix(odd.where("source in ('hot', 'a', 'b')"), weights).collect()
    assert all(r["taken"] == 0 for r in got if r["source"] == "b") and sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), rel=0.01)


def test_mixing_runs_no_python(spark):
    plan = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
