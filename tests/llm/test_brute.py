"""Learned operators against plain forms of their formulas, base scans against plain scans, and edges of all text operators."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, common, jaccard, langid, licenses, quality, secretscan, warc

SMALL = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def bucket(codes, bits):
    """The bucket of one n-gram of 16-bit codes."""
    key = 0
    for c in codes:
        key = key << 16 | c
    key ^= key >> 29
    key = key * ((0x9E3779B97F4A7C15 + 2 * len(codes)) & MASK) & MASK
    key ^= key >> 32
    return (key * 0xD6E8FEB86659FD93 & MASK) >> (64 - bits)


def language_grams(text):
    codes = [ord(c) if ord(c) < 1 << 16 and c.isalpha() else 0xF8FF if ord(c) >= 1 << 16 and c.isalpha() else 32 for c in text.lower()]
    kept = [c for k, c in enumerate(codes) if c != 32 or k and codes[k - 1] != 32]
    return {bucket(kept[k : k + n], langid.BITS) for n in langid.ORDERS for k in range(len(kept) - n + 1)} if any(c != 32 for c in codes) else set()


def test_language_is_kernel_regression(spark):
    """Kernel values pair by pair, the Nystroem map and the ridge solution, all plainly."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(60)
    model = langid.fit(docs, per_lang=400, landmarks=16, ridge=1e-2)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 30))
    rows = sorted(docs.select("lang", draw.alias("d"), F.col("doc_id").cast("string").alias("i"), "text").collect(), key=lambda r: (r["lang"], r["d"], r["i"]))
    langs = sorted({r["lang"] for r in rows})
    by = {k: [g for r in rows if r["lang"] == k and (g := language_grams(r["text"] or ""))] for k in langs}
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    each = max(4, 16 // len(langs))
    marks = [g for k in langs for g in by[k][:each]]
    own = [(g, k) for k in langs for g in by[k]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([[kernel(g, m) for m in marks] for g, _ in own]) @ root
    weight = np.array([len(own) / (len(langs) * len(by[k])) for _, k in own])[:, None]
    target = np.array([[1.0 if k == x else -1.0 for x in langs] for _, k in own])
    solved = np.linalg.solve(phi.T @ (weight * phi) + 1e-2 * len(own) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ (weight * target))
    texts = [r["text"] for r in rows][:40] + ["und dann der", "the", "𝒜 x"]
    names, _, margin = langid.predict(texts, model)
    for t, name, m in zip(texts, names, margin, strict=True):
        f = np.array([kernel(language_grams(t), x) for x in marks]) @ root @ solved
        assert m == pytest.approx(f.max(), abs=2e-3) and (name == langs[int(f.argmax())] or np.sort(f)[-1] - np.sort(f)[-2] < 4e-3)


def test_language_ties_and_windows(monkeypatch):
    model = langid.LanguageModel(["aa", "bb"], np.ones((1 << langid.BITS, 2), np.float32))
    assert langid.predict(["abc"], model)[0] == ["aa"]
    text = "wörter und noch mehr wörter " * 50
    whole = langid.presence(text)
    monkeypatch.setattr(langid.grams.windows, "__defaults__", (len("wörter und noch ") * 7 - 3,))
    # a window border can only add what a border adds: nothing but grams that begin with the space before a word
    assert not (whole & ~langid.presence(text)).any()


def plain_counts(text):
    """Counts of buckets, one feature at a time."""
    out = [0] * (1 << quality.BITS)
    short = [32 if c in " \t\n\r\x0b\x0c" else min(ord(c), 0xFFFF) for c in text]
    for n in quality.ORDERS:
        for k in range(len(short) - n + 1):
            out[bucket(short[k : k + n], quality.BITS)] += 1
    words = [sum((ord(c) + 1) * pow(0x5851F42D4C957F2D, k, 1 << 64) for k, c in enumerate(w)) & MASK for w in re.split("[ \t\n\r\x0b\x0c]+", text) if w]
    mixed = [mix(w) for w in words]
    for w in mixed:
        out[w >> (64 - quality.BITS)] += 1
    for a, b, x, y in zip(words, words[1:], mixed, mixed[1:], strict=False):
        out[(1 << 63 if a == b else mix((x * 3 + y) & MASK)) >> (64 - quality.BITS)] += 1
    return out


def test_quality_scores_are_the_softmax_of_means():
    rng = np.random.default_rng(2)
    model = quality.QualityModel(rng.standard_normal((1 << quality.BITS, 2)).astype(np.float32) * 20, np.array([0.3, -0.2]))
    texts = ["", "a", "one two two three\nfour", "é𝄞 x  y", "word " * 30, " ".join(random.Random(3).choices(["ab", "cde", "f", "ghij"], k=80))]
    for t, p in zip(texts, quality.probabilities(texts, model), strict=True):
        c = plain_counts(t)
        n = max(1, sum(c))
        z = [sum(v * float(model.weights[k, s]) for k, v in enumerate(c) if v) / n + model.bias[s] for s in (0, 1)]
        assert p == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-4)


def test_quality_training_is_plain_descent(spark):
    """The same steps one component at a time."""
    data = [(1, "good words here", 1), (2, "bad bad bad", 0), (3, "fine text it is", 1), (4, "spam spam", 0)]
    model = quality.fit(spark.createDataFrame(data, "doc_id long, text string, quality int"), size=3, epochs=2, rate=0.5, seed=1)
    rng = np.random.default_rng(1)
    vectors = rng.uniform(-1 / 3, 1 / 3, (1 << quality.BITS, 3)).astype(np.float32).astype(float)
    layer, bias = rng.uniform(-0.5, 0.5, (3, 2)).astype(np.float32).astype(float), [0.0, 0.0]
    done = 0
    for _ in range(2):
        for at in rng.permutation(len(data)):
            _, text, y = data[at]
            c = {k: v for k, v in enumerate(plain_counts(text)) if v}
            total = sum(c.values())
            step = 0.5 * (1 - done / 8)
            done += 1
            h = [sum(v / total * vectors[k][j] for k, v in c.items()) for j in range(3)]
            z = [sum(h[j] * layer[j][s] for j in range(3)) + bias[s] for s in (0, 1)]
            e = [np.exp(x - max(z)) for x in z]
            p = [x / sum(e) for x in e]
            p[y] -= 1
            back = [sum(layer[j][s] * p[s] for s in (0, 1)) for j in range(3)]
            for k, v in c.items():
                for j in range(3):
                    vectors[k][j] -= step * len(c) ** 0.5 * v / total * back[j]
            for j in range(3):
                for s in (0, 1):
                    layer[j][s] -= step * 0.1 * h[j] * p[s]
            bias = [b - step * 0.02 * x for b, x in zip(bias, p, strict=True)]
    used = sorted({k for _, t, _ in data for k, v in enumerate(plain_counts(t)) if v})
    assert np.allclose(model.weights[used], (vectors @ layer)[used], atol=1e-4) and np.allclose(model.bias, bias, atol=1e-5)


def test_licence_base_against_a_plain_scan(spark):
    """The base columns of every row of a table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for r in licenses.scan(docs).collect():
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_very_long_texts(spark, monkeypatch):
    """Texts of several windows, pieces or segments have the results of the whole."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(3000)]
    text = " ".join(rng.choices(words, k=20000))
    assert (jaccard.shingles(text) == jaccard.shingles(text, piece=1000)).all()
    one = licenses.scan_text(text + " all rights reserved " + text)
    assert (one["n_words"], one["n_base"], one["first_word"]) == (40003, 1, 20000)
    monkeypatch.setattr(quality.grams.windows, "__defaults__", (10**9,))
    whole = quality.counts(text)
    monkeypatch.setattr(quality.grams.windows, "__defaults__", (5000,))
    cut = quality.counts(text)
    # a border can only touch the features that lie across it
    assert np.abs(whole - cut).sum() < 0.01 * whole.sum()
    pages = spark.createDataFrame([(1, "u", text * 30), (2, "v", text * 30)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read(spark, warc.write(pages, f"{common.shared_dir(spark)}/long-pages")).collect()}
    assert got[1]["payload_bytes"] == len((text * 30).encode()) and got[2]["refers_to"] == 1


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    none = docs.limit(0)
    model = langid.fit(docs, per_lang=10, landmarks=8)
    assert langid.identify(none, model).count() == 0
    assert licenses.scan(none).count() == 0 and secretscan.scan(none).count() == 0 and secretscan.masked(none).count() == 0
    assert quality.score(none, quality.QualityModel(np.zeros((1 << quality.BITS, 2), np.float32), np.zeros(2))).count() == 0
    assert bpe.round_trip(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, SMALL)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns), name


def test_columns_of_any_name_stay(spark):
    names = ["__assign", "__hex", "__t", "__lang", "__lic", "__bpe", "row", "told", "t", "run", "named", "more"]
    df = spark.createDataFrame([(1, "token = abcdefgh", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    model = langid.LanguageModel(["aa"], np.ones((1 << langid.BITS, 1), np.float32))
    for got in (secretscan.scan(df), secretscan.masked(df), langid.identify(df, model), licenses.scan(df), bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        r = got.first()
        assert [r[n] for n in names] == list(range(len(names))) and r["doc_id"] == 1


def test_rows_that_share_an_id(spark):
    """One stays, the same whatever the plan; n_chars follows changed texts alone."""
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, "b text of its own", "en", "s", 17), (1, "a text of its own", "en", "s", 17), (1, None, "en", "s", 0), (2, "[secret] from the start", "en", "s", 7), (3, "password = hunter22", "en", "s", 19)]
    df = spark.createDataFrame(rows, schema)
    for parts in (1, 3):
        got = corpus_pipeline.near_copies(spark, df.repartition(parts), SMALL).collect()
        assert sorted((r["doc_id"], str(r["text"])) for r in got) == [(1, "None"), (2, "[secret] from the start"), (3, "password = hunter22")]
    told = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.secrets(spark, df.where("doc_id > 1"), SMALL).collect()}
    assert told == {2: ("[secret] from the start", 7), 3: ("[secret]", 8)}


def test_few_bits_give_the_same_components(spark):
    from .test_near import brute, corpus

    docs = corpus(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), most_bits=16, frequent=2).collect()}
    assert got == brute(docs)
