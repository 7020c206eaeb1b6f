"""Source divergence audit: how the sources of a language differ in their terms, by exact whole numbers.

Terms are runs of ASCII letters and characters above U+007F, with only A-Z lower-cased. A language keeps the V terms that at least `least` of its documents hold. A group, (language,
source) or the language as a whole, gives each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its occurrences of kept terms, and two groups differ in a term by
f = floor((p - q)^2 / (p + q)).

Count columns are deduplicated: a term's counts over the sources are a sparse vector, terms with the same vector are one column with a
multiplicity, and every pair of sources is evaluated once for each distinct column, times its multiplicity. Only columns that have a count in either
source are visited; the others differ by one constant a pair. Terms are ranked from distinct columns too: of those that f and their smallest term put first, with their terms.

Words are cut and counted with arrays of bytes and dictionaries of a few megabytes at a time, and leave a task as sums by (language, source, term). Sums by all three
come before any by term, so that a common word or a large source is no task's own. Columns are dealt by hash to tasks of about `columns` of them, and sources to tiles of `tile`: a task has the columns of
two tiles. A row of counts has one entry a source of its language, and sources are numbered language by language; nothing else is gathered. Pairs are as many as the result has.

Defined results: null text, language and source are read as ''; a group without terms has p from counts of 0; a language that keeps no term has pairs of value 0 and no terms; ties are in order of
UTF-8; documents of any length are cut between words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of text that are cut into words at a time, and rows of sums that a task holds.
PIECE, HELD = 1 << 23, 1 << 20
SCALE = 1_000_000_000
_BYTES = np.arange(256, dtype=np.uint8)
LETTER = (_BYTES >= 0x80) | ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of texts that lie end to end in data, text k from bounds[k] to bounds[k + 1], and the text of each."""
    own = LETTER[data]
    ends = bounds[(bounds > 0) & (bounds < len(data))]
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    first[ends] = own[ends]
    last[:-1] &= ~own[1:]
    last[ends - 1] = own[ends - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[own]]))
    return terms, np.searchsorted(bounds, start, side="right") - 1


def summed(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of whole texts."""
    terms, doc = words(data, bounds)
    coded = terms.dictionary_encode()
    size = max(1, len(coded.dictionary))
    keys, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)  # a text's terms
    keys, back = np.unique(group[keys // size] * size + keys % size, return_inverse=True)
    counts = [np.bincount(back, w, len(keys)).astype(np.int64) for w in (n, None)]
    return pa.table({"group": keys // size, "term": coded.dictionary.take(pa.array(keys % size)), "n": counts[0], "docs": counts[1]})


def _long_text(data: np.ndarray, group: int) -> pa.Table:
    """As summed, of one text in pieces that end between words."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and LETTER[data[end]]:
            rest = np.flatnonzero(~LETTER[data[end : end + PIECE]])
            end = end + int(rest[0]) if len(rest) else min(len(data), end + PIECE)
        parts.append(summed(data[at:end], np.array([0, end - at]), np.array([group])))
        at = end
    both = pa.concat_tables(parts).group_by(["group", "term"]).aggregate([("n", "sum")])
    return pa.table({"group": both["group"], "term": both["term"], "n": both["n_sum"], "docs": np.ones(len(both), np.int64)})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        both = pa.concat_tables(held).combine_chunks().group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return both.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["group", "term", "n", "docs"])

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = list(groups)
        pick = lambda k: pa.array([x[k] for x in names], pa.string()).take(pc.cast(table["group"], pa.int64()).combine_chunks())
        yield from pa.table({"lang": pick(0), "source": pick(1), "term": table["term"], "n": table["n"], "docs": table["docs"]}).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        of = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        texts = batch.column(2).cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        k = 0
        while k < len(texts):
            last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + PIECE, side="right")) - 1)  # texts k to last, PIECE together or one
            piece = data[bounds[k] : bounds[last]]
            held.append(_long_text(piece, of[k]) if len(piece) > PIECE else summed(piece, bounds[k : last + 1] - bounds[k], of[k:last]))
            k = last
        if len(held) >= 64 or sum(map(len, held)) > HELD:
            held = [merged()]
            if len(held[0]) > HELD // 2:
                yield from out(held[0])
                held = []
    if held:
        yield from out(merged())


def shares(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of counts; by Python's whole numbers where 64 bits are too few."""
    if n + 2 * v + 2 < 9 * 10**9:
        return 1 + SCALE * (count + 2) // (n + 2 * v)
    return np.array([1 + SCALE * (c + 2) // (n + 2 * v) for c in count.tolist()], np.int64)


def _tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over a task's distinct columns for all pairs of two tiles' sources, above what a column without either has; chunk 0 adds that for all V."""
    sources = sorted(right.to_pylist(), key=lambda r: r["i"])
    lang, v, (a, b), chunk = sources[0]["lang"], sources[0]["v"], (sources[0]["a"], sources[0]["b"]), sources[0]["chunk"]
    place = {r["i"]: k for k, r in enumerate(sources)}
    zero = np.array([shares(np.zeros(1, np.int64), r["n"], v)[0] if v else 1 for r in sources], np.int64)
    p = np.repeat(zero[:, None], left.num_rows, axis=1)
    if left.num_rows:
        column = left["vector"].combine_chunks()
        row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        flat = column.flatten()
        i, c = flat.field("i").to_numpy(), flat.field("n").to_numpy()
        for s in np.unique(i).tolist():
            if s in place:
                p[place[s], row[i == s]] = shares(c[i == s], sources[place[s]]["n"], v)
    m = left["m"].to_numpy()
    f = lambda x, y: (x - y) * (x - y) // (x + y)
    out = []
    for k, r in enumerate(sources):
        if r["tile"] != a:
            continue
        others = [x for x, q in enumerate(sources) if q["tile"] == b and x > k]
        base = f(zero[k], zero[others])
        value = (f(p[k], p[others]) - base[:, None]) @ m + (base * v if chunk == 0 else 0)
        if not v:
            value = base * 0
        out += [x for q, w in zip(others, value.tolist(), strict=True) for x in ((r["source"], sources[q]["source"], w), (sources[q]["source"], r["source"], w))]
    return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64())))], names=["lang", "source", "item", "value"])


def _share(count: Column, n: Column, v: Column) -> Column:
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (n + v * 2).cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, least: int = 10, top: int = 10, columns: int = 4096, tile: int = 256) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the `top` terms that a source has more of than the language."""
    common.batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    names = docs.select("lang", "source").distinct().withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    names, _ = common.stored(names, "sources")
    sums = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").join(names, ["lang", "source"])
    sums = sums.groupBy("lang", "i", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("i", "n"))).alias("vector")).where(F.col("docs") >= least)
    kept, _ = common.stored(kept.select("lang", "term", "all", "vector"), "kept-terms")
    counts = kept.select("lang", F.inline("vector")).groupBy("lang", "i").agg(F.sum("n").alias("n"))
    distinct, _ = common.stored(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m"), F.min("term").alias("first"), F.first("all").alias("all")), "distinct-columns")
    whole = distinct.groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.col("all") * F.col("m")).alias("n_lang"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / columns)).alias("chunks"))
    zero = {"n": 0, "v": 0, "n_lang": 0, "chunks": 1}
    plan = names.join(counts, ["lang", "i"], "left").join(whole, "lang", "left").fillna(zero).withColumn("tiles", F.expr(f"count(1) over (partition by lang) div {tile} + 1"))
    plan, _ = common.stored(plan.withColumn("tile", F.expr(f"i div {tile}")), "audit-plan")

    # pairs: tasks are (language, chunk of columns, two tiles)
    langs = plan.groupBy("lang").agg(F.first("chunks").alias("chunks"), F.first("tiles").alias("tiles"))
    last = F.col("tiles") - 1
    tasks = plan.withColumn("chunk", F.explode(F.expr("sequence(0, cast(chunks as int) - 1)"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    tasks = tasks.select("lang", F.col("chunk").cast("long").alias("chunk"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "i", "source", "n", "v", "tile")
    met = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform("vector", lambda e: F.call_function("div", e.i, F.lit(tile)))), lambda t: F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda u: F.struct(F.least(t, u).alias("a"), F.greatest(t, u).alias("b"))))))
    dealt = distinct.join(langs, "lang").select("lang", F.pmod(F.xxhash64("vector"), F.col("chunks")).alias("chunk"), "m", "vector", F.explode(met).alias("met"))
    dealt = dealt.select("lang", "chunk", F.col("met.a").alias("a"), F.col("met.b").alias("b"), "m", F.filter("vector", lambda e: F.call_function("div", e.i, F.lit(tile)).isin(F.col("met.a"), F.col("met.b"))).alias("vector"))
    keys = ["lang", "chunk", "a", "b"]
    pairs = dealt.groupBy(*keys).cogroup(tasks.groupBy(*keys)).applyInArrow(_tile, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    of = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(of).alias("rank"))

    # terms: the first `top` columns of each group, then the first `top` of their terms
    entries = distinct.select("lang", "vector", "first", "all", F.inline("vector")).join(plan.select("lang", "i", "source", F.col("n").alias("n_source"), "v", "n_lang"), ["lang", "i"])
    entries = entries.withColumns({"p": _share(F.col("n"), F.col("n_source"), F.col("v")), "q": _share(F.col("all"), F.col("n_lang"), F.col("v"))}).where("p > q")
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    best = entries.select("lang", "source", "vector", "first", value.alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "first"))
    best, _ = common.stored(best.withColumn("place", place).where(F.col("place") <= top).drop("place", "first"), "first-columns")
    smallest = F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))
    own = kept.select("lang", "vector", "term").join(best.select("lang", "vector").distinct(), ["lang", "vector"], "left_semi").withColumn("place", smallest).where(F.col("place") <= top)
    terms = best.join(own, ["lang", "vector"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term"))).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
