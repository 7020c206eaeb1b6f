"""Secret scans in DataFrame functions alone: fixed patterns, and sliding-window entropy of candidate strings.

Base kinds, leftmost and non-overlapping each: `assign` (a key word, an operator, a value of 6 characters or
more), `access` (AKIA and 16 characters or more), `hex` (24 hexadecimal digits or more). Matches that fail a length drop
after matching, so they still use up their characters.

Added kinds: candidates are maximal runs of 20 characters or more of [A-Za-z0-9+/_=-], in pieces of 83 characters that overlap by 19, so that each window lies in one; a run of up to 83 is one piece. A window of 20 characters slides over
each piece; the sum of c * log2(c) over the counts of its characters is kept up to date from the one character that leaves and
the one that enters, and gives the window's Shannon entropy. The highest one decides by the piece's character class:
`entropy_hex` (hexadecimal digits, letters of one case and digits both present), `entropy_base64` (upper case, lower case and a digit),
`entropy_lower` and `entropy_upper` (letters of one case, and digits, `=` allowed: base36 keys, base32 seeds).
Neighbouring pieces of one kind that score are one span, which ends with the run at the latest: one rule for runs of any length.
An allow-list suppresses added spans: UUIDs, and what follows a digest's, commit's or URL's name, whole; alphabets in order, eight
equal characters and EXAMPLE keys (40 characters on either side of the word) only where they stand: the run is cut there, and each part of 20 characters or more is scored as a run.
Added spans that lie within a base span are dropped.

Defined results: null and empty texts have no spans. Offsets are in code points, ends exclusive. Spans are in order of start, then
kind as listed here. Whole texts are scanned; spans of a text are built in blocks, so that many of them
cost time in proportion. One projection of the input, without shuffle: order, repeated rows and skew don't matter. Other columns
are kept; a column that has the name of an output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run from its first AKIA, and a whole run of digits: the same as matching any length and dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW, BLOCK = 20, 64
#: Least entropy of the best window, bits a character.
LEAST = {"entropy_hex": 3.01, "entropy_base64": 3.81, "entropy_lower": 3.65, "entropy_upper": 3.65}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Allow-list: runs that aren't scored; where runs are cut; what stands right before.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOWED_PART = r"(?i).{0,40}example.{0,40}|abcdefgh|01234567|(.)\1{7,255}"
ALLOWED_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|blake2b?|checksum|digest|integrity|commit|etag|uuid|https?://[^\s]*)[\s:=\"'(\[#@-]*$"


def _starts(lengths: Column) -> Column:
    """Sums of the lengths before each, in blocks of 256."""
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")
    run = lambda a: F.aggregate(a, F.struct(zero.alias("t"), none.alias("s")), lambda x, v: F.struct((x.t + v).alias("t"), F.concat(x.s, F.array(x.t)).alias("s")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda b: run(F.slice(lengths, b * 256 + 1, F.lit(256))))
    offsets = lambda b: F.aggregate(b, F.struct(zero.alias("t"), none.alias("s")), lambda x, v: F.struct((x.t + v.t).alias("t"), F.concat(x.s, F.array(x.t)).alias("s"))).s
    return F.flatten(F.zip_with(blocks, offsets(blocks), lambda x, o: F.transform(x.s, lambda v: v + o)))


SPAN = "array<struct<start:bigint,rank:int,end:bigint,found:string,before:string>>"


def _found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the pattern, with what they hold and the 40 characters before; group: the one that has `least` characters."""

    def spans(x: Column) -> Column:
        # start of match k: all before it, parts 0 to k and matches 0 to k - 1
        sizes = F.zip_with(x.parts, x.whole, lambda p, m: F.char_length(p).cast("bigint") + F.coalesce(F.char_length(m), F.lit(0)).cast("bigint"))
        made = F.zip_with(
            F.arrays_zip(_starts(sizes).alias("at"), x.parts.alias("p")), F.arrays_zip(x.whole.alias("m"), x.kept.alias("g")),
            lambda a, b: F.when(b.m.isNotNull() & (F.char_length(b.g) >= least), F.struct((a.at + F.char_length(a.p)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (a.at + F.char_length(a.p) + F.char_length(b.m)).alias("end"), b.m.alias("found"), F.right(a.p, F.lit(40)).alias("before"))),
        )
        return F.filter(made, lambda s: s.isNotNull()).cast(SPAN)

    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    cut = F.struct(F.split(text, pattern, -1).alias("parts"), every(0).alias("whole"))
    with_group = (lambda x: _bound(F.struct(x.parts.alias("parts"), x.whole.alias("whole"), (every(group) if group else x.whole).alias("kept")), spans))
    return F.when(text.rlike(pattern), _bound(cut, with_group)).otherwise(F.array().cast(SPAN))


def best_entropy(run: Column) -> Column:
    """The highest Shannon entropy of any window of 20 characters of a run of ALPHABET, bits a character."""
    weigh = F.array(*[F.lit(0.0)] + [F.lit(c * math.log2(c)) for c in range(1, WINDOW + 2)])
    none = F.array_repeat(F.lit(0), len(ALPHABET))
    count = lambda a, k: F.element_at(a, k)
    bump = lambda a, k, by: F.concat(F.slice(a, F.lit(1), k - 1), F.array(count(a, k) + by), F.slice(a, k + 1, F.lit(len(ALPHABET))))
    changed = lambda a, k, by: F.element_at(weigh, count(a, k) + by + 1) - F.element_at(weigh, count(a, k) + 1)
    start = lambda: F.struct(none.alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("low"), F.array().cast("array<int>").alias("q"))

    def enter(x: Column, k: Column) -> Column:
        return F.struct(bump(x.n, k, 1).alias("n"), (x.s + changed(x.n, k, 1)).alias("s"), x.low.alias("low"), F.concat(x.q, F.array(k)).alias("q"))

    def leave(x: Column) -> Column:
        full, old = F.size(x.q) > WINDOW, F.element_at(x.q, 1)
        return F.when(full, F.struct(bump(x.n, old, -1).alias("n"), (x.s + changed(x.n, old, -1)).alias("s"), x.low.alias("low"), F.slice(x.q, F.lit(2), F.lit(WINDOW)).alias("q"))).otherwise(x)

    first = WINDOW * math.log2(WINDOW)
    low = lambda x: F.struct(x.n.alias("n"), x.s.alias("s"), F.when(F.size(x.q) == WINDOW, F.least(x.low, x.s - first)).otherwise(x.low).alias("low"), x.q.alias("q"))
    step = lambda x, k: _bound(_bound(enter(x, k), leave), low)
    # Blocks overlap by a window less one: each window lies in one block.
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(run) - WINDOW, F.lit(0)) / BLOCK).cast("int")), lambda b: F.substring(run, b * BLOCK + 1, F.lit(BLOCK + WINDOW - 1)))
    keys = lambda piece: F.transform(F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    lowest = F.transform(pieces, lambda p: F.aggregate(keys(p), start(), step, lambda x: x.low))
    return -F.array_min(lowest) / WINDOW


def _kind_of(run: Column) -> Column:
    """The character class of a run, as an index into KINDS; null if it is no candidate."""
    digit, letter = run.rlike("[0-9]"), run.rlike("[A-Za-z]")
    return (
        F.when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & letter, F.lit(3))
        .when(digit & run.rlike("[a-z]") & run.rlike("[A-Z]"), F.lit(4))
        .when(digit & run.rlike("^[a-z0-9=]+$") & letter, F.lit(5))
        .when(digit & run.rlike("^[A-Z0-9=]+$") & letter, F.lit(6))
    )


def _scores(run: Column, rank: Column) -> Column:
    """Whether the best window of a run has the least entropy of its kind."""
    least = F.element_at(F.array(*(F.lit(LEAST.get(k, 99.0)) for k in KINDS)), rank + 1)
    return best_entropy(run) >= least


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, wherever f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _stretches(r: Column) -> Column:
    """Spans of a run, piece by piece, between the parts that the allow-list has."""
    size = BLOCK + WINDOW - 1
    alone = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), r.found.alias("p")))

    def cut() -> Column:
        parts, gone = F.split(r.found, ALLOWED_PART, -1), F.regexp_extract_all(r.found, F.lit(ALLOWED_PART), F.lit(0))
        sizes = F.zip_with(parts, gone, lambda p, m: F.char_length(p).cast("bigint") + F.coalesce(F.char_length(m), F.lit(0)).cast("bigint"))
        return F.filter(F.arrays_zip(_starts(sizes).alias("at"), parts.alias("p")), lambda x: F.char_length(x.p) >= WINDOW)

    own = F.when(r.found.rlike(ALLOWED_PART), cut()).otherwise(alone)
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(x.p) - WINDOW) / BLOCK).cast("int")), lambda b: F.substring(x.p, b * BLOCK + 1, F.lit(size)))
    rank = lambda piece: _bound(_kind_of(piece), lambda k: F.when(k.isNotNull() & _scores(piece, k), k).otherwise(F.lit(-1)))
    scored = F.transform(own, lambda x: F.struct(x.at.alias("at"), F.char_length(x.p).alias("n"), F.transform(pieces(x), rank).alias("h")))

    def spans(x: Column) -> Column:
        h = lambda k: F.coalesce(F.get(x.h, k), F.lit(-1))
        every = F.sequence(F.lit(0), F.size(x.h) - 1)
        first = F.filter(every, lambda k: (h(k) >= 0) & ((k == 0) | (h(k) != h(k - 1))))
        last = F.filter(every, lambda k: (h(k) >= 0) & ((k == F.size(x.h) - 1) | (h(k) != h(k + 1))))
        at = lambda k: r.start + x.at + k.cast("bigint") * BLOCK
        return F.zip_with(first, last, lambda a, b: F.struct(at(a).alias("start"), h(a).alias("rank"), F.least(at(b) + size, r.start + x.at + x.n).alias("end")))

    return F.flatten(F.transform(scored, spans))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base (spans of the base kinds) and found (all spans): arrays of (start, rank, end, kind)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("base", "found")]
    out = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), t.alias("t"))
    t = F.col("t")
    out = out.select("row", _found(t, ASSIGN, "assign", 2, 6).alias("assign"), _found(t, ACCESS, "access").alias("access"), _found(t, HEX, "hex").alias("hex"), _found(t, RUN, "entropy_hex").alias("run"))
    out = out.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    within = lambda r: F.exists("base", lambda b: (b.start <= r.start) & (b.end >= r.end))
    out = out.withColumn("run", F.filter("run", lambda r: ~r.found.rlike(UUID) & ~r.before.rlike(ALLOWED_BEFORE) & ~within(r)))
    out = out.withColumn("more", F.filter(F.flatten(F.transform("run", _stretches)), lambda r: ~within(r)))
    named = lambda a: F.transform(a, lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind")))
    out = out.withColumn("named", named(F.col("base"))).withColumn("found", F.array_sort(F.concat("named", named(F.col("more")))))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.col("named").alias("base"), "found")


def digest(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(docs: DataFrame, text: str = "text", mark: str = "[secret]", block: int = 1 << 16, changed: str | None = None) -> DataFrame:
    """docs with every span found replaced by mark; the other columns as they are, and null texts stay null.

    Overlapping spans become one mark. Texts are cut into blocks first; each looks at all spans of its text. changed: a column
    to add that tells whether a text has any.
    """
    names = docs.columns
    out = scan(docs.select(F.struct(*names).alias("__row"), F.col(text).cast("string").alias("__t")), "__t")  # no name of docs stands beside these
    # spans merged to disjoint ones in order of start
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    last = lambda x: F.element_at(x, -1)
    merge = lambda x, s: F.when((F.size(x) > 0) & (s.start < F.try_element_at(x, F.lit(-1)).b), F.concat(F.slice(x, F.lit(1), F.size(x) - 1), F.array(F.struct(last(x).a.alias("a"), F.greatest(last(x).b, s.end).alias("b"))))).otherwise(F.concat(x, F.array(F.struct(s.start.alias("a"), s.end.alias("b")))))
    out = out.withColumn("__cut", F.aggregate("found", none, merge))
    blocks = F.when(F.char_length("__t") <= block, F.array("__t")).otherwise(F.regexp_extract_all("__t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    out = out.withColumn("__blocks", blocks)

    def block_text(piece: Column, k: Column) -> Column:
        low = k.cast("bigint") * block
        own = F.filter("__cut", lambda s: (s.a < low + block) & (s.b > low))
        ends = F.concat(F.transform(own, lambda s: F.struct(F.greatest(s.a - low, F.lit(0)).alias("a"), F.least(s.b - low, F.lit(block)).alias("b"), (s.a >= low).alias("new"))), F.array(F.struct(F.lit(block).cast("bigint").alias("a"), F.lit(block).cast("bigint").alias("b"), F.lit(False).alias("new"))))
        grow = lambda x, s: F.struct(s.b.alias("at"), F.concat(x.out, F.array(F.substring(piece, (x.at + 1).cast("int"), (s.a - x.at).cast("int")), F.when(s.new, F.lit(mark)).otherwise(F.lit("")))).alias("out"))
        return F.aggregate(ends, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")), grow, lambda x: F.array_join(x.out, ""))

    clean = F.when(F.size("__cut") > 0, F.array_join(F.transform("__blocks", block_text), "")).otherwise(F.col("__t"))
    out = out.withColumn("__clean", clean)
    told = [(F.size("__cut") > 0).alias(changed)] if changed else []
    return out.select(*[F.col("__clean").alias(c) if c == text else F.col("__row")[c].alias(c) for c in names], *told)
