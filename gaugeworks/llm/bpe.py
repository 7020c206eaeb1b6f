"""Byte-level byte-pair encoding and decoding by backtracking.

Token bytes become Latin-1 strings in an Aho-Corasick automaton, one pass of which finds the longest token that
starts at each byte of a pre-token. The encoder takes longest tokens from the left; a token may follow
another only if merging the two's bytes by rank gives just those two (memoised by pair); if not, the next shorter token
that starts there is tried, and if none is left, the token before is given up and its end marked as unusable. Each position
is marked once at most, so the time is linear in the length. A sequence all of whose neighbours are compatible
is the one that merging by rank gives, whatever tokens are at hand.

Texts are cut before spaces that have no white space beside, where no pre-token of the pattern crosses, and pieces seen before
come from a bounded cache. Defined results: null and empty texts have no ids; nothing is special, so that strings that look like special tokens are
ordinary text. Whole texts are encoded, segment by segment. Lone surrogates can't come from Spark strings. Every row gets its result, repeated
or not. Other columns are kept; one that has the name of an output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENT = 1 << 20
#: White space beside a space: they can be one pre-token. Spaces without any: a pre-token starts there.
BESIDE, SINGLE = re.compile(r" \s|\s "), re.compile(r" (?<!\s )(?!\s)")
KIND = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Encoder:
    """Encodes by the ranks in a file of base64 tokens and ranks; cached: pieces and pairs that are remembered at most."""

    def __init__(self, path: str, pattern: str, cached: int = 300_000):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {r: b for b, r in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.cached = cached
        self.found = ahocorasick.Automaton()
        for b, r in self.rank.items():
            self.found.add_word(b.decode("latin-1"), (len(b), r))
        self.found.make_automaton()
        self.pairs = common.Remembered(lambda key: self.checked(*key), cached)
        self.words = common.Remembered(lambda word: np.array(self.backtracked(word.encode()), "<u4").tobytes(), cached)
        self.spaced = common.Remembered(lambda text: self.piece(" " + text), cached)
        self.spines: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids by merging the neighbours of least rank again and again: the definition, slow for long data."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The outermost parts on one side of a token while it is merged, each with the rank of the merge that takes it up."""
        known = self.spines.get((token, right))
        if known is None:
            if len(token) == 1:
                known = [(token, 1 << 60)]
            else:
                a, b = self.halves(token)
                known = [*self.spine(b if right else a, right)[:-1], (b if right else a, self.rank[token]), (token, 1 << 60)]
            self.spines[token, right] = known
        return known

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens that are merged to this one."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            _, at = min((self.rank.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def checked(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the tokens a and b apart, side by side.

        The parts on either side of the border change at known ranks; two of them that meet merge first if their
        token's rank is below that of the left one's own merge, and not above the right one's (of equal merges the left comes first).
        """
        left, right, rank = self.spine(self.bytes[a], True), self.spine(self.bytes[b], False), self.rank
        k = m = 0
        while True:
            (x, until_x), (y, until_y) = left[k], right[m]
            r = rank.get(x + y)
            if r is not None and r < until_x and r <= until_y:
                return False
            if k + 1 == len(left) and m + 1 == len(right):
                return True
            if until_x <= until_y:
                k += 1
            else:
                m += 1

    def backtracked(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        n, rank, pairs = len(data), self.rank, self.pairs
        longest = [1] * n
        for end, (size, _) in self.found.iter(data.decode("latin-1")):
            if size > longest[start := end + 1 - size]:
                longest[start] = size
        usable = bytearray(b"\1" * (n + 1))
        ids: list[int] = []
        ends: list[int] = []
        at, size = 0, longest[0]
        while at < n:
            before = ids[-1] if ids else None
            while size:
                token = rank.get(data[at : at + size])
                if token is not None and usable[at + size] and (before is None or pairs[before, token]):
                    ids.append(token)
                    at += size
                    ends.append(at)
                    size = longest[at] if at < n else 0
                    break
                size -= 1
            else:
                usable[at] = 0
                ids.pop()
                ends.pop()
                back = ends[-1] if ends else 0
                size = at - back - 1
                at = back
        return ids

    def piece(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def segments(self, text: str) -> Iterator[str]:
        """text in parts that begin with a single space before something else, or in one if it has none."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = text.find(" ", at + SEGMENT)
            while cut > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut + 1 >= len(text):
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids of the whole text in order, packed, segment by segment."""
        for part in self.segments(text or ""):
            first, *rest = SINGLE.split(part) if BESIDE.search(part) else part.split(" ")
            yield self.piece(first) + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; path: the rank file's, on every worker."""
    common.batches(docs.sparkSession)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def udf(t: pa.Array) -> pa.Array:
        own, n, ids, back = encoder(path, pattern), [], [], []
        for x in t.to_pylist():
            size, a, b = 0, hashlib.sha256(), hashlib.sha256()
            for part in own.encode(x):
                size += len(part) // 4
                a.update(part)
                b.update(own.decode(part))
            n.append(size)
            ids.append(a.hexdigest())
            back.append(b.hexdigest())
        return common.struct_array(KIND, n_tokens=n, ids_sha256=ids, decoded_sha256=back)

    return common.widened(docs, udf(F.col(text).cast("string")), KIND.names)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text as an array of integers."""
    common.batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def udf(t: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        return pa.array([np.frombuffer(b"".join(own.encode(x)), "<u4").astype(np.int32) for x in t.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out, udf(F.col(text).cast("string")))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text of each array of ids (invalid UTF-8 gets replacement characters); null ids give null."""
    common.batches(rows.sparkSession)

    @F.arrow_udf("string")
    def udf(x: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        return pa.array([None if a is None else own.decode(np.array(a, "<u4").tobytes()).decode("utf-8", "replace") for a in x.to_pylist()], pa.string())

    return rows.withColumn(out, udf(F.col(ids)))
