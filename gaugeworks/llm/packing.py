"""Packing of tokenised documents into fixed windows, online in bounded space.

Each partition keeps a fixed number of open windows. A document's whole windows are cut off from its start and emitted at once; the
rest goes into the open window that it fills best. If none fits and no more may be open, the fullest is emitted as
it is and a new one opened. What is left open at a partition's end is merged: the left pieces of every 16 partitions
are packed anew, longest first, each into the fullest window that it fits. So a task holds a bounded number of windows, and padding
stays small. The pieces are a table in the shared folder before leftovers are merged, so that both parts of the result come from one run of each partition.

Defined results: a null text counts as empty; every document gets at least one piece, as its ids end with the end id. Rows with null or
repeated ids are packed like others. Which documents share a window depends on the partitions; that each id lies in one piece, and that offsets are
gapless, doesn't. Columns other than those named are not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
KIND = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in KIND.split(", ")]


#: How the files that Words can speed up normalise texts and divide them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
DIVIDED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
END = "</w>"


def _class(codes: Iterable[int]) -> str:
    """Code points as the inside of a regular expression's class."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def _plain() -> tuple[str, str]:
    """Letters and marks, as classes, that normalising leaves in place or lower-cases one by one, and that every Unicode version has alike."""
    kind = unicodedata.category
    letters = [c for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x530)) if kind(chr(c)) in ("Lu", "Ll") and len(chr(c).lower()) == 1 and unicodedata.is_normalized("NFC", chr(c))]
    marks = [c for c in (*range(0x21, 0x7F), *range(0xA1, 0x100), *range(0x2010, 0x2028)) if kind(chr(c))[0] in "PS"]
    return _class(letters), _class(marks)


class Words:
    """Ids of texts by a tokenizers file.

    Its merges by rank over words with an end are those of a rank encoder whose tokens have a space where the file marks a word's end: the file's
    ids rise with its merges, so they are ranks, and a byte with that space comes before all of them. So a text
    of plain letters, digits and marks is lower-cased, gets spaces around marks and digits, and is encoded in one call. Texts with other characters, and all texts if the
    file is of another build, go through the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        letters, marks = _plain()
        self.odd = rf"[^\t\n\r 0-9{letters}{marks}]"
        self.apart = rf"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[{marks}]+|[\t\n\r]"
        with open(path, encoding="utf-8") as f:
            self.ranked = self.ranks(json.load(f))
        if self.ranked and [x.tolist() for x in self.fast(pa.array([SAMPLE]))] != [x.tolist() for x in self.whole([SAMPLE])]:
            self.ranked = None

    @staticmethod
    def ranks(file: dict):
        """A rank encoder that does the same, or None for a file of another build."""
        import tiktoken

        model, divide = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        names, merges = model.get("vocab") or {}, [x if isinstance(x, list) else x.split(" ") for x in model.get("merges") or []]
        known = file.get("normalizer") == NORMALIZER and divide[0].get("pattern") == {"Regex": DIVIDED} and [x.get("type") for x in divide] == ["Split", "ByteLevel"] and not divide[1].get("add_prefix_space")
        if not known or model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("ignore_merges") or not merges:
            return None
        # the byte-level alphabet: printable bytes stand for themselves, others for what follows U+00FF
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printed]
        byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
        ended = lambda x: x.endswith(END) and x != END
        try:
            rank = {bytes(byte[c] for c in x.removesuffix(END)) + b" " if ended(x) else bytes(byte[c] for c in x): k for x, k in names.items()}
            made = [names[a + b] for a, b in merges]
        except KeyError:
            return None
        first = min(made)
        if made != list(range(first, first + len(made))) or len(rank) != len(names) or any(rank.get(bytes([b]) + e, first) >= first for b in range(256) for e in (b"", b" ")):
            return None
        return tiktoken.Encoding("words", pat_str=r"[^ \t\n\r]+ ", mergeable_ranks=rank, special_tokens={})

    def whole(self, texts: list[str]) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4")

    def fast(self, texts: pa.Array) -> Iterator[np.ndarray]:
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), self.apart, r" \0 ")
        for x in spaced.to_pylist():
            yield self.ranked.encode_to_numpy(x + " ", disallowed_special=()).astype("<u4", copy=False)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column, null ones being empty."""
        texts = texts.fill_null("")
        if not self.ranked:
            yield from self.whole(texts.to_pylist())
            return
        odd = pc.match_substring_regex(texts, self.odd)
        plain = self.fast(texts.filter(pc.invert(odd)))
        # one text at a time: ids with what the library keeps beside them take many times a text's room
        others = (ids for x in texts.filter(odd).to_pylist() for ids in self.whole([x]))
        for is_odd in odd.to_pylist():
            yield next(others if is_odd else plain)


#: Says at load whether a file's words are encoded alike both ways.
SAMPLE = "Abc, d\u00e9 EF.\n\nG\u0416 $$jk=4;l 1234 (m)\t'n o's ''s don't we'LL extraordinarily"


@cache
def words(path: str) -> Words:
    """One for each worker process."""
    return Words(path)


class Packer:
    """Open windows; full ones go to `done` as (sequence, pieces)."""

    def __init__(self, window: int, most: int | None, first: int):
        self.window, self.most, self.next = window, most, first
        self.open: list[tuple[int, int]] = []  # (used, sequence), sorted
        self.pieces: dict[int, list] = {}
        self.done: list[tuple[int, list]] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, piece: tuple, length: int) -> None:
        """piece: of at most a window; kept whole."""
        at = bisect_left(self.open, (self.window - length + 1, -1)) - 1  # the fullest that has room
        if at >= 0:
            used, seq = self.open.pop(at)
        else:
            if self.most is not None and len(self.open) >= self.most:
                _, full = self.open.pop()
                self.done.append((full, self.pieces.pop(full)))
            used, seq = 0, self.new()
            self.pieces[seq] = []
        self.pieces[seq].append((*piece, used))
        if used + length == self.window:
            self.done.append((seq, self.pieces.pop(seq)))
        else:
            insort(self.open, (used + length, seq))

    def rows(self) -> list[tuple]:
        out = [(*p[:-1], seq, p[-1]) for seq, pieces in self.done for p in pieces]
        self.done = []
        return out


def pack(docs: DataFrame, path: str, end_id: int, id: str = "doc_id", text: str = "text", window: int = WINDOW, open_windows: int = 16, merged: int = 16) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    path: the tokenizer's file, on every worker; end_id follows each document's ids. merged: how many
    partitions' leftovers are packed together.
    """
    common.batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, p = words(path), Packer(window, open_windows, part << 32)

        def batch(rows: list[tuple], group: int | None) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array([group] * len(rows), pa.int64())], names=[*NAMES, "leftover"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), own.encode(b.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    own_ids = ids[start : start + window]
                    piece = (doc, start, len(own_ids), zlib.crc32(own_ids.tobytes()), len(ids))
                    if len(own_ids) == window:
                        p.done.append((p.new(), [(*piece, 0)]))
                    else:
                        p.place(piece, len(own_ids))
            if p.done:
                yield batch(p.rows(), None)
        p.done = list(p.pieces.items())
        if p.done:
            yield batch(p.rows(), part // merged)

    made, _ = common.stored(rows.mapInArrow(run, KIND + ", leftover long"), "packed")

    def merge(left: pd.DataFrame) -> pd.DataFrame:
        p = Packer(window, None, (1 << 62) + (int(left["leftover"].iloc[0]) << 32))
        for r in left.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])[NAMES[:5]].astype(object).itertuples(index=False):
            p.place(tuple(None if pd.isna(x) else int(x) for x in r), int(r.length))
        p.done += p.pieces.items()
        return pd.DataFrame(p.rows(), columns=NAMES).astype({"doc_id": "Int64"})

    # A group has the open windows of `merged` partitions, so its size is bounded.
    rest = made.where("leftover is not null").groupBy("leftover").applyInPandas(merge, KIND)
    return made.where("leftover is null").select(*NAMES).unionByName(rest)
