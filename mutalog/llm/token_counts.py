"""Exact token counts by prefix dynamic programming.

Inside a pre-token, the BPE encoding of a prefix is the encoding of a shorter
prefix plus one last token, and that token is the only one ending there that
fits the one before it (two tokens fit if encoding their bytes gives them back).
So one pass over a pre-token stores the last token and the count of every
prefix. Pre-tokens add up, so the table of a text answers how many tokens any
prefix has and how much of the text fits a budget, without encoding again.

Defined results: a null text is an empty one with 0 tokens; special strings
inside texts count as the library counts them (one token); a row stays a row,
repeated or without id; a column of the
caller that has the name of an added one goes on as <name>_input.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutalog.llm.shared import apart, in_batches
from mutalog.llm.tokens import default_path, vocabulary

#: Pre-tokens whose counts a worker remembers, and pairs of tokens; when full, it starts anew.
REMEMBERED = 1_000_000
#: Characters of the longest pre-token that is remembered.
SHORT = 64


class _Known(dict):
    """Token counts of pre-tokens, worked out at the first look-up."""

    def __init__(self, count):
        self._count = count

    def __missing__(self, piece: str) -> int:
        n = self._count(piece)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


class PrefixCounts:
    def __init__(self, path: str):
        self.vocabulary = v = vocabulary(path)
        self._id, self._bytes, self._longest = v.id_of, v.bytes_of, v.longest
        self._fit: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._known = _Known(lambda piece: self.table(piece.encode())[-1])

    def _fits(self, a: int, b: int) -> bool:
        found = self._fit.get((a, b))
        if found is None:
            if len(self._fit) >= REMEMBERED:
                self._fit.clear()
            found = self._fit[a, b] = self.vocabulary.merge(self._bytes[a] + self._bytes[b]) == [a, b]
        return found

    def _reached(self, t: int) -> bool:
        found = self._whole.get(t)
        if found is None:
            found = self._whole[t] = self.vocabulary.merge(self._bytes[t]) == [t]
        return found

    def table(self, word: bytes) -> list[int]:
        """Tokens of word[:i] for every i, by the programme above."""
        ids, longest, last, count = self._id, self._longest, [-1], [0]
        for i in range(1, len(word) + 1):
            for start in range(max(0, i - longest), i):
                t = ids.get(word[start:i])
                if t is None:
                    continue
                if self._reached(t) if start == 0 else self._fits(last[start], t):
                    last.append(t)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {word[:80]!r}")
        return count

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of the text and whether each is a special string."""
        at = 0
        if self.vocabulary.special_pattern:
            for m in self.vocabulary.special_pattern.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield text[at:], False

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its table, from the tables of its pre-tokens."""
        n = 0
        for part, special in self._segments(text):
            if special:
                n += 1
                continue
            n += sum(map(self._known.__getitem__, self.vocabulary.split(part)))
        return n

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to len(text)."""
        out = np.zeros(len(text) + 1, np.int64)
        pieces: list[tuple[int, str, bool]] = []
        at = 0
        for part, special in self._segments(text):
            for piece in [part] if special else self.vocabulary.split(part):
                pieces.append((at, piece, special))
                at += len(piece)
        before: list[int] = []
        n = 0
        for k, (at, piece, special) in enumerate(pieces):
            before.append(n)
            word = piece.encode()
            table = [0] * len(word) + [1] if special else self.table(word)
            byte = 0
            for j, c in enumerate(piece, 1):
                byte += len(c.encode())
                # a cut right after the first characters, in a contraction or in a special string can be split otherwise: look back two pre-tokens
                if j < len(piece) and (special or j == 1 or piece[0] == "'"):
                    back = max(0, k - 2)
                    out[at + j] = before[back] + self.total(text[pieces[back][0] : at + j])
                else:
                    out[at + j] = n + table[byte]
            n += table[-1]
        return out


@functools.lru_cache(2)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    for x in batch.column(column):
        yield x.as_py() or ""


def count_tokens(df: DataFrame, text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """df without its text, with n_bytes, n_tokens and over_limit."""
    df = apart(df, "n_bytes", "n_tokens", "over_limit")
    path = path or default_path()
    kept = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(f for f in df.schema if f.name != text_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n = pa.array([c.total(t) for t in _texts(b, text_col)], pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(b.column(text_col)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), size, n, pc.greater(n, limit)], [*kept, "n_bytes", "n_tokens", "over_limit"])

    return in_batches(df, run, schema)


def prefix_tables(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df with prefix_tokens: the token count of every prefix, by code points, 0 first."""
    df = apart(df, "prefix_tokens")
    path = path or default_path()
    schema = T.StructType([*df.schema, T.StructField("prefix_tokens", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for i, t in enumerate(_texts(b, text_col)):  # a table is eight times its text: one row at a time
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([c.prefixes(t)], pa.list_(pa.int64()))], schema.names)

    return in_batches(df, run, schema)


def truncated(tables: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """From prefix_tables(): the longest prefix of each text with at most budget tokens, as text and its count."""
    numbered = F.transform("prefix_tokens", lambda n, i: F.when(n <= budget, i))
    return tables.withColumn("__cut", F.array_max(numbered)).withColumns({text_col: F.substring(F.coalesce(text_col, F.lit("")), F.lit(1), F.col("__cut")), "n_tokens": F.element_at("prefix_tokens", F.col("__cut") + 1)}).drop("__cut", "prefix_tokens")
