"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over bytes cuts texts where their content says so, so a passage
shared by documents gives the same chunks in each. A worker encodes a chunk once
and reuses its ids for every document that holds it. Chunks are encoded alone,
so ids at a join can differ from those of the whole text: the join is repaired
by re-encoding from the last sure boundary before it to the first one after it,
where both sides agree. A boundary is sure where a space follows a visible
ASCII character: no pre-token and no special string reaches across it.

Reuse is per worker and bounded in bytes; a text is encoded where it is read, so
nothing is shuffled and a lost task is run again alone.

Defined results: a null text is an empty text (0 ids); special strings inside
texts become their ids, as the library does; every row stays a row;
a column of the caller that has the name of an added one goes on as <name>_input.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mutalog.llm.shared import apart, in_batches
from mutalog.llm.tokens import default_path, vocabulary

WINDOW, MASK, LEAST, MOST = 32, (1 << 9) - 1, 256, 4096
#: Bytes of chunk text that a worker remembers, the longest unused going first.
REMEMBERED = 24 << 20
#: Texts are hashed in slices of so many bytes.
SLICE = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


#: The tables that _powers() made last.
_TABLES: list[np.ndarray] = []


def _powers(n: int = SLICE + WINDOW + 1) -> list[np.ndarray]:
    """The first n powers (or more) of the base and of its inverse modulo 2 ** 64: tables that grow with the longest text, not those of a whole slice at once."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        if n <= SLICE + WINDOW + 1:
            size = min(size, SLICE + WINDOW + 1)
        _TABLES.clear()
        for x in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            table = np.full(size, x, np.uint64)
            table[0] = 1
            _TABLES.append(np.multiply.accumulate(table, out=table))
    return _TABLES


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash of each window of bytes; entry i is of data[i : i + window]. At most SLICE + WINDOW bytes."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], dtype=np.uint64, out=prefix[1:])
    h = (prefix[window:] - prefix[:n]) * up[:n]
    return h ^ (h >> np.uint64(29))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data, at character boundaries; the last is its length."""
    n, out, start = len(data), [], 0
    raw = np.frombuffer(data, np.uint8)
    found = []
    for at in range(0, max(0, n - WINDOW + 1), SLICE):
        part = raw[at : at + SLICE + WINDOW - 1]
        h = rolling(part, WINDOW)
        found.append(np.flatnonzero((h >> np.uint64(13)) & np.uint64(MASK) == 0) + at + WINDOW)
    for p in np.concatenate(found).tolist() if found else []:
        while p - start > MOST:
            start = _whole(data, start + MOST)
            out.append(start)
        p = _whole(data, p)
        if p - start >= LEAST and p < n:
            out.append(p)
            start = p
    while n - start > MOST:
        start = _whole(data, start + MOST)
        if start >= n:
            break
        out.append(start)
    if n > (out[-1] if out else 0):
        out.append(n)
    return out


def _whole(data: bytes, p: int) -> int:
    while p < len(data) and data[p] & 0xC0 == 0x80:
        p += 1
    return p


class Encoder:
    def __init__(self, path: str):
        v = vocabulary(path)
        self._fast, self.special, self.bytes_of = v.fast(), set(v.special), v.bytes_of
        self._length = [len(v.bytes_of.get(i, b"")) for i in range(max(v.bytes_of) + 1)]
        self._known: OrderedDict[bytes, array] = OrderedDict()
        self._held = 0
        self.encoded_bytes = self.reused_bytes = 0

    def _plain(self, data: bytes) -> list[int]:
        return self._fast.encode(data.decode("utf-8"), allowed_special=self.special)

    def _chunk(self, data: bytes) -> array:
        ids = self._known.get(data)
        if ids is not None:
            self._known.move_to_end(data)
            self.reused_bytes += len(data)
            return ids
        ids = self._known[data] = array("i", self._plain(data))
        self.encoded_bytes += len(data)
        self._held += len(data)
        while self._held > REMEMBERED:
            self._held -= len(self._known.popitem(last=False)[0])
        return ids

    def encode(self, text: str) -> array:
        data = text.encode("utf-8")
        out = array("i")
        done = start = 0  # ids up to byte done are final, and done is a sure boundary
        for end in cuts(data):
            ids = self._chunk(data[start:end])
            first = start if start == done else self._sure_after(data, start, end)
            last = end if end == len(data) else self._sure_before(data, first, end) if first >= 0 else -1
            if first >= 0 and last > first:
                a, b = self._inside(ids, first - start), len(ids) - self._inside(ids[::-1], end - last)
                if a >= 0 and b <= len(ids):  # both encodings have a token boundary there
                    if done < first:
                        out.extend(self._plain(data[done:first]))
                    out += ids[a:b]
                    done = last
            start = end
        if done < len(data):
            out.extend(self._plain(data[done:]))
        return out

    def _inside(self, ids: array, size: int) -> int:
        """How many of the ids have exactly size bytes together; -1 if size falls into a token."""
        k = 0
        while size > 0:
            size -= self._length[ids[k]]
            k += 1
        return k if size == 0 else -1

    @staticmethod
    def _sure_after(data: bytes, a: int, b: int) -> int:
        """The first sure boundary in [a, b], or -1."""
        p = data.find(b" ", max(a, 1), b)
        while p >= 0 and not 0x20 < data[p - 1] < 0x7F:
            p = data.find(b" ", p + 1, b)
        return p

    @staticmethod
    def _sure_before(data: bytes, a: int, b: int) -> int:
        """The last sure boundary in (a, b], or -1."""
        p = data.rfind(b" ", a + 1, b + 1)
        while p >= 0 and not 0x20 < data[p - 1] < 0x7F:
            p = data.rfind(b" ", a + 1, p)
        return p

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df with token_ids."""
    df = apart(df, "token_ids")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = pa.array(([*e.encode(x.as_py() or "")] for x in b.column(text_col)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "token_ids"])

    return in_batches(df, run, T.StructType([*df.schema, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """df with decoded, the text of its ids; null ids give an empty text."""
    df = apart(df, "decoded")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = pa.array((e.decode(x.as_py() or []) for x in b.column(ids_col)), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])

    return in_batches(df, run, T.StructType([*df.schema, T.StructField("decoded", T.StringType())]))


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df without its text, with n_tokens and the digests of its ids and of what they decode to: both ways in one pass."""
    df = apart(df, "n_tokens", "ids_sha256", "decoded_sha256")
    path = path or default_path()
    kept = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(f for f in df.schema if f.name != text_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        names = [str(i) for i in range(max(e.bytes_of) + 1)]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(text_col):
                ids = e.encode(x.as_py() or "")
                n.append(len(ids))
                ids_sha.append(sha(",".join([names[i] for i in ids]).encode()))
                text_sha.append(sha(e.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema.names)

    return in_batches(df, run, schema)
