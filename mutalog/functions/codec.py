"""Keys and values between text and bytes, and bounds of key prefixes.

Keys are compared as unsigned bytes with a proper prefix first. Spark sorts
BinaryType and StringType that way already, so no comparator is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(c: Column | str) -> Column:
    """Text to UTF-8 bytes; NULL stays NULL."""
    return F.encode(c, "UTF-8")


def decode(c: Column | str) -> Column:
    """UTF-8 bytes to text; NULL stays NULL."""
    return F.decode(c, "UTF-8")


def as_strings(df: DataFrame) -> DataFrame:
    """The typed view: key and value as text, other columns untouched."""
    return df.withColumns({c: decode(F.col(c)) for c in ("key", "value") if c in df.columns})


def padded_key(c: Column, prefix: str = "k", width: int = 10) -> Column:
    """prefix and the number padded with zeros, so that number order is byte order."""
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))


def prefix_bounds(prefix: bytes) -> tuple[bytes, bytes | None]:
    """[from, to) of all keys that start with prefix.

    The upper bound is the prefix with its last byte that isn't 0xFF raised by
    one and the rest cut off; None (open) if there is no such byte.
    """
    kept = prefix.rstrip(b"\xff")
    return prefix, kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def component_bounds(*parts: str) -> tuple[bytes, bytes]:
    """[from, to) of the composite keys (parts joined by NUL) below these parts."""
    packed = "\0".join(parts).encode()
    return packed + b"\0", packed + b"\1"
