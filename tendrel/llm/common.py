"""What several operators share: repeated rows, limits, Arrow list access and hashing kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.session import table


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key; rows with a null key are left out. Repeated rows are alike in content, so any will do."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df.dropDuplicates(list(keys))


def limits(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The fixed size_limits table (four rows) as a dict."""
    return {r["limit_name"]: r["amount"] for r in table(spark, sf_dir, "size_limits").collect()}


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the offsets of its values (n + 1); nulls are empty."""
    if pa.types.is_string(col.type):
        width = np.int32
    elif pa.types.is_large_string(col.type):
        width = np.int64
    else:
        raise TypeError(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=width, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def whole(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Byte -> its value inside a word (0: separates words); upper case folds to lower.
_WORD = np.zeros(256, dtype=np.uint64)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = _c + 32


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; kept for the next batch, up to a few megabytes."""
    known = _KNOWN.get(int(base))
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    np.cumprod(out, out=out)
    if n <= 1 << 22:
        _KNOWN[int(base)] = out
    return out[:n]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (a run of a-z0-9 after folding) in all values, and the value each word is in.

    One polynomial prefix hash over all bytes gives every word's hash by subtraction, so there is no loop over
    words: hash(word) = (P[end] - P[start]) / base**start modulo 2**64.
    """
    v = _WORD[raw]
    inside = v != 0
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[at[:-1][at[:-1] < n]] = True  # a value's first byte always starts anew
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(v * _powers(_BASE, n), out=prefix[1:])
    h = (prefix[ends] - prefix[start]) * _powers(_INVERSE, n)[start]
    return mix(h + (ends - start).astype(np.uint64)), np.searchsorted(at, start, side="right") - 1


def shingle_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within one value, and the value each is in."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : m + i]
    own = owner[:m]
    same = own == owner[n - 1 :]
    return mix(h[same]), own[same]


def distinct_pairs(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, h) sorted, each pair once."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
        h, owner = h[new], owner[new]
    return h, owner


def list_array(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """A list per value 0..n-1 from values grouped by a sorted owner."""
    offsets = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


# -- a filter of hashes -------------------------------------------------------------------------------------------------

#: Bits that a Bloom filter of hashes starts with and may grow to (32 MB), three positions for each hash. Beyond some fifty
#: million hashes it lets more through, which costs shuffle and nothing else.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_PLACES = (0, 17, 34)


def sieve(hashes: DataFrame, rows: int | None = None):
    """A broadcast Bloom filter of the column u (bigint hashes), or-ed together by the executors: 16 bits for each row of
    hashes (rows, if the caller knows about how many) within the bounds, so at most MOST_BITS / 64 rows reach the driver.
    They come as Arrow batches, 12 bytes a row (50 MB at most): as Python objects they took gigabytes."""
    spark = hashes.sparkSession
    bits = LEAST_BITS
    rows = hashes.count() if rows is None else rows
    while bits < min(MOST_BITS, 16 * rows):
        bits *= 2
    at = F.explode(F.array(*(F.shiftrightunsigned("u", n).bitwiseAND(F.lit(bits - 1)) for n in _PLACES))).alias("at")
    words = hashes.select(at).groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    for b in words.to_batches():
        out[np.asarray(b.column(0))] = np.asarray(b.column(1)).view(np.uint64)
    return spark.sparkContext.broadcast(out)


def passes(words: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter lets through: all it was made of, and few others."""
    keep = np.ones(len(u), bool)
    for n in _PLACES:
        at = (u >> np.uint64(n)) & np.uint64(len(words) * 64 - 1)
        keep &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return keep
