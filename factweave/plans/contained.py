"""Which of many needles stand inside texts, without meeting each with each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First bytes of a needle that are looked up before its whole length is; shorter needles are looked up as they are.
PREFIXES = (8, 4)
#: Bytes of text that are hashed at a time.
PIECE = 1 << 18
#: Bits of the filter for a needle, and the powers of two of its least and largest size.
BITS, LEAST, MOST = 64, 15, 27
#: Different finds that a task holds before it hands them on.
HELD = 100_000

_BASE = 0x9E3779B97F4A7C15
_STEP = [pow(_BASE, s, 2**64) for s in (1, -1)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _prefix(n: int) -> int:
    return next((p for p in PREFIXES if n >= p), n)


class _Hashed:
    """Hashes of all windows of some bytes: sums of powers, so that a window of any length is one difference."""

    powers = [np.ones(1, dtype=np.uint64)] * 2

    def __init__(self, data: bytes, k: int):
        self.n, self.k = len(data), np.uint64(64 - k)
        if len(_Hashed.powers[0]) <= self.n:
            _Hashed.powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)]), dtype=np.uint64) for b in _STEP]
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * self.powers[0][: self.n], out=self.sums[1:], dtype=np.uint64)

    def _bit(self, h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        return (h * _MIX) >> self.k

    def every(self, size: int) -> np.ndarray:
        return self._bit((self.sums[size:] - self.sums[: self.n + 1 - size]) * self.powers[1][: self.n + 1 - size])

    def at(self, at: np.ndarray, sizes) -> np.ndarray:
        return self._bit((self.sums[at + sizes] - self.sums[at]) * self.powers[1][at])


def _bits(needles: list[bytes], k: int) -> np.ndarray:
    """Bits of the filter for each needle: of its prefix and of the whole."""
    sizes = np.array([len(x) for x in needles], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    h = _Hashed(b"".join(needles), k)
    return np.stack([h.at(at, np.array([_prefix(int(n)) for n in sizes], dtype=np.int64)), h.at(at, sizes)], axis=1).astype(np.int64)


def _hits(data: bytes, sizes: list[int], bits: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths with the places at which a needle of that length may stand."""
    h = _Hashed(data, k)
    met = lambda x: (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
    for p in sorted({_prefix(n) for n in sizes}):
        first = np.flatnonzero(met(h.every(p))) if len(data) >= p else np.empty(0, dtype=np.int64)
        for n in sizes:
            if _prefix(n) == p:
                here = first[: np.searchsorted(first, len(data) - n, "right")]
                yield n, here if n == p else here[met(h.at(here, n))]


def latest(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``needle, last``: the largest ``value`` (an int) of the ``texts(value, text)`` that hold a needle of ``needles(needle)``.

    Needles are different texts, none empty; as strings both are compared byte by byte. Every
    window of a text that has the length of a needle is asked against one filter of bounded size,
    by its hash; what passes is joined by equality with the needles, which may be any number.
    """
    n = F.octet_length("needle")
    lengths = {r["n"]: r["c"] for r in needles.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    sizes, k = sorted(lengths), max(LEAST, min(MOST, (sum(lengths.values()) * BITS).bit_length()))
    longest = max(sizes, default=1)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(x: pd.Series) -> pd.Series:
        return pd.Series(list(_bits(x.tolist(), k)) if len(x) else [], dtype=object)

    bit = needles.select(F.explode(places(F.col("needle").cast("binary"))).alias("b"))
    blocks = bit.groupBy(F.shiftright("b", 15).alias("no")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    filter_ = np.zeros((2**k >> 15, 4096), dtype=np.uint8)
    for r in blocks:
        filter_[r["no"]] = np.frombuffer(r["bits"], np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(filter_.ravel())

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
        held, size = [], 0
        for batch in batches:
            for value, text in zip(batch["value"].tolist(), batch["text"].tolist()):
                for at in range(0, len(text), PIECE):
                    held.append((value, text[at : at + PIECE + longest - 1]))
                    size += len(held[-1][1])
                    if size >= PIECE:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[bytes, int] = {}
        out = lambda: pd.DataFrame({"needle": list(best), "last": list(best.values())})
        for held in pieces(batches):
            data = b"\xff".join(t for _, t in held)  # a byte that no text has
            starts = np.cumsum([0] + [len(t) + 1 for _, t in held[:-1]])
            for n, places_ in _hits(data, sizes, sent.value, k):
                for at, i in zip(places_.tolist(), (np.searchsorted(starts, places_, "right") - 1).tolist()):
                    key, value = data[at : at + n], held[i][0]
                    if value > best.get(key, -(2**31) - 1):
                        best[key] = value
                if len(best) > HELD:
                    yield out()
                    best.clear()
        if best:
            yield out()

    found = texts.where("value is not null and text is not null and text <> ''").select("value", F.col("text").cast("binary").alias("text")).mapInPandas(find, "needle binary, last int")
    last = found.groupBy("needle").agg(F.max("last").alias("last")).withColumnRenamed("needle", "__bytes")
    return needles.join(last.hint("merge"), needles["needle"].cast("binary") == F.col("__bytes")).select("needle", "last")
