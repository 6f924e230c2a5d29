"""Byte n-gram tables that give exact code lengths under frozen statistics, for many models at once.

Both users of this module (context trees with escapes, interpolated Kneser-Ney) share one shape: a
known n-gram has a full cost in bits, an unknown one costs what its context asks for leaving it plus
the cost of the n-gram shortened at the left. Tables hold one column a model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_CHARS, bounded_batches, give_back, groups_of, written

#: Positions that are scored at once, times models.
CELLS = 1 << 20


@dataclass
class Table:
    """Rows of float32 by 64-bit key, by open addressing in numpy arrays."""

    slots: np.ndarray
    rows: np.ndarray
    bits: int

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Table:
        """keys: distinct, under 2**63; rows: one for each."""
        bits = max(4, int(len(keys) * 2).bit_length())
        slots = np.full(1 << bits, -1, np.int64)
        number = np.zeros(1 << bits, np.int64)
        left, of = keys.astype(np.int64), np.arange(len(keys))
        at = cls._hash(left, bits)
        while len(left):
            free = slots[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = first[free[first]]
            slots[at[won]], number[at[won]] = left[won], of[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, of, at = left[rest], of[rest], (at[rest] + 1) & ((1 << bits) - 1)
        spread = np.zeros((1 << bits, rows.shape[1]), np.float32)
        used = slots != -1
        spread[used] = rows[number[used]]
        return cls(slots, spread, bits)

    @staticmethod
    def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for unknown ones."""
        at = self._hash(keys, self.bits)
        seen = self.slots[at]
        out = np.where(seen == keys, at, -1)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        mask = (1 << self.bits) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            seen = self.slots[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (seen != -1)]
        return out


@dataclass
class Coder:
    """grams[k] has the costs of n-grams of k + 1 bytes, leave[k] those of leaving a context of k bytes; base: a byte that no model knows."""

    models: list[str]
    base: np.ndarray
    grams: list[Table] = field(default_factory=list)
    leave: list[Table | None] = field(default_factory=list)

    @property
    def order(self) -> int:
        return len(self.grams) - 1

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each model needs for each text: array of len(texts) by models."""
        out = np.zeros((len(texts), len(self.models)))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(texts), np.uint8)
        # How many bytes of its own text stand before each byte, up to the order.
        before = np.full(len(data), self.order, np.int8)
        for k in range(self.order):
            at = ends - lengths + k
            before[at[k < lengths]] = k
        size = max(1024, CELLS // len(self.models))
        for a in range(0, len(data), size):
            b = min(len(data), a + size)
            bits = self._bits(data, before, a, b)
            first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b - 1, side="right")
            own = np.arange(first, last + 1)
            own = own[lengths[own] > 0]
            out[own] += np.add.reduceat(bits, np.maximum(ends[own] - lengths[own], a) - a, axis=0, dtype=np.float64)
        return out

    def _bits(self, data: np.ndarray, before: np.ndarray, a: int, b: int) -> np.ndarray:
        start = max(0, a - self.order)
        own = data[start:b].astype(np.int64)
        n, skip = b - a, a - start
        keys = [own[skip:]]
        for k in range(1, self.order + 1):
            shifted = np.zeros(n, np.int64)
            have = own[max(0, skip - k) : len(own) - k]
            shifted[n - len(have) :] = have
            keys.append(keys[-1] + (shifted << (8 * k)))
        bits = np.zeros((n, len(self.models)), np.float32)
        room = before[a:b]
        left = np.flatnonzero(room == self.order)
        for k in range(self.order, -1, -1):
            if k < self.order:
                left = np.concatenate((left, np.flatnonzero(room == k)))
            of = keys[k][left]
            found = self.grams[k].find(of)
            known = found >= 0
            bits[left[known]] += self.grams[k].rows[found[known]]
            left, of = left[~known], of[~known]
            if self.leave[k] is not None and len(left):
                context = self.leave[k].find(of >> 8)
                known = context >= 0
                bits[left[known]] += self.leave[k].rows[context[known]]
        bits[left] += self.base
        return bits


def gram_counts(labelled: DataFrame, order: int) -> DataFrame:
    """(model, size, gram, n): how often each byte n-gram of 1 to order + 1 bytes stands in the texts of a model.

    labelled: model string, text string, neither null. The key of an n-gram is its bytes as a big-endian number.
    Counts are summed where texts are read, before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("model").to_pylist(), batch.column("text").to_pylist()
            for a, b in groups_of(texts, 4 * GROUP_CHARS):
                by: dict[str, list[bytes]] = {}
                for name, text in zip(names[a:b], texts[a:b], strict=True):
                    by.setdefault(name, []).append(text.encode("utf-8", "surrogatepass"))
                for name, own in by.items():
                    lengths = np.fromiter(map(len, own), np.int64, len(own))
                    data = np.frombuffer(b"".join(own), np.uint8).astype(np.int64)
                    room = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    key = data
                    for k in range(order + 1):
                        if k:
                            key = key.copy()
                            key[k:] += data[:-k] << (8 * k) if len(data) > k else 0
                        grams, n = np.unique(key[room >= k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(np.full(len(grams), k + 1)), pa.array(grams), pa.array(n)], names=["model", "size", "gram", "n"])
        give_back()

    return bounded_batches(labelled).select("model", "text").mapInArrow(run, "model string, size bigint, gram bigint, n bigint").groupBy("model", "size", "gram").agg(F.sum("n").alias("n"))


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About `most` rows of every value of `by`, all if it has fewer; which ones is decided by a hash of `key`.

    Nothing of a group is collected or sorted: a count gives each value's share.
    """
    # Written, so that its size is known when the join is planned.
    shares = written(rows.groupBy(by).agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count(F.lit(1))).alias("share")))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.join(shares, by).where(draw < F.col("share")).drop("share")
