"""SimHash near-duplicates by self-joins of binary tries of all fingerprints.

Equal fingerprints are one leaf. The 64 bits are cut into segments, a few more than the error budget; two
fingerprints within the budget agree in at least all but `budget` of them, whichever these are. So for each choice of
that many segments the bits are put in an order that starts with the chosen ones, and the trie of the permuted
fingerprints is joined with itself: down to the depth of the chosen bits only a node with itself, below it
nodes in pairs, walked together to the leaves. A pair of nodes carries the bits that differ so far, and is dropped once
they exceed the budget, or once all leaves of both are known to be connected. The number of segments grows with the
number of fingerprints, so that few share the chosen bits and the work stays in proportion to them.

Permuted leaves are sorted and cut into blocks of bounded size; blocks meet where they hold leaves with the same chosen bits,
which but for crowded prefixes is inside a block. A block returns the spanning forest of the links that it finds, so a large
group of near copies costs as many edges as it has fingerprints, while every link between different fingerprints counts.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows
share a fingerprint and a component; a null doc_id links as any row does, but is never the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, written
from .components import components

#: Seed of the shingle hash, fixed by the contract.
SEED = 42
#: Most leaves in a block, and least number of blocks that are asked for.
BLOCK, LEAST_BLOCKS = 65_536, 16
#: Node pairs that are walked at once; what they link is known to the next ones.
FRONTIER = 1 << 15
#: Segments are added until so many fingerprints share the chosen bits if they are spread evenly; most that are added.
SHARE, MORE = 8, 4


def fingerprint(text: str | None, width: int = 4) -> int:
    """64 bits, the most significant first; a bit is set if it is set in over half the shingle hashes."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    if len(found) <= width:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=">u8")
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, id_column: str, text_column: str, width: int = 4, extra: tuple = ()) -> DataFrame:
    """id_column, extra columns and fp, the fingerprint as a signed 64-bit number."""

    def made(texts: list) -> dict[str, list]:
        return {"fp": pa.array(np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64))}

    return map_texts(documents.select(id_column, *extra, text_column), id_column, text_column, made, "fp bigint")


class Order:
    """The bits of a fingerprint in another order: those of the chosen segments first."""

    def __init__(self, segments: int, chosen: tuple[int, ...]) -> None:
        ends = [64 * k // segments for k in range(segments + 1)]
        parts = [(ends[k], ends[k + 1] - ends[k]) for k in (*chosen, *(k for k in range(segments) if k not in chosen))]
        #: (first bit from the top, bits) of each segment in turn.
        self.parts = parts
        self.depth = sum(n for _, n in parts[: len(chosen)])

    def permuted(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint64)
        for start, n in self.parts:
            out = (out << np.uint64(n)) | ((values >> np.uint64(64 - start - n)) & np.uint64((1 << n) - 1))
        return out

    def restored(self, values: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(values), np.uint64), 64
        for start, n in self.parts:
            left -= n
            out |= ((values >> np.uint64(left)) & np.uint64((1 << n) - 1)) << np.uint64(64 - start - n)
        return out


def orders(n: int, budget: int) -> list[Order]:
    """An order for each choice of all but `budget` segments; there is one segment more than that at least, and as many as n fingerprints ask for."""
    segments = budget + 1
    while segments < budget + MORE and n > SHARE << (64 * (segments - budget) // segments):
        segments += 1
    return [Order(segments, chosen) for chosen in combinations(range(segments), segments - budget)]


def _common(x: np.ndarray) -> np.ndarray:
    """Zero bits above the highest set one: what two numbers have in common, from their difference."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return 64 - np.bitwise_count(x).astype(np.int64)


def _above(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first so many bits of each number."""
    return np.where(bits > 0, x >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))


def _runs(values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the nodes of a depth start among sorted leaves, with the end, and their bits."""
    prefix = values >> np.uint64(64 - depth)
    starts = np.concatenate(([0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1))
    return np.concatenate((starts, [len(values)])), prefix[starts]


class _Forest:
    """For each leaf the smallest one that links reach, and whether a range of leaves is one component."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.changes = np.zeros(0, np.int64)
        self._count()

    def _count(self) -> None:
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while not np.array_equal(jump := label[label], label):
                label = jump
        self.label = label
        self._count()

    def connected(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether the leaves of both ranges are known to be one component."""
        return (self.changes[a0] == self.changes[a1 - 1]) & (self.changes[b0] == self.changes[b1 - 1]) & (self.label[a0] == self.label[b0])


def linked(left: np.ndarray, right: np.ndarray | None, budget: int, depth: int) -> np.ndarray:
    """For each leaf of left, then right, the first one that it is connected with by pairs of the same first `depth` bits at budget bits or fewer.

    left and right: sorted and distinct, unsigned 64 bits; right None: pairs within left, else pairs of one leaf of either.
    """
    own = right is None
    leaves = left if own else np.concatenate((left, right))
    forest = _Forest(len(leaves))
    if not len(left) or not own and not len(right):
        return forest.label
    ends, prefix = _runs(left, depth)
    if own:
        a0, a1 = ends[:-1], ends[1:]
        crowded = a1 - a0 > 1
        a0, a1 = a0[crowded], a1[crowded]
        b0, b1 = a0, a1
    else:
        others, theirs = _runs(right, depth)
        _, x, y = np.intersect1d(prefix, theirs, assume_unique=True, return_indices=True)
        a0, a1, b0, b1 = ends[x], ends[x + 1], others[y] + len(left), others[y + 1] + len(left)
    stack = [(a0, a1, b0, b1)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(a0[half:], a1[half:], b0[half:], b1[half:]), (a0[:half], a1[:half], b0[:half], b1[:half])]
            continue
        same = a0 == b0
        first_a, first_b = leaves[a0], leaves[b0]
        # The depths at which the two nodes branch; 64 for a leaf.
        branch_a, branch_b = _common(first_a ^ leaves[a1 - 1]), _common(first_b ^ leaves[b1 - 1])
        at = np.minimum(branch_a, branch_b)
        keep = np.bitwise_count(_above(first_a ^ first_b, at)) <= budget
        keep &= ~forest.connected(a0, a1, b0, b1)
        pair = keep & (at == 64)
        if pair.any():
            forest.link(a0[pair], b0[pair])
        keep &= at < 64
        if not keep.any():
            continue
        a0, a1, b0, b1, same, at, cut_a, cut_b = (x[keep] for x in (a0, a1, b0, b1, same, at, branch_a == at, branch_b == at))

        def middle(start: np.ndarray, side: np.ndarray, base: int, at: np.ndarray = at) -> np.ndarray:
            """Where a node's second half starts: the first leaf with the bit that it branches at."""
            low = (63 - at).astype(np.uint64)
            return np.searchsorted(side, ((leaves[start] >> low) | np.uint64(1)) << low) + base

        mid_a = np.where(cut_a, middle(a0, left, 0), a1)
        mid_b = mid_a if own and same.all() else np.where(cut_b, middle(b0, left if own else right, 0 if own else len(left)), b1)
        halves_a, halves_b = ((a0, mid_a, None), (mid_a, a1, cut_a)), ((b0, mid_b, None), (mid_b, b1, cut_b))
        found = []
        for x, (p0, p1, has_a) in enumerate(halves_a):
            for y, (q0, q1, has_b) in enumerate(halves_b):
                wanted = np.ones(len(a0), bool)
                for has in (has_a, has_b):
                    if has is not None:
                        wanted &= has
                if x > y:
                    wanted &= ~same
                found.append([z[wanted] for z in (p0, p1, q0, q1)])
        parts = [np.concatenate(z) for z in zip(*found, strict=True)]
        # A leaf has no pair with itself.
        some = ~((parts[0] == parts[2]) & (parts[1] - parts[0] == 1))
        stack.append(tuple(z[some] for z in parts))
    return forest.label


def _edges(leaves: np.ndarray, label: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """The forest's links as signed fingerprints."""
    at = np.flatnonzero(label != np.arange(len(label)))
    return tuple(order.restored(x).view(np.int64) for x in (leaves[label[at]], leaves[at]))


def _pack(most: int):
    """Sorted leaves (order, signed) of a partition to blocks of at most so many, each of one order; lo is the first leaf as a signed number."""

    def block(k: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(values[0])]), pa.array([int(values[-1])]), pa.array([values.tobytes()], pa.binary())], names=["k", "lo", "hi", "leaves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, np.zeros(0, np.int64)
        for batch in batches:
            kinds, values = (batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
            for kind in np.unique(kinds).tolist():
                if kind != held:
                    if len(kept):
                        yield block(held, kept)
                    held, kept = kind, kept[:0]
                kept = np.concatenate((kept, values[kinds == kind]))
                while len(kept) >= most:
                    yield block(held, kept[:most])
                    kept = kept[most:]
        if len(kept):
            yield block(held, kept)

    return run


#: Turns the order of signed numbers into that of unsigned ones, and back.
TOP = np.uint64(1 << 63)


def _leaves(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64).view(np.uint64) ^ TOP


def _unsigned(x: int) -> int:
    return x + (1 << 63)


def _room(a: tuple[int, int], b: tuple[int, int]) -> int:
    """Least number of differing bits between two ranges of leaves, from the bits that each has in common."""
    shared = min(64 - (x[0] ^ x[1]).bit_length() for x in (a, b))
    return ((a[0] ^ b[0]) >> (64 - shared)).bit_count() if shared else 0


def hamming_components(distinct: DataFrame, budget: int = 4, block: int = BLOCK) -> DataFrame:
    """(id, component) of the fingerprints that link, directly or not; distinct has one column fp, a signed bigint."""
    with Scratch(distinct.sparkSession) as scratch:
        found = scratch.written(distinct)
        n = found.count()
        every = orders(n, budget)
        depths = [o.depth for o in every]

        def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for k, order in enumerate(every):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array((order.permuted(values) ^ TOP).view(np.int64))], names=["k", "leaf"])

        parts = max(LEAST_BLOCKS, -(-n * len(every) // block))
        sorted_ = found.mapInArrow(permute, "k int, leaf bigint").repartitionByRange(parts, "k", "leaf").sortWithinPartitions("k", "leaf")
        blocks = scratch.written(sorted_.mapInArrow(_pack(block), "k int, lo bigint, hi bigint, leaves binary"))

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    leaves = _leaves(raw)
                    u, v = _edges(leaves, linked(leaves, None, budget, depths[k]), every[k])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        # A block shares chosen bits with others only at its ends.
        bits = F.get(F.array(*(F.lit(64 - d) for d in depths)), F.col("k"))
        ends = blocks.select("k", "lo", "hi").withColumn("bits", bits)
        ends = ends.select("k", "lo", "hi", F.explode(F.array_distinct(F.array(F.expr("shiftright(lo, bits)"), F.expr("shiftright(hi, bits)")))).alias("prefix"))

        def meet(group: pa.Table) -> pa.Table:
            """Pairs of blocks of one prefix that leave room for a link; a group has two numbers for each block."""
            k, rows = group.column("k")[0].as_py(), sorted(zip(group.column("lo").to_pylist(), group.column("hi").to_pylist(), strict=True))
            low = _unsigned(group.column("prefix")[0].as_py() << (64 - depths[k]))
            high = low + (1 << (64 - depths[k])) - 1
            cut = [(max(_unsigned(a), low), min(_unsigned(b), high)) for a, b in rows]
            met = [(k, rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if _room(cut[i], cut[j]) <= budget]
            return pa.table({"k": pa.array([x for x, _, _ in met], pa.int32()), "a": pa.array([x for _, x, _ in met], pa.int64()), "b": pa.array([x for _, _, x in met], pa.int64())})

        crowded = ends.groupBy("k", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        pairs = scratch.written(ends.join(crowded, ["k", "prefix"]).groupBy("k", "prefix").applyInArrow(meet, "k int, a bigint, b bigint").distinct())

        def across(group: pa.Table) -> pa.Table:
            k = group.column("k")[0].as_py()
            left, right = (_leaves(raw) for _, raw in sorted(zip(group.column("lo").to_pylist(), group.column("leaves").to_pylist(), strict=True)))
            u, v = _edges(np.concatenate((left, right)), linked(left, right, budget, depths[k]), every[k])
            return pa.table({"u": u, "v": v})

        cells = pairs.select("k", "a", "b", F.explode(F.array("a", "b")).alias("lo")).join(blocks.select("k", "lo", "leaves"), ["k", "lo"])
        links = blocks.select("k", "leaves").mapInArrow(inside, "u bigint, v bigint").union(cells.groupBy("k", "a", "b").applyInArrow(across, "u bigint, v bigint"))
        return components(links)


def simhash_components(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """A row for each row of documents: its id, fingerprint (hex), fp (the same, signed) and component_id, the smallest id reachable.

    What the joins look up is written first, so that adaptive execution splits a fingerprint or component with very many rows.
    """
    docs = written(fingerprints(documents, id_column, text_column, width))
    leaves = written(docs.groupBy("fp").agg(F.min(id_column).alias("first_id")))
    linked_ = hamming_components(leaves.select("fp"), budget)
    named = written(leaves.join(linked_, leaves.fp == linked_.id, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")))
    least = written(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    found = written(named.join(least, "component").select("fp", "component_id"))
    return docs.join(found, "fp").select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "fp", "component_id")


def keep_one(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """The columns of documents, one row of each component: that with the smallest id, by its text's hash if ids repeat.

    In a component where all ids are null the row with the smallest hash stays; rows that are equal in id and text are one.
    """
    names = documents.columns
    keys = F.xxhash64(text_column)
    own = written(fingerprints(documents.select(F.col(id_column).alias("id"), keys.alias("key"), F.col(text_column).alias("text")), "id", "text", width, ("key",)))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
    # The best row of a fingerprint, then of a component: minima of minima.
    leaves = written(own.groupBy("fp").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("n")))
    linked_ = hamming_components(leaves.select("fp"), budget).withColumnRenamed("id", "fp")
    placed = leaves.join(linked_, "fp", "left").select("x", F.coalesce("component", "fp").alias("component"))
    chosen = written(placed.groupBy("component").agg(F.min("x").alias("x")).select(F.col("x.id").alias("chosen_id"), F.col("x.key").alias("chosen_key")))
    keyed = documents.toDF(*(f"in_{k}" for k in range(len(names))))
    id_in, text_in = f"in_{names.index(id_column)}", f"in_{names.index(text_column)}"
    kept = keyed.join(chosen, F.col(id_in).eqNullSafe(F.col("chosen_id")) & (F.xxhash64(text_in) == F.col("chosen_key")), "left_semi")
    out = kept.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(names)))
    # Rows that repeat id and text pass the join together; only then is there anything left to do.
    single = own.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return out if single else out.dropDuplicates([id_column, text_column])
