"""Exact top-k by integer inner product with block-at-a-time pruning.

Rows in the order of their ids are cut into blocks; a block keeps its forward index (a matrix of the
rows' terms) and for every term the largest and the smallest weight in it. For a query, the sum over
its terms of weight times that extreme bounds every score in the block. A query visits blocks from the
highest bound on and scores them whole, until the bound falls below its kth score so far.

Batches of queries first meet one range of blocks each, which gives every query a kth score to start from. Then each batch
meets the extremes of all other ranges, and only queries with a bound that reaches their kth score go on to a range, together a
task of bounded size; the best of all are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

#: Rows of a block, blocks of a range and queries of a batch.
BLOCK, RANGE, BATCH = 1024, 32, 512
#: Rows of a pack: their ids, their own numbers and weights; width is that of a weight in bytes.
PACKED = "k bigint, n bigint, dims bigint, width bigint, ids binary, rows binary, weights binary"
LEAST = np.iinfo(np.int64).min


def _packed_row(k: int, ids: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> list:
    top = int(np.abs(weights).max(initial=0))
    width = next(w for w in (2, 4, 8) if w == 8 or top < 1 << (8 * w - 1))
    return [k, len(ids), weights.shape[1], width, ids.tobytes(), rows.tobytes(), weights.astype(f"<i{width}").tobytes()]


def _batch(row: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)


NAMES = [x.split()[0] for x in PACKED.split(", ")]
KINDS = [pa.int64()] * 4 + [pa.binary()] * 3


def _pack(most: int):
    """Rows (id, row, weights) in order to packs of at most `most`; shorter vectors are padded with zeros. k is the first row's own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[int] = []
        vectors: list[np.ndarray] = []

        def out(n: int) -> pa.RecordBatch:
            matrix = np.zeros((n, max(1, max(map(len, vectors[:n])))), np.int64)
            for i, v in enumerate(vectors[:n]):
                matrix[i, : len(v)] = v
            made = _batch(_packed_row(rows[0], np.array(ids[:n], np.int64), np.array(rows[:n], np.int64), matrix), NAMES, KINDS)
            del ids[:n], rows[:n], vectors[:n]
            return made

        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            column = batch.column(2)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            vectors += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            while len(ids) >= most:
                yield out(most)
        while ids:
            yield out(min(most, len(ids)))

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, rows and weights of a pack."""
    weights = np.frombuffer(row["weights"], f"<i{row['width']}").reshape(-1, row["dims"]).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), weights


def _padded(*matrices: np.ndarray) -> list[np.ndarray]:
    dims = max(x.shape[1] for x in matrices)
    return [np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in matrices]


def extremes(weights: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest weight of every term in each block."""
    starts = np.arange(0, len(weights), block)
    return np.maximum.reduceat(weights, starts, axis=0), np.minimum.reduceat(weights, starts, axis=0)


def bounds_of(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """No score of a query in a block is over this: array of queries by blocks."""
    queries, most, least = _padded(queries, most, least)
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


def search(query_rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of each query that reach its floor, by score, then smaller id: (query number, id, score), and how many blocks were visited.

    A row whose own number is the query's takes no part. ids ascend. floor: a score that k rows elsewhere have.
    """
    bounds = bounds_of(queries, *extremes(rows, block))
    queries, rows = _padded(queries, rows)
    # Sums of this size are exact in doubles, which multiply fastest.
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * queries.shape[1]
    kind = np.float64 if top < 1 << 53 else np.int64
    queries, rows = queries.astype(kind), rows.astype(kind)
    starts = np.arange(0, len(rows), block)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    n, visits = len(queries), 0
    best_of, best_id, best_score = (np.zeros(0, np.int64) for _ in range(3))
    kth = np.full(n, LEAST) if floor is None else floor.astype(np.int64).copy()
    for t in range(len(starts)):
        at = turn[:, t]
        open_ = bounds[np.arange(n), at] >= kth
        if not open_.any():
            break
        visits += int(open_.sum())
        parts = [(best_of, best_id, best_score)]
        for b in np.unique(at[open_]):
            mine = np.flatnonzero(open_ & (at == b))
            a, z = starts[b], min(starts[b] + block, len(rows))
            scores = (queries[mine] @ rows[a:z].T).astype(np.int64)
            wanted = (scores >= kth[mine, None]) & (own[None, a:z] != query_rows[mine, None])
            if z - a > k + 1:
                # One more than k, for the query itself may be among them.
                wanted &= scores >= np.partition(scores, z - a - k - 1, axis=1)[:, z - a - k - 1][:, None]
            i, j = np.nonzero(wanted)
            parts.append((mine[i], ids[a + j], scores[i, j]))
        of, found, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((found, -score, of))
        of, found, score = of[order], found[order], score[order]
        kept = np.arange(len(of)) - np.searchsorted(of, of) < k
        best_of, best_id, best_score = of[kept], found[kept], score[kept]
        full = np.flatnonzero(np.bincount(best_of, minlength=n) >= k)
        kth[full] = np.maximum(kth[full], best_score[np.searchsorted(best_of, full, side="right") - 1])
    return best_of, best_id, best_score, visits


def quantized(embeddings: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, row, weights): floor(scale * x) of each component as a double, and a number of each row's own."""
    x = F.col(vector_column)
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    rows = embeddings.where(F.col(id_column).isNotNull() & x.isNotNull() & sound)
    weights = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return rows.select(F.col(id_column).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), weights.alias("weights"))


def top_k(embeddings: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, query_every: int = 20, scale: int = 64, block: int = BLOCK, blocks: int = RANGE, batch: int = BATCH) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best of all other rows for each row whose id, a whole number, is divisible by query_every.

    Defined results: a vector that is null or has a null or non-finite component takes no part, nor
    does a row without an id; rows that repeat an id are rows of their own, as queries (each with its ranks) and as candidates; vectors of unlike
    length meet as if the shorter one went on with zeros; a query with no other row has no results.
    """
    with Scratch(embeddings.sparkSession) as scratch:
        rows = scratch.written(quantized(embeddings, id_column, vector_column, scale))

        def packed(df: DataFrame, most: int, name: str) -> tuple[DataFrame, int]:
            """Packs with a number from 0, and how many there are; the numbering sees a number for each pack."""
            parts = max(1, -(-df.count() // most))
            made = scratch.written(df.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").select("id", "row", "weights").mapInArrow(_pack(most), PACKED))
            numbers = scratch.written(made.select("k", (F.row_number().over(Window.orderBy("k")) - 1).cast("bigint").alias(name)))
            return scratch.written(made.join(numbers, "k")), numbers.count()

        ranges, n_ranges = packed(rows, block * blocks, "a")
        batches, n_batches = packed(rows.where(F.col("id") % query_every == 0), batch, "b")
        kept = [c for c in ranges.columns if c not in ("a", "b")]
        schema, names = f"a bigint, b bigint, side bigint, {PACKED}, floors binary", ["a", "b", "side", *NAMES, "floors"]
        kinds = [pa.int64()] * 3 + KINDS + [pa.binary()]
        result = "b bigint, query bigint, query_id bigint, vec_id bigint, score bigint"

        def score(cell: pa.Table) -> pa.Table:
            sides = {r["side"]: r for r in cell.to_pylist()}
            query_ids, query_rows, queries = _unpacked(sides[0])
            ids, own, matrix = _unpacked(sides[1])
            floors = np.frombuffer(sides[0]["floors"], np.int64) if sides[0]["floors"] else None
            of, found, scores, _ = search(query_rows, queries, ids, own, matrix, k, block, floors)
            return pa.table({"b": pa.array(np.full(len(of), sides[0]["b"], np.int64)), "query": query_rows[of], "query_id": query_ids[of], "vec_id": found, "score": scores})

        def scored(asked: DataFrame) -> DataFrame:
            """asked: (a, b, packed queries, floors); each meets its range."""
            left = asked.select("a", "b", F.lit(0).cast("bigint").alias("side"), *kept, "floors")
            right = asked.select("a", "b").join(ranges, "a").select("a", "b", F.lit(1).cast("bigint").alias("side"), *kept, F.lit(None).cast("binary").alias("floors"))
            return left.union(right).groupBy("a", "b").applyInArrow(score, result)

        home = F.col("b") % max(1, n_ranges)
        first = scratch.written(scored(batches.select(home.alias("a"), "b", *kept, F.lit(None).cast("binary").alias("floors"))))
        # At most a batch of pairs for each batch.
        kth = first.groupBy("b", "query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        floors = scratch.written(kth.groupBy("b").agg(F.collect_list(F.struct("query", "kth")).alias("known")))

        def outline(packs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in packs:
                for r in record.to_pylist():
                    most, least = extremes(_unpacked(r)[2], block)
                    yield _batch([r["a"], most.shape[1], most.tobytes(), least.tobytes()], ["a", "terms", "most", "least"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

        outlines = scratch.written(ranges.select("a", *kept).mapInArrow(outline, "a bigint, terms bigint, most binary, least binary"))

        def reach(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in records:
                for i in range(record.num_rows):
                    r = record.slice(i, 1).to_pylist()[0]
                    ids, own, queries = _unpacked(r)
                    known = {x["query"]: x["kth"] for x in r["known"] or ()}
                    floor = np.array([known.get(x, LEAST) for x in own.tolist()], np.int64)
                    most, least = (np.frombuffer(r[x], np.int64).reshape(-1, r["terms"]) for x in ("most", "least"))
                    go = bounds_of(queries, most, least).max(axis=1) >= floor
                    if go.any():
                        yield _batch([r["a"], r["b"], 0, *_packed_row(r["k"], ids[go], own[go], queries[go]), floor[go].tobytes()], names, kinds)

        others = batches.join(floors, "b", "left").withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, n_ranges) - 1).cast("bigint")))).where(F.col("a") != home)
        asked = scratch.written(others.join(outlines, "a").select("a", "b", *kept, "known", "terms", "most", "least").mapInArrow(reach, schema))
        best = first.union(scored(asked))
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return written(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
