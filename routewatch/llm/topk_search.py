"""Exact top-k search by inner product, a block of a document range at a time.

Vectors, in the order of their ids, are cut into ranges, ranges into blocks. A block's forward index
holds its vectors; its maxima and minima by component (the terms of a query, by sign) add up to a bound
on every score in it. For each query the blocks of a range come by falling bound and are scored until
the bounds fall below the k-th best score known. Ranges are taken in rounds, each ``GROWTH`` times as many as
the rounds before, and a query's k-th best score of earlier rounds is the floor of the later ones, so
the rows that queries bring back stay in proportion to k.

A range meets the queries in one task: its rows come first, then the queries in Arrow batches.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import discard, written

#: Vectors of a range (a power of two) and of a block; how the rounds grow; queries that are scored at once.
RANGE_BITS, BLOCK, GROWTH, SLICE = 12, 128, 8, 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def vectors(rows: DataFrame, key="vec_id", vector="embedding") -> DataFrame:
    """vec_id and v of every row whose vector is neither null nor holds null or non-finite components."""
    kind = "array<float>" if rows.schema[vector].dataType.elementType.typeName() == "float" else "array<double>"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).filter(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors' components as floor(64 x) in doubles; shorter vectors are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(64.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _widened(matrix, width):
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


class Range:
    """The blocks of one range: forward indexes, and maxima and minima by component."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray):
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids, self.matrix = ids.fill_null(0).to_numpy(), matrix
        starts = np.arange(0, len(matrix), BLOCK)
        self.starts, self.ends = starts, np.append(starts[1:], len(matrix))
        self.high, self.low = np.maximum.reduceat(matrix, starts), np.minimum.reduceat(matrix, starts)
        self.largest = float(np.abs(matrix).max(initial=0))

    def best(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
        """Rows of queries, places here and scores of each query's k best vectors that reach its floor."""
        width = max(queries.shape[1], self.matrix.shape[1])
        queries, matrix = _widened(queries, width), _widened(self.matrix, width)
        high, low = _widened(self.high, width), _widened(self.low, width)
        reach = float(np.abs(queries).max(initial=0)) * self.largest * width
        if reach >= 2.0 ** 53:  # doubles are not exact there: whole numbers of any size, all of them
            scores = np.clip(_whole(queries) @ _whole(matrix).T, _LEAST, _MOST).astype(np.int64)
            rows, places = np.nonzero(~((ids[:, None] == self.ids) & ~self.null))
            return self._first(rows, places, scores[rows, places], k)
        kind = np.float32 if reach < 2.0 ** 24 else np.float64
        queries, matrix, floors = queries.astype(kind), matrix.astype(kind), floors.copy()
        bounds = np.maximum(queries, 0) @ high.astype(kind).T + np.minimum(queries, 0) @ low.astype(kind).T
        order = np.argsort(-bounds, axis=1, kind="stable")
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)]
        done, step = 0, 1
        while done < len(self.starts):
            chosen = order[:, done:done + step]
            asking, at = np.nonzero(np.take_along_axis(bounds, chosen, 1) >= floors[:, None])
            if not len(asking):
                break  # bounds only fall
            blocks, found = chosen[asking, at], [kept]
            for block in np.unique(blocks):
                rows, (a, b) = asking[blocks == block], (self.starts[block], self.ends[block])
                scores = queries[rows] @ matrix[a:b].T
                own = (ids[rows][:, None] == self.ids[a:b]) & ~self.null[a:b]
                x, y = np.nonzero((scores >= floors[rows][:, None]) & ~own)
                found.append([rows[x], a + y, scores[x, y]])
            rows, places, scores = (np.concatenate(c) for c in zip(*found))
            by = np.lexsort((-scores, rows))
            last = by[np.flatnonzero(_ranks(rows[by]) == k - 1)]  # the k-th best of each row so far
            floors[rows[last]] = np.maximum(floors[rows[last]], scores[last])
            reaching = scores >= floors[rows]
            kept = [rows[reaching], places[reaching], scores[reaching]]
            done, step = done + step, 2 * step
        return self._first(kept[0], kept[1], kept[2].astype(np.int64), k)

    def _first(self, rows, places, scores, k):
        order = np.lexsort((self.ids[places], self.null[places], ~scores, rows))  # ~x falls as x grows, for every long
        rows, places, scores = rows[order], places[order], scores[order]
        first = _ranks(rows) < k
        return rows[first], places[first], scores[first]


def _ranks(rows):
    """The place of each element among the equal ones; ``rows`` are sorted."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def _whole(matrix):
    return np.array([[int(x) for x in row] for row in matrix], object).reshape(matrix.shape)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k):
    def batches(parts):
        number, pieces, index = None, [], None
        for part in parts:
            ranges, kinds = part.column("range").to_numpy(), part.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(ranges) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows]):
                piece = part.slice(a, b - a)
                if ranges[a] != number:
                    number, pieces, index = ranges[a], [], None
                if kinds[a] == 0:
                    pieces.append((piece.column("id"), _matrix(piece.column("v"))))
                    continue
                if index is None and pieces:
                    width = max(m.shape[1] for _, m in pieces)
                    index = Range(pa.concat_arrays([i for i, _ in pieces]), np.concatenate([_widened(m, width) for _, m in pieces]))
                if index is None:
                    continue
                ids, wanted = piece.column("id").to_numpy(), _matrix(piece.column("v"))
                floors = piece.column("floor").fill_null(-math.inf).to_numpy()
                floors = np.where(np.abs(floors) < 2.0 ** 53, floors, np.nextafter(floors, -math.inf))  # rounded ones may be too high
                for at in range(0, len(ids), SLICE):
                    rows, places, scores = index.best(ids[at:at + SLICE], wanted[at:at + SLICE], floors[at:at + SLICE], k)
                    found = pa.array(index.ids[places], mask=index.null[places])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + SLICE][rows]), found, pa.array(scores)], schema=_FOUND)

    return batches


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``candidates`` with the highest scores for each of ``queries``.

    Both have vec_id and v (see ``vectors``). The score is the inner product of floor(64 x), exact; ties go to
    the smaller vec_id, null last. Rows with the query's own id are no candidates for it. Repeated rows all
    take part; of several queries with one id the least vector counts, queries without id are left out. Vectors
    of unequal length are filled up with zeros. Scores beyond 64 bits count as the nearest long. Fewer candidates
    than k give fewer rows; empty tables none.
    """
    spark = candidates.sparkSession
    sorted_rows = candidates.select("vec_id", "v").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    rows = written(sorted_rows.withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)), "vectors")
    wanted = written(queries.filter(F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "vector-queries")
    ranges = written(rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range"), "ranges")
    rounds = 1 + math.ceil(math.log(max(1, ranges.count()), GROWTH))
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    # a range's round: the last one takes all but a GROWTHth, and so on back to the first
    place = F.pmod(F.xxhash64("range"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    turn = F.lit(0)
    for number in range(1, rounds):
        turn = F.when(place >= GROWTH ** float(number - rounds), number).otherwise(turn)
    for number in range(rounds):
        now = turn == number
        floors = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
        known = wanted.join(floors, "query_id", "left").select(F.col("query_id").alias("id"), "v", F.col("least").cast("double").alias("floor"))
        asked = known.crossJoin(ranges.filter(now)).withColumn("kind", F.lit(1))
        held = rows.filter(now).select("range", F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("floor"), F.lit(0).alias("kind"))
        met = held.unionByName(asked).repartition("range").sortWithinPartitions("range", "kind", F.asc_nulls_last("id"))
        found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long").unionByName(best)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        before = best
        best = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank"), "best")
        if number:
            discard(before)
        best, ranked = best.drop("rank"), best
    return ranked.select("query_id", "rank", "vec_id", "score")
