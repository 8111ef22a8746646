"""Exact top-k by inner product with an impact-ordered index, score at a time.

Each block of rows is indexed once: for each dimension, the postings (row,
value) by descending impact, the magnitude of the value. A query takes the
postings in segments of descending quantised impact on its own score, |query
component * value|, a step of a fixed ratio at a time: of each dimension a
segment is one slice. What is left can add to a row's score no more than the
product of what is left of the row's and the query's norm (Cauchy-Schwarz), both
kept beside the score. Rows that look best are scored exactly, which gives a
score that the k-th best has at least; once few rows can still reach it, and
that is proven, these are scored exactly and the other segments are skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, pick

#: Results of a query; rows of an index; queries that meet it in one task at most.
K, ROWS, QUERIES = 20, 1 << 15, 1 << 13

#: Tasks that small tables are still cut into, and queries that each then has at least.
SPREAD, FEWEST = 12, 64

#: Least impacts of the segments, as shares of the greatest there can be; what is left has any.
IMPACTS = (1 / 48, 1 / 80, 1 / 128, 0.0)

#: Dimensions whose postings are added at a time.
TOGETHER = 8

#: Share of an index's rows that may be scored exactly before the next segment is taken instead; indexes of up to so many rows are scored wholly.
RESCORED, WHOLE = 0.1, 256

#: Bits of the sums of squares, of the query and the row, that a row's accumulator holds below its score: all three are exact in one double.
_BITS = 17
_MASK = (1 << _BITS) - 1

_LONG = np.iinfo(np.int64)


def quantise(vector: str = "embedding", scale: int = 64):
    """array<bigint> of floor(scale * x), x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; what is beyond 64 bits becomes the nearest 64-bit number."""
    most = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).sum())
    if most < 1 << 52:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    return np.array([min(max(v, _LONG.min), _LONG.max) for v in rows.astype(object) @ query.astype(object)], np.int64)


class Index:
    """One block of rows: ``ids`` ascending, ``rows`` as they are, and for each dimension its rows by descending impact.

    ``visited`` and ``held`` count the postings that queries took, and could have taken.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, places: np.ndarray | None = None) -> None:
        if places is None:
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            places = np.argsort(-np.abs(rows.T).astype(np.int64), axis=1, kind="stable").astype(np.uint16 if len(rows) <= 1 << 16 else np.int64)
        self.ids, self.rows = ids, rows
        self.visited = self.held = 0
        squares = (rows.astype(np.float64) ** 2).sum(axis=1)
        # A row's accumulator holds three sums, if all of them fit.
        self.fits = len(rows) > WHOLE and rows.shape[1] > 0 and squares.max(initial=0) <= _MASK
        self.places = places
        if self.fits:
            self.squares = squares.astype(np.int64)
            self.top = int(np.abs(rows).max(initial=0))
            self.numbers = np.arange(-self.top, self.top + 1)
            # For each posting, where its value is in a table of all dimensions' numbers.
            start = np.arange(rows.shape[1])[:, None] * len(self.numbers) + self.top
            self.codes = np.take_along_axis(rows.T, self.places, axis=1).astype(np.int64) + start
            self.codes = self.codes.astype(np.uint16 if rows.shape[1] * len(self.numbers) <= 1 << 16 else np.int64)
            # above[d, m]: postings of dimension d with an impact of at least m
            impacts = np.stack([np.bincount(np.abs(v), minlength=self.top + 1) for v in rows.T])
            self.above = np.append(np.cumsum(impacts[:, ::-1], axis=1)[:, ::-1], np.zeros((len(impacts), 1), np.int64), axis=1)

    def packed(self) -> dict:
        """What ``unpacked`` makes the same index of, in narrow numbers."""
        small = self.rows.max(initial=0) < 1 << 15 and self.rows.min(initial=0) >= -(1 << 15)
        rows = self.rows.astype("<i2" if small else "<i8")
        places = self.places.astype("<u2" if len(self.ids) <= 1 << 16 else "<u4")
        return {"width": rows.shape[1], "ids": self.ids.astype("<i8").tobytes(), "rows": rows.tobytes(), "places": places.tobytes()}

    @staticmethod
    def unpacked(width: int, ids: bytes, rows: bytes, places: bytes) -> Index:
        found = np.frombuffer(ids, "<i8")
        n = len(found)
        held = np.frombuffer(rows, "<i2" if len(rows) == 2 * n * width else "<i8").reshape(n, width)
        return Index(found, held, np.frombuffer(places, "<u2" if n <= 1 << 16 else "<u4").reshape(width, n))

    def search(self, query_id: int, query: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the rows, the query's own left out, that can be among its k best: all that tie with the last are there."""
        q = np.zeros(max(self.rows.shape[1], len(query)), np.int64)
        q[: len(query)] = query
        q = q[: self.rows.shape[1]]
        # The query's own rows stand together, as ids ascend.
        own = slice(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right"))
        left = len(self.ids) - (own.stop - own.start)
        size = np.abs(q)
        if self.fits and left > k and (size.astype(np.float64) ** 2).sum() <= _MASK:
            at = self._members(q, size, own, k)
        else:
            at = np.arange(len(self.ids))
        at = at[(at < own.start) | (at >= own.stop)]
        return self.ids[at], exact_scores(self.rows[at], q)

    def _members(self, q: np.ndarray, size: np.ndarray, own: slice, k: int) -> np.ndarray:
        n = len(self.ids)
        added, taken = np.zeros(n), np.zeros(len(q), np.int64)
        adds = ((q[:, None] * self.numbers << (2 * _BITS)) + (q[:, None] ** 2 << _BITS) + self.numbers**2).astype(np.float64).ravel()
        square, largest = int((q * q).sum()), self.top * int(size.max(initial=0))
        self.held += n * len(q)
        least = -np.inf
        at = np.arange(n)
        for share in IMPACTS:
            low = np.where(size > 0, np.ceil(max(largest * share, 1) / np.maximum(size, 1)), self.top + 1)
            ends = self.above[np.arange(len(q)), np.minimum(low, self.top + 1).astype(np.int64)]
            more = np.flatnonzero(ends > taken)
            for i in range(0, len(more), TOGETHER):
                here = [(d, slice(taken[d], ends[d])) for d in more[i : i + TOGETHER]]
                added += np.bincount(np.concatenate([self.places[x] for x in here]), adds[np.concatenate([self.codes[x] for x in here])], n)
            sums = added.astype(np.int64)
            self.visited += int(np.maximum(ends - taken, 0).sum())
            taken = np.maximum(taken, ends)
            score = sums >> (2 * _BITS)
            slack = np.sqrt(((square - (sums >> _BITS & _MASK)) * (self.squares - (sums & _MASK))).astype(np.float64))
            score[own] = -(1 << 40)
            seem = np.argpartition(score, n - min(n, 2 * k))[n - min(n, 2 * k) :]
            seem = seem[(seem < own.start) | (seem >= own.stop)]
            if len(seem) >= k:
                sure = exact_scores(self.rows[seem], q)
                least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
            at = np.flatnonzero(score + slack + 0.5 >= least)
            if len(at) <= max(4 * k, RESCORED * n):
                break
        return at


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to smaller ids; ordered by query, rank."""
    order = np.lexsort((ids, -score, q))
    sorted_q = q[order]
    starts = np.searchsorted(sorted_q, sorted_q)
    return order[np.arange(len(order)) - starts < k]


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    n = len(values)
    sizes = np.diff(values.offsets.to_numpy()) if n else np.zeros(0, int)
    width = int(sizes.max(initial=0))
    out = np.zeros((n, width), np.int64)
    if width:
        out[np.arange(width)[None, :] < sizes[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def search(vectors: DataFrame, is_query, k: int = K, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, v array<bigint>) that ``is_query`` holds for, its k best others.

    Rows are dealt to blocks, of each of which one index is built and written.
    Each pair of an index and a block of queries is one task's work and yields
    k rows of each query at most; those are merged by query. An index travels
    once for each block of queries, a query once for each index. Rows with the
    query's own id are left out, so repeated rows of another id count one by
    one. Of rows that repeat a query's id, the smallest vector asks. Vectors of
    unlike length are compared as if filled up with zeros.
    """
    n = vectors.count()
    asked = cut(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    many = asked.count()
    row_blocks = max(1, -(-n // rows))
    query_blocks = max(1, -(-many // queries), min(-(-SPREAD // row_blocks), many // FEWEST))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int")  # one id's rows may be many

    def build(held: pa.Table) -> pa.Table:
        found = Index(held.column("vec_id").to_numpy(), _matrix(held.column("v"))).packed()
        return pa.table({"r": held.column("r")[:1]} | {c: [v] for c, v in found.items()})

    index = vectors.select(own.alias("r"), "vec_id", "v").groupBy("r").applyInArrow(build, "r int, width bigint, ids binary, rows binary, places binary")
    right = cut(index).select(every(query_blocks).alias("q"), "*")
    left = asked.select(every(row_blocks).alias("r"), F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(query_blocks)).cast("int").alias("q"), "vec_id", "v")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        q, v, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if held.num_rows and asked.num_rows:
            there = Index.unpacked(**held.select(["width", "ids", "rows", "places"]).to_pylist()[0])
            for query_id, query in zip(asked.column("vec_id").to_pylist(), _matrix(asked.column("v"))):
                ids, scores = there.search(query_id, query, k)
                top = best(np.zeros(len(ids), np.int64), ids, scores, k)
                q.append(np.full(len(top), query_id))
                v.append(ids[top])
                s.append(scores[top])
        return pa.table({"query_id": np.concatenate(q), "vec_id": np.concatenate(v), "score": np.concatenate(s)})

    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_inner_products(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``, against all rows.

    Components become floor(64 * x). Null ids, null vectors and vectors that
    hold a null or non-finite component take no part; an empty vector scores 0.
    Components and scores beyond 64 bits count as the nearest 64-bit number. Of
    rows that repeat a query's id, the smallest vector asks, and none of them is
    its candidate. An empty table gives no rows; other columns are ignored.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = pick(embeddings, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(F.forall("embedding", finite)).select(F.col("vec_id").cast("bigint").alias("vec_id"), quantise().alias("v"))
    return search(rows, F.col("vec_id") % every == 0, k)
