"""Nearest neighbours by inverted lists and adaptive dimension scan.

A random rotation spreads every vector's length evenly over its dimensions, so the distance over the first s
of D dimensions, times D / s, estimates the whole. Within each probed list a query's candidates are scanned
in blocks of columns, and a candidate is given up as soon as its estimate exceeds the query's k-th distance
so far by more than (1 + 2.1 / sqrt(s)) allows. What remains is measured in double precision on the original
vectors.

The lists are the cells of two codebooks, one for each half of the turned dimensions, of N^(1/4) centroids
each, so there are about sqrt(N) lists and the codebooks stay small. They are fitted on a bounded sample of
``sample_rows`` vectors (by a hash of the id); every vector is put in its list. The number of probes is the least that finds
98 % of true neighbours within the sample, found by brute force. Some of the sample, the pivots, bound each
query's k-th distance before the scan; they are not answers themselves, but the lists of its k nearest pivots
are probed too.

Lists are dealt out in portions of ``PORTION`` vectors, which stand still while the queries that probe the
list go past; a list that more than ``ASKERS`` queries probe is dealt out again for each ``ASKERS``. Queries that
find fewer than k, as their lists held too few, are scanned once more over all lists.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id.
Vectors of another length than ``width`` (by default the most frequent one, of equals the greatest) can't be compared and
take no part. Rows that share an id are one candidate at its least distance. Ties go to
the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import discard, stored

PORTION, ASKERS, TILE = 4_096, 16_384, 512
BLOCK_COLUMNS, EPSILON = 16, 2.1


@dataclass
class Index:
    """``books``: the centroids of each half of the turned dimensions; list a * len(books[1]) + b is the cell of centroids a and b."""

    rotation: np.ndarray
    books: tuple[np.ndarray, np.ndarray]
    probes: int
    pivots: np.ndarray
    pivot_ids: np.ndarray

    def _away(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of turned vectors to the centroids, less what all centroids have in common."""
        half = self.books[0].shape[1]
        return tuple((c**2).sum(axis=1) - 2 * part @ c.T for c, part in zip(self.books, (x[:, :half], x[:, half:])))

    def list_of(self, x: np.ndarray) -> np.ndarray:
        a, b = self._away(x @ self.rotation)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def near_lists(self, x: np.ndarray) -> np.ndarray:
        """All lists by distance."""
        a, b = self._away(x @ self.rotation)
        return np.argsort((a[:, :, None] + b[:, None, :]).reshape(len(x), -1), axis=1, kind="stable")

    def ask(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the lists to probe, and a bound on its k-th neighbour's squared distance."""
        near = np.maximum(0, (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * x @ self.pivots.T)
        near[ids[:, None] == self.pivot_ids] = np.inf
        home = self.list_of(self.pivots) if len(self.pivots) else np.zeros(0, dtype=np.int64)
        lists, bounds = [], []
        for q, d, own in zip(x, near, self.near_lists(x)[:, : self.probes]):
            best = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
            best = best[np.isfinite(d[best])]
            exact = ((self.pivots[best] - q) ** 2).sum(axis=1)
            lists.append(np.union1d(own, home[best]))
            bounds.append(exact.max() * (1 + 1e-9) if len(best) == k else np.inf)
        return lists, np.array(bounds)


def _dense(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vec_col: str, width: int | None = None) -> tuple[DataFrame, int]:
    """Rows (id, v) that take part, and their dimension."""
    v = F.col("v")
    named = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    if width is None:
        size = named.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        width = size["size"] if size else 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return named.where((F.size(v) == width) & finite & F.exists(v, lambda x: x != 0)), width


def _centroids(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; a centroid that loses all its vectors stays where it is."""
    out = x[rng.choice(len(x), n, replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(8 if n > 1 else 0):
        at = np.argmin((out**2).sum(axis=1) - 2 * x @ out.T, axis=1)
        total = np.zeros_like(out)
        np.add.at(total, at, x)
        count = np.bincount(at, minlength=n)[:, None]
        out = np.where(count > 0, total / np.maximum(1, count), out)
    return out


def fit(rows: DataFrame, width: int, k: int, sample_rows: int = 8_192, seed: int = 5) -> Index:
    """Fits the index on at most ``sample_rows`` rows (by a hash of the id), which come to the driver."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    rng = np.random.default_rng(seed)
    ids, x = sample.id.to_numpy(dtype=np.int64), np.array([np.asarray(v, dtype=np.float64) for v in sample.v]).reshape(len(sample), max(1, width))
    rotation = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    turned, half = x @ rotation, x.shape[1] // 2
    size = max(1, min(round(n**0.25), len(x) // 8))  # the sample outgrows n^(1/4) for all n under 10^12
    books = tuple(_centroids(part, size if part.shape[1] else 1, rng) for part in (turned[:, :half], turned[:, half:]))
    pivots = np.unique(ids[:2_048], return_index=True)[1]
    index = Index(rotation, books, 1, x[pivots], ids[pivots])
    if size > 1:
        own = x[: min(256, len(x))]
        d = (x**2).sum(axis=1) - 2 * own @ x.T
        d[np.arange(len(own)), np.arange(len(own))] = np.inf
        true = np.argsort(d, axis=1)[:, :k]
        rank = np.argsort(index.near_lists(own), axis=1)  # of each list, for each query
        index.probes = int(np.quantile(np.take_along_axis(rank, index.list_of(x)[true], axis=1), 0.98)) + 1
    return index


def scan(queries: np.ndarray, turned: np.ndarray, candidates: np.ndarray, turned_candidates: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and candidates, and squared distances: of each query the candidates within its k-th distance.

    Candidates come in tiles of rows and each tile in blocks of columns; after a tile the bounds follow what was found.
    """
    width, bounds = candidates.shape[1], bounds.copy()
    found: list[list[np.ndarray]] = [[], [], []]
    for start in range(0, len(candidates), TILE):
        tile = turned_candidates[start : start + TILE]
        end = min(BLOCK_COLUMNS, width)
        first = (turned[:, :end] ** 2).sum(axis=1)[:, None] + (tile[:, :end] ** 2).sum(axis=1) - 2 * turned[:, :end] @ tile[:, :end].T
        going = lambda partial, end, bound: (partial * (width / end) <= (1 + EPSILON / np.sqrt(end)) ** 2 * bound) | (end >= width)
        q, c = np.nonzero(going(first, end, bounds[:, None]))
        partial = first[q, c]
        for s in range(end, width, BLOCK_COLUMNS):
            end = min(s + BLOCK_COLUMNS, width)
            partial = partial + ((tile[c, s:end] - turned[q, s:end]) ** 2).sum(axis=1)
            alive = going(partial, end, bounds[q])
            q, c, partial = q[alive], c[alive], partial[alive]
        d = ((candidates[start + c] - queries[q]) ** 2).sum(axis=1)
        near = d <= bounds[q]
        for to, own in zip(found, (q[near], start + c[near], d[near])):
            to.append(own)
        if start + TILE < len(candidates):
            q, d = (np.concatenate(found[i]) for i in (0, 2))
            order = np.lexsort((d, q))
            q, d = q[order], d[order]
            first_of = np.searchsorted(q, np.arange(len(queries)))
            kth = first_of + k - 1
            has = kth < np.append(first_of[1:], len(q))
            bounds[has] = np.minimum(bounds[has], d[kth[has]])
    q, c, d = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in found)
    near = d <= bounds[q]  # all that tie for the k-th place remain
    return q[near], c[near], d[near]


def _best(q: np.ndarray, ids: np.ndarray, d: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """Of found (query place, id, distance) the rows of each query's k nearest ids, itself left out."""
    rows = np.flatnonzero(ids != asked[q])
    rows = rows[np.lexsort((d[rows], ids[rows], q[rows]))]
    rows = rows[np.append(True, (np.diff(q[rows]) != 0) | (np.diff(ids[rows]) != 0))] if len(rows) else rows  # an id once, at its least distance
    rows = rows[np.lexsort((ids[rows], d[rows], q[rows]))]
    at = np.arange(len(rows)) - np.searchsorted(q[rows], q[rows])
    return rows[at < k]


def _scanned(placed: DataFrame, asked: DataFrame, width: int, k: int, rotation: np.ndarray) -> DataFrame:
    """Rows (query_id, id, score): of placed (id, v, list) the k nearest to each of asked (id, v, bound, list) within each portion of its lists."""
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("asks")), "list")
    cut = sizes.select("list", F.ceil(F.col("n") / PORTION).alias("portions"), F.ceil(F.col("asks") / ASKERS).alias("blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    vectors = placed.join(cut, "list").withColumn("portion", F.pmod(F.xxhash64("id"), F.col("portions"))).select("list", "portion", each("blocks").alias("block"), F.lit(0).alias("side"), "id", "v", F.lit(0.0).alias("bound"))
    queries = asked.join(cut, "list").withColumn("block", F.pmod(F.xxhash64("id", F.lit("q")), F.col("blocks"))).select("list", each("portions").alias("portion"), "block", F.lit(1).alias("side"), "id", "v", "bound")
    cell = ["list", "portion", "block"]
    dealt = vectors.unionByName(queries).repartition(*cell).sortWithinPartitions(*cell, "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, x, turned = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(4)], axis=1)
            starts = np.append(0, np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1)
            out: tuple[list, list, list] = ([], [], [])
            for a, b in itertools.pairwise([*starts.tolist(), batch.num_rows]):
                own_ids, v = batch.column(4).slice(a, b - a).to_numpy(), _dense(batch.column(5).slice(a, b - a), width)
                cell_now = tuple(keys[a, :3])
                if keys[a, 3] == 0:
                    if cell_now == now:  # a portion that goes on in the next batch
                        ids, x, turned = np.append(ids, own_ids), np.concatenate((x, v)), np.concatenate((turned, v @ rotation))
                    else:
                        now, ids, x, turned = cell_now, own_ids, v, v @ rotation
                elif cell_now == now:
                    more = 1 + len(ids) - len(np.unique(ids))  # the query's own row, and rows that share an id
                    bounds = batch.column(6).slice(a, b - a).to_numpy()
                    for s in range(0, b - a, 128):
                        q, c, d = scan(v[s : s + 128], v[s : s + 128] @ rotation, x, turned, bounds[s : s + 128], k + more)
                        best = _best(q, ids[c], d, own_ids[s : s + 128], k)
                        for to, values in zip(out, (own_ids[s + q[best]], ids[c[best]], np.sqrt(d[best]))):
                            to.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "id", "score"])

    return dealt.mapInArrow(run, "query_id long, id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = 8_192, width: int | None = None) -> DataFrame:
    """Rows (query_id, rank, id, score): the k nearest found of each row for which ``is_query`` (on ``id``) holds."""
    rows, width = usable(vectors, id_col, vec_col, width)
    index = fit(rows, width, k, sample_rows)
    shared = rows.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shared.value.list_of(_dense(batch.column(1), width)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], names=["id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                own = batch.slice(start, 256)
                lists, bounds = shared.value.ask(own.column(0).to_numpy(), _dense(own.column(1), width), k)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(bounds, pa.float64()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "v", "bound", "lists"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = rows.select(F.col("id").cast("long"), "v").mapInArrow(place, f"id long, v {kind}, list long")
    queries = rows.where(is_query).select(F.col("id").cast("long"), "v")
    asked = queries.mapInArrow(probe, f"id long, v {kind}, bound double, lists array<long>").select("id", "v", "bound", F.explode("lists").alias("list"))
    first = stored(_scanned(placed, asked, width, k, index.rotation))
    enough = first.groupBy("query_id").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = stored(queries.join(enough, "id", "left_anti"))
    found = first
    if not short.isEmpty():
        lists = placed.select("list").distinct()
        every = lists.agg(F.array_sort(F.collect_list("list")).alias("lists"))  # one row, of about sqrt(N) numbers
        found = first.union(_scanned(placed, short.crossJoin(every).select("id", "v", F.lit(float("inf")).alias("bound"), F.explode("lists").alias("list")), width, k, index.rotation))
    else:
        discard(short)
    one = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    place_of = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return one.withColumn("rank", place_of).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
