"""Approximate nearest neighbours by inner product: an inverted multi-index, exactly reranked.

Fit, on a bounded sample in one task: each vector half gets a codebook by k-means, the larger the more rows there are; a
cell is a pair of centroids. Index: every row is put in its cell, and cells are packed into blocks of bounded size (a cell
with more rows is split by a hash of vec_id). Search: a query walks centroid pairs by ascending summed distance (minus inner
product) with a heap until the cells so far hold the wanted share of the rows; the distance it got to decides which cells it
sees, and it is sent to their blocks. Rows are shuffled once, whatever the number of queries: a task holds one block at a
time, and the queries sent to it, which come after its rows, stream past. Seen rows are scored in double precision.
The wanted share is the least that reached the target recall on the sample, measured there against brute force.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the fit, block_rows a block, of which a query is given its k best rows. Codebooks have about
    sqrt(rows / cell_rows) centroids, at most `centroids`, so that cells hold cell_rows rows on average as long as they can
    be listed on the driver."""

    centroids: int = 512
    cell_rows: int = 16
    sample_rows: int = 20_000
    sample_queries: int = 200
    rounds: int = 12
    recall: float = 0.95
    k: int = 20
    block_rows: int = 16_384


@dataclass
class Index:
    codebooks: tuple[np.ndarray, np.ndarray]
    share: float
    counts: np.ndarray  # rows of each cell
    first_block: np.ndarray  # of each cell
    splits: np.ndarray  # blocks of each cell
    rows: DataFrame  # vec_id, vec, cell, block

    @property
    def dim(self) -> int:
        return self.codebooks[0].shape[1] + self.codebooks[1].shape[1]


def usable(vec: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1) - 2 * x @ book.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    book = x[np.random.default_rng(0).permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, book)
        size = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        book[size > 0] = total[size > 0] / size[size > 0, None]
    return book


def walk(one: np.ndarray, two: np.ndarray, counts: np.ndarray, wanted: float) -> float:
    """The summed distance up to which cells must be seen to hold `wanted` rows: the multi-sequence walk with a heap."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    x, y, k = one[a].tolist(), two[b].tolist(), len(two)
    rows = counts.reshape(len(one), k)[a][:, b].tolist()
    heap, seen, reached = [(x[0] + y[0], 0, 0)], 0, -np.inf
    while heap and seen < wanted:
        reached, i, j = heapq.heappop(heap)
        seen += rows[i][j]
        if j + 1 < k:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return reached


def fit(sample: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Codebooks of the halves, of at most k centroids, and the share of rows to see for s.recall on the sample."""
    half = max(1, sample.shape[1] // 2)
    one, two = k_means(sample[:, :half], k, s.rounds), k_means(sample[:, half:], k, s.rounds)
    cell = nearest(sample[:, :half], one) * len(two) + nearest(sample[:, half:], two)
    counts = np.bincount(cell, minlength=len(one) * len(two))
    need = []
    for q in np.linspace(0, len(sample) - 1, min(s.sample_queries, len(sample))).astype(int):
        sims = sample @ sample[q]
        sims[q] = -np.inf
        best = np.argsort(-sims)[: min(s.k, len(sample) - 1)]
        d = -((one @ sample[q, :half])[:, None] + (two @ sample[q, half:])[None, :]).ravel()
        order = np.argsort(d)
        held = np.empty(len(d))
        held[order] = np.cumsum(counts[order])
        need += (held[cell[best]] / len(sample)).tolist()
    return one, two, float(np.quantile(need, s.recall)) if need else 1.0


def build(embeddings: DataFrame, s: Settings = Settings()) -> Index | None:
    """Index embeddings (vec_id, embedding array<float>). Rows with a null vec_id or an unusable vector take no part, nor do
    vectors of another length than most (ties: the longer). Repeated rows are rows of their own. None without rows."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None
    dim, total = sizes[0]["d"], sizes[0]["count"]
    k = min(s.centroids, max(8, int((total / s.cell_rows) ** 0.5)))
    rows = rows.filter(F.size("vec") == dim)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [vectors(b.column("vec"), dim).astype(np.float64) for b in batches if b.num_rows]:
            one, two, share = fit(np.concatenate(got), k, s)
            yield pa.RecordBatch.from_pydict({"one": [one.tobytes()], "two": [two.tobytes()], "share": [share]})

    picked = rows.withColumn("_h", F.xxhash64("vec_id")).orderBy("_h", "vec_id", "vec").limit(s.sample_rows).select("vec").coalesce(1)
    got = picked.mapInArrow(fitted, "one binary, two binary, share double").collect()[0]
    half = max(1, dim // 2)
    one = np.frombuffer(got["one"]).reshape(-1, half)
    two = np.frombuffer(got["two"]).reshape(len(one), -1)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors(b.column("vec"), dim).astype(np.float64)
            cell = nearest(x[:, :half], one) * len(two) + nearest(x[:, half:], two)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    kind = rows.schema["vec"].dataType.simpleString()
    indexed = cut(rows.mapInArrow(celled, f"vec_id long, vec {kind}, cell int"))
    counts = np.zeros(len(one) * len(two), np.int64)
    for cell, n in indexed.groupBy("cell").count().collect():
        counts[cell] = n
    splits = np.maximum(-(-counts // s.block_rows), 1)
    first, at, room = np.zeros(len(counts), np.int64), 0, s.block_rows
    for c, n in enumerate(counts.tolist()):  # cells go to blocks in order; a split cell has blocks of its own
        if n > room or splits[c] > 1:
            at, room = at + (room < s.block_rows), s.block_rows
        first[c], room = at, room - n
        if splits[c] > 1:
            at, room = at + int(splits[c]), s.block_rows
    place = spark.createDataFrame([(c, int(first[c]), int(splits[c])) for c in np.flatnonzero(counts).tolist()], "cell int, first int, splits int")
    blocked = indexed.join(F.broadcast(place), "cell").select("vec_id", "vec", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int")).alias("block"))
    return Index((one, two), got["share"], counts, first, splits, blocked)


def search(index: Index, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """queries (query_id long, vec) -> query_id, rank, vec_id, score: at most s.k rows a query, best first, ties to the
    smaller vec_id. A row whose vec_id is the query's own is not a candidate."""
    one, two = index.codebooks
    half, dim, counts = one.shape[1], index.dim, index.counts
    wanted, total = index.share * counts.sum(), int(counts.sum())
    last = index.first_block + index.splits - 1
    filled = np.flatnonzero(counts)
    kind = index.rows.schema["vec"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = vectors(b.column("vec"), dim).astype(np.float64)
            source, block, reach = [], [], []
            for i, x in enumerate(q):
                d1, d2 = -(one @ x[:half]), -(two @ x[half:])
                far = walk(d1, d2, counts, min(max(wanted, s.k + 1), total))
                seen = filled[(d1[:, None] + d2[None, :]).ravel()[filled] <= far + 1e-12]
                to = sorted({p for a, z in set(zip(index_first[seen].tolist(), index_last[seen].tolist())) for p in range(a, z + 1)})
                source += [i] * len(to)
                block += to
                reach += [far] * len(to)
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(source, pa.int64())), b.column("vec").take(pa.array(source, pa.int64())), pa.array(reach, pa.float64()), pa.array(block, pa.int32())], ["query_id", "vec", "reach", "block"])

    index_first, index_last = index.first_block, last
    asked = queries.select("query_id", "vec").mapInArrow(spread, f"query_id long, vec {kind}, reach double, block int")

    def score(block: tuple[np.ndarray, ...], own: np.ndarray, q: np.ndarray, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, x, cell = block
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            far = -((part[:, :half] @ one.T)[:, cell // len(two)] + (part[:, half:] @ two.T)[:, cell % len(two)])
            sims = part @ x.T
            sims[(far > reach[a : a + 256, None] + 1e-9) | (own[a : a + 256, None] == ids[None, :])] = -np.inf
            least = np.partition(sims, -s.k, axis=1)[:, -s.k] if len(ids) > s.k else np.full(len(part), -np.inf)
            i, j = np.nonzero((sims >= (least - 1e-9)[:, None]) & (sims > -np.inf))
            exact = np.zeros(len(i))
            for d in range(dim):  # one order of additions, whatever the block: equal vectors get equal scores
                exact += part[i, d] * x[j, d]
            order = np.lexsort((ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < s.k
            yield pa.RecordBatch.from_arrays([pa.array(own[a + i[top]]), pa.array(ids[j[top]]), pa.array(exact[top])], ["query_id", "vec_id", "score"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and queries in the order of blocks, a block's rows before its queries."""
        at, held, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            block, cell = b.column("block").to_numpy(), b.column("cell").to_numpy()
            ids, x, reach = b.column("id").to_numpy(), vectors(b.column("vec"), dim).astype(np.float64), b.column("reach").to_numpy()
            edge = np.flatnonzero((block[1:] != block[:-1]) | ((cell[1:] < 0) != (cell[:-1] < 0))) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(block)]):
                if block[i] != at:
                    at, held, ready = block[i], [], None
                if cell[i] >= 0:
                    held.append((ids[i:j], x[i:j], cell[i:j]))
                elif held:
                    ready = ready or tuple(np.concatenate(c) for c in zip(*held))
                    yield from score(ready, ids[i:j], x[i:j], reach[i:j])

    rows = index.rows.select("block", "cell", F.col("vec_id").alias("id"), "vec", F.lit(0.0).alias("reach"))
    both = rows.unionByName(asked.select("block", F.lit(-1).alias("cell"), F.col("query_id").alias("id"), "vec", "reach"))
    near = both.repartition("block").sortWithinPartitions("block", F.col("cell") < 0, "id").mapInArrow(ranked, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 20, s: Settings = Settings()) -> DataFrame:
    """The s.k nearest of every row whose vec_id is divisible by `every`; no rows for an empty table.

    A repeated vec_id is one query, with the smallest of its vectors (component by component from the first); its rows are
    candidates of other queries alone, each by itself."""
    index = build(embeddings, s)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = index.rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    return search(index, asked, s)
