"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``LENGTH`` nearest pivots.  The index posts every
vector in the inverted file of each of these pivots, with its place in the order; a quarter
of all vectors is in each file, so a file is an array of places.  A query reads the
files of its own pivots, ranks the vectors by truncated footrule distance, and reranks the
best by the exact inner product in double precision.  Index and queries are cut into blocks
of bounded size that meet in an equi-join on the block number; the best of all blocks are
merged by a windowed top-k.  A query visits every block: neighbours of directions in many
dimensions are spread over most pivots.

Pivots come from a bounded sample; every valid row is indexed, none is capped.  Defined
results: rows whose id or vector is null, or whose vector is zero, empty, of another length
than most of the sample, or has a null or non-finite component, take no part; rows
with the query's own id aren't its neighbours; equal scores go to the smaller id; rows that
repeat id and vector count once, as queries and as candidates; an id with several vectors is a
candidate with each, and asks with all of them for one common list; an empty table has no
answers; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.decontam import ranges

PIVOTS, LENGTH, BLOCK, QUERY_BLOCK = 256, 64, 4096, 1024
#: Rows that a block reranks for a query, best by footrule first.
RERANK = 1024
MOST_TASKS = 20_000


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    near = x @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :length]


def spread_out(x: np.ndarray, most: int, closest: float = 0.7) -> np.ndarray:
    """The first rows that aren't close to one taken before; a common vector gives one pivot."""
    taken = [0]
    for i in range(1, len(x)):
        if len(taken) == most:
            break
        if (x[taken] @ x[i]).max() < closest:
            taken.append(i)
    rest = [i for i in range(len(x)) if i not in set(taken)]
    return x[(taken + rest)[:most]]


class Block:
    """The inverted files of one block of vectors; equal vectors are posted once, with all their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, length: int):
        x, owner = np.unique(x.astype(np.float64), axis=0, return_inverse=True)
        named = np.unique(np.stack([owner.ravel().astype(np.int64), ids.astype(np.int64)], 1), axis=0)
        self.ids, self.first = named[:, 1].copy(), np.searchsorted(named[:, 0], np.arange(len(x) + 1))
        self.columns = np.ascontiguousarray(x.T)
        order = orders(x, pivots, length)
        #: for each pivot, ``length`` less the vector's place, 0 for vectors that aren't posted
        self.files = np.zeros((len(pivots), len(x)), np.uint8)
        self.files[order.T, np.arange(len(x))[None, :]] = np.arange(length, 0, -1, dtype=np.uint8)[:, None]

    def search(self, key: int, q: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for one query."""
        n, length = self.columns.shape[1], len(order)
        take = max(RERANK, k)
        if n > take + 1:
            # the footrule distance falls by twice the smaller of both weights for each shared pivot
            near, shared = np.zeros(n, np.uint16), np.empty(n, np.uint8)
            for place, p in enumerate(order.tolist()):
                np.minimum(self.files[p], np.uint8(length - place), out=shared)
                near += shared
            rows = np.argpartition(near, n - take - 1)[n - take - 1 :]
        else:
            rows = np.arange(n)
        score = np.zeros(len(rows))
        for column, v in zip(self.columns, q.tolist(), strict=True):
            score += column[rows] * v
        # the k-th best vector bounds the scores that count; the query's own id may be one of them
        if len(rows) > k + 1:
            good = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            rows, score = rows[good], score[good]
        copies = self.first[rows + 1] - self.first[rows]
        ids = self.ids[ranges(self.first[rows], copies)]
        score = np.repeat(score, copies)
        other = ids != key
        ids, score = ids[other], score[other]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def valid(id_col: str, vec_col: str) -> Column:
    """Whether a row takes part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row that ``is_query`` picks."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = vectors.where(valid(id_col, vec_col)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    if not n or not n_queries:
        return empty
    # at most 8 * PIVOTS rows, by a hash of the vector
    hashed = F.xxhash64("v")
    some = rows.select("v", hashed.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(min(1.0, 4 * PIVOTS / n) * (1 << 30)) + 1)).limit(8 * PIVOTS).collect()
    if len(some) < min(n, PIVOTS):
        some = rows.select("v", hashed.alias("h")).limit(8 * PIVOTS).collect()
    size = Counter(len(r.v) for r in some).most_common(1)[0][0]
    sample = np.unique(np.array([r.v for r in some if len(r.v) == size], np.float64), axis=0)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    pivots = spread_out(sample[np.random.default_rng(5).permutation(len(sample))], PIVOTS)
    length = min(LENGTH, len(pivots))
    n_blocks, n_query_blocks = -(-n // BLOCK), -(-n_queries // QUERY_BLOCK)
    rows = rows.where(F.size("v") == size)

    def vectors_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        return t.column("id").to_numpy(), flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)

    def index(key: tuple, t: pa.Table) -> pa.Table:
        ids, x = vectors_of(t)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "files": pa.array([pickle.dumps(Block(ids, x, pivots, length))], pa.binary())})

    def queries(key: tuple, t: pa.Table) -> pa.Table:
        ids, x = vectors_of(t)
        # repeated rows ask once
        named = np.unique(np.concatenate([ids.view(np.float64)[:, None], x], 1).view(np.int64), axis=0, return_index=True)[1] if len(ids) else np.zeros(0, np.int64)
        ids, x = ids[named], x[named]
        return pa.table({"queries": pa.array([pickle.dumps((ids, x, orders(x, pivots, length).astype(np.int16)))], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, None
        for batch in batches:
            for b, files, asked in zip(*(batch.column(c) for c in ("block", "files", "queries")), strict=True):
                if number != b.as_py():
                    block, number = pickle.loads(files.as_py()), b.as_py()
                found = [(key, *block.search(key, q, order, k)) for key, q, order in zip(*pickle.loads(asked.as_py()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    spread = F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks))
    # a block for a task: they are few, and each is work enough
    tasks = min(2 * n_blocks, MOST_TASKS)
    indexed = rows.select("id", "v", spread.alias("block")).repartition(tasks, "block").groupBy("block").applyInArrow(index, "block bigint, files binary")
    asked = (
        rows.where("q").select("id", "v", F.pmod(F.xxhash64("v", "id"), F.lit(n_query_blocks)).alias("part"))
        .groupBy("part").applyInArrow(queries, "queries binary")
        .select("queries", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block"))
    )
    found = indexed.join(asked.repartition(tasks, "block"), "block").select("block", "files", "queries").mapInArrow(meet, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
