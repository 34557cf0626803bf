"""Vector tables: upserts, checks, exact and approximate nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_valid_vector

#: Queries in one matrix product, and most queries that are broadcast, under 20 MB of 1,024 floats.
BLOCK, BROADCAST_QUERIES = 256, 4096
#: Vectors of one shard where queries are too many to broadcast.
SHARD = 20_000


def upsert_vectors(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store with the batch's last vector of each id; (memory_id, vec), the batch with order column ``o``."""
    last = batch.groupBy("memory_id").agg(F.max_by("vec", "o").alias("vec"))
    return store.join(last.select("memory_id"), "memory_id", "left_anti").unionByName(last)


def append_problems(store: DataFrame, batch: DataFrame, size: int) -> DataFrame:
    """(memory_id, problem): why a batch may not be appended; no row if it may."""
    again = batch.groupBy("memory_id").count().where("count > 1").select("memory_id", F.lit("repeated").alias("problem"))
    known = batch.join(store.select("memory_id"), "memory_id", "left_semi").select("memory_id", F.lit("exists").alias("problem"))
    bad = batch.where(~is_valid_vector(F.col("vec"), size)).select("memory_id", F.lit("invalid").alias("problem"))
    return again.unionByName(known).unionByName(bad).distinct()


def append_vectors(store: DataFrame, batch: DataFrame, size: int) -> DataFrame:
    """The store with the whole batch, or as it was if anything is wrong with it."""
    wrong = append_problems(store, batch, size).limit(1).agg((F.count(F.lit(1)) > 0).alias("__wrong"))
    good = batch.join(F.broadcast(wrong)).where(~F.col("__wrong")).drop("__wrong")
    return store.unionByName(good.select(*store.columns))


def remove_vectors(store: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store without ``ids``, and those ids that it did not have."""
    return store.join(ids.select("memory_id"), "memory_id", "left_anti"), ids.join(store.select("memory_id"), "memory_id", "left_anti")


def pending_backfill(memories: DataFrame, state: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Memories that are not done yet, in order of id."""
    rows = memories if force else memories.join(state.where("status = 'completed'").select("memory_id"), "memory_id", "left_anti")
    return rows.orderBy("memory_id").limit(limit) if limit else rows


def _matrix(ids: pa.Array, lists: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and finite vectors of one length (``size``, else the first one's), without a Python object for each number."""
    lengths = pc.list_value_length(lists).fill_null(-1)
    size = size or next((n for n in lengths.to_pylist() if n > 0), 0)
    fits = pc.equal(lengths, size)
    m = lists.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(size, 1))
    good = np.isfinite(m).all(axis=1)
    return ids.filter(fits).to_numpy(zero_copy_only=False)[good], m[good]


def _nearest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, min_score: float | None, distance: bool = False, tables: int = 0) -> Iterator[pa.RecordBatch]:
    """The k nearest of ``m`` for each query, equal scores by id; as cosine distances of six digits, if asked for.

    With ``tables``, so many bucket numbers stand before the entries of a vector: only pairs with an equal one count, by 1 less half the squared distance.
    """
    (qb, q), (mb, m) = ((x[:, :tables], x[:, tables:]) for x in (q, m))
    if distance:
        q, m = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (q, m))
    for a in range(0, len(q) if len(m) else 0, BLOCK):
        scores = q[a : a + BLOCK] @ m.T
        if tables:
            scores += 1 - ((q[a : a + BLOCK] ** 2).sum(axis=1)[:, None] + (m**2).sum(axis=1)) / 2
            shared = np.zeros(scores.shape, bool)
            for t in range(tables):
                shared |= qb[a : a + BLOCK, t, None] == mb[:, t]
            scores[~shared] = -np.inf
        if distance:
            scores = -np.round(1 - scores, 6)
        last = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if scores.shape[1] > k else np.full((len(scores), 1), -np.inf)
        if min_score is not None:
            last = np.maximum(last, min_score)
        row, at = np.nonzero((scores >= last) & (scores > -np.inf))
        s = scores[row, at]
        order = np.lexsort((ids[at], -s, row))
        row, at, s = row[order], at[order], s[order]
        n = np.arange(len(row)) - np.searchsorted(row, row)
        keep = n < k
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[a + row[keep]]), pa.array(ids[at[keep]]), pa.array(0.0 - s[keep] if distance else s[keep])], ["query_id", "vec_id", "score"])


def knn(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, size: int | None = None, distance: bool = False, by: Sequence[str] = (), tables: int = 0) -> DataFrame:
    """Exact neighbours: (query_id, vec_id, score, rank) by inner product, or by cosine ``distance``, the smallest first.

    Up to BROADCAST_QUERIES queries go out to one scan of the vectors; each Arrow batch of vectors is a matrix product that
    keeps k rows for each query, equal scores by id, and only those shuffle.  More queries, or queries that meet the vectors
    of their own ``by`` columns only (an owner, say), are dealt into blocks and vectors into shards, and each block meets
    each shard in a group of bounded size.  Vectors of another length or not finite are left out.  ``tables``: as in ``_nearest``.
    """
    schema = "query_id long, vec_id long, score double"
    q = queries.select(F.col("query_id").cast("long"), F.col("vec").cast("array<float>").alias("vec"), *by)
    v = vectors.select(F.col("vec_id").cast("long"), F.col("vec").cast("array<float>").alias("vec"), *[F.col(c).alias(c) for c in by])
    first = None if by else q.limit(BROADCAST_QUERIES + 1).toArrow().combine_chunks()
    if first is not None and first.num_rows <= BROADCAST_QUERIES:
        batch = first.to_batches()[0] if first.num_rows else None
        shared = vectors.sparkSession.sparkContext.broadcast(_matrix(batch.column(0), batch.column(1), size) if batch else (np.zeros(0, np.int64), np.zeros((0, 1))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            for batch in batches:
                if len(ids):
                    yield from _nearest(ids, m, *_matrix(batch.column(0), batch.column(1), m.shape[1]), k, min_score, distance, tables)

        found = v.mapInArrow(scan, schema)
    else:
        # as many blocks of queries and shards of vectors as an owner's rows need, or all rows
        parts = lambda df, most, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
        sizes = parts(q, BROADCAST_QUERIES, "__nb").join(parts(v, SHARD, "__ns"), list(by)) if by else parts(q, BROADCAST_QUERIES, "__nb").crossJoin(parts(v, SHARD, "__ns"))
        with_sizes = lambda df: df.join(sizes, list(by)) if by else df.crossJoin(F.broadcast(sizes))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = with_sizes(q).withColumn("__b", F.pmod(F.xxhash64("query_id"), "__nb")).where("__ns > 0").withColumn("__s", every("__ns")).drop("__nb", "__ns")
        right = with_sizes(v).withColumn("__s", F.pmod(F.xxhash64("vec_id"), "__ns")).where("__nb > 0").withColumn("__b", every("__nb")).drop("__nb", "__ns")
        keys = ["__b", "__s", *by]

        def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            sides = [_matrix(t.column(i).combine_chunks(), t.column("vec").combine_chunks(), size) for t, i in ((a, "query_id"), (b, "vec_id"))] if a.num_rows and b.num_rows else None
            found = list(_nearest(*sides[0], *sides[1], k, min_score, distance, tables)) if sides else []
            return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score") if distance else F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieval_k(top_k: int) -> int:
    return min(3 * top_k, 100)


def approx_knn(queries: DataFrame, vectors: DataFrame, k: int, bucket: float = 1.0, tables: int = 4, radius: float = 1.5) -> DataFrame:
    """Neighbours by random projections: candidates share a bucket in one of the tables; scores are exact.

    For unit vectors the squared distance is 2 - 2 cos.  Wide buckets, which recall needs, hold a large part of all vectors, so
    candidate pairs are not written: a vector travels with its bucket numbers, and where queries meet vectors as in ``knn``, pairs
    without a bucket in common are left out.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v, q = (df.select(key, "vec", array_to_vector("vec").alias("features")) for df, key in ((vectors, "vec_id"), (queries, "query_id")))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(v)
    buckets = F.concat(*[vector_to_array(F.get("hashes", F.lit(t)), "float32") for t in range(tables)])
    placed = lambda df, key: model.transform(df).select(key, F.concat(buckets, F.col("vec").cast("array<float>")).alias("vec"))
    near = knn(placed(q, "query_id"), placed(v, "vec_id"), k, tables=tables)
    return near.where(F.col("score") > 1 - radius * radius / 2)


def embed_texts(df: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """Unit vectors of hashed, IDF-weighted words: the embedder that needs no model file."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.select(key, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+").alias("words"))
    stages = [HashingTF(inputCol="words", outputCol="tf", numFeatures=size), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="unit")]
    return Pipeline(stages=stages).fit(words).transform(words).select(key, vector_to_array("unit", "float32").alias("vec"))


def embed_with(df: DataFrame, key: str, text: str, embed) -> DataFrame:
    """Vectors of a user's function from a list of texts to a matrix, one Arrow batch at a time, scaled to length 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.asarray(embed(batch[text].fillna("").tolist()), np.float32)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({key: batch[key], "vec": list(m)})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, vec array<float>")
