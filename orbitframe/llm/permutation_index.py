"""Approximate nearest neighbours by a permutation index with pivot inverted files (operator 8)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize


def _orders(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first (ties to the smaller number)."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :depth]


class Shard:
    """Vectors posted in the inverted files of their nearest pivots, with the pivot's rank for each.

    Footrule distance tells directions only. A line fitted on some of the shard's own vectors turns it into an expected
    cosine, which times a vector's length is the inner product that candidates are ranked by.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, depth: int, fitted: int = 24):
        self.ids, self.vectors, self.depth = ids, vectors, depth
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = _orders(vectors, pivots, depth)
        owner, pivot = np.repeat(np.arange(len(ids)), order.shape[1]), order.ravel()
        rank = np.tile(np.arange(order.shape[1]), len(ids))
        by = np.argsort(pivot, kind="stable")
        self.owner, self.rank = owner[by], rank[by].astype(np.int16)
        self.starts = np.searchsorted(pivot[by], np.arange(len(pivots) + 1))
        some = np.unique(np.linspace(0, len(ids) - 1, min(fitted, len(ids))).astype(int))
        near = np.concatenate([self._near(order[i]) for i in some])
        cosine = np.concatenate([self.vectors @ (vectors[i] / self.lengths[i]) / self.lengths for i in some])
        spread = near.var()
        self.slope = ((near - near.mean()) * (cosine - cosine.mean())).mean() / spread if spread else 1.0
        self.level = cosine.mean() - self.slope * near.mean()

    def _near(self, order: np.ndarray) -> np.ndarray:
        """Footrule closeness of each vector: a shared pivot gives depth - |difference of ranks|, a missing one nothing."""
        lists = [slice(self.starts[p], self.starts[p + 1]) for p in order]
        at = np.concatenate([self.owner[s] for s in lists])
        saved = np.concatenate([self.depth - np.abs(self.rank[s] - np.int16(r)) for r, s in enumerate(lists)])
        return np.bincount(at, weights=saved, minlength=len(self.ids))

    def places(self, query: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, scores, places) of the k truly best: what share of the shard's vectors is ranked before each."""
        expected, exact = (self.level + self.slope * self._near(order)) * self.lengths, self.vectors @ query
        best = np.lexsort((self.ids, -exact))[:k]
        before = np.searchsorted(np.sort(-expected), -expected[best], side="right")
        return self.ids[best], exact[best], before / len(self.ids)

    def search(self, query: np.ndarray, order: np.ndarray, share: float, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best: posted vectors are ranked by expected inner product, the first share reranked."""
        expected = (self.level + self.slope * self._near(order)) * self.lengths
        keep = min(len(self.ids), max(least, math.ceil(share * len(self.ids))))
        chosen = np.argpartition(-expected, keep - 1)[:keep] if keep < len(self.ids) else np.arange(len(self.ids))
        rough = self.vectors[chosen] @ query
        if len(chosen) > 4 * k:
            chosen = chosen[np.argpartition(-rough, 4 * k - 1)[: 4 * k]]
        exact = (self.vectors[chosen] * query).sum(axis=1)
        best = np.lexsort((self.ids[chosen], -exact))[:k]
        return self.ids[chosen][best], exact[best]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, n, k1, k2, v) of the rows that take part: no null, zero or non-finite vector; k1, k2 name equal vectors."""
    df = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("v")).where("id IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    df = df.select("id", F.struct(F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(8), "v").alias("k2"), "v").alias("x"))
    return df.groupBy("id").agg(F.min("x").alias("x")).select("id", F.size("x.v").alias("n"), "x.k1", "x.k2", "x.v")


def _shards(batches, pivot: np.ndarray, depth: int):
    """(shard, ids, query vectors) of sorted batches: each shard's vectors come first and are indexed, then the queries."""
    now, ids, parts, built = None, [], [], None
    for batch in batches:
        shard, block, kind, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        values = batch.column(4)
        grid = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        group = shard.astype(np.int64) << 32 | block
        edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]), True])
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            if group[at] != now:
                now, ids, parts, built = group[at], [], [], None
            if kind[at] == 0:
                ids.append(own[at:to].copy())
                parts.append(grid[at:to].copy())
                continue
            if built is None and ids:
                built = Shard(np.concatenate(ids), np.concatenate(parts), pivot, depth)
                ids, parts = [], []
            if built is not None:
                yield built, own[at:to], grid[at:to]


def _meet(few: DataFrame, asked: DataFrame, shards: int, blocks: int, answer, schema: str) -> DataFrame:
    """Rows that ``answer(shard, query id, query)`` makes where every shard of few (id, v) meets every query of asked (id, v).

    The grid of shards and blocks of queries is one task a field: vectors are sent once per block, queries once per shard.
    """
    spot = lambda of, n, salt: F.pmod(F.xxhash64(F.lit(salt), of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = few.select(spot("id", shards, 1).alias("shard"), "id", "v").select("shard", every(blocks).alias("block"), F.lit(0).alias("kind"), "id", "v")
    sent = asked.select(spot("id", blocks, 3).alias("block"), "id", "v").select(every(shards).alias("shard"), "block", F.lit(1).alias("kind"), "id", "v")
    met = index.unionByName(sent).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "kind", "id")
    return met.mapInArrow(answer, schema)


def measured_share(few: DataFrame, asked: DataFrame, pivot: np.ndarray, depth: int, shards: int, k: int, recall: float, sample: int) -> float:
    """The share of each shard that has to be reranked for the recall, measured against brute force.

    For at most ``sample`` queries, chosen by hash, every shard tells its truly best vectors and where its own ranking puts
    them; of those among the query's k best of all, the wanted part must lie within the share.
    """
    shared = few.sparkSession.sparkContext.broadcast(pivot)

    def run(batches):
        for shard, own, grid in _shards(batches, shared.value, depth):
            for i, order in enumerate(_orders(grid, shared.value, depth)):
                ids, scores, places = shard.places(grid[i], order, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), own[i])), pa.array(ids), pa.array(scores), pa.array(places)], names=["query_id", "vec_id", "score", "place"])

    some = materialize(asked.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(sample), "sampled-queries")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _meet(few, some, shards, 1, run, "query_id long, vec_id long, score double, place double").where("query_id <> vec_id")
    rows = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("place").collect()  # at most sample * k
    places = np.sort([r["place"] for r in rows])
    return float(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) if len(places) else 1.0


def nearest(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, pivots: int = 256, depth: int = 64, share: float | None = None, recall: float = 0.95, sample: int = 64, shard_rows: int = 65_536, block_rows: int = 131_072, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors found nearest to each query, itself left out, nearest first.

    Nearness is the largest inner product in double precision, ties to the smaller id. ``queries`` defaults to the rows
    whose id is divisible by ``every``. ``pivots`` vectors chosen by hash (a bounded sample) order the space; a vector is
    represented by its ``depth`` nearest pivots in order and posted in their inverted files. Shards of at most about
    ``shard_rows`` vectors are indexed by one task each; queries stream past every shard in blocks of ``block_rows``, read
    their own pivots' files there, rank what is posted by footrule distance and rerank the best ``share`` by the true
    measure. The shards' answers are merged per query.

    How much must be reranked depends on the vectors: little where they cluster, most of them in many dimensions without
    structure. So ``share`` is measured, on ``sample`` queries against brute force, to reach ``recall``; give it to skip
    that. A share of 1 is exact.

    Of equal vectors only the k + 1 smallest ids can be among any answer, so large groups of copies shrink to those, and
    equal queries are searched once. Rows with null id, or null, zero or non-finite vectors take no part, nor do vectors of
    another number of components than most have (equally many: the smaller number). Of rows that repeat an id, the vector
    least by hash counts. With fewer than k candidates all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col), "vectors")
    usual = rows.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.col("n") == (usual["n"] if usual else 0))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0) if queries is None else usable(queries, id_col, vec_col).where(F.col("n") == (usual["n"] if usual else 0))
    asked = materialize(asked.select("id", "k1", "k2", "v"), "queries")
    few = rows.withColumn("n", F.row_number().over(W.partitionBy("k1", "k2").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    few = materialize(few, "distinct-vectors")
    total = few.count()
    step = max(1, total // (4 * pivots))
    seeds = few.where(F.pmod("k2", F.lit(step)) == 0).dropDuplicates(["k1", "k2"]).orderBy("k1", "k2").select("v").limit(pivots).collect()
    table = np.array([r["v"] for r in seeds], np.float64)
    if len(table):
        table /= np.sqrt((table * table).sum(axis=1, keepdims=True))
    depth = min(depth, len(table))
    # one query for all that are equal: that of the smallest id
    names = asked.groupBy("k1", "k2").agg(F.min("id").alias("once"))
    once = materialize(asked.join(names, ["k1", "k2"]).where("id = once").select("id", "v").dropDuplicates(["id"]), "distinct-queries")
    shards = max(1, math.ceil(total / shard_rows), min(spark.sparkContext.defaultParallelism, math.ceil(total / 8192)))
    if share is None and total:
        share = measured_share(few.select("id", "v"), once, table, depth, shards, k, recall, sample)
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        names = ["once", "vec_id", "score"]
        for shard, own, grid in _shards(batches, shared.value, depth):
            out = []
            for i, order in enumerate(_orders(grid, shared.value, depth)):
                found, scores = shard.search(grid[i], order, share, 4 * k, k + 1)
                out.append((np.full(len(found), own[i]), found, scores))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    found = _meet(few.select("id", "v"), once, shards, max(1, math.ceil(once.count() / block_rows)), run, "once long, vec_id long, score double")
    best = W.partitionBy("once").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    answers = asked.join(names, ["k1", "k2"]).select(F.col("id").alias("query_id"), "once").distinct().join(found, "once").where("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
