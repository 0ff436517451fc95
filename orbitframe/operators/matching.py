"""One-to-one matches of instances, and what follows from them: metrics and change."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import written as _written
from .regions import min_label


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest total score, by shortest augmenting paths with potentials."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        best, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, last, so_far = row, -1, 0.0
        while True:
            reach = so_far + cost[at] - row_price[at] - col_price
            better = ~done & (reach < best)
            best[better], via[better] = reach[better], last
            last = int(np.argmin(np.where(done, np.inf, best)))
            so_far = best[last]
            done[last] = True
            if owner[last] < 0:
                break
            at = owner[last]
        row_price[row] += so_far
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                row_price[owner[j]] += so_far - best[j]
            col_price[j] -= so_far - best[j]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else row
            last = before
    return sorted((j, int(i)) if flip else (int(i), j) for j, i in enumerate(owner) if i >= 0)


def assign_sparse(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b, score) of the matching with the largest total score, by augmenting paths over the edges.

    Each node of a in turn takes the path of least reduced cost to a free node of b, or to staying alone, by Dijkstra's
    search with potentials; it ends at the first free node, so a long chain costs what its paths cost. Memory follows the
    edges; no matrix is made.
    """
    rows, row_of = np.unique(a, return_inverse=True)
    cols, col_of = np.unique(b, return_inverse=True)
    out: list[list[tuple[int, float, int]]] = [[] for _ in rows]
    for e, (i, j, w) in enumerate(zip(row_of.tolist(), col_of.tolist(), score.tolist(), strict=True)):
        out[i].append((j, -w, e))
    row_price, col_price, owner = [0.0] * len(rows), [0.0] * len(cols), [-1] * len(cols)
    taken = [-1] * len(rows)  # the edge of each row, -1 alone
    for row in range(len(rows)):
        best, via, heap, done, order = {}, {}, [], set(), []
        at, so_far, alone, alone_row = row, 0.0, np.inf, row
        while True:
            if so_far - row_price[at] < alone:
                alone, alone_row = so_far - row_price[at], at
            for j, cost, e in out[at]:
                reach = so_far + cost - row_price[at] - col_price[j]
                if j not in done and reach < best.get(j, np.inf):
                    best[j], via[j] = reach, (at, e)
                    heapq.heappush(heap, (reach, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                so_far, last = alone, -1
                break
            so_far, last = heapq.heappop(heap)
            done.add(last)
            order.append(last)
            if owner[last] < 0:
                break
            at = owner[last]
        row_price[row] += so_far
        for j in order:
            gain = so_far - best[j]
            if owner[j] >= 0:
                row_price[owner[j]] += gain
            col_price[j] -= gain
        if last < 0:  # the path ends where a row lets its column go
            last = next((j for j in order if owner[j] == alone_row), -1)
            taken[alone_row] = -1
        while last >= 0:
            i, e = via[last]
            before = next((j for j in order if owner[j] == i), -1) if i != row else -1
            owner[last], taken[i], last = i, e, before
    return np.array([e for e in taken if e >= 0], np.int64)


def settled_pairs(edges: DataFrame, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(pairs that some best matching holds, edges left over): a pair that weighs at least as much as the best other edges of
    both its nodes together can always be exchanged in. Settled nodes leave, so others may settle in the next round."""
    chosen, left = None, _written(edges)
    for _ in range(rounds):
        found = left
        for side, key in (("x", "a"), ("y", "b")):
            top = W.partitionBy(key).orderBy(F.desc("iou"), "a", "b")
            found = found.withColumn(f"__n{side}", F.row_number().over(top)).withColumn(side, F.coalesce(F.lead("iou").over(top), F.lit(0.0)))
        pairs = _written(found.where((F.col("__nx") == 1) & (F.col("__ny") == 1) & (F.col("iou") >= F.col("x") + F.col("y"))).select("a", "b", "iou"))
        if pairs.isEmpty():
            break
        chosen = pairs if chosen is None else chosen.unionByName(pairs)
        left = _written(left.join(pairs.select("a"), "a", "left_anti").join(pairs.select("b"), "b", "left_anti"))
    return (left.limit(0) if chosen is None else chosen), left


def one_to_one_match(edges: DataFrame, least: float = 0.3, most_pairs: bool = False) -> DataFrame:
    """(a, b, iou): of overlaps (a, b, iou), the assignment with the largest total, then only pairs of at least ``least``.

    With ``most_pairs`` only overlaps of at least ``least`` count, and of the assignments with the most pairs that with the
    largest total. Pairs that are best beyond doubt, such as all above one half where neither side overlaps itself, are
    settled in distributed rounds. What is left falls into connected clusters, each assigned by itself over its edges
    (``assign_sparse``): a cluster of n nodes and m edges takes memory for m and at most n searches of m log m. The names of
    both sides are independent numbers; of repeated pairs the largest overlap counts.
    """
    near = edges.where(F.col("iou") >= least if most_pairs else F.col("iou") > 0).groupBy("a", "b").agg(F.max("iou").cast("double").alias("iou"))
    settled, near = (near.limit(0), _written(near)) if most_pairs else settled_pairs(near)
    labels = min_label(near.select((2 * F.col("a")).alias("u"), (2 * F.col("b") + 1).alias("v")))
    groups = near.join(labels, 2 * near["a"] == labels["node"]).select("label", "a", "b", "iou")

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["a", "b", "iou"]).sort_by([("a", "ascending"), ("b", "ascending")])
        a, b, iou = (table.column(n).to_numpy() for n in ("a", "b", "iou"))
        return table.take(pa.array(np.sort(assign_sparse(a, b, iou + len(iou) if most_pairs else iou))))

    found = groups.groupBy("label").applyInArrow(run, "a long, b long, iou double")
    return settled.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "iou").unionByName(found).where(F.col("iou") >= least)


def _counts(truth: DataFrame, found: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_a, n_b, matched, mean_iou); truth and found have (by, id, area), matches (by, a, b, iou)."""
    side = lambda df, n: df.groupBy(*by).agg(F.count("*").alias(n), F.sum("area").alias(f"{n}_area"))
    both = matches.groupBy(*by).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    out = side(truth, "n_a").join(side(found, "n_b"), by, "full").join(both, by, "left")
    return out.fillna(0, ["n_a", "n_b", "n_a_area", "n_b_area", "matched"]).fillna(0.0, ["mean_iou"])


def instance_metrics(truth: DataFrame, found: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of instances, mean IoU of the matched, and errors of the count."""
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    m, a, b = F.col("matched"), F.col("n_a"), F.col("n_b")
    off = F.abs(b - a)
    return _counts(truth, found, matches, by).select(
        *by, safe(m, b).alias("precision"), safe(m, a).alias("recall"), safe(2 * m, a + b).alias("f1"), F.col("mean_iou").alias("matched_iou"),
        off.alias("count_error"), safe(off, a).alias("relative_error"),
    )


def instance_change(before: DataFrame, after: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """Counts of both dates, what stayed, may be new or gone, and the change of count and area."""
    a, b = F.col("n_a"), F.col("n_b")
    return _counts(before, after, matches, by).select(
        *by, a.alias("before_n"), b.alias("after_n"), (b - a).alias("net"), F.try_divide(100.0 * (b - a), a.cast("double")).alias("net_percent"), F.col("matched").alias("persistent"),
        (b - F.col("matched")).alias("possible_new"), (a - F.col("matched")).alias("possible_removed"), (F.col("n_b_area") - F.col("n_a_area")).alias("net_area"),
    )


def change_status(side: DataFrame, matches: DataFrame, key: str, role: str) -> DataFrame:
    """side (id, ...) with status and candidate_type; ``key`` is its column in matches, ``role`` what an unmatched one may be."""
    known = matches.select(F.col(key).alias("id"), F.lit(True).alias("__m")).distinct()
    df = side.join(known, "id", "left")
    return df.withColumn("status", F.when(F.col("__m"), "UNCHANGED").otherwise("POSSIBLE_CHANGE")).withColumn("candidate_type", F.when(F.col("__m").isNull(), role)).drop("__m")
