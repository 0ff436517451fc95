"""Aggregations, thresholds, ranking and evaluation over pixel, run and sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import written

#: Rows of some twenty numbers that are broadcast at most.
FEW = 100_000


def class_coverage(df: DataFrame, by: list[str], label: str, p: Column | None = None) -> DataFrame:
    """Pixels and percent per class over valid pixels; with p also the mean probability. The total comes from the groups."""
    aggs = [F.count("*").alias("pixels"), *([F.avg(p).alias("mean_p")] if p is not None else [])]
    total = F.sum("pixels").over(W.partitionBy(*(by or [F.lit(0)])))
    return df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(*aggs).withColumn("percent", 100 * F.col("pixels") / total)


def coverage(df: DataFrame, by: list[str], mask: Column, valid: Column) -> DataFrame:
    out = df.groupBy(*by).agg(F.count_if(mask & valid).alias("pixels"), F.count_if(valid).alias("valid"), F.count("*").alias("all"))
    return out.withColumn("of_valid", F.try_divide(100.0 * F.col("pixels"), F.col("valid"))).withColumn("of_all", 100.0 * F.col("pixels") / F.col("all"))


def exact_percentiles(df: DataFrame, by: list[str], x: Column, shares: dict[str, float], cells: int = 4096, levels: int = 2) -> DataFrame:
    """(by, one column per share): exact percentiles, linear between neighbours, of groups of any size.

    Histograms narrow each wanted rank down to a cell, ``levels`` times; only the distinct values of the last cells are
    ranked, about one in ``cells`` ** ``levels``. No task holds a group's values. Nulls and NaN count for nothing.

    The ends of the groups are a small table, whose size is known: up to ``FEW`` wanted ranks are broadcast to the values,
    so that these are not shuffled; more are joined by group.
    """
    src = df.select(*by, x.cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    ends = src.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    ends = written(ends, "ends")
    few = ends.count() * 2 * len(shares) <= FEW
    spot = lambda q: F.lit(float(q)) * (F.col("__n") - 1)
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(i).alias("side"), (F.floor if i == 0 else F.ceil)(spot(q)).cast("long").alias("rank"), (spot(q) - F.floor(spot(q))).alias("part")) for name, q in shares.items() for i in (0, 1)]
    keys = [*by, "name", "side", "rank", "part"]
    state = ends.select(*by, "__lo", "__hi", F.explode(F.array(*ranks)).alias("__k")).select(*by, "__k.*", "__lo", "__hi", F.lit(0).cast("long").alias("__before"))
    sized = F.broadcast if few else lambda x: x
    met = lambda now: (src.join(sized(now), by) if by else src.crossJoin(F.broadcast(now))).where(F.col("__x").between(F.col("__lo"), F.col("__hi")))

    def narrow(groups: DataFrame, order: str) -> DataFrame:
        """Of counted groups in order, the one that holds each rank."""
        upto = F.col("__before") + F.sum("__m").over(W.partitionBy(*keys).orderBy(order))
        return groups.withColumn("__upto", upto).where((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("__m")))

    for _ in range(levels):
        cell = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * cells)).otherwise(0)
        counted = met(state).withColumn("__cell", cell).groupBy(*keys, "__before", "__cell").agg(F.count("*").alias("__m"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        state = narrow(counted, "__cell").select(*keys, "__lo", "__hi", (F.col("__upto") - F.col("__m")).alias("__before"))
    found = narrow(met(state).groupBy(*keys, "__before", "__x").agg(F.count("*").alias("__m")), "__x")
    value = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("__x")))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    return found.groupBy(*by).agg(*[((1 - part(name)) * value(name, 0) + part(name) * value(name, 1)).alias(name) for name in shares])


def with_group(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of small, which has one row per group, or one in all."""
    return df.join(small, by, "left") if by else df.crossJoin(F.broadcast(small))


def index_summary(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    return with_group(df.groupBy(*by).agg(F.avg(x).alias("mean")), exact_percentiles(df, by, x, {"p10": 0.1, "p90": 0.9}), by)


def band_moments(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))


def robust_threshold(df: DataFrame, by: list[str], x: Column, floor: float = 0.08, k: float = 3.0, spread: float = 0.01) -> DataFrame:
    """max(floor, median + k max(MAD, spread)) per group."""
    df = df.withColumn("__x", x)
    mid = exact_percentiles(df, by, F.col("__x"), {"median": 0.5})
    off = exact_percentiles(with_group(df, mid, by), by, F.abs(F.col("__x") - F.col("median")), {"mad": 0.5})
    return with_group(mid, off, by).withColumn("threshold", F.greatest(F.lit(floor), F.col("median") + k * F.greatest(F.col("mad"), F.lit(spread))))


def histogram(df: DataFrame, by: list[str], x: Column, bins: int, lo: float, hi: float) -> DataFrame:
    """(by, bin, n) for values in lo..hi, the last bin closed; bins without values are left out."""
    at = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return df.where((x >= lo) & (x <= hi)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def otsu(df: DataFrame, by: list[str], x: Column, bins: int = 256, lo: float = 0.0, hi: float = 1.0, clip: tuple[float, float] = (0.08, 0.45)) -> DataFrame:
    """(by, threshold): the upper edge of the bin with the largest between-class variance, the first on ties, clipped.

    Runs over the histogram, so only bins are sorted.
    """
    step = (hi - lo) / bins
    h = histogram(df, by, x, bins, lo, hi).withColumn("__m", lo + (F.col("bin") + 0.5) * step)
    part = W.partitionBy(*(by or [F.lit(0)]))
    run = part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumns({"__upto_n": F.sum("n").over(run), "__upto_s": F.sum(F.col("n") * F.col("__m")).over(run), "__all_n": F.sum("n").over(part), "__all_s": F.sum(F.col("n") * F.col("__m")).over(part)})
    w0, w1 = F.col("__upto_n"), F.col("__all_n") - F.col("__upto_n")
    gap = F.col("__upto_s") / w0 - F.try_divide(F.col("__all_s") - F.col("__upto_s"), w1)
    h = h.withColumn("__v", F.round(F.coalesce(w0 * w1 * gap * gap / (F.col("__all_n") * F.col("__all_n")), F.lit(0.0)), 12))
    best = h.groupBy(*by).agg(F.max(F.struct(F.col("__v"), (-F.col("bin")).alias("b"))).alias("t"))
    return best.select(*by, F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), lo + (1 - F.col("t.b")) * step)).alias("threshold"))


def category_mix(df: DataFrame, by: list[str], db: Column, high: float = -10.0, low: float = -20.0) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(share(db >= high).alias("bright"), share(db <= low).alias("dark"), share((db < high) & (db > low)).alias("between"))


def speckle_index(df: DataFrame, by: list[str], x: Column, least: int = 64) -> DataFrame:
    return df.groupBy(*by).agg(F.when(F.count(x) < least, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.stddev_pop(x), F.avg(x)), F.lit(0.0)))).alias("speckle"))


def agreement(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    out = df.groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))
    return out.withColumn("iou", F.coalesce(F.try_divide(F.col("both"), F.col("either")), F.lit(0.0)))


def minmax_stretch(df: DataFrame, by: list[str], x: Column, out: str, least: float = 1e-5) -> DataFrame:
    """One range per group, joined back."""
    df = df.withColumn("__x", x)
    ends = df.groupBy(*by).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    return df.join(ends, by).withColumn(out, (F.col("__x") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(least))).drop("__x", "__lo", "__hi")


def percentile_stretch(df: DataFrame, by: list[str], x: Column, out: str, lo: float = 2.0, hi: float = 98.0) -> DataFrame:
    """Linear-interpolated percentiles to 0..1 with clip; a flat group becomes 0.5 if its value is above 0, else 0."""
    df = df.withColumn("__x", x)
    ends = exact_percentiles(df, by, F.col("__x"), {"__plo": lo / 100, "__phi": hi / 100})
    a, b = F.col("__plo"), F.col("__phi")
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("__x") - a) / (b - a)))
    return with_group(df, ends, by).withColumn(out, F.when(F.col("__x").isNull(), None).when(b > a, scaled).otherwise(F.when(b > 0, 0.5).otherwise(0.0))).drop("__x", "__plo", "__phi")


def to_byte(df: DataFrame, by: list[str], x: Column, out: str) -> DataFrame:
    df = percentile_stretch(df, by, x, "__b")
    return df.withColumn(out, F.bround(F.col("__b") * 255, 0).cast("int")).drop("__b")


def unit_scale(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """(by, factor): one decision per scene: the largest value above 1.5 is divided by 255, else kept."""
    return df.groupBy(*by).agg(F.when(F.max(x) > 1.5, 1 / 255).otherwise(1.0).alias("factor"))


def weighted_blend(df: DataFrame, keys: list[str], p: Column, w: Column) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(p * w) / F.sum(w)).alias("p"))


def collapse_classes(df: DataFrame, keys: list[str], fine: str, p: str, mapping: DataFrame) -> DataFrame:
    """Sums fine probabilities by coarse class (mapping: fine, coarse) and renormalizes per key."""
    out = df.join(mapping, df[fine] == mapping["fine"]).groupBy(*keys, "coarse").agg(F.sum(p).alias("p"))
    return out.withColumn("p", F.try_divide("p", F.sum("p").over(W.partitionBy(*keys))))


def bounding_boxes(df: DataFrame, by: list[str], x: str, y: str, w: str, h: str, score: str, key: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(F.col(x) + F.col(w)).alias("x1"), F.max(F.col(y) + F.col(h)).alias("y1"),
        F.count("*").alias("tiles"), F.avg(score).alias("mean_score"), F.max(score).alias("best_score"), F.min(key).alias("first_tile"),
    )


def period_composite(df: DataFrame, by: list[str], period: Column, x: Column, periods: int = 12) -> DataFrame:
    """Mean per period 1..periods of each group; an empty period repeats the one before it, else 0."""
    own = df.groupBy(*by, period.cast("int").alias("period")).agg(F.avg(x).alias("v"))
    spine = own.select(*by).distinct().withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    w = W.partitionBy(*by).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return spine.join(own, [*by, "period"], "left").withColumn("v", F.coalesce(F.last("v", True).over(w), F.lit(0.0)))


def confusion(df: DataFrame, truth: str, pred: str, k: int) -> DataFrame:
    """All k x k cells with their counts."""
    spark = df.sparkSession
    grid = spark.range(k * k).select((F.col("id") / k).cast("int").alias("truth"), (F.col("id") % k).cast("int").alias("pred"))
    n = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(n, ["truth", "pred"], "left").fillna(0, ["n"])


def class_metrics(cells: DataFrame) -> DataFrame:
    """Per class IoU, precision, recall, F1 and specificity from a confusion table; 0 where there is nothing to divide by."""
    t, p, everything = W.partitionBy("truth"), W.partitionBy("pred"), W.partitionBy(F.lit(0))
    df = cells.withColumns({"__t": F.sum("n").over(t), "__p": F.sum("n").over(p), "__a": F.sum("n").over(everything)}).where("truth = pred")
    tp, fn, fp = F.col("n"), F.col("__t") - F.col("n"), F.col("__p") - F.col("n")
    tn = F.col("__a") - F.col("__t") - F.col("__p") + F.col("n")
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return df.select(F.col("truth").alias("class"), div(tp, tp + fp + fn).alias("iou"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tn, tn + fp).alias("specificity"))


def binary_metrics(df: DataFrame, by: list[str], truth: Column, pred: Column) -> DataFrame:
    n = df.groupBy(*by).agg(F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"), F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns({"iou": div(tp, tp + fp + fn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "specificity": div(tn, tn + fp)})


def calibration_error(df: DataFrame, confidence: Column, correct: Column, bins: int = 5) -> DataFrame:
    """Sum over bins of share * |accuracy - confidence|, the last bin closed; four decimals."""
    at = F.least(F.floor(confidence * bins), F.lit(bins - 1))
    b = df.groupBy(at.alias("__b")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 4).alias("ece"), F.sum("n").alias("samples"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark limits each partition before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def share_of_total(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """Sums meet the rows in a join: a group may hold most of the table."""
    total = with_group(df, df.groupBy(*by).agg(F.sum(x).alias("__total")), by)
    return total.withColumn(out, F.try_divide(F.col(x).cast("double"), F.col("__total"))).drop("__total")


def relative_to_first(df: DataFrame, by: list[str], order: list[Column], x: str, out: str) -> DataFrame:
    """``order`` are columns, ascending; the first row is the least of them, found by partial aggregation."""
    first = df.groupBy(*by).agg(F.min(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.col(x).alias("v")))["v"].alias("__first"))
    return with_group(df, first, by).withColumn(out, F.try_divide(F.col(x).cast("double"), F.col("__first"))).drop("__first")


def in_ranges(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df as a written table in sorted ranges: __part names the range, __at rises by one from row to row in it.

    A group of any size spreads over as many ranges as it fills, so no task holds more than a range; what its ranges add up
    to passes from one to the next by ``carried``. Rows with equal group and order are in one range.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return written(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "ranges")


def carried(ranged: DataFrame, by: list[str], own: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """ranged with the columns ``over``: window expressions over a group's ranges in order, one row each, of the aggregates ``own``.

    NULL is a group like any other.
    """
    parts = ranged.groupBy(*by, "__part").agg(*[x.alias(n) for n, x in own.items()])
    keys = [*by, "__part"]
    parts = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[x.alias(n) for n, x in over.items()])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranged.join(parts, same).drop(*[f"__k{i}" for i in range(len(keys))])


def _ranges(by: list[str]) -> tuple[W, W, W]:
    """Windows of ``in_ranges``: a group's rows in one range so far, its earlier ranges, and all of them."""
    parts = W.partitionBy(*by)
    return W.partitionBy(*by, "__part").orderBy("__at").rowsBetween(W.unboundedPreceding, 0), parts.orderBy("__part").rowsBetween(W.unboundedPreceding, -1), parts


def _placed(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with each row's place in its group from 0, __i, and the group's number of rows, __n."""
    _, before, every = _ranges(by)
    counts = {"__first": F.col("__first"), "__before": F.coalesce(F.sum("__count").over(before), F.lit(0)), "__n": F.sum("__count").over(every)}
    df = carried(in_ranges(df, by, order), by, {"__first": F.min("__at"), "__count": F.count("*")}, counts)
    return df.withColumn("__i", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """df with each row's rank in its group, from 1. Groups may be of any size; ``top_per_group`` is cheaper for a few ranks."""
    return _placed(df, by, order).withColumn(rank, F.col("__i") + 1).drop("__i", "__n")


def cumulative(df: DataFrame, by: list[str], order: list[Column], x: str, out: str) -> DataFrame:
    """df with the running sum of x in each group's order; NULL until there is a value. Groups may be of any size."""
    here, before, _ = _ranges(by)
    kind = df.select(F.sum(x).alias("x")).schema["x"].dataType
    ranged = carried(in_ranges(df, by, order), by, {"__sum": F.sum(x)}, {"__before": F.sum("__sum").over(before)})
    run = F.sum(x).over(here)
    return ranged.withColumn(out, F.coalesce(F.col("__before") + run, "__before", run).cast(kind)).drop("__part", "__at", "__before")


def forward_fill(df: DataFrame, by: list[str], order: list[Column], x: str, out: str) -> DataFrame:
    """df with the last value of x so far in each group's order; NULL until there is one. Groups may be of any size."""
    here, before, _ = _ranges(by)
    last = F.max_by(x, F.when(F.col(x).isNotNull(), F.col("__at")))
    ranged = carried(in_ranges(df, by, order), by, {"__last": last}, {"__before": F.last("__last", True).over(before)})
    return ranged.withColumn(out, F.coalesce(F.last(x, True).over(here), "__before")).drop("__part", "__at", "__before")


def dominant_class(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Of each group the label of the most rows, ties to the smaller label."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return top_per_group(n, by, [F.desc("n"), F.col(label)], 1, "__k").drop("__k")


def even_sample(df: DataFrame, by: list[str], order: list[Column], most: int = 32) -> DataFrame:
    """Evenly spaced rows of each group, both ends included, at most so many. Groups may be of any size."""
    df = _placed(df, by, order)
    # row i is chosen when it is floor(j (n - 1) / (most - 1)) for some j
    j = F.ceil(F.col("__i") * (most - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = (F.floor(j * (F.col("__n") - 1) / (most - 1)) == F.col("__i")) & (j <= most - 1)
    return df.where((F.col("__n") <= most) | hit).drop("__i", "__n")


def confidence_weakest(df: DataFrame, by: list[str], confidence: Column, quality: float, alignment: float, penalty: float, cap: float = 0.98) -> DataFrame:
    return df.groupBy(*by).agg((F.min(F.least(confidence, F.lit(cap))) * quality * alignment * (1 - penalty)).alias("confidence"))


def micro_average(df: DataFrame, tp: Column, fp: Column, fn: Column) -> DataFrame:
    """Precision, recall, F1 of pooled counts over samples (NULL if undefined) and the mean absolute count error."""
    s = df.agg(F.count("*").alias("samples"), F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"), F.avg(F.abs(fp - fn)).alias("count_error"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("samples", ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1"), "count_error")


def land_bounds(df: DataFrame, by: list[str], land: Column, unknown: Column) -> DataFrame:
    """Shares (0..100) of classified land, of unknown, and of what could be land at most; pixels of NULL are not counted."""
    seen = df.where(land.isNotNull() & unknown.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(land).alias("a"), F.count_if(unknown & ~land).alias("u"))
    share = lambda x: 100.0 * x / F.col("n")
    return seen.select(*by, share(F.col("a")).alias("land"), share(F.col("u")).alias("unknown"), share(F.col("a") + F.col("u")).alias("possible"))


def percent_metrics(cells: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Per class IoU, precision, recall and F1 in percent, and the overall accuracy; classes of weight 0 are left out of all."""
    kept = [k for k, w in weights.items() if w]
    inside = cells.where(F.col("truth").isin(kept) & F.col("pred").isin(kept))
    total = inside.agg((100.0 * F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    own = class_metrics(inside).select("class", *[(100 * F.col(c)).alias(c) for c in ("iou", "precision", "recall", "f1")])
    return own.crossJoin(F.broadcast(total))  # one row
