"""Scores of images, models and benchmark runs, and the evidence behind a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import exact_percentiles, with_group


def image_quality(df: DataFrame, by: list[str], bands: list[str]) -> DataFrame:
    """Light, range, shares of cloud, shadow and saturated pixels in percent, and a score of 0.1 to 1, per group."""
    light = sum((F.col(b) for b in bands[1:]), F.col(bands[0])) / len(bands)
    most = F.greatest(*bands) if len(bands) > 1 else F.col(bands[0])
    s = df.groupBy(*by).agg(
        F.avg(light).alias("brightness"),
        (100 * F.avg((light > 0.90).cast("double"))).alias("cloud"), (100 * F.avg((light < 0.05).cast("double"))).alias("shadow"),
        (100 * F.avg((most > 0.99).cast("double"))).alias("saturated"),
    )
    ends = exact_percentiles(df, by, light, {"__lo": 0.02, "__hi": 0.98})
    s = with_group(s, ends, by).withColumn("dynamic_range", F.col("__hi") - F.col("__lo")).drop("__lo", "__hi")
    loss = F.least(F.lit(0.3), F.col("cloud") / 200) + F.least(F.lit(0.2), F.col("shadow") / 250) + F.greatest(F.lit(0.0), 0.3 - F.col("dynamic_range")) * 0.5 + F.least(F.lit(0.1), F.col("saturated") / 500)
    return s.withColumn("score", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - loss)), 3))


def item_passed(similarity: Column, exact: Column, iou: Column) -> Column:
    """An answer passes if it is similar or exact, and its boxes, where asked for, fit."""
    return ((similarity >= 0.45) | exact) & (iou.isNull() | (iou >= 0.5))


def benchmark_summary(items: DataFrame, by: list[str], passed: Column, similarity: Column, iou: Column, category: Column, categories: list[str], confidence: Column, latency: Column, grounding: str, model: Column) -> DataFrame:
    """Totals, pass rate, means, and the pass rate per category; a category without items counts as 100.

    ``grounding`` names the category whose mean IoU is given, 0 where none of its items has one; ``models`` lists the models
    that took part, of which there are few.
    """
    rate = lambda c: F.coalesce(F.round(100 * F.avg(F.when(category == c, passed.cast("double"))), 2), F.lit(100.0)).alias(f"{c}_accuracy")
    return items.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.round(100 * F.avg(passed.cast("double")), 2).alias("accuracy"),
        F.round(F.avg(similarity), 3).alias("similarity"), F.round(F.avg(iou), 3).alias("iou"), *[rate(c) for c in categories],
        F.round(F.avg(confidence), 3).alias("confidence"), F.round(F.avg(latency), 1).alias("latency"),
        F.coalesce(F.round(F.avg(F.when(category == grounding, iou)), 3), F.lit(0.0)).alias("grounding_iou"), F.array_join(F.array_sort(F.collect_set(model)), ",").alias("models"),
    )


def dataset_summary(items: DataFrame, dataset: str, lists: dict[str, str]) -> DataFrame:
    """(dataset, samples, and per name of ``lists`` the sorted distinct values of its column) of each named dataset."""
    out = items.where(F.col(dataset).isNotNull()).groupBy(dataset).agg(F.count("*").alias("samples"))
    for name, column in lists.items():
        out = out.join(distinct_sorted(items, [dataset], column, name), dataset, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{items.schema[column].dataType.simpleString()}>")))
    return out


def distinct_sorted(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """Sorted distinct values per group: distinct first, so a group holds each value once."""
    return df.where(F.col(x).isNotNull()).select(*by, x).distinct().groupBy(*by).agg(F.array_sort(F.collect_list(x)).alias(out))


def run_timing(df: DataFrame, component: str, seconds: Column) -> DataFrame:
    told = df.groupBy(component).agg(F.count("*").alias("runs"), F.avg(seconds).alias("mean"), F.max(seconds).alias("most"))
    return told.join(exact_percentiles(df, [component], seconds, {"p95": 0.95}), component, "left")


def top_class(p: Column, names: list[str]) -> tuple[Column, Column, Column]:
    """(id, name, probability) of the most likely class, the first on ties; four places."""
    at = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    return at, F.get(F.array(*map(F.lit, names)), at), F.round(F.array_max(p).cast("double"), 4)


def best_box_per_truth(truth: DataFrame, predicted: DataFrame, sample: str) -> DataFrame:
    """(sample, boxes, mean_iou): of each true box the best overlap with a predicted one of its sample, 0 without any.

    Boxes (x0, y0, x1, y1) meet inside their sample only; an equi-join on the sample, reduced to one row per true box.
    """
    t = truth.select(sample, "box_id", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    both = t.join(predicted.select(sample, "x0", "y0", "x1", "y1"), sample, "left")
    zero = F.lit(0.0)
    inside = F.greatest(zero, F.least("x1", "tx1") - F.greatest("x0", "tx0")) * F.greatest(zero, F.least("y1", "ty1") - F.greatest("y0", "ty0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) + (F.col("tx1") - F.col("tx0")) * (F.col("ty1") - F.col("ty0"))
    fit = F.when(F.col("x0").isNull(), zero).otherwise(F.coalesce(F.try_divide(inside, area - inside), zero))
    return both.groupBy(sample, "box_id").agg(F.max(fit).alias("__f")).groupBy(sample).agg(F.count("*").alias("boxes"), F.avg("__f").alias("mean_iou"))


def instance_overlap(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, a, b, shared, iou) of two label grids in one table; label 0 or NULL is background.

    Counted by pair first; the sizes come from the pair counts, so pixels are shuffled once.
    """
    n = df.withColumns({a: F.coalesce(F.col(a), F.lit(0)), b: F.coalesce(F.col(b), F.lit(0))}).groupBy(*by, a, b).agg(F.count("*").alias("shared"))
    n = n.withColumn("__a", F.sum("shared").over(W.partitionBy(*by, a))).withColumn("__b", F.sum("shared").over(W.partitionBy(*by, b)))
    return n.where((F.col(a) != 0) & (F.col(b) != 0)).select(*by, a, b, "shared", (F.col("shared") / (F.col("__a") + F.col("__b") - F.col("shared"))).alias("iou"))


def threshold_sweep(df: DataFrame, truth: str, pred: str, confidence: Column, candidates: list[float]) -> DataFrame:
    """(threshold, macro_iou, coverage, objective): the least confidence whose macro IoU times coverage is best, the first on ties.

    Rows are counted once by (truth, pred, number of candidates they reach), so the sweep runs over a few counts.
    """
    steps = sorted(candidates)
    reach = sum((confidence >= t).cast("int") for t in steps)
    cells = df.where(F.col(truth).isNotNull()).groupBy(truth, pred, reach.alias("__n")).agg(F.count("*").alias("n"))
    each = cells.select(truth, pred, "n", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(steps)])).alias("s"), "__n")
    total = cells.agg(F.sum("n").alias("__all"))
    taken = each.where(F.col("__n") >= F.col("s.k")).groupBy("s.threshold", truth, pred).agg(F.sum("n").alias("n"))
    sides = taken.select("threshold", F.explode(F.array(F.struct(F.col(truth).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), "n", (F.col(truth) == F.col(pred)).alias("hit"))
    per = sides.groupBy("threshold", "x.k").agg(F.sum(F.col("n") * F.col("x.t")).alias("t"), F.sum(F.col("n") * F.col("x.p")).alias("p"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.t")).otherwise(0)).alias("i"))
    score = per.groupBy("threshold").agg(F.avg(F.col("i") / (F.col("t") + F.col("p") - F.col("i"))).alias("macro_iou"), F.sum("t").alias("__taken"))
    score = score.crossJoin(F.broadcast(total)).select("threshold", "macro_iou", (F.col("__taken") / F.col("__all")).alias("coverage"))
    score = score.withColumn("objective", F.col("macro_iou") * F.col("coverage"))
    best = score.agg(F.max(F.struct(F.round("objective", 12).alias("o"), (-F.col("threshold")).alias("first"), "macro_iou", "coverage", "objective", "threshold")).alias("b"))
    return best.select("b.threshold", "b.macro_iou", "b.coverage", "b.objective")


def evidence_cross_check(evidence: DataFrame, run: str, kind: str, a: str, b: str, value: str) -> DataFrame:
    """(run, pairs, agree): all pairs of two kinds of evidence in a run and how many agree, from counts, not from pairs."""
    n = evidence.where(F.col(kind).isin(a, b)).groupBy(run, value).agg(F.count_if(F.col(kind) == a).alias("na"), F.count_if(F.col(kind) == b).alias("nb"))
    return n.groupBy(run).agg((F.sum("na") * F.sum("nb")).alias("pairs"), F.sum(F.col("na") * F.col("nb")).alias("agree")).where("pairs > 0")


def contract_join(scenes: DataFrame, contracts: DataFrame, key: str, roles: str) -> DataFrame:
    """(key, model, missing): the contract of the best priority whose bands a scene has, else NULL and what the first lacks.

    ``contracts`` (model, priority, need) is a list of models: small by nature, and checked to be under 1000 rows.
    """
    if contracts.limit(1000).count() >= 1000:
        raise ValueError("too many contracts to broadcast")
    each = scenes.crossJoin(F.broadcast(contracts)).withColumn("missing", F.array_except("need", roles))
    best = each.groupBy(key).agg(F.min(F.struct((F.size("missing") > 0).alias("bad"), "priority", "model", "missing")).alias("t"))
    return best.select(key, F.when(~F.col("t.bad"), F.col("t.model")).alias("model"), F.array_join("t.missing", ",").alias("missing"))


def chronological_pair(df: DataFrame, site: str, scene: str, date: str) -> DataFrame:
    """(site, before, after): the first and the last scene of each place with two or more, by date, then by name."""
    order = F.struct(F.col(date), F.col(scene))
    return df.groupBy(site).agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count("*").alias("n")).where("n > 1").select(site, F.col(f"a.{scene}").alias("before"), F.col(f"z.{scene}").alias("after"), F.datediff(f"z.{date}", f"a.{date}").alias("days"))


def reported_counts(reported: DataFrame, recomputed: DataFrame, key: list[str], x: str, tolerance: float) -> DataFrame:
    """Keys whose reported number differs from the recomputed one, or that only one side has."""
    a, b = reported.select(*key, F.col(x).alias("reported")), recomputed.select(*key, F.col(x).alias("recomputed"))
    return a.join(b, key, "full").where(F.col("reported").isNull() | F.col("recomputed").isNull() | (F.abs(F.col("reported") - F.col("recomputed")) > tolerance))


def input_range(df: DataFrame, by: list[str], x: Column, lo: float, hi: float) -> DataFrame:
    """The outer thousandths of a group's values and whether they lie in the accepted range."""
    s = exact_percentiles(df, by, x, {"least": 0.001, "most": 0.999})
    return s.withColumn("accepted", (F.col("least") >= lo) & (F.col("most") <= hi))


def class_partition(df: DataFrame, by: list[str], label: str, valid: Column, legend: list) -> DataFrame:
    """(by, foreign, unlabelled, whole): classes off the legend, valid pixels without a class, and whether all is well."""
    s = df.groupBy(*by).agg(F.count_if(valid & F.col(label).isNotNull() & ~F.col(label).isin(legend)).alias("foreign"), F.count_if(valid & F.col(label).isNull()).alias("unlabelled"))
    return s.withColumn("whole", (F.col("foreign") == 0) & (F.col("unlabelled") == 0))
