"""Mixing sources to target weights by Pareto order sampling (operator 10); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Steps of each of the two histograms that find a source's cut-off.
STEPS = 4096


def water_fill(df: DataFrame, by: list[str], total: str, cap: str, weight: str, out: str) -> DataFrame:
    """Share ``total`` among the rows of each group by weight; no row gets more than its cap, the excess is shared again.

    The fixed point has one level: a row gets least(cap, level * weight). Rows are few (sources, or size classes of one).
    """
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ratio = F.coalesce(F.try_divide(F.col(cap), F.col(weight)), F.lit(0.0))
    order = w.orderBy("__of_ratio", "__of_tie")
    rest = order.rowsBetween(0, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("__of_ratio", ratio).withColumn("__of_tie", F.xxhash64(cap, weight))
    df = df.withColumn("__of_level", F.try_divide(F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)), F.sum(weight).over(rest))).withColumn("__of_at", F.row_number().over(order))
    level = F.min(F.when(F.col("__of_ratio") > F.col("__of_level"), F.struct("__of_at", "__of_level"))).over(w)["__of_level"]
    return df.withColumn("__of_water", level).withColumn(out, F.when(F.col("__of_water").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.greatest(F.lit(0.0), F.col("__of_water") * F.col(weight))))).drop("__of_ratio", "__of_tie", "__of_level", "__of_at", "__of_water")


def _keyed(docs: DataFrame, id_col: str, source_col: str, size: Column, seed: int) -> DataFrame:
    """Adds the size, a source key without null, the size class and the document's random number in (0, 1)."""
    # rows without an id are told apart by their other columns
    own = F.when(F.col(id_col).isNull(), F.xxhash64(*[c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), own), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return (
        docs.withColumn("__of_size", size)
        .withColumn("__of_key", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")))
        .withColumn("__of_class", F.floor(F.log2(F.col("__of_size") + 1.0)).cast("int"))
        .withColumn("__of_u", unit)
    )


def _cells(df: DataFrame) -> DataFrame:
    """Pareto rank q = odds(u) / odds(p), mapped to q / (1 + q) and cut into cells of two levels."""
    p = F.col("__of_p")
    q = F.try_divide(F.col("__of_u") / (1 - F.col("__of_u")), F.try_divide(p, 1 - p))
    at = F.coalesce(q / (1 + q), F.lit(1.0)) * STEPS
    first = F.least(F.floor(at), F.lit(STEPS - 1)).cast("int")
    return df.withColumn("__of_b1", first).withColumn("__of_b2", F.least(F.floor((at - first) * STEPS), F.lit(STEPS - 1)).cast("int"))


def _decided(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_ratio: float = 2.0, tilt: float = 0.1, seed: int = 10) -> DataFrame:
    """``docs`` with __of_size, __of_source_size, __of_target and __of_copies; see ``mix``."""
    if not weights or min(weights) <= 0 or share < 0 or max_ratio < 0 or tilt < 0:
        raise ValueError("weights must be positive; share, max_ratio and tilt not negative")
    keyed = _keyed(docs, id_col, source_col, word_count(F.col("text")) if size is None else size, seed)
    slim = materialize(keyed.select("__of_key", "__of_size", "__of_class", "__of_u"), "mix")
    classes = materialize(slim.groupBy("__of_key", "__of_class").agg(F.sum("__of_size").alias("__of_words")), "mix-classes")
    sources = classes.groupBy("__of_key").agg(F.sum("__of_words").alias("__of_source_size"))
    # null has the empty key: last by hand, then code points (UTF-8 bytes compare alike)
    spot = F.row_number().over(W.partitionBy(F.lit(0)).orderBy((F.col("__of_key") == "").cast("int"), "__of_key"))
    sources = sources.withColumn("__of_weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(spot - 1, F.lit(len(weights))) + 1))
    sources = sources.withColumn("__of_cap", F.col("__of_source_size") * F.lit(float(max_ratio))).withColumn("__of_total", F.sum("__of_source_size").over(W.partitionBy(F.lit(0))) * F.lit(float(share)))
    sources = water_fill(sources, [], "__of_total", "__of_cap", "__of_weight", "__of_target").select("__of_key", "__of_source_size", "__of_target")
    strata = classes.join(sources, "__of_key").withColumn("__of_cap", F.col("__of_words") * F.lit(float(max_ratio))).withColumn("__of_weight", F.col("__of_words") * (1 + F.lit(float(tilt)) * F.col("__of_class")))
    strata = water_fill(strata, ["__of_key"], "__of_target", "__of_cap", "__of_weight", "__of_share").withColumn("__of_e", F.coalesce(F.try_divide(F.col("__of_share"), F.col("__of_words")), F.lit(0.0)))
    strata = strata.withColumn("__of_whole", F.floor(F.col("__of_e") + 1e-9)).withColumn("__of_p", F.greatest(F.lit(0.0), F.col("__of_e") - F.col("__of_whole")))
    strata = materialize(strata.select("__of_key", "__of_class", "__of_source_size", "__of_target", "__of_words", "__of_whole", "__of_p"), "mix-strata")
    # what certain copies leave of each target
    need = strata.groupBy("__of_key").agg((F.first("__of_target") - F.sum(F.col("__of_whole") * F.col("__of_words"))).alias("__of_need"))
    open_ = _cells(slim.join(strata.select("__of_key", "__of_class", "__of_p").where("__of_p > 0"), ["__of_key", "__of_class"]))
    hist = open_.groupBy("__of_key", "__of_b1").agg(F.sum("__of_size").alias("__of_n"))
    upto = F.sum("__of_n").over(W.partitionBy("__of_key").orderBy("__of_b1"))
    cut1 = hist.withColumn("__of_upto", upto).join(need, "__of_key").where("__of_upto >= __of_need").groupBy("__of_key").agg(F.min(F.struct("__of_b1", "__of_upto", "__of_n", "__of_need")).alias("c"))
    cut1 = cut1.select("__of_key", F.col("c.__of_b1").alias("__of_c1"), (F.col("c.__of_need") - F.col("c.__of_upto") + F.col("c.__of_n")).alias("__of_left"))
    cut1 = materialize(cut1, "mix-cut")
    fine = open_.join(cut1, "__of_key").where("__of_b1 = __of_c1").groupBy("__of_key", "__of_c1", "__of_left", "__of_b2").agg(F.sum("__of_size").alias("__of_n"))
    fine = fine.withColumn("__of_upto", F.sum("__of_n").over(W.partitionBy("__of_key").orderBy("__of_b2")))
    # the last cell is taken when that brings the sum nearer to the target
    cut2 = fine.where(F.abs(F.col("__of_upto") - F.col("__of_left")) < F.abs(F.col("__of_upto") - F.col("__of_n") - F.col("__of_left"))).groupBy("__of_key").agg(F.max("__of_b2").alias("__of_c2"))
    cuts = strata.join(cut1.select("__of_key", "__of_c1"), "__of_key", "left").join(cut2, "__of_key", "left").select("__of_key", "__of_class", "__of_source_size", "__of_target", "__of_whole", "__of_p", "__of_c1", "__of_c2")
    out = _cells(keyed.join(materialize(cuts, "mix-cuts"), ["__of_key", "__of_class"], "left"))
    c1 = F.coalesce(F.col("__of_c1"), F.lit(STEPS))  # no cut-off: the source needs all of its documents
    drawn = (F.col("__of_p") > 0) & ((F.col("__of_b1") < c1) | ((F.col("__of_b1") == c1) & (F.col("__of_b2") <= F.coalesce(F.col("__of_c2"), F.lit(-1)))))
    copies = (F.col("__of_whole") + F.when(drawn, 1).otherwise(0)).cast("long")
    return out.withColumn("__of_copies", F.coalesce(copies, F.lit(0).cast("long"))).select(*docs.columns, "__of_size", "__of_source_size", "__of_target", "__of_copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target (its source's) and copies (how often the mix takes it).

    Options: ``id_col``, ``source_col``, ``size`` (a column; by default the number of words of ``text``), ``weights``,
    ``share``, ``max_ratio``, ``tilt`` and ``seed``, as in ``_decided``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` of all sizes; no target is
    above ``max_ratio`` times its source's size. Inside a source a document's expected copies grow with its size class,
    by a share of ``tilt`` per class, and reach the target exactly in expectation; their whole part is certain, the rest
    is the inclusion probability p of a Pareto sample: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u from a hash
    of id and seed, and taken in that order until the target's words are reached. The cut-off comes from two histograms
    of 4096 cells per source, so no source is ever sorted or gathered; the sample ends within one cell (a
    sixteen-millionth of a source, in practice one document) of the target.

    Null source: a source of its own, last. Null text: size 0. Rows that repeat an id are decided alike, so they are taken
    or left together; rows without an id are told apart by their other columns. An empty table gives an empty result.
    Columns of docs named as one of the four new ones are replaced; names starting with ``__of_`` are reserved. Sources
    and their size classes (some 20 a source) are ranked in one task: meant for up to millions of sources.
    """
    new = {"size": "__of_size", "source_size": "__of_source_size", "target": "__of_target", "copies": "__of_copies"}
    return _decided(docs, **options).select(*[c for c in docs.columns if c not in new], *[F.col(of).alias(c) for c, of in new.items()])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    return _decided(docs, **options).withColumn("__of_copy", F.explode(F.array_repeat(F.lit(1), F.col("__of_copies").cast("int")))).select(*docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
