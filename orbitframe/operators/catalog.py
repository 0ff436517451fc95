"""Catalog operators over runs, geometries, chats and samples: joins, upserts, searches and text tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bbox_filter(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes that touch the query box; plain comparisons, so Parquet statistics prune."""
    return df.where((F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1))


def runs_with_geometry_count(runs: DataFrame, geometries: DataFrame, key: str) -> DataFrame:
    """Every run with its number of geometries, zero kept; counted before the join."""
    n = geometries.groupBy(key).agg(F.count("*").alias("geometries"))
    return runs.join(n, key, "left").fillna(0, ["geometries"])


def latest(df: DataFrame, order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).orderBy(*order).limit(n)


def chats_with_latest(messages: DataFrame, chat: str, time: str, text: str) -> DataFrame:
    return messages.groupBy(chat).agg(F.max_by(text, time).alias("last_message"), F.count("*").alias("messages"), F.max(time).alias("updated"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR REPLACE: a new row wins over an old one with its key."""
    both = table.withColumn("__v", F.lit(0)).unionByName(rows.withColumn("__v", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__v")))).where("__n = 1").drop("__v", "__n")


def replace_group(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the groups that come in are replaced; saving again never duplicates."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def patch(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial update: NULL keeps the old value. Keys of updates are unique."""
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return table.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def patch_report(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """(key, found): whether each key of a partial update existed."""
    known = table.select(key).distinct().withColumn("found", F.lit(True))
    return updates.select(key).distinct().join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete_cascade(parent: DataFrame, children: list[DataFrame], gone: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    return parent.join(gone, key, "left_anti"), [c.join(gone, key, "left_anti") for c in children]


def merge_run_index(local: DataFrame, remote: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """Union of two lists, local wins on the same id, newest first."""
    return upsert(remote, local, [key]).orderBy(F.desc(time), F.desc(key)).limit(n)


def topic_counts(df: DataFrame, text: Column, topics: dict[str, str]) -> DataFrame:
    """Total and rows per topic; topics may overlap."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.lower(text).contains(word)).alias(name) for name, word in topics.items()])


def recency_groups(df: DataFrame, time: str, now: str) -> DataFrame:
    """Today, This Week, This Month or Older per row count, seen from a fixed time."""
    days = F.datediff(F.lit(now).cast("date"), F.col(time).cast("date"))
    label = F.when(days <= 0, "Today").when(days < 7, "This Week").when(days < 30, "This Month").otherwise("Older")
    return df.groupBy(label.alias("period")).agg(F.count("*").alias("n"), F.max(time).alias("newest"))


def tag_first(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The first tag with a whole-word hit."""
    out = None
    for tag, words in table:
        hit = F.lower(text).rlike(r"\b(" + "|".join(words) + r")\b")
        out = F.when(hit, F.lit(tag)) if out is None else out.when(hit, F.lit(tag))
    return out


def tag_all(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """All tags with a whole-word hit, in the table's order."""
    return F.filter(F.array(*[F.when(F.lower(text).rlike(r"\b(" + "|".join(words) + r")\b"), F.lit(tag)) for tag, words in table]), lambda x: x.isNotNull())


def extract_years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda x: x.cast("int"))


def normalize_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def preview_url(url: Column) -> Column:
    return F.regexp_replace(url, r"\.tiff?$", "_preview.png")


def exact_match(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != ""))


def token_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of the intersection and the union of two texts' word sets."""
    x, y = _words(a), _words(b)
    return F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))


def turn_pairs(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """turns that follow another one, with its text as ``before``; nulls on either side are left out."""
    return turns.withColumn("before", F.lag(text).over(W.partitionBy(key).orderBy(order))).where(F.col("before").isNotNull() & F.col(text).isNotNull())


def keyword_similarity(predicted: Column, target: Column, keywords: tuple[str, ...]) -> Column:
    """1 for equal texts, case aside; else 0.6 of the share of keywords found and 0.4 of the words' Jaccard similarity."""
    a, b = F.lower(predicted), F.lower(target)
    words = lambda x: F.array_distinct(F.filter(F.split(F.translate(x, ",.", "  "), r"\s+"), lambda w: w != ""))
    hits = sum((F.contains(a, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    overlap = F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.lit(1), F.size(F.array_union(words(a), words(b))))
    return F.when(a == b, 1.0).otherwise(F.round(0.6 * hits / max(1, len(keywords)) + 0.4 * overlap, 3))


def perplexity(logprobs: Column) -> Column:
    n = F.size(logprobs)
    return F.when(n > 0, F.round(F.exp(-F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / n), 3))


def human_area(m2: Column) -> Column:
    return F.when(m2 >= 1e6, F.concat(F.format_number(m2 / 1e6, 2), F.lit(" km²"))).when(m2 >= 1e4, F.concat(F.format_number(m2 / 1e4, 2), F.lit(" ha"))).otherwise(F.concat(F.format_number(m2, 0), F.lit(" m²")))


def split_leak(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that appear in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def quality_score(df: DataFrame, by: list[str], severity: Column) -> DataFrame:
    """1 - 0.20 per blocker - 0.04 per warning, in 0..1."""
    out = df.groupBy(*by).agg(F.count_if(severity == "blocker").alias("blockers"), F.count_if(severity == "warning").alias("warnings"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 1 - 0.20 * F.col("blockers") - 0.04 * F.col("warnings")))


def out_of_range(df: DataFrame, key: str, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, rule) for values that are NULL, not finite or outside their bounds; one pass over the table."""
    failing = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | ~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in rules.items()]
    return df.select(key, F.explode(F.filter(F.array(*failing), lambda x: x.isNotNull())).alias("rule"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def flood_summary(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, dry, flood, cloud, flood_share, dominant) of classes 0 dry, 1 flood, other: not observed."""
    kind = F.col(label)
    out = df.groupBy(*by).agg(F.count_if(kind == 0).alias("dry"), F.count_if(kind == 1).alias("flood"), F.count_if(~kind.isin(0, 1)).alias("cloud"))
    share = F.col("flood") / F.greatest(F.col("flood") + F.col("dry"), F.lit(1))
    hidden = F.col("cloud") / (F.col("dry") + F.col("flood") + F.col("cloud"))
    return out.withColumn("flood_share", F.round(share, 6)).withColumn("dominant", F.when(share >= 0.10, "flood").when(hidden >= 0.50, "cloud_nodata").otherwise("no_flood"))


def choose_variable(variables: DataFrame, by: list[str], name: str, width: str, height: str, bands: str, wanted: str | None = None) -> DataFrame:
    """(by, name, score): the variable of the wanted name, case aside, else the largest; lines of one pixel are no images."""
    score = (F.col(width) * F.col(height) * F.greatest(F.lit(1), F.least(F.col(bands), F.lit(16)))).cast("long")
    df = variables.where((F.col(width) > 1) & (F.col(height) > 1)).select(*by, F.col(name).alias("name"), score.alias("score"))
    if wanted is not None:
        df = df.where(F.lower("name") == wanted.lower())
    best = df.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("x"))
    return best.select(*by, "x.name", (-F.col("x.s")).alias("score"))


def append_messages(chats: DataFrame, messages: DataFrame, new: DataFrame, key: str, at: str, updated: str) -> tuple[DataFrame, DataFrame]:
    """(messages, chats): the new ones are added, and their chats' time of change follows the latest of them."""
    last = new.groupBy(key).agg(F.max(at).alias("__at"))
    touched = chats.join(last, key, "left").withColumn(updated, F.coalesce("__at", updated)).drop("__at")
    return messages.unionByName(new), touched


def scene_report(df: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(part, scene, metrics): JSON of the global metrics and of each scene's, one row each so that no row grows with them."""
    packed = F.to_json(F.struct(*metrics)).alias("metrics")
    named = [m.alias(n) for n, m in metrics.items()]
    whole = df.agg(*named).select(F.lit("global").alias("part"), F.lit(None).cast("string").alias("scene"), packed)
    each = df.groupBy(*by).agg(*named).select(F.lit("by_scene").alias("part"), F.to_json(F.struct(*by)).alias("scene"), packed)
    return whole.unionByName(each)


def in_order(df: DataFrame, by: list[str], keys: list) -> DataFrame:
    """df with ``place``, from 1 in each group; groups are a chat's or a run's own rows."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*keys)).cast("long"))


def union_records(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """One row per key, from the first part that has it."""
    ranked = None
    for i, part in enumerate(parts):
        one = part.select(*key, F.struct(F.lit(i).alias("__i"), *[c for c in part.columns if c not in key]).alias("__x"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy(*key).agg(F.min("__x").alias("__x")).select(*key, "__x.*").drop("__i")
