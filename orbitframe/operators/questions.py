"""Rule tables joined to data: the task of a question, the modality of an image, the cards that sum up a run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import human_area, tag_first

# The words and phrases of each fact, the targets in their order, and the rules.
TARGETS = [
    ("built-up", ["built-up", "built up", "construction", "building", "buildings", "urban", "structures", "commercial", "residential", "development", "urban expansion", "settlement", "settlements", "houses", "city", "town", "infrastructure", "airport", "runway"]),
    ("water", ["water", "river", "rivers", "lake", "lakes", "flood", "ocean", "sea", "reservoir", "pond", "ponds", "water body", "water bodies", "waterbody", "canal", "estuary", "bay", "coastal", "aquatic", "wetland", "water expansion"]),
    ("vegetation", ["vegetation", "forest", "forests", "crop", "crops", "green", "greenery", "ndvi", "canopy", "tree", "trees", "agriculture", "agricultural", "farmland", "woodland", "vegetation loss", "deforestation", "pasture", "dense canopy"]),
    ("road", ["road", "roads", "highway", "highways", "bridge", "bridges", "street", "streets", "transportation"]),
]
PHRASES = {
    "change": ("change", "changed", "before/after", "before and after", "before", "after", "increase", "increased", "decrease", "decreased", "expansion", "expanded", "expand", "reduction", "reduced", "growth", "grown", "loss", "lost", "difference", "between dates", "between these", "between two", "over time", "temporal comparison", "urban expansion", "vegetation loss", "water expansion", "evolve", "compared", "dynamics", "shrunk", "shrinking"),
    "fusion": ("optical + sar", "optical and sar", "radar", "sar", "multispectral and radar", "both sensors", "cross-modal", "cross modal", "combine optical and sar", "use both images", "radar evidence", "optical evidence", "sentinel-1 and sentinel-2", "optical-sar", "sar-optical", "what information does sar add", "surface characteristics", "what does optical show", "what does sar show", "what additional information does sar provide", "identify built-up areas using both", "identify water using optical and sar", "compare optical and sar", "using both", "both images", "optical and radar", "radar and optical", "complementary analysis", "sar show", "optical show", "radar show", "sar add"),
    "says_optical": ("what does optical show", "optical show", "only optical", "visible in optical"),
    "says_radar": ("what does sar show", "sar show", "what does radar show", "radar show", "only sar"),
    "says_more": ("what additional information does sar provide", "what information does sar add", "what does sar add", "what additional information"),
    "land": ("land cover", "landcover", "land-cover", "terrain", "types of terrain", "types of land", "what types of land", "composed of", "composition of land", "agricultural land", "is this area mostly agricultural", "classify the visible land cover", "what can i see here", "what land cover", "what land is", "what land", "land-cover types", "land use", "land classification", "find land", "find the land", "locate land", "locate land cover", "identify land", "detect land", "detect land cover", "map land", "map land cover", "land cover map", "segment land", "segment land cover", "land segmentation", "land classes", "land categories", "classify land", "classify land cover", "surface composition"),
    "scene": ("describe this image", "describe the image", "describe this scene", "describe the scene", "describe", "what is visible in this scene", "what is visible in this image", "give me an overview", "what does this image contain", "overview of this satellite image", "overview", "summarize this image", "summarize", "caption this", "caption", "tell me about this scene", "what is the scene", "what is visible", "what's visible"),
    "object": ("where are the buildings", "identify roads", "find the river", "locate agricultural fields", "identify major objects", "what objects are visible", "what objects are present", "objects present", "locate structures", "where are the settlements", "locate the airport", "locate", "identify", "find the", "detect objects", "where is", "where are"),
    "buildings": ("how many buildings", "count buildings", "count the buildings", "number of buildings", "building footprint", "building footprints", "detect buildings", "building detection", "identify buildings", "map buildings", "building count", "buildings in this image", "structures detected", "footprint detection", "delineate buildings"),
    "water_words": ("water", "lake", "river", "ocean", "flood", "pond", "reservoir", "wetland"),
    "water_main": ("water", "river", "lake", "flood"),
    "water_ask": ("highlight", "largest", "find water", "where are the water", "water bodies", "where is the river", "show the lake", "locate water", "how much water"),
    "locate": ("highlight", "locate", "where is", "find", "show"),
    "plant_words": ("vegetation", "greenery", "forest", "crop", "tree", "canopy", "ndvi"),
    "plant_main": ("vegetation", "greenery", "forest", "canopy"),
    "plant_ask": ("concentrated", "greenery", "analyze vegetation", "where is vegetation", "is vegetation present", "dense", "canopy", "forest"),
    "built_words": ("built-up", "built up", "building", "buildings", "urban", "construction", "city", "settlement"),
    "built_main": ("built-up", "urban", "building", "city"),
    "built_ask": ("built-up", "built up", "urban", "urbanized", "where are the buildings", "locate buildings", "city", "settlement", "identify built-up"),
    "counting": ("how many", "count", "is there", "are there", "what is the number", "number of", "can you see", "is this area mostly"),
    "roof_nouns": ("building", "buildings", "structure", "structures", "footprint"),
    "identify": ("identify",),
    "object_nouns": ("object", "structure", "feature"),
}
UNSUPPORTED = (r"\bcapital of\b", r"\bwho is\b", r"\bwho was\b", r"\bpython code\b", r"\bwrite a code\b", r"\bwrite a script\b", r"\bhow to cook\b", r"\bweather in\b", r"\btranslate\b", r"\bcalculate \d+\b", r"\bwhat is \d+ \+ \d+\b", r"\bpresident of\b", r"\bmeaning of life\b")
UNCLEAR = ("hello", "hi", "hey", "test", "run", "do it", "analyze", "check", "what", "ok", "please")
#: (trigger, other facts that must hold, facts that must not, application, task, specific task, target or None for the named one), by priority.
RULES = (
    ("unsupported", (), (), "unsupported", "unsupported", "unsupported", None),
    ("unclear", (), (), "unclear", "unclear", "unclear", None),
    ("cross", ("says_optical",), (), "optical_sar", "optical_sar", "optical_focus_analysis", None),
    ("cross", ("says_radar",), (), "optical_sar", "optical_sar", "sar_focus_analysis", None),
    ("cross", ("says_more",), (), "optical_sar", "optical_sar", "sar_complementary_analysis", None),
    ("cross", ("target:water",), (), "optical_sar", "optical_sar", "cross_modal_water", None),
    ("cross", ("target:built-up",), (), "optical_sar", "optical_sar", "cross_modal_builtup", None),
    ("cross", (), (), "optical_sar", "optical_sar", "cross_modal_comparative", None),
    ("temporal", ("target:built-up",), (), "bi_temporal", "bi_temporal_change", "built_up_change", None),
    ("temporal", ("target:vegetation",), (), "bi_temporal", "bi_temporal_change", "vegetation_change", None),
    ("temporal", ("target:water",), (), "bi_temporal", "bi_temporal_change", "water_change", None),
    ("temporal", (), (), "bi_temporal", "bi_temporal_change", "general_change", None),
    ("land", ("targeted",), (), "single_image", "land_cover", "land_cover", None),
    ("land", (), (), "single_image", "land_cover", "land_cover", "land_cover"),
    ("water_words", ("water_ask", "locate"), (), "single_image", "grounding", "water_grounding", "water"),
    ("target:water", ("locate",), ("scene",), "single_image", "grounding", "water_grounding", "water"),
    ("water_words", ("water_ask",), (), "single_image", "water_analysis", "water_analysis", "water"),
    ("target:water", (), ("scene",), "single_image", "water_analysis", "water_analysis", "water"),
    ("plant_words", ("plant_ask",), (), "single_image", "vegetation_analysis", "vegetation_analysis", "vegetation"),
    ("target:vegetation", (), ("scene",), "single_image", "vegetation_analysis", "vegetation_analysis", "vegetation"),
    ("buildings", (), (), "single_image", "building_detection", "building_detection", "built-up"),
    ("counting", ("roof_nouns",), (), "single_image", "building_detection", "building_detection", "built-up"),
    ("built_words", ("built_ask",), ("counting",), "single_image", "built_up_analysis", "built_up_analysis", "built-up"),
    ("target:built-up", (), ("counting", "scene"), "single_image", "built_up_analysis", "built_up_analysis", "built-up"),
    ("object", (), (), "single_image", "object_identification", "object_identification", None),
    ("identify", ("object_nouns",), (), "single_image", "object_identification", "object_identification", None),
    ("scene", (), (), "single_image", "scene_description", "scene_description", None),
    ("any", (), (), "single_image", "single_vqa", "vqa", None),
)
#: (part of a question, facts that must hold, facts that must not).
PARTS = (
    ("land_cover", ("land",), ()), ("water_analysis", ("water_words", "water_main"), ()), ("vegetation_analysis", ("plant_words", "plant_main"), ()),
    ("built_up_analysis", ("built_words", "built_main"), ()), ("building_detection", ("buildings",), ()), ("scene_description", ("scene",), ("land",)),
)


def _named(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold."""
    return F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in conditions.items()]), lambda x: x.isNotNull())


def _texts(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _table(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """A small table as one constant, an array of rows; texts, numbers and tuples of texts."""
    cell = lambda x: _texts(x) if isinstance(x, tuple) else F.lit(x).cast("int" if isinstance(x, int) else "string")
    return F.array(*[F.struct(*[cell(x).alias(n) for n, x in zip(names, row, strict=True)]) for row in rows])


def _fits(facts: Column, needs: Column, bars: Column) -> Column:
    """Do all of some facts hold, and none of others?"""
    return F.forall(needs, lambda n: F.array_contains(facts, n)) & ~F.exists(bars, lambda n: F.array_contains(facts, n))


def with_task_facts(questions: DataFrame, text: Column, images: Column, pair: Column) -> DataFrame:
    """questions with ``__target`` and ``__facts``, the names of what a question says and of what its images are.

    Each step is a column that later ones refer to, and phrases lie in one constant that is gone through per question: as one
    expression with a term per phrase, the text would be prepared again for every phrase and the code outgrow the compiler.
    """
    least = lambda words: tuple(w for w in words if not any(v != w and v in w for v in words))  # noqa: E731  others hold one of these
    phrases = _table([(n, least(words)) for n, words in PHRASES.items()], ("name", "words"))
    df = questions.withColumns({"__q": F.btrim(F.lower(F.coalesce(text, F.lit("")))), "__n": images, "__pair": pair})
    q = F.col("__q")
    said = F.filter(phrases, lambda x: F.exists(x["words"], lambda w: F.contains(q, w)))
    df = df.withColumns({"__target": tag_first(q, TARGETS), "__said": F.transform(said, lambda x: x["name"])})
    says, target, several = (lambda n: F.array_contains("__said", F.lit(n))), F.col("__target"), F.col("__n") >= 2
    more = _named({
        "unsupported": q.rlike("|".join(UNSUPPORTED)), "unclear": (F.length(q) < 3) | q.isin(*UNCLEAR), "targeted": target.isNotNull(), "any": F.lit(True),
        "cross": says("fusion") | (F.col("__pair") == "optical_sar") & (several | ~says("change")), "temporal": several | says("change") | (F.col("__pair") == "bi_temporal"),
        **{f"target:{t}": target == t for t, _ in TARGETS},
    })
    return df.withColumn("__facts", F.concat("__said", more)).drop("__q", "__n", "__pair", "__said")


def tag_tasks(questions: DataFrame, key: str, text: Column, images: Column, pair: Column) -> DataFrame:
    """(key, application, task, specific_task, target, parts, is_multi): one task per question by a decision table.

    Of the rules whose facts hold the first counts; the table is a constant, so a question is settled where it is read.
    Questions about one image may have several parts; one part is named after the task. Null questions are unclear.
    """
    facts = F.col("__facts")
    rules = _table(list(RULES), ("trigger", "needs", "bars", "application", "task", "specific", "own"))
    parts = _table(list(PARTS), ("name", "needs", "bars"))
    found = with_task_facts(questions, text, images, pair).select(
        key, "__target", F.transform(F.filter(parts, lambda p: _fits(facts, p["needs"], p["bars"])), lambda p: p["name"]).alias("__parts"),
        F.get(F.filter(rules, lambda r: F.array_contains(facts, r["trigger"]) & _fits(facts, r["needs"], r["bars"])), F.lit(0)).alias("__rule"),
    ).select(key, "__target", "__parts", "__rule.*")
    single = F.col("application") == "single_image"
    multi = single & (F.size("__parts") > 1)
    named = F.when(F.col("application").isin("unsupported", "unclear"), F.lit(None)).otherwise(F.coalesce("own", "__target"))
    own = F.when(F.col("task") == "grounding", "water_analysis").otherwise(F.col("specific"))
    return found.select(key, "application", "task", F.col("specific").alias("specific_task"), named.alias("target"), F.when(multi, F.col("__parts")).when(single, F.array(own)).otherwise(F.array().cast("array<string>")).alias("parts"), multi.alias("is_multi"))


# Words in band names, tags and file names, with the points they give.
POLARISATIONS = ("vv", "vh", "hh", "hv", "vv_sigma0", "vh_sigma0", "hh_sigma0", "hv_sigma0")
SENTINEL_BANDS = ("b01", "b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b09", "b11", "b12", "coastal", "blue", "green", "red", "rededge", "nir", "swir1", "swir2")
LANDSAT_BANDS = ("b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8", "b9", "b10", "b11", "pan", "thermal", "qa")
RADAR_TAGS = ("sar", "radar", "polaris", "sigma0", "gamma0", "beta0", "incidence_angle", "backscatter", "grd", "slc", "rtc", "c-sar", "l-sar", "s-sar", "sentinel-1", "sentinel1", "asar", "ers", "envisat", "palsar", "cosmo", "radarsat", "terrasar", "tandem", "capella", "iceye")
OPTICAL_TAGS = ("landsat", "sentinel-2", "sentinel2", "modis", "viirs", "worldview", "quickbird", "pleiades", "spot", "rapideye")
RADAR_FILES = ("sar", "radar", "s1_", "_s1_", "sentinel1", "sentinel-1", "grd", "slc", "rtc")
OPTICAL_FILES = ("rgb", "optical", "landsat", "sentinel2", "s2_", "_s2_")
PICTURES = (".png", ".jpg", ".jpeg", ".bmp", ".webp", ".gif")


def _first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of some words, in their order, that a text holds."""
    return F.element_at(F.concat(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.array(F.lit(None).cast("string"))), 1)


def modality_evidence(scenes: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """(key, nth, kind, side, points, word): every hint of a scene in the order of their weight, those of bands by number."""
    radar = F.broadcast(bands.sparkSession.createDataFrame([(w,) for w in POLARISATIONS], "word string").withColumn("pol", F.lit(True)))
    name = F.lower(F.btrim("name"))
    named = bands.select(key, "i", name.alias("word")).where("word <> ''").join(radar, "word", "left")
    kind = F.when(F.col("pol"), "polarisation").when(_first_word(F.col("word"), SENTINEL_BANDS).isNotNull(), "sentinel band").when(_first_word(F.col("word"), LANDSAT_BANDS).isNotNull(), "landsat band").when(F.col("word") == "rgb", "optical band")
    of_bands = named.withColumn("kind", kind).where("kind IS NOT NULL").select(
        key, F.col("i").cast("long").alias("nth"), "kind", F.when(F.col("pol"), "sar").otherwise("optical").alias("side"), F.when(F.col("pol"), 3).when(F.col("kind") == "sentinel band", 2).otherwise(1).alias("points"), "word"
    )
    file, tags = F.lower("file"), F.lower("tags")
    picture = F.coalesce(file.rlike("(" + "|".join(map(re.escape, PICTURES)) + ")$"), F.lit(False))
    floats = F.col("dtype").startswith("float") & ~picture & (F.col("least") < -5.0)
    scaled = floats & (F.col("least") > -60.0) & (F.col("most") < 10.0)
    hint = lambda nth, kind, side, points, word: F.struct(F.lit(1000 + nth).cast("long").alias("nth"), F.lit(kind).alias("kind"), F.lit(side).alias("side"), F.lit(points).alias("points"), word.alias("word"))
    rules = [
        (_first_word(tags, RADAR_TAGS).isNotNull(), hint(1, "radar tag", "sar", 2, _first_word(tags, RADAR_TAGS))), (_first_word(tags, OPTICAL_TAGS).isNotNull(), hint(2, "optical tag", "optical", 2, _first_word(tags, OPTICAL_TAGS))),
        (scaled, hint(3, "decibels", "sar", 3, F.lit("range"))), (floats & ~scaled, hint(3, "negative values", "sar", 1, F.lit("range"))),
        # the following count only where nothing else speaks for their side
        (~picture & (F.col("n_bands") >= 4), hint(4, "several bands", "optical?", 1, F.col("n_bands").cast("string"))),
        (_first_word(file, RADAR_FILES).isNotNull(), hint(5, "radar file", "sar?", 1, _first_word(file, RADAR_FILES))), (_first_word(file, OPTICAL_FILES).isNotNull(), hint(6, "optical file", "optical?", 1, _first_word(file, OPTICAL_FILES))),
    ]
    told = F.filter(F.array(*[F.when(F.coalesce(holds, F.lit(False)), x) for holds, x in rules]), lambda x: x.isNotNull())
    all_of = of_bands.unionByName(scenes.select(key, F.explode(told).alias("x")).select(key, "x.*"))
    weak = F.col("side").endswith("?")
    best = all_of.where(~weak).groupBy(key).agg(*[F.count_if(F.col("side") == s).alias(f"__{s}") for s in ("sar", "optical")])
    # of several weak hints for a side the first one counts
    first = all_of.where(weak).groupBy(key, "side").agg(F.min("nth").alias("__first"))
    open_ = all_of.where(weak).join(first, [key, "side"]).join(best, key, "left").withColumn("side", F.rtrim("side", F.lit("?")))
    kept = open_.where((F.col("nth") == F.col("__first")) & (F.coalesce(F.when(F.col("side") == "sar", F.col("__sar")).otherwise(F.col("__optical")), F.lit(0)) == 0))
    return all_of.where(~weak).unionByName(kept.select(*all_of.columns))


def modality_from_metadata(scenes: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """(key, modality, level, is_verified, is_calibrated, family, sar, optical, evidence): what kind of image a scene is.

    scenes (key, file, tags, dtype, n_bands, least, most, speckle, saturation, gap) and bands (key, i, name). Points for radar
    and for optics are added over all hints; three for radar or two for optics verify a sensor. Else weak radar hints, grey
    or coloured pixels, and the number of bands decide, in this order. ``evidence`` lists the hints in their order. The
    pixel columns are looked at only where nothing speaks for radar; nulls in any column are no hint.
    """
    hints = modality_evidence(scenes, bands, key)
    say = F.concat_ws(":", "kind", "word")
    sums = hints.groupBy(key).agg(
        *[F.sum(F.when(F.col("side") == s, F.col("points")).otherwise(0)).alias(s) for s in ("sar", "optical")], F.bool_or(F.col("kind") == "decibels").alias("scaled"), F.count_if((F.col("side") == "sar") & (F.col("kind") != "radar file")).alias("loud"),
        F.array_sort(F.collect_list(F.struct("nth", say.alias("s"), "kind", "word"))).alias("x"),
    )
    df = scenes.join(sums, key, "left").withColumns({s: F.coalesce(s, F.lit(0)) for s in ("sar", "optical")})
    quiet = F.coalesce("loud", F.lit(0)) == 0
    grey = quiet & (F.col("n_bands").isin(1, 2) | ((F.col("n_bands") >= 3) & ((F.col("gap") < 4.0) | (F.col("saturation") < 0.04))))
    colour = quiet & (F.col("n_bands") >= 3) & ~((F.col("gap") < 4.0) | (F.col("saturation") < 0.04))
    yes = lambda x: F.coalesce(x, F.lit(False))
    grey, colour = yes(grey), yes(colour)
    rough = yes(quiet & (F.col("speckle") > 0.20))
    words = lambda kind: F.array_distinct(F.transform(F.filter("x", lambda h: h["kind"] == kind), lambda h: h["word"]))
    pols = words("polarisation")
    tag = F.initcap(F.regexp_replace(F.element_at(F.concat(words("optical tag"), F.array(F.lit(None).cast("string"))), 1), "-", " "))
    sure_sar, sure_optical = F.col("sar") >= 3, F.col("optical") >= 2
    hint = (F.col("sar") >= 1) & (F.col("optical") == 0)
    fallback = (F.col("optical") == 1) | (F.col("n_bands") >= 3)
    by = lambda *out: F.when(sure_sar, out[0]).when(sure_optical, out[1]).when(hint | grey, out[2]).when(colour, out[3]).when(yes(fallback), out[4]).when(rough, out[2]).otherwise(out[5])
    family_sar = F.when(F.size(pols) > 0, F.concat(F.lit("SAR ("), F.upper(F.array_join(pols, "/")), F.lit(")"))).otherwise(F.coalesce(tag, F.lit("SAR (sensor family unverified)")))
    like, plain = F.lit("Visual SAR-like image"), F.lit("RGB optical image")
    return df.select(
        key, by("sar", "optical", "sar_like", "optical", "optical", "unknown").alias("modality"), by(F.when(F.col("sar") >= 5, "high").otherwise("medium"), F.lit("high"), F.lit("low"), F.lit("medium"), F.lit("low"), F.lit("low")).alias("level"),
        (sure_sar | sure_optical).alias("is_verified"), yes(F.col("scaled") & (sure_sar | sure_optical)).alias("is_calibrated"),
        by(family_sar, F.coalesce(tag, F.lit("Optical multispectral (sensor verified)")), like, plain, plain, F.coalesce(tag, F.lit("Unknown"))).alias("family"),
        F.col("sar").cast("long").alias("sar"), F.col("optical").cast("long").alias("optical"), F.coalesce(F.array_join(F.transform("x", lambda h: h["s"]), "; "), F.lit("")).alias("evidence"),
    )


#: What kind of evidence decides the family of a run's cards, the first that there is.
FAMILIES = ("water_grounding_evidence:water", "baseline_change_detection:change", "learned_change_witness:change", "land_cover_classification:cover", "building_detection_evidence:buildings", "vegetation_grounding_evidence:plants", "croma_cross_attention_fusion:fusion", "cross_sensor_agreement:fusion")
#: (family, label, form, metric, other metric, what stands for a missing one), by place. Forms: whole percent, percent of two
#: places, count, area (a share of the scene where there is no scale), confidence, and text as it is.
CARDS = (
    ("insufficient", "Status", "text", "Insufficient Evidence", None, None), ("insufficient", "Data Quality", "text", "Inconclusive Signal", None, None),
    ("no_water", "Water Coverage", "text", "0%", None, None), ("no_water", "Water Bodies", "text", "0", None, None),
    ("water", "Water Coverage", "whole", "total_coverage_percent", "largest_coverage_percent", 0.0), ("water", "Detected Area", "area image", "total_area_m2", "total_coverage_percent", 0.0), ("water", "Water Bodies", "count", "region_count", None, 1.0), ("water", "Confidence", "confidence", None, None, None),
    ("change", "Changed Area", "whole", "changed_percent", None, 0.0), ("change", "Area Changed", "area image", "area_m2", "changed_percent", 0.0), ("change", "Change Regions", "count", "region_count", None, 0.0), ("change", "Confidence", "confidence", None, None, None),
    ("cover", "Dominant Land", "class", "dominant_percent", None, 0.0), ("cover", "Vegetation", "fine", "vegetation_percent", None, 0.0), ("cover", "Built-up Area", "fine", "built_up_percent", None, 0.0), ("cover", "Water Coverage", "fine", "water_percent", None, 0.0), ("cover", "Confidence", "confidence", None, None, None),
    ("buildings", "Buildings Found", "count", "building_count", None, 0.0), ("buildings", "Built Coverage", "whole", "coverage_percent", None, 0.0), ("buildings", "Detected Area", "area scene", "area_m2", "coverage_percent", 0.0), ("buildings", "Confidence", "confidence", None, None, None),
    ("plants", "Coverage", "whole", "coverage_percent", None, 0.0), ("plants", "Detected Area", "area scene", "total_area_m2", "coverage_percent", 0.0), ("plants", "Regions", "count", "region_count", None, 1.0), ("plants", "Confidence", "confidence", None, None, None),
    ("fusion", "Sensor Agreement", "whole", "confirmed_percent", None, 0.0), ("fusion", "Confirmed Area", "area scene", "area_m2", "confirmed_percent", 0.0), ("fusion", "Agreement Regions", "count", "region_count", None, 1.0), ("fusion", "Confidence", "confidence", None, None, None),
    ("generic", "Confidence", "confidence", None, None, None), ("generic", "Status", "text", "Verified & Grounded", None, None),
)


def summary_cards(runs: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, family, place, label, value): the cards of each run, rows of a template table filled with its metrics.

    runs (key, status, confidence, scaled) and evidence (key, kind, metrics map<string, double>, word). A run's family is that
    of the first kind of ``FAMILIES`` that its evidence has; runs of insufficient evidence, or under 0.40 of confidence,
    say so, and water that is told not to be there (metric ``identified`` 0) has none. Templates meet runs in an equi-join on
    the family, broadcast; the forms write their metric. Of several pieces of evidence of a kind, the least by metrics
    as text counts. Runs without evidence get generic cards; a missing metric takes the template's stand-in.
    """
    spark = runs.sparkSession
    order = spark.createDataFrame([(i, *x.split(":")) for i, x in enumerate(FAMILIES)], "rank int, kind string, own string")
    told = evidence.join(F.broadcast(order), "kind").withColumn("__best", F.min("rank").over(W.partitionBy(key))).where(F.col("rank") == F.col("__best"))
    told = told.withColumn("__t", F.to_json("metrics"))
    first = told.groupBy(key).agg(F.min_by(F.struct("own", "metrics", "word"), "__t").alias("e"))
    poor = (F.col("status") == "insufficient_evidence") | (F.col("confidence") < 0.40)
    dry = (F.col("e.own") == "water") & (F.coalesce(F.col("e.metrics")["identified"], F.lit(1.0)) == 0.0)
    family = F.when(F.coalesce(poor, F.lit(True)), "insufficient").when(dry, "no_water").otherwise(F.coalesce("e.own", F.lit("generic")))
    df = runs.join(first, key, "left").select(key, family.alias("family"), "confidence", "scaled", F.coalesce("e.metrics", F.create_map().cast("map<string,double>")).alias("m"), F.col("e.word").alias("word"))
    cards = spark.createDataFrame([(i, *x) for i, x in enumerate(CARDS)], "place int, family string, label string, form string, metric string, other string, lack double")
    # looked up once a card, not in every form
    met = df.join(F.broadcast(cards), "family").withColumns({n: F.try_element_at("m", F.coalesce(x, F.lit(""))) for n, x in (("__a", "metric"), ("__b", "other"))})
    form, found = F.col("form"), (F.col("__a"), F.col("__b"))
    usual = lambda *x: F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in x], "lack")  # noqa: E731  a zero is no finding
    whole = lambda x: F.concat(F.bround(x, 0).cast("long").cast("string"), F.lit("%"))
    fine = lambda x: F.concat(F.format_string("%.2f", x), F.lit("%"))
    area = F.when(F.col("scaled") & (found[0] > 0), human_area(found[0])).otherwise(F.concat(whole(usual(found[1])), F.lit(" of "), F.substring_index(form, " ", -1)))
    value = F.when(form == "text", F.col("metric")).when(form == "confidence", whole(100 * F.col("confidence"))).when(form.startswith("area"), area)
    value = value.when(form == "count", usual(found[0]).cast("long").cast("string")).when(form == "fine", fine(usual(found[0]))).when(form == "whole", whole(usual(*found)))
    value = value.when(form == "class", F.concat(F.initcap(F.regexp_replace(F.coalesce("word", F.lit("land")), "_", " ")), F.lit(" ("), fine(usual(found[0])), F.lit(")")))
    return met.select(key, "family", "place", "label", value.alias("value"))
