"""Questions, names and reports as column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and labels that the results must use.
DECREASE = ("decrease", "loss", "decline", "reduction", "less", "dropped", "shrunk")
UNCLEAR = ("hello", "hi", "hey", "test", "run", "do it", "analyze", "check", "what", "ok", "please")
PREPOSITIONS = ("in", "within", "around", "near")
#: What may follow a place, as patterns: the start of a period, or the end of a clause.
AFTER_PLACE = (" +between", " +from", " +in +[0-9]{4}", "[,.?!]")
INDEX_BANDS = {"NDVI": ("nir", "red"), "NDWI": ("green", "nir"), "NDBI": ("swir", "nir")}


def change_direction(text: Column) -> Column:
    return F.when(F.lower(text).rlike("|".join(DECREASE)), "decrease").otherwise("increase")


def is_unclear(text: Column) -> Column:
    x = F.btrim(F.lower(text))
    return (F.length(x) < 3) | x.isin(*UNCLEAR)


def place(text: Column) -> Column:
    """The phrase after a preposition, up to a period of time or the end of the clause; NULL if there is none."""
    lead = "|".join(PREPOSITIONS)
    rest = F.regexp_extract(F.regexp_replace(F.lower(text), r"\s+", " "), rf"(?:^|[^a-z0-9_])(?:{lead}) ([a-z].*)", 1)
    phrase = F.regexp_replace(rest, rf"({'|'.join(AFTER_PLACE)}).*$", "")
    return F.when(F.length(phrase).between(2, 61) & ~phrase.rlike("[^a-z0-9 _-]"), F.btrim(phrase))


def coordinates(text: Column) -> tuple[Column, Column, Column]:
    """(lat, lon, error) of "mark 12.3, 45.6"; values out of range leave NULLs and an error."""
    form = r"(?i)\bmark\s+(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"
    lat, lon = (F.nullif(F.regexp_extract(text, form, i), F.lit("")).cast("double") for i in (1, 2))
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, lat), F.when(ok, lon), F.when(~ok, F.lit("out of range"))


def topic_title(text: Column, most: int = 28) -> Column:
    """The first four words, in title case; longer than ``most`` characters: cut, with three dots."""
    words = F.filter(F.split(F.btrim(F.regexp_replace(text, r"[^\w\s]", "")), r"\s+"), lambda x: x != "")
    short = F.initcap(F.array_join(F.slice(words, 1, 4), " "))
    return F.when(F.size(words) == 0, "Geospatial Analysis").when(F.length(short) <= most, short).otherwise(F.concat(F.substring(short, 1, most - 3), F.lit("...")))


def strip_words(text: Column, words: str = "left|right|top|bottom") -> Column:
    """Without remarks such as "(left)"."""
    return F.btrim(F.regexp_replace(text, rf"\s*\((?i:{words})\)", ""))


def named_scores(text: Column) -> Column:
    """"Name (0.94), Other (0.91)" as an array of (name, score)."""
    form = r"([A-Za-z][A-Za-z ]*?) \((\d+\.\d+)\)"
    names, scores = F.regexp_extract_all(text, F.lit(form), F.lit(1)), F.regexp_extract_all(text, F.lit(form), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("n"), scores.alias("s")), lambda x: F.struct(x["n"].alias("name"), x["s"].cast("double").alias("score")))


def numbers_in_list(text: Column) -> Column:
    """"[8, 10]" as an array of integers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int"))


def coverage_entries(text: Column) -> Column:
    """Array of (class, pixels, percent) from "62279 pixels (4.05%) water", else from "water: 62279 pixels (4.05%)"."""
    def found(form: str, order: tuple[int, int, int]) -> Column:
        part = [F.regexp_extract_all(text, F.lit(form), F.lit(i)).alias(f"p{i}") for i in (1, 2, 3)]
        kind, pixels, percent = (f"p{i}" for i in order)
        return F.transform(F.arrays_zip(*part), lambda x: F.struct(F.lower(x[kind]).alias("class"), x[pixels].cast("long").alias("pixels"), x[percent].cast("double").alias("percent")))

    first = found(r"(\d+) pixels \((\d+(?:\.\d+)?)%\) ([A-Za-z]+)", (3, 1, 2))
    return F.when(F.size(first) > 0, first).otherwise(found(r"([A-Za-z]+): (\d+) pixels \((\d+(?:\.\d+)?)%\)", (1, 2, 3)))


def quality_label(percent: Column, model: bool = False) -> Column:
    """A share of the scene in words; a model's classes have bounds of their own."""
    steps = [(35, "Dominant"), (10, "Moderate"), (0.5, "Detected")] if model else [(35, "Dominant"), (15, "Moderate"), (2, "Detected"), (0.2, "Low")]
    out = F.when(percent >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        out = out.when(percent >= least, label)
    return (out.when(percent > 0, "Trace") if model else out).otherwise("None")


def available_indices(roles: Column) -> Column:
    """Names of the indices all of whose bands are there."""
    return F.filter(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, need)), roles)) == 0, F.lit(name)) for name, need in INDEX_BANDS.items()]), lambda x: x.isNotNull())


def modality(roles: Column, polarised: Column) -> Column:
    """sar, multispectral, optical or unknown, from band roles and whether any polarisation is named."""
    rgb = F.size(F.array_except(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), roles)) == 0
    return F.when(polarised, "sar").when(F.arrays_overlap(roles, F.array(F.lit("nir"), F.lit("swir"), F.lit("swir2"))), "multispectral").when(rgb, "optical").otherwise("unknown")
