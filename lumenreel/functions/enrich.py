"""Buckets, names and merges of what detectors report; pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenreel.schema import COLORS, STATUS_ORDER

#: Thresholds with names, from the top down or from the bottom up; languages with locales.
SHOTS = ((0.40, "extreme close-up"), (0.15, "close-up"), (0.05, "medium close-up"), (0.015, "medium shot"))
LIGHTS = ((0.15, "very dark"), (0.3, "dark"), (0.7, "normal"), (0.85, "bright"))
HUES = ((15, "red"), (45, "orange"), (75, "yellow"), (150, "green"), (195, "cyan"), (260, "blue"), (290, "purple"), (330, "pink"))
LOCALES = {
    "zh": "zh_CN", "ja": "ja_JP", "en": "en_US", "ko": "ko_KR", "fr": "fr_FR", "de": "de_DE", "es": "es_ES", "it": "it_IT", "pt": "pt_BR", "ru": "ru_RU", "ar": "ar_SA",
    "nl": "nl_NL", "sv": "sv_SE", "da": "da_DK", "fi": "fi_FI", "nb": "nb_NO", "tr": "tr_TR", "th": "th_TH", "vi": "vi_VN", "ms": "ms_MY", "he": "he_IL",
}


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def shot_bucket(face_area: Column) -> Column:
    """The shot type of the largest face's share of the picture; null (no face) is a wide shot."""
    out = F.lit("wide shot")
    for least, name in reversed(SHOTS):
        out = F.when(face_area >= least, name).otherwise(out)
    return out


def max_face_area(faces: Column) -> Column:
    return F.array_max(F.transform(faces, lambda f: f["width"] * f["height"]))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def lighting_bucket(value: Column) -> Column:
    out = F.lit("very bright")
    for below, name in reversed(LIGHTS):
        out = F.when(value < below, name).otherwise(out)
    return out


def nearest_color(r: Column, g: Column, b: Column) -> Column:
    """The name of a colour given as 0 to 255."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    light, delta = (most + least) / 2, most - least
    saturation = F.when(delta == 0, 0.0).otherwise(F.try_divide(delta, 1 - F.abs(2 * light - 1)))
    turn = F.when(most == r, F.try_divide(g - b, delta) + F.when(g < b, 6.0).otherwise(0.0)).when(most == g, 2 + F.try_divide(b - r, delta)).otherwise(4 + F.try_divide(r - g, delta))
    name = F.lit("red")
    for below, color in reversed(HUES):
        name = F.when(turn * 60 < below, color).otherwise(name)
    gray = F.when(light < 0.2, "black").when(light > 0.8, "white").otherwise("gray")
    return F.when(saturation < 0.12, gray).otherwise(name)


def palette(names: Column) -> Column:
    """Distinct colour names in order; null without any."""
    return F.when(F.size(names) > 0, F.array_join(F.array_distinct(names), " "))


def subjects(faces: Column, humans: Column) -> Column:
    n = F.greatest(F.coalesce(faces, F.lit(0)), F.coalesce(humans, F.lit(0)))
    return F.when(n <= 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("person"))).otherwise(F.array(F.concat(n.cast("string"), F.lit(" people"))))


def scene_and_objects(labels: Column, threshold: float = 0.1, most: int = 8) -> Column:
    """struct(scene, objects) of an array of struct(identifier, confidence)."""
    kept = F.filter(labels, lambda x: x["confidence"] >= threshold)
    ordered = F.array_sort(kept, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(F.when(a["identifier"] < b["identifier"], -1).when(a["identifier"] > b["identifier"], 1).otherwise(0)))
    names = F.transform(F.slice(ordered, 1, most), lambda x: F.replace(x["identifier"], F.lit("_"), F.lit(" ")))
    return F.struct(F.get(names, 0).alias("scene"), F.filter(names, lambda x, i: i > 0).alias("objects"))


def locale(language: Column) -> Column:
    """The locale of a language code; unknown and null: en_US."""
    low = F.lower(language)
    return F.coalesce(lookup(LOCALES, low), lookup(LOCALES, F.substring_index(low, "-", 1)), F.lit("en_US"))


def concurrency(cores: Column, mode: Column, low_power: Column, thermal: Column, memory_mb: Column) -> Column:
    """How many jobs may run, from the machine's state."""
    half = lambda x: F.greatest(F.lit(1), F.floor(x / 2).cast("int"))
    eff = F.when(low_power, "background").otherwise(mode)
    base = F.when(eff == "full_speed", F.greatest(F.lit(2), cores - 2)).when(eff == "balanced", half(cores)).otherwise(F.greatest(F.lit(1), F.floor(cores / 4).cast("int")))
    warm = F.when(thermal == "critical", 1).when(thermal == "serious", half(base)).when(thermal == "fair", F.greatest(F.lit(1), F.floor(base * 3 / 4).cast("int"))).otherwise(base)
    return F.when(memory_mb < 512, 1).when(memory_mb < 1024, half(warm)).otherwise(warm).cast("int")


def rating(value: Column) -> Column:
    """Clamped to 0 to 5; null is 0."""
    return F.least(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)), F.lit(5)).cast("int")


def color_or_null(label: Column) -> Column:
    return F.when(label.isin(*COLORS), label)


def finder_tags(tags: Column, label: Column) -> Column:
    """Tags without colour names, with the label's name and number appended."""
    kept = F.filter(tags, lambda t: ~t.isin(*[c.capitalize() for c in COLORS]))
    mark = F.concat(F.initcap(label), F.lit("\n"), lookup(COLORS, label).cast("string"))
    return F.when(label.isNull(), kept).otherwise(F.concat(kept, F.array(mark)))


def status_order(status: Column) -> Column:
    return lookup(STATUS_ORDER, status)


def frames_per_scene(duration: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(3), F.floor(duration / 5).cast("int")))
