"""Scalar expressions: names, keys, dates, bands."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of polygon names and what they stand for.
KINDS = {"I": "Tree", "Gp": "Group", "Gs": "Grassland", "C": "Cropland", "S": "Shrubs", "O": "Other", "X": "DeadTree"}
# The two ways in which picture names hold their time.
MINUTE_NAME = r"(\d{4}-\d{2}-\d{2}_\d{4})\.(jpg|png|jpeg|jp2)"
SECOND_NAME = r"(\d{4}_\d{4}_\d{6})\.(jpg|png|jpeg|jp2)"
#: Picture files by the end of their lower-cased name.
PICTURES = (".jpg", ".jpeg", ".jp2", "jp2k")


def full_name(name: Column) -> Column:
    """"I.12" -> "Tree0012": the kind and the number padded to four digits; null for an unknown kind."""
    kinds = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in KINDS.items()))
    parts = F.split(name, r"\.", -1)
    number = F.get(parts, 1)
    return F.concat(F.try_element_at(kinds, F.get(parts, 0)), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")))


def product_prefix(stem: Column, full_name: Column) -> Column:
    """"Tree0012-GCC-3D-p90-transitions" -> "GCC_3D_p90"; null for other files."""
    inner = F.substring(stem, F.length(full_name) + 2, F.length(stem) - F.length(full_name) - F.lit(1 + len("-transitions")))
    return F.when(stem.endswith("-transitions"), F.replace(inner, F.lit("-"), F.lit("_")))


def uid_of(full_name: Column) -> Column:
    return F.split(full_name, "_")[0]


def site_label(name: Column, overrides: dict[str, str] | None = None) -> Column:
    """What follows the last colon, trimmed; or the override for the whole name."""
    label = F.trim(F.element_at(F.split(name, ":"), -1))
    if not overrides:
        return label
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in overrides.items()))
    return F.coalesce(F.try_element_at(known, name), label)


def deviation_key(key: Column) -> Column:
    """"GU_50_std" -> "GU_50-std"."""
    return F.regexp_replace(key, "_std$", "-std")


def compact_name(species: Column) -> Column:
    """"Fagus sylvatica" -> "F. sylvatica"."""
    return F.concat(F.substring(species, 1, 1), F.lit(". "), F.element_at(F.split(species, " "), -1))


def elevation_band(metres: Column) -> Column:
    # Bands and their upper ends in metres.
    chosen = F.when(metres < 600, "Low").when(metres < 1000, "Mid").when(metres < 1500, "High").otherwise("Very High")
    return F.when(metres.isNotNull() & ~F.isnan(metres), chosen)


def is_station(location: Column) -> Column:
    """Four digits: a station of the national service."""
    return location.rlike("^[0-9]{4}$")


def camera_type(location: Column) -> Column:
    return F.when(is_station(location), "analysis").otherwise("panorama")


def picture_time(path: Column) -> Column:
    """Local time in a picture's name, without a zone; null if there is none or no such date."""
    name = F.element_at(F.split(path, "/"), -1)
    minute = F.try_to_timestamp(F.nullif(F.regexp_extract(name, MINUTE_NAME, 1), F.lit("")), F.lit("yyyy-MM-dd_HHmm"))
    second = F.try_to_timestamp(F.nullif(F.regexp_extract(name, SECOND_NAME, 1), F.lit("")), F.lit("yyyy_MMdd_HHmmss"))
    return F.when(name.rlike(MINUTE_NAME), minute).otherwise(second).cast("timestamp_ntz")


def is_picture(path: Column) -> Column:
    lower = F.lower(F.element_at(F.split(path, "/"), -1))
    found = lower.endswith(PICTURES[0])
    for end in PICTURES[1:]:
        found = found | lower.endswith(end)
    return found


def observation_key(ts: Column) -> Column:
    """Time as it stands in observation files."""
    return F.date_format(ts, "yyyy-MM-dd_HHmm")


def date_of_doy(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy.cast("int") - 1)


def site_year(location: Column, sublocation: Column, year: Column) -> Column:
    return F.concat(location, F.lit("_"), sublocation, F.lit("-"), year.cast("string"))


def split_site_year(key: Column) -> list[Column]:
    """location, sublocation, year of a composite key."""
    site = F.split(key, "-", 2)
    place = F.split(site[0], "_", 2)
    return [place[0].alias("location"), F.get(place, 1).alias("sublocation"), F.get(site, 1).alias("year")]


def season_length(up: Column, down: Column) -> Column:
    return down - up


def date_key(prefix: Column, direction: str, threshold: Column) -> Column:
    return F.concat(prefix, F.lit(f"{direction}_"), F.round(threshold * 100).cast("int").cast("string"))


def hex_to_bgr(colour: Column) -> Column:
    part = lambda i: F.conv(F.substring(F.ltrim(colour, F.lit("#")), i, 2), 16, 10).cast("int")
    return F.array(part(5), part(3), part(1))


def guarded(value: Column) -> Column:
    """1e-6 in place of zero, as a divisor."""
    return F.when(value == 0, 1e-6).otherwise(value)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def shoelace(ring: Column) -> Column:
    """Area of a ring of [x, y] points (closed or not)."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, following, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, x: s + x)) / 2


def extent(ring: Column, axis: int) -> Column:
    """Width (axis 0) or height (axis 1) of a ring's bounding box."""
    values = F.transform(ring, lambda p: p[axis])
    return F.array_max(values) - F.array_min(values)


def colour_ratios(red: Column, green: Column, blue: Column) -> list[Column]:
    """Aggregates over rows: mean channel by mean brightness (gcc, rcc, bcc) and mean brightness."""
    total = guarded(F.avg(red + green + blue))
    return [(F.avg(green) / total).alias("gcc"), (F.avg(red) / total).alias("rcc"), (F.avg(blue) / total).alias("bcc"), total.alias("brightness")]
