"""Where a document belongs: coordinates, place names, source metadata, source default."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filtering import collapsed
from tidemark.operators.text import casefold

CONFIDENCE = {"explicit_geo": 1.0, "text_toponym": 0.85, "source_metadata": 0.7, "source_default": 0.4, "unresolved": 0.0}


def _place(region: Column, municipality: Column, confidence: Column, source: str, *evidence: Column) -> Column:
    return F.struct(
        region.cast("string").alias("region_id"), municipality.cast("string").alias("municipality_id"), confidence.cast("double").alias("geo_confidence"), F.lit(source).alias("geo_source"),
        F.array(F.lit(f"selected_source:{source}"), *evidence).alias("geo_evidence"),
    )


def explicit(lat: Column, lon: Column, boxes: list[dict]) -> Column:
    """The first box that holds the point, edges included; the boxes are constants of the plan."""
    out = F
    for b in boxes:
        inside = lat.between(b["lat_min"], b["lat_max"]) & lon.between(b["lon_min"], b["lon_max"])
        where = _place(
            F.lit(b.get("region_id")), F.lit(b.get("municipality_id")), F.lit(CONFIDENCE["explicit_geo"]), "explicit_geo",
            F.concat(F.lit("coordinates:"), F.format_string("%.5f,%.5f", lat, lon)), F.lit(f"matched_area:{b.get('label') or b.get('name') or 'unnamed_area'}"),
        )
        out = out.when(inside, where)
    return out if boxes else F.lit(None)


def toponym(text: Column, aliases: list[tuple[str, dict]]) -> Column:
    """The longest alias that stands in the text as a whole word, wherever it stands."""
    t = collapsed(casefold(F.coalesce(text, F.lit(""))))
    out = F
    for alias, entry in sorted(aliases, key=lambda p: -len(p[0])):
        at = t.rlike(rf"(?U)(?<!\w){re.escape(alias.casefold())}(?!\w)")
        out = out.when(at, _place(
            F.lit(entry.get("region_id")), F.lit(entry.get("municipality_id")), F.lit(entry.get("confidence", CONFIDENCE["text_toponym"])), "text_toponym",
            F.lit(f"matched_toponym:{alias}"), F.lit(f"resolved_region:{entry.get('region_id')}"),
        ))
    return out if aliases else F.lit(None)


def from_config(entry: dict | None, source: str, label_key: str, default_label: str) -> Column:
    if not entry or (entry.get("region_id") is None and entry.get("municipality_id") is None):
        return F.lit(None)
    return _place(
        F.lit(entry.get("region_id")), F.lit(entry.get("municipality_id")), F.lit(entry.get("confidence", CONFIDENCE[source])), source,
        F.lit(f"{label_key}:{entry.get('label') or entry.get('source') or default_label}"), F.lit(f"resolved_region:{entry.get('region_id')}"),
    )


def default_entry(config: dict) -> dict | None:
    if config.get("default_geo") is not None:
        return config["default_geo"]
    entry = {"region_id": config.get("default_region_id"), "municipality_id": config.get("default_municipality_id"), "label": config.get("default_region_label")}
    if config.get("default_geo_confidence") is not None:
        entry["confidence"] = config["default_geo_confidence"]
    return entry


def enrich(df: DataFrame, config: dict, *, languages: tuple[str, ...] = ("ru",), text_col: str = "text") -> DataFrame:
    """Adds region_id, municipality_id, geo_confidence, geo_source, geo_evidence; the first of
    the four ways that finds a place wins. Names are read only in a supported language."""
    lang = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    reads = F.coalesce("is_supported_language", F.lit(False)) & lang.isin(*languages)
    skipped = F.when(~reads, F.array(F.concat(F.lit("text_toponym_skipped:unsupported_language:"), F.coalesce(F.nullif(lang, F.lit("")), F.lit("unknown")))))
    unresolved = F.struct(
        F.lit(None).cast("string").alias("region_id"), F.lit(None).cast("string").alias("municipality_id"), F.lit(0.0).alias("geo_confidence"), F.lit("unresolved").alias("geo_source"),
        F.array(F.lit("selected_source:unresolved"), F.lit("geo_unresolved:no_matching_source")).alias("geo_evidence"),
    )
    way = F.coalesce(
        explicit(F.col("geo_lat"), F.col("geo_lon"), config.get("explicit_geo_regions", [])),
        F.when(reads, toponym(F.col(text_col), config.get("toponyms", []))),
        from_config(config.get("metadata_geo"), "source_metadata", "metadata_label", "channel_metadata"),
        from_config(default_entry(config), "source_default", "default_label", "source_default"),
        unresolved,
    )
    df = df.withColumn("_g", way)
    return df.withColumns({
        **{c: F.col("_g")[c] for c in ("region_id", "municipality_id", "geo_confidence", "geo_source")},
        "geo_evidence": F.concat(F.coalesce(skipped, F.array().cast("array<string>")), F.col("_g")["geo_evidence"]),
    }).drop("_g")


def nearest(points: DataFrame, regions: list[tuple[str, float, float]], lat: str, lon: str) -> DataFrame:
    """Adds ``nearest_region``: least squared degree distance, the first of equals. The regions
    are constants of the plan, so nothing is joined."""
    options = F.array(*[F.struct((F.pow(F.col(lat) - a, 2) + F.pow(F.col(lon) - b, 2)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, a, b) in enumerate(regions)])
    return points.withColumn("nearest_region", F.array_min(options)["name"])


def locate(labels: DataFrame, regions: DataFrame, label_col: str = "region") -> DataFrame:
    """Labels that have a point, by case-folded name; ``regions``: name, lat, lon (a fixed gazetteer)."""
    r = regions.select(casefold(F.trim("name")).alias("_k"), "lat", "lon")
    return labels.join(F.broadcast(r), casefold(F.trim(label_col)) == F.col("_k")).drop("_k")


def coordinates_of(text: Column) -> Column:
    """struct(lat, lon) of a "lat lon" string if both lie in range."""
    p = F.split(F.trim(text), r"[\s,;]+")
    lat, lon = F.try_element_at(p, F.lit(1)).try_cast("double"), F.try_element_at(p, F.lit(2)).try_cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


# Region names and the word patterns that stand for them.
REGION_PATTERNS = {
    "Москва": (r"\bмоскв[а-яё-]*\b", r"\bмосковск(?:ая|ой|ую)\s+област[ьи]\b"),
    "Санкт-Петербург": (r"\bсанкт[-\s]?петербург[а-яё-]*\b", r"\bпитер[аеуы]?\b"),
    "Ростовская область": (r"\bростов(?:-на-дону)?[а-яё-]*\b", r"\bростовск(?:ая|ой|ую)\s+област[ьи]\b"),
    "Волгоградская область": (r"\bволгоград[а-яё-]*\b", r"\bволгоградск(?:ая|ой|ую)\s+област[ьи]\b"),
    "Краснодарский край": (r"\bкраснодар[а-яё-]*\b", r"\bкраснодарск(?:ий|ого|ом)\s+кра[йяе]\b"),
    "Нижегородская область": (r"\bнижн(?:ий|его)\s+новгород[аеуы]?\b", r"\bнижегородск(?:ая|ой|ую)\s+област[ьи]\b"),
}
# Payload fields whose text may name a region; fields that may hold coordinates.
REGION_FIELDS = (
    "geo.place.title", "geo.place.city", "geo.place.country", "place.title", "location.title", "location.region", "location.city",
    "group.name", "group.screen_name", "author", "source.title", "title", "summary", "description",
)
POINT_FIELDS = (
    ("geo.coordinates.latitude", "geo.coordinates.longitude"), ("geo.lat", "geo.lon"), ("geo.latitude", "geo.longitude"),
    ("location.lat", "location.lon"), ("location.latitude", "location.longitude"), ("lat", "lon"), ("latitude", "longitude"),
)


def region_of(text: Column) -> Column:
    t, out = F.lower(text), F
    for name, patterns in REGION_PATTERNS.items():
        out = out.when(t.rlike("(?U)" + "|".join(patterns)), name)
    return out


def region_hint(text: Column, payload: Column) -> Column:
    """The payload's own region, else the first region named in the text or in its fields (``payload``: JSON text)."""
    own = [F.nullif(F.trim(F.get_json_object(payload, f"$.{k}")), F.lit("")) for k in ("region_hint", "region")]
    return F.coalesce(*own, region_of(text), *[region_of(F.get_json_object(payload, f"$.{f}")) for f in REGION_FIELDS])


def point_of(payload: Column) -> Column:
    """struct(lat, lon) of the first pair of fields in range, else of a "lat lon" string."""
    number = lambda f: F.replace(F.trim(F.get_json_object(payload, f"$.{f}")), F.lit(","), F.lit(".")).try_cast("double")
    valid = lambda a, b: F.when(a.between(-90, 90) & b.between(-180, 180), F.struct(a.alias("lat"), b.alias("lon")))
    pairs = [valid(number(a), number(b)) for a, b in POINT_FIELDS]
    return F.coalesce(*pairs, coordinates_of(F.get_json_object(payload, "$.geo.coordinates")))
