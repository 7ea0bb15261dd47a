"""Readers of the engine's settings: source registry, taxonomy, ranking profiles and region points.

A setting is a JSON or YAML text (YAML where its library is installed). Wrong settings are errors that
name what is wrong; where a missing file has a meaning, the reader takes None: defaults for the ranking, no points for regions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import CRISIS, MONITORING, RankingConfig
from tidemark.operators.normalize import SOURCE_ALIASES


def text_of(spark: SparkSession, path: str) -> str | None:
    """A file's text, through Spark's readers; None if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.text(path, wholetext=True).head()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found[0] if found else ""


def mapping(text: str, what: str) -> dict:
    """The mapping at the root of a text; an empty text is an empty one."""
    if text.lstrip()[:1] in ("{", "["):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{what}: YAML cannot be read here, give JSON") from e
        found = yaml.safe_load(text)
    found = {} if found is None else found
    if not isinstance(found, dict):
        raise ValueError(f"{what}: the root must be a mapping")
    return found


def source_registry(text: str) -> dict[str, dict]:
    """Source -> its configuration with the defaults under it; sources stand under ``sources`` or at the root."""
    data = mapping(text, "source registry")
    sources = data.get("sources", {k: v for k, v in data.items() if k != "defaults"})
    if not isinstance(sources, dict):
        raise ValueError("source registry: 'sources' must be a mapping")
    found = {str(name): (data.get("defaults") or {}) | own for name, own in sources.items() if isinstance(own, dict)}
    if not found:
        raise ValueError("source registry: it has no source")
    return found


def source_config(registry: dict[str, dict], source_type: str) -> dict:
    """A source type's own entry, else that of its kind with the entity type that its name says."""
    if source_type in registry:
        return dict(registry[source_type])
    head, _, tail = source_type.partition("_")
    kind = head if head in SOURCE_ALIASES else source_type
    if kind not in registry:
        raise ValueError(f"source registry: no entry for {source_type}")
    return {"entity_type": tail if tail in ("comment", "article") else "post", "source": kind} | registry[kind]


def taxonomy(text: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Category -> (label, keywords), as ``text.classify`` takes it; ``other`` must be there."""
    found = mapping(text, "taxonomy").get("categories")
    if not isinstance(found, dict) or not found:
        raise ValueError("taxonomy: 'categories' must be a mapping with entries")
    out = {}
    for name, entry in found.items():
        label = str(entry.get("label", "")).strip() if isinstance(entry, dict) else ""
        words = entry.get("keywords", ()) if isinstance(entry, dict) else None
        if not label or not isinstance(words, list | tuple):
            raise ValueError(f"taxonomy: category {name} needs a label and a list of keywords")
        out[str(name)] = label, tuple(w for w in (str(x).strip().lower() for x in words) if w)
    if "other" not in out:
        raise ValueError("taxonomy: the category 'other' is missing")
    return out


def ranking(text: str | None, profile: str | None = None) -> RankingConfig:
    """Ranking settings with the weights of ``profile``, by default the active one of the file, else monitoring. None: the defaults."""
    data = mapping(text, "ranking") if text else {}
    profiles = data.get("weights") or {"monitoring": MONITORING, "crisis": CRISIS}
    name = profile or data.get("active_profile") or "monitoring"
    if name not in profiles:
        raise ValueError(f"ranking: no weight profile {name}")
    periods = data.get("snapshot_period_hours", RankingConfig.periods)
    periods = tuple(int(p) for p in (periods.split(",") if isinstance(periods, str) else periods))
    own = {"top_n": "top_n", "min_cluster_size_for_ranking": "min_cluster_size", "stale_after_hours": "stale_after_hours", "new_cluster_hours": "new_cluster_hours", "growing_threshold": "growing_threshold", "geo_max_coverage_ratio": "geo_max_coverage_ratio", "source_type_count": "source_type_count"}
    return RankingConfig(weights={str(k): float(v) for k, v in profiles[name].items()}, periods=periods, **{field: data[key] for key, field in own.items() if key in data})


def regions(spark: SparkSession, text: str | None) -> DataFrame:
    """name, lat, lon of the regions that have all three, as ``geo.locate`` takes them; a repeated name keeps its last point."""
    found = mapping(text, "regions").get("regions") if text else None
    points = {}
    for entry in found.values() if isinstance(found, dict) else ():
        if isinstance(entry, dict) and isinstance(entry.get("label"), str) and entry.get("lat") is not None and entry.get("lon") is not None:
            points[entry["label"].strip().casefold()] = entry["label"], float(entry["lat"]), float(entry["lon"])
    return spark.createDataFrame(list(points.values()), "name string, lat double, lon double")
