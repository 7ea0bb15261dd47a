"""Settings, exports, and small functions that no query covers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import CRISIS, MONITORING
from tidemark.operators import dedup, geo, ranking, serving, summarize, vectors
from tidemark.sources import files, settings

REGISTRY = """
defaults:
  timezone: "+03:00"
  is_official: false
sources:
  vk_post: {source: vk, default_region: North}
  vk: {timezone: "+05:00"}
  broken: 3
"""


def test_source_registry():
    r = settings.source_registry(REGISTRY)
    assert r == {"vk_post": {"timezone": "+03:00", "is_official": False, "source": "vk", "default_region": "North"}, "vk": {"timezone": "+05:00", "is_official": False}}
    assert settings.source_registry(json.dumps({"defaults": {"a": 1}, "sources": {"x": {"b": 2}}})) == {"x": {"a": 1, "b": 2}}
    assert settings.source_registry('{"rss": {"a": 1}}') == {"rss": {"a": 1}}  # sources at the root
    assert settings.source_config(r, "vk_post")["default_region"] == "North"
    assert settings.source_config(r, "vk_comment") == {"entity_type": "comment", "source": "vk", "timezone": "+05:00", "is_official": False}
    for text in ("[1]", "sources: 5", "", "a: 1"):
        with pytest.raises(ValueError, match="source registry"):
            settings.source_registry(text)
    with pytest.raises(ValueError, match="fax_page"):
        settings.source_config(r, "fax_page")


def test_taxonomy():
    t = settings.taxonomy("categories:\n  roads: {label: Roads, keywords: [' Pit ', bus, '']}\n  other: {label: Other}\n")
    assert t == {"roads": ("Roads", ("pit", "bus")), "other": ("Other", ())}
    for text, what in (("categories: {}", "entries"), ("categories: {a: {label: A}}", "other"), ("categories: {other: {label: ' '}}", "label"), ("categories: {other: {label: O, keywords: word}}", "keywords"), ("- a", "mapping")):
        with pytest.raises(ValueError, match=what):
            settings.taxonomy(text)


def test_ranking_settings():
    assert settings.ranking(None).weights == MONITORING and settings.ranking(None, "crisis").weights == CRISIS
    text = json.dumps({"active_profile": "crisis", "top_n": 5, "min_cluster_size_for_ranking": 3, "snapshot_period_hours": "6, 12", "weights": {"monitoring": MONITORING, "crisis": CRISIS, "bad": {"volume": 1}}})
    c = settings.ranking(text)
    assert (c.weights, c.top_n, c.min_cluster_size, c.periods, c.stale_after_hours) == (CRISIS, 5, 3, (6, 12), 48)
    assert settings.ranking(text, "monitoring").weights == MONITORING
    for profile, what in (("none", "none"), ("bad", "weights")):
        with pytest.raises(ValueError, match=what):
            settings.ranking(text, profile)


def test_regions_and_points(spark, tmp_path):
    text = "regions:\n  a: {label: North Town, lat: 1.5, lon: 2}\n  b: {label: ' north town ', lat: 3, lon: 4}\n  c: {label: No point}\n  d: {label: South, lat: 5, lon: 6}\n  e: 7\n"
    (tmp_path / "regions").write_text(text)
    r = settings.regions(spark, settings.text_of(spark, f"{tmp_path}/regions"))
    assert sorted(map(tuple, r.collect())) == [(" north town ", 3.0, 4.0), ("South", 5.0, 6.0)]
    assert settings.text_of(spark, f"{tmp_path}/none") is None and settings.regions(spark, None).count() == 0 and settings.regions(spark, "regions: [1]").count() == 0
    located = geo.locate(spark.createDataFrame([("NORTH town", 1), ("South ", 2), ("West", 3), (None, 4)], "region string, n int"), r)
    assert sorted((x.n, x.lat, x.lon) for x in located.collect()) == [(1, 3.0, 4.0), (2, 5.0, 6.0)]
    assert tuple(serving.map_points(located).head()) == (4.0, 5.0) and tuple(serving.map_points(located.limit(0)).head()) == serving.MAP_CENTER
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 3, 100, 308, 494, 10_000)], "n int").select(serving.marker_radius(F.col("n")).alias("r")).collect()
    assert [x.r for x in sizes] == [max(8, min(28, int(8 + max(n, 1) ** 0.5 * 0.9 + 0.5))) for n in (0, 1, 3, 100, 308, 494, 10_000)]


def items(spark):
    parts = {f"{c}_component": 0.1 * i for i, c in enumerate(ranking.COMPONENTS)}
    at = dt.datetime(2024, 1, 1)
    row = {"rank": 1, "cluster_id": 7, "summary": "a, \"b\"", "category": "roads", "mention_count": 5, "unique_authors": 2, "reach_total": 9, "growth_rate": 2.5, "geo_regions": ["A", "B"], "sources": [("rss", 3), ("vk_post", 2)], "score": 0.5, "urgency": "low", "period_start": at, "period_end": at, "computed_at": at} | parts
    kinds = "rank int, cluster_id int, summary string, category string, mention_count long, unique_authors long, reach_total long, growth_rate double, geo_regions array<string>, sources array<struct<source_type:string,count:long>>, score double, urgency string, period_start timestamp_ntz, period_end timestamp_ntz, computed_at timestamp_ntz"
    return spark.createDataFrame([tuple(row.values())], kinds + "".join(f", {p} double" for p in parts))


def test_exports(spark, tmp_path):
    serving.export_csv(items(spark), f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/csv")
    r = back.head()
    assert back.columns == list(serving.EXPORT_COLUMNS) and r.summary == 'a, "b"' and r.geo_regions == "A;B" and r.sources == "rss:3;vk_post:2" and r.period_start == "2024-01-01T00:00:00+00:00"
    sheets = serving.export_sheets(items(spark))
    assert set(sheets) == {"top", "breakdown", "sources"} and [tuple(x) for x in sheets["sources"].collect()] == [(1, 7, "rss", 3), (1, 7, "vk_post", 2)]
    assert sheets["breakdown"].columns == ["rank", "cluster_id", "volume", "dynamics", "sentiment", "reach", "geo", "source", "итого"] and sheets["breakdown"].head().geo == pytest.approx(0.4)
    files.write_jsonl(items(spark).select("rank", "summary"), f"{tmp_path}/lines")
    files.write_jsonl(items(spark).select("rank", "summary"), f"{tmp_path}/lines")
    assert [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/lines").collect()] == [{"rank": 1, "summary": 'a, "b"'}] * 2


def test_explanation_without_weights(spark):
    """Without weights the largest parts are named as they are; ties go by the order of the components."""
    rows = items(spark).withColumnsRenamed({"mention_count": "size"}).withColumns({"is_new": F.lit(True), "is_growing": F.lit(True)})
    assert ranking.explain(rows).head().explanation == "Ранг 1: 5 упоминаний; тема появилась менее 3 часов назад; рост в 2.5x за последние 6 часов; охватывает 2 районов. Основные факторы: разнообразие источников и гео-покрытие."
    flat = rows.withColumns({f"{c}_component": F.lit(0.2) for c in ranking.COMPONENTS})
    assert ranking.explain(flat).head().explanation.endswith("объём упоминаний и динамика роста.")


def test_lexical_duplicates(spark):
    """Titles from 0.92, texts from 0.97, either from 0.94; matching blocks as the standard library has them."""
    from difflib import SequenceMatcher

    pairs = [("water main broke", "water main broke!", "a", "b"), ("x", "y", "the very same long text here", "the very same long text here"), ("abcdefgh", "abcdefgx", "t", "u"), (None, "", "a", "b"), ("one", "two", None, "x")]
    df = spark.createDataFrame(pairs, "t1 string, t2 string, x1 string, x2 string")
    got = [r.d for r in df.select(dedup.lexical_duplicate(*map(F.col, ("t1", "t2", "x1", "x2"))).alias("d")).collect()]
    ratio = lambda a, b: SequenceMatcher(None, a or "", b or "").ratio()
    assert got == [ratio(a, b) >= 0.92 or ratio(c, d) >= 0.97 or max(ratio(a, b), ratio(c, d)) >= 0.94 for a, b, c, d in pairs] == [True, True, False, True, False]


def test_prompt_files_and_models(spark):
    text = "intro\n## system\nBe brief.\n## user\n```\nTopic {size}\n```\n"
    assert summarize.sections(text, ("system", "user")) == {"system": "Be brief.", "user": "Topic {size}"}
    assert len(summarize.prompt_version(text)) == 16 and summarize.prompt_version(text) != summarize.prompt_version(text + " ")
    with pytest.raises(ValueError, match="other"):
        summarize.sections(text, ("other",))
    df = spark.createDataFrame([("a", "text")], "doc_id string, text_used string")
    assert len(vectors.encode(df, vectors.hashed_backend(4), 4).head().embedding) == 4
    with pytest.raises(Exception, match="must give 5"):
        vectors.encode(df, vectors.hashed_backend(4), 5).collect()
