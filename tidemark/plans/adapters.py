"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FilterConfig

NOW = dt.datetime(2024, 1, 30)
UNDESCRIBED, UNREVIEWED, NOISE = 3, 5, 7

# Lexicons in the languages of the driver's texts.
FILTER = FilterConfig(
    spam_signatures=("buy now", "free offer", "subscribe"), ad_hashtags=("#ad", "#sale"), noise_markers=("ok", "test", "..."),
    complaint_markers=("is it", "not ", "again", "problem"), relevant_short_markers=("fire", "bridge"),
)
TAXONOMY = {
    "articles": ("Articles", ("the", "der", "le", "el")), "links": ("Links", ("and", "und", "et", "y", "of the")), "places": ("Places", ("on", "in", "dans", "en la", "auf")), "other": ("Other", ()),
}
SENTIMENT = {"click": 0.25, "error": -0.75, "purchase": 0.75, "signup": 0.0, "view": -0.25}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def ranking_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_n"), F.col("n_name").alias("region"))
    e = table(spark, sf_dir, "events").withColumn("_n", (F.col("user_id") % 25).cast("int")).join(F.broadcast(nation), "_n", "left")  # 25 nations
    mood = F
    for k, v in SENTIMENT.items():
        mood = mood.when(F.col("event_type") == k, F.lit(v))
    m = F.col("event_id") % 3
    return e.select(
        F.col("event_id").alias("doc_id"), (k_of(F.col("props")) % 12).alias("cluster_id"), F.col("user_id").alias("author_id"), F.col("event_type").alias("source_type"), F.col("ts").alias("created_at"),
        F.floor("value").alias("reach"), "region", F.when(m == 0, 1.0).when(m == 1, 0.5).otherwise(0.25).alias("quality_weight"), mood.alias("sentiment_score"),
        F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("user_id") % 4)).alias("category"), F.concat(F.lit("C"), F.col("user_id") % 4).alias("category_label"),
    )


def clusters(spark: SparkSession) -> DataFrame:
    c = F.col("cluster_id")
    return spark.range(12).select(
        F.col("id").cast("int").alias("cluster_id"), (F.col("id") == NOISE).alias("noise"), (F.col("id") != UNDESCRIBED).alias("described"), (F.col("id") == UNREVIEWED).alias("needs_review")
    ).withColumn("cluster_id", c)


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text", F.col("source").alias("author_id"), F.col("lang").alias("language"), F.lit(True).alias("is_supported_language"), (F.col("doc_id") % 10 == 0).alias("is_official"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)").alias("created_at"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"), "embedding")


def payloads(spark: SparkSession, sf_dir: str) -> dict[str, tuple[dict, DataFrame]]:
    """Source -> (its configuration, rows of JSON): the events by event_id mod 4, with null and missing keys."""
    e = table(spark, sf_dir, "events").withColumn("k", k_of(F.col("props")))
    i, secs = F.col("event_id"), F.unix_seconds(F.col("ts").cast("timestamp"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    some = lambda c, v: F.when(c, v)
    vk = F.struct(
        i.alias("id"), (-F.col("user_id")).alias("owner_id"), F.col("user_id").alias("from_id"), F.concat(F.lit("post "), F.col("event_type")).alias("text"), secs.alias("date"),
        F.struct(F.floor("value").alias("count")).alias("views"), F.struct(F.col("k").alias("count")).alias("likes"), some(i % 8 == 0, i % 100).alias("post_id"),
        F.array(F.struct(F.when(i % 3 == 0, "photo").when(i % 3 == 1, "video").otherwise("doc").alias("type"))).alias("attachments"),
    )
    mx = F.struct(
        i.cast("string").alias("id"), F.struct((F.col("user_id") % 5).cast("string").alias("id")).alias("channel"), F.struct(F.col("user_id").cast("string").alias("id")).alias("author"),
        F.concat(F.lit("message "), F.col("event_type")).alias("message"), F.concat(iso, F.lit("+03:00")).alias("created_at"), F.struct(F.floor("value").alias("reach"), F.col("k").alias("likes")).alias("metrics"),
    )
    rss = F.struct(F.concat(F.lit("g-"), i).alias("guid"), F.concat(F.lit("title "), i).alias("title"), F.col("event_type").alias("summary"), F.concat(iso, F.lit("Z")).alias("published_at"), F.concat(F.lit("https://news.example/"), i).alias("link"))
    portal = F.struct(
        i.alias("appeal_id"), F.lit("subject").alias("subject"), F.col("event_type").alias("message"), iso.alias("created_at"),
        F.struct(F.lit("North").alias("region"), F.lit("47.5").alias("lat"), F.lit("39.25").alias("lon")).alias("location"),
    )
    shapes = {
        "vk": (0, {"source": "vk", "region_hint": "South"}, vk, "true"), "max": (1, {"source": "mailru_max"}, mx, "true"), "rss": (2, {"source": "feed", "feed_id": "f1"}, rss, "true"),
        "portal": (3, {"source": "portal", "timezone": "+02:00", "is_official": True}, portal, "true"),
    }
    out = {}
    for name, (m, config, shape, _) in shapes.items():
        out[name] = (config, e.filter(i % 4 == m).select(F.to_json(shape).alias("raw_payload")))
    return out
