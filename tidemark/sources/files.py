"""File sources of raw messages: portal appeals, channel dumps, feeds; their sinks and queues.

Readers have fixed schemas and fail on bad rows; nothing is inferred at scale. Payloads stay
JSON text, so that the normaliser sees them as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([
    T.StructField("source_type", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("author_id", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("created_at_utc", T.TimestampType()), T.StructField("collected_at", T.TimestampType()),
    T.StructField("is_official", T.BooleanType()), T.StructField("reach", T.LongType()), T.StructField("likes", T.LongType()), T.StructField("reposts", T.LongType()),
    T.StructField("comments_count", T.LongType()), T.StructField("raw_payload", T.StringType()),
])
REQUIRED = ("source_type", "source_id", "text", "created_at_utc", "collected_at")


def json_rows(spark: SparkSession, path: str, *, lines: bool | None = None) -> DataFrame:
    """(raw_payload): one JSON object a row. ``.jsonl`` has one a line; ``.json`` an array or {"items": [...]}."""
    if lines if lines is not None else path.endswith(".jsonl"):
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("raw_payload"))
    else:
        whole = spark.read.text(path, wholetext=True)
        items = F.when(F.trim("value").startswith("{"), F.get_json_object("value", "$.items")).otherwise(F.col("value"))
        rows = whole.select(F.explode(F.from_json(items, "array<variant>")).alias("v")).select(F.to_json("v").alias("raw_payload"))
    broken = F.parse_json("raw_payload")  # an error for a row that is no JSON
    return rows.filter(broken.isNotNull())


def appeals(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path)


def channel_messages(spark: SparkSession, path: str) -> DataFrame:
    """Posts and comments of nested channel dumps (channels -> posts -> comments), as raw messages."""
    rows = json_rows(spark, path)
    get = lambda x, k, t="string": F.variant_get(x, f"$.{k}", t)

    def items(x, k: str, *otherwise: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, f"$.{k}", "array<variant>"), F.from_json(get(x, k), "array<variant>"), *otherwise)

    v = F.parse_json("raw_payload")
    ch = rows.select(F.explode_outer(items(v, "channels", F.array(v))).alias("c")).filter("c IS NOT NULL")
    # what posts need of their channel, so that no post carries the whole of it
    ch = ch.select(get("c", "id").alias("channel"), get("c", "owner_id").alias("owner"), get("c", "is_official", "boolean").alias("official"), items("c", "posts").alias("posts"))
    posts = ch.select("channel", "owner", "official", F.explode_outer("posts").alias("p")).filter("p IS NOT NULL")
    posts = posts.select("owner", "official", "p", F.concat_ws("_", F.coalesce(get("p", "channel_id"), "channel"), get("p", "id")).alias("post_id"))

    def message(x, kind: str, source_id: Column, parent: Column, author: Column, official: Column, replies: str) -> Column:
        n = lambda k: F.coalesce(get(x, k, "bigint"), F.lit(0)).alias(k)
        return F.struct(
            F.lit(kind).alias("source_type"), source_id.alias("source_id"), parent.alias("parent_id"), author.alias("author_id"), F.trim(get(x, "text")).alias("text"), F.lit("text").alias("media_type"),
            F.to_timestamp(get(x, "created_at")).alias("created_at_utc"), F.current_timestamp().alias("collected_at"), official.alias("is_official"), n("reach"), n("likes"), n("reposts"),
            F.coalesce(get(x, replies, "bigint"), F.lit(0)).alias("comments_count"), F.to_json(x).alias("raw_payload"),
        )

    own = message("p", "max_post", F.col("post_id"), F.lit(None).cast("string"), F.coalesce(get("p", "author_id"), "owner", F.lit("unknown")), F.coalesce(get("p", "is_official", "boolean"), "official", F.lit(False)), "comments_count")
    reply = lambda m: message(m, "max_comment", F.concat_ws("_", "post_id", get(m, "id")), F.col("post_id"), F.coalesce(get(m, "author_id"), F.lit("unknown")), F.coalesce(get(m, "is_official", "boolean"), F.lit(False)), "replies_count")
    replies = F.transform(F.coalesce(items("p", "comments"), F.array().cast("array<variant>")), reply)
    return posts.select(F.explode_outer(F.concat(F.array(own), replies)).alias("m")).select("m.*").filter("text <> ''")


def vk_post(raw: Column) -> dict[str, Column]:
    """Fields of a raw message from a wall post (JSON text): the first photo, video or link says its media type."""
    g = lambda p: F.get_json_object(raw, f"$.{p}")
    kinds = F.filter(F.transform(F.from_json(g("attachments"), "array<map<string,string>>"), lambda a: a["type"]), lambda k: k.isin("photo", "video", "link"))
    count = lambda p: F.coalesce(g(f"{p}.count").cast("long"), F.lit(0))
    return {
        "source_type": F.lit("vk_post"), "source_id": F.concat_ws("_", g("owner_id"), g("id")), "parent_id": F.lit(None).cast("string"), "author_id": g("from_id"), "text": g("text"),
        "media_type": F.coalesce(F.get(kinds, F.lit(0)), F.lit("text")), "created_at_utc": F.timestamp_seconds(g("date").cast("long")), "is_official": F.lit(False),
        "reach": count("views"), "likes": count("likes"), "reposts": count("reposts"), "comments_count": count("comments"), "raw_payload": raw,
    }


def vk_comment(raw: Column, post: Column) -> dict[str, Column]:
    g = lambda p: F.get_json_object(raw, f"$.{p}")
    parent = F.concat_ws("_", F.get_json_object(post, "$.owner_id"), F.get_json_object(post, "$.id"))
    return {
        "source_type": F.lit("vk_comment"), "source_id": F.concat_ws("_", parent, g("id")), "parent_id": parent, "author_id": F.coalesce(g("from_id"), F.lit("")), "text": g("text"), "media_type": F.lit("text"),
        "created_at_utc": F.timestamp_seconds(g("date").cast("long")), "is_official": F.lit(False), "reach": F.lit(0), "likes": F.coalesce(g("likes.count").cast("long"), F.lit(0)), "reposts": F.lit(0),
        "comments_count": F.coalesce(g("thread.count").cast("long"), F.lit(0)), "raw_payload": raw,
    }


def wall(posts: DataFrame, raw_col: str, since=None) -> DataFrame:
    """Raw messages of wall posts that have text and are not older than ``since``."""
    rows = posts.select(*[v.alias(k) for k, v in vk_post(F.col(raw_col)).items()]).filter(F.trim("text") != "")
    return rows if since is None else rows.filter(F.col("created_at_utc") >= since)


def feed(spark: SparkSession, path: str, feed_url: str = "") -> DataFrame:
    """Raw messages of RSS items (XML, row tag ``item``)."""
    schema = "guid string, id string, link string, title string, summary string, description string, author string, pubDate string, published string, updated string, content string"
    return feed_items(spark.read.format("xml").option("rowTag", "item").schema(schema).load(path), feed_url)


def rfc822(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\b(?:GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(text)))


def uuid5_url(name: Column) -> Column:
    """Version 5 UUID in the URL name space, from SHA-1 in the JVM."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def feed_items(items: DataFrame, feed_url: str = "") -> DataFrame:
    """Ids: id, guid, link, else a UUID of feed, title and date. Texts: title and summary (or description), else content."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    body = F.coalesce(some("summary"), some("description"))
    text = F.coalesce(F.nullif(F.concat_ws("\n\n", some("title"), body), F.lit("")), some("content"))
    name = F.concat_ws(":", F.lit(feed_url), F.coalesce("title", F.lit("")), F.coalesce("published", F.lit("")))
    created = F.coalesce(rfc822(F.col("pubDate")), rfc822(F.col("published")), rfc822(F.col("updated")), F.current_timestamp())
    rows = items.select(
        F.lit("rss_article").alias("source_type"), F.coalesce(some("id"), some("guid"), some("link"), uuid5_url(name)).alias("source_id"), F.lit(None).cast("string").alias("parent_id"),
        F.coalesce(some("author"), F.lit("rss")).alias("author_id"), text.alias("text"), F.lit("link").alias("media_type"), created.alias("created_at_utc"), F.current_timestamp().alias("collected_at"),
        F.lit(False).alias("is_official"), *[F.lit(0).cast("long").alias(c) for c in ("reach", "likes", "reposts", "comments_count")], F.to_json(F.struct(*[F.col(c) for c in items.columns])).alias("raw_payload"),
    )
    return rows.filter(F.col("text").isNotNull())


def judged(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``lines`` with _m (the message's fields) and _e: why a line is no raw message, null where it is one.
    Unknown keys and missing required fields are errors."""
    v = F.col(value_col)
    fields = F.array(*[F.lit(f.name) for f in RAW.fields])
    shape = T.StructType([f if f.name != "raw_payload" else T.StructField("raw_payload", T.VariantType()) for f in RAW.fields])
    rows = lines.withColumns({"_m": F.from_json(v, shape, {"mode": "PERMISSIVE"}), "_k": F.json_object_keys(v)})
    error = F.when(F.col("_k").isNull(), "not a JSON object").when(F.size(F.array_except("_k", fields)) > 0, F.concat(F.lit("unknown fields: "), F.array_join(F.array_except("_k", fields), ", "))).when(
        F.concat(*[F.col(f"_m.{r}").isNull().cast("string") for r in REQUIRED]).contains("true"), "a required field is missing"
    )
    return rows.withColumn("_e", error).drop("_k")


def fields_of(rows: DataFrame, *keep: str) -> DataFrame:
    """The raw messages of ``judged`` lines."""
    cols = [F.col(f"_m.{f.name}") if f.name != "raw_payload" else F.to_json("_m.raw_payload").alias("raw_payload") for f in RAW.fields]
    return rows.select(*cols, *keep)


def split_raw(lines: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good raw messages, dead letters) of JSON lines. Dead letters: {"error": ..., "message": ...}."""
    rows = judged(lines.select(F.col(value_col).alias("_v")), "_v")
    return fields_of(rows.filter("_e IS NULL")), rows.filter("_e IS NOT NULL").select(F.to_json(F.struct(F.col("_e").alias("error"), F.col("_v").alias("message"))).alias("value"))


def replay_dead(letters: DataFrame) -> DataFrame:
    return letters.select(F.get_json_object("value", "$.message").alias("value"))


def replay_raw(raw: DataFrame, source_type: str | None = None, limit: int | None = None) -> DataFrame:
    rows = raw if source_type is None else raw.filter(F.col("source_type") == source_type)
    rows = rows.orderBy("collected_at", "created_at_utc", "source_type", "source_id")
    return rows if limit is None else rows.limit(limit)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


#: Options of the topics; a Kafka connector is needed where they are used.
KAFKA_READ = {"startingOffsets": "earliest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": "100000"}
KAFKA_WRITE = {"kafka.linger.ms": "50", "kafka.batch.size": "32768", "kafka.compression.type": "lz4"}
TOPICS = {"raw.documents": {"partitions": 4, "replication": 3, "retention_days": 7}, "raw.documents.dlq": {"partitions": 4, "replication": 3, "retention_days": 7}}
