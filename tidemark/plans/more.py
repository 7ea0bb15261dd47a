"""Queries of sources, normalisation, events and services, with DuckDB SQL for the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CRISIS, RankingConfig, SummaryConfig
from tidemark.functions import language
from tidemark.operators import normalize, ranking, sentiment, serving, summarize, text, vectors
from tidemark.plans import adapters as A
from tidemark.plans.oracles import DOCS, ORACLES, RANK
from tidemark.sources import events as messages
from tidemark.sources import files, tables
from tidemark.streaming import raw

NOW = A.NOW


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").withColumns({"k": A.k_of(F.col("props")), "reach": F.floor("value"), "secs": F.unix_seconds(F.col("ts").cast("timestamp"))})


def _epoch(*cols: str):
    return [F.unix_seconds(F.col(c).cast("timestamp")).alias(c) for c in cols]


def _post(spark, sf) -> DataFrame:
    """Wall posts as JSON; every seventh has no text."""
    e = _events(spark, sf)
    i = F.col("event_id")
    shape = F.struct(
        i.alias("id"), (-F.col("user_id")).alias("owner_id"), F.col("user_id").alias("from_id"), F.when(i % 7 == 0, "  ").otherwise(F.concat(F.lit("post "), F.col("event_type"))).alias("text"), F.col("secs").alias("date"),
        F.struct(F.col("reach").alias("count")).alias("views"), F.struct(F.col("k").alias("count")).alias("likes"), F.array(F.struct(F.when(i % 3 == 0, "doc").when(i % 3 == 1, "video").otherwise("link").alias("type"))).alias("attachments"),
    )
    return e.select("event_id", F.to_json(shape).alias("post"))


def wall_posts(spark, sf):
    rows = files.wall(_post(spark, sf), "post", dt.datetime(2024, 1, 10))
    return rows.select("source_type", "source_id", "author_id", "text", "media_type", *_epoch("created_at_utc"), "reach", "likes", "reposts", "comments_count", "is_official")


def wall_comments(spark, sf):
    """The comment of each event under the post of the same event."""
    e = _events(spark, sf).join(_post(spark, sf), "event_id")
    own = F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 > 0, F.col("user_id")).alias("from_id"), F.col("event_type").alias("text"), F.col("secs").alias("date"), F.struct(F.col("k").alias("count")).alias("likes")))
    rows = e.select(own.alias("c"), "post")
    shape = files.vk_comment(F.col("c"), F.col("post"))
    return rows.select(*[v.alias(k) for k, v in shape.items()]).select("source_type", "source_id", "parent_id", "author_id", "text", *_epoch("created_at_utc"), "likes", "comments_count")


def channel_dump(spark, sf):
    """Events as a dump of channels with posts and comments, written and read as the collector does."""
    at = tables.shared_folder(spark, "channel_dump")
    e = _events(spark, sf).withColumn("channel", F.col("user_id") % 20)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    comment = F.struct(F.lit("c1").alias("id"), F.concat(F.lit("re "), F.col("event_type")).alias("text"), iso.alias("created_at"), F.col("k").alias("likes"))
    post = F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")).alias("text"), iso.alias("created_at"), F.col("reach").alias("reach"), F.when(F.col("event_id") % 4 == 0, F.array(comment)).alias("comments"))
    lines = e.groupBy("channel", F.col("event_id") % 50).agg(F.collect_list(post).alias("posts")).select(F.to_json(F.struct(F.col("channel").alias("id"), F.concat(F.lit("o"), "channel").alias("owner_id"), (F.col("channel") == 3).alias("is_official"), "posts")).alias("value"))
    lines.write.text(f"{at}/dump.jsonl")
    rows = files.channel_messages(spark, f"{at}/dump.jsonl")
    return rows.select("source_type", "source_id", "parent_id", "author_id", "text", "is_official", "reach", "likes", "comments_count", *_epoch("created_at_utc"))


def feed_articles(spark, sf):
    """Items of a feed made of events: ids and dates by precedence."""
    i = F.col("event_id")
    e = _events(spark, sf)
    some = lambda m, v: F.when(i % m == 0, v)
    items = e.select(
        some(5, F.concat(F.lit("g"), i)).alias("guid"), some(15, F.concat(F.lit(" id"), i)).alias("id"), some(2, F.concat(F.lit("https://n.example/"), i)).alias("link"), F.concat(F.lit("title "), i).alias("title"), some(3, F.col("event_type")).alias("summary"),
        F.concat(F.lit("about "), F.col("event_type")).alias("description"), some(4, F.lit(" ed ")).alias("author"), some(2, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'")).alias("pubDate"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.lit(None).cast("string").alias("updated"), F.lit("body").alias("content"),
    )
    return files.feed_items(items, "https://f.example/rss").select("source_id", "author_id", "text", *_epoch("created_at_utc"))


def _lines(spark, sf) -> DataFrame:
    """Raw messages as JSON lines, some of them broken in each way."""
    i = F.col("event_id")
    e = _events(spark, sf)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = [
        F.lit("vk_post").alias("source_type"), F.concat(F.lit("1_"), F.col("event_id") % 4000).alias("source_id"), F.col("user_id").cast("string").alias("author_id"), F.when(i % 11 > 0, F.col("event_type")).alias("text"), iso.alias("created_at_utc"), iso.alias("collected_at"),
        F.col("reach").alias("reach"), F.struct(i.alias("id")).alias("raw_payload"),
    ]
    good, odd = F.to_json(F.struct(*base)), F.to_json(F.struct(*base, F.lit(1).alias("odd")))
    return e.select(F.when(i % 13 == 0, "no json").when(i % 17 == 0, odd).otherwise(good).alias("value"), i.alias("original_offset"))


def raw_consumer(spark, sf):
    """Lines through the stream consumer in two micro-batches: the table that is left."""
    at = tables.shared_folder(spark, "raw_consumer")
    from tidemark.streaming import jobs

    raw.consume_job(jobs.replayed(_lines(spark, sf), f"{at}/in", "original_offset", 2), f"{at}/raw", f"{at}/letters", f"{at}/check").awaitTermination()
    rows = tables.rows_of(spark, f"{at}/raw")
    return rows.select("source_id", "author_id", "text", "reach", *_epoch("collected_at"), F.get_json_object("raw_payload", "$.id").cast("long").alias("payload_id"))


def dead_letters(spark, sf):
    _, bad = raw.sorted_out(_lines(spark, sf))
    return bad.groupBy("error", "kind", "attempt").agg(F.count("*").alias("letters"), F.min("original_offset").alias("first_offset"))


def replay_raw(spark, sf):
    good, _ = raw.sorted_out(_lines(spark, sf))
    return files.replay_raw(good, "vk_post", 50).select("source_id", "text", *_epoch("collected_at"), "author_id")


def raw_contract(spark, sf):
    """Raw messages whose payloads lack keys, to the contract in one call."""
    i = F.col("event_id")
    e = _events(spark, sf)
    kind = F.when(i % 4 == 0, "vk_post").when(i % 4 == 1, "max_post").when(i % 4 == 2, "rss_article").otherwise("portal_appeal")
    payload = F.when(i % 4 == 0, F.to_json(F.struct(i.alias("id"), (-F.col("user_id")).alias("owner_id"), (F.col("secs") - 86400).alias("date")))).when(i % 4 == 1, F.to_json(F.struct(i.alias("id"), F.struct((F.col("user_id") % 5).alias("id")).alias("channel")))).when(
        i % 4 == 2, F.to_json(F.struct(F.concat(F.lit("g"), i).alias("guid"), F.lit(None).cast("string").alias("author")), {"ignoreNullFields": "false"})
    ).otherwise(F.to_json(F.struct(i.alias("appeal_id"), F.lit("subject").alias("subject"))))
    at = F.col("ts").cast("timestamp")
    rows = e.select(
        kind.alias("source_type"), i.cast("string").alias("source_id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("u"), "user_id").alias("author_id"), F.concat(F.lit("text "), "event_type").alias("text"), F.lit("photo").alias("media_type"),
        at.alias("created_at_utc"), at.alias("collected_at"), F.lit(True).alias("is_official"), F.col("reach"), F.col("k").cast("long").alias("likes"), F.lit(2).cast("long").alias("reposts"), F.lit(None).cast("long").alias("comments_count"), payload.alias("raw_payload"),
    )
    out = normalize.contract(rows, {})
    return out.select("doc_id", "source_type", "source_id", "author_id", "text", "is_official", "reach", "likes", "reposts", "comments_count", "parent_id", *_epoch("created_at", "collected_at"))


def event_round_trip(spark, sf):
    """Change events to messages and back; rows whose code is not allowed are letters and not here."""
    schema = messages.Schema("change", 2, "id long, at timestamp, kind string, tags array<string>, score double", {"kind": ("click", "view", "error")}, {"score": 0.5}, ("tags",))
    e = _events(spark, sf)
    rows = e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), F.when(F.col("k") % 2 == 0, F.array(F.lit("t"), F.col("k").cast("string"))).alias("tags"), F.col("value").alias("score"))
    good, bad = messages.read_back(messages.serialised(rows, schema, "id"), schema)
    out = good.select("id", F.unix_micros("at").alias("at_us"), "kind", F.array_join("tags", ",").alias("tags"), "score", F.lit(None).cast("string").alias("error"))
    letters = bad.select(F.get_json_object("message", "$.id").cast("long").alias("id"), F.lit(None).cast("long").alias("at_us"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("tags"), F.lit(None).cast("double").alias("score"), "error")
    return out.unionByName(letters)


def sentiment_batch(spark, sf):
    """A lexicon in place of a model, over whole texts."""
    return sentiment.score(A.text_docs(spark, sf), sentiment.lexicon_backend(("the", "der", "la", "el"), ("of", "und", "et", "y"))).withColumn("sentiment_score", F.round("sentiment_score", 6))


def regenerate_topics(spark, sf):
    """Topics whose description is to be made anew, from counts of events then and now."""
    e = A.ranking_docs(spark, sf)
    then = F.col("created_at") < F.expr("timestamp_ntz'2024-01-20'")
    rows = e.groupBy("cluster_id", "author_id").agg(
        F.count("*").alias("size"), F.count_if(then).alias("size_then"), F.max(F.when(then, F.col("created_at"))).alias("generated_at"), (F.count_if(~then) / F.greatest(F.count_if(then), F.lit(1))).alias("growth_rate")
    ).withColumns({"prompt_version": F.concat(F.lit("v"), F.col("author_id") % 10), "current_version": F.when(F.col("author_id") % 10 == 9, "v8").otherwise(F.concat(F.lit("v"), F.col("author_id") % 10))})
    again = summarize.needs_new(rows, ranking.ntz(NOW), SummaryConfig())
    return rows.select("cluster_id", "author_id", "size", F.coalesce(again, F.lit(False)).alias("again"))


def description_history(spark, sf):
    """The current row of each key and how many went to history."""
    e = A.table(spark, sf, "events").select("user_id", "event_id", "value")
    now, before = summarize.history(e.filter("event_id % 3 > 0"), e.filter("event_id % 3 = 0"), "user_id", "event_id")
    return now.join(before.groupBy("user_id").agg(F.count("*").alias("earlier"), F.max("event_id").alias("last_earlier")), "user_id", "left").select("user_id", "event_id", "value", F.coalesce("earlier", F.lit(0)).cast("long").alias("earlier"), "last_earlier")


def generation_cost(spark, sf):
    c = A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    return c.select("conv_id", F.round(summarize.cost(F.col("n"), F.col("n") / 2, 0.01, 0.03), 8).alias("cost_usd"))


def pooled_chunks(spark, sf):
    """Vectors of a label pooled as if they were windows of one document."""
    rows = vectors.pool_chunks(A.members(spark, sf), "cluster_id")
    return rows.select("cluster_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 5))


def crisis_ranking(spark, sf):
    out = ranking.rank(A.ranking_docs(spark, sf), A.clusters(spark), NOW, RankingConfig(weights=dict(CRISIS)))
    return out.select("period_hours", "cluster_id", "rank", F.round("score", 6).alias("score"))


def upsert_by_bucket(spark, sf):
    """Events taken into a bucketed table in three batches, the last of them old."""
    at = tables.shared_folder(spark, "upsert_by_bucket")
    e = A.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    for part in (1, 2, 0):
        tables.upsert(e.filter(F.col("event_id") % 3 == part), f"{at}/t", ("user_id", "event_type"), ("event_id",))
    return tables.rows_of(spark, f"{at}/t")


def request_statistics(spark, sf):
    e = _events(spark, sf)
    log = e.select((F.col("k") * 5 + 100).alias("status"), F.col("value").alias("latency_ms"), (F.col("k") % 2 == 0).alias("hit"))
    return serving.request_metrics(log).withColumn("hit_ratio", F.round("hit_ratio", 6))


def demojized_text(spark, sf):
    """Texts with pictographs in place of full stops."""
    d = A.text_docs(spark, sf)
    sign = F.when(F.col("doc_id") % 3 == 0, "\U0001f525").when(F.col("doc_id") % 3 == 1, "☂️").otherwise("\U0001f600")
    rows = d.select("doc_id", F.regexp_replace("text", r"\.", F.concat(sign, F.lit("."))).alias("text"))
    out = text.clean(rows)
    return out.select("doc_id", "token_count", F.sha2("normalized_text", 256).alias("text_sha"), F.array_join("cleanup_flags", ",").alias("cleanup_flags"))


def ngram_language(spark, sf):
    """Languages by a model of the labelled documents that are not held out (every fifth is)."""
    d = A.table(spark, sf, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % 5 == 0).alias("held_out"))
    model = language.fit(d.filter("NOT held_out"))
    out = language.annotate(d, model.detector, supported=tuple(model.weights))
    return out.select("doc_id", "lang", "held_out", "language", F.round("language_confidence", 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        wall_posts, wall_comments, channel_dump, feed_articles, raw_consumer, dead_letters, replay_raw, raw_contract, event_round_trip, sentiment_batch, regenerate_topics, description_history, generation_cost,
        pooled_chunks, crisis_ranking, upsert_by_bucket, request_statistics, demojized_text, ngram_language,
    )
}

E = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor(value) AS BIGINT) AS reach, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events)"""
LINES = f"""{E}, l AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'not a JSON object' WHEN event_id % 17 = 0 THEN 'unknown fields: odd' WHEN event_id % 11 = 0 THEN 'a required field is missing' END AS error, concat('1_', event_id % 4000) AS source_id FROM e)"""
SPLIT = r"regexp_split_to_array(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"

SQL = {
    "wall_posts": f"""WITH {E} SELECT 'vk_post' AS source_type, concat(-user_id, '_', event_id) AS source_id, CAST(user_id AS VARCHAR) AS author_id, concat('post ', event_type) AS text,
      CASE event_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'video' ELSE 'link' END AS media_type, secs AS created_at_utc, reach, k::BIGINT AS likes, 0::BIGINT AS reposts, 0::BIGINT AS comments_count, false AS is_official
      FROM e WHERE event_id % 7 > 0 AND secs >= epoch(TIMESTAMP '2024-01-10')""",
    "wall_comments": f"""WITH {E} SELECT 'vk_comment' AS source_type, concat(-user_id, '_', event_id, '_', event_id) AS source_id, concat(-user_id, '_', event_id) AS parent_id,
      CASE WHEN event_id % 5 > 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS author_id, event_type AS text, secs AS created_at_utc, k::BIGINT AS likes, 0::BIGINT AS comments_count FROM e""",
    "channel_dump": f"""WITH {E}, p AS (SELECT *, user_id % 20 AS channel, concat(user_id % 20, '_', event_id) AS post_id FROM e)
      SELECT 'max_post' AS source_type, post_id AS source_id, NULL AS parent_id, concat('o', channel) AS author_id, event_type AS text, channel = 3 AS is_official, reach, 0::BIGINT AS likes, 0::BIGINT AS comments_count, secs AS created_at_utc FROM p WHERE event_id % 9 > 0
      UNION ALL SELECT 'max_comment', concat(post_id, '_c1'), post_id, 'unknown', concat('re ', event_type), false, 0, k, 0, secs FROM p WHERE event_id % 4 = 0""",
    "feed_articles": f"""WITH {E}, u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('https://f.example/rss:title ', event_id, ':', strftime(ts, '%Y-%m-%dT%H:%M:%SZ')))) AS h FROM e)
      SELECT CASE WHEN event_id % 15 = 0 THEN concat('id', event_id) WHEN event_id % 5 = 0 THEN concat('g', event_id) WHEN event_id % 2 = 0 THEN concat('https://n.example/', event_id)
        ELSE concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', printf('%x', (CAST('0x' || h[17] AS INTEGER) & 3) | 8), h[18:20], '-', h[21:32]) END AS source_id,
        CASE WHEN event_id % 4 = 0 THEN 'ed' ELSE 'rss' END AS author_id, concat('title ', event_id, chr(10), chr(10), CASE WHEN event_id % 3 = 0 THEN event_type ELSE concat('about ', event_type) END) AS text, secs AS created_at_utc FROM u""",
    "raw_consumer": f"""WITH {LINES} SELECT source_id, CAST(user_id AS VARCHAR) AS author_id, event_type AS text, reach, secs AS collected_at, event_id AS payload_id FROM l WHERE error IS NULL
      QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY secs DESC) = 1""",
    "dead_letters": f"WITH {LINES} SELECT error, 'validation_error' AS kind, 1 AS attempt, count(*) AS letters, min(event_id) AS first_offset FROM l WHERE error IS NOT NULL GROUP BY error",
    "replay_raw": f"WITH {LINES} SELECT source_id, event_type AS text, secs AS collected_at, CAST(user_id AS VARCHAR) AS author_id FROM l WHERE error IS NULL ORDER BY secs, source_id LIMIT 50",
    "raw_contract": f"""WITH {E}, c AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'vk_post' WHEN 1 THEN 'max_post' WHEN 2 THEN 'rss_article' ELSE 'portal_appeal' END AS source_type,
      CASE event_id % 4 WHEN 0 THEN concat(-user_id, '_', event_id) WHEN 1 THEN concat(user_id % 5, '_', event_id) WHEN 2 THEN concat('g', event_id) ELSE CAST(event_id AS VARCHAR) END AS source_id FROM e)
      SELECT concat(source_type, ':', source_id) AS doc_id, source_type, source_id, CASE event_id % 4 WHEN 2 THEN 'rss:unknown' ELSE concat('u', user_id) END AS author_id,
        CASE event_id % 4 WHEN 2 THEN '' WHEN 3 THEN concat('subject', chr(10), chr(10), 'text ', event_type) ELSE concat('text ', event_type) END AS text, false AS is_official, reach, k::BIGINT AS likes, 2::BIGINT AS reposts, 0::BIGINT AS comments_count, NULL AS parent_id,
        secs AS created_at, secs AS collected_at FROM c""",
    "event_round_trip": """SELECT event_id AS id, CASE WHEN ok THEN epoch_us(ts) END AS at_us, CASE WHEN ok THEN event_type END AS kind, CASE WHEN ok AND k % 2 = 0 THEN concat('t,', k) END AS tags, CASE WHEN ok THEN value END AS score,
      CASE WHEN NOT ok THEN concat('kind: unknown code ', event_type) END AS error FROM (SELECT *, event_type IN ('click', 'view', 'error') AS ok, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "sentiment_batch": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0b\x1c-\x1f\x85\xa0]+'), lambda x: x <> '') AS w FROM documents),
      n AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'der', 'la', 'el'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'und', 'et', 'y'))) AS n FROM w)
      SELECT doc_id, round(CASE WHEN p + n = 0 THEN 0.0 ELSE p / (p + n) - n / (p + n) END, 6) AS sentiment_score FROM n""",
    "regenerate_topics": f"""WITH {DOCS}, g AS (SELECT cluster_id, author_id, count(*) AS size, count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-20') AS size_then, max(created_at) FILTER (WHERE created_at < TIMESTAMP '2024-01-20') AS made_at FROM docs GROUP BY ALL)
      SELECT cluster_id, author_id, size, author_id % 10 = 9 OR (size - size_then) / greatest(size_then, 1) > 0.3 OR coalesce((epoch_us(TIMESTAMP '2024-01-30') - epoch_us(made_at)) / 3.6e9 > 6 AND (size - size_then) / greatest(size_then, 1) > 2.0, false) AS again FROM g""",
    "description_history": """SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) - 1 AS earlier, list_sort(list(event_id), 'DESC')[2] AS last_earlier FROM events GROUP BY user_id""",
    "generation_cost": "SELECT conv_id, round(sum(length(text)) / 1000.0 * 0.01 + sum(length(text)) / 2 / 1000.0 * 0.03, 8) AS cost_usd FROM conversations GROUP BY conv_id",
    "pooled_chunks": """WITH m AS (SELECT label AS cluster_id, i - 1 AS i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
      SELECT cluster_id, i::INTEGER AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)), 5) AS x FROM m""",
    "crisis_ranking": "WITH " + RANK.replace("volume_score * 0.25 + dynamics_score * 0.25 + sentiment_part * 0.2 + reach_score * 0.15 + geo_score * 0.1 + source_score * 0.05", "volume_score * 0.2 + dynamics_score * 0.3 + sentiment_part * 0.25 + reach_score * 0.15 + geo_score * 0.07 + source_score * 0.03") + " SELECT period_hours, cluster_id, rank, round(score, 6) AS score FROM ranked",
    "upsert_by_bucket": ORACLES["latest_upsert"],
    "request_statistics": f"""WITH {E}, l AS (SELECT k * 5 + 100 AS status, value, k % 2 = 0 AS hit FROM e), o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM l)
      SELECT count(*) AS requests, count(*) FILTER (WHERE status < 400) AS ok, count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS refused, count(*) FILTER (WHERE status >= 500) AS failed, round(avg(hit::INTEGER), 6) AS hit_ratio,
        (SELECT value FROM o WHERE i = CAST(round_even((n - 1) * 0.99, 0) AS BIGINT)) AS p99_ms FROM l""",
    "demojized_text": r"""WITH t AS (SELECT doc_id, replace(text, '.', CASE doc_id % 3 WHEN 0 THEN ' fire ' WHEN 1 THEN ' umbrella  ' ELSE ' grinning face ' END || '.') AS t0, text FROM documents),
      b AS (SELECT doc_id, text, regexp_replace(regexp_replace(t0, '(?i)(https?://|www\.)\S+', ' ', 'g'), '(^|[^\pL\pN_])@[A-Za-z0-9_][A-Za-z0-9_.-]*', '\1USER', 'g') AS t2 FROM t),
      c AS (SELECT *, trim(regexp_replace(t2, '[\s\x1c-\x1f]+', ' ', 'g')) AS t FROM b)
      SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INTEGER AS token_count, sha256(t) AS text_sha, concat_ws(',', CASE WHEN contains(text, '.') THEN 'emoji_demojized' END, CASE WHEN t <> t2 THEN 'whitespace_normalized' END) AS cleanup_flags FROM c""",
    # of queries that had no SQL
    "normalize_events_json": f"""WITH {E}, c AS (SELECT *, event_id % 8 = 0 AS comment FROM e)
      SELECT concat(t, ':', source_id) AS doc_id, t AS source_type, source_id, parent_id, text, media_type, author_id, is_official, reach, likes, reposts, comments_count, region_hint, geo_lat, geo_lon, created_epoch FROM (
        SELECT CASE WHEN comment THEN 'vk_comment' ELSE 'vk_post' END AS t, CASE WHEN comment THEN concat(-user_id, '_', event_id % 100, '_', event_id) ELSE concat(-user_id, '_', event_id) END AS source_id, CASE WHEN comment THEN concat(-user_id, '_', event_id % 100) END AS parent_id,
          concat('post ', event_type) AS text, CASE event_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' ELSE 'text' END AS media_type, CAST(user_id AS VARCHAR) AS author_id, false AS is_official, reach, k::BIGINT AS likes, 0::BIGINT AS reposts, 0::BIGINT AS comments_count,
          'South' AS region_hint, NULL::DOUBLE AS geo_lat, NULL::DOUBLE AS geo_lon, secs AS created_epoch FROM c WHERE event_id % 4 = 0
        UNION ALL SELECT 'max_post', concat(user_id % 5, '_', event_id), NULL, concat('message ', event_type), 'text', CAST(user_id AS VARCHAR), false, reach, k, 0, 0, NULL, NULL, NULL, secs - 10800 FROM c WHERE event_id % 4 = 1
        UNION ALL SELECT 'rss_article', concat('g-', event_id), NULL, concat('title ', event_id, chr(10), chr(10), event_type), 'link', 'f1', false, 0, 0, 0, 0, NULL, NULL, NULL, secs FROM c WHERE event_id % 4 = 2
        UNION ALL SELECT 'portal_appeal', CAST(event_id AS VARCHAR), NULL, concat('subject', chr(10), chr(10), event_type), 'text', 'anonymous', true, 0, 0, 0, 0, 'North', 47.5, 39.25, secs - 7200 FROM c WHERE event_id % 4 = 3)""",
    "parse_summary": rf"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s, list_filter(regexp_split_to_array(regexp_replace(text, '[^\pL\pN_ ]+', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant'),
      d AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i)[1:6] AS p FROM a),
      t AS (SELECT *, array_to_string(list_filter({SPLIT.format('s')}, lambda x: x <> '')[1:3], ' ') AS three, list_transform(p, lambda x: lower(x)) AS low FROM d),
      u AS (SELECT *, CASE WHEN len(regexp_extract_all(three, '[\pL\pN_]+')) > 120 THEN array_to_string(regexp_extract_all(three, '[\pL\pN_]+')[1:120], ' ') ELSE three END AS cut FROM t)
      SELECT conv_id, turn, CASE WHEN cut = '' OR right(cut, 1) IN ('.', '!', '?') THEN cut ELSE concat(cut, '.') END AS summary, array_to_string(list_filter(p, lambda x, i: list_position(low, lower(x)) = i), ';') AS key_phrases FROM u""",
    "export_rows": ORACLES["urgency"].rsplit("SELECT period_hours, cluster_id, CASE", 1)[0] + f""", urg AS (SELECT cluster_id, rank, size, unique_authors, reach_total, growth_rate, regions, score,
        CASE WHEN growth_rate >= 5 OR (is_new AND size >= 100) OR (wide IS NOT NULL AND sentiment_score < -0.6) THEN 'critical' WHEN score >= 0.7 OR is_growing THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS urgency FROM x WHERE period_hours = 72),
      wgt AS (SELECT cluster_id, coalesce(category, 'other') AS category, sum(qw) AS weight FROM win WHERE period_hours = 72 GROUP BY ALL), cat AS (SELECT * FROM wgt QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, category) = 1),
      src AS (SELECT cluster_id, string_agg(concat(source_type, ':', n), ';' ORDER BY n DESC, source_type) AS sources FROM (SELECT cluster_id, source_type, count(*) AS n FROM win WHERE period_hours = 72 GROUP BY ALL) GROUP BY cluster_id)
      SELECT rank, cluster_id, concat('topic ', cluster_id) AS summary, category, size AS mention_count, unique_authors, reach_total, round(growth_rate, 6) AS growth_rate, array_to_string(regions, ';') AS geo_regions, sources, round(score, 6) AS score, urgency,
        '2024-01-27T00:00:00+00:00' AS period_start, '2024-01-30T00:00:00+00:00' AS period_end, '2024-01-30T00:00:00+00:00' AS computed_at FROM urg JOIN cat USING (cluster_id) JOIN src USING (cluster_id)""",
}
SQL["validate_summary"] = SQL["parse_summary"].rsplit("SELECT conv_id, turn, CASE", 1)[0] + r""", v AS (SELECT *, len(regexp_extract_all(cut, '[\pL\pN_]+')) AS n, len(list_filter(p, lambda x, i: list_position(low, lower(x)) = i)) AS k FROM u)
      SELECT conv_id, turn, CASE WHEN cut = '' THEN 'описание отсутствует' WHEN n < 10 THEN 'описание слишком короткое' WHEN n > 120 THEN 'описание слишком длинное' WHEN k NOT BETWEEN 5 AND 7 THEN 'нужно 5-7 ключевых фраз' END AS invalid_reason FROM v"""
