"""One query for each operator of the engine, on the driver's tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ClusterConfig, DedupConfig, RankingConfig, SummaryConfig
from tidemark.functions import language
from tidemark.operators import cluster, dedup, filtering, geo, normalize, ranking, sentiment, serving, summarize, text, vectors
from tidemark.plans import adapters as A
from tidemark.sources import html, tables
from tidemark.streaming import history, jobs

NOW = A.NOW
PERIODS = RankingConfig().periods
ROUND = 6


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in cols})


def _ranked(spark, sf, config=None):
    return ranking.rank(A.ranking_docs(spark, sf), A.clusters(spark), NOW, config)


def rank_topics(spark: SparkSession, sf: str) -> DataFrame:
    out = _ranked(spark, sf, RankingConfig(periods=(24,)))
    out = out.withColumn("geo_regions", F.array_join("geo_regions", ","))
    cols = ["period_hours", "cluster_id", "rank", "score", "size", "weighted_size", "unique_authors", "unique_sources", "reach_total", "growth_rate", "sentiment_score", "geo_regions", "is_new", "is_growing"]
    return r6(out.select(*cols), "score", "growth_rate", "sentiment_score")


def rank_topics_3_windows(spark, sf):
    return r6(_ranked(spark, sf).select("period_hours", "cluster_id", "rank", "score", "size", "reach_total"), "score")


def rank_exclusions(spark, sf):
    return ranking.exclusion_counts(A.ranking_docs(spark, sf), A.clusters(spark), NOW)


def score_breakdown(spark, sf):
    cols = [F.col(f"{c}_component").alias(f"{c}_score") for c in ranking.COMPONENTS]
    return r6(_ranked(spark, sf).select("period_hours", "cluster_id", *cols), *[f"{c}_score" for c in ranking.COMPONENTS])


def urgency(spark, sf):
    return ranking.urgency(_ranked(spark, sf)).select("period_hours", "cluster_id", "urgency", "urgency_reason")


def explain_rank(spark, sf):
    return ranking.explain(_ranked(spark, sf), RankingConfig().weights).select("period_hours", "cluster_id", "explanation")


def topic_timeline_72h(spark, sf):
    return r6(ranking.timeline(A.ranking_docs(spark, sf), NOW), "growth_rate")


def topic_timeline_unweighted(spark, sf):
    return r6(ranking.timeline(A.ranking_docs(spark, sf), NOW, weighted=False), "growth_rate")


def topic_sources(spark, sf):
    return ranking.source_summaries(A.ranking_docs(spark, sf), NOW, PERIODS)


def topic_samples(spark, sf):
    docs = A.ranking_docs(spark, sf)
    named = docs.filter("doc_id % 97 = 0").select("cluster_id", "doc_id", (F.col("doc_id") % 13).cast("int").alias("pos"))  # what a description cites
    return ranking.samples(docs, named, NOW, PERIODS).select("period_hours", "cluster_id", "doc_id", "ordinal", "is_post")


def topic_category(spark, sf):
    return ranking.category(A.ranking_docs(spark, sf), NOW, PERIODS).select("period_hours", "cluster_id", "category", "category_label", "weight")


def weighted_sentiment(spark, sf):
    return r6(ranking.window_aggregates(A.ranking_docs(spark, sf), NOW, PERIODS).select("period_hours", "cluster_id", "sentiment_score"), "sentiment_score")


def weighted_growth(spark, sf):
    return r6(ranking.window_aggregates(A.ranking_docs(spark, sf), NOW, PERIODS).select("period_hours", "cluster_id", "growth_rate"), "growth_rate")


def snapshot_metrics(spark, sf):
    docs = A.ranking_docs(spark, sf)
    before = ranking.rank(docs, A.clusters(spark), NOW - dt.timedelta(hours=6))
    return r6(ranking.snapshot_metrics(_ranked(spark, sf), before, 5), "min_score", "max_score", "score_gap")


def _bursts(spark, sf, key, minutes, threshold, flag):
    docs = A.ranking_docs(spark, sf)
    out = filtering.bursts(docs, (key,), "created_at", minutes, threshold, flag)
    return r6(out.select("doc_id", "size", "window_start", "window_end", "confidence"), "confidence")


def author_burst(spark, sf):
    return _bursts(spark, sf, "author_id", 720, 3, "author_burst")


def velocity_flood(spark, sf):
    return _bursts(spark, sf, "cluster_id", 30, 2, "coordinated_flood")


def bot_timing(spark, sf):
    out = filtering.bot_timing(A.ranking_docs(spark, sf), ("author_id",), "created_at", 720, 2, 7200)
    return out.select("doc_id", "size", "window_start", "window_end")


def _snapshots(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderkey").alias("ranking_id"), F.col("o_orderdate").alias("computed_at"), F.when(F.col("o_orderkey") % 3 == 0, 6).when(F.col("o_orderkey") % 3 == 1, 24).otherwise(72).alias("period_hours"))


def history_buckets_6h(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("event_id").alias("snapshot_id"), F.col("ts").alias("computed_at"))
    return ranking.latest_in_bucket(e, "computed_at", "6 hours").select("bucket", "snapshot_id", "computed_at")


def latest_snapshot_asof(spark, sf):
    return serving.latest_snapshot(_snapshots(spark, sf), 24, dt.datetime(1996, 6, 1)).select("ranking_id", "computed_at", "period_hours")


def filter_content(spark, sf):
    out = filtering.filter_content(A.text_docs(spark, sf), A.FILTER)
    return out.select("doc_id", "filter_status", F.array_join("filter_reasons", ",").alias("filter_reasons"), "quality_weight")


def filter_baseline(spark, sf):
    out = filtering.filter_content(A.text_docs(spark, sf), A.FILTER)
    return filtering.with_baseline(out, A.FILTER).groupBy("filter_status", "quality_weight").agg(F.count("*").alias("documents"))


def clean_text(spark, sf):
    out = text.clean(A.text_docs(spark, sf), emoji=False)
    return out.select("doc_id", F.sha2("normalized_text", 256).alias("normalized_sha"), "token_count", F.array_join("cleanup_flags", ",").alias("cleanup_flags"))


def stem_tokens(spark, sf):
    d = A.text_docs(spark, sf).select(F.explode(text.stems(F.col("text"))).alias("stem"))
    return d.groupBy("stem").agg(F.count("*").alias("n"))


def classify_document(spark, sf):
    return r6(text.classify(A.text_docs(spark, sf), A.TAXONOMY), "category_confidence")


def text_fingerprint(spark, sf):
    return A.text_docs(spark, sf).select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), text.preview(F.col("text")).alias("preview"))


def exact_dedup_groups(spark, sf):
    return dedup.exact_groups(A.text_docs(spark, sf))


def shingle_stats(spark, sf):
    return A.text_docs(spark, sf).select("doc_id", F.size(dedup.shingles(F.col("text"))).alias("n_shingles"))


def near_dup_groups(spark, sf):
    return dedup.duplicate_groups(A.text_docs(spark, sf))


def _signed_documents(spark, sf):
    c = DedupConfig()
    return A.text_docs(spark, sf).select("doc_id", dedup.text_signature(F.col("text"), c.shingle_size, c.permutations).alias("signature"))


def minhash_signature(spark, sf):
    return _signed_documents(spark, sf).select("doc_id", F.sha2(F.array_join("signature", ""), 256).alias("signature_sha"))


def lsh_candidates(spark, sf):
    firsts = dedup._cut(dedup.firsts(A.text_docs(spark, sf)))  # copies are one document here
    signed = firsts.select("doc_id", dedup.text_signature(F.col("text"), 5, 64, dedup.common_hashes(firsts, 5, 64)).alias("signature"))
    return dedup.candidates(dedup.bands(signed, DedupConfig()))


def near_dup_pairs(spark, sf):
    return r6(dedup.near_pairs(A.text_docs(spark, sf)), "similarity")


def normalize_events_json(spark, sf):
    frames = [normalize.normalize(df, config) for config, df in A.payloads(spark, sf).values()]
    out = reduce(DataFrame.unionByName, frames)
    return out.select(*[c for c in normalize.COLUMNS if c not in ("created_at", "collected_at", "raw_payload")], F.unix_seconds("created_at").alias("created_epoch"))


def extract_page_links(spark, sf):
    return html.links(A.table(spark, sf, "pages"), limit=15).groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("link").alias("first_link"))


def page_article(spark, sf):
    out = html.articles(A.table(spark, sf, "pages"))
    return out.select("page_id", "title", F.sha2("text", 256).alias("text_sha"), "created_at_raw", "appeal_id")


BOXES = [
    {"label": "low", "region_id": "r0", "lat_min": 0.0, "lat_max": 30.0, "lon_min": -20.0, "lon_max": 40.0}, {"label": "mid", "region_id": "r1", "municipality_id": "m1", "lat_min": 20.0, "lat_max": 60.0, "lon_min": 0.0, "lon_max": 90.0},
]
TOPONYMS = [("the and", {"region_id": "t0"}), ("der", {"region_id": "t1"}), ("of the", {"region_id": "t2", "municipality_id": "m2"}), ("la", {"region_id": "t3", "confidence": 0.5})]
REGIONS = [("west", 10.0, -10.0), ("east", 10.0, 50.0), ("north", 55.0, 20.0), ("centre", 30.0, 20.0)]


def _located(spark, sf):
    c = A.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("doc_id"), (F.col("c_nationkey") * 3.0).alias("geo_lat"), (F.col("c_custkey") % 120 - 20.0).alias("geo_lon"))


def geo_bbox(spark, sf):
    g = geo.explicit(F.col("geo_lat"), F.col("geo_lon"), BOXES)
    return _located(spark, sf).withColumn("g", g).filter("g IS NOT NULL").select("doc_id", "g.region_id", "g.municipality_id", "g.geo_confidence")


def geo_toponym(spark, sf):
    g = geo.toponym(F.col("text"), TOPONYMS)
    return A.text_docs(spark, sf).withColumn("g", g).select("doc_id", "g.region_id", "g.municipality_id", "g.geo_confidence")


def geo_priority(spark, sf):
    d = A.text_docs(spark, sf).withColumns({"geo_lat": F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 80).cast("double")), "geo_lon": (F.col("doc_id") % 100).cast("double")})
    config = {"explicit_geo_regions": BOXES, "toponyms": TOPONYMS[:1], "metadata_geo": None, "default_region_id": "dflt"}
    out = geo.enrich(d, config, languages=("en", "de"))
    return out.select("doc_id", "region_id", "geo_confidence", "geo_source", F.size("geo_evidence").alias("n_evidence"))


def nearest_region(spark, sf):
    return geo.nearest(_located(spark, sf), REGIONS, "geo_lat", "geo_lon").groupBy("nearest_region").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def cluster_centroids(spark, sf):
    c = vectors.centroids(A.members(spark, sf), "cluster_id")
    return c.select("cluster_id", "size", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 5))


def cluster_cohesion(spark, sf):
    m = A.members(spark, sf)
    return vectors.cohesion(m, vectors.centroids(m, "cluster_id"), "cluster_id").withColumn("cohesion_score", F.round("cohesion_score", 5))


def cluster_metrics(spark, sf):
    m = A.members(spark, sf)
    cents = vectors.centroids(m, "cluster_id")
    rows = vectors.cohesion(m, cents, "cluster_id").join(cents, "cluster_id").withColumn("noise", F.col("cluster_id") == 0)
    out = cluster.run_metrics(rows)
    return out.withColumns({"noise_ratio": F.round("noise_ratio", 5), "avg_cohesion": F.round("avg_cohesion", 5)})


def cluster_enrichment(spark, sf):
    out = cluster.enrich(A.ranking_docs(spark, sf), NOW)
    return r6(out.withColumn("geo_regions", F.size("geo_regions")), "growth_rate")


def reconcile_clusters(spark, sf):
    m = A.members(spark, sf)
    new, old = vectors.centroids(m, "cluster_id"), vectors.centroids(m.filter("doc_id % 2 = 0"), "cluster_id")
    return cluster.reconcile(new, old, ClusterConfig(reconcile_threshold=0.5)).withColumn("similarity", F.round("similarity", 5))


def batch_cosine_stats(spark, sf):
    out = vectors.batch_metrics(A.members(spark, sf))
    return out.select(*[F.round(c, 5).alias(c) if c != "n_vectors" else F.col(c) for c in out.columns])


def _nearest_topic(spark, sf):
    m = A.members(spark, sf)
    return cluster.assign_online(m, vectors.centroids(m, "cluster_id"), ClusterConfig(assignment_threshold=0.3))


def nearest_topic(spark, sf):
    return _nearest_topic(spark, sf).select("doc_id", "cluster_id", F.round("strength", 5).alias("strength"), "assigned")


def _online(spark, sf):
    m = A.members(spark, sf)
    model = dedup._cut(cluster.density_model(m.withColumn("window", F.lit(0)), "window"))
    return cluster.predict(m, model.join(m.select("doc_id", "embedding"), "doc_id"))


def online_assign(spark, sf):
    return _online(spark, sf).filter("assigned").select("doc_id", "label", F.round("strength", 6).alias("strength"))


def buffered_candidates(spark, sf):
    return _online(spark, sf).filter("NOT assigned").select("doc_id", F.round("strength", 6).alias("last_strength"))


def unassigned_docs(spark, sf):
    d = A.text_docs(spark, sf)
    return cluster.unassigned(d, d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 = 1")).select("doc_id")


def density_clusters(spark, sf):
    return cluster.density_clusters(A.members(spark, sf).withColumn("window", F.lit(0)), "window").select("doc_id", "label", F.round("strength", 6).alias("strength"))


def representative_docs(spark, sf):
    m = A.members(spark, sf)
    cents = vectors.centroids(m, "cluster_id")
    near = m.join(cents, "cluster_id").select("cluster_id", "doc_id", F.round(vectors.dot(F.col("embedding"), F.col("centroid")), 5).alias("similarity"))
    return summarize.representatives(near.join(A.text_docs(spark, sf), "doc_id"), SummaryConfig(max_documents=12, max_tokens=1200)).select("cluster_id", "doc_id", "position", "tokens")


def chunk_windows(spark, sf):
    return text.chunk_windows(A.text_docs(spark, sf), "text").select("doc_id", "chunk", "start", "n_tokens", F.sha2("chunk_text", 256).alias("chunk_sha"))


def sentiment_from_scores(spark, sf):
    e = A.table(spark, sf, "events")
    v = F.pmod(F.floor(F.col("value") * 100), F.lit(64)) / 64.0
    pair = lambda n, s: F.struct(F.lit(n).alias("label"), s.alias("score"))
    scores = F.when(F.col("event_type") == "click", F.array(pair("LABEL_2", v), pair("neg", 1 - v), pair("neutral", v * 0.5))).when(F.col("event_type") == "view", F.array(pair("POS", v), pair("label_0", F.lit(0.25)))).when(
        F.col("event_type") == "error", F.array(pair("negative", v))
    ).otherwise(F.array(pair("neu", v)))
    return e.select("event_id", sentiment.from_scores(scores).alias("sentiment_score"))


def documents_page(spark, sf):
    docs = A.ranking_docs(spark, sf)
    return serving.page(docs.select("cluster_id", "doc_id"), docs.drop("cluster_id"), 4, 2, 25)[0].select("doc_id", "created_at", "reach")


def _items(spark, sf):
    docs = A.ranking_docs(spark, sf)
    items = ranking.urgency(ranking.rank(docs, A.clusters(spark), NOW))
    cats = ranking.category(docs, NOW, PERIODS).select("period_hours", "cluster_id", "category")
    items = items.join(cats, ["period_hours", "cluster_id"])
    return serving.with_children(items, ranking.source_summaries(docs, NOW, PERIODS), "sources", "ordinal").filter("period_hours = 72")


def top_filtered(spark, sf):
    return r6(serving.top(_items(spark, sf), limit=5, source="click", region="NATION_0").select("rank", "cluster_id", "score"), "score")


def export_rows(spark, sf):
    items = _items(spark, sf).withColumns({
        "summary": F.concat(F.lit("topic "), F.col("cluster_id")), "mention_count": F.col("size"), "period_start": ranking.ntz(NOW - dt.timedelta(hours=72)), "period_end": ranking.ntz(NOW), "computed_at": ranking.ntz(NOW),
    })
    return r6(serving.export_rows(items), "score", "growth_rate")


def pipeline_stats(spark, sf):
    counts = [A.table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), F.lit("table").alias("kind"), "n") for t in ("events", "documents", "embeddings", "labels", "pages", "conversations")]
    by_type = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")).select("name", F.lit("source_type").alias("kind"), "n")
    return reduce(DataFrame.unionByName, [*counts, by_type])


def health_status(spark, sf):
    e = A.table(spark, sf, "events")
    stages = {k: (e.filter(F.col("event_type") == t), "ts") for k, t in (("embedding", "click"), ("clustering", "view"), ("summarization", "error"), ("ranking", "purchase"), ("missing", "none"))}
    return r6(serving.health(stages, NOW, 30), "age_minutes")


def table_metrics(spark, sf):
    t = {"events": (A.table(spark, sf, "events"), "ts"), "orders": (A.table(spark, sf, "orders"), "o_orderdate"), "documents": (A.table(spark, sf, "documents"), None)}
    return serving.table_metrics(t, NOW)


def documents_with_ml(spark, sf):
    d = A.text_docs(spark, sf)
    prints = d.select("doc_id", F.sha2("text", 256).alias("text_hash"))
    labels = A.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("category"), F.col("toxic").alias("toxicity"))
    return serving.documents_with_ml(d.select("doc_id", "language"), prints, labels)


def latest_upsert(spark, sf):
    e = A.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return serving.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ("user_id", "event_type"), "event_id")


def official_documents(spark, sf):
    d = A.ranking_docs(spark, sf).select("doc_id", "source_type", F.col("author_id").cast("string").alias("source_id"), F.col("author_id").cast("string").alias("author_id"), (F.col("doc_id") % 50 == 0).alias("is_official"))
    reg = A.table(spark, sf, "events").filter("user_id % 7 = 0").select(F.lit("click").alias("source_type"), F.col("user_id").cast("string").alias("source_id"))
    return serving.official(d, reg, author_ids=("5", "11")).groupBy("source_type", "is_official").agg(F.count("*").alias("n"))


def _answers(spark, sf):
    c = A.table(spark, sf, "conversations").filter("role = 'assistant'")
    words = F.split(F.regexp_replace("text", r"(?U)[^\w ]+", " "), " +")
    phrases = F.array_join(F.slice(F.array_distinct(F.filter(words, lambda w: w != "")), 1, 6), "; ")
    return c.select("conv_id", "turn", "text", F.concat(F.lit("ОПИСАНИЕ: "), "text", F.lit("\nФРАЗЫ: "), phrases).alias("answer"))


def parse_summary(spark, sf):
    return _answers(spark, sf).withColumn("p", summarize.parsed("answer")).select("conv_id", "turn", "p.summary", F.array_join("p.key_phrases", ";").alias("key_phrases"))


def validate_summary(spark, sf):
    rows = _answers(spark, sf).withColumn("p", summarize.parsed("answer")).select("conv_id", "turn", "p.summary", "p.key_phrases", F.array("text").alias("documents"))
    return summarize.validate(rows).select("conv_id", "turn", "invalid_reason")


def passage_text(spark, sf):
    d = A.text_docs(spark, sf)
    return d.select("doc_id", F.sha2(text.passage(F.col("text"), F.col("author_id")), 256).alias("passage_sha"))


def annotate_language(spark, sf):
    d = A.text_docs(spark, sf).select("doc_id", "text")
    return r6(language.annotate(d, supported=("en", "de", "fr", "es")).select("doc_id", "language", "language_confidence", "is_supported_language"), "language_confidence")


def source_urls(spark, sf):
    e = A.table(spark, sf, "events")
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "vk_post").when(i % 3 == 1, "vk_comment").otherwise("rss_article")
    ident = F.when(i % 3 == 0, F.concat_ws("_", "user_id", "event_id")).otherwise(F.concat_ws("_", "user_id", "event_id", F.lit("7")))
    payload = F.when(i % 5 == 0, F.concat(F.lit('{"link": "https://a.example/'), i, F.lit('"}'))).otherwise(F.col("props"))
    return e.select("event_id", text.source_url(kind, ident, payload).alias("source_url"))


def streaming_rank(spark, sf):
    """The last snapshot of a stream of events that comes in several micro-batches."""
    at = tables.shared_folder(spark, "streaming_rank")
    events = A.table(spark, sf, "events").select("event_id", "event_type")
    jobs.ranking_job(jobs.replayed(events, f"{at}/in", "event_id", 2), A.clusters(spark), lambda: A.ranking_docs(spark, sf), f"{at}/out", f"{at}/check", NOW, RankingConfig(periods=(24,))).awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    last = out.agg(F.max("batch_id").alias("batch_id"))
    out = out.join(F.broadcast(last), "batch_id").withColumn("geo_regions", F.array_join("geo_regions", ","))  # one row
    cols = ["period_hours", "cluster_id", "rank", "score", "size", "weighted_size", "unique_authors", "unique_sources", "reach_total", "growth_rate", "sentiment_score", "geo_regions", "is_new", "is_growing"]
    return r6(out.select(*cols), "score", "growth_rate", "sentiment_score")


def streaming_hourly_counts(spark, sf):
    """Events by hour and type, in four micro-batches out of order; late ones correct closed hours."""
    at = tables.shared_folder(spark, "streaming_hourly_counts")
    events = A.table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("source_type"), F.floor("value").alias("reach"))
    jobs.hours_job(jobs.replayed(events, f"{at}/in", "event_id"), f"{at}/out", f"{at}/check").awaitTermination()
    return jobs.hours(spark, f"{at}/out").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "source_type", "count", "reach")


def streaming_preprocess(spark, sf):
    """All documents in three micro-batches, out of order, as the stream leaves them."""
    at = tables.shared_folder(spark, "streaming_preprocess")
    docs = A.text_docs(spark, sf).select("doc_id", "text", "author_id", "created_at", "is_official")
    jobs.preprocess_job(jobs.replayed(docs, f"{at}/in", "doc_id", 3), f"{at}/out", f"{at}/check", A.FILTER, supported=("en", "de", "fr", "es")).awaitTermination()
    out = history.current(spark, f"{at}/out")
    return out.select("doc_id", "language", "filter_status", F.array_join("filter_reasons", ",").alias("filter_reasons"), "token_count", "text_sha256", "canonical_doc_id", "duplicate_cluster_size", "near_duplicate_flag", F.array_join("anomaly_flags", ",").alias("anomaly_flags"), F.round("quality_weight", ROUND).alias("quality_weight"))


QUERIES = {
    f.__name__: f
    for f in (
        rank_topics, rank_topics_3_windows, rank_exclusions, score_breakdown, urgency, explain_rank, topic_timeline_72h, topic_timeline_unweighted, topic_sources, topic_samples, topic_category,
        weighted_sentiment, weighted_growth, snapshot_metrics, author_burst, velocity_flood, bot_timing, history_buckets_6h, latest_snapshot_asof, filter_content, filter_baseline, clean_text, stem_tokens,
        classify_document, text_fingerprint, exact_dedup_groups, shingle_stats, minhash_signature, lsh_candidates, near_dup_pairs, near_dup_groups, normalize_events_json, extract_page_links, page_article,
        geo_bbox, geo_toponym, geo_priority, nearest_region, cluster_centroids, cluster_cohesion, cluster_metrics, cluster_enrichment, reconcile_clusters, batch_cosine_stats, nearest_topic, online_assign, buffered_candidates,
        unassigned_docs, density_clusters, representative_docs, chunk_windows, sentiment_from_scores, documents_page, top_filtered, export_rows, pipeline_stats, health_status, table_metrics, documents_with_ml,
        latest_upsert, official_documents, parse_summary, validate_summary, passage_text, annotate_language, source_urls,
        streaming_rank, streaming_hourly_counts, streaming_preprocess,
    )
}
