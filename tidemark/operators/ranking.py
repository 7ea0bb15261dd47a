"""Ranking: window aggregates, exclusions, scores, ranks and what is shown beside them.

Documents: doc_id, cluster_id, author_id, source_type, created_at, reach, region,
quality_weight, sentiment_score[, category, category_label, text]. One row of the result
per (period_hours, cluster_id). All windows of one run share one scan and one shuffle by
(period_hours, cluster_id); what follows works on rows of clusters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import RankingConfig, UrgencyConfig

COMPONENTS = ("volume", "dynamics", "sentiment", "reach", "geo", "source")
# Names of the components in explanations.
COMPONENT_NAMES = {
    "volume": "объём упоминаний", "dynamics": "динамика роста", "sentiment": "негативная тональность",
    "reach": "охват аудитории", "geo": "гео-покрытие", "source": "разнообразие источников",
}


def ntz(value: dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 on with at most three digits after the point, as C and Python print it: the value of the double itself
    is rounded, exact halves to the even digit. (``format_string`` rounds its shortest decimal form, halves up.)"""
    scale, half = 10**digits, 2**52
    part = (x - F.floor(x)) * float(2**53)  # no rounding: floor and power of two
    below = (part - F.floor(part)) * scale  # nothing for numbers from 1/2 on
    n = F.floor(part) * scale + F.floor(below)
    q, rest = F.shiftright(n, 53), n.bitwiseAND(F.lit(2 * half - 1))
    up = (rest > half) | ((rest == half) & ((below > F.floor(below)) | (q % 2 == 1)))
    units = F.floor(x) * scale + q + up.cast("long")
    return F.concat(((units - units % scale) / scale).cast("long").cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), digits, "0"))


def weighted_sum(value: Column, weight: Column, when: Column) -> Column:
    return F.sum(F.when(when, value * weight).otherwise(F.lit(0.0)))


def by_period(docs: DataFrame, now: dt.datetime, periods: tuple[int, ...]) -> DataFrame:
    """Documents of the longest window, once for each window that holds them; both ends belong to it."""
    longest = docs.filter(F.col("created_at").between(ntz(now - dt.timedelta(hours=max(periods))), ntz(now)))
    inside = F.array(*[F.when(F.col("created_at") >= ntz(now - dt.timedelta(hours=p)), F.lit(p)) for p in sorted(periods)])
    return longest.withColumn("period_hours", F.explode(F.array_compact(inside)))


def window_aggregates(docs: DataFrame, now: dt.datetime, periods: tuple[int, ...]) -> DataFrame:
    w, t = F.col("quality_weight"), F.col("created_at")
    six, twelve = ntz(now - dt.timedelta(hours=6)), ntz(now - dt.timedelta(hours=12))
    heft = F.greatest(F.col("reach") * w, w)
    rated = F.col("sentiment_score").isNotNull() & (heft > 0)
    one = F.lit(1.0)
    agg = by_period(docs, now, periods).groupBy("period_hours", "cluster_id").agg(
        F.count("*").alias("size"),
        F.sum(w).alias("weighted_size"),
        F.count_distinct("author_id").alias("unique_authors"),
        F.count_distinct("source_type").alias("unique_sources"),
        F.rint(F.sum(F.col("reach") * w)).cast("long").alias("reach_total"),
        F.array_sort(F.collect_set(F.when(F.col("region") != "", F.col("region")))).alias("geo_regions"),
        F.min(t).alias("earliest_doc_at"),
        F.max(t).alias("latest_doc_at"),
        weighted_sum(one, w, t >= six).alias("recent"),
        weighted_sum(one, w, (t >= twelve) & (t < six)).alias("previous"),
        weighted_sum(F.col("sentiment_score"), heft, rated).alias("sentiment_sum"),
        weighted_sum(one, heft, rated).alias("sentiment_weight"),
    )
    return agg.select(
        "*",
        (F.col("recent") / F.greatest("previous", F.lit(1.0))).alias("growth_rate"),
        F.when(F.col("sentiment_weight") > 0, F.col("sentiment_sum") / F.col("sentiment_weight")).otherwise(0.0).alias("sentiment_score"),
    ).drop("recent", "previous", "sentiment_sum", "sentiment_weight")


def with_exclusion(aggregates: DataFrame, clusters: DataFrame, now: dt.datetime, config: RankingConfig) -> DataFrame:
    """Every (period, cluster) with ``reason``, null where it is ranked. ``clusters``: cluster_id,
    noise, described, needs_review. The first reason in order counts."""
    periods = F.explode(F.array(*map(F.lit, config.periods))).alias("period_hours")
    joined = clusters.select("*", periods).join(aggregates, ["period_hours", "cluster_id"], "left")
    reason = (
        F.when(F.col("size").isNull(), "empty_window")
        .when(~F.col("described"), "missing_description")
        .when(F.col("noise"), "noise_cluster")
        .when(F.col("size") < config.min_cluster_size, "too_small")
        .when(F.col("latest_doc_at") < ntz(now - dt.timedelta(hours=config.stale_after_hours)), "stale")
        .when(F.col("needs_review"), "needs_review")
    )
    return joined.withColumn("reason", reason)


def _log_share(value: str, over) -> Column:
    x = F.log1p(F.greatest(F.lit(0.0), F.col(value).cast("double")))
    top = F.max(x).over(over)
    return F.when(top > 0, clamp(x / top)).otherwise(0.0)


def dynamics(growth: Column) -> Column:
    """Rises to 0.3 at 1, falls to 0 just above it, then grows with the logarithm to 1 at 5."""
    return F.when(growth <= 1.0, F.greatest(F.lit(0.0), (growth - 0.5) / 0.5) * 0.3).otherwise(F.least(F.lit(1.0), F.log(growth) / F.log(F.lit(5.0))))


def score(ranked: DataFrame, now: dt.datetime, config: RankingConfig) -> DataFrame:
    """Scores and ranks of surviving clusters, against the survivors of their period."""
    over = Window.partitionBy("period_hours")
    regions = ranked.select("period_hours", F.explode("geo_regions").alias("r")).groupBy("period_hours").agg(F.count_distinct("r").alias("total_regions"))
    rows = ranked.join(F.broadcast(regions), "period_hours", "left")  # one row a period
    parts = {
        "volume": _log_share("weighted_size", over),
        "dynamics": dynamics(F.col("growth_rate")),
        "sentiment": (1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sentiment_score")))) / 2.0,
        "reach": _log_share("reach_total", over),
        "geo": clamp(F.size("geo_regions") / F.greatest(F.coalesce("total_regions", F.lit(0)) * config.geo_max_coverage_ratio, F.lit(1.0))),
        "source": clamp(F.col("unique_sources") / float(max(config.source_type_count, 1))),
    }
    rows = rows.withColumns({f"{k}_component": v for k, v in parts.items()})
    total = sum((F.col(f"{k}_component") * config.weights[k] for k in COMPONENTS), F.lit(0.0))
    order = Window.partitionBy("period_hours").orderBy(F.desc("score"), F.desc("size"), F.desc("reach_total"), "cluster_id")
    new = F.col("earliest_doc_at") > ntz(now - dt.timedelta(hours=config.new_cluster_hours))
    return (
        rows.withColumn("score", clamp(total))
        .withColumn("rank", F.row_number().over(order))
        .withColumns({"is_new": new, "is_growing": F.col("growth_rate") > config.growing_threshold})
        .drop("total_regions")
    )


def rank(docs: DataFrame, clusters: DataFrame, now: dt.datetime, config: RankingConfig | None = None) -> DataFrame:
    config = config or RankingConfig()
    kept = with_exclusion(window_aggregates(docs, now, config.periods), clusters, now, config).filter("reason IS NULL")
    return score(kept, now, config)


def exclusion_counts(docs: DataFrame, clusters: DataFrame, now: dt.datetime, config: RankingConfig | None = None) -> DataFrame:
    config = config or RankingConfig()
    rows = with_exclusion(window_aggregates(docs, now, config.periods), clusters, now, config)
    return rows.filter("reason IS NOT NULL").groupBy("period_hours", "reason").agg(F.count("*").alias("clusters"))


def explain(items: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``explanation``; without weights all count 1."""
    weights = weights or dict.fromkeys(COMPONENTS, 1.0)
    spread = F.size(F.array_distinct("geo_regions"))
    reasons = F.array_compact(
        F.array(
            F.concat(F.col("size").cast("string"), F.lit(" упоминаний")),
            F.when(F.col("is_new"), "тема появилась менее 3 часов назад"),
            F.when(F.col("is_growing"), F.concat(F.lit("рост в "), fixed(F.col("growth_rate"), 1), F.lit("x за последние 6 часов"))),
            F.when(spread > 1, F.concat(F.lit("охватывает "), spread.cast("string"), F.lit(" районов"))),
        )
    )
    parts = F.array(*[F.struct((-(F.col(f"{k}_component") * weights[k])).alias("v"), F.lit(i).alias("i"), F.lit(COMPONENT_NAMES[k]).alias("name")) for i, k in enumerate(COMPONENTS)])
    factors = F.array_join(F.transform(F.slice(F.sort_array(parts), 1, 2), lambda x: x["name"]), " и ")
    text = F.concat(F.lit("Ранг "), F.col("rank").cast("string"), F.lit(": "), F.array_join(reasons, "; "), F.lit(". Основные факторы: "), factors, F.lit("."))
    return items.withColumn("explanation", text)


def urgency(items: DataFrame, config: UrgencyConfig | None = None) -> DataFrame:
    """Adds ``urgency`` and ``urgency_reason``."""
    c = config or UrgencyConfig()
    spread = F.size("geo_regions")
    wide = F.concat(F.lit("охватывает "), spread.cast("string"), F.lit(" районов"))
    wide = F.when(spread >= c.critical_geo_spread, wide)
    rules = [
        (F.col("growth_rate") >= c.critical_growth_rate, "critical", F.concat(F.lit("рост в "), fixed(F.col("growth_rate"), 1), F.lit("x за 6 часов"))),
        (F.col("is_new") & (F.col("size") >= c.critical_new_size), "critical", F.concat(F.lit("новая тема с "), F.col("size").cast("string"), F.lit(" упоминаниями за 3 часа"))),
        (wide.isNotNull() & (F.col("sentiment_score") < c.critical_sentiment), "critical", wide),
        (F.col("score") >= c.high_score_threshold, "high", F.concat_ws("; ", wide, F.concat(F.lit("высокий суммарный балл "), fixed(F.col("score"), 2)))),
        (F.col("is_growing"), "high", F.concat_ws("; ", wide, F.lit("активный рост"))),
        (F.col("score") >= c.medium_score_threshold, "medium", F.lit("устойчивое упоминание")),
    ]
    level, reason = F, F
    for when, name, text in rules:
        level, reason = level.when(when, F.lit(name)), reason.when(when, text)
    return items.withColumns({"urgency": level.otherwise("low"), "urgency_reason": reason.otherwise("фоновый уровень")})


def timeline(docs: DataFrame, now: dt.datetime, hours: int = 72, *, weighted: bool = True) -> DataFrame:
    """(cluster_id, hour, count, reach, growth_rate): ``hours`` zero-filled buckets up to the hour of ``now``."""
    end = now.replace(minute=0, second=0, microsecond=0)
    start = end - dt.timedelta(hours=hours - 1)
    w = F.col("quality_weight") if weighted else F.lit(1.0)
    inside = docs.filter((F.col("created_at") >= ntz(start)) & (F.col("created_at") < ntz(end + dt.timedelta(hours=1))))
    hour = F.date_trunc("hour", F.col("created_at")).cast("timestamp_ntz").alias("hour")
    counted = inside.groupBy("cluster_id", hour).agg(F.sum(w).alias("n"), F.sum(F.col("reach") * w).alias("r"))
    grid = docs.select("cluster_id").distinct().withColumn("hour", F.explode(F.sequence(ntz(start), ntz(end), F.expr("INTERVAL 1 HOUR"))))
    rows = grid.join(counted, ["cluster_id", "hour"], "left").fillna(0.0, ["n", "r"])
    before = F.lag("n", 1, 0.0).over(Window.partitionBy("cluster_id").orderBy("hour"))
    growth = F.when((before != 0) | (F.col("n") != 0), F.col("n") / F.greatest(before, F.lit(1.0))).otherwise(0.0)
    return rows.select("cluster_id", "hour", F.rint("n").cast("long").alias("count"), F.rint("r").cast("long").alias("reach"), growth.alias("growth_rate"))


def source_summaries(docs: DataFrame, now: dt.datetime, periods: tuple[int, ...]) -> DataFrame:
    counts = by_period(docs, now, periods).groupBy("period_hours", "cluster_id", "source_type").agg(F.count("*").alias("count"))
    order = Window.partitionBy("period_hours", "cluster_id").orderBy(F.desc("count"), "source_type")
    return counts.withColumn("ordinal", F.row_number().over(order))


def samples(docs: DataFrame, described: DataFrame, now: dt.datetime, periods: tuple[int, ...], *, limit: int = 20, posts: int = 5) -> DataFrame:
    """Documents shown for a cluster: the description's own (cluster_id, doc_id, pos) in their order, then the newest."""
    first = described.groupBy("cluster_id", "doc_id").agg(F.min("pos").alias("pos"))
    rows = by_period(docs, now, periods).join(first, ["cluster_id", "doc_id"], "left")
    order = Window.partitionBy("period_hours", "cluster_id").orderBy(F.coalesce("pos", F.lit(2**31 - 1)), F.desc("created_at"), F.desc("doc_id"))
    return rows.withColumn("ordinal", F.row_number().over(order)).filter(F.col("ordinal") <= limit).withColumn("is_post", F.col("ordinal") <= posts)


def category(docs: DataFrame, now: dt.datetime, periods: tuple[int, ...]) -> DataFrame:
    """Heaviest category of a cluster, the lesser name on ties; the label first seen with it."""
    rows = by_period(docs, now, periods).withColumns({
        "category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("other")),
        "category_label": F.coalesce(F.nullif(F.col("category_label"), F.lit("")), F.lit("Прочее")),
    })
    per = rows.groupBy("period_hours", "cluster_id", "category").agg(
        F.sum("quality_weight").alias("weight"), F.min_by("category_label", F.struct("created_at", "doc_id")).alias("category_label")
    )
    best = F.row_number().over(Window.partitionBy("period_hours", "cluster_id").orderBy(F.desc("weight"), "category"))
    return per.withColumn("_n", best).filter("_n = 1").drop("_n")


def snapshot_metrics(items: DataFrame, previous: DataFrame, top_n: int = 10) -> DataFrame:
    """Score range, gap of the first two, entries that are new and that have gone, by period."""
    now_, then = items.filter(F.col("rank") <= top_n), previous.filter(F.col("rank") <= top_n)
    a = now_.groupBy("period_hours").agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.collect_set("cluster_id").alias("ids"),
    )
    b = then.groupBy("period_hours").agg(F.collect_set("cluster_id").alias("old"))
    both = a.join(b, "period_hours", "left").withColumn("old", F.coalesce("old", F.array().cast("array<bigint>")))
    return both.select(
        "period_hours", "min_score", "max_score", F.coalesce(F.col("first") - F.col("second"), F.lit(0.0)).alias("score_gap"),
        F.size(F.array_except("ids", "old")).alias("new_entries"), F.size(F.array_except("old", "ids")).alias("dropped_entries"),
    )


def latest_in_bucket(snapshots: DataFrame, at: str, bucket: str) -> DataFrame:
    """The last snapshot of each bucket; ``bucket`` as in '1 hour', '6 hours', '1 day'."""
    rows = snapshots.withColumn("bucket", F.window(F.col(at), bucket)["start"])
    last = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc(at), F.desc("snapshot_id")))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n")
