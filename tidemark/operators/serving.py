"""What is served: latest snapshots, filtered tops, pages, histories, health, exports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import ntz

# Columns of the export.
EXPORT_COLUMNS = (
    "rank", "cluster_id", "summary", "category", "mention_count", "unique_authors", "reach_total", "growth_rate",
    "geo_regions", "sources", "score", "urgency", "period_start", "period_end", "computed_at",
)


def latest_snapshot(snapshots: DataFrame, period_hours: int, as_of: dt.datetime | None = None) -> DataFrame:
    rows = snapshots.filter(F.col("period_hours") == period_hours)
    if as_of is not None:
        rows = rows.filter(F.col("computed_at") <= ntz(as_of))
    return rows.orderBy(F.desc("computed_at"), F.desc("ranking_id")).limit(1)


def check_request(*, as_of: dt.datetime | None, computed_at: dt.datetime, now: dt.datetime, max_age_minutes: int = 30, page: int = 1, limit: int = 10, since=None, until=None) -> int:
    """200, or the status that refuses the request."""
    if as_of is not None and as_of > now or page < 1 or not 1 <= limit <= 100 or since is not None and until is not None and until <= since:
        return 422
    return 503 if as_of is None and now - computed_at > dt.timedelta(minutes=max_age_minutes) else 200


def top(items: DataFrame, *, limit: int = 10, category: str | None = None, region: str | None = None, source: str | None = None) -> DataFrame:
    """Ranked items that pass the filters, numbered anew. ``sources``: array of (source_type, count)."""
    if category is not None:
        items = items.filter(F.col("category") == category)
    if region is not None:
        items = items.filter(F.array_contains("geo_regions", region))
    if source is not None:
        items = items.filter(F.exists("sources", lambda s: s["source_type"] == source))
    best = items.orderBy("rank", "cluster_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("rank", "cluster_id")))  # at most ``limit`` rows


def page(members: DataFrame, docs: DataFrame, cluster_id, number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(a page of a cluster's documents, newest first; their total count)."""
    rows = members.filter(F.col("cluster_id") == cluster_id).join(docs, "doc_id")
    return rows.orderBy(F.desc("created_at"), F.desc("doc_id")).offset((number - 1) * size).limit(size), rows.agg(F.count("*").alias("total"))


def with_children(header: DataFrame, child: DataFrame, name: str, order: str, keys: tuple[str, ...] = ("period_hours", "cluster_id")) -> DataFrame:
    """Child rows as an ordered array column; a header without children has an empty one."""
    cols = [c for c in child.columns if c not in keys]
    lists = child.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.struct(*cols).alias("v")))).alias("_l"))
    rows = header.join(lists, list(keys), "left").withColumn(name, F.transform(F.coalesce("_l", F.array().cast(lists.schema["_l"].dataType)), lambda x: x["v"]))
    return rows.drop("_l")


def export_rows(items: DataFrame) -> DataFrame:
    """The 15 columns of the CSV export; lists joined by semicolons."""
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    rows = items.withColumns({
        "geo_regions": F.array_join("geo_regions", ";"),
        "sources": F.array_join(F.transform("sources", lambda s: F.concat(s["source_type"], F.lit(":"), s["count"].cast("string"))), ";"),
        **{c: iso(F.col(c)) for c in ("period_start", "period_end", "computed_at")},
    })
    return rows.select(*EXPORT_COLUMNS)


def export_csv(items: DataFrame, path: str) -> None:
    export_rows(items).orderBy("rank").write.mode("overwrite").option("header", True).csv(path)


def export_sheets(items: DataFrame) -> dict[str, DataFrame]:
    """The three sheets of a workbook: items, score parts, sources. Writing xlsx needs a library that is not here."""
    parts = [F.col(f"{c}_component").alias(c) for c in ("volume", "dynamics", "sentiment", "reach", "geo", "source")]
    return {
        "top": export_rows(items),
        "breakdown": items.select("rank", "cluster_id", *parts, F.col("score").alias("итого")),
        "sources": items.select("rank", "cluster_id", F.explode("sources").alias("s")).select("rank", "cluster_id", "s.source_type", "s.count"),
    }


def freshness(age_minutes: Column, threshold: int) -> Column:
    return F.when(age_minutes.isNull(), "down").when(age_minutes <= threshold, "ok").when(age_minutes <= 2 * threshold, "degraded").otherwise("down")


def health(stages: dict[str, tuple[DataFrame, str]], now: dt.datetime, threshold_minutes: int = 30) -> DataFrame:
    """(stage, last_at, age_minutes, status) from the latest time of each stage's table."""
    rows = [df.agg(F.max(at).cast("timestamp_ntz").alias("last_at")).select(F.lit(name).alias("stage"), "last_at") for name, (df, at) in stages.items()]
    age = (F.unix_micros(ntz(now).cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 6e7
    return reduce(DataFrame.unionByName, rows).withColumn("age_minutes", age).withColumn("status", freshness(F.col("age_minutes"), threshold_minutes))


def table_metrics(tables: dict[str, tuple[DataFrame, str | None]], now: dt.datetime) -> DataFrame:
    """(table, rows, freshness_seconds) for a metrics exporter; an empty table is 1e9 s old."""
    rows = [
        df.agg(F.count("*").alias("rows"), (F.max(at).cast("timestamp_ntz") if at else F.lit(None).cast("timestamp_ntz")).alias("last")).select(F.lit(name).alias("table"), "rows", "last")
        for name, (df, at) in tables.items()
    ]
    age = (F.unix_micros(ntz(now).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return reduce(DataFrame.unionByName, rows).select("table", "rows", F.coalesce(age, F.lit(1e9)).alias("freshness_seconds"))


def request_metrics(log: DataFrame) -> DataFrame:
    """Counts by status class, cache hit ratio and p99 by index; ``log``: a rolling window of requests (status, latency_ms, hit)."""
    stats = log.agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") < 400).alias("ok"), F.count_if(F.col("status").between(400, 499)).alias("refused"), F.count_if(F.col("status") >= 500).alias("failed"),
        F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_ratio"),
    )
    # the p99 by counts of equal latencies: what is ordered are a rolling window's distinct values, one row of them an array
    ends = log.groupBy("latency_ms").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("latency_ms", "n"))).alias("v"))
    both = stats.join(F.broadcast(ends))  # one row each
    rank = F.rint((F.col("requests") - 1) * 0.99)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("x"))
    found = F.aggregate("v", start, lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), F.when((a["n"] <= rank) & (a["n"] + e["n"] > rank), e["latency_ms"].cast("double")).otherwise(a["x"]).alias("x")))
    return both.select(*stats.columns, found["x"].alias("p99_ms"))


def documents_with_ml(docs: DataFrame, fingerprints: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with what is known of them; the models' category is ``ml_category``."""
    own = [c for c in results.columns if c != "doc_id"]
    return docs.join(fingerprints, "doc_id", "left").join(results.select("doc_id", *[F.col(c).alias(f"ml_{c}") for c in own]), "doc_id", "left")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """One row a key, the highest version; write it to a new directory and switch to that."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(version))
    return old.unionByName(new).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def official(docs: DataFrame, registry: DataFrame, *, source_ids: tuple[str, ...] = (), author_ids: tuple[str, ...] = (), by_config: bool = False) -> DataFrame:
    """Sets is_official: own flag, configuration, registry of (source_type, source_id), or lists of ids."""
    known = registry.select("source_type", "source_id").distinct().withColumn("_r", F.lit(True))
    yes = F.coalesce("is_official", F.lit(False)) | F.lit(by_config) | F.coalesce("_r", F.lit(False))
    if source_ids:
        yes = yes | F.coalesce(F.col("source_id").isin(*source_ids), F.lit(False))
    if author_ids:
        yes = yes | F.coalesce(F.col("author_id").isin(*author_ids), F.lit(False))
    return docs.join(known, ["source_type", "source_id"], "left").withColumn("is_official", yes).drop("_r")


# Where a map without points is centred, and the sizes of its markers.
MAP_CENTER, LEAST_RADIUS, MOST_RADIUS, RADIUS_STEP = (47.4743, 40.6964), 8, 28, 0.9


def map_points(items: DataFrame) -> DataFrame:
    """Mean point of located items: lat, lon; the fixed centre where there are none."""
    return items.agg(*[F.coalesce(F.avg(c), F.lit(d)).alias(c) for c, d in zip(("lat", "lon"), MAP_CENTER, strict=True)])


def marker_radius(mentions: Column) -> Column:
    """A marker's radius in pixels: it grows with the square root of the mentions, within bounds; halves go up."""
    size = F.floor(LEAST_RADIUS + F.sqrt(F.greatest(mentions, F.lit(1))) * RADIUS_STEP + 0.5)
    return F.greatest(F.lit(LEAST_RADIUS), F.least(F.lit(MOST_RADIUS), size)).cast("int")


def latest(df: DataFrame, at: str, id_col: str, n: int = 5) -> DataFrame:
    """The last ``n`` rows."""
    return df.orderBy(F.desc(at), F.desc(id_col)).limit(n)


def latest_item(rankings: DataFrame, items: DataFrame, cluster_id, period_hours: int = 24) -> DataFrame:
    """A cluster's item in the last ranking of a period that has it."""
    both = rankings.filter(F.col("period_hours") == period_hours).join(items.filter(F.col("cluster_id") == cluster_id), "ranking_id")
    return both.orderBy(F.desc("computed_at"), F.desc("ranking_id")).limit(1)


def save_ranking(header: DataFrame, items: DataFrame, children: dict[str, DataFrame], path: str, ranking_id: str) -> None:
    """A snapshot under one id: a table each for header, items and children, in a partition that a second run replaces.
    The header comes last, so a snapshot that has one is whole."""
    for name, df in (*children.items(), ("items", items), ("header", header)):
        df.withColumn("ranking_id", F.lit(ranking_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ranking_id").parquet(f"{path}/{name}")


def save_ml_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest result of each document; a new row without a status is ``processed``, or ``error`` if it has a message."""
    status = F.coalesce("status", F.when(F.col("error_message").isNotNull(), "error").otherwise("processed"))
    return upsert(old, new.withColumn("status", status), ("doc_id",), "processed_at")


def with_raw(docs: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their raw payload, documents whose raw message is missing), by source_type and source_id."""
    key = ["source_type", "source_id"]
    return docs.join(raw.select(*key, "raw_payload"), key), docs.join(raw.select(*key), key, "left_anti")
