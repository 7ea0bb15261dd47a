"""Content filter and coordinated-activity flags.

Lexicons are substring tests on lower-cased text with collapsed white space. Windows are
range frames, one shuffle by key and bucket of event time: ``count`` over the window that ends at a row finds full
windows, ``max`` over the windows that start after it says whether one of them covers it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FilterConfig

PY_SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), PY_SPACE, " "))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """One alternation of quoted words: a single pass, whatever the lexicon's size."""
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def filter_content(df: DataFrame, config: FilterConfig | None = None, text_col: str = "text") -> DataFrame:
    """Adds filter_status (pass, review, drop), filter_reasons and quality_weight.

    Empty text is spam, checked before noise. Official documents are not complaints."""
    c = config or FilterConfig()
    t = F.lower(collapsed(F.col(text_col)))
    spam = (t == "") | contains_any(t, c.spam_signatures + c.ad_hashtags)
    n_words = F.size(F.split(t, " "))
    noise = (F.char_length(t) < c.min_text_length) & ~contains_any(t, c.relevant_short_markers) & (t.isin(list(c.noise_markers)) | (n_words <= 2))
    complaint = (F.char_length(t) >= c.min_meaningful_length) & contains_any(t, c.complaint_markers) & ~F.coalesce("is_official", F.lit(False))
    reason = F.when(spam, "spam_signature").when(noise, "short_noise").when(complaint, "complaint_like")
    return with_baseline(df.withColumn("filter_reasons", F.array_compact(F.array(reason))), c)


def with_baseline(df: DataFrame, config: FilterConfig | None = None) -> DataFrame:
    """filter_status and quality_weight that follow from filter_reasons."""
    c = config or FilterConfig()
    has = lambda *r: F.arrays_overlap("filter_reasons", F.array(*map(F.lit, r)))
    status = F.when(has("spam_signature", "short_noise"), "drop").when(F.size("filter_reasons") > 0, "review").otherwise("pass")
    weight = F.when(status == "drop", 0.0).when(status == "review", c.review_weight).otherwise(1.0)
    return df.withColumns({"filter_status": status, "quality_weight": weight})


#: Windows that a bucket of event time is long; rows within a window of its ends are in two buckets.
BUCKET_WINDOWS = 16


def _dealt(df: DataFrame, at: str, window_us: int) -> DataFrame:
    """Rows dealt to buckets of event time, each with what lies within one window of its ends, so that all windows around a bucket's own
    rows are whole. A key with very many rows is then many tasks, not one. ``_own``: whether a row is the bucket's own."""
    size = BUCKET_WINDOWS * window_us
    rows = df.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    home, into = F.floor(F.col("_us") / size), F.pmod(F.col("_us"), F.lit(size))
    near = F.array_compact(F.array(F.lit(0), F.when(into <= window_us, -1), F.when(into >= size - window_us, 1)))
    rows = rows.withColumn("_off", F.explode(F.when(F.col("_us").isNull(), F.array(F.lit(0))).otherwise(near)))
    return rows.withColumns({"_bucket": home + F.col("_off"), "_own": F.col("_off") == 0}).drop("_off")


def bursts(df: DataFrame, keys: tuple[str, ...], at: str, minutes: int, threshold: int, flag: str, id_col: str = "doc_id") -> DataFrame:
    """(id, flag, size, window_start, window_end, confidence): documents covered by a window of
    ``minutes`` that holds at least ``threshold`` documents of one key; the largest covering
    window counts, then the latest."""
    width = 60 * minutes * 1_000_000
    rows = _dealt(df, at, width)
    span = Window.partitionBy(*keys, "_bucket").orderBy("_us")
    rows = rows.withColumns({"_n": F.count("*").over(span.rangeBetween(-width, 0)), "_ws": F.min("_us").over(span.rangeBetween(-width, 0))})
    full = F.when(F.col("_n") >= threshold, F.struct(F.col("_n").alias("n"), F.col("_us").alias("we"), F.col("_ws").alias("ws")))
    rows = rows.withColumn("_best", F.max(full).over(span.rangeBetween(0, width))).filter("_own AND _best IS NOT NULL")
    over = (F.col("_best.n") - threshold) / F.lit(float(threshold))
    return rows.select(
        id_col, *keys, F.lit(flag).alias("flag"), F.col("_best.n").alias("size"),
        F.timestamp_micros("_best.ws").cast("timestamp_ntz").alias("window_start"), F.timestamp_micros("_best.we").cast("timestamp_ntz").alias("window_end"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 + 0.2 * over)).alias("confidence"),
    )


def bot_timing(df: DataFrame, keys: tuple[str, ...], at: str, minutes: int, threshold: int, gap_seconds: int, id_col: str = "doc_id") -> DataFrame:
    """Bursts whose documents follow each other in less than ``gap_seconds``: all in one session."""
    width, micro = 60 * minutes * 1_000_000, 1_000_000
    rows = _dealt(df, at, width)
    order = Window.partitionBy(*keys, "_bucket").orderBy("_us", id_col)
    gap = F.col("_us") - F.lag("_us").over(order)
    rows = rows.withColumn("_gap", (F.coalesce(gap, F.lit(0)) >= gap_seconds * micro).cast("int"))
    rows = rows.withColumn("_sid", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy(*keys, "_bucket").orderBy("_us")
    back, ahead = span.rangeBetween(-width, 0), span.rangeBetween(0, width)
    rows = rows.withColumns({"_n": F.count("*").over(back), "_lo": F.min("_sid").over(back), "_hi": F.max("_sid").over(back), "_ws": F.min("_us").over(back)})
    full = F.when((F.col("_n") >= max(threshold, 2)) & (F.col("_lo") == F.col("_hi")), F.struct(F.col("_n").alias("n"), F.col("_us").alias("we"), F.col("_ws").alias("ws")))
    rows = rows.withColumn("_best", F.max(full).over(ahead)).filter("_own AND _best IS NOT NULL")
    return rows.select(
        id_col, *keys, F.lit("bot_timing").alias("flag"), F.col("_best.n").alias("size"),
        F.timestamp_micros("_best.ws").cast("timestamp_ntz").alias("window_start"), F.timestamp_micros("_best.we").cast("timestamp_ntz").alias("window_end"),
        F.lit(0.95).alias("confidence"),
    )


FLAGS = ("coordinated_flood", "near_duplicate_flood", "author_burst", "bot_timing")


def detect(df: DataFrame, config: FilterConfig | None = None) -> DataFrame:
    """All flags of documents (doc_id, created_at, author_id, text_sha256, duplicate_group_id, near_duplicate_flag)."""
    c = config or FilterConfig()
    return (
        bursts(df, ("text_sha256",), "created_at", c.velocity_window_minutes, c.velocity_threshold, FLAGS[0]).drop("text_sha256")
        .unionByName(bursts(df.filter("near_duplicate_flag"), ("duplicate_group_id",), "created_at", c.velocity_window_minutes, c.near_velocity_threshold, FLAGS[1]).drop("duplicate_group_id"))
        .unionByName(bursts(df, ("author_id",), "created_at", c.author_burst_window_minutes, c.author_burst_threshold, FLAGS[2]).drop("author_id"))
        .unionByName(bot_timing(df, ("author_id",), "created_at", c.author_burst_window_minutes, c.author_burst_threshold, c.bot_gap_seconds).drop("author_id"))
    )


def apply_flags(df: DataFrame, flags: DataFrame, config: FilterConfig | None = None) -> DataFrame:
    """anomaly_flags in fixed order, anomaly_confidence; a flagged document goes to review and
    loses weight by the confidence, a dropped one stays dropped."""
    c = config or FilterConfig()
    order = F.create_map(*[x for i, f in enumerate(FLAGS) for x in (F.lit(f), F.lit(i))])
    per = flags.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct(order[F.col("flag")].alias("i"), "flag"))).alias("_flags"), F.max("confidence").alias("_confidence")
    )
    rows = with_baseline(df, c).join(per, "doc_id", "left")
    hit = F.col("_flags").isNotNull() & (F.col("filter_status") != "drop")
    return rows.withColumns({
        "anomaly_flags": F.coalesce(F.transform("_flags", lambda x: x["flag"]), F.array().cast("array<string>")),
        "anomaly_confidence": F.coalesce("_confidence", F.lit(0.0)),
        "quality_weight": F.when(hit, F.greatest(F.lit(0.0), F.col("quality_weight") * (1 - F.col("_confidence")))).otherwise(F.col("quality_weight")),
        "filter_status": F.when(hit, "review").otherwise(F.col("filter_status")),
    }).drop("_flags", "_confidence")
