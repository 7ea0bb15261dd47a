"""Encoding as a job: windows of tokens, vectors from a cache or a model, and a spool for what could not be saved.

A document's text is prepared, cut into token windows, each window encoded, and the mean of its windows is its vector. A window whose
text the same model has seen is not encoded again: a cache table, dealt to buckets by (model, version, digest), holds
what it gave. Documents that cannot be encoded (no text) are letters.

Saving may fail while the stream must go on. Then the encoded rows of the micro-batch go to the spool, a log by
batch, and ``replay`` saves them later: the oldest first, at most ``limit`` rows, the newest row of a document. Only when the
save has returned are they acknowledged, in a second log; a replay that dies in between repeats its rows, and saving is an upsert.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import text, vectors
from tidemark.operators.dedup import _cut
from tidemark.operators.ranking import ntz
from tidemark.sources import tables

CACHE_KEY = ("model_name", "model_version", "text_sha256")


@dataclass(frozen=True)
class Model:
    name: str
    version: str
    dimension: int
    backend: Callable[[list[str]], list[list[float]]]
    window: int = 512
    overlap: int = 64


def encoded(docs: DataFrame, model: Model, cache: str | None = None, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, letters) of documents (doc_id, normalized_text, source_type). ``cache``: a table that is read and added to."""
    spark = docs.sparkSession
    has = F.trim(F.coalesce("normalized_text", F.lit(""))) != ""
    letters = docs.filter(~has).select("doc_id", F.lit("no text to encode").alias("error"))
    ready = docs.filter(has).withColumn("text_used", text.passage(F.col("normalized_text"), F.col("source_type"), emoji=True)).dropDuplicates(["doc_id"])
    windows = _cut(text.chunk_windows(ready, "text_used", model.window, model.overlap).withColumn("text_sha256", F.sha2("chunk_text", 256)))
    wanted = windows.groupBy("text_sha256").agg(F.first("chunk_text").alias("chunk_text")).withColumns({"model_name": F.lit(model.name), "model_version": F.lit(model.version)})
    known = tables.rows_of(spark, cache, wanted, CACHE_KEY) if cache else None
    known = None if known is None else _cut(known.select("text_sha256", "embedding"))
    new = wanted if known is None else wanted.join(known.select("text_sha256"), "text_sha256", "left_anti")
    made = _cut(vectors.encode(new, model.backend, model.dimension, "text_sha256", "chunk_text"))
    if cache:
        tables.upsert(made.select(F.lit(model.name).alias("model_name"), F.lit(model.version).alias("model_version"), "text_sha256", "embedding"), cache, CACHE_KEY, ("text_sha256",))
    every = made if known is None else made.unionByName(known)
    pooled = vectors.pool_chunks(windows.join(every, "text_sha256").select("doc_id", "embedding"), "doc_id")
    counts = windows.groupBy("doc_id").agg(F.max(F.col("start") + F.col("n_tokens")).cast("int").alias("token_count"), (F.count("*") > 1).alias("truncated"))
    at = F.current_timestamp().cast("timestamp_ntz") if now is None else ntz(now)
    rows = ready.drop("token_count").join(pooled, "doc_id").join(counts, "doc_id")
    return rows.withColumns({"model_name": F.lit(model.name), "model_version": F.lit(model.version), "embedded_at": at}), letters


class Spool:
    """Rows that wait to be saved, by micro-batch, and what has been saved of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch_id}")

    def waiting(self) -> DataFrame | None:
        """The newest row of each document that is not acknowledged, with the batch that brought it."""
        rows = tables.read_or_none(self.spark, f"{self.path}/rows")
        if rows is None:
            return None
        whole = F.struct(*rows.columns)
        rows = rows.groupBy("doc_id").agg(F.max_by(whole, "batch_id").alias("_r"), F.min("batch_id").alias("first_batch")).select("_r.*", "first_batch")
        done = tables.read_or_none(self.spark, f"{self.path}/done")
        if done is None:
            return rows
        done = done.groupBy("doc_id").agg(F.max("saved_batch").alias("saved_batch"))
        return rows.join(done, "doc_id", "left").filter("saved_batch IS NULL OR saved_batch < batch_id").drop("saved_batch")

    def peek(self, limit: int = 100) -> DataFrame | None:
        """The oldest ``limit`` rows: by the batch that first brought the document, then by id."""
        rows = self.waiting()
        return None if rows is None else rows.orderBy("first_batch", "doc_id").limit(limit)

    def acknowledge(self, rows: DataFrame) -> None:
        rows.select("doc_id", F.col("batch_id").alias("saved_batch")).write.mode("append").parquet(f"{self.path}/done")

    def size(self) -> int:
        rows = self.waiting()
        return 0 if rows is None else rows.count()

    def replay(self, save: Callable[[DataFrame], None], limit: int = 100) -> int:
        """Save the oldest rows and acknowledge them after that; returns how many. Fails as ``save`` fails, and then acknowledges none."""
        rows = self.peek(limit)
        if rows is None:
            return 0
        rows = _cut(rows)
        save(rows.drop("batch_id", "first_batch"))
        self.acknowledge(rows)
        return rows.count()


def encode_batch(docs: DataFrame, batch_id: int, model: Model, save: Callable[[DataFrame], None], spool: Spool, letters: str, *, cache: str | None = None, publish: Callable[[DataFrame, int], None] | None = None, now: dt.datetime | None = None) -> bool:
    """One micro-batch: encode, save or spool, then publish. Returns whether it was saved."""
    rows, bad = encoded(docs, model, cache, now)
    rows = _cut(rows)
    bad.write.mode("overwrite").parquet(f"{letters}/batch_id={batch_id}")
    saved = True
    try:
        save(rows)
    except Exception:  # an outage of the table, whatever it is: nothing is lost, and the stream goes on
        spool.add(rows, batch_id)
        saved = False
    if publish is not None:
        publish(rows, batch_id)
    return saved


def encode_job(stream: DataFrame, checkpoint: str, model: Model, save: Callable[[DataFrame], None], spool: Spool, letters: str, **options):
    run = lambda batch, batch_id: encode_batch(batch, batch_id, model, save, spool, letters, **options)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
