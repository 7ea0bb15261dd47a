"""Raw messages from a stream into a table, with dead letters beside it.

A micro-batch goes to two sinks under one id: letters to their own directory ``batch_id=<id>``, which is replaced when the batch
runs again, and messages to an upsert table by (source_type, source_id), where running again changes
nothing. So a batch that fails between the two and is repeated has no row twice in either.

A message that is no valid raw message is a ``validation_error``; one that the step ``accept`` refuses, or that a
later job could not take, is a ``processing_error``. Letters keep the message as it came, where it stood and how often it
was tried; ``retry_job`` reads them as a stream and takes in what has become acceptable. After
``ATTEMPTS`` tries a letter is final and stays in the letters of the last try.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import _cut
from tidemark.sources import files, tables

KEY, ORDER = ("source_type", "source_id"), ("collected_at",)
ATTEMPTS = 3
LETTER = "error string, message string, kind string, original_partition string, original_offset long, attempt int, failed_at timestamp"


def sorted_out(messages: DataFrame, accept: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good messages, letters) of messages (value and, if known, original_partition, original_offset, attempt). ``accept``
    adds a column ``refused``: why a valid message cannot be taken, null where it can."""
    known = set(messages.columns)
    extra = {
        "original_partition": F.col("original_partition").cast("string") if "original_partition" in known else F.lit(None).cast("string"),
        "original_offset": F.col("original_offset").cast("long") if "original_offset" in known else F.lit(None).cast("long"),
        "attempt": F.col("attempt").cast("int") if "attempt" in known else F.lit(0),
    }
    place = F.struct(*[c.alias(n) for n, c in extra.items()])
    rows = files.judged(messages.select(F.col("value").alias("_v"), place.alias("_place")), "_v")
    bad = rows.filter("_e IS NOT NULL").select(F.col("_e").alias("error"), F.col("_v").alias("message"), F.lit("validation_error").alias("kind"), "_place.*")
    good = files.fields_of(rows.filter("_e IS NULL"), "_v", "_place")
    if accept is not None:
        good = accept(good)
        refused = good.filter("refused IS NOT NULL").select(F.col("refused").alias("error"), F.col("_v").alias("message"), F.lit("processing_error").alias("kind"), "_place.*")
        bad, good = bad.unionByName(refused), good.filter("refused IS NULL").drop("refused")
    return good.drop("_v", "_place"), bad.withColumns({"attempt": F.col("attempt") + 1, "failed_at": F.current_timestamp()})


def take(messages: DataFrame, batch_id: int, path: str, letters: str, accept: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One micro-batch. Letters are written first: if the batch ends there, it is repeated with both sinks."""
    good, bad = sorted_out(_cut(messages), accept)
    bad.write.mode("overwrite").parquet(f"{letters}/batch_id={batch_id}")
    tables.upsert(good, path, KEY, ORDER)


def consume_job(stream: DataFrame, path: str, letters: str, checkpoint: str, accept: Callable[[DataFrame], DataFrame] | None = None):
    """``stream``: value (JSON text) and, if known, original_partition and original_offset."""
    run = lambda batch, batch_id: take(batch, batch_id, path, letters, accept)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def letter_stream(spark: SparkSession, letters: str) -> DataFrame:
    """Letters that may be tried again, as messages."""
    rows = spark.readStream.schema(f"{LETTER}, batch_id long").parquet(letters)
    return rows.filter(F.col("attempt") < ATTEMPTS).select(F.col("message").alias("value"), "original_partition", "original_offset", "attempt")


def retry_job(spark: SparkSession, letters: str, path: str, still: str, checkpoint: str, accept: Callable[[DataFrame], DataFrame] | None = None):
    """Try the letters again; what fails once more is written to ``still``."""
    return consume_job(letter_stream(spark, letters), path, still, checkpoint, accept)
