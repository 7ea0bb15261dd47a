"""Shared helpers of the training-data operators.

Words are the runs of ``[^\\x20\\x09-\\x0D]+`` of a text; on UTF-8 bytes these are
what ``bytes.split()`` returns, since it splits on the same six characters.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

ROW_GROUP_BYTES = 16 << 20
ARROW_ROWS = 1000

_written: list[tuple[SparkSession, str]] = []


class Remembered(dict):
    """What ``make`` gives for a key. About ``limit`` bytes are held, in two generations: what is
    asked for again outlives what is not. A task makes its own, so that it ends with the task."""

    def __init__(self, make: Callable, limit: int = 16 << 20, each: int = 200, longest: int = 200):
        self._make, self._half, self._each, self._longest = make, limit // 2, each, longest
        self._older: dict = {}
        self._room = self._half

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= self._longest:
            if self._room <= 0:
                self._older, self._room = dict(self), self._half
                self.clear()
            self._room -= len(key) + self._each
            self[key] = value
        return value


def word_hashes() -> Remembered:
    import xxhash

    return Remembered(xxhash.xxh3_64_intdigest)


def small_batches(df: DataFrame) -> DataFrame:
    """Rows that hold whole texts go to Python ``ARROW_ROWS`` at a time: Spark's default of 10,000 makes
    batches of long texts large. A session that has set its own number keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(ARROW_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where
    the session has none (tests), a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def store(df: DataFrame, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends there, so a lost
    executor costs a reread, and what is read twice is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    out = df.write.option("parquet.block.size", ROW_GROUP_BYTES)  # a writing task holds one row group
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            return


atexit.register(_remove)


def n_words(text) -> F.Column:
    """Word count of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text) -> F.Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is heavy if it holds more than one in ``HEAVY`` of all rows, so at most ``HEAVY`` keys are.
HEAVY, HEAVY_SALTS = 10_000, 16


def join_salted(rows: DataFrame, unique: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """``rows`` joined by ``key`` (no null matches) with ``unique``, which has one row a key and in ``count``
    how many of all rows hold it. Rows of heavy keys are dealt by a hash of ``spread`` to salts, to each of
    which their one partner is copied. Only the list of heavy keys, ``HEAVY`` at most, is broadcast."""
    total = unique.agg(F.sum(count)).head()[0] or 0
    is_heavy = F.col(count) * HEAVY > total
    heavy = unique.filter(is_heavy).select(key, F.lit(True).alias("_heavy"))
    dealt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(HEAVY_SALTS))).otherwise(0).cast("int")
    left = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", dealt).drop("_heavy")
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(HEAVY_SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(unique.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt")


def without(docs: DataFrame, gone: DataFrame, id_col: str, content, content_col: str) -> DataFrame:
    """The rows of ``docs`` whose id (null included) and ``content``, a binary expression over them, are
    not together a row of ``gone``, which holds the latter in ``content_col``: an id may stand for several texts."""
    own, name, other = fresh(docs, "_content"), fresh(docs, "_gone"), fresh(docs, "_gone_content")
    told = docs.withColumn(own, content)
    both = gone.select(F.col(id_col).cast("long").alias(name), F.col(content_col).alias(other))
    return told.join(both, told[id_col].cast("long").eqNullSafe(F.col(name)) & (F.col(own) == F.col(other)), "left_anti").drop(own)


def stays(docs: DataFrame, verdicts: DataFrame, id_col: str, content, content_col: str) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (id, ``content_col``, kept; a row for each of ``docs``) keeps. Rows that
    repeat an id and content are one document: the first by all its columns stays."""
    verdicts = store(verdicts.select(F.col(id_col), content_col, "kept"))
    rest = without(docs, verdicts.filter("not kept"), id_col, content, content_col)
    again = verdicts.filter("kept").groupBy(id_col, content_col).agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return rest
    own, place = fresh(docs, "_content"), fresh(docs, "_place")
    same = rest.withColumn(own, content)
    other = again.select(F.col(id_col).alias(fresh(docs, "_again")), F.col(content_col).alias(fresh(docs, "_again_content")))
    match = same[id_col].cast("long").eqNullSafe(other[0]) & (same[own] == other[1])
    order = Window.partitionBy(F.col(id_col).cast("long"), own).orderBy(*[F.col(f"`{c}`").cast("string").asc_nulls_last() for c in docs.columns])
    first = same.join(other, match, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return without(rest, again, id_col, content, content_col).unionByName(first.drop(own, place))
