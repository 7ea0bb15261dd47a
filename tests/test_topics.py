"""Topic jobs: full runs that switch at once, assignment in micro-batches, buffer, events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import ClusterConfig
from tidemark.operators import cluster
from tidemark.streaming import jobs
from tidemark.streaming.topics import Topics

START = dt.datetime(2024, 1, 1)
END = START + dt.timedelta(hours=72)
SCHEMA = "doc_id long, created_at timestamp_ntz, embedding array<double>, author_id string, source_type string, reach long, region string"
CONFIG = ClusterConfig(assignment_threshold=0.3)


def docs(n_old=90, n_new=60):
    """Three blobs and noise; later documents near the blobs and away from them."""
    r, out = random.Random(3), []
    centres = [[1, 0, 0, 0.2], [0, 1, 0, 0.2], [0, 0, 1, 0.2]]
    for i in range(n_old + n_new):
        late = i >= n_old
        if i % 10 == 9:
            v = [r.uniform(-1, 1) for _ in range(4)]
        else:
            v = [x + r.gauss(0, 0.02) for x in centres[i % 3]]
        at = (END if late else START) + dt.timedelta(minutes=(i - n_old if late else 40 * i) + 1)
        out.append((i, at, v, f"a{i % 7}", "vk_post" if i % 2 else "rss", i, None if i % 5 else "R"))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(docs(), SCHEMA).repartition(2).cache()


def groups(rows):
    """Assignments without the names of the topics."""
    by = {}
    for r in rows:
        by.setdefault(r.cluster_id, set()).add(r.doc_id)
    return sorted(sorted(v) for k, v in by.items() if k >= 0), sorted(by.get(-1, ()))


def test_jobs_in_three_batches_then_recompute(spark, table, tmp_path):
    topics = Topics(spark, f"{tmp_path}/t", lambda: table, CONFIG)
    late = table.filter("doc_id >= 90")
    topics.assign(late, 0)  # no run yet: nothing to do
    assert topics.assignments() is None
    topics.recompute(END)
    first = topics.runs.current()
    assert topics.clusters().filter("NOT noise").count() == 3 and topics.events().count() == 1
    # three micro-batches, the second twice, with documents of the run's own window among them
    whole = Topics(spark, f"{tmp_path}/one", lambda: table, CONFIG)
    whole.recompute(END)
    late.unionByName(table.filter("doc_id < 5")).withColumn("part", F.col("doc_id") % 3).write.partitionBy("part").parquet(f"{tmp_path}/in")
    for part in range(3):
        batch = spark.read.parquet(f"{tmp_path}/in").filter(F.col("part") == part).drop("part")
        topics.assign(batch, part)
        if part == 1:
            topics.assign(batch, part)
    model = first["run"]
    assert topics.runs.current()["run"] == model
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema).drop("part")
    for _ in range(2):
        whole.assign_job(stream, f"{tmp_path}/check").awaitTermination(120)
    cut, one = topics.assignments(), whole.assignments()
    assert groups(cut.collect()) == groups(one.collect())
    assert {r.doc_id for r in topics.buffer().collect()} == {r.doc_id for r in whole.buffer().collect()}
    both = [*cut.filter("doc_id >= 90").collect(), *topics.buffer().collect()]
    assert sorted(r.doc_id for r in both) == list(range(90, 150))  # each once, and none of the run's window
    assert {r.doc_id for r in topics.buffer().collect()} <= {i for i in range(150) if i % 10 == 9} and topics.buffer().count() >= 3
    # the topics' counts are those of all their documents
    sizes = {r.cluster_id: r["n"] for r in cut.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert {r.cluster_id: r["size"] for r in topics.clusters().filter("NOT noise").collect()} == {k: n for k, n in sizes.items() if k >= 0}
    assert topics.events().count() == 4 and all(r.changed_cluster_ids == sorted(r.changed_cluster_ids) and r.changed_cluster_ids for r in topics.events().collect())
    # a full run after the batches equals one full run
    now = END + dt.timedelta(hours=2)
    for t in (topics, whole):
        t.recompute(now)
    assert groups(topics.assignments().collect()) == groups(whole.assignments().collect())
    kept = {r.cluster_id for r in topics.clusters().filter("NOT noise").collect()}
    assert kept == {0, 1, 2} and topics.runs.current()["number"] == 2 and topics.buffer() is None
    cols = ["cluster_id", "size", "unique_authors", "reach_total", "growth_rate"]
    assert sorted(map(tuple, topics.clusters().select(*cols).collect())) == sorted(map(tuple, whole.clusters().select(*cols).collect()))


def test_killed_run_leaves_the_generation_before(spark, table, tmp_path):
    topics = Topics(spark, f"{tmp_path}/t", lambda: table, CONFIG)
    topics.recompute(END)
    before = topics.runs.current()
    real = cluster.rebuild

    def dies(*args, **kwargs):
        out = real(*args, **kwargs)
        return out | {"metrics": out["metrics"].withColumn("n_documents", F.when(F.lit(True), F.raise_error(F.lit("killed"))).otherwise(F.col("n_documents")))}

    cluster.rebuild = dies
    try:
        with pytest.raises(Exception, match="killed"):
            topics.recompute(END + dt.timedelta(hours=1))
    finally:
        cluster.rebuild = real
    assert topics.runs.current() == before and topics.assignments().count() == 90


def test_run_without_topics(spark, table, tmp_path):
    """Too few documents for a topic: all noise, and nothing is assigned until a later run finds topics."""
    few = table.filter("doc_id < 5 OR doc_id >= 90")
    topics = Topics(spark, f"{tmp_path}/t", lambda: few, CONFIG)
    topics.recompute(END)
    assert topics.clusters().filter("NOT noise").count() == 0
    topics.assign(few, 0)
    assert topics.buffer() is None and topics.assignments().filter("cluster_id >= 0").count() == 0
    topics.recompute(END + dt.timedelta(hours=2))
    assert topics.clusters().filter("NOT noise").count() == 3
