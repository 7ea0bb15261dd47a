"""Topics as jobs: a full recompute that becomes visible at once, and assignment of what comes after it.

A full run writes its tables as one generation (``tables.Generations``): assignments, clusters, metrics, the density model and
which cluster each of its labels is. A run that is killed leaves the generation before it. Between full runs
a stream assigns documents: those after the end of the run's window that are neither assigned nor buffered yet are predicted by
the model's densities; strong ones join a topic, the rest waits in the buffer. The topics that got documents are counted
anew from all their documents, and one event names them. Everything a micro-batch writes lies under the generation
and the batch's id, so running it again replaces it, and a new generation starts with an empty buffer.

``documents`` gives the table of all documents, as ``cluster.enrich`` wants them, with embedding.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ClusterConfig
from tidemark.operators import cluster
from tidemark.operators.dedup import _cut
from tidemark.operators.ranking import ntz
from tidemark.sources.tables import Generations, read_or_none


class Topics:
    def __init__(self, spark: SparkSession, path: str, documents: Callable[[], DataFrame], config: ClusterConfig | None = None):
        self.spark, self.documents, self.config = spark, documents, config or ClusterConfig()
        self.runs = Generations(spark, path)

    def _online(self, run: str, name: str, batch_id: int | None = None) -> DataFrame | None:
        """What micro-batches before ``batch_id`` (None: all) wrote under a run."""
        rows = read_or_none(self.spark, f"{self.runs.path}/runs/{run}/online/{name}")
        return rows if rows is None or batch_id is None else rows.filter(F.col("batch_id") < batch_id)

    def _both(self, run: str, name: str, batch_id: int | None = None) -> DataFrame:
        """A table of the run and what micro-batches added to it; the run's own rows have batch -1."""
        own = self.spark.read.parquet(f"{self.runs.path}/runs/{run}/{name}").withColumn("batch_id", F.lit(-1).cast("long"))
        added = self._online(run, name, batch_id)
        return own if added is None else own.unionByName(added.withColumn("batch_id", F.col("batch_id").cast("long")))

    def assignments(self, batch_id: int | None = None) -> DataFrame | None:
        now = self.runs.current()
        return None if now is None else self._both(now["run"], "assignments", batch_id).drop("batch_id")

    def clusters(self, batch_id: int | None = None) -> DataFrame | None:
        """The newest row of each topic."""
        now = self.runs.current()
        if now is None:
            return None
        rows = self._both(now["run"], "clusters", batch_id)
        whole = F.struct(*[c for c in rows.columns if c != "batch_id"])
        return rows.groupBy("cluster_id").agg(F.max_by(whole, "batch_id").alias("_c")).select("_c.*")

    def buffer(self, batch_id: int | None = None) -> DataFrame | None:
        now = self.runs.current()
        return None if now is None else self._online(now["run"], "buffer", batch_id)

    def recompute(self, now: dt.datetime, *, hours: int | None = None) -> dict:
        """A full run over the last ``hours``. The topics keep their ids where the ones before are alike, online updates included."""
        hours = hours or self.config.window_hours
        before = self.clusters()
        old = self.spark.createDataFrame([], "cluster_id long, centroid array<double>") if before is None else before.filter("NOT noise").select("cluster_id", "centroid")
        docs = self.documents()
        out = cluster.recompute(docs, old, now, self.config, hours=hours)
        changed = out["changed"]
        event = changed.agg(F.array_sort(F.collect_list("cluster_id")).alias("changed_cluster_ids")).select(
            ntz(now).alias("run_at"), ntz(now - dt.timedelta(hours=hours)).alias("period_start"), ntz(now).alias("period_end"), "changed_cluster_ids"
        )  # ids of topics, not of documents
        tables = {
            "assignments": out["assignments"].select("doc_id", "cluster_id", F.lit(1.0).alias("strength"), ntz(now).alias("assigned_at")),
            "clusters": out["clusters"], "metrics": out["metrics"], "ids": out["ids"], "events": event,
            "model": out["model"].join(docs.select("doc_id", "embedding"), "doc_id"),
        }
        return self.runs.write(tables, {"period_start": (now - dt.timedelta(hours=hours)).isoformat(), "period_end": now.isoformat(), "created_at": now.isoformat()})

    def assign(self, batch: DataFrame, batch_id: int, now: dt.datetime | None = None) -> None:
        """One micro-batch of documents (doc_id, created_at, embedding). ``now``: by default the latest time in the batch."""
        run = self.runs.current()
        if run is None:
            return
        name, end = run["run"], dt.datetime.fromisoformat(run["period_end"])
        model, ids = self.runs.table("model"), self.runs.table("ids")
        if ids is None or ids.isEmpty():  # a run without topics has nothing to assign to
            return
        waiting = self.buffer(batch_id)
        waiting = batch.select("doc_id").limit(0) if waiting is None else waiting
        fresh = _cut(cluster.unassigned(batch, self.assignments(batch_id), waiting, ntz(end)).select("doc_id", "created_at", "embedding"))
        if fresh.isEmpty():
            return
        at = ntz(now or fresh.agg(F.max("created_at")).head()[0])
        judged = _cut(cluster.predict(fresh, model, self.config).join(ids, "label", "left"))
        joined = _cut(judged.filter("assigned AND cluster_id IS NOT NULL").select("doc_id", "cluster_id", "strength", at.alias("assigned_at")))
        waits = judged.join(joined.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("strength").alias("last_strength"), at.alias("buffered_at"))
        out = f"{self.runs.path}/runs/{name}/online"
        joined.write.mode("overwrite").parquet(f"{out}/assignments/batch_id={batch_id}")
        waits.write.mode("overwrite").parquet(f"{out}/buffer/batch_id={batch_id}")
        touched = joined.select("cluster_id").distinct()
        if touched.isEmpty():
            return
        known = self._both(name, "assignments", batch_id).select("doc_id", "cluster_id").join(touched, "cluster_id", "left_semi").unionByName(joined.select("doc_id", "cluster_id"))
        moment = now or fresh.agg(F.max("created_at")).head()[0]
        out_of = cluster.rebuild(self.documents().drop("cluster_id").join(known, "doc_id"), moment, self.config)
        out_of["clusters"].write.mode("overwrite").parquet(f"{out}/clusters/batch_id={batch_id}")
        event = out_of["changed"].agg(F.array_sort(F.collect_list("cluster_id")).alias("changed_cluster_ids")).select(
            at.alias("run_at"), ntz(dt.datetime.fromisoformat(run["period_start"])).alias("period_start"), at.alias("period_end"), "changed_cluster_ids"
        )
        event.write.mode("overwrite").parquet(f"{out}/events/batch_id={batch_id}")

    def events(self) -> DataFrame | None:
        """The events of the generation: its own and one for each micro-batch that changed topics."""
        now = self.runs.current()
        return None if now is None else self._both(now["run"], "events")

    def assign_job(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(lambda batch, batch_id: self.assign(batch, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
