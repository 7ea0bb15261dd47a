"""Descriptions of topics as a job: which topics need one, asking with feedback, and a log of every attempt.

``due`` keeps the changed topics that are no noise and have no description or one that is no longer
good (``summarize.needs_new``). A model is asked for each of them with its representative documents; an answer that breaks a rule is
asked for again with that rule named, at most ``retries`` times. Where the first model times out or refuses,
the second is asked. What was asked is written before anything is read from it, so no topic is asked twice because a plan is run
twice. Two tables come of it: one description a topic and one cost row an attempt; a topic whose last answer
still breaks a rule is kept for review.

A topic's documents are bounded by the selection (``SummaryConfig.max_documents``), so a task holds one small group at a time.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import SummaryConfig
from tidemark.operators import summarize
from tidemark.operators.dedup import _cut
from tidemark.operators.ranking import ntz

ASKED = (
    "cluster_id {kind}, attempts array<struct<attempt_number:int,model_name:string,input_token_count:long,output_token_count:long,generation_time_ms:long,fallback_used:boolean,validation_error:string>>, "
    "summary string, key_phrases array<string>, sample_doc_ids array<{doc}>"
)


@dataclass(frozen=True)
class Answer:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    model_name: str = "stand-in"


#: client(system, user) -> Answer; raises TimeoutError, ConnectionError or Refused where another model should be asked.
Client = Callable[[str, str], Answer]


class Refused(Exception):
    """A model's service does not answer this request now."""


def extractive_client(system: str, user: str) -> Answer:
    """A deterministic stand-in: the documents of the prompt are its lines that start with a number."""
    texts = [line.split(". ", 1)[1] for line in user.splitlines() if line[:1].isdigit() and ". " in line]
    text = summarize.extractive_answer(texts)
    return Answer(text, len(user) // 4, len(text) // 4, "extractive")


def ask(first: Client, second: Client | None, system: str, user: str) -> tuple[Answer, bool]:
    """(answer, whether the second model gave it)."""
    try:
        return first(system, user), False
    except (TimeoutError, ConnectionError, Refused):
        if second is None:
            raise
        return second(system, user), True


def due(clusters: DataFrame, described: DataFrame, changed: DataFrame, version: str, now: dt.datetime, config: SummaryConfig | None = None) -> DataFrame:
    """``clusters`` (cluster_id, noise, size, growth_rate) named in ``changed`` that are no noise, with ``regenerate``: whether
    ``described`` (cluster_id, prompt_version, size_then, generated_at) has no row of them or one to be replaced."""
    old = described.select("cluster_id", "prompt_version", "size_then", "generated_at")
    rows = clusters.filter("NOT noise").join(changed.select("cluster_id").distinct(), "cluster_id", "left_semi").join(old, "cluster_id", "left").withColumn("current_version", F.lit(version))
    again = F.col("prompt_version").isNull() | summarize.needs_new(rows, ntz(now), config)
    return rows.withColumn("regenerate", F.coalesce(again, F.lit(True))).drop("prompt_version", "size_then", "generated_at", "current_version")


def _asking(system: str, template: str, clients: tuple[Client, Client | None], c: SummaryConfig):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("position")
        texts = pdf["prompt_text"].tolist()
        one = pdf.iloc[0]
        values = {k: one[k] for k in ("size", "period_start", "period_end", "source_types", "geo_regions")} | {"texts": "\n".join(f"{i}. {t}" for i, t in enumerate(texts, 1))}
        attempts, reason, summary, phrases = [], None, "", []
        for n in range(1, c.retries + 2):
            began = time.monotonic()
            answer, fell_back = ask(*clients, system, summarize.render(template, values, reason))
            summary, phrases = summarize.parse_answer(answer.text, c.max_words)
            reason = summarize.broken_rule(summary, phrases, texts, c)
            attempts.append({
                "attempt_number": n, "model_name": answer.model_name, "input_token_count": answer.input_tokens, "output_token_count": answer.output_tokens, "generation_time_ms": int(1000 * (time.monotonic() - began)),
                "fallback_used": fell_back, "validation_error": reason,
            })
            if reason is None:
                break
        return pd.DataFrame([{"cluster_id": one["cluster_id"], "attempts": attempts, "summary": summary, "key_phrases": phrases, "sample_doc_ids": pdf["doc_id"].tolist()[: c.sample_documents]}])

    return run


def describe(clusters: DataFrame, members: DataFrame, described: DataFrame, changed: DataFrame, prompt: str, now: dt.datetime, clients: tuple[Client, Client | None] = (extractive_client, None), config: SummaryConfig | None = None, *, price_in: float = 0.0, price_out: float = 0.0) -> dict[str, DataFrame]:
    """``descriptions``, ``costs`` (a row an attempt), ``metrics`` (one row) and ``updated`` (ids of the event).

    ``clusters``: cluster_id, noise, size, growth_rate, period_start, period_end, geo_regions. ``members``: as for
    ``summarize.representatives``, with source_type. ``prompt``: a file with sections ``system`` and ``user``. A topic without documents is left out."""
    c = config or SummaryConfig()
    parts, version = summarize.sections(prompt, ("system", "user")), summarize.prompt_version(prompt)
    judged = _cut(due(clusters, described, changed, version, now, c))
    wanted = judged.filter("regenerate")
    own = members.join(wanted.select("cluster_id"), "cluster_id", "left_semi")
    types = own.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("source_type")), ", ").alias("source_types"))
    when = lambda col: F.date_format(col, "dd.MM.yyyy HH:mm").alias(col)
    regions = F.when(F.size("geo_regions") > 0, F.array_join("geo_regions", ", ")).otherwise("не определён").alias("geo_regions")
    about = wanted.select("cluster_id", "size", when("period_start"), when("period_end"), regions).join(types, "cluster_id")
    chosen = summarize.representatives(own, c).select("cluster_id", "doc_id", "position", "prompt_text").join(about, "cluster_id")
    kinds = dict(chosen.dtypes)
    asked = chosen.groupBy("cluster_id").applyInPandas(_asking(parts["system"], parts["user"], clients, c), ASKED.format(kind=kinds["cluster_id"], doc=kinds["doc_id"]))
    asked = _cut(asked.join(wanted.select("cluster_id", "size"), "cluster_id"))
    last = F.element_at("attempts", -1)
    descriptions = asked.select(
        "cluster_id", "summary", "key_phrases", "sample_doc_ids", last["model_name"].alias("model_name"), F.lit(version).alias("prompt_version"), ntz(now).alias("generated_at"),
        last["input_token_count"].alias("input_token_count"), last["output_token_count"].alias("output_token_count"),
        F.aggregate(F.transform("attempts", lambda a: a["generation_time_ms"]), F.lit(0).cast("long"), lambda s, x: s + x).alias("generation_time_ms"),
        F.exists("attempts", lambda a: a["fallback_used"]).alias("fallback_used"), last["validation_error"].isNotNull().alias("needs_review"), F.col("size").alias("size_then"),
    )
    costs = asked.select("cluster_id", F.explode("attempts").alias("a")).select("cluster_id", "a.*", F.lit(version).alias("prompt_version"), ntz(now).alias("requested_at"))
    costs = costs.withColumn("estimated_cost_usd", summarize.cost(F.col("input_token_count"), F.col("output_token_count"), price_in, price_out))
    spent = costs.groupBy("cluster_id").agg(F.sum("input_token_count").alias("input_tokens"), F.sum("output_token_count").alias("output_tokens"), F.sum("estimated_cost_usd").alias("cost_usd"))
    runs = judged.select("cluster_id", "regenerate").join(descriptions.select("cluster_id", "fallback_used", F.col("needs_review").alias("invalid"), "generation_time_ms"), "cluster_id", "left").join(spent, "cluster_id", "left")
    runs = runs.filter("NOT regenerate OR invalid IS NOT NULL").withColumn("regenerated", F.col("regenerate"))
    return {"descriptions": descriptions, "costs": costs, "metrics": summarize.run_metrics(runs), "updated": descriptions.select("cluster_id")}
