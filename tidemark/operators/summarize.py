"""Summaries: what a model reads, what its answer must look like, when it is asked again."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import SummaryConfig
from tidemark.operators.filtering import collapsed
from tidemark.operators.text import casefold

# Words a description must not have.
FORBIDDEN_WORDS = ("жалоба", "жалобы", "скандал", "катастрофа", "ужас", "беда", "виноват", "халтура", "проблема")

_label = re.compile(r"^\s*(описание|фразы)\s*:\s*(.*)$", re.I)
_sentence = re.compile(r"(?<=[.!?])\s+")
_word = re.compile(r"\w+")


def parse_answer(text: str | None, max_words: int = 120, max_sentences: int = 3) -> tuple[str, list[str]]:
    """(summary, phrases) of an answer whose lines are sections with continuations."""
    whole = (text or "").strip()
    if not whole:
        return "", []
    parts: dict[str, list[str]] = {"summary": [], "phrases": []}
    section = None
    for line in filter(None, map(str.strip, whole.splitlines())):
        if m := _label.match(line):
            section = "summary" if m[1].casefold() == "описание" else "phrases"
            line = m[2].strip()
        if section and line:
            parts[section].append(line)
    summary = " ".join(parts["summary"]) or next((p.strip() for p in whole.split("\n\n") if p.strip()), whole[:300].strip())
    phrases: dict[str, str] = {}
    for p in " ".join(parts["phrases"]).split(";"):
        p = " ".join(p.split()).strip(" -\t")
        if p:
            phrases.setdefault(p.casefold(), p)
    summary = " ".join(summary.split())
    sentences = [s.strip() for s in _sentence.split(summary) if s.strip()]
    if len(sentences) > max_sentences:
        summary = " ".join(sentences[:max_sentences])
    words = _word.findall(summary)
    if len(words) > max_words:
        summary = " ".join(words[:max_words])
    if summary and summary[-1] not in ".!?":
        summary += "."
    return summary, list(phrases.values())


@F.pandas_udf(T.StructType([T.StructField("summary", T.StringType()), T.StructField("key_phrases", T.ArrayType(T.StringType()))]))
def parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_answer(t) for t in texts], columns=["summary", "key_phrases"])


def validate(df: DataFrame, config: SummaryConfig | None = None) -> DataFrame:
    """Adds ``invalid_reason`` (null when valid) to rows of summary, key_phrases, documents (array of texts)."""
    c = config or SummaryConfig()
    words = F.transform(F.regexp_extract_all(F.col("summary"), F.lit(r"(?U)(\w+)"), F.lit(1)), casefold)
    bad = F.array_sort(F.array_intersect(words, F.array(*map(F.lit, FORBIDDEN_WORDS))))
    phrases = F.transform("key_phrases", lambda p: collapsed(casefold(p)))
    texts = F.transform("documents", lambda t: collapsed(casefold(t)))
    missing = F.filter(F.col("key_phrases"), lambda p: ~F.exists(texts, lambda t: F.contains(t, collapsed(casefold(p)))))
    reason = (
        F.when(F.trim("summary") == "", "описание отсутствует")
        .when(F.size(words) < c.min_words, "описание слишком короткое")
        .when(F.size(words) > c.max_words, "описание слишком длинное")
        .when(F.size(bad) > 0, F.concat(F.lit("запрещённые слова: "), F.array_join(bad, ", ")))
        .when(~F.size("key_phrases").between(c.min_phrases, c.max_phrases), "нужно 5-7 ключевых фраз")
        .when(F.size(F.array_distinct(phrases)) < F.size(phrases), "ключевые фразы повторяются")
        .when(F.exists(phrases, lambda p: p == ""), "обнаружена пустая ключевая фраза")
        .when(F.size(missing) > 0, F.concat(F.lit("ключевая фраза не найдена в текстах: "), F.get(missing, F.lit(0))))
    )
    return df.withColumn("invalid_reason", reason)


def broken_rule(summary: str, phrases: list[str], texts: list[str], config: SummaryConfig | None = None) -> str | None:
    """``validate`` for one answer, where a task asks again with the reason."""
    c = config or SummaryConfig()
    plain = lambda t: " ".join((t or "").casefold().split())
    words, own = [w.casefold() for w in _word.findall(summary)], [plain(p) for p in phrases]
    bad, sources = sorted(set(words) & set(FORBIDDEN_WORDS)), [plain(t) for t in texts]
    missing = [p for p, q in zip(phrases, own, strict=True) if not any(q in t for t in sources)]
    rules = (
        (not summary.strip(), "описание отсутствует"), (len(words) < c.min_words, "описание слишком короткое"), (len(words) > c.max_words, "описание слишком длинное"),
        (bool(bad), f"запрещённые слова: {', '.join(bad)}"), (not c.min_phrases <= len(phrases) <= c.max_phrases, "нужно 5-7 ключевых фраз"), (len(set(own)) < len(own), "ключевые фразы повторяются"),
        ("" in own, "обнаружена пустая ключевая фраза"), (bool(missing), f"ключевая фраза не найдена в текстах: {missing[0] if missing else ''}"),
    )
    return next((text for broken, text in rules if broken), None)


def prompt_text(text: Column, max_chars: int = 500) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.substring(t, 1, max_chars), r"(?U)\s+$", "")


def token_estimate(text: Column) -> Column:
    n = F.char_length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.ceil(n / 4).cast("int")


def representatives(members: DataFrame, config: SummaryConfig | None = None) -> DataFrame:
    """Members (cluster_id, doc_id, author_id, created_at, text, similarity) that a model reads:
    nearest first, few per author, while the token budget lasts. A first text that is over the
    budget alone is read alone."""
    c = config or SummaryConfig()
    rows = members.withColumn("prompt_text", prompt_text(F.col("text"), c.max_chars)).withColumn("tokens", token_estimate(F.col("prompt_text")))
    order = [F.desc("similarity"), F.asc("created_at"), F.asc("doc_id")]
    per_author = F.row_number().over(Window.partitionBy("cluster_id", "author_id").orderBy(*order))
    rows = rows.withColumn("_a", per_author).filter(F.col("_a") <= c.max_per_author)
    w = Window.partitionBy("cluster_id").orderBy(*order)
    rows = rows.withColumns({"position": F.row_number().over(w), "_sum": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("_over", F.first("tokens").over(w) > c.max_tokens)
    kept = F.when(F.col("_over"), F.col("position") == 1).otherwise((F.col("_sum") <= c.max_tokens) & (F.col("position") <= c.max_documents))
    return rows.filter(kept).drop("_a", "_sum", "_over")


def needs_new(df: DataFrame, now: Column, config: SummaryConfig | None = None) -> Column:
    """df: prompt_version, current_version, size, size_then, generated_at, growth_rate."""
    c = config or SummaryConfig()
    growth = (F.col("size") - F.col("size_then")) / F.greatest(F.col("size_then"), F.lit(1))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))) / 3.6e9
    return (F.col("prompt_version") != F.col("current_version")) | (growth > c.regenerate_growth) | ((age > c.regenerate_age_hours) & (F.col("growth_rate") > c.regenerate_rate))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return tokens_in / 1000.0 * price_in + tokens_out / 1000.0 * price_out


def prompt_version(prompt: str) -> str:
    import hashlib

    return hashlib.sha256(prompt.encode()).hexdigest()[:16]


def sections(prompt: str, required: tuple[str, ...]) -> dict[str, str]:
    """``## name`` sections of a prompt file, fenced blocks unwrapped; all required ones must be there."""
    found, name = {}, None
    for line in prompt.splitlines():
        if line.startswith("## "):
            name = line[3:].strip()
            found[name] = []
        elif name and not line.startswith("```"):
            found[name].append(line)
    missing = [r for r in required if r not in found]
    if missing:
        raise ValueError(f"the prompt lacks sections: {', '.join(missing)}")
    return {k: "\n".join(v).strip() for k, v in found.items()}


def extractive_answer(texts: list[str]) -> str:
    """A deterministic stand-in for a language model: first sentences and frequent words, labelled."""
    from collections import Counter

    first = [_sentence.split(" ".join(t.split()))[0] for t in texts if t.strip()][:3]
    words = [w for w, _ in Counter(w for t in texts for w in _word.findall(t.lower()) if len(w) > 4).most_common(6)]
    return f"ОПИСАНИЕ: {' '.join(first)}\nФРАЗЫ: {'; '.join(words)}"


def describe(selected: DataFrame, client=extractive_answer, config: SummaryConfig | None = None) -> DataFrame:
    """(cluster_id, summary, key_phrases, attempts, needs_review) from representative documents.
    Asks again with the reason when an answer is not valid; a group is bounded by the selection."""
    c = config or SummaryConfig()

    def run(pdf):
        texts = pdf.sort_values("position")["prompt_text"].tolist()
        summary, phrases, n = "", [], 0
        ok = False
        lowered = [" ".join(t.casefold().split()) for t in texts]
        while n <= c.retries and not ok:
            n += 1
            summary, phrases = parse_answer(client(texts), c.max_words)
            ok = c.min_words <= len(_word.findall(summary)) and c.min_phrases <= len(phrases) <= c.max_phrases and all(any(p.casefold() in t for t in lowered) for p in phrases)
        return pd.DataFrame([{"cluster_id": pdf["cluster_id"].iloc[0], "summary": summary, "key_phrases": phrases, "attempts": n, "needs_review": not ok}])

    kind = dict(selected.dtypes)["cluster_id"]
    return selected.select("cluster_id", "position", "prompt_text").groupBy("cluster_id").applyInPandas(run, f"cluster_id {kind}, summary string, key_phrases array<string>, attempts int, needs_review boolean")


def history(current: DataFrame, fresh: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(new current rows, rows that go to history): a fresh row takes its predecessor's place."""
    both = current.unionByName(fresh)
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    ranked = both.withColumn("_n", n)
    return ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").drop("_n")


def render(template: str, values: dict[str, object], feedback: str | None = None) -> str:
    """The prompt for one cluster; ``feedback`` says which rule the last answer broke."""
    prompt = template.format(**values).strip()
    return prompt if not feedback else f"{prompt}\n\nПредыдущий ответ нарушил правило: {feedback}. Перепиши ответ строго по формату."


def run_metrics(runs: DataFrame) -> DataFrame:
    """Counts, mean time, tokens and cost of a run; ``runs``: regenerated, fallback_used, invalid, generation_time_ms,
    input_tokens, output_tokens, cost_usd, one row a cluster."""
    again = F.col("regenerated")
    total = lambda c, zero: F.coalesce(F.sum(F.when(again, F.col(c))), F.lit(zero))
    return runs.agg(
        F.count("*").alias("clusters_processed"), F.count_if(again).alias("clusters_regenerated"), F.count_if(~again).alias("clusters_skipped"), F.count_if(again & F.col("fallback_used")).alias("fallback_used_count"),
        F.count_if(again & F.col("invalid")).alias("validation_failed"), F.coalesce(F.avg(F.when(again, F.col("generation_time_ms"))), F.lit(0.0)).alias("avg_generation_time_ms"),
        total("input_tokens", 0).alias("total_input_tokens"), total("output_tokens", 0).alias("total_output_tokens"), total("cost_usd", 0.0).alias("estimated_cost_usd"),
    )
