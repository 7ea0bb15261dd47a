"""Sentiment: from a model's label scores to one number in [-1, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the labels.
LABELS = {
    "negative": "negative", "neg": "negative", "label_0": "negative", "neutral": "neutral", "neu": "neutral", "label_1": "neutral",
    "positive": "positive", "pos": "positive", "label_2": "positive",
}


def label(name: Column) -> Column:
    n = F.lower(F.trim(name))
    out = F
    for k, v in LABELS.items():
        if k != v:
            out = out.when(n == k, v)
    return out.otherwise(n)


def from_scores(scores: Column) -> Column:
    """``scores``: array of (label, score). Positive minus negative, damped by neutral; without
    both, the best label's score with its sign."""
    of = lambda want: F.get(F.reverse(F.filter(scores, lambda s: label(s["label"]) == want)), F.lit(0))["score"]
    pos, neg, neu = of("positive"), of("negative"), of("neutral")
    raw = (pos - neg) * F.when(neu.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - neu))
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    best = F.get(F.filter(scores, lambda s: s["score"] == top), F.lit(0))
    name = label(best["label"])
    fallback = F.when(name == "negative", -F.abs(best["score"])).when(name == "positive", F.abs(best["score"])).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(raw, fallback, F.lit(0.0))))


def score(df: DataFrame, backend, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``backend``: list of texts -> list of [(label, score)]; one call an Arrow batch."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = backend(b[text_col].fillna("").tolist())
            yield pd.DataFrame({id_col: b[id_col], "scores": [[{"label": k, "score": float(v)} for k, v in row] for row in out]})

    kind = dict(df.dtypes)[id_col]
    rows = df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, scores array<struct<label:string,score:double>>")
    return rows.select(id_col, from_scores(F.col("scores")).alias("sentiment_score"))


def lexicon_backend(positive: tuple[str, ...], negative: tuple[str, ...]):
    """A deterministic stand-in for a sentiment model."""

    def run(texts):
        out = []
        for t in texts:
            words = t.lower().split()
            p, n = sum(w in positive for w in words), sum(w in negative for w in words)
            k = max(1, p + n)
            out.append([("positive", p / k), ("negative", n / k), ("neutral", 0.0 if p + n else 1.0)])
        return out

    return run
