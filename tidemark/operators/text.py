"""Text cleaning, classification and fingerprints."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import ENDINGS
from tidemark.operators.filtering import PY_SPACE, collapsed

URL = r"(?i)(?:https?://|www\.)(?U)\S+"
MENTION = r"(?U)(?<!\w)@[A-Za-z0-9_][A-Za-z0-9_.-]*"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{200D}\\x{FE0F}]"


@F.pandas_udf(T.StringType())
def _demojize(texts: pd.Series) -> pd.Series:
    """Unicode names for pictographs; joiners and selectors are spaces."""
    import unicodedata

    names: dict[str, str] = {}

    def sign(c: str) -> str:
        if c in "‍️":
            return " "
        if not (0x1F300 <= ord(c) <= 0x1FAFF or 0x2600 <= ord(c) <= 0x27BF):
            return c
        name = unicodedata.name(c, "").lower().replace("-", " ")
        return f" {name} " if name else c

    def one(t: str | None):
        return None if t is None else "".join(c if c < " " else names.setdefault(c, sign(c)) for c in t)

    return texts.map(one)


def demojize(text: Column) -> Column:
    """Only texts with a pictograph leave the JVM's own path."""
    return F.when(text.rlike(EMOJI), _demojize(text)).otherwise(text)


def clean(df: DataFrame, text_col: str = "text", *, emoji: bool = True) -> DataFrame:
    """Adds normalized_text, token_count and cleanup_flags, a flag for each step that changed the text."""
    steps = [("url_removed", lambda t: F.regexp_replace(t, URL, " ")), ("mention_normalized", lambda t: F.regexp_replace(t, MENTION, "USER"))]
    if emoji:
        steps.append(("emoji_demojized", demojize))
    steps.append(("whitespace_normalized", collapsed))
    df = df.withColumn("_t0", F.coalesce(F.col(text_col), F.lit("")))
    for i, (_, step) in enumerate(steps):
        df = df.withColumn(f"_t{i + 1}", step(F.col(f"_t{i}")))
    last = f"_t{len(steps)}"
    flags = F.array_compact(F.array(*[F.when(F.col(f"_t{i}") != F.col(f"_t{i + 1}"), name) for i, (name, _) in enumerate(steps)]))
    tokens = F.when(F.col(last) == "", 0).otherwise(F.size(F.split(last, " ")))
    return df.withColumns({"normalized_text": F.col(last), "token_count": tokens, "cleanup_flags": flags}).drop(*[f"_t{i}" for i in range(len(steps) + 1)])


def stem(token: Column) -> Column:
    """Strip the first ending that leaves three characters. The list falls in length, so the
    shortest stem that a lazy match finds is the first ending that fits."""
    endings = "|".join(dict.fromkeys(ENDINGS))
    return F.regexp_replace(token, f"^(.{{3,}}?)(?:{endings})$", "$1")


def stem_of(token: str) -> str:
    """``stem`` of a constant."""
    return re.sub(f"^(.{{3,}}?)(?:{'|'.join(dict.fromkeys(ENDINGS))})$", r"\1", token)


def stems(text: Column, keep: Column | None = None) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([0-9a-zа-яё]+)"), F.lit(1))
    return F.transform(tokens, stem)


def classify(df: DataFrame, taxonomy: Mapping[str, tuple[str, tuple[str, ...]]], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, category, category_label, category_confidence, secondary_category, hits.

    ``taxonomy``: key -> (label, keywords), with a key "other". Keywords are matched as runs of
    stems and are constants of the plan: hits are counted within the row, so there is no explode,
    join or shuffle. A document without hits is "other", certainly."""

    def count(gram: tuple[str, ...]) -> Column:
        at = lambda t, i: reduce(lambda a, b: a & b, [t == gram[0], *(F.get(F.col("_toks"), i + j) == g for j, g in enumerate(gram[1:], 1))])
        return F.size(F.filter("_toks", lambda t, i: F.coalesce(at(t, i), F.lit(False))))

    def hits(words: tuple[str, ...]) -> Column:
        grams = [g for w in words if (g := tuple(map(stem_of, re.findall("[0-9a-zа-яё]+", w.lower()))))]
        single = [g[0] for g in grams if len(g) == 1]
        parts = [F.size(F.filter("_toks", lambda t: t.isin(*set(single))))] if len(set(single)) == len(single) > 0 else [count((g,)) for g in single]
        return reduce(lambda a, b: a + b, [*parts, *(count(g) for g in grams if len(g) > 1)], F.lit(0))

    found = [F.struct((-hits(words)).cast("long").alias("h"), F.lit(k).alias("category"), F.lit(label).alias("category_label")) for k, (label, words) in taxonomy.items() if words]
    ranked = df.select(id_col, stems(F.col(text_col)).alias("_toks")).select(id_col, F.sort_array(F.filter(F.array(*found), lambda x: x["h"] < 0)).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    top = -first["h"]
    other = taxonomy["other"][0]
    return ranked.select(
        id_col,
        F.coalesce(first["category"], F.lit("other")).alias("category"),
        F.coalesce(first["category_label"], F.lit(other)).alias("category_label"),
        F.coalesce(top / (top + 1), F.lit(1.0)).alias("category_confidence"),
        F.when((-second["h"] > 0) & ((top + second["h"]) < 2), second["category"]).alias("secondary_category"),
        F.coalesce(top, F.lit(0)).alias("hits"),
    )


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fingerprint(text: Column) -> Column:
    return F.sha2(collapsed(casefold(F.coalesce(text, F.lit("")))), 256)


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(collapsed(text), 1, n)


def passage(text: Column, source_type: Column, *, emoji: bool = False) -> Column:
    """What an encoder reads: no links, no mentions, marked with the source."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)https?://\S+|www\.\S+", " "), r"(?U)@\w+", " ")
    t = collapsed(demojize(t) if emoji else t)
    return F.concat(F.lit("passage: ["), source_type, F.lit("] "), t)


def chunk_windows(df: DataFrame, text_col: str, size: int = 512, overlap: int = 64, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk, start, n_tokens, chunk_text): token windows of ``size`` with ``overlap``; the last ends with the text."""
    toks = df.select(id_col, F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), PY_SPACE), lambda w: w != "").alias("t"))
    n, step = F.size("t"), size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < n))
    rows = toks.select(id_col, "t", F.posexplode(starts).alias("chunk", "start"))
    part = F.slice("t", F.col("start") + 1, size)
    return rows.select(id_col, "chunk", "start", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk_text"))


# Payload fields that may hold a document's address, in order.
URL_FIELDS = ("url", "link", "short_url", "source_url", "permalink", "canonical_url", "full_url")


def source_url(source_type: Column, source_id: Column, payload: Column) -> Column:
    """The first web address in the payload (JSON text), else one that follows from a VK id."""
    found = [F.get_json_object(payload, f"$.{k}") for k in URL_FIELDS]
    found += [F.get_json_object(payload, "$.attachments[0].link.url"), F.get_json_object(payload, "$.research.urls[0]")]
    web = [F.when(u.rlike("^https?://"), u) for u in found]
    parts = F.split(source_id, "_")
    at = lambda i: F.get(parts, F.lit(i))
    wall = lambda n: (F.size(parts) == n) & F.forall(parts, lambda p: p != "")
    post = F.when((source_type == "vk_post") & wall(2), F.concat(F.lit("https://vk.com/wall"), source_id))
    comment = F.when((source_type == "vk_comment") & wall(3), F.concat(F.lit("https://vk.com/wall"), at(0), F.lit("_"), at(1), F.lit("?reply="), at(2)))
    return F.coalesce(*web, post, comment)


def engagement(likes: Column, reposts: Column, comments: Column) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.coalesce(likes, zero) + F.coalesce(reposts, zero) + F.coalesce(comments, zero))
