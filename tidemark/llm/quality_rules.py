"""Quality rules as weak supervision; built-in functions only.

Each rule votes for a document (1), against it (-1) or abstains (0). Documents are added up by
their votes, and expectation-maximisation over those counts estimates the share of good
documents and of a few kinds of bad ones and, of each rule, how often its votes are against each;
an abstention says nothing. Junk is of several kinds and each rule sees only some, so the kinds
are found first: the common sets of two or more rules that vote against the same documents, as many as the data show.
Rules are believed to err: ``ERRORS`` of a class more votes than were counted are against and
for it, a share of the class, so that the belief is alike at every corpus size. One vote against
is then fatal only if the accuracies and the other votes say so. A document's quality
probability is the posterior of the good class given all its votes, looked up by vote pattern.
The driver sees at most 3 ** rules counts, never documents.

Defined results. Null text is empty; a document with fewer words than ``MIN_WORDS`` or
with too many repeated words fails the base and is not kept, whatever its posterior. Texts of
any length are read whole. Tied and repeated rows get equal verdicts. An empty table gives an
empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, store

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: A rule's votes that are taken to be errors, as a share of a class.
ERRORS = 0.02
#: A set of rules starts a kind of bad documents of its own if at least this share of the documents shows it, so there are at most
#: 1 / LEAST_KIND kinds; a rarer set belongs to the kinds that it is like.
LEAST_KIND = 0.002
ROUNDS = 500


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more, the first included."""

    def covered(windows: Column) -> Column:
        def flagged(s: Column) -> Column:
            def twin(e: Column, i: Column) -> Column:
                same_before = (i > 0) & (F.get(s, i - 1)["x"] == e["x"])
                same_after = F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))
                return F.when(same_before | same_after, e["i"])

            return F.sort_array(F.filter(F.transform(s, twin), lambda p: p.isNotNull()))

        def length(starts: Column) -> Column:
            steps = F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(starts, i + 1) - p), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        repeats = _let(_let(ordered, flagged), length)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(repeats)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(windows, covered))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    t = t.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""))
    return t.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit(r"\p{Lu}{3,}")).cast("long").alias("n_shouted"),
        F.regexp_count("text", F.lit(r"[.!?](?:\s|$)")).cast("long").alias("n_stops"),
        F.regexp_count("text", F.lit(r"!!|\?\?")).cast("long").alias("n_excited"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"[\p{L}\p{N}][.,;:!?)\x{201d}\x22]?(?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_plain"),
        F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get("words", i - 1)))).cast("long").alias("n_again"),
    )


def rules() -> dict[str, Column]:
    """Rule -> vote. Thresholds are fixed shares, alike at every corpus size."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(against: Column, for_: Column) -> Column:
        return F.when(against, F.lit(-1)).when(for_, F.lit(1)).otherwise(F.lit(0))

    def share(c: str) -> Column:
        return F.col(c) / n

    return {
        "length": vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 40),
        "word_length": vote(~share("word_chars").between(2.5, 14), share("word_chars").between(3, 12)),
        "symbols": vote(share("n_symbols") > 0.25, share("n_symbols") < 0.05),
        "lines": vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), (F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0)),
        "repeats": vote(share("n_repeat_words") > 0.2, (F.col("n_words") >= 40) & (share("n_repeat_words") < 0.02)),
        "variety": vote((F.col("n_words") >= 40) & (F.col("n_words") <= 2000) & (share("n_distinct") < 0.3), (F.col("n_words") >= 40) & (share("n_distinct") > 0.45)),
        "shouting": vote(share("n_shouted") > 0.4, share("n_shouted") < 0.05),
        "sentences": vote((F.col("n_words") >= 40) & (F.col("n_stops") * 80 < F.col("n_words")), F.col("n_stops") * 40 >= F.col("n_words")),
        "excitement": vote(share("n_excited") > 0.2, share("n_excited") < 0.02),
        "letters": vote(F.col("n_letters") < 0.7 * F.col("word_chars"), F.col("n_letters") > 0.85 * F.col("word_chars")),
        "plain_words": vote(share("n_plain") < 0.6, share("n_plain") > 0.85),
        "again": vote(share("n_again") > 0.1, share("n_again") < 0.03),
    }


def kinds_of(counts: list[tuple[tuple[int, ...], int]]) -> list[frozenset[int]]:
    """The commonest sets of two or more rules against the same documents that are mostly unlike each other."""
    sets: dict[frozenset[int], int] = {}
    for v, n in counts:
        against = frozenset(k for k, x in enumerate(v) if x < 0)
        if len(against) > 1:
            sets[against] = sets.get(against, 0) + n
    least, found = LEAST_KIND * sum(n for _, n in counts), []
    for s in sorted(sets, key=lambda s: (-sets[s], sorted(s))):
        if sets[s] >= least and all(2 * len(s & f) < len(s | f) for f in found):
            found.append(s)
    return found or [frozenset()]


def fit(counts: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[list[float], list[list[float]]]:
    """EM over (votes, documents): the share of each class, and [class][rule]: P(against | a vote is
    cast, class). Class 0 is the good one. To start, one vote against makes a document somewhat
    doubtful and two make it bad, of the kinds whose rules are against it."""
    import numpy as np

    kinds = kinds_of(counts)
    votes = np.array([v for v, _ in counts], np.int64).reshape(len(counts), n_rules)
    n = np.array([c for _, c in counts], np.float64)
    against, for_ = (votes < 0).astype(np.float64), (votes > 0).astype(np.float64)
    good = np.array([0.98, 0.8, 0.05])[np.minimum(2, against.sum(1).astype(int))]
    alike = np.array([[0.01 + sum(v[k] < 0 for k in s) / max(1, len(s)) for s in kinds] for v, _ in counts]).reshape(len(counts), len(kinds))
    post = np.column_stack([good, (1 - good)[:, None] * alike / alike.sum(1, keepdims=True)])
    share, odds = np.full(len(kinds) + 1, 1 / (len(kinds) + 1)), np.full((len(kinds) + 1, n_rules), 0.5)
    for _ in range(ROUNDS):
        mass = post * n[:, None]
        total = mass.sum(0)
        no, yes = mass.T @ against, mass.T @ for_
        belief = ERRORS * total[:, None] + 1e-9
        odds = (no + belief) / (no + yes + 2 * belief)
        share = np.maximum(total / max(1.0, n.sum()), 1e-4)
        share /= share.sum()
        z = np.log(share) + against @ np.log(odds).T + for_ @ np.log(1 - odds).T
        e = np.exp(z - z.max(1, keepdims=True))
        fresh = e / e.sum(1, keepdims=True)
        moved = float(np.abs(fresh - post).max(initial=0.0))
        post = fresh
        if moved < 1e-9:
            break
    return share.tolist(), odds.tolist()


def posterior_of(votes: tuple[int, ...], share: list[float], odds: list[list[float]]) -> float:
    z = [math.log(s) + sum(math.log(p if x < 0 else 1 - p) for p, x in zip(row, votes, strict=True) if x) for s, row in zip(share, odds, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    return e[0] / sum(e)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    named = rules()
    pattern = sum(((v + 1) * 3**k for k, v in enumerate(named.values())), F.lit(0)).cast("int")
    rows = store(features(docs, id_col, text_col).withColumn("pattern", pattern))
    votes = lambda p: tuple(p // 3**k % 3 - 1 for k in range(len(named)))
    counts = {r["pattern"]: r["count"] for r in rows.groupBy("pattern").count().collect()}  # at most 3 ** rules rows
    share, odds = fit(sorted((votes(p), c) for p, c in counts.items()), len(named))
    # The posterior of each pattern, as a table: at most 3 ** rules rows, so it may be broadcast.
    table = json.dumps([{"pattern": p, "posterior": posterior_of(votes(p), share, odds)} for p in counts])
    known = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<pattern:int,posterior:double>>")))
    rows = rows.join(F.broadcast(known), "pattern")
    posterior = F.col("posterior")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (posterior >= threshold)).alias("kept"), posterior,
    )
