"""Toxicity by weak supervision.

Many voters say toxic (1), clean (0) or abstain: hand-written lexicons and patterns, and
lexicons induced from the labelled training rows (words and word beginnings that toxic rows
hold far more often). The annotators' label is one more voter. A generative model estimates
each voter's votes on toxic and on clean rows by expectation-maximisation, and the
correlations of the voters given the class, by which it counts dependent voters less. A
linear classifier over words and word beginnings is trained on its posterior labels; it
alone scores documents, so a score needs nothing but the text.

Training reads at most ``TRAIN_ROWS`` labelled rows (chosen by a seeded hash) whose texts have
at most ``TRAIN_TEXT_BYTES``, never those of the held-out fold. The classifier has at most
``MAX_FEATURES`` weights, the only thing broadcast. Scoring is one narrow pass over whole
texts of any length.

Defined results. Null and empty texts get the score of a text without words. Without
labelled rows the words of the hand-written lexicons alone score. Rows that repeat get equal
scores. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, small_batches
from tidemark.llm.linear import Logistic, labelled_sample

TRAIN_ROWS, TRAIN_TEXT_BYTES = 3000, 100_000
MAX_FEATURES = 6000
HEADS = (4, 5, 6, 7)
FOLDS = 5

LEXICONS = {
    "insults_en": "idiot moron imbecile dumbass fool clown loser scum trash stupid worthless pathetic disgusting vermin scumbag jerk bastard creep freak",
    "abuse_en": "kill die hate shut filthy ugly dirt garbage parasite subhuman degenerate retard whore slut bitch shit fuck asshole",
    "insults_fr": "idiot imbécile crétin débile abruti ordure salaud connard conne pourriture minable dégoûtant stupide",
    "insults_de": "idiot dummkopf trottel abschaum arschloch widerlich erbärmlich dreckig hurensohn schwachkopf versager",
    "insults_es": "idiota imbécil estúpido basura escoria asqueroso patético inútil cabrón payaso perdedor",
}
PATTERNS = {
    "you_are": re.compile(r"\b(?:you|your|du|tu|eres|bist)\b[^.!?\n]{0,40}\b(?:idiot|moron|stupid|trash|scum|loser|dumm|basura)\w*", re.I),
    "masked": re.compile(r"\b\w[*@#$]{2,}\w\b"),
    "threat": re.compile(r"\b(?:i will|i'll|gonna)\b[^.!?\n]{0,20}\b(?:kill|hurt|beat)\b", re.I),
}
_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> set[str]:
    return set(_words((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in HEADS if len(word) > n)]


def row_of(words: set[str]) -> Counter:
    return Counter(f for w in words for f in features_of(w))


def induced(rows: list[Counter], labels: list[int], *, voters: int = 6, least: int = 3) -> list[set[str]]:
    """Lexicons of features that toxic rows hold far more often, dealt to voters by rank."""
    toxic, clean = Counter(), Counter()
    n1 = n0 = 0
    for r, y in zip(rows, labels, strict=True):
        if y:
            toxic.update(r.keys())
            n1 += 1
        else:
            clean.update(r.keys())
            n0 += 1
    if not n1 or not n0:
        return []
    rated = {f: math.log((c + 0.1) / (n1 + 1)) - math.log((clean[f] + 0.5) / (n0 + 1)) for f, c in toxic.items() if c >= least}
    best = sorted((f for f, s in rated.items() if s > 3), key=lambda f: (-rated[f] * math.log1p(toxic[f]), f))[: 40 * voters]
    return [x for v in range(voters) if (x := set(best[v::voters]))]


def votes_of(text: str | None, words: set[str], row: Counter, learned: list[set[str]]) -> list[int]:
    """-1 abstains."""
    hits = [1 if any(w in words for w in lexicon.split()) else -1 for lexicon in LEXICONS.values()]
    hits += [1 if p.search(text or "") else -1 for p in PATTERNS.values()]
    hits += [1 if lexicon & row.keys() else -1 for lexicon in learned]
    n = sum(h == 1 for h in hits)
    return [*hits, 0 if n == 0 else -1, 1 if n >= 2 else -1]


class LabelModel:
    """Class-conditional vote distributions with correlation-discounted weights."""

    def __init__(self, share: float, ratios, discount):
        self.share, self.ratios, self.discount = share, ratios, discount

    @classmethod
    def fit(cls, votes: list[list[int]], *, rounds: int = 30) -> LabelModel:
        import numpy as np

        v = np.asarray(votes)
        n, k = v.shape
        one_hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)  # abstain, clean, toxic
        p = np.clip((v == 1).sum(1) / np.maximum(1, (v >= 0).sum(1)), 0.02, 0.98)
        discount = np.ones(k)
        for _ in range(rounds):
            a = np.einsum("n,nkx->kx", p, one_hot) + np.array([2.0, 0.5, 2.0])
            b = np.einsum("n,nkx->kx", 1 - p, one_hot) + np.array([2.0, 2.0, 0.1])
            a /= a.sum(1, keepdims=True)
            b /= b.sum(1, keepdims=True)
            ratios = np.log(a) - np.log(b)
            share = (p.sum() + 1) / (n + 10)
            # correlation of two voters given the class
            score = (v == 1).astype(float) - (v == 0)
            rest = score - p[:, None] * (a[:, 2] - a[:, 1]) - (1 - p[:, None]) * (b[:, 2] - b[:, 1])
            cov = rest.T @ rest / n
            sd = np.sqrt(np.diag(cov)) + 1e-9
            rho = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
            np.fill_diagonal(rho, 0)
            discount = 1 / (1 + rho.sum(1))
            logit = np.log(share / (1 - share)) + (one_hot * ratios[None] * discount[None, :, None]).sum((1, 2))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return cls(share, ratios, discount)

    def posterior(self, votes: list[int]) -> float:
        logit = math.log(self.share / (1 - self.share)) + sum(d * r[x + 1] for d, r, x in zip(self.discount, self.ratios, votes, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def train(sample: list[tuple[str | None, int | None]]) -> Logistic:
    """From (text, label or None) rows."""
    words = [words_of(t) for t, _ in sample]
    rows = [row_of(w) for w in words]
    known = [(r, y) for r, (_, y) in zip(rows, sample, strict=True) if y is not None]
    learned = induced([r for r, _ in known], [y for _, y in known]) if known else []
    votes = [[*votes_of(t, w, r, learned), -1 if y is None else int(y)] for (t, y), w, r in zip(sample, words, rows, strict=True)]
    model = LabelModel.fit(votes)
    soft = [model.posterior(v) for v in votes]
    inside, outside = Counter(), Counter()
    for r, p in zip(rows, soft, strict=True):
        (inside if p >= 0.5 else outside).update(r.keys())
    n1, n0 = sum(p >= 0.5 for p in soft), sum(p < 0.5 for p in soft)
    telling = {f: math.log((inside[f] + 0.3) / (n1 + 1)) - math.log((outside[f] + 0.3) / (n0 + 1)) for f in {f for f, c in (inside + outside).items() if c >= 3}}
    chosen = set(sorted((f for f, s in telling.items() if abs(s) > 1.5), key=lambda f: (-abs(telling[f]) * math.log1p(inside[f] + outside[f]), f))[:MAX_FEATURES])
    chosen |= {w for x in LEXICONS.values() for w in x.split() if len(w) > 3}
    thin = [{f: float(min(c, 3)) for f, c in r.items() if f in chosen} for r in rows]
    # the hand-written words start as toxic examples of their own
    texts = [{w: 1.0} for w in sorted({w for k, x in LEXICONS.items() if k.startswith("insults") for w in x.split()})]
    return Logistic.fit(thin + texts, soft + [0.95] * len(texts), counts=[1.0] * len(thin) + [0.05] * len(texts), l2=2e-5, steps=400)


def _scorer(model):
    """text -> score, with the words' features remembered between texts."""
    weights, bias = model
    of = Remembered(lambda word: [f for f in features_of(word) if f in weights])

    def one(text: str | None) -> float:
        found = Counter(f for w in words_of(text) for f in of[w])
        z = bias + sum(weights[f] * min(c, 3) for f, c in found.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return one


def _score(shared):
    """(id, text) rows to (id, score)."""

    def run(batches):
        one = _scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(one, part.column(1).to_pylist()), pa.float64())], ["id", "score"])

    return run


def _clean(shared, at_text: int):
    """The rows, with all their columns, that do not score as toxic."""

    def run(batches):
        one = _scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([one(x) < 0.5 for x in part.column(at_text).to_pylist()], pa.bool_()))

    return run


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, train_rows: int = TRAIN_ROWS, seed: int = 6):
    """The broadcast classifier: at most MAX_FEATURES weights and the lexicons."""
    text = F.col(text_col).cast("string").alias("text")
    small_batches(docs)
    allowed = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).alias("y")).filter(F.col(id_col).isNotNull() & F.col("y").isNotNull()).filter(~held_out(id_col))
    short = docs.filter(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) <= TRAIN_TEXT_BYTES)
    rows = labelled_sample(short, allowed, id_col, [text], train_rows, seed).select("text", "y", id_col).orderBy(id_col, "text").limit(train_rows).collect()  # at most train_rows documents of bounded size
    sample = [(r["text"], int(r["y"])) for r in rows]
    model = train(sample) if sample else Logistic({w: 2.0 for x in LEXICONS.values() for w in x.split()}, -2.0)
    return docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(fitted(docs, labels, id_col, text_col, label_col, **options)), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; no shuffle."""
    return docs.mapInArrow(_clean(fitted(docs, labels, id_col, text_col, **options), docs.columns.index(text_col)), docs.schema)
