"""Quality by co-training.

Two classifiers look at different views of a document: its text's content (shapes, repetition
and layout of its words) and its page metadata (source, language and size, never the text).
Each is a naive Bayes model over hashed tokens, so it is fitted from sums alone: over all
labelled rows and, from the second round on, over all unlabelled documents of which the other
view is sure. Pseudo-labels of a class weigh together at most as much as its labels. After
every round both are calibrated (Platt) on labelled rows that neither trains on, and a
document's score combines the calibrated views by how well they did there.

Texts are read once, whole; each document's tokens (some hundred bytes) are kept in a table that
the rounds read. A round is two aggregations whose results, sums by token and by calibration
bin, have a fixed size; nothing is sampled, and no document reaches the driver. The two models'
weights are all that is broadcast. Labels of the held-out fold are never read.

Defined results. Null and empty texts score as texts without words; null metadata is a value
of its own. Without training labels of both classes every document scores 0.5 and is kept. Rows
that repeat get equal scores; of several labels of one id the best counts. A null id has no
label. An empty table gives an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, small_batches, store
from tidemark.llm.linear import Logistic

TOKENS = 1 << 14
FOLDS, CALIBRATION = 5, 4
ROUNDS, SURE, SHRINK = 3, 0.95, 2.0
BINS, REACH = 256, 32.0
TRAIN, CALIBRATE, HELD_OUT = 0, 1, 2


_SIGNS = str.maketrans({chr(c): "A" if chr(c).isupper() else "a" if chr(c).isalpha() else "0" for c in range(128) if chr(c).isalnum()})
_UPPER = bytes(range(65, 91))
_run = re.compile(r"(.)\1+", re.S)
_wide = re.compile(r"[^\x00-\x7f]+")


def shape(word: str) -> str:
    """Runs of upper, lower, digit characters as one sign each; other characters as they are. Of a
    shape longer than 64 signs a hash is the name, so that a name is short."""
    signs = word.translate(_SIGNS) if word.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    out = _run.sub(r"\1", signs)
    return out if len(out) <= 64 else hashlib.blake2b(out.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def n_upper(text: str) -> int:
    """Upper-case characters of the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw) - len(raw.translate(None, _UPPER))
    return n if len(raw) == len(text) else n + sum(map(str.isupper, "".join(_wide.findall(text))))


def _level(share: float) -> int:
    """0 for a half and more, 1 for a quarter and more, to 6 for less than 1/64 and 9 for none."""
    return 9 if share <= 0 else min(6, max(0, math.ceil(-math.log2(share)) - 1))


def text_view(text: str | None, shapes=None) -> set[str]:
    """Tokens of the whole text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return {"empty"}
    seen: Counter = Counter()
    for w, c in Counter(words).items():
        seen[shapes[w] if shapes is not None else shape(w)] += c
    out = {f"shape {s} {_level(c / n)}" for s, c in seen.items()}
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    size = len(text)
    return out | {
        f"again {_level(again / n)}", f"triples again {_level(1 - triples / max(1, n - 2)) if n > 2 else 9}", f"lines again {_level(1 - len(set(lines)) / max(1, len(lines)))}",
        f"word length {min(12, sum(map(len, words)) // n)}", f"upper {_level(n_upper(text) / size)}", f"marks {_level(sum(map(text.count, '#*$%&|<>!')) / size)}",
        f"digits {_level(sum(map(text.count, '0123456789')) / size)}", f"line length {int(math.log2(1 + size / max(1, len(lines))))}", f"words {int(math.log2(n))}",
    }


def metadata_view(source, lang, n_chars) -> set[str]:
    """Tokens of what is known of the page without its text."""
    size = -1 if n_chars is None else int(2 * math.log2(1 + max(0, n_chars)))
    return {f"source {source}", f"lang {lang}", f"source {source} lang {lang}", f"size {size}", f"lang {lang} size {size // 2}"}


def _views(batches):
    """(id, text, source, lang, n_chars) to (id, text's tokens, metadata's tokens), tokens as 16-bit hashes."""
    import numpy as np
    import xxhash

    number = Remembered(lambda t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % TOKENS)
    shapes = Remembered(shape)
    pack = lambda tokens: np.unique(np.fromiter(map(number.__getitem__, tokens), np.uint16, len(tokens))).tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts, *rest = (part.column(i).to_pylist() for i in range(1, 5))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([pack(text_view(t, shapes)) for t in texts], pa.binary()), pa.array([pack(metadata_view(*m)) for m in zip(*rest, strict=True)], pa.binary())], ["id", "t", "m"]
            )


class View:
    """Naive Bayes over tokens: log ratios, and (a, b) of its calibration."""

    def __init__(self, weights, bias: float, a: float = 1.0, b: float = 0.0):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    @classmethod
    def fit(cls, bad, good, n_bad: float, n_good: float) -> View:
        """From weighted documents by token and class. A token's rates are drawn to the pooled rate."""
        import numpy as np

        pooled = SHRINK * (bad + good) / max(n_bad + n_good, 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.log((good + pooled) / (n_good + SHRINK)) - np.log((bad + pooled) / (n_bad + SHRINK))
        return cls(np.where(bad + good > 0, np.nan_to_num(ratio), 0.0), math.log((n_good + 1) / (n_bad + 1)))

    def raw(self, packed: list[bytes]):
        """Log odds of documents, before calibration. A document's tokens depend on each other, so
        their sum is divided by the root of their number."""
        import numpy as np

        sizes = np.array([len(x) // 2 for x in packed], np.int64)
        flat = np.frombuffer(b"".join(packed), np.uint16)
        sums = np.bincount(np.repeat(np.arange(len(packed)), sizes), self.weights[flat], len(packed))
        return np.clip(self.bias + sums / np.sqrt(np.maximum(1, sizes)), -REACH, REACH)

    def logit(self, packed: list[bytes]):
        import numpy as np

        return np.clip(self.a * self.raw(packed) + self.b, -30, 30)


def _slices(batches, rows: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _tally(shared):
    """Documents by view, token (-1: any) and class: labelled ones, and those of which the other view is sure."""

    def run(batches):
        import numpy as np

        sums = np.zeros((2, TOKENS + 1, 4), np.int64)  # labelled bad, good; sure bad, good
        models = shared.value
        for part in _slices(batches):
            packed = [part.column(i).to_pylist() for i in (0, 1)]
            y, fold = (np.array([-1 if x is None else x for x in part.column(i).to_pylist()], np.int64) for i in (2, 3))
            kinds = [np.where(fold == TRAIN, y, -1) for _ in (0, 1)]
            if models:
                for v in (0, 1):
                    p = 1 / (1 + np.exp(-models[1 - v].logit(packed[1 - v])))
                    kinds[v] = np.where(fold >= 0, kinds[v], np.where(p >= SURE, 3, np.where(p <= 1 - SURE, 2, -1)))
            for v in (0, 1):
                sizes = np.array([len(x) // 2 for x in packed[v]], np.int64)
                flat = np.frombuffer(b"".join(packed[v]), np.uint16)
                owner = np.repeat(kinds[v], sizes)
                for k in range(4):
                    sums[v, :TOKENS, k] += np.bincount(flat[owner == k], minlength=TOKENS)
                    sums[v, TOKENS, k] += int((kinds[v] == k).sum())
        view, token = np.nonzero(sums.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(token, pa.int32()), *(pa.array(sums[view, token, k], pa.int64()) for k in range(4))], ["view", "token", "l0", "l1", "p0", "p1"])

    return run


def _histogram(shared):
    """Calibration rows by view, label and bin of their log odds."""

    def run(batches):
        import numpy as np

        sums = np.zeros((2, 2, BINS), np.int64)
        for part in _slices(batches):
            y = np.array(part.column(2).to_pylist(), np.int64)
            for v, model in enumerate(shared.value):
                at = np.minimum(BINS - 1, ((model.raw(part.column(v).to_pylist()) + REACH) * (BINS / (2 * REACH))).astype(np.int64))
                np.add.at(sums[v], (y, at), 1)
        view, y, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[view, y, at], pa.int64())], ["view", "y", "bin", "n"])

    return run


def platt(cells: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """(a, b, skill) from (log odds, label, rows): P(good) = 1 / (1 + exp(-(a * odds + b))); skill falls with the loss."""
    if len({y for _, y, _ in cells}) < 2:
        return 1.0, 0.0, 1.0
    model = Logistic.fit([{"z": z / 5} for z, _, _ in cells], [y for _, y, _ in cells], counts=[n for *_, n in cells], l2=1e-4, steps=300)
    a, b = max(0.05, model.weights.get("z", 5.0) / 5), model.bias
    loss = sum(n * math.log1p(math.exp(-max(-30.0, min(30.0, (a * z + b) * (2 * y - 1))))) for z, y, n in cells) / sum(n for *_, n in cells)
    return a, b, 1 / (0.02 + loss)


def co_train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[View], list[float]]:
    """The calibrated views, and the share each has in a score. ``rows``: t, m, y, fold."""
    import numpy as np

    context = rows.sparkSession.sparkContext
    models, shares = [], [0.5, 0.5]
    for _ in range(rounds + 1):
        sums = np.zeros((2, TOKENS + 1, 4), np.float64)
        parts = rows.select("t", "m", "y", "fold").mapInArrow(_tally(context.broadcast(models)), "view int, token int, l0 long, l1 long, p0 long, p1 long")
        for r in parts.groupBy("view", "token").agg(*[F.sum(c).alias(c) for c in ("l0", "l1", "p0", "p1")]).collect():  # at most 2 * (TOKENS + 1) rows
            sums[r["view"], r["token"]] = r["l0"], r["l1"], r["p0"], r["p1"]
        if not (sums[0, TOKENS, 0] and sums[0, TOKENS, 1]):
            zero = View(np.zeros(TOKENS), 0.0)
            return [zero, zero], shares
        fresh = []
        for v in (0, 1):
            n = sums[v, TOKENS]
            weigh = [min(1.0, n[c] / n[2 + c]) if n[2 + c] else 0.0 for c in (0, 1)]
            bad, good = (sums[v, :, c] + weigh[c] * sums[v, :, 2 + c] for c in (0, 1))
            fresh.append(View.fit(bad[:TOKENS], good[:TOKENS], bad[TOKENS], good[TOKENS]))
        cells = rows.filter(F.col("fold") == CALIBRATE).select("t", "m", "y").mapInArrow(_histogram(context.broadcast(fresh)), "view int, y int, bin int, n long")
        found: list[list] = [[], []]
        for r in cells.groupBy("view", "y", "bin").agg(F.sum("n").alias("n")).orderBy("view", "y", "bin").collect():  # at most 4 * BINS rows
            found[r["view"]].append(((r["bin"] + 0.5) * (2 * REACH / BINS) - REACH, r["y"], r["n"]))
        skill = []
        for v in (0, 1):
            fresh[v].a, fresh[v].b, s = platt(found[v])
            skill.append(s)
        models, shares = fresh, [s / sum(skill) for s in skill]
    return models, shares


def _score(shared):
    def run(batches):
        import numpy as np

        models, shares = shared.value
        sigmoid = lambda z: pa.array(1 / (1 + np.exp(-z)), pa.float64())
        for part in _slices(batches):
            z = [models[v].logit(part.column(1 + v).to_pylist()) for v in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), sigmoid(z[0]), sigmoid(z[1]), sigmoid(shares[0] * z[0] + shares[1] * z[1])], ["id", "text_score", "metadata_score", "score"])

    return run


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def tokens(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, seed: int = 8) -> DataFrame:
    """id, t, m (tokens of the views), y and fold (null without a label) for every row of ``docs``."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    columns = [F.col(text_col).cast("string").alias("text"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]]
    views = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), *columns).mapInArrow(_views, "id long, t binary, m binary")
    known = labels.select(F.col(id_col).cast("long").alias("known"), (F.col(label_col).cast("int") > 0).cast("int").alias("y")).filter("known IS NOT NULL AND y IS NOT NULL").groupBy("known").agg(F.max("y").alias("y"))
    fold = F.when(held_out("known"), HELD_OUT).when(F.pmod(F.xxhash64(F.lit(seed), "known"), F.lit(CALIBRATION)) == 0, CALIBRATE).otherwise(TRAIN)
    known = known.select("known", "y", fold.cast("int").alias("fold"), F.lit(0).alias("other"))
    # rows without an id have no label; a salt keeps them out of one task
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("t", "m"), F.lit(4096)).cast("int")).otherwise(0)
    views = views.withColumn("salt", salt)
    return store(views.join(known, (views.id == known.known) & (views.salt == known.other), "left").select("id", "t", "m", "y", "fold"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, seed: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """id, text_score, metadata_score, score, kept, held_out for every row of ``docs``; ``source``, ``lang`` and ``n_chars`` may be absent."""
    rows = tokens(docs, labels, id_col, text_col, label_col, seed=seed)
    shared = docs.sparkSession.sparkContext.broadcast(co_train(rows, rounds))
    scored = rows.select("id", "t", "m").mapInArrow(_score(shared), "id long, text_score double, metadata_score double, score double")
    return scored.select(F.col("id").alias(id_col), "text_score", "metadata_score", "score", (F.col("score") >= 0.5).alias("kept"), held_out("id").alias("held_out"))
