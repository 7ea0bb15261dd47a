"""Exact search, vector codes and fill-in-middle against brute force."""

import hashlib
import math
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import COLUMNS, frame, rows

from tidemark.llm import fim, topk_search, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=400, width=16, seed=5):
    """Blobs, a hot vector, ties, repeated rows, nulls and broken components."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    out = []
    for i in range(n):
        if i % 3 == 0:
            v = [0.25] * width
        else:
            v = (centres[i % 6] + 0.2 * r.normal(size=width)).astype(np.float32).tolist()
        out.append((i, v, None if i % 5 == 0 else i % 4))
    out += [out[10], out[10], out[20]]
    out += [(n + 100, None, 1), (n + 200, [None] + [0.5] * (width - 1), 1), (n + 300, [float("nan")] * width, 1), (n + 400, [math.inf] + [0.0] * (width - 1), 2), (None, [0.25] * width, 1)]
    out += [(n + 500, [0.25] * (width // 2), 1), (n + 600, [], 2)]
    return out


def whole(data, scale, width):
    out = []
    for i, v, label in data:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            line = [math.floor(float(np.float32(x)) * scale) for x in v]
            out.append((i, line + [0] * (width - len(line)), label))
    return out


def load(spark, data):
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("id", "v", "asks", "group", "region", "home", "near", "rank", "_key", "code", "error", "part")})


def best(data, ask, k, width=16):
    rows_ = whole(data, 1024, width)
    out = []
    for at, (i, q, _) in enumerate(rows_):
        if ask(i):
            scored = sorted((-int(np.dot(q, c)), j is None, j or 0) for other, (j, c, _) in enumerate(rows_) if other != at)
            out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(scored[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("group_rows,regions,k", [(50, 3, 10), (8192, 2048, 10), (20, 2048, 3)])
def test_search(spark, group_rows, regions, k):
    data = vectors()
    got = topk_search.search(load(spark, data), F.col("vec_id") % 10 == 0, k, pivots=5, group_rows=group_rows, regions=regions)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == best(data, lambda i: i is not None and i % 10 == 0, k)


def test_search_few_and_none(spark):
    empty = topk_search.search(load(spark, []), F.col("vec_id") % 100 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    few = [(0, [1.0, 0.5], 1), (7, [0.5, -1.0], 1), (9, [2.0, 2.0], None)]
    got = topk_search.search(load(spark, few), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 9, 1024 * 2048 + 512 * 2048), (0, 2, 7, 0)]
    assert topk_search.search(load(spark, few[:1]), F.col("vec_id") == 0).collect() == []
    assert topk_search.search(load(spark, few), F.col("vec_id") == 5).collect() == []
    with pytest.raises(ValueError, match="long"):
        topk_search.search(load(spark, [(0, [1e18, 1.0], 1), (1, [1.0, 1.0], 1)]), F.col("vec_id") == 0)


def test_search_bounds_hold_and_eliminate():
    """No bound is below a score, and clustered rows are not all evaluated."""
    r = np.random.default_rng(2)
    x = np.floor(1024 * (r.normal(size=(20, 32))[r.integers(0, 20, 5000)] + 0.05 * r.normal(size=(5000, 32)))).astype(np.int64)
    bound = float((x**2).sum(1).max()) * (1 + 1e-9)
    space = topk_search.Space(topk_search.farthest_first(x[:1000], 24, bound), bound)
    near = space.of_rows(x).astype(np.float32)
    seen = 0
    for q in x[::100]:
        away = space.of_queries(q[None])[0]
        most = space.most(q, np.abs(near - away.astype(np.float32)).max(1))
        scores = x @ q
        assert (most >= scores).all()
        found, value, tried = topk_search.evaluate(q, most, topk_search.LOWEST, x, np.arange(5000), np.zeros(5000, bool), 10)
        want = np.lexsort((np.arange(5000), -scores))[:10]
        assert found.tolist() == want.tolist() and value.tolist() == scores[want].tolist()
        seen += tried
    assert seen < 0.5 * 50 * 5000


def lloyd(data, width=16, parts=16, entries=64, rounds=2):
    kept = sorted(whole(data, 256, width), key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    x = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        away = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        code = away.argmin(2)
        if r < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    error = away.min(2).sum(1)
    by = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(map(repr, ((i, "".join(f"{c:02x}" for c in line), e, by[label], digest) for (i, _, label), line, e in zip(kept, code.tolist(), error.tolist(), strict=True))))


@pytest.mark.parametrize("n,block,entries,rounds", [(400, 64, 64, 2), (400, 4096, 9, 4), (30, 7, 64, 2), (60, 16, 1, 1), (50, 16, 8, 0)])
def test_vector_codes(spark, n, block, entries, rounds):
    data = vectors(n, 32)
    got = vector_codes.codes(load(spark, data), block=block, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == lloyd(data, 32, entries=entries, rounds=rounds)


def test_vector_codes_odd_width_empty_and_large(spark):
    data = [(i, [0.1 * i, 1.0 - i, 0.5], i % 2) for i in range(40)]
    wide = [(i, v + [0.0] * 13, l) for i, v, l in data]
    assert sorted(map(repr, map(tuple, vector_codes.codes(load(spark, data)).collect()))) == lloyd(wide)
    assert vector_codes.codes(load(spark, [])).collect() == []
    with pytest.raises(ValueError, match="long"):
        vector_codes.codes(load(spark, [(1, [1e15] * 16, 1), (2, [1.0] * 16, 1)]))


def test_heaps_touch_only_what_may_change():
    """Parts that stay in their heaps keep the entry that a full comparison gives; few are popped when entries move little."""
    r = np.random.default_rng(8)
    x = np.floor(256 * (r.normal(size=(1000, 3, 4)) * 0.05 + r.integers(0, 4, (1000, 3, 1)))).astype(np.int64)
    books = x[:12].transpose(1, 0, 2).copy()
    block, drift = vector_codes.Block.first(x, books), np.zeros(books.shape[:2])
    sums = block.settle(books, drift, 1e-6)
    popped = []
    for _ in range(6):
        new = vector_codes.moved_books(books, sums)
        drift, books = drift + vector_codes.drifts(books, new), new
        block = vector_codes.Block.load(block.dump("int32"), books.shape, "int32")
        popped.append(sum(k <= drift[p, e] for p, position in enumerate(block.heaps) for e, heap in enumerate(position) for k, _ in heap))
        sums = sums + block.settle(books, drift, 1e-6)
        for p in range(3):
            away = ((x[:, p, None] - books[p][None]) ** 2).sum(2)
            assert (block.codes[:, p] == away.argmin(1)).all()
            counts = np.bincount(away.argmin(1), minlength=12)
            assert (sums[p, :, -1] == counts).all()
            assert all(h[i][0] <= h[j][0] for h in block.heaps[p] for i in range(len(h)) for j in (2 * i + 1, 2 * i + 2) if j < len(h))
    assert popped[-1] < 1500


def test_elias_fano():
    r = random.Random(4)
    for n, top in [(0, 0), (1, 0), (1, 1), (1, 10**9), (5, 4), (300, 100), (1000, 10**7), (64, 64)]:
        values = np.array(sorted(r.randint(0, top) for _ in range(n)), np.int64)
        back = fim.EliasFano.from_bytes(fim.EliasFano.of(values).to_bytes())
        assert [back.select(i) for i in range(n)] == values.tolist()
    ends = np.arange(80, 80 * 10_001, 80)
    assert 8 * len(fim.EliasFano.of(ends).to_bytes()) < 9.1 * len(ends)  # log2(80) + 2 bits a line


FIM = rows() + [
    (500, "a\nb\n\nc", "en", "a", 6), (501, "\n", "en", "a", 1), (502, "\n\n\nx", "en", "a", 4), (503, "has <S> in\nit", "en", "a", 12), (504, "ends\n", "en", "a", 5), (505, "é\n你好\n😀 end\r\nx", "en", "a", 9),
    (None, "no id\nat all", "en", "a", 10), (506, "long line " * 30_000 + "\n" + "x\n" * 20_000, "en", "a", 340_000),
] + [(600 + i, "one hot\ntext of\nmany copies\n", "en", "a", 28) for i in range(700)]


def fim_by_hand(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    spm_form = h[3] % 100 < spm
    out = f"<S>{s}<P>{p}<M>{m}" if spm_form else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), "spm" if spm_form else "psm", len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("percent,spm", [(100, 50), (60, 0)])
def test_fim(spark, percent, spm):
    df = frame(spark, FIM).withColumns({c: F.lit("x") for c in ("id", "digest", "content", "ids", "salt", "salts", "n", "form", "output")})
    got = fim.report(df, fim.Rules(fim_percent=percent, spm_percent=spm)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(fim_by_hand(d[0], d[1], percent, spm)) for d in FIM)


def test_fim_colliding_digests_and_index(spark):
    df = frame(spark, FIM)
    weak = lambda text: bytes([len(text) % 3])
    got = fim.transform(df, digest=weak).select("doc_id", "n", "form", "prefix_chars", "middle_chars").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(fim_by_hand(d[0], d[1])[:5]) for d in FIM)
    index = fim.boundaries(df, digest=weak).collect()
    texts = {d[1] or "" for d in FIM}
    assert len(index) == len(texts)
    lists = sorted([fim.EliasFano.from_bytes(r.ends).select(i) for i in range(r.n)] for r in index if r.n < 100)
    want = []
    for t in texts:
        at, ends = 0, []
        for u in re.findall(r"[^\n]*\n|[^\n]+", t):
            at += len(u)
            ends.append(at)
        if len(ends) < 100:
            want.append(ends)
    assert lists == sorted(want)
    assert fim.report(spark.createDataFrame([], COLUMNS)).collect() == []
