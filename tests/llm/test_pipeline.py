"""The pipeline's stages on small tables."""

import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from helpers import frame, rows


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = rows(80, seed=9)
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        (out := stage(spark, docs, str(tmp_path))).write.parquet(path)
        assert out.columns == columns
        docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} <= before
    want = Counter((r.doc_id, r.text) for r in docs.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(4 * r.n_tokens == len(r.ids) for r in got)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on all that its predecessor kept: toxic documents, copies and near copies go, the mix keeps
    its targets, ids are the library's; every decision is in the rows that run() returns."""
    import random
    import re

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import corpus_pipeline

    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(4, 8))) for _ in range(600)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    data, labels, toxic = [], [], set()
    for i in range(240):
        w = words(r.randint(40, 80))
        if i % 4 == 2:
            w[3:3] = ["you", "worthless", "disgusting", "vermin", "scum"]
            toxic.add(i)
        elif i % 10 == 1:  # a near copy of a clean document
            w = data[r.choice([j for j in range(i) if j not in toxic])][1].split()
            w[5] = "changedword"
        text = data[i - 2][1].replace(" ", "\n") if i % 10 == 3 else "  ".join(w)  # or a copy but for spaces
        data.append((i, text, "en", "ab"[i % 2], len(text)))
        labels.append((i, 1, int(i in toxic)))
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    clean = {i: t for i, t, *_ in data if i not in toxic}
    single = {}
    for i in sorted(clean):
        single.setdefault(" ".join(split(clean[i])), i)
    ids = sorted(single.values())
    sets = {i: {tuple(w[k : k + 5]) for w in [split(clean[i].lower())] for k in range(len(w) - 4)} for i in ids}
    label = {i: i for i in ids}
    for x in ids:
        for y in ids:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((label[x], label[y]))
                label = {k: a if v == b else v for k, v in label.items()}
    stay = [{i for i in clean}, set(ids), {i for i in ids if label[i] == i}]
    assert len(data) > len(stay[0]) > len(stay[1]) > len(stay[2])

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], stay, strict=False):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        assert {d.doc_id for d in docs.collect()} == want, name

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(d.doc_id for d in got)
    assert set(times) <= stay[2] and max(times.values()) <= 3
    size = {i: len(split(clean[i])) for i in stay[2]}
    whole = {s: sum(n for i, n in size.items() if "ab"[i % 2] == s) for s in "ab"}
    first = min(sum(size.values()) / 3, 3 * whole["a"])
    target = {"a": first, "b": min(sum(size.values()) - first, 3 * whole["b"])}
    for s in "ab":
        assert abs(sum(n * size[i] for i, n in times.items() if "ab"[i % 2] == s) - target[s]) <= max(size.values())
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(corpus_pipeline.VOCABULARY), special_tokens={})
    for d in got:
        want = library.encode_ordinary(clean[d.doc_id])
        assert d.ids == b"".join(t.to_bytes(4, "little") for t in want) and (d.n_tokens, d.text) == (len(want), clean[d.doc_id])


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, one id for two texts: what is no copy and has words stays; so does an empty table."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(30))
    data = [(None, long, "en", "a", 9), (None, "alone without an id", None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 9), (3, "another text of one id", "en", "a", 5), (4, "x y z", "en", "a", 5), (4, "x y z", "en", "a", 5)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) <= {(None, "alone without an id"), (3, long), (3, "another text of one id"), (4, "x y z")} and max(got.values()) <= 3
    taken = {source: sum(n * len(t.split()) for (i, t), n in got.items() if (i is None) == (source is None)) for source in (None, "a")}
    assert taken[None] == 12 and abs(taken["a"] - 30) <= 3  # targets of 4 and 38 words: 28, cut to 12, and the rest
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), Counter((r[0], r[1]) for r in {*data})
    for _, stage in corpus_pipeline.STAGES[:3]:  # rows that repeat are one document, once copies are dropped
        docs = stage(spark, docs, str(tmp_path))
    del want[None, long], want[2, ""]  # copies of another row
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == want
    frame(spark, []).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
