"""Fixtures shared by the tests of the training-data operators."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=120, seed=1):
    """Documents with copies, near copies, shared passages, nulls, ties and odd texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage = words(40)
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1 and out:
            text = r.choice(out)[1]
        elif kind < 0.3 and out and out[-1][1]:
            w = out[-1][1].split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind < 0.45:
            text = " ".join(words(15) + passage + words(r.randint(0, 15)))
        else:
            text = " ".join(words(r.randint(1, 120))) + r.choice(["", "\n", "  tail", "\t\x0bÉ ß 你好 x"])
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", "é", None]), len(text or "")))
    out += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t", "en", "a", 3), (n + 3, "one two", "en", "b", 7), (n + 4, "ONE two", "en", "b", 7)]
    out += [out[3], out[3]]  # repeated rows
    out += [(n + 5, " ".join(words(9000)), "en", "b", 50_000)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, COLUMNS).repartition(3)
