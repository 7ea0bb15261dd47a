"""Queries against their DuckDB oracles on the smallest tables."""

import os

import pytest

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"minhash_signature", "lsh_candidates", "near_dup_pairs", "near_dup_groups"}  # run by the driver
EMPTY = {"crisis_ranking", "export_rows", "streaming_rank", "rank_topics", "rank_topics_3_windows", "score_breakdown", "urgency", "explain_rank", "top_filtered", "snapshot_metrics"}  # too few documents for a topic in the smallest tables


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_integer_ratio"):
        return str(v)
    return round(float(v), 6) + 0.0


def _names():
    from tidemark.plans.more import SQL
    from tidemark.plans.oracles import ORACLES

    return sorted(set(ORACLES | SQL) - SLOW)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    made = {}
    for sf in (SF, LARGER):
        made[sf] = duckdb.connect()
        for t in TABLES:
            path = f"{sf}/{t}.parquet"
            made[sf].sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return made


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
@pytest.mark.parametrize("name", _names())
def test_oracle(spark, duck, name):
    from tidemark.plans.more import QUERIES as MORE
    from tidemark.plans.more import SQL
    from tidemark.plans.oracles import ORACLES
    from tidemark.plans.queries import QUERIES

    sf = LARGER if name in EMPTY else SF
    df = (QUERIES | MORE)[name](spark, sf)
    want = duck[sf].sql((ORACLES | SQL)[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    ours = sorted(str([_plain(v) for v in r]) for r in df.collect())
    assert ours
    assert ours == sorted(str([_plain(r[i]) for i in at]) for r in want.fetchall())
