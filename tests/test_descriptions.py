"""Description runs: skip, feedback, second model, attempt log; and normalisation of raw messages in one call."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import SummaryConfig
from tidemark.operators import normalize, summarize
from tidemark.streaming import descriptions

NOW = dt.datetime(2024, 1, 2, 12)
PROMPT = "# prompt\n## system\nYou describe topics.\n## user\n```\nSize {size}, {period_start} to {period_end}, {source_types}, {geo_regions}\n{texts}\n```\n"
CONFIG = SummaryConfig(min_words=4, min_phrases=2, max_phrases=4, retries=2, max_documents=3)


def clients():
    """Functions that travel to the tasks with all they use."""

    def learns(system, user):
        """Right once it is told what was wrong."""
        words = user.splitlines()[1].split(". ", 1)[1].split()
        good = f"ОПИСАНИЕ: {' '.join(words[:6])}.\nФРАЗЫ: {' '.join(words[:2])}; {words[3]}"
        ok = system == "You describe topics." and "нарушил правило" in user
        return descriptions.Answer(good if ok else "ОПИСАНИЕ: too short\nФРАЗЫ: a; b", 100, 10, "first")

    def never(system, user):
        return descriptions.Answer("ОПИСАНИЕ: one two three four five\nФРАЗЫ: not there; nor there", 7, 3, "first")

    def times_out(system, user):
        raise TimeoutError("slow")

    return learns, never, times_out


learns, never, times_out = clients()


def frames(spark):
    at = dt.datetime(2024, 1, 1)
    clusters = spark.createDataFrame(
        [(i, i == 4, 10 * i + 10, 1.0 if i != 5 else 3.0, at, NOW, ["North"] if i % 2 else []) for i in range(1, 8)], "cluster_id long, noise boolean, size long, growth_rate double, period_start timestamp_ntz, period_end timestamp_ntz, geo_regions array<string>"
    )
    version = summarize.prompt_version(PROMPT)
    old = [(1, version, 20, NOW - dt.timedelta(hours=1)), (2, "older", 30, NOW), (3, version, 30, NOW), (5, version, 60, NOW - dt.timedelta(hours=7))]
    described = spark.createDataFrame(old, "cluster_id long, prompt_version string, size_then long, generated_at timestamp_ntz")
    docs = [(c, 100 * c + i, f"a{i}", "vk_post" if i else "rss", at + dt.timedelta(minutes=i), f"water pipe broke near house number{c} on the long street {i}", 1.0 - i / 10) for c in range(1, 7) for i in range(5)]
    members = spark.createDataFrame(docs, "cluster_id long, doc_id long, author_id string, source_type string, created_at timestamp_ntz, text string, similarity double")
    return clusters, members, described, clusters.select("cluster_id").filter("cluster_id <> 6").unionByName(clusters.select("cluster_id").limit(2))


def test_run_with_feedback(spark):
    """1 is fresh and skipped; 2 has an old prompt, 3 grew, 5 is old and active; 4 is noise, 6 has not changed, 7 has no documents."""
    out = descriptions.describe(*frames(spark), PROMPT, NOW, (learns, None), CONFIG, price_in=1.0, price_out=10.0)
    got = {r.cluster_id: r for r in out["descriptions"].collect()}
    assert set(got) == {2, 3, 5} and not any(r.needs_review or r.fallback_used for r in got.values())
    assert got[2].summary == "water pipe broke near house number2." and got[2].key_phrases == ["water pipe", "near"] and got[2].sample_doc_ids == [200, 201, 202] and got[3].size_then == 40
    costs = sorted((r.cluster_id, r.attempt_number, r.validation_error, round(r.estimated_cost_usd, 6)) for r in out["costs"].collect())
    assert costs == [(c, n, e, 0.2) for c in (2, 3, 5) for n, e in ((1, "описание слишком короткое"), (2, None))]
    m = out["metrics"].head()
    assert (m.clusters_processed, m.clusters_regenerated, m.clusters_skipped, m.fallback_used_count, m.validation_failed, m.total_input_tokens, m.total_output_tokens) == (4, 3, 1, 0, 0, 600, 60)
    assert round(m.estimated_cost_usd, 6) == 1.2 and {r.cluster_id for r in out["updated"].collect()} == {2, 3, 5}


def test_run_that_never_gets_it_right_and_second_model(spark):
    out = descriptions.describe(*frames(spark), PROMPT, NOW, (never, None), CONFIG)
    assert {(r.needs_review, r.summary) for r in out["descriptions"].collect()} == {(True, "one two three four five.")} and out["costs"].count() == 9
    assert out["metrics"].head().validation_failed == 3
    out = descriptions.describe(*frames(spark), PROMPT, NOW, (times_out, learns), CONFIG)
    assert {r.fallback_used for r in out["descriptions"].collect()} == {True} and out["metrics"].head().fallback_used_count == 3
    with pytest.raises(Exception, match="slow"):
        descriptions.describe(*frames(spark), PROMPT, NOW, (times_out, None), CONFIG)
    stand_in = descriptions.describe(*frames(spark), PROMPT, NOW, config=CONFIG)
    assert stand_in["descriptions"].filter("model_name = 'extractive'").count() == 3


def test_broken_rule_is_validate(spark):
    c = SummaryConfig(min_words=3, max_words=8, min_phrases=2, max_phrases=3)
    texts = ["Пожар в доме  Ёлка", "второй ТЕКСТ про мост"]
    cases = [("", []), ("a b", []), ("a b c d e f g h i", []), ("это скандал и беда", ["a", "b"]), ("a b c d", ["мост"]), ("a b c d", ["мост", "Мост "]), ("a b c d", ["", "мост"]), ("a b c d", ["мост", "река"]), ("a b c d", ["В ДОМЕ", "текст про"]), ("a b c d", ["в доме ёлка", "мост"])]
    rows = summarize.validate(spark.createDataFrame([(i, s, p, texts) for i, (s, p) in enumerate(cases)], "i int, summary string, key_phrases array<string>, documents array<string>"), c).orderBy("i").collect()
    assert [r.invalid_reason for r in rows] == [summarize.broken_rule(s, p, texts, c) for s, p in cases]
    assert [r.invalid_reason is None for r in rows] == [False] * 8 + [True] * 2


def test_raw_message_to_contract(spark):
    """Absent keys come from the message and a present null stays; the message's time goes before a post's date (trap a) and its text into ``message`` (trap b)."""
    at, later = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 11, 0, 0, 250_000)
    raw = [
        ("vk_post", "-2_1", None, "5", "the post", "photo", at, later, True, 7, 1, 2, 3, json.dumps({"id": 1, "owner_id": -2, "from_id": 5, "text": "own text", "date": 1700000000, "likes": {"count": 9}})),
        ("max_post", "9_4", None, "a", "from the message", "text", at, later, False, 5, 0, 0, 0, json.dumps({"id": 4, "channel": {"id": 9}})),
        ("portal_appeal", "77", None, "anonymous", "Title\n\nbody", "text", at, later, False, 0, 0, 0, 0, json.dumps({"appeal_id": 77, "subject": "Title"})),
        ("rss_article", "g", None, "rss", "t", "link", at, later, False, 0, 0, 0, 0, json.dumps({"guid": "g", "title": "t", "author": None, "reach": None})),
        ("vk_post", "empty", None, "6", "no payload", "text", at, later, False, 1, 0, 0, 0, None),
    ]
    fields = "source_type string, source_id string, parent_id string, author_id string, text string, media_type string, created_at_utc timestamp, collected_at timestamp, is_official boolean, reach long, likes long, reposts long, comments_count long, raw_payload string"
    df = spark.createDataFrame(raw, fields)
    payload = json.loads(normalize.with_defaults(df).filter("source_type = 'rss_article'").head().raw_payload)
    assert payload["author"] is None and payload["reach"] is None and payload["body"] == "t" and payload["likes"] == 0 and payload["created_at"].startswith("2024-01-01T10:00:00") and len(payload) == 4 + 15
    got = {r.doc_id: r for r in normalize.contract(df, {"vk_post": {"source": "vk", "is_official": False}}).collect()}
    post = got["vk_post:-2_1"]
    assert post.created_at == at and post.collected_at == later and post.text == "own text" and post.likes == 9 and post.reach == 7 and not post.is_official
    assert got["max_post:9_4"].text == "from the message" and got["max_post:9_4"].reach == 5
    assert got["portal_appeal:77"].text == "Title\n\nTitle\n\nbody"
    assert got["rss_article:g"].reach == 0 and len(got) == 5
    assert [r.text for k, r in got.items() if k.startswith("vk_post:vk")] == ["no payload"]
