"""DuckDB SQL for the queries that SQL can state on whole tables."""

from __future__ import annotations

from tidemark.config import DedupConfig

DOCS = """
docs AS (SELECT event_id AS doc_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS cluster_id, user_id AS author_id, event_type AS source_type, ts AS created_at,
  CAST(floor(value) AS BIGINT) AS reach, n_name AS region, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS qw,
  CASE event_type WHEN 'click' THEN 0.25 WHEN 'error' THEN -0.75 WHEN 'purchase' THEN 0.75 WHEN 'signup' THEN 0.0 WHEN 'view' THEN -0.25 END::DOUBLE AS mood,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('c', user_id % 4) END AS category, concat('C', user_id % 4) AS category_label
  FROM events LEFT JOIN nation ON n_nationkey = user_id % 25)"""
RANK = DOCS + """,
periods AS (SELECT unnest([6, 24, 72]) AS period_hours),
win AS (SELECT p.period_hours, d.* FROM docs d JOIN periods p ON d.created_at BETWEEN TIMESTAMP '2024-01-30' - to_hours(p.period_hours) AND TIMESTAMP '2024-01-30'),
agg AS (SELECT period_hours, cluster_id, count(*) AS size, sum(qw) AS weighted_size, count(DISTINCT author_id) AS unique_authors, count(DISTINCT source_type) AS unique_sources,
  CAST(round_even(sum(reach * qw), 0) AS BIGINT) AS reach_total, min(created_at) AS earliest, max(created_at) AS latest,
  list_sort(list(DISTINCT region) FILTER (WHERE region IS NOT NULL)) AS regions,
  sum(CASE WHEN created_at >= TIMESTAMP '2024-01-29 18:00:00' THEN qw ELSE 0 END)
   / greatest(sum(CASE WHEN created_at >= TIMESTAMP '2024-01-29 12:00:00' AND created_at < TIMESTAMP '2024-01-29 18:00:00' THEN qw ELSE 0 END), 1.0) AS growth_rate,
  sum(mood * greatest(reach * qw, qw)) / sum(greatest(reach * qw, qw)) AS sentiment_score
  FROM win GROUP BY ALL),
judged AS (SELECT p.period_hours, c.cluster_id, CASE WHEN a.size IS NULL THEN 'empty_window' WHEN c.cluster_id = 3 THEN 'missing_description' WHEN c.cluster_id = 7 THEN 'noise_cluster'
  WHEN a.size < 10 THEN 'too_small' WHEN a.latest < TIMESTAMP '2024-01-28' THEN 'stale' WHEN c.cluster_id = 5 THEN 'needs_review' END AS reason,
  a.* EXCLUDE (period_hours, cluster_id) FROM periods p CROSS JOIN (SELECT unnest(range(12)) AS cluster_id) c LEFT JOIN agg a ON a.period_hours = p.period_hours AND a.cluster_id = c.cluster_id),
kept AS (SELECT * FROM judged WHERE reason IS NULL),
tot AS (SELECT period_hours, count(DISTINCT r) AS total_regions FROM (SELECT period_hours, unnest(regions) AS r FROM kept) GROUP BY period_hours),
parts AS (SELECT k.*, ln(1 + weighted_size) / max(ln(1 + weighted_size)) OVER w AS volume_score,
  CASE WHEN growth_rate <= 1 THEN greatest(0.0, (growth_rate - 0.5) / 0.5) * 0.3 ELSE least(1.0, ln(growth_rate) / ln(5.0)) END AS dynamics_score,
  (1 - greatest(-1.0, least(1.0, sentiment_score))) / 2 AS sentiment_part,
  CASE WHEN max(reach_total) OVER w > 0 THEN ln(1 + greatest(reach_total, 0)) / max(ln(1 + greatest(reach_total, 0))) OVER w ELSE 0.0 END AS reach_score,
  least(1.0, len(regions) / greatest(total_regions * 0.3, 1.0)) AS geo_score, least(1.0, unique_sources / 4.0) AS source_score
  FROM kept k JOIN tot USING (period_hours) WINDOW w AS (PARTITION BY period_hours)),
scored AS (SELECT *, greatest(0.0, least(1.0, volume_score * 0.25 + dynamics_score * 0.25 + sentiment_part * 0.2 + reach_score * 0.15 + geo_score * 0.1 + source_score * 0.05)) AS score FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period_hours ORDER BY score DESC, size DESC, reach_total DESC, cluster_id) AS rank,
  earliest > TIMESTAMP '2024-01-29 21:00:00' AS is_new, growth_rate > 2.0 AS is_growing FROM scored)"""

WORDS = "list_filter(string_split_regex({0}, '[\\s\\x1c-\\x1f]+'), lambda w: w != '')"


def timeline(weight: str) -> str:
    return f"""WITH {DOCS}, counted AS (SELECT cluster_id, date_trunc('hour', created_at) AS hour, sum({weight}) AS n, sum(reach * {weight}) AS r FROM docs
      WHERE created_at >= TIMESTAMP '2024-01-27 01:00:00' AND created_at < TIMESTAMP '2024-01-30 01:00:00' GROUP BY ALL),
    grid AS (SELECT cluster_id, hour FROM (SELECT DISTINCT cluster_id FROM docs) CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-27 01:00:00', TIMESTAMP '2024-01-30', INTERVAL 1 HOUR)) AS hour)),
    filled AS (SELECT cluster_id, hour, coalesce(n, 0.0)::DOUBLE AS n, coalesce(r, 0.0)::DOUBLE AS r FROM grid LEFT JOIN counted USING (cluster_id, hour)),
    lagged AS (SELECT *, lag(n, 1, 0.0) OVER (PARTITION BY cluster_id ORDER BY hour) AS p FROM filled)
    SELECT cluster_id, hour, CAST(round_even(n, 0) AS BIGINT) AS count, CAST(round_even(r, 0) AS BIGINT) AS reach, round(CASE WHEN p != 0 OR n != 0 THEN n / greatest(p, 1.0) ELSE 0.0 END, 6) AS growth_rate FROM lagged"""


def bursts(key: str, minutes: int, threshold: int) -> str:
    return f"""WITH {DOCS}, b AS (SELECT doc_id, {key} AS k, created_at AS t, count(*) OVER w AS n, min(created_at) OVER w AS ws FROM docs
      WINDOW w AS (PARTITION BY {key} ORDER BY created_at RANGE BETWEEN INTERVAL {minutes} MINUTES PRECEDING AND CURRENT ROW)),
    f AS (SELECT doc_id, max(CASE WHEN n >= {threshold} THEN {{'n': n, 'we': t, 'ws': ws}} END) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN CURRENT ROW AND INTERVAL {minutes} MINUTES FOLLOWING) AS best FROM b)
    SELECT doc_id, best.n AS size, best.ws AS window_start, best.we AS window_end, round(greatest(0.0, least(1.0, 0.8 + 0.2 * (best.n - {threshold}) / {threshold}.0)), 6)::DOUBLE AS confidence FROM f WHERE best IS NOT NULL"""


TEXT = "lower(trim(regexp_replace(coalesce(text, ''), '[\\s\\x1c-\\x1f]+', ' ', 'g')))"
FILTERED = f"""f AS (SELECT doc_id, doc_id % 10 = 0 AS official, {TEXT} AS t FROM documents),
 j AS (SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, 'buy now|free offer|subscribe|#ad|#sale') THEN 'spam_signature'
  WHEN length(t) < 8 AND NOT regexp_matches(t, 'fire|bridge') AND (t IN ('ok', 'test', '...') OR len(string_split(t, ' ')) <= 2) THEN 'short_noise'
  WHEN length(t) >= 20 AND regexp_matches(t, 'is it|not |again|problem') AND NOT official THEN 'complaint_like' END AS reason FROM f),
 s AS (SELECT doc_id, coalesce(reason, '') AS filter_reasons, CASE WHEN reason IN ('spam_signature', 'short_noise') THEN 'drop' WHEN reason IS NOT NULL THEN 'review' ELSE 'pass' END AS filter_status FROM j),
 w AS (SELECT *, CASE filter_status WHEN 'drop' THEN 0.0 WHEN 'review' THEN 0.6 ELSE 1.0 END::DOUBLE AS quality_weight FROM s)"""

STEMS = """s AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zа-яё]+'), lambda w: regexp_replace(w,
 '^(.{3,}?)(?:иями|ями|ами|иях|его|ому|ыми|ими|ого|ему|ах|ях|ий|ый|ой|ая|яя|ое|ее|ые|ие|ам|ям|ом|ем|ов|ев|ую|юю|ей|а|я|ы|и|у|ю|е|о|ь)$', '\\1')) AS toks FROM documents)"""

SHINGLED = """n AS (SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\s\\x1c-\\x1f]+', ' ', 'g')) AS t FROM documents),
 firsts AS (SELECT min(d.doc_id) AS doc_id, any_value(t) AS t FROM n JOIN documents d USING (doc_id) GROUP BY coalesce(text, '')),
 sh AS (SELECT doc_id, CASE WHEN length(t) <= 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) END AS s FROM {src})"""
SIGNED = ", sg AS (SELECT doc_id, k, list_min(list_transform(s, lambda x: substr(sha256(concat(k, ':', x)), 1, 16))) AS m FROM sh CROSS JOIN (SELECT unnest(range(64)) AS k))"
BANDED = ", bk AS (SELECT doc_id, k // 4 AS band, string_agg(m, '' ORDER BY k) AS bucket FROM sg GROUP BY ALL), cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bk x JOIN bk y USING (band, bucket) WHERE x.doc_id < y.doc_id)"
THRESHOLD = DedupConfig().threshold
PAIRS = f""", pairs AS (SELECT a, b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS similarity FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b),
 near AS (SELECT a, b, similarity FROM pairs WHERE similarity >= {THRESHOLD})"""

UNIT = "u AS (SELECT vec_id AS doc_id, label AS cluster_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings)"


def centroid(name: str, where: str = "true") -> str:
    return f"""{name}_m AS (SELECT cluster_id, i, avg(x) AS m, count(*) AS n FROM (SELECT cluster_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u WHERE {where}) GROUP BY ALL),
 {name}_l AS (SELECT cluster_id, sqrt(sum(m * m)) AS len, max(n) AS size FROM {name}_m GROUP BY ALL),
 {name} AS (SELECT cluster_id, max(size) AS size, list(m / len ORDER BY i) AS centroid FROM {name}_m JOIN {name}_l USING (cluster_id) GROUP BY ALL)"""


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
ONLINE = f"""WITH {UNIT}, {centroid('c', 'TRUE')},
 s AS (SELECT u.doc_id, c.cluster_id, {DOT.format('u.e', 'c.centroid')} AS s FROM u CROSS JOIN c),
 b AS (SELECT doc_id, arg_max(cluster_id, s) AS cluster_id, greatest(0.0, least(1.0, max(s))) AS s FROM s GROUP BY doc_id) """

BASE = "c AS (SELECT c_custkey AS doc_id, c_nationkey * 3.0 AS lat, (c_custkey % 120 - 20)::DOUBLE AS lon FROM customer)"



def shifted(sql: str, hours: int) -> str:
    """The same SQL as of some hours earlier."""
    import datetime as dt
    import re

    return re.sub(r"TIMESTAMP '([^']+)'", lambda m: f"TIMESTAMP '{dt.datetime.fromisoformat(m[1]) - dt.timedelta(hours=hours)}'", sql)


#: Greedy matching, best pair first; ids of pairs taken so far.
GREEDY = f"""WITH RECURSIVE {UNIT}, {centroid('n')}, {centroid('o', 'doc_id % 2 = 0')},
 p AS (SELECT n.cluster_id AS new_id, o.cluster_id AS old_id, {DOT.format('n.centroid', 'o.centroid')} AS sim FROM n CROSS JOIN o),
 q AS (SELECT *, row_number() OVER (ORDER BY sim DESC, new_id DESC, old_id DESC) AS i FROM p WHERE sim >= 0.5),
 g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS news, []::BIGINT[] AS olds UNION ALL
  SELECT q.i, CASE WHEN list_contains(news, new_id) OR list_contains(olds, old_id) THEN news ELSE list_append(news, new_id) END,
   CASE WHEN list_contains(news, new_id) OR list_contains(olds, old_id) THEN olds ELSE list_append(olds, old_id) END FROM g JOIN q ON q.i = g.i + 1),
 f AS (SELECT unnest(news) AS new_id, unnest(olds) AS old_id FROM (SELECT * FROM g ORDER BY i DESC LIMIT 1))"""
#: Least document reachable over near pairs between first documents.
GROUPS = f"""WITH RECURSIVE {SHINGLED.format(src='firsts')}{SIGNED}{BANDED}{PAIRS}, e AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
 r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), comp AS (SELECT node, min(seen) AS c FROM r GROUP BY node),
 d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
 m AS (SELECT d.doc_id, text_sha256, coalesce(c, first) AS grp, c IS NOT NULL AS near_duplicate_flag FROM d LEFT JOIN comp ON node = first)"""
TRIMMED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

ORACLES = {
    "snapshot_metrics": f"""WITH now_ AS (WITH {RANK} SELECT period_hours, cluster_id, rank, score FROM ranked WHERE rank <= 5), then_ AS (WITH {shifted(RANK, 6)} SELECT period_hours, cluster_id FROM ranked WHERE rank <= 5)
      SELECT period_hours, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(coalesce(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 0.0), 6) AS score_gap,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM then_ t WHERE t.period_hours = n.period_hours AND t.cluster_id = n.cluster_id))::INTEGER AS new_entries,
       (SELECT count(*) FROM then_ t WHERE t.period_hours = n.period_hours AND t.cluster_id NOT IN (SELECT x.cluster_id FROM now_ x WHERE x.period_hours = n.period_hours))::INTEGER AS dropped_entries
      FROM now_ n GROUP BY period_hours""",
    "reconcile_clusters": GREEDY + " SELECT new_id, old_id, round(sim, 5) AS similarity FROM f JOIN p USING (new_id, old_id)",
    "near_dup_groups": GROUPS + """ SELECT doc_id, text_sha256, min(doc_id) OVER w AS duplicate_group_id, min(doc_id) OVER w AS canonical_doc_id, count(*) OVER w AS duplicate_cluster_size, near_duplicate_flag FROM m WINDOW w AS (PARTITION BY grp)""",
    "representative_docs": f"""WITH {UNIT}, {centroid('c')}, s AS (SELECT u.cluster_id, u.doc_id, source AS author, round({DOT.format('e', 'centroid')}, 5) AS sim, rtrim(substr({TRIMMED.format("coalesce(text, '')")}, 1, 500), E' \n\t\r') AS t
       FROM u JOIN c USING (cluster_id) JOIN documents d ON d.doc_id = u.doc_id),
      a AS (SELECT *, ceil(length(t) / 4.0)::INTEGER AS tokens, row_number() OVER (PARTITION BY cluster_id, author ORDER BY sim DESC, doc_id) AS n FROM s),
      r AS (SELECT *, row_number() OVER w AS position, sum(tokens) OVER w AS total, first_value(tokens) OVER w AS f FROM a WHERE n <= 3 WINDOW w AS (PARTITION BY cluster_id ORDER BY sim DESC, doc_id))
      SELECT cluster_id, doc_id, position::INTEGER AS position, tokens FROM r WHERE CASE WHEN f > 1200 THEN position = 1 ELSE total <= 1200 AND position <= 12 END""",
    "annotate_language": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+'), lambda w: w != '') AS w FROM documents),
      l AS (SELECT doc_id, t, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Cyrillic}]', '', 'g')) AS cyr, [
       {'n': len(list_filter(w, lambda x: x IN ('the', 'and', 'of', 'to', 'in', 'that', 'is', 'for', 'on', 'with'))), 'l': 'en'},
       {'n': len(list_filter(w, lambda x: x IN ('der', 'die', 'das', 'und', 'ist', 'nicht', 'von', 'mit', 'den', 'ein'))), 'l': 'de'},
       {'n': len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'des', 'et', 'est', 'une', 'pour', 'dans', 'que'))), 'l': 'fr'},
       {'n': len(list_filter(w, lambda x: x IN ('el', 'los', 'las', 'una', 'que', 'con', 'para', 'por', 'del', 'como'))), 'l': 'es'}] AS c FROM t),
      b AS (SELECT *, list_max(c) AS best, list_sum(list_transform(c, lambda x: x.n)) AS total FROM l),
      k AS (SELECT doc_id, CASE WHEN letters = 0 THEN 'unknown' WHEN cyr * 2 > letters THEN 'ru' WHEN total > 0 THEN best.l ELSE 'unknown' END AS language,
       CASE WHEN letters = 0 THEN 0.0 WHEN cyr * 2 > letters THEN cyr / letters WHEN total > 0 THEN best.n / total ELSE 0.0 END AS conf FROM b)
      SELECT doc_id, language, round(conf, 6)::DOUBLE AS language_confidence, language IN ('en', 'de', 'fr', 'es') AS is_supported_language FROM k""",
    "extract_page_links": r"""WITH h AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 1) AS s, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS h, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS d,
       list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1), lambda x: trim(x)) AS a FROM pages),
      u AS (SELECT page_id, h, list_transform(list_filter(a, lambda x: x != '' AND NOT starts_with(x, '#')), lambda x: CASE WHEN regexp_matches(x, '(?i)^https?://') THEN x WHEN starts_with(x, '//') THEN concat(s, ':', x)
       WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL WHEN starts_with(x, '/') THEN concat(s, '://', h, x) ELSE concat(s, '://', h, CASE WHEN d = '' THEN '/' ELSE d END, x) END) AS l FROM h),
      p AS (SELECT page_id, h, list_transform(list_filter(l, lambda x: x IS NOT NULL), lambda x: regexp_replace(regexp_extract(x, '^([^?#]*)', 1), '/+$', '')) AS l FROM u),
      o AS (SELECT page_id, list_filter(l, lambda x: contains(regexp_extract(x, '^https?://([^/]+)', 1), h) AND NOT regexp_matches(x, '(?i)\.(?:jpg|jpeg|png|gif|webp|pdf)$')) AS l FROM p),
      e AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM o), f AS (SELECT page_id, x, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) AS n FROM e GROUP BY page_id, x)
      SELECT page_id, count(*) AS n_links, min(x) AS first_link FROM f WHERE n <= 15 GROUP BY page_id""",
    "rank_topics": f"""WITH {RANK} SELECT period_hours, cluster_id, rank, round(score, 6) AS score, size, weighted_size, unique_authors, unique_sources, reach_total, round(growth_rate, 6) AS growth_rate,
      round(sentiment_score, 6) AS sentiment_score, array_to_string(regions, ',') AS geo_regions, is_new, is_growing FROM ranked WHERE period_hours = 24""",
    "rank_topics_3_windows": f"WITH {RANK} SELECT period_hours, cluster_id, rank, round(score, 6) AS score, size, reach_total FROM ranked",
    "rank_exclusions": f"WITH {RANK} SELECT period_hours, reason, count(*) AS clusters FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "score_breakdown": f"""WITH {RANK} SELECT period_hours, cluster_id, round(volume_score, 6) AS volume_score, round(dynamics_score, 6) AS dynamics_score, round(sentiment_part, 6) AS sentiment_score,
      round(reach_score, 6) AS reach_score, round(geo_score, 6) AS geo_score, round(source_score, 6) AS source_score FROM ranked""",
    "urgency": f"""WITH {RANK}, x AS (SELECT *, CASE WHEN len(regions) >= 5 THEN concat('охватывает ', len(regions), ' районов') END AS wide FROM ranked)
      SELECT period_hours, cluster_id, CASE WHEN growth_rate >= 5 OR (is_new AND size >= 100) OR (wide IS NOT NULL AND sentiment_part < -0.6) THEN 'critical' WHEN score >= 0.7 OR is_growing THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS urgency,
      CASE WHEN growth_rate >= 5 THEN concat('рост в ', printf('%.1f', growth_rate), 'x за 6 часов') WHEN is_new AND size >= 100 THEN concat('новая тема с ', size, ' упоминаниями за 3 часа')
       WHEN wide IS NOT NULL AND sentiment_part < -0.6 THEN wide WHEN score >= 0.7 THEN concat_ws('; ', wide, concat('высокий суммарный балл ', printf('%.2f', score))) WHEN is_growing THEN concat_ws('; ', wide, 'активный рост')
       WHEN score >= 0.4 THEN 'устойчивое упоминание' ELSE 'фоновый уровень' END AS urgency_reason FROM x""".replace("sentiment_part < -0.6", "sentiment_score < -0.6"),
    "explain_rank": f"""WITH {RANK}, f AS (SELECT period_hours, cluster_id, unnest([{{'v': -volume_score * 0.25, 'i': 0, 'n': 'объём упоминаний'}}, {{'v': -dynamics_score * 0.25, 'i': 1, 'n': 'динамика роста'}}, {{'v': -sentiment_part * 0.2, 'i': 2, 'n': 'негативная тональность'}},
       {{'v': -reach_score * 0.15, 'i': 3, 'n': 'охват аудитории'}}, {{'v': -geo_score * 0.1, 'i': 4, 'n': 'гео-покрытие'}}, {{'v': -source_score * 0.05, 'i': 5, 'n': 'разнообразие источников'}}]) AS s FROM ranked),
      t AS (SELECT period_hours, cluster_id, s, row_number() OVER (PARTITION BY period_hours, cluster_id ORDER BY s.v, s.i) AS k FROM f),
      g AS (SELECT period_hours, cluster_id, string_agg(s.n, ' и ' ORDER BY k) AS factors FROM t WHERE k <= 2 GROUP BY ALL)
      SELECT period_hours, cluster_id, concat('Ранг ', rank, ': ', concat_ws('; ', concat(size, ' упоминаний'), CASE WHEN is_new THEN 'тема появилась менее 3 часов назад' END,
       CASE WHEN is_growing THEN concat('рост в ', printf('%.1f', growth_rate), 'x за последние 6 часов') END, CASE WHEN len(regions) > 1 THEN concat('охватывает ', len(regions), ' районов') END), '. Основные факторы: ', factors, '.') AS explanation
      FROM ranked JOIN g USING (period_hours, cluster_id)""",
    "topic_timeline_72h": timeline("qw"),
    "topic_timeline_unweighted": timeline("1.0"),
    "topic_sources": f"""WITH {RANK}, s AS (SELECT period_hours, cluster_id, source_type, count(*) AS count FROM win GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY period_hours, cluster_id ORDER BY count DESC, source_type) AS ordinal FROM s""",
    "topic_samples": f"""WITH {RANK}, o AS (SELECT period_hours, cluster_id, doc_id, row_number() OVER (PARTITION BY period_hours, cluster_id ORDER BY CASE WHEN doc_id % 97 = 0 THEN doc_id % 13 ELSE 2147483647 END, created_at DESC, doc_id DESC) AS ordinal FROM win)
      SELECT *, ordinal <= 5 AS is_post FROM o WHERE ordinal <= 20""",
    "topic_category": f"""WITH {RANK}, k AS (SELECT period_hours, cluster_id, coalesce(category, 'other') AS category, sum(qw) AS weight, arg_min(category_label, {{'a': created_at, 'b': doc_id}}) AS category_label FROM win GROUP BY ALL)
      SELECT period_hours, cluster_id, category, category_label, weight FROM k QUALIFY row_number() OVER (PARTITION BY period_hours, cluster_id ORDER BY weight DESC, category) = 1""",
    "weighted_sentiment": f"WITH {RANK} SELECT period_hours, cluster_id, round(sentiment_score, 6) AS sentiment_score FROM agg",
    "weighted_growth": f"WITH {RANK} SELECT period_hours, cluster_id, round(growth_rate, 6) AS growth_rate FROM agg",
    "author_burst": bursts("author_id", 720, 3),
    "velocity_flood": bursts("cluster_id", 30, 2),
    "bot_timing": f"""WITH {DOCS}, g AS (SELECT doc_id, author_id AS k, created_at AS t, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY author_id ORDER BY created_at, doc_id) >= INTERVAL 7200 SECONDS THEN 1 ELSE 0 END AS gap FROM docs),
      s AS (SELECT *, sum(gap) OVER (PARTITION BY k ORDER BY t, doc_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
      b AS (SELECT *, count(*) OVER w AS n, min(sid) OVER w AS lo, max(sid) OVER w AS hi, min(t) OVER w AS ws FROM s WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN INTERVAL 720 MINUTES PRECEDING AND CURRENT ROW)),
      f AS (SELECT doc_id, max(CASE WHEN n >= 2 AND lo = hi THEN {{'n': n, 'we': t, 'ws': ws}} END) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN CURRENT ROW AND INTERVAL 720 MINUTES FOLLOWING) AS best FROM b)
      SELECT doc_id, best.n AS size, best.ws AS window_start, best.we AS window_end FROM f WHERE best IS NOT NULL""",
    "history_buckets_6h": """SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS bucket, event_id AS snapshot_id, ts AS computed_at FROM events
      QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') ORDER BY ts DESC, event_id DESC) = 1""",
    "latest_snapshot_asof": "SELECT o_orderkey AS ranking_id, o_orderdate AS computed_at, 24 AS period_hours FROM orders WHERE o_orderkey % 3 = 1 AND o_orderdate <= TIMESTAMP '1996-06-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "filter_content": f"WITH {FILTERED} SELECT doc_id, filter_status, filter_reasons, quality_weight FROM w",
    "filter_baseline": f"WITH {FILTERED} SELECT filter_status, quality_weight, count(*) AS documents FROM w GROUP BY ALL",
    "clean_text": r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t0 FROM documents), b AS (SELECT *, regexp_replace(t0, '(?i)(?:https?://|www\.)\S+', ' ', 'g') AS t1 FROM a),
      c AS (SELECT *, regexp_replace(t1, '(^|[^\p{L}\p{N}_])@[A-Za-z0-9_][A-Za-z0-9_.-]*', '\1USER', 'g') AS t2 FROM b), d AS (SELECT *, trim(regexp_replace(t2, '[\s\x1c-\x1f]+', ' ', 'g')) AS t3 FROM c)
      SELECT doc_id, sha256(t3) AS normalized_sha, CASE WHEN t3 = '' THEN 0 ELSE len(string_split(t3, ' ')) END AS token_count,
      concat_ws(',', CASE WHEN t0 != t1 THEN 'url_removed' END, CASE WHEN t1 != t2 THEN 'mention_normalized' END, CASE WHEN t2 != t3 THEN 'whitespace_normalized' END) AS cleanup_flags FROM d""",
    "stem_tokens": f"WITH {STEMS} SELECT stem, count(*) AS n FROM (SELECT unnest(toks) AS stem FROM s) GROUP BY stem",
    "classify_document": f"""WITH {STEMS}, kw AS (SELECT * FROM (VALUES ('articles', 'the', 1), ('articles', 'der', 1), ('articles', 'le', 1), ('articles', 'el', 1), ('links', 'and', 1), ('links', 'und', 1), ('links', 'et', 1), ('links', 'y', 1), ('links', 'of the', 2),
       ('places', 'on', 1), ('places', 'in', 1), ('places', 'dans', 1), ('places', 'en la', 2), ('places', 'auf', 1)) v(category, gram, width)),
      g AS (SELECT doc_id, unnest(toks) AS gram FROM s UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(toks)), lambda i: concat(toks[i], ' ', toks[i + 1]))) FROM s),
      h AS (SELECT doc_id, category, count(*) AS hits FROM g JOIN kw USING (gram) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, category) AS k FROM h),
      one AS (SELECT * FROM r WHERE k = 1), two AS (SELECT * FROM r WHERE k = 2)
      SELECT d.doc_id, coalesce(one.category, 'other') AS category, CASE coalesce(one.category, 'other') WHEN 'articles' THEN 'Articles' WHEN 'links' THEN 'Links' WHEN 'places' THEN 'Places' ELSE 'Other' END AS category_label,
      round(coalesce(one.hits / (one.hits + 1), 1.0), 6) AS category_confidence, CASE WHEN one.hits - two.hits < 2 THEN two.category END AS secondary_category, coalesce(one.hits, 0) AS hits
      FROM documents d LEFT JOIN one ON d.doc_id = one.doc_id LEFT JOIN two ON d.doc_id = two.doc_id""",
    "text_fingerprint": r"""SELECT doc_id, sha256(trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\s\x1c-\x1f]+', ' ', 'g'))) AS fingerprint,
      substr(trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g')), 1, 200) AS preview FROM documents""",
    "exact_dedup_groups": """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents), g AS (SELECT text_sha256, min(doc_id) AS canonical_doc_id, count(*) AS duplicate_cluster_size FROM h GROUP BY ALL)
      SELECT doc_id, text_sha256, canonical_doc_id, duplicate_cluster_size FROM h JOIN g USING (text_sha256)""",
    "shingle_stats": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\s\x1c-\x1f]+', ' ', 'g')) AS t FROM documents)
      SELECT doc_id, CASE WHEN length(t) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) END::INTEGER AS n_shingles FROM t""",
    "minhash_signature": f"WITH {SHINGLED.format(src='n')}{SIGNED} SELECT doc_id, sha256(string_agg(m, '' ORDER BY k)) AS signature_sha FROM sg GROUP BY doc_id",
    "lsh_candidates": f"WITH {SHINGLED.format(src='firsts')}{SIGNED}{BANDED} SELECT a, b FROM cand",
    "near_dup_pairs": f"WITH {SHINGLED.format(src='firsts')}{SIGNED}{BANDED}{PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM near",
    "geo_bbox": f"""WITH {BASE} SELECT doc_id, CASE WHEN lat BETWEEN 0 AND 30 AND lon BETWEEN -20 AND 40 THEN 'r0' ELSE 'r1' END AS region_id,
      CASE WHEN lat BETWEEN 0 AND 30 AND lon BETWEEN -20 AND 40 THEN NULL ELSE 'm1' END AS municipality_id, 1.0::DOUBLE AS geo_confidence FROM c WHERE (lat BETWEEN 0 AND 30 AND lon BETWEEN -20 AND 40) OR (lat BETWEEN 20 AND 60 AND lon BETWEEN 0 AND 90)""",
    "geo_toponym": r"""WITH t AS (SELECT doc_id, concat(' ', trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\s\x1c-\x1f]+', ' ', 'g')), ' ') AS t FROM documents),
      m AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[^\p{L}\p{N}\p{M}_]the and[^\p{L}\p{N}\p{M}_]') THEN 0 WHEN regexp_matches(t, '[^\p{L}\p{N}\p{M}_]of the[^\p{L}\p{N}\p{M}_]') THEN 2
       WHEN regexp_matches(t, '[^\p{L}\p{N}\p{M}_]der[^\p{L}\p{N}\p{M}_]') THEN 1 WHEN regexp_matches(t, '[^\p{L}\p{N}\p{M}_]la[^\p{L}\p{N}\p{M}_]') THEN 3 END AS g FROM t)
      SELECT doc_id, 't' || g AS region_id, CASE g WHEN 2 THEN 'm2' END AS municipality_id, CASE WHEN g = 3 THEN 0.5 WHEN g IS NOT NULL THEN 0.85 END::DOUBLE AS geo_confidence FROM m""",
    "geo_priority": r"""WITH t AS (SELECT doc_id, lang IN ('en', 'de') AS reads, concat(' ', trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\s\x1c-\x1f]+', ' ', 'g')), ' ') AS t,
       CASE WHEN doc_id % 5 = 0 THEN doc_id % 80 END AS lat, doc_id % 100 AS lon FROM documents),
      m AS (SELECT doc_id, reads, CASE WHEN lat BETWEEN 0 AND 30 AND lon BETWEEN -20 AND 40 THEN 'r0' WHEN lat BETWEEN 20 AND 60 AND lon BETWEEN 0 AND 90 THEN 'r1' END AS box,
       reads AND regexp_matches(t, '[^\p{L}\p{N}\p{M}_]the and[^\p{L}\p{N}\p{M}_]') AS named FROM t)
      SELECT doc_id, coalesce(box, CASE WHEN named THEN 't0' ELSE 'dflt' END) AS region_id, CASE WHEN box IS NOT NULL THEN 1.0 WHEN named THEN 0.85 ELSE 0.4 END::DOUBLE AS geo_confidence,
      CASE WHEN box IS NOT NULL THEN 'explicit_geo' WHEN named THEN 'text_toponym' ELSE 'source_default' END AS geo_source, 3 + CASE WHEN reads THEN 0 ELSE 1 END AS n_evidence FROM m""",
    "nearest_region": f"""WITH {BASE}, r AS (SELECT * FROM (VALUES (0, 'west', 10.0, -10.0), (1, 'east', 10.0, 50.0), (2, 'north', 55.0, 20.0), (3, 'centre', 30.0, 20.0)) v(i, name, a, b)),
      n AS (SELECT doc_id, arg_min(name, {{'d': (lat - a) * (lat - a) + (lon - b) * (lon - b), 'i': i}}) AS nearest_region FROM c CROSS JOIN r GROUP BY doc_id) SELECT nearest_region, count(*) AS n, min(doc_id) AS first FROM n GROUP BY ALL""",
    "cluster_centroids": f"WITH {UNIT}, {centroid('c')} SELECT cluster_id, size, (i - 1)::INTEGER AS i, round(x, 5) AS x FROM (SELECT cluster_id, size, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM c)",
    "cluster_cohesion": f"WITH {UNIT}, {centroid('c')} SELECT cluster_id, round(avg({DOT.format('e', 'centroid')}), 5) AS cohesion_score FROM u JOIN c USING (cluster_id) GROUP BY ALL",
    "cluster_metrics": f"""WITH {UNIT}, {centroid('c')}, h AS (SELECT cluster_id, max(size) AS size, avg({DOT.format('e', 'centroid')}) AS h FROM u JOIN c USING (cluster_id) GROUP BY ALL)
      SELECT sum(size)::BIGINT AS n_documents, count(*) FILTER (cluster_id != 0) AS n_clusters, coalesce(sum(size) FILTER (cluster_id = 0), 0)::BIGINT AS n_noise,
      round(coalesce(sum(size) FILTER (cluster_id = 0), 0) / sum(size), 5) AS noise_ratio, round(avg(h) FILTER (cluster_id != 0), 5) AS avg_cohesion FROM h""",
    "cluster_enrichment": f"""WITH {DOCS} SELECT cluster_id, count(*) AS size, count(DISTINCT author_id) AS unique_authors, count(DISTINCT source_type) AS unique_sources, sum(reach)::BIGINT AS reach_total, min(created_at) AS earliest_doc_at, max(created_at) AS latest_doc_at,
      count(DISTINCT region)::INTEGER AS geo_regions, round(count(*) FILTER (created_at >= TIMESTAMP '2024-01-29 18:00:00') / greatest(count(*) FILTER (created_at >= TIMESTAMP '2024-01-29 12:00:00' AND created_at < TIMESTAMP '2024-01-29 18:00:00'), 1), 6) AS growth_rate FROM docs GROUP BY ALL""",
    "batch_cosine_stats": f"""WITH {UNIT}, n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS n FROM embeddings), s AS (SELECT i, sum(x) AS s FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u) GROUP BY i),
      q AS (SELECT sum(s * s) AS q FROM s) SELECT count(*) AS n_vectors, round(avg(n), 5) AS norm_mean, round(stddev_pop(n), 5) AS norm_std, round(min(n), 5) AS norm_min, round(max(n), 5) AS norm_max, 0.0::DOUBLE AS truncated_ratio,
      round((max(q) - count(*)) / (count(*) * (count(*) - 1)), 5) AS mean_pairwise_cosine FROM n CROSS JOIN q""",
    "nearest_topic": ONLINE + "SELECT doc_id, cluster_id, round(s, 5) AS strength, s > 0.3 AS assigned FROM b",
    "unassigned_docs": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents a WHERE a.doc_id = d.doc_id AND a.doc_id % 3 = 0) AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id = d.doc_id AND b.doc_id % 3 = 1)",
    "chunk_windows": f"""WITH t AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, greatest(len(t), 1), 448)) AS start FROM t)
      SELECT doc_id, (start // 448)::INTEGER AS chunk, start::INTEGER AS start, len(t[start + 1:start + 512])::INTEGER AS n_tokens, sha256(array_to_string(t[start + 1:start + 512], ' ')) AS chunk_sha FROM s WHERE start = 0 OR start + 64 < len(t)""",
    "sentiment_from_scores": """WITH v AS (SELECT event_id, event_type, (((floor(value * 100)::BIGINT % 64) + 64) % 64) / 64.0 AS v FROM events)
      SELECT event_id, greatest(-1.0, least(1.0, CASE event_type WHEN 'click' THEN (v - (1 - v)) * greatest(0.0, 1 - v * 0.5) WHEN 'view' THEN v - 0.25 WHEN 'error' THEN -v ELSE 0.0 END))::DOUBLE AS sentiment_score FROM v""",
    "documents_page": f"WITH {DOCS} SELECT doc_id, created_at, reach FROM docs WHERE cluster_id = 4 ORDER BY created_at DESC, doc_id DESC LIMIT 25 OFFSET 25",
    "top_filtered": f"""WITH {RANK}, f AS (SELECT * FROM ranked WHERE period_hours = 72 AND list_contains(regions, 'NATION_0') AND cluster_id IN (SELECT cluster_id FROM win WHERE period_hours = 72 AND source_type = 'click') ORDER BY rank LIMIT 5)
      SELECT row_number() OVER (ORDER BY rank, cluster_id)::INTEGER AS rank, cluster_id, round(score, 6) AS score FROM f""",
    "pipeline_stats": " UNION ALL ".join(f"SELECT '{t}' AS name, 'table' AS kind, count(*) AS n FROM {t}" for t in ("events", "documents", "embeddings", "labels", "pages", "conversations"))
    + " UNION ALL SELECT event_type, 'source_type', count(*) FROM events GROUP BY event_type",
    "health_status": """WITH s AS (SELECT * FROM (VALUES ('embedding', 'click'), ('clustering', 'view'), ('summarization', 'error'), ('ranking', 'purchase'), ('missing', 'none')) v(stage, t)),
      a AS (SELECT stage, max(ts) AS last_at FROM s LEFT JOIN events ON event_type = t GROUP BY stage), m AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last_at)) / 6e7 AS age FROM a)
      SELECT stage, last_at, round(age, 6) AS age_minutes, CASE WHEN age IS NULL THEN 'down' WHEN age <= 30 THEN 'ok' WHEN age <= 60 THEN 'degraded' ELSE 'down' END AS status FROM m""",
    "table_metrics": """SELECT 'events' AS "table", count(*) AS rows, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(max(ts))) / 1e6 AS freshness_seconds FROM events UNION ALL
      SELECT 'orders', count(*), (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(max(o_orderdate))) / 1e6 FROM orders UNION ALL SELECT 'documents', count(*), 1e9::DOUBLE FROM documents""",
    "documents_with_ml": "SELECT d.doc_id, lang AS language, sha256(text) AS text_hash, quality AS ml_category, toxic AS ml_toxicity FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "latest_upsert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "official_documents": """SELECT event_type AS source_type, event_id % 50 = 0 OR (event_type = 'click' AND user_id % 7 = 0) OR user_id IN (5, 11) AS is_official, count(*) AS n FROM events GROUP BY ALL""",
    "passage_text": r"""SELECT doc_id, sha256(concat('passage: [', source, '] ', trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+', ' ', 'g'), '@[\p{L}\p{N}\p{M}_]+', ' ', 'g'), '[\s\x1c-\x1f]+', ' ', 'g')))) AS passage_sha
      FROM documents""",
    "source_urls": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN concat('https://a.example/', event_id) WHEN event_id % 3 = 0 THEN concat('https://vk.com/wall', user_id, '_', event_id)
      WHEN event_id % 3 = 1 THEN concat('https://vk.com/wall', user_id, '_', event_id, '?reply=7') END AS source_url FROM events""",
}

ORACLES["streaming_rank"] = ORACLES["rank_topics"]
ORACLES["streaming_hourly_counts"] = """
SELECT date_trunc('hour', ts) AS hour, event_type AS source_type, count(*) AS count, CAST(sum(floor(value)) AS BIGINT) AS reach FROM events GROUP BY ALL
"""
