"""DuckDB SQL for the service's rules, corpus reports, store and training preparation, from their definitions."""

from __future__ import annotations

from prosegauge.oracles import PRED, SCORED, q

_B = r"[ \t\n\r\f\v]"
_SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_N = f"len(list_filter(regexp_split_to_array(coalesce(text, ''), {q(_B + '+')}), lambda x: x <> ''))"
_BLANK = f"regexp_replace(coalesce(text, ''), {q(_B)}, '', 'g') = ''"
_BAD = f"CASE WHEN {_BLANK} THEN 'essay_empty' WHEN len(text) > 60000 THEN 'essay_too_long' WHEN len(text) < 200 THEN 'essay_too_short' END"
#: Requests made of documents: who asks, and how.
REQUESTS = "rq AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang = 'de' THEN ' 10.0.0.7 , 10.0.0.1' WHEN lang = 'fr' THEN '' END AS forwarded, source AS host, CASE lang WHEN 'es' THEN false WHEN 'en' THEN true END AS save, source = 'src3' AS requested FROM documents)"
_HASH = "sha256(text || chr(0) || '1.0.0' || chr(0) || '1.0.0')"
_SENT_DOCS = "(SELECT doc_id, '  Here is the essay:' || chr(10) || '# Title' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '(Word count: 120)' AS text, coalesce(source, '') || ' / ' || coalesce(lang, '') AS topic FROM documents)"


def _re(x: str, pattern: str, into: str = "", flags: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(into)}, '{flags}')" if flags else f"regexp_replace({x}, {q(pattern)}, {q(into)})"


_CLEAN = f"trim(text, {_SP})"
for _p in ((rf"(?i)\A(sure[,!.]?{_B}*|certainly[,!.]?{_B}*|here(?:'s| is)[^\n]*\n+)",), (rf"\A#{{1,6}}{_B}+[^\n]*\n+",)):
    _CLEAN = _re(_CLEAN, _p[0])
_CLEAN = _re(_re(_CLEAN, r"\A```[a-z]*\n"), r"\n```\z")
_CLEAN = _re(_re(_CLEAN, rf"(?i)\n+{_B}*[(\[]?word count[:\s][^\n]*\z"), "\n{3,}", "\n\n", "g")
_CLEAN = f"trim({_CLEAN}, {_SP})"

#: Contributions made of documents' sizes, for the rules over them.
CONTRIBUTIONS = """ct AS (SELECT doc_id, unnest(['sty_ttr', 'lm_perplexity', 'agg_mean_lm_frac_top1', 'bur_cv_sent_len', 'doc_log_n_words', 'cor_char_sim_human', 'shift_n_changepoints', 'rep_distinct2', 'odd']) AS feature,
  unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i, n_chars FROM documents),
con AS (SELECT doc_id, feature, CASE WHEN i = 9 THEN 0.0 ELSE ((doc_id * i * 31 + n_chars) % 1000 - 500) / 1000.0 END AS contribution FROM ct)"""
_RANK = """rd AS (SELECT *, list_max([p0, p1, p2]) AS top, list_reverse_sort([p0, p1, p2])[2] AS second, list_position([p0, p1, p2], list_max([p0, p1, p2])) - 1 AS k FROM pred),
rr AS (SELECT *, CASE WHEN n_sentences < 5 OR n_words < 120 THEN 'too_little_text' WHEN top < 0.45 THEN 'low_confidence' WHEN top - second < 0.1 THEN 'narrow_margin' END AS reason FROM rd)"""
_W = "({k} / {n} + 3.8416 / (2 * {n}) {s} 1.96 * sqrt(({k} / {n} * (1 - {k} / {n}) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n})"
_GROUP = "CASE WHEN f ~ '^(lm|whole_lm)_.*' THEN 'lm' WHEN f ~ '^(sty|doc)_.*' THEN 'style' WHEN f ~ '^syn_.*' THEN 'syntax' WHEN f ~ '^(ctx|shift)_.*' THEN 'context' WHEN f ~ '^bur_.*' THEN 'rhythm' WHEN f ~ '^rep_.*' THEN 'repetition' WHEN f ~ '^cor_.*' THEN 'corpus' ELSE 'other' END"
#: The corpus's groups: documents of equal text; their topics are sources, their models languages.
_KEY = f"md5(trim(regexp_replace(lower(coalesce(text, '')), {q(_B + '+')}, ' ', 'g')))"
PROFILE = f"gp AS (SELECT {_KEY} AS key_hash, min(doc_id) AS group_id, count(*) AS n_docs, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)) AS labels, list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)) AS topics, coalesce(bool_or(lang = 'es'), false) AS l2 FROM documents GROUP BY key_hash)"
SPLITS = (
    PROFILE
    + """,
ft AS (SELECT *, list_has_any(topics, ['src7', 'src13']) AS held, array_to_string(labels, '+') || '|' || CASE WHEN l2 THEN 'l2' ELSE 'l1' END AS stratum FROM gp),
od AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(group_id::VARCHAR), group_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM ft WHERE NOT held),
cu AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(n - 2, round_even(0.7 * n, 0))) ELSE round_even(0.7 * n, 0) END AS t, round_even(0.15 * n, 0) AS v0 FROM od),
cv AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(n - t - 1, v0)) ELSE v0 END AS v FROM cu),
sp AS (SELECT key_hash, group_id, stratum, n_docs, CASE WHEN r <= t THEN 'train' WHEN r <= t + v THEN 'validation' ELSE 'test' END AS split FROM cv UNION ALL SELECT key_hash, group_id, stratum, n_docs, 'test' FROM ft WHERE held)"""
)

ORACLES: dict[str, str] = {
    "request_rules": f"""WITH {REQUESTS} SELECT doc_id, octet_length(encode(text)) > 1000000 AS too_large, {_BAD} AS error_code, CASE {_BAD} WHEN 'essay_empty' THEN 422 WHEN 'essay_too_long' THEN 413 WHEN 'essay_too_short' THEN 422 ELSE 200 END AS http_status,
        CASE WHEN {_N} < 300 THEN 'short' WHEN {_N} < 600 THEN 'medium' ELSE 'long' END AS length_band, CASE WHEN {_N} < 200 THEN '<200' WHEN {_N} < 280 THEN '200-280' ELSE '>=280' END AS word_band, (coalesce(requested, false) OR len(text) >= 25000) AS queued,
        save IS DISTINCT FROM false AS store_text, coalesce(nullif(trim(string_split(coalesce(forwarded, ''), ',')[1]), ''), host, 'unknown') AS client, len(text)::BIGINT AS chars, {_N}::BIGINT AS words, sha256(text)[1:16] AS digest, sha256({_HASH})[1:24] AS essay_id,
        CASE WHEN save IS DISTINCT FROM false THEN text END AS stored_text FROM rq""",
    "clean_generated": f"SELECT doc_id, sha256({_CLEAN}) AS cleaned, regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g')[1:32] AS slug FROM {_SENT_DOCS}",
    "display_rules": f"""WITH {SCORED} SELECT doc_id, sent_id, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.6 THEN 'elevated' WHEN score >= 0.4 THEN 'uncertain' ELSE 'low' END AS colour, round(10 * score)::BIGINT AS blocks, least(1.0, abs(score - 0.5) / 0.5) AS bar FROM scored""",
    "summary_counts": f"""WITH {SCORED}, pa AS (SELECT doc_id, para_id, sum(score * greatest(n_words, 1)) / sum(greatest(n_words, 1)) AS p, max(score) AS peak, count(*) AS k FROM scored GROUP BY ALL),
        pf AS (SELECT doc_id, count(*) FILTER (p >= 0.6 OR (p < 0.4 AND peak >= 0.75 AND k >= 3)) AS flagged_paragraphs, count(*) FILTER (p >= 0.4 AND p < 0.6) AS uncertain_paragraphs FROM pa GROUP BY doc_id)
        SELECT doc_id, count(*) AS n_sentences, count(*) AS sentences_scored, count(*) FILTER (score >= 0.6) AS flagged_sentences, count(*) FILTER (score >= 0.4 AND score < 0.6) AS uncertain_sentences, count(*) FILTER (score < 0.4) AS human_like_sentences,
        any_value(flagged_paragraphs) AS flagged_paragraphs, any_value(uncertain_paragraphs) AS uncertain_paragraphs, round(count(*) FILTER (score >= 0.6) / count(*), 4) AS flagged_share FROM scored JOIN pf USING (doc_id) GROUP BY doc_id""",
    "contribution_share": f"""WITH {CONTRIBUTIONS}, cg AS (SELECT doc_id, regexp_replace(feature, '^agg_(mean|std|min|max|p25|p75)_', '') AS f, abs(contribution) AS a FROM con), cs AS (SELECT doc_id, {_GROUP} AS feature_group, sum(a) AS total, count(*) AS n_features FROM cg GROUP BY ALL)
        SELECT doc_id, feature_group, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, feature_group) AS place, round(CASE WHEN sum(total) OVER (PARTITION BY doc_id) = 0 THEN 0 ELSE total / sum(total) OVER (PARTITION BY doc_id) END, 4) AS share, n_features FROM cs""",
    "top_contributions": f"WITH {CONTRIBUTIONS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, feature) AS place, feature, round(contribution, 6) AS contribution, CASE WHEN contribution > 0 THEN 'machine' ELSE 'human' END AS direction FROM con WHERE abs(contribution) > 1e-9 QUALIFY place <= 5",
    "abstention": f"""WITH {PRED}, {_RANK}, ab AS (SELECT count(*) AS n, count(reason) AS a, count(*) FILTER (reason IS NULL AND k = y) AS r FROM rr)
        SELECT n AS n_documents, a AS abstained, round(a / n, 4) AS abstention_rate, n - a AS answered, round(r / (n - a), 4) AS accuracy_when_answering, round(greatest(0, {_W.format(k='r', n='(n - a)', s='-')}), 4) AS low, round(least(1, {_W.format(k='r', n='(n - a)', s='+')}), 4) AS high FROM ab""",
    "confident_errors": f"""WITH {PRED}, {_RANK}, wr AS (SELECT *, count(*) FILTER (top >= 0.55) OVER () AS sure FROM rr WHERE k <> y)
        SELECT doc_id, y::BIGINT AS y, k::BIGINT AS k, round(top, 6) AS confidence, sure < 20 AS fallback FROM wr WHERE top >= 0.55 OR sure < 20 ORDER BY confidence DESC, doc_id LIMIT 20""",
    "error_cases": f"""WITH {PRED}, {_RANK}, kd AS (SELECT doc_id, y, k, unnest(list_filter([CASE WHEN y = 0 THEN 'false_positive' END, CASE WHEN y <> 0 AND k = 0 THEN 'missed' END, CASE WHEN y = 2 THEN 'polished_confusion' END], lambda x: x IS NOT NULL)) AS kind FROM rr WHERE k <> y),
        kp AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS place FROM kd)
        SELECT kp.doc_id, kind, y::BIGINT AS y, k::BIGINT AS k, place, d.source, CASE WHEN d.source IS DISTINCT FROM 'src5' THEN d.text[1:280] END AS excerpt, CASE WHEN d.source = 'src5' THEN 'withheld: ingested text' END AS withheld FROM kp LEFT JOIN documents d USING (doc_id) WHERE place <= 20""",
    "group_profile": f"WITH {PROFILE} SELECT group_id, n_docs, array_to_string(labels, '+') AS labels, array_to_string(topics, '+') AS topics, l2 FROM gp",
    "assign_splits_held_out": f"WITH {SPLITS} SELECT group_id, stratum, n_docs, split FROM sp",
    "split_documents": f"WITH {SPLITS} SELECT d.doc_id, coalesce(sp.split, 'train') AS split FROM (SELECT doc_id, {_KEY} AS key_hash FROM documents) d LEFT JOIN sp USING (key_hash)",
    "split_crosstab": f"""WITH {SPLITS}, sd AS (SELECT d.lang, sp.split, d.words FROM (SELECT lang, {_KEY} AS key_hash, {_N} AS words FROM documents) d JOIN sp USING (key_hash))
        SELECT coalesce(lang, 'none') AS label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, sum(words)::BIGINT AS words FROM sd GROUP BY ALL""",
    "data_regime": "SELECT CASE WHEN NOT bool_or(source IN ('groq', 'ingested_real')) THEN 'bootstrap' WHEN bool_or(source = 'groq') AND bool_or(source = 'seed_authored') THEN 'mixed' ELSE 'real' END AS data_regime, count(source) AS documents FROM documents",
    "empirical_length_bands": f"""WITH wc AS (SELECT list_sort(list({_N})) AS s FROM documents), pc AS (SELECT s[1] AS p0, s[least(len(s) - 1, floor(0.33 * len(s))::INT) + 1] AS p1, s[least(len(s) - 1, floor(0.66 * len(s))::INT) + 1] AS p2, s[least(len(s) - 1, floor(0.999 * len(s))::INT) + 1] AS p3 FROM wc)
        SELECT 'short' AS band, p0::BIGINT AS low, greatest(p0 + 10, p1)::BIGINT AS high FROM pc UNION ALL SELECT 'medium', p1::BIGINT, greatest(p1 + 10, p2)::BIGINT FROM pc UNION ALL SELECT 'long', p2::BIGINT, greatest(p2 + 10, p3)::BIGINT FROM pc""",
    "latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at, count(*) AS writes FROM events GROUP BY user_id",
    "retention_purge": """WITH kp AS (SELECT e.* FROM events e WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS)
        SELECT 'events' AS tab, event_id AS id FROM kp UNION ALL SELECT 'users', user_id FROM (SELECT DISTINCT user_id FROM events) u WHERE EXISTS (SELECT 1 FROM kp WHERE kp.user_id = u.user_id)""",
    "keyed_upsert": """WITH un AS (SELECT c_custkey AS k, c_acctbal AS v, TIMESTAMP '1990-01-01' AS written, 0 AS o FROM customer UNION ALL SELECT o_custkey, o_totalprice, o_orderdate::TIMESTAMP, o_orderkey FROM orders)
        SELECT k AS key, v AS value, o AS version FROM un QUALIFY row_number() OVER (PARTITION BY k ORDER BY written DESC, o DESC) = 1""",
    "insert_if_absent": "SELECT c_custkey, c_mktsegment AS origin FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)",
    "cascade_delete": "SELECT 'customer' AS tab, c_custkey AS id FROM customer WHERE NOT c_acctbal < 0 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "cache_lookup": """WITH ca AS (SELECT event_type || ':' || user_id AS key, ts + INTERVAL 86400 SECONDS AS expires, event_id FROM events WHERE event_type IN ('view', 'purchase')), lt AS (SELECT key, max((expires, event_id)) AS e FROM ca GROUP BY key)
        SELECT user_id, lt.e IS NOT NULL AND struct_extract_at(lt.e, 1) > TIMESTAMP '2024-01-30 00:00:00' AS hit FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN lt ON lt.key = 'view:' || u.user_id""",
    "latest_versions": "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 3",
    "rate_limit_fixed": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, floor(epoch(ts) / 60) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth, count(*) OVER (PARTITION BY user_id, floor(epoch(ts) / 60) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 30 AS allowed FROM events",
    "json_properties": "SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, json(props)::VARCHAR AS again FROM events",
    "health_rollup": "SELECT user_id, CASE WHEN NOT bool_or(event_type = 'signup') THEN 'unavailable' WHEN bool_or(event_type = 'error') THEN 'degraded' ELSE 'ok' END AS status FROM events GROUP BY user_id",
    "rate_limit_sliding": """WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS i FROM events),
        st AS (SELECT event_id, user_id, t, i, true AS allowed, 0::BIGINT AS retry_after, [t] AS log FROM ev WHERE i = 1
          UNION ALL SELECT ev.event_id, ev.user_id, ev.t, ev.i, len(list_filter(st.log, lambda x: x >= ev.t - 3600)) < 2,
            CASE WHEN len(list_filter(st.log, lambda x: x >= ev.t - 3600)) < 2 THEN 0 ELSE greatest(1, floor(3600 - (ev.t - list_min(list_filter(st.log, lambda x: x >= ev.t - 3600))))::BIGINT) END,
            CASE WHEN len(list_filter(st.log, lambda x: x >= ev.t - 3600)) < 2 THEN list_append(list_filter(st.log, lambda x: x >= ev.t - 3600), ev.t) ELSE list_filter(st.log, lambda x: x >= ev.t - 3600) END
          FROM st JOIN ev ON ev.user_id = st.user_id AND ev.i = st.i + 1)
        SELECT event_id, user_id, allowed, retry_after FROM st""",
}
