"""DuckDB SQL for verdicts, evaluation, rhythm, repetition and structure, from their definitions: lists and self-joins where the Spark side has windows and plans."""

from __future__ import annotations

from prosegauge.expected_rules import _KEY, _RANK
from prosegauge.oracles import PRED, SCORED, SURF, TOK, WHOLE

_BAND = "CASE WHEN top < 0.45 THEN 'very low' WHEN top < 0.65 THEN 'low' WHEN top < 0.85 THEN 'moderate' ELSE 'high' END"
_NAMES = "['human', 'ai_generated', 'ai_polished']"
_CELLS = f"{PRED}, {_RANK}, cm AS (SELECT c AS class, count(*) FILTER (y = c AND k = c)::DOUBLE AS tp, count(*) FILTER (y <> c AND k = c)::DOUBLE AS fp, count(*) FILTER (y = c AND k <> c)::DOUBLE AS fn, count(*) FILTER (y <> c AND k <> c)::DOUBLE AS tn FROM rr, (SELECT unnest([0, 1, 2])::BIGINT AS c) GROUP BY c)"
_CV = "CASE WHEN avg({0}) < 1e-9 THEN 0 ELSE stddev_pop({0}) / avg({0}) END"
_LENS = f"{SURF}, ls AS (SELECT doc_id, list(sty_n_words ORDER BY sent_id) AS x, count(*) AS n, avg(sty_n_words) AS mu, stddev_pop(sty_n_words) AS sd FROM sent GROUP BY doc_id), df AS (SELECT *, list_transform(range(1, n), lambda i: x[i + 1] - x[i]) AS d FROM ls)"
_GRAMS = ", ".join(f"g{k} AS (SELECT doc_id, count(*) AS n, count(DISTINCT g) AS u, max(c) AS top, count(DISTINCT g) FILTER (c > 1) AS types FROM (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i : i + {k - 1}], ' '))) AS g FROM dw)) GROUP BY doc_id)" for k in (2, 3, 4, 5))


def _by_size(x: str) -> str:
    return f"CASE WHEN len(ws) < 12 THEN 0.0 ELSE {x} END"


ORACLES: dict[str, str] = {
    "verdict_rules": f"""WITH {PRED}, {_RANK} SELECT doc_id, CASE WHEN reason IS NULL THEN {_NAMES}[k + 1] ELSE 'insufficient_evidence' END AS classification, round(top, 6) AS confidence_score, CASE WHEN reason IS NULL THEN {_BAND} ELSE 'very low' END AS confidence,
        round(top - second, 6) AS margin, reason IS NOT NULL AS abstained, coalesce(reason, '') AS abstain_reason FROM rr""",
    "sentence_bands": f"""WITH {SCORED} SELECT doc_id, sent_id, round(score, 4) AS score, b[1] AS band, b[2] AS confidence FROM (SELECT *, CASE WHEN n_words < 5 THEN ['uncertain', 'very low'] WHEN score < 0.25 THEN ['likely_human', 'high'] WHEN score < 0.4 THEN ['likely_human', 'moderate']
        WHEN score < 0.6 THEN ['uncertain', 'low'] WHEN score < 0.75 THEN ['possibly_ai_assisted', 'moderate'] ELSE ['likely_ai_assisted', 'high'] END AS b FROM scored)""",
    "paragraph_rollup": f"""WITH {SCORED}, pl AS (SELECT doc_id, para_id, list(score) AS s, list(greatest(n_words, 1)) AS w FROM scored GROUP BY ALL), pz AS (SELECT *, list_dot_product(s::DOUBLE[], w::DOUBLE[]) / list_sum(w) AS p, list_max(s) AS peak FROM pl)
        SELECT doc_id, para_id, len(s) AS n_sentences, round(p, 9) AS score, round(1 - p, 9) AS human_likeness, peak, len(list_filter(s, lambda x: x >= 0.6)) AS flagged, len(list_filter(s, lambda x: x >= 0.4 AND x < 0.6)) AS uncertain,
        CASE WHEN p >= 0.6 THEN 'likely_ai_assisted' WHEN p >= 0.4 THEN 'uncertain' WHEN peak >= 0.75 AND len(s) >= 3 THEN 'contains_flagged_sentence' ELSE 'likely_human' END AS classification FROM pz""",
    "confusion_metrics": f"""WITH {_CELLS} SELECT class, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS rec, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support,
        round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS fnr FROM cm""",
    "classification_summary": f"""WITH {_CELLS}, f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS s, tp + fp AS p FROM cm), po AS (SELECT avg((k = y)::INT) AS a, count(*)::DOUBLE AS n FROM rr),
        pe AS (SELECT sum(s * p) / any_value(n * n) AS e, sum(s * p) AS sp, sum(s * s) AS ss, sum(p * p) AS pp, any_value(n) AS n, sum(tp) AS c FROM f, po)
        SELECT round(any_value(a), 6) AS accuracy, round(avg(tp / s) FILTER (s > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * s) / sum(s), 6) AS weighted_f1, round((any_value(a) - any_value(e)) / (1 - any_value(e)), 6) AS kappa,
        round(any_value((c * pe.n - sp) / sqrt((pe.n * pe.n - pp) * (pe.n * pe.n - ss))), 6) AS mcc FROM f, po, pe""",
    "ece_reliability": f"""WITH {PRED}, {_RANK}, bn AS (SELECT unnest(range(1, 11)) AS bin) SELECT bin, count(*) AS n, round(avg(top), 6) AS confidence, round(avg((k = y)::INT), 6) AS accuracy, round(abs(avg(top) - avg((k = y)::INT)) * count(*) / (SELECT count(*) FROM rr), 6) AS ece_part
        FROM rr JOIN bn ON top > (bin - 1) / 10.0 AND top <= bin / 10.0 OR bin = 1 AND top <= 0 GROUP BY bin""",
    "losses": f"""WITH {PRED} SELECT round(-avg(ln(greatest(1e-15, least(1 - 1e-15, [p0, p1, p2][y + 1])))), 6) AS log_loss, round(avg(pow(p0 - (y = 0)::INT, 2)), 6) AS brier_human, round(avg(pow(p1 - (y = 1)::INT, 2)), 6) AS brier_ai_generated,
        round(avg(pow(p2 - (y = 2)::INT, 2)), 6) AS brier_ai_polished FROM pred""",
    "slice_metrics": f"""WITH {PRED}, {_RANK}, sl AS (SELECT (k = y)::INT AS hit, top, unnest([{{'n': 'lang', 'v': lang}}, {{'n': 'source', 'v': source}}, {{'n': 'band', 'v': CASE WHEN n_words >= 280 THEN 'long' WHEN n_words >= 200 THEN 'medium' ELSE 'short' END}}, {{'n': 'all', 'v': 'all'}}]) AS s FROM rr)
        SELECT s.n AS slice_name, s.v AS slice_value, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(top), 6) AS mean_confidence, count(*) < 8 AS too_small FROM sl GROUP BY ALL""",
    "wilson_bias_by_language": f"""WITH {PRED}, {_RANK}, g AS (SELECT lang, count(*)::DOUBLE AS n, avg((k <> 0)::INT) AS p FROM rr WHERE y = 0 GROUP BY lang), w AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) AS h FROM g)
        SELECT lang, n::BIGINT AS n, round(p, 6) AS fpr, round(greatest(0, c - h), 4) AS low, round(least(1, c + h), 4) AS high, n < 15 AS underpowered FROM w""",
    "error_rates": f"WITH {PRED}, {_RANK} SELECT round(count(*) FILTER (k <> y) / count(*), 6) AS error_rate, round(avg(top) FILTER (k = y), 6) AS confidence_right, round(avg(top) FILTER (k <> y), 6) AS confidence_wrong, round(count(reason) / count(*), 6) AS abstention_rate FROM rr",
    "exact_duplicates": f"WITH k AS (SELECT {_KEY} AS key_hash, list_sort(list(doc_id)) AS ids FROM documents GROUP BY ALL) SELECT key_hash, len(ids) AS copies, ids[1] AS kept_id, ids[-1] AS last_id FROM k WHERE len(ids) > 1",
    "dedup_keep_first": f"WITH k AS (SELECT doc_id, {_KEY} AS key_hash FROM documents) SELECT doc_id, key_hash, count(*) OVER (PARTITION BY key_hash) AS copies FROM k QUALIFY row_number() OVER (PARTITION BY key_hash ORDER BY doc_id) = 1",
    "event_tumbling_counts": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT // 3600 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "joined_results": "SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n_results, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "recent_page": "WITH r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS i, (SELECT count(*) FROM events) AS total FROM events) SELECT event_id, user_id, event_type, total FROM r WHERE i BETWEEN 41 AND 60",
    "rhythm_series": f"WITH {SURF}, mu AS (SELECT doc_id, avg(sty_n_words) AS m FROM sent GROUP BY doc_id) SELECT s.doc_id, s.sent_id, s.sty_n_words AS n_words, round(s.sty_n_words - m, 6) AS deviation, coalesce(abs(s.sty_n_words - p.sty_n_words), 0) AS step FROM sent s JOIN mu USING (doc_id) LEFT JOIN sent p ON p.doc_id = s.doc_id AND p.sent_id = s.sent_id - 1",
    "rhythm_by_document": f"""WITH {_LENS},
        hb AS (SELECT doc_id, map_values(list_aggregate(list_transform(x, lambda v: floor(v / 5)), 'histogram')) AS c, n FROM ls), he AS (SELECT doc_id, -list_sum(list_transform(c, lambda v: v / n * log2(v / n))) AS h, len(c) AS k FROM hb),
        cvs AS (SELECT doc_id, {_CV.format('sty_mean_word_len')} AS a, {_CV.format('sty_punct_density')} AS b, {_CV.format('sty_comma_rate')} AS c, {_CV.format('sty_ttr')} AS d2, {_CV.format('sty_root_ttr')} AS e FROM sent GROUP BY doc_id)
        SELECT df.doc_id, round(mu, 6) AS bur_mean_sent_len, round(list_median(x), 6) AS bur_median_sent_len, round(sd, 6) AS bur_std_sent_len, round(CASE WHEN mu < 1e-9 THEN 0 ELSE sd / mu END, 6) AS bur_cv_sent_len, round(list_aggregate(x, 'quantile_cont', 0.75) - list_aggregate(x, 'quantile_cont', 0.25), 6) AS bur_iqr_sent_len,
        list_max(x) - list_min(x) AS bur_range_sent_len, list_min(x) AS bur_min_sent_len, list_max(x) AS bur_max_sent_len, round(CASE WHEN mu + sd < 1e-9 THEN 0 ELSE (sd - mu) / (sd + mu) END, 6) AS bur_burstiness_index, round(h, 6) AS bur_sent_len_entropy, round(CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END, 6) AS bur_normalised_len_entropy,
        round(coalesce(list_avg(list_transform(d, lambda v: abs(v))), 0), 6) AS bur_mean_abs_adjacent_diff, round(coalesce(list_aggregate(list_transform(d, lambda v: abs(v)), 'stddev_pop'), 0), 6) AS bur_std_abs_adjacent_diff, coalesce(list_max(list_transform(d, lambda v: abs(v))), 0) AS bur_max_abs_adjacent_diff,
        round(coalesce(list_avg(list_transform(range(1, n), lambda i: abs(x[i + 1] - x[i]) / greatest(x[i], 1))), 0), 6) AS bur_mean_rel_adjacent_diff,
        round(CASE WHEN n < 3 OR list_sum(list_transform(x, lambda v: pow(v - mu, 2))) < 1e-12 THEN 0 ELSE greatest(-1, least(1, list_sum(list_transform(range(1, n), lambda i: (x[i] - mu) * (x[i + 1] - mu))) / list_sum(list_transform(x, lambda v: pow(v - mu, 2))))) END, 6) AS bur_lag1_autocorr_sent_len,
        round(len(list_filter(x, lambda v: abs(v - mu) <= 0.2 * greatest(mu, 1))) / n, 6) AS bur_frac_sent_within_20pct_of_mean, round(len(list_filter(x, lambda v: v >= 10 AND v <= 25)) / n, 6) AS bur_frac_sent_len_10_25,
        round(CASE WHEN n < 3 THEN 0 ELSE len(list_filter(range(1, n - 1), lambda i: d[i] * d[i + 1] < 0)) / (n - 2) END, 6) AS bur_direction_changes, round(a, 6) AS bur_cv_word_len, round(b, 6) AS bur_cv_punct_density, round(cvs.c, 6) AS bur_cv_comma_rate, round(d2, 6) AS bur_cv_ttr, round(e, 6) AS bur_cv_root_ttr
        FROM df JOIN he USING (doc_id) JOIN cvs USING (doc_id)""",
    "sentence_jaccard": f"""WITH {TOK}, sw AS (SELECT doc_id, sent_id, list_distinct(list(w)) AS s FROM tok WHERE content = 1 GROUP BY ALL), jp AS (SELECT a.doc_id, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j FROM sw a JOIN sw b ON a.doc_id = b.doc_id AND a.sent_id < b.sent_id)
        SELECT doc_id, round(max(j), 6) AS rep_max_sentence_jaccard, round(avg(j), 6) AS rep_mean_sentence_jaccard, round(avg((j > 0.3)::INT), 6) AS rep_frac_sentence_pairs_over_30pct FROM jp GROUP BY doc_id""",
    "ngram_repetition": f"""WITH {TOK}, dw AS (SELECT doc_id, list(w ORDER BY sent_id, pos) AS ws, list(w) FILTER (content = 1) AS cw FROM tok GROUP BY doc_id), {_GRAMS},
        op AS (SELECT doc_id, o, count(*) AS c FROM (SELECT doc_id, sent_id, array_to_string(list(w ORDER BY pos)[1:2], ' ') AS o, count(*) AS m FROM tok GROUP BY doc_id, sent_id) WHERE m >= 2 GROUP BY doc_id, o), os AS (SELECT doc_id, sum(c) AS n, count(*) AS u, max(c) AS top FROM op GROUP BY doc_id),
        ch AS (SELECT doc_id, map_values(list_aggregate(cw, 'histogram')) AS c, len(cw) AS n FROM dw WHERE cw IS NOT NULL)
        SELECT dw.doc_id, round({_by_size('1 - g2.u / g2.n')}, 6) AS rep_bigram_repeat_ratio, round({_by_size('1 - g3.u / g3.n')}, 6) AS rep_trigram_repeat_ratio, round({_by_size('1 - g4.u / g4.n')}, 6) AS rep_fourgram_repeat_ratio, round({_by_size('1 - g5.u / g5.n')}, 6) AS rep_fivegram_repeat_ratio,
        round({_by_size('g2.u / g2.n')}, 6) AS rep_distinct2, round({_by_size('g3.u / g3.n')}, 6) AS rep_distinct3, round({_by_size('g4.u / g4.n')}, 6) AS rep_distinct4, {_by_size('greatest(g3.top, g4.top, g5.top)::DOUBLE')} AS rep_max_ngram_repeat_count, {_by_size('(g3.types + g4.types + g5.types)::DOUBLE')} AS rep_repeated_ngram_types,
        round(coalesce((ch.n - len(ch.c)) / ch.n, 0), 6) AS rep_content_word_repeat_ratio, round(coalesce(list_max(ch.c) / ch.n, 0), 6) AS rep_top_content_word_share, round(coalesce(-list_sum(list_transform(ch.c, lambda v: v / ch.n * log2(v / ch.n))), 0), 6) AS rep_content_word_entropy,
        round(coalesce((os.n - os.u) / os.n, 0), 6) AS rep_sentence_opener_repeat_ratio, coalesce(os.top, 0)::DOUBLE AS rep_max_opener_count
        FROM dw LEFT JOIN g2 USING (doc_id) LEFT JOIN g3 USING (doc_id) LEFT JOIN g4 USING (doc_id) LEFT JOIN g5 USING (doc_id) LEFT JOIN ch USING (doc_id) LEFT JOIN os USING (doc_id)""",
    "document_structure": f"""WITH {SURF}, {WHOLE}, pl AS (SELECT doc_id, para_id, list(sty_n_words ORDER BY sent_id) AS x FROM sent GROUP BY ALL), pw AS (SELECT doc_id, list(list_sum(x)) AS w, list(len(x)::DOUBLE) AS s, list(x[1]) AS f FROM pl GROUP BY doc_id),
        d AS (SELECT whole.*, pw.*, greatest(n_words, 1) AS nw, list_sum(s) AS ns FROM whole JOIN pw USING (doc_id))
        SELECT doc_id, round(ln(1 + ns), 6) AS doc_log_n_sentences, round(ln(1 + nw), 6) AS doc_log_n_words, round(ln(1 + n_chars), 6) AS doc_log_n_chars, len(w)::DOUBLE AS doc_n_paragraphs, round(list_avg(w), 6) AS doc_mean_paragraph_words, round(list_aggregate(w, 'stddev_pop'), 6) AS doc_std_paragraph_words,
        round(CASE WHEN list_avg(w) > 1e-9 THEN list_aggregate(w, 'stddev_pop') / list_avg(w) ELSE 0 END, 6) AS doc_cv_paragraph_words, round(list_avg(s), 6) AS doc_mean_sentences_per_paragraph, round(CASE WHEN list_avg(s) > 1e-9 THEN list_aggregate(s, 'stddev_pop') / list_avg(s) ELSE 0 END, 6) AS doc_cv_sentences_per_paragraph,
        list_max(w) AS doc_max_paragraph_words, list_min(w) AS doc_min_paragraph_words, round(nw / ns, 6) AS doc_words_per_sentence, round(kinds / nw, 6) AS doc_type_token_ratio, round(kinds / sqrt(nw), 6) AS doc_root_type_token_ratio, round(hapax / nw, 6) AS doc_hapax_ratio, round(syl / nw, 6) AS doc_mean_syllables_per_word,
        round(206.835 - 1.015 * (nw / ns) - 84.6 * (syl / nw), 6) AS doc_flesch_reading_ease, round(0.39 * (nw / ns) + 11.8 * (syl / nw) - 15.59, 6) AS doc_flesch_kincaid_grade, round(CASE WHEN list_avg(f) > 0 THEN list_aggregate(f, 'stddev_pop') / list_avg(f) ELSE 0 END, 6) AS doc_paragraph_first_sentence_len_cv,
        (len(w) <= 1)::INT::DOUBLE AS doc_has_single_paragraph FROM d""",
    "split_manifest": """WITH l AS (SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, n_chars FROM documents), e AS (SELECT unnest([lang, lang, '*', '*']) AS lang, unnest([source, '*', source, '*']) AS source, n_chars FROM l)
        SELECT lang, source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, round(avg(n_chars), 6) AS mean_chars FROM e GROUP BY ALL""",
}
