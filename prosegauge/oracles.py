"""DuckDB SQL for the queries of the package proper. Sentences and their measurements are computed here anew, by DuckDB's own means."""

from __future__ import annotations

from prosegauge.functions import lexicons as L
from prosegauge.operators.surface import STY
from prosegauge.plans import corpus as C
from prosegauge.plans import decide as V
from prosegauge.plans import documents as P
from prosegauge.plans import store as S
from prosegauge.plans.run import dialect


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(entries) -> str:
    return "[" + ", ".join(map(q, entries)) + "]"


_B = r"[ \t\n\r\f\v]"
_ABBR = r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(a.replace(".", r"\.") for a in L.ABBREVIATIONS) + r")\.\x01([^\x02]*)\x02"
_SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BOUNDARY = r"([.!?])([\"')\]]*" + _B + r"+)([\"'(\[A-Z])"


def _unmark(x: str) -> str:
    return f"regexp_replace({x}, {q(_ABBR)}, '\\1\\2.\\3', 'g')"


_MARKED = _unmark(_unmark(f"regexp_replace(text, {q(_BOUNDARY)}, '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"))


def _para(pattern: str) -> str:
    return f"""SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS off, full_ FROM (
    SELECT doc_id, i, len(p) - CASE WHEN contains(p, chr(1)) THEN 1 ELSE 0 END AS n, trim(split_part(p, chr(1), 1), {_SP}) <> '' AS full_
    FROM (SELECT doc_id, unnest(string_split(m, chr(2))) AS p, generate_subscripts(string_split(m, chr(2)), 1) AS i FROM (SELECT doc_id, regexp_replace(text, {q(pattern)}, chr(1) || '\\0' || chr(2), 'g') AS m FROM src)))"""


SENT = rf"""src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pb AS ({_para(chr(92) + 'n' + _B + '*' + chr(92) + 'n')}),
pn AS ({_para(chr(92) + 'n')}),
kb AS (SELECT s.doc_id, (count(*) FILTER (full_) <= 1 AND any_value(contains(s.text, chr(10)))) AS lines FROM src s LEFT JOIN pb USING (doc_id) GROUP BY s.doc_id),
ps AS (SELECT doc_id, list(off) AS starts FROM (SELECT pb.doc_id, off FROM pb JOIN kb USING (doc_id) WHERE NOT lines AND full_ UNION ALL SELECT pn.doc_id, off FROM pn JOIN kb USING (doc_id) WHERE lines AND full_) GROUP BY doc_id),
pc AS (SELECT doc_id, unnest(string_split(m, chr(2))) AS p, generate_subscripts(string_split(m, chr(2)), 1) AS i FROM (SELECT doc_id, {_MARKED} AS m FROM src)),
pp AS (SELECT doc_id, i, split_part(p, chr(1), 1) AS raw, len(p) - CASE WHEN contains(p, chr(1)) THEN 1 ELSE 0 END AS n FROM pc),
pt AS (SELECT doc_id, raw, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS off FROM pp),
pr AS (SELECT doc_id, trim(raw, {_SP}) AS text, off + len(raw) - len(ltrim(raw, {_SP})) AS st FROM pt),
pq AS (SELECT pr.doc_id, pr.text, st, greatest(0, len(list_filter(coalesce(starts, []), lambda x: x <= st)) - 1) AS para FROM pr LEFT JOIN ps USING (doc_id) WHERE pr.text <> ''),
s0 AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1)::BIGINT AS sent_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY para) - 1)::BIGINT AS para_id, st::BIGINT AS "start", (st + len(text))::BIGINT AS "end", text FROM pq)"""

_SYL = "CASE WHEN {w} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({w}, '[aeiouy]+')) - CASE WHEN {w} LIKE '%e' AND NOT regexp_matches({w}, '(le|ee|ye)$') AND len(regexp_extract_all({w}, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"
_SYLS = "coalesce(list_sum(list_transform(list_transform(l, lambda x: trim(x, '''-')), lambda x: " + _SYL.format(w="x") + ")), 0)"


def _times(text: str, parts) -> str:
    return "(" + " + ".join(f"(len({text}) - len(replace({text}, {q(p)}, ''))) // {len(p)}" for p in parts) + ")"


def _in(entries) -> str:
    return f"len(list_filter(l, lambda x: list_contains({listed(entries)}, x)))"


def _mixed(entries) -> str:
    plain, spaced = [e for e in entries if " " not in e], [e for e in entries if " " in e]
    return _in(plain) + (" + " + _times("low", spaced) if spaced else "")


def _per(x: str, per: str = "100.0") -> str:
    return f"CASE WHEN n = 0 THEN 0.0 ELSE ({x}) * {per} / n END"


# boundaries are doubled first, so that neighbouring contractions do not share one
_CONTRACTED = "len(regexp_extract_all(regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'), " + q(r"(?i)(^|[^\p{L}\p{N}_])(" + L.CONTRACTIONS + r")($|[^\p{L}\p{N}_])") + "))"
_PUNCT = "[,.;:!?–()\\[\\]\"'…-]"
_VALUES = [
    "n",
    "len(text)",
    "coalesce(list_avg(ln), 0.0)",
    "CASE WHEN n < 2 THEN 0.0 ELSE list_aggregate(ln, 'stddev_pop') END",
    "coalesce(list_max(ln), 0)",
    _per("len(list_filter(ln, lambda x: x >= 7))", "1.0"),
    _per("len(list_filter(ln, lambda x: x <= 3))", "1.0"),
    _per(_SYLS, "1.0"),
    _per("list_unique(l)", "1.0"),
    "CASE WHEN n = 0 THEN 0.0 ELSE list_unique(l) / sqrt(n) END",
    _per("len(list_filter(map_values(list_aggregate(l, 'histogram')), lambda x: x = 1))", "1.0"),
    _per(_in(L.FUNCTION_WORDS), "1.0"),
    _per(f"n - {_in(L.FUNCTION_WORDS)}", "1.0"),
    _per(f"len(regexp_extract_all(text, {q(_PUNCT)}))"),
    _per(_times("text", ",")),
    _per(_times("text", ";")),
    _per(_times("text", ":")),
    _per(f"{_times('text', '-–')} + len(regexp_extract_all(text, {q(_B + '-' + _B)}))"),
    _per(_times("text", "([")),
    _per(_times("text", '"“”')),
    _per(_times("text", "!")),
    _per(_times("text", "?")),
    _per(_times("text", ["...", "…"])),
    "len(regexp_extract_all(text, '\\p{Nd}')) / greatest(len(text), 1)",
    "len(regexp_extract_all(text, '\\p{Lu}')) / greatest(len(text), 1)",
    _per("len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]')))", "1.0"),
    _per(_CONTRACTED),
    _per(_mixed(L.COLLOQUIAL)),
    _per(_times("low", L.REGISTER_PHRASES)),
    _per(_in(L.TRANSITION_WORDS)),
    _per(_times("low", L.TRANSITION_PHRASES)),
    f"CASE WHEN n > 0 AND list_contains({listed(L.TRANSITION_WORDS)}, l[1]) THEN 1.0 ELSE 0.0 END",
    _per(_mixed(L.HEDGES)),
    _per(_in(L.INTENSIFIERS)),
    _per(_in(L.FIRST_PERSON)),
    _per(f"len(list_filter(l, lambda x: len(x) > 5 AND regexp_matches(x, {q('(' + '|'.join(L.NOMINAL_SUFFIXES) + ')$')})))"),
    _times("text", ","),
]
_WORDS = "regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*')"
SURF = (
    SENT
    + f""",
s1 AS (SELECT *, {_WORDS} AS w, lower(text) AS low FROM s0),
s2 AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l, list_transform(w, lambda x: len(x)) AS ln, len(w) AS n FROM s1),
sent AS (SELECT doc_id, sent_id, para_id, "start", "end", text, """
    + ", ".join(f"({v})::DOUBLE AS {c}" for v, c in zip(_VALUES, STY, strict=True))
    + " FROM s2)"
)
TOK = (
    SENT
    + f""",
s1 AS (SELECT doc_id, sent_id, list_transform({_WORDS}, lambda x: lower(x)) AS l FROM s0),
t0 AS (SELECT doc_id, sent_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM s1),
tok AS (SELECT doc_id, sent_id, pos, sent_id * 16777216 + pos AS n, w, CASE WHEN list_contains({listed(L.FUNCTION_WORDS)}, w) THEN 0 ELSE 1 END AS content, CASE WHEN list_contains({listed(P.DULL)}, w) THEN 1 ELSE 0 END AS dull FROM t0)"""
)
WHOLE = f"""whole AS (SELECT doc_id, len(text) AS n_chars, len(l) AS n_words, list_unique(l) AS kinds, len(list_filter(map_values(list_aggregate(l, 'histogram')), lambda x: x = 1)) AS hapax, {_SYLS} AS syl
FROM (SELECT doc_id, text, list_transform({_WORDS}, lambda x: lower(x)) AS l FROM src))"""


def over(base: str, plan: str) -> str:
    """``plan`` for DuckDB, with ``base`` as further common tables."""
    plan = dialect(plan, 1).strip()
    if not base:
        return plan
    return f"WITH {base}, {plan[4:].strip()}" if plan.upper().startswith("WITH") else f"WITH {base} {plan}"


_KEY = f"trim(regexp_replace(lower(coalesce(text, '')), {q(_B + '+')}, ' ', 'g'))"
KEYED = f"keyed AS (SELECT *, md5({_KEY}) AS key_hash FROM documents)"
_SPACED = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), {q(_B + '+')}), lambda x: x <> '')"


def _shingles(name: str, key: str, table: str, as_key: str) -> str:
    return f"""{name} AS (SELECT DISTINCT {as_key}, md5(list_aggregate(w[i:i + 4], 'string_agg', ' ')) AS shingle FROM (SELECT {key} AS {as_key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {key}, {_SPACED} AS w FROM {table})))"""


SHINGLES = _shingles("left_shingles", "doc_id", "documents", "doc_id") + ", " + _shingles("right_shingles", "item_id", "benchmark", "ref_id")
SELF_SHINGLES = _shingles("left_shingles", "doc_id", "(SELECT * FROM documents WHERE doc_id % 10 >= 7)", "doc_id") + ", " + _shingles("right_shingles", "doc_id", "(SELECT * FROM documents WHERE doc_id % 10 < 7)", "ref_id")
_FEATURES = ["bur_mean_sent_len", "bur_cv_sent_len", "bur_burstiness_index", "bur_sent_len_entropy", "bur_cv_word_len"]
MELTED = (
    SURF
    + ", rhythm AS (SELECT * FROM ("
    + dialect(P.RHYTHM, 1).strip()
    + ")), melted AS (SELECT l.doc_id, b.quality, l.feature, l.value::DOUBLE AS value FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS feature, {f} AS value FROM rhythm" for f in _FEATURES)
    + ") l LEFT JOIN labels b USING (doc_id))"
)
VECTORS = "vectors AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)"
FOLDED = f"words AS (SELECT doc_id, doc_id % 2 AS fold, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''\\-]*'), lambda x: lower(x)) AS l FROM documents))"
TEXTS = f"""texts0 AS (SELECT conv_id * 1000 + turn AS id, role AS label, text FROM conversations WHERE role <> 'system'), texts AS (SELECT id, label FROM texts0),
padded AS (SELECT id, ' ' || unnest({_SPACED}) || ' ' AS p FROM texts0),
grams AS (SELECT id, unnest(CASE WHEN len(p) <= k THEN CASE WHEN k = 3 OR len(p) > k - 1 THEN [p] ELSE [] END ELSE list_transform(range(1, len(p) - k + 2), lambda i: substr(p, i, k)) END) AS gram FROM padded, (SELECT unnest([3, 4, 5]) AS k))"""
_W = [f"((doc_id * {m} % 101) + 1 + CASE WHEN y = {k} THEN 60 ELSE 0 END)::DOUBLE" for k, m in enumerate((37, 53, 71))]
PRED = (
    "base AS (SELECT d.doc_id, lang, source, len(text) AS n_chars, ((quality + d.doc_id) % 3)::INTEGER AS y FROM documents d JOIN labels USING (doc_id)), pred AS (SELECT doc_id, lang, source, y, "
    + ", ".join(f"{w} / ({' + '.join(_W)}) AS p{k}" for k, w in enumerate(_W))
    + ", (n_chars // 60)::BIGINT AS n_sentences, (n_chars // 6)::BIGINT AS n_words FROM base)"
)
SCORED = SENT + f", scored AS (SELECT doc_id, sent_id, para_id, len({_WORDS}) AS n_words, ((doc_id * 131 + sent_id * 17) % 1000) / 1000.0::DOUBLE AS score FROM s0)"
_PHONE = r"(^|[^0-9])(\+?[0-9][0-9\s().-]{7,}[0-9])"

ORACLES: dict[str, str] = {
    "sentence_split": f'WITH {SENT} SELECT doc_id, sent_id, para_id, "start", "end", text FROM s0',
    "paragraph_spans": f'WITH {SENT} SELECT doc_id, para_id, count(*) AS n_sentences, min("start") AS "start", max("end") AS "end" FROM s0 GROUP BY doc_id, para_id',
    "surface_features": f"WITH {SURF} SELECT doc_id, sent_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in STY) + " FROM sent",
    "repeated_spans": over(TOK, P.REPEATED_SPANS),
    "validate_documents": f"""SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), {q(_B)}, '', 'g') = '' THEN 'empty' WHEN len(text) > 60000 THEN 'too_long' WHEN len(text) < 200 THEN 'too_short' ELSE 'ok' END AS status,
        len(coalesce(text, ''))::BIGINT AS n_chars, len({_SPACED})::BIGINT AS n_words, sha256(coalesce(text, '') || chr(0) || '1.0.0' || chr(0) || '1.0.0') AS content_hash FROM documents""",
    "reference_percentiles": over(MELTED, C.REFERENCE),
    "percentile_lookup": over(MELTED, C.PERCENTILE_LOOKUP),
    "iqr_outliers": over(MELTED, C.OUTLIERS),
    "centroid_cosine_embeddings": over(VECTORS, C.NEAREST_CENTROID),
    "ngram_lm_scores": over(FOLDED, C.NGRAM_SCORES),
    "auc_by_class": over(PRED, V.AUC),
    "roc_pr_curves": over(PRED, V.CURVES),
    "scrub_pii": f"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, {q(chr(91) + 'a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+' + chr(92) + '.[a-zA-Z0-9_.]+')}, '<email>', 'g'), {q(_PHONE)}, '\\1<phone>', 'g'), '\\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\\b', '<ssn>', 'g')) AS scrubbed FROM documents",
}
