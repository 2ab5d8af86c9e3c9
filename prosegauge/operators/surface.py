"""The 37 surface measurements of each sentence (``sty_``) and the degraded syntax contract (``syn_``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as L
from prosegauge.functions import text as T
from prosegauge.functions.stats import array_sum, ratio

NAMES = (
    "n_words n_chars mean_word_len std_word_len max_word_len long_word_ratio short_word_ratio syllables_per_word ttr root_ttr hapax_ratio stopword_ratio content_word_ratio punct_density comma_rate "
    "semicolon_rate colon_rate dash_rate paren_rate quote_rate exclaim_rate question_rate ellipsis_rate digit_ratio uppercase_ratio capitalised_word_ratio contraction_rate colloquial_rate llm_phrase_rate "
    "transition_word_rate transition_phrase_rate sentence_initial_transition hedge_rate intensifier_rate first_person_rate nominalization_rate avg_commas_per_clause"
).split()
STY = [f"sty_{n}" for n in NAMES]
SYN = (
    [f"syn_pos_{t.lower()}" for t in L.POS_TAGS]
    + [f"syn_dep_{d}" for d in L.DEP_LABELS]
    + [
        f"syn_{n}"
        for n in (
            "n_clauses clauses_per_sentence max_dep_depth mean_dep_depth mean_dep_distance max_dep_distance passive_ratio subordinate_ratio coordination_ratio noun_verb_ratio adj_noun_ratio "
            "adverb_verb_ratio function_word_ratio pos_entropy dep_entropy starts_with_pronoun starts_with_conj starts_with_adverb starts_with_prep ends_with_period"
        ).split()
    ]
)


def _split(entries: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return tuple(e for e in entries if " " not in e), tuple(e for e in entries if " " in e)


def _among(words: Column, entries: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*entries)))


def hapaxes(ordered: Column) -> Column:
    """Words that occur once, in a sorted array."""
    return F.size(F.filter(ordered, lambda w, i: ((i == 0) | (F.get(ordered, i - 1) != w)) & ((i == F.size(ordered) - 1) | (F.get(ordered, i + 1) != w))))


def surface(sentences: DataFrame) -> DataFrame:
    """``sentences`` with its words in lower case (``words``) and the columns ``STY``."""
    s = sentences.withColumn("raw_words", T.words(F.col("text"))).withColumn("low", F.lower("text"))
    s = s.withColumn("words", F.transform("raw_words", F.lower)).withColumn("lens", F.transform("raw_words", F.length))
    s = s.withColumns({"ordered": F.array_sort("words"), "n": F.size("words"), "kinds": F.size(F.array_distinct("words")), "len_mean": F.when(F.size("lens") > 0, array_sum(F.col("lens")) / F.size("lens")).otherwise(0.0)})
    text, low, words, n = F.col("text"), F.col("low"), F.col("words"), F.col("n")
    chars = F.greatest(F.length(text), F.lit(1))
    stops = _among(words, L.FUNCTION_WORDS)
    count = lambda *parts: T.occurrences_of(text, parts)
    listed = lambda entries: _among(words, _split(entries)[0]) + (T.occurrences_of(low, _split(entries)[1]) if _split(entries)[1] else 0)
    per100 = lambda x: ratio(x, n, 100.0)
    punctuation = F.length(text) - F.length(F.translate(text, T.PUNCTUATION, ""))
    values = [
        n,
        F.length(text),
        F.col("len_mean"),
        F.when(n < 2, 0.0).otherwise(F.sqrt(array_sum(F.transform("lens", lambda x: (x - F.col("len_mean")) * (x - F.col("len_mean")))) / n)),
        F.coalesce(F.array_max("lens"), F.lit(0)),
        ratio(F.size(F.filter("lens", lambda x: x >= 7)), n),
        ratio(F.size(F.filter("lens", lambda x: x <= 3)), n),
        ratio(array_sum(F.transform(words, T.syllables)), n),
        ratio(F.col("kinds"), n),
        F.when(n == 0, 0.0).otherwise(F.col("kinds") / F.sqrt(n)),
        ratio(hapaxes(F.col("ordered")), n),
        ratio(stops, n),
        ratio(n - stops, n),
        per100(punctuation),
        per100(count(",")),
        per100(count(";")),
        per100(count(":")),
        per100(count("-", "–") + T.matches(text, rf"{T.BLANK}-{T.BLANK}")),
        per100(count("(", "[")),
        per100(count('"', "“", "”")),
        per100(count("!")),
        per100(count("?")),
        per100(count("...", "…")),
        T.matches(text, r"\p{Nd}") / chars,
        T.matches(text, r"\p{Lu}") / chars,
        ratio(F.size(F.filter("raw_words", lambda w: w.rlike("^[A-Z]"))), n),
        per100(T.matches(text, T.CONTRACTION)),
        per100(listed(L.COLLOQUIAL)),
        per100(T.occurrences_of(low, L.REGISTER_PHRASES)),
        per100(_among(words, L.TRANSITION_WORDS)),
        per100(T.occurrences_of(low, L.TRANSITION_PHRASES)),
        F.coalesce(F.get(words, F.lit(0)).isin(*L.TRANSITION_WORDS), F.lit(False)).cast("double"),
        per100(listed(L.HEDGES)),
        per100(_among(words, L.INTENSIFIERS)),
        per100(_among(words, L.FIRST_PERSON)),
        per100(F.size(F.filter(words, lambda w: (F.length(w) > 5) & w.rlike("(" + "|".join(L.NOMINAL_SUFFIXES) + ")$")))),
        count(","),
    ]
    return s.select(*sentences.columns, "words", *(v.cast("double").alias(name) for v, name in zip(values, STY, strict=True)))


def syntax(sentences: DataFrame) -> DataFrame:
    """Without a parser all syntax columns are zero but the final full stop."""
    zero = [F.lit(0.0).alias(c) for c in SYN[:-1]]
    return sentences.select("*", *zero, F.col("text").endswith(".").cast("double").alias(SYN[-1]))
