"""Values at a limit exactly fall on the side that the SQL has them on."""

from prosegauge.operators import features as X
from prosegauge.plans import decide as P
from prosegauge.plans.run import run
from prosegauge.queries import QUERIES


def test_paragraphs_at_a_limit_exactly(spark):
    cases = {1: [(0.377, 1), (0.394, 20), (0.411, 13)], 2: [(0.566, 6), (0.583, 2), (0.6, 24), (0.617, 4), (0.634, 2), (0.651, 2)], 3: [(0.359, 3), (0.376, 14), (0.393, 1), (0.41, 25), (0.427, 8)], 4: [(0.59, 47), (0.607, 26), (0.624, 12)]}
    rows = [(d, 0, i, n, s) for d, x in cases.items() for i, (s, n) in enumerate(x)]
    got = run(spark, P.ROLLUP, scored=spark.createDataFrame(rows, "doc_id long, para_id long, sent_id long, n_words long, score double")).collect()
    assert {r["doc_id"]: r["classification"] for r in got} == {1: "likely_human", 2: "likely_ai_assisted", 3: "likely_human", 4: "uncertain"}


def test_a_length_two_deviations_away_is_not_beyond(spark):
    rows = [(d, i, 0, *([1.0] * 2), n, z) for d, z in ((1, 2.0000000000000004), (2, 2.1)) for i, n in enumerate((4, 4, 4, 4, 9))]
    ctx = spark.createDataFrame(rows, "doc_id long, sent_id long, para_id long, lm_mean_logprob double, sty_root_ttr double, sty_n_words int, ctx_z_n_words double").selectExpr("*", "0D AS ctx_z_mean_logprob", "0D AS ctx_pos_js_to_doc", "0D AS ctx_style_distance_to_doc", "0D AS ctx_style_distance_to_prev", *(f"0D AS {c}" for c in X.STYLE if c != "sty_root_ttr"), *(f"1D AS {x}_{c}" for x in "ms" for c in X.STYLE))
    got = {r["doc_id"]: r["shift_frac_sent_abs_z_len_gt2"] for r in X.shift(ctx).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_statements_at_a_factor_exactly(spark):
    """A perplexity of 0.6 times the essay's but for rounding: sums go in the order of words, as the SQL has them."""
    s = QUERIES["sentence_statements"](spark, "/root/testdata/sf0.01").where("doc_id = 24 and sent_id in (36, 66, 96, 126)").collect()
    assert len(s) == 4 and not any("Perplexity" in r["statements"] for r in s)
