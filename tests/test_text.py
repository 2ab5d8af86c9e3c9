from pyspark.sql import functions as F

from prosegauge.functions import lexicons as L
from prosegauge.functions import text as T
from prosegauge.operators.segment import sentences
from prosegauge.operators.surface import STY, SYN, surface, syntax


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_widths():
    assert (len(L.FUNCTION_WORDS), len(STY), len(SYN)) == (171, 37, 69)


def test_normalise(spark):
    assert one(spark, T.normalise, "a​b\x01  c\r\nd \t\n\n\n\n\n eﬁ ") == "ab c\nd\n\n eﬁ".replace("ﬁ", "fi")


def test_limits(spark):
    cases = {"": "empty", " \n": "empty", "x": "too_short", "x" * 200: "ok", "x" * 60_001: "too_long"}
    assert {t: one(spark, T.verdict_of_length, t) for t in cases} == cases


def test_scrub_order(spark):
    assert one(spark, T.scrub, "a.b@c.de or +1 (555) 123-4567, 123-45-6789") == "<email> or <phone>, <phone>"


def test_sentences(spark):
    text = 'Dr. Smith came, e.g. at 5. He said "Go!" Then left. no capital.\nnew line'
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "One.\n\nTwo! Three?")], "doc_id long, text string")
    rows = sorted(sentences(df).collect(), key=lambda r: (r.doc_id, r.sent_id))
    got = {d: [(r.text, r.para_id) for r in rows if r.doc_id == d] for d in (1, 2, 3, 4)}
    assert [t for t, _ in got[1]] == ["Dr. Smith came, e.g. at 5.", 'He said "Go!', "Then left. no capital.\nnew line"]
    assert got[2] == got[3] == [] and got[4] == [("One.", 0), ("Two!", 1), ("Three?", 1)]
    assert all(r.text == (text if r.doc_id == 1 else "One.\n\nTwo! Three?")[r.start : r.end] for r in rows)


def test_surface_of_one_sentence(spark):
    df = spark.createDataFrame([(1, 0, "However, I don't think it's very important - not at all!")], "doc_id long, sent_id long, text string")
    r = syntax(surface(df)).first()
    assert r.sty_n_words == 10 and r.sty_contraction_rate == 20 and r.sty_sentence_initial_transition == 1 and r.sty_dash_rate == 20 and r.syn_ends_with_period == 0
