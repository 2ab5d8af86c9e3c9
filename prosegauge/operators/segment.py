"""Paragraphs and sentences with code-point offsets.

A sentence ends after ``.``, ``!`` or ``?`` where closers, white space and then a capital, a quote or an opening bracket follow, unless the
stop belongs to an abbreviation. One pattern marks those places with two control characters, each text is split once, and one window
per document, ordered by piece, turns the pieces' lengths into offsets and their runs of newlines into paragraph numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.functions.lexicons import ABBREVIATIONS
from prosegauge.functions.text import BLANK

END, NEXT = "\x01", "\x02"
#: The stop is asked for first, so that all else is only tried at stops.
ABBREVIATED = r"(?<!(?<![\p{L}\p{N}_])(?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.)"
BOUNDARY = rf"([.!?]){ABBREVIATED}([\"')\]]*+{BLANK}++)(?=[\"'(\[A-Z])"
SPACES = " \t\n\r\f\x0b"
#: Runs of white space with one newline or more, and with two or more.
LINE_GAP, BLANK_LINE = rf"\n{BLANK}*+", rf"\n[ \t\r\f\x0B]*+\n{BLANK}*+"


def marked(text: Column) -> Column:
    """The text with END before and NEXT after the gap at each sentence boundary."""
    t = F.translate(F.coalesce(text, F.lit("")), END + NEXT, "")
    return F.regexp_replace(t, BOUNDARY, f"$1{END}$2{NEXT}")


def by_blank_lines(text: Column) -> Column:
    """Are there blank lines between parts of the text? Else single newlines part its paragraphs."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES)).rlike(r"\n[ \t\r\f\x0B]*\n")


def pieces(text: Column) -> Column:
    """Of each text an array of (text, gaps): its trimmed pieces, empty ones too, and the paragraph breaks in each."""

    def by(gap: str) -> Column:
        def one(x: Column, i: Column) -> Column:
            seen = F.when(i == 0, F.ltrim(x, F.lit(SPACES))).otherwise(x)
            return F.struct(F.trim(F.split_part(x, F.lit(END), F.lit(1)), F.lit(SPACES)).alias("text"), F.regexp_count(seen, F.lit(gap)).alias("gaps"))

        return F.transform(F.split(marked(text), NEXT, -1), one)

    # the kind of gap is asked for once a text: inside the lambda it would be sought anew for each piece
    return F.when(by_blank_lines(text), by(BLANK_LINE)).otherwise(by(LINE_GAP))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, para_id, start, end, text); ids count from 0 without gaps, empty pieces are dropped."""
    # the outer form: for the plain one a filter on the number of pieces is inferred, which splits each text twice
    # the kind of gap first: beside the generator it would be sought in the whole text for each piece
    kinds = docs.select("doc_id", "text", by_blank_lines(F.col("text")).alias("blank"))
    pieces = kinds.select("doc_id", "blank", F.posexplode_outer(F.split(marked(F.col("text")), NEXT, -1)).alias("i", "piece"))
    # white space before the first sentence is no gap between paragraphs
    seen = F.when(F.col("i") == 0, F.ltrim(F.col("piece"), F.lit(SPACES))).otherwise(F.col("piece"))
    gaps = F.when(F.col("blank"), F.regexp_count(seen, F.lit(BLANK_LINE))).otherwise(F.regexp_count(seen, F.lit(LINE_GAP)))
    raw = F.split_part(F.col("piece"), F.lit(END), F.lit(1))
    n = F.length("piece") - F.when(F.col("piece").contains(END), 1).otherwise(0)
    parts = pieces.select("doc_id", "i", n.alias("n"), gaps.alias("gaps"), raw.alias("raw"))
    by = Window.partitionBy("doc_id").orderBy("i")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "para": F.coalesce(F.sum("gaps").over(before), F.lit(0))})
    parts = parts.withColumns({"text": F.trim(F.col("raw"), F.lit(SPACES)), "start": F.col("at") + F.length("raw") - F.length(F.ltrim(F.col("raw"), F.lit(SPACES)))}).where("text <> ''")
    # paragraphs in which no sentence starts do not count
    fresh = F.when(F.col("para") == F.lag("para", 1).over(by), 0).otherwise(1)
    parts = parts.withColumn("fresh", fresh)
    return parts.select(
        "doc_id",
        (F.row_number().over(by) - 1).cast("long").alias("sent_id"),
        (F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long").alias("para_id"),
        F.col("start").cast("long").alias("start"),
        (F.col("start") + F.length("text")).cast("long").alias("end"),
        "text",
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_id, n_sentences, start, end): a row a paragraph."""
    s = sentences(docs)
    return s.groupBy("doc_id", "para_id").agg(F.count("sent_id").alias("n_sentences"), F.min("start").alias("start"), F.max("end").alias("end"))
