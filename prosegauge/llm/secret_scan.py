"""Secret scans (native): patterns, and sliding-window entropy over candidate strings.

Everything on the path is a Spark expression. Positions are code points. A pattern's matches and the text between them come from
one ``regexp_extract_all`` and one ``split``; running sums of their lengths give the spans.

Base kinds. ``assign``: a name such as ``password`` or ``api_key``, a separator and a value of 8 or more characters; ``access``: an
access key id of 16 or more; ``hex``: 32 or more lower-case hex digits. Matches are leftmost and do not overlap within a kind;
those that are too short are dropped after matching.

Entropy. Candidates are runs of ``[A-Za-z0-9+/_=-]``, of ``WINDOW`` characters or more. A window of ``WINDOW`` characters slides over each; the sum
of ``c log2 c`` over the counts c in the window is kept by the counts of the character that leaves and of the one that enters, so each step
costs two counts. Shannon entropy, ``log2 WINDOW - sum / WINDOW``, over the threshold of the run's character class makes the run a span of
kind ``entropy``. Long runs are cut into pieces of ``PIECE`` characters that overlap by a window less one, so that every window is in a piece and the
work grows with the run's length. Classes, by the run without separators ``+/_=-``: hex digits of one case, lower case and digits, upper case and digits, both cases, both and
digits; each has its own threshold (``BITS``). Digits alone and letters of one case alone are no class: they are numbers and words.

Allow-list. A run is suppressed if it is words, camel case or not, joined by separators; a uuid; a path in lower case; or short and with a placeholder in it (:func:`allowed`).
Suppression never touches base kinds.

Every pattern is a plain repetition of one character class: nested ones would fill the regex engine's stack on a run of some ten thousand characters.

Defined results: null and empty text have no spans; a text may be one run of any length; equal rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the base kinds, the group whose length counts, and its least length.
BASE = {
    "assign": (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character that a window must exceed, by class.
BITS = {"hex": 3.0, "lower_digits": 3.6, "upper_digits": 3.6, "letters": 3.95, "mixed": 3.7}
#: New characters of a piece of a long run; matches whose spans are added up in one go.
PIECE, CHUNK = 237, 256
SEPARATORS = "+/_=-"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
PLACEHOLDER_CHARS = 200
PLACEHOLDERS = r"(?i)example|placeholder|changeme|your[-_]|xxxx"
SPAN = "array<struct<kind: string, start: int, end: int, rank: int>>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(pairs: Column, kind: str, rank: int) -> Column:
    """Spans of the pairs (gap before a match, its length, does it count), in order."""
    name, start, end, place, at, out = (F.lit(x) for x in ("kind", "start", "end", "rank", "at", "out"))

    def step(acc: Column, p: Column) -> Column:
        here = acc["at"] + p["gap"]
        found = F.named_struct(name, F.lit(kind), start, here, end, here + p["n"], place, F.lit(rank))
        return F.named_struct(at, here + p["n"], out, F.when(p["ok"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]))

    def walk(some: Column) -> Column:
        return F.aggregate(some, F.named_struct(at, F.lit(0), out, F.array().cast(SPAN)), step)

    def put_together(parts: Column) -> Column:
        begins = F.aggregate(parts, F.named_struct(at, F.lit(0), out, F.array().cast("array<int>")), lambda acc, p: F.named_struct(at, acc["at"] + p["at"], out, F.concat(acc["out"], F.array(acc["at"]))))["out"]
        moved = lambda p, x: F.transform(p["out"], lambda s: F.named_struct(name, s["kind"], start, s["start"] + x, end, s["end"] + x, place, s["rank"]))
        return F.flatten(F.zip_with(parts, begins, moved))

    # arrays only grow within a chunk: one that grew over all matches would be copied for each
    chunks = _let(pairs, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda i: walk(F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)))))
    return F.when(F.size(pairs) > CHUNK, _let(chunks, put_together)).otherwise(walk(pairs)["out"])


def _matches(text: Column, pattern: str, keep, kind: str, rank: int) -> Column:
    """Spans of the matches that ``keep`` (of the match) accepts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = _let(found, lambda f: F.zip_with(f, F.slice(between, 1, F.size(f)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), keep(m).alias("ok"))))
    return F.when(text.rlike(pattern), _let(pairs, lambda p: _spans(p, kind, rank))).otherwise(F.array().cast(SPAN))


def _clogc(count: Column) -> Column:
    """c log2 c, from a table: counts are at most WINDOW."""
    return F.element_at(F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2))), count + 1)


def _count(window: Column, char: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def peak_entropy(run: Column) -> Column:
    """The greatest Shannon entropy of any window of ``run``, in bits a character; ``run`` has WINDOW characters or more."""
    first = F.substring(run, 1, WINDOW)
    distinct = F.array_distinct(F.split(first, ""))
    begin = F.aggregate(distinct, F.lit(0.0), lambda s, c: s + _clogc(_count(first, c)))
    steps = F.sequence(F.lit(1), F.length(run) - WINDOW + 1)

    def slide(acc: Column, i: Column) -> Column:
        # from the window at i - 1 to that at i: one character leaves, one enters
        old = F.substring(run, i - 1, F.lit(WINDOW))
        out, into = F.substring(run, i - 1, F.lit(1)), F.substring(run, i + F.lit(WINDOW - 1), F.lit(1))
        gone, had = _count(old, out), _count(old, into) - (out == into).cast("int")
        s = F.when(i == 1, acc["s"]).otherwise(acc["s"] - _clogc(gone) + _clogc(gone - 1) - _clogc(had) + _clogc(had + 1))
        # where the same character leaves and enters, the two changes cancel
        s = F.when((i > 1) & (out == into), acc["s"]).otherwise(s)
        return F.struct(s.alias("s"), F.least(acc["low"], s).alias("low"))

    low = F.aggregate(steps, F.struct(begin.alias("s"), F.lit(1e9).alias("low")), slide, lambda acc: acc["low"])
    return F.lit(math.log2(WINDOW)) - low / WINDOW


def most_entropy(piece: Column) -> Column:
    """An upper bound for all windows, by the piece's distinct characters."""
    return F.log2(F.size(F.array_distinct(F.split(piece, ""))).cast("double"))


def pieces(run: Column) -> Column:
    """A run as pieces of PIECE characters, each with the first WINDOW - 1 of the next: every window is in one."""
    cut = F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    return _let(cut, lambda c: F.filter(F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: F.concat(x, F.coalesce(F.substring(y, 1, WINDOW - 1), F.lit("")))), lambda x: F.length(x) >= WINDOW))


def allowed(run: Column) -> Column:
    """Is the run on the allow-list?"""
    # words joined by single separators; both cases only in camel case: a small letter before a capital once in five characters at most
    joined = run.rlike(r"^[A-Za-z][A-Za-z/_=+-]*$") & ~run.rlike(r"[/_=+-]$") & ~run.rlike(r"[/_=+-]{2}") & (5 * F.regexp_count(run, F.lit("[a-z][A-Z]")) <= F.length(run))
    path = run.rlike(r"^[a-z0-9/_-]+$") & run.rlike(r"[a-z0-9_-]/") & ~run.contains("//")
    # a long run has such a part by chance
    return joined | path | run.rlike(UUID) | ((F.length(run) <= PLACEHOLDER_CHARS) & run.rlike(PLACEHOLDERS))


def class_bits(run: Column) -> Column:
    """The threshold of the run's class; null if it has none."""
    bare = F.translate(run, SEPARATORS, "")
    lower, upper, digit = bare.rlike("[a-z]"), bare.rlike("[A-Z]"), bare.rlike("[0-9]")
    hexed = digit & (lower | upper) & (bare.rlike("^[0-9a-f]+$") | bare.rlike("^[0-9A-F]+$"))
    kinds = {"hex": hexed, "mixed": lower & upper & digit, "lower_digits": lower & digit, "upper_digits": upper & digit, "letters": lower & upper}
    out = F.lit(None).cast("double")
    for k in reversed(kinds):
        out = F.when(kinds[k], BITS[k]).otherwise(out)
    return out


def _secret_like(run: Column) -> Column:
    return _let(class_bits(run), lambda bits: F.when(bits.isNull() | allowed(run), False).otherwise(F.exists(pieces(run), lambda p: (most_entropy(p) > bits) & (peak_entropy(p) > bits))))


def find_secrets(text: Column) -> Column:
    """Array of (kind, start, end, rank): all base spans and entropy spans, by start, then kind as listed, ``entropy`` last."""
    t = F.coalesce(text, F.lit(""))
    kinds = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        keep = (lambda m, p=pattern, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n) if group else (lambda m, n=least: F.length(m) >= n)
        # runs of hex digits are everywhere, long ones are not; a maximal run that is long enough is found with or without the short ones
        kinds.append(_matches(t, pattern if kind == "assign" else f"{pattern[:-1]}{{{least - (4 if kind == 'access' else 0)},}}", keep, kind, rank))
    kinds.append(_matches(t, CANDIDATE, _secret_like, "entropy", len(BASE)))
    return F.array_sort(F.concat(*kinds), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
