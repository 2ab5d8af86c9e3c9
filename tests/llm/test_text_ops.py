import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosegauge.llm import packing, simhash
from prosegauge.llm.decontaminate import Automaton, decontaminate, judge, remove_contamination, words
from prosegauge.llm.language import UND, decide, entropies, language_id
from prosegauge.llm.oracles import OP4
from prosegauge.llm.lines import expand, kept_text, line_dedup

EDGE = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x\ny"), (5, "word " * 30_000), (6, "\n\n \t\n")]


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names an operator might use itself
    return df.withColumns({c: F.lit(c) for c in ("id", "th", "drops", "fp", "n_lines", "row", "part", "size")}) if extra else df


# ---- packing


FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def whole_windows(out):
    """No gap, no overlap, no padding but at a power of two."""
    lengths = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert max(lengths.values()) <= 1024
    assert all(n & (n - 1) == 0 for n in lengths.values())


def test_packing_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "größe", "x1", "\n", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext", "  ", "漢字"]) for _ in range(rng.choice([0, 3, 60, 900, 5000])))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, "hello <|endoftext|> world"), (1003, " " * 1_000_000), (1004, "aB-" * 300_000), (1005, "x" + "\n" * 50_000 + "y")]
    out = packing.pack(docs_of(spark, rows, extra=True).repartition(5), *FILES, open_windows=4).collect()
    t = Tokenizer.from_file(FILES[0])
    assert t.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for d, text in rows:
        if d == 1001:
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in out if r.doc_id == d), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and 4 * r.length == len(r.ids) for r in mine)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
    assert len([r for r in out if r.doc_id == 1001]) == 2
    whole_windows(out)


def test_packing_last_partition_full(spark):
    """The last partition leaves no open window; merged leftovers still get sequence ids of their own."""
    rows = [(i, "the " * 40) for i in range(8)]
    n = len(packing.Encoder(*FILES).encode("x")) + 1
    rows += [(100 + i, "x") for i in range(1024 // n)]
    df = docs_of(spark, rows[:8]).coalesce(1).union(docs_of(spark, rows[8:]).coalesce(1))
    whole_windows(packing.pack(df, *FILES).collect())


def test_packing_empty(spark):
    assert packing.pack(docs_of(spark, []), *FILES).count() == 0


def test_ids_without_ranks():
    slow, fast = packing.Encoder(FILES[0]), packing.Encoder(*FILES)
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", " ", "\n", "\u3000", "é", "'s", "12", "<|", "endoftext", "|>", "😀", "\u0301", "\x00", "\x85", "\xa0"]) for _ in range(60))
        assert slow.encode(text) == fast.encode(text)


def test_best_fit_and_fullest():
    p = packing.Packer(10, 2)
    put = lambda d, n: list(p.take((d, 0, np.arange(n, dtype="<u4"), n)))
    assert not put("a", 6) and not put("b", 7) and not put("c", 3) == []
    assert [w.used for w in p.rest] == [6]
    put("d", 8)
    full = put("e", 5)  # fits nowhere: the fullest, d's, is topped up
    assert [x[0] for x in full[0].pieces] == ["d", "e"] and sorted(w.used for w in p.rest) == [3, 6] or sorted(w.used for w in p.rest) == [9]


# ---- line dedup


def brute_lines(rows, mode, min_docs, min_chars):
    seen = {}
    order = sorted({(d is not None, d, t or "") for d, t in rows}, key=lambda x: (x[0], x[1] or 0, x[2]))
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for _, d, t in order:
        for x in t.split("\n"):
            seen.setdefault(key(x), []).append((d, t))
    held = {k: len({d for d, _ in v if d is not None} if mode == "frequent" else set(v)) for k, v in seen.items()}
    out = {}
    first = set()
    for _, d, t in order:
        kept = []
        for x in t.split("\n"):
            k = key(x)
            many = len(k) >= min_chars and held[k] >= min_docs
            drop = many and (mode == "frequent" or k in first)
            first.add(k)
            if not drop:
                kept.append(x)
        out[d, t] = ("\n".join(kept), len(t.split("\n")) - len(kept))
    return out


@pytest.mark.parametrize("mode,min_docs,min_chars", [("frequent", 3, 1), ("first", 1, 1), ("first", 2, 4), ("frequent", 1, 1)])
def test_line_dedup_brute(spark, mode, min_docs, min_chars):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["A b", " a B\t", "É", "é", "common", "zz", "", f"own {i}"]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(7, "twice\nhere"), (7, "twice\nhere"), (8, "twice"), (9, "twice")]
    rows += [r for r in EDGE if r[0] != 5] + [(500, "common\n" * 3000 + "end")]
    out = line_dedup(docs_of(spark, rows, extra=True), mode=mode, min_docs=min_docs, min_chars=min_chars)
    got = out.select("doc_id", "text", "row", "n_lines", "n_dropped", F.size(expand(F.col("keep_bitmap"))).alias("bits"), kept_text(F.col("text"), F.col("keep_bitmap")).alias("kept")).collect()
    want = brute_lines(rows, mode, min_docs, min_chars)
    assert len(got) == len(rows)
    for r in got:
        if mode == "first" and (r.doc_id, r.text or "") not in want:
            continue
        assert (r.kept, r.n_dropped) == want[r.doc_id, r.text or ""], (r.doc_id, r.text)
        assert r.bits == r.n_lines and r.row == "row"


def test_line_dedup_hot(spark):
    """Past 13,000 pairs the sketch names hot keys; the result stays that of the plain definition."""
    rows = [(i, f"hot line\nline {i}\nhalf {i // 2}") for i in range(9000)]
    df = docs_of(spark, rows)
    for mode in ("frequent", "first"):
        got = {r.doc_id: r.n_dropped for r in line_dedup(df, mode=mode, min_docs=3).collect()}
        assert sum(got.values()) == (9000 if mode == "frequent" else 8999)
    assert line_dedup(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("mode", ["frequent", "first"])
def test_line_dedup_repeated_row(spark, mode):
    """Rows that agree in id and text are one document, however many they are."""
    rows = [(1, "alpha\nbeta\nalpha")] * 20 + [(2, "gamma"), (3, "beta")]
    got = line_dedup(docs_of(spark, rows), mode=mode, min_docs=10).collect()
    assert len(got) == 22 and all(r.n_dropped == 0 for r in got)


def test_line_dedup_against_sql(spark):
    """The query's SQL on rows that repeat, ids that repeat with other texts, and rows without an id."""
    import duckdb
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(1, "only line")] * 20  # one document
    rows += [(i, f"six ids\n{j}") for i in range(10, 16) for j in (0, 1)]  # six documents
    rows += [(i, "ten ids\nx") for i in range(20, 29)] + [(29, "TEN IDS "), (29, "y")]
    rows += [(i, "nine ids") for i in range(30, 39)] + [(None, "nine ids"), (None, "Nine ids"), (None, "ten ids")]
    rows += [(rng.choice([None, *range(40, 60)]), "\n".join(rng.choice(["a", " A", "b", "", "c d"]) for _ in range(4))) for _ in range(80)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    want = sorted(con.execute(OP4).fetchall(), key=str)
    out = line_dedup(docs_of(spark, rows, extra=True), mode="frequent", min_docs=10)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep_bitmap")).cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == want
    dropped = {(r.doc_id, r.text): r.n_dropped for r in out.select("doc_id", "text", "n_dropped").collect()}
    assert dropped[1, "only line"] == dropped[10, "six ids\n0"] == dropped[30, "nine ids"] == 0 and dropped[20, "ten ids\nx"] == dropped[None, "ten ids"] == 1


# ---- SimHash


def root_of(prints, max_bits):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= max_bits:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}


def flipped(rng, width, n):
    """Clusters of chained near fingerprints, some large."""
    out = []
    while len(out) < n:
        base = rng.getrandbits(width)
        for _ in range(rng.choice([1, 2, 5, 60])):
            out.append(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(width)
    return out[:n]


@pytest.mark.parametrize("width,segments,max_bits", [(64, 2, 2), (128, 4, 6)])
def test_links_brute(spark, width, segments, max_bits):
    rng = random.Random(width)
    k = width // 64
    prints = {i: [v >> 64 * j & (1 << 64) - 1 for j in range(k)] for i, v in enumerate(flipped(rng, width, 400))}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [tuple(map(signed, v)) for v in {tuple(v) for v in prints.values()}]
    fps = spark.createDataFrame(rows, ", ".join(f"f{j} long" for j in range(k)))
    comp = {tuple(r.node): tuple(r.root) for r in simhash.components(simhash.links(fps, width, segments, max_bits)).collect()}
    got, want = {}, root_of(prints, max_bits)
    for i, v in prints.items():
        s = tuple(map(signed, v))
        got.setdefault(comp.get(s, s), set()).add(i)
    groups = {}
    for i, r in want.items():
        groups.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_fingerprint_definition():
    import xxhash

    ws = "Alpha beta\x0bgamma  x delta alpha BETA gamma".encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(len(ws) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(b" ".join(ws), 3) == [want]
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(b" \n", 3) == [0]
    assert simhash.fingerprint(b"One two", 3) == [xxhash.xxh64_intdigest(b"one two", 42)]


def test_near_dedup_edges(spark):
    rows = [*EDGE, (7, "p q r s t"), (8, "P q r s t"), (9, "p q r s t")]
    df = docs_of(spark, rows, extra=True)
    got = {r.doc_id: r.component_id for r in simhash.near_dedup(df, shingle=3).collect()}
    assert got[1] == got[2] == got[6] == 1 and got[8] == got[9] == got[7] == 7 and got[None] is None
    kept = simhash.keep_one(df, shingle=5, width=192, segments=9, max_bits=30)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 7] and kept.columns == df.columns
    assert simhash.near_dedup(docs_of(spark, [])).count() == 0


# ---- decontamination


def brute_hits(text, items, window):
    seq, hit, found = words((text or "").encode()), set(), set()
    for name, t in items:
        w = words(t.encode())
        m = min(window, len(w))
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(seq) - m + 1 if m else 0):
            if tuple(seq[i : i + m]) in grams:
                found.add(name)
                hit |= set(range(i, i + m))
    return len(seq), len(hit), sorted(found)


def test_automaton_brute():
    rng = random.Random(5)
    pick = lambda n: " ".join(rng.choice("a b c d É".split()) for _ in range(n))
    for round_ in range(60):
        items = [(str(k), pick(rng.choice([0, 1, 2, 4, 5, 9, 14]))) for k in range(6)] + [("dup", "a b c d É")] * (round_ % 2)
        a = Automaton([(k, t.encode()) for k, t in items], 4)
        halves = [Automaton([(k, t.encode()) for k, t in items[i::2]], 4) for i in (0, 1)]
        for _ in range(6):
            text = pick(rng.choice([0, 3, 30])) + "! " + pick(12).upper().replace("É", "é")
            want = brute_hits(text, items, 4)
            for automata in ([a], halves):
                got = judge(text.encode(), automata, 1)
                assert (got[0], got[1], sorted(set(got[2]))) == want


@pytest.mark.parametrize("block_words", [200_000, 8])
def test_decontaminate_frame(spark, block_words):
    """One automaton, and several one after the other."""
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (2, "rare phrase"), (3, None), (None, "x"), (4, " "), (5, "b c d rare"), (6, "phrase b c")], "item_id long, text string")
    rows = [(1, f"Before, {item.upper()}! after"), (2, "a rare-phrase b c d e f"), (3, None), (4, ""), (5, "one two three"), (6, item), (6, item)]
    df = docs_of(spark, rows, extra=True).withColumns({c: F.lit(c) for c in ("hit", "key", "spans", "items")})
    got = {r.doc_id: r.hit for r in decontaminate(df, items, block_words=block_words).select("row.doc_id", "hit").collect()}
    assert (got[1].n_hit, got[1].items, got[1].clean) == (11, ["1"], "Before, ! after")
    assert (got[2].n_hit, got[2].items, got[2].clean) == (4, ["2", "6"], "a  d e f") and got[3].n_words == got[5].n_hit == 0 and got[5].n_words == 3
    kept = remove_contamination(df, items, max_coverage=0.9, block_words=block_words)
    assert kept.columns == df.columns
    assert {r.doc_id: (r.text, r.hit) for r in kept.collect()} == {1: ("Before, ! after", "hit"), 2: ("a  d e f", "hit"), 3: (None, "hit"), 4: ("", "hit"), 5: ("one two three", "hit")}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(df, none).where("hit.n_hit > 0").count() == 0 and decontaminate(df.limit(0), items, block_words=block_words).count() == 0


# ---- language ID


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = docs.where(fold == 0).withColumn("r", language_id(docs, docs.where(fold != 0)))
    assert found.where("r.lang_pred = lang").count() >= 0.95 * found.count()


def longest_first(text, sample):
    n = at = 0
    while at < len(text):
        m = 1
        while at + m < len(text) and text[at : at + m + 1] in sample:
            m += 1
        n, at = n + 1, at + m
    return n


@pytest.mark.parametrize("dense", [1 << 24, 0])
def test_cross_parse_brute(monkeypatch, dense):
    """Whole texts of many segments: as many phrases as a plain greedy parse has, with dense tables and with edges."""
    from prosegauge.llm import language as L

    monkeypatch.setattr(L, "SEGMENT", 32)
    monkeypatch.setattr(L, "DENSE", dense)
    rng = random.Random(2)
    sample = {k: "".join(rng.choice(s) for _ in range(n)) for k, s, n in (("aa", "abc d", 600), ("bb", "bcde ", 600), ("ones", "a", 70))}
    sample = {k: " ".join(v.split()) for k, v in sample.items()}
    fold, classes = L._fold(sample)
    langs = sorted(sample)
    tables = L.tables_of([L._classes(sample[k], fold) for k in langs], classes)
    assert all((t.dense is not None) == (dense > 0) for t in tables)
    p = L.Parser(langs, tables, [1.0] * 3, fold)
    texts = [" ".join("".join(rng.choice("abcdez ") for _ in range(rng.randint(1, 500))).split()) for _ in range(40)]
    # the parse of a text of one letter never falls in step with one that starts elsewhere
    texts += ["a" * 1000, "a" * 31, "a" * 33, sample["aa"], sample["bb"] + sample["aa"], "zz" * 300]
    h, sizes = entropies(texts, p)
    for t, row, n in zip(texts, h, sizes, strict=True):
        assert n == len(t) and [round(x * max(n, 1)) for x in row] == [longest_first(t, sample[k]) for k in langs]
    assert decide([None, "", " 12 ?"], p)[2][0] == UND


def test_prediction_brute(spark):
    """The operator's language is the one of the fewest normalised phrases by the plain definition, for texts in several scripts."""
    import math
    import unicodedata

    own = {
        "zh": "今天早上城市的居民在公园里看到了一件奇怪的事情很多人停下来拍照有人说他们从来没有见过这样的景象",
        "el": "χθες το πρωί οι κάτοικοι της πόλης είδαν κάτι παράξενο στο πάρκο και πολλοί από αυτούς σταμάτησαν",
        "en": "yesterday morning the people of the town saw something strange in the park and many of them stopped",
        "fr": "hier matin les habitants de la ville ont vu quelque chose d étrange dans le parc et beaucoup d entre eux",
    }
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(own.items())], "doc_id long, text string, lang string")
    texts = ["很多人在城市的公园里", "the town and the park", unicodedata.normalize("NFD", "étrange ville et étrange chose"), "στο πάρκο της πόλης", "les people de town", "ж"]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", language_id(df, df).alias("r")).collect()
    plain = lambda t: " ".join("".join(c.lower() if c.isalpha() else " " for c in unicodedata.normalize("NFC", t)).split())
    for r in got:
        t = plain(texts[r.doc_id])
        cost = {k: longest_first(t, plain(v)) * math.log2(len(plain(v)) + 1) / len(t) for k, v in own.items()}
        assert r.r.lang_pred == min(sorted(cost), key=cost.get) and abs(r.r.entropy - min(cost.values())) < 1e-9


def test_wide_alphabets_stay_small():
    """40,000 Chinese characters beside another language: edges, not a table of all states by all letters."""
    from prosegauge.llm import language as L

    rng = random.Random(3)
    sample = {"zh": "".join(chr(0x4E00 + min(int(rng.expovariate(1 / 300)), 5000)) for _ in range(40_000)), "en": "".join(rng.choice("etaoin shrdlu") for _ in range(40_000))}
    fold, classes = L._fold(sample)
    tables = L.tables_of([L._classes(sample[k], fold) for k in sorted(sample)], classes)
    assert sum(x.nbytes for t in tables for x in (t.own, t.keys, t.to)) < 8 << 20 and all(t.dense is None for t in tables)
    h, _ = entropies([sample["zh"][:500], sample["en"][-500:]], L.Parser(["en", "zh"], tables, [15.0, 15.0], fold))
    assert h[0].argmin() == 1 and h[1].argmin() == 0


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "hello there friend", "en"), (2, None, "de"), (3, "", None), (4, "123 !!", "en"), (5, "guten tag freund " * 20_000, "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.r for r in df.select("doc_id", language_id(df, df).alias("r")).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["en", UND, UND, UND, "de"] and got[2].score == 0
    assert df.limit(0).select(language_id(df, df.limit(0)).alias("r")).count() == 0
    assert df.select(language_id(df, df.limit(0)).alias("r")).where("r.lang_pred <> 'und'").count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
