"""Language-model and context features of whole documents in Arrow batches: nothing that has a row a token or a sentence is shuffled or written.

A document's sentences are made where it is read, and stay together, in order, until they are added up. What has to cross the network are word counts, and of each document the words that are rare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as L


class WordModel:
    """Counts and ranks of the frequent words of each half, and what holds for a whole half. Keys are the fold that is scored."""

    def __init__(self, words: dict[int, tuple[list[str], np.ndarray, np.ndarray]], half: dict[int, tuple[float, float, float, float]]):
        self.words = {k: (pa.array(w, pa.string()), np.append(c, 0), np.append(r, 0)) for k, (w, c, r) in words.items()}
        total, v, most, entropy = (np.array([half.get(k, (0, 0, 0, 0.0))[i] for k in (0, 1)], np.float64) for i in range(4))
        self.size, self.most, self.entropy, self.unknown = total + v + 1, most, entropy, (v + 1).astype(np.int64)

    def looked_up(self, words: pa.Array, fold: np.ndarray, doc: np.ndarray, rare: dict[tuple[int, str], tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ranks) of words; ``rare`` has those of (document, word) that are not among the frequent ones."""
        c, r = np.zeros(len(words), np.int64), self.unknown[fold]
        for k in (0, 1):
            at = np.flatnonzero(fold == k)
            if not len(at):
                continue
            own = words.take(pa.array(at))
            where = np.full(len(at), -1)
            if k in self.words:
                known, counts, ranks = self.words[k]
                where = pc.fill_null(pc.index_in(own, value_set=known), -1).to_numpy(zero_copy_only=False)
                c[at], r[at] = counts[where], np.where(where < 0, r[at], ranks[where])
            for i in np.flatnonzero(where < 0) if rare else ():
                found = rare.get((int(doc[at[i]]), own[int(i)].as_py()))
                if found:
                    c[at[i]], r[at[i]] = found
        return c, r


def _spread(x: np.ndarray, seg: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation by segment; 0 for an empty one."""
    k = np.maximum(n, 1)
    m = np.bincount(seg, x, len(n)) / k
    return m, np.sqrt(np.bincount(seg, (x - m[seg]) ** 2, len(n)) / k)


def _at(ordered: np.ndarray, start: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """The percentile of each (sorted, not empty) segment, interpolated."""
    place = (n - 1) * q
    low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
    x = ordered[start + low]
    return x + (ordered[start + high] - x) * (place - low)


def measured(c: np.ndarray, r: np.ndarray, seg: np.ndarray, n: np.ndarray, fold: np.ndarray, model: WordModel) -> np.ndarray:
    """The 32 ``lm_`` values (rows) of each segment (columns) of tokens in the order of segments; zeros for an empty one."""
    out = np.zeros((32, len(n)))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    size = model.size[fold]
    lp, top, e = np.log((c + 1) / size[seg]), np.log((model.most[fold] + 1) / size), model.entropy[fold]
    p, lr = np.exp(lp), np.log(r.astype(np.float64))
    share = lambda x: np.bincount(seg, x, len(n)) / np.maximum(n, 1)
    m, sd = _spread(lp, seg, n)
    mp, sp = _spread(p, seg, n)
    mr, sr = _spread(lr, seg, n)
    ends = np.cumsum(n)
    start = (ends - n)[some]
    # the rarer, the higher its rank: one order serves both
    order = np.lexsort((c, seg))
    ordered, k = lp[order], n[some]
    ranks = lr[order]
    q = lambda x: _at(ordered, start, k, x)
    low = ordered[start]
    ppl = np.minimum(-m[some], 20.0)
    rows = [
        k, m[some], q(0.5), sd[some], low, ordered[start + k - 1], q(0.1), q(0.9), q(0.75) - q(0.25), ppl, np.exp(ppl), mp[some], sp[some], sp[some] ** 2, e[some], np.zeros(len(some)), e[some], e[some], mr[some], _at(ranks, start, k, 0.5), sr[some],
        *(share(x)[some] for x in (r == 1, r <= 10, r <= 100, r > 1000, p > 0.5, p > 0.9, p < 0.05, p < 0.01)), top[some] - m[some], top[some] - low, np.where(e[some] > 1e-6, -m[some] / np.where(e[some] > 1e-6, e[some], 1.0), 0.0),
    ]
    out[:, some] = rows
    return out


def cosines(known: np.ndarray, seg: np.ndarray, n: np.ndarray, doc: np.ndarray, docs: int, sents: np.ndarray) -> np.ndarray:
    """Each segment's function-word profile (``known``: numbers of words, -1 for others) against the mean of its document's ``sents`` profiles."""
    k = len(L.FUNCTION_WORDS)
    here = known >= 0
    keys, times = np.unique(seg[here] * k + known[here], return_counts=True)
    s, w = keys // k, keys % k
    f = times / n[s]
    both, place = np.unique(doc[s] * k + w, return_inverse=True)
    d = np.bincount(place, f, len(both)) / sents[both // k]
    nd = np.sqrt(np.bincount(both // k, d * d, docs))
    dot, nf = np.bincount(s, f * d[place], len(n)), np.sqrt(np.bincount(s, f * f, len(n)))
    size = nf * nd[doc]
    return np.where((nf < 1e-12) | (nd[doc] < 1e-12), 0.0, dot / np.where(size > 0, size, 1.0))


def features_column(sent, names: list[str], words: Column, gaps: Column, fold: Column, rare: Column) -> Column:
    """A struct of each document: ``whole``, its ``lm_`` columns, and ``pieces``, of each of its pieces sent_id and para_id, its ``lm_`` columns and ``fw_cosine``.
    ``words``: of each piece, null where it is empty; ``gaps``: paragraph breaks in each piece; ``rare``: (w, c, r) of words that the model (a broadcast) does not hold."""
    kind = ", ".join(f"{c}: double" for c in names)

    @F.arrow_udf(f"struct<whole: struct<{kind}>, pieces: array<struct<sent_id: bigint, para_id: bigint, {kind}, fw_cosine: double>>>")
    def of(words: pa.Array, gaps: pa.Array, fold: pa.Array, rare: pa.Array) -> pa.Array:
        model: WordModel = sent.value
        docs = len(words)
        per = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, first = np.repeat(np.arange(docs), per), np.cumsum(per) - per
        lists = words.flatten()
        full = lists.is_valid().to_numpy(zero_copy_only=False)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, fold = lists.flatten(), fold.to_numpy(zero_copy_only=False).astype(np.int64)
        seg = np.repeat(np.arange(len(n)), n)
        seldom = {(i, x["w"]): (x["c"], x["r"]) for i, row in enumerate(rare) if row.is_valid for x in row.as_py()}
        c, r = model.looked_up(flat, fold[doc[seg]], doc[seg], seldom)
        lm = measured(c, r, seg, n, fold[doc], model)
        whole = measured(c, r, doc[seg], np.bincount(doc, n, docs).astype(np.int64), fold, model)
        bare = n == 0
        lm[1:, bare] = whole[1:, doc[bare]]
        # numbers within the document: of full pieces, and of the stretches of them between paragraph breaks
        within = lambda x: np.cumsum(x) - (np.append(0, np.cumsum(x))[first])[doc]
        sent_id = within(full) - 1
        g = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        para = within(g) - g
        at = np.flatnonzero(full)
        fresh = np.zeros(len(n), np.int64)
        fresh[at] = np.append(True, (doc[at][1:] != doc[at][:-1]) | (para[at][1:] != para[at][:-1]))[: len(at)]
        para_id = within(fresh) - 1
        function = pc.fill_null(pc.index_in(flat, value_set=pa.array(L.FUNCTION_WORDS)), -1).to_numpy(zero_copy_only=False)
        cosine = cosines(function, seg, n, doc, docs, np.bincount(doc, full, docs))
        pieces = pa.StructArray.from_arrays([pa.array(sent_id, pa.int64()), pa.array(para_id, pa.int64()), *map(pa.array, lm), pa.array(cosine)], ["sent_id", "para_id", *names, "fw_cosine"])
        ends = pa.array(np.append(0, np.cumsum(per)).astype(np.int32))
        return pa.StructArray.from_arrays([pa.StructArray.from_arrays(list(map(pa.array, whole)), names), pa.ListArray.from_arrays(ends, pieces)], ["whole", "pieces"])

    return of(words, gaps, fold, rare)


def by_documents(df: DataFrame, made: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``made`` of the rows of whole documents, some documents at a time. Rows (doc_id, sent_id, ...) of a document have to follow each other in order, as the table of sentences has them; where they do not, this fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out(tables):
            done = made(pa.Table.from_batches(tables).to_pandas())
            yield from pa.Table.from_pandas(done, preserve_index=False).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            n, d = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("sent_id", "doc_id"))
            before = np.append(-1 if last is None else last[0], n[:-1])
            same = np.append(last is not None and (d[0] == last[1]), d[1:] == d[:-1])
            if not np.all((n == 0) | (same & (n == before + 1))):
                raise ValueError("the sentences of a document have to follow each other in order")
            last = n[-1], d[-1]
            starts = np.flatnonzero(n == 0)
            if len(starts) and (held or starts[-1]):
                held.append(b.slice(0, starts[-1]))
                yield from out(held)
                held = []
                b = b.slice(starts[-1])
            held.append(b)
        if held:
            yield from out(held)

    return df.mapInArrow(run, schema)


class Runs:
    """Sums over the runs of rows that make a document (or a paragraph)."""

    def __init__(self, begins: np.ndarray):
        self.of = np.cumsum(begins) - 1
        self.start = np.flatnonzero(begins)
        self.n = np.diff(np.append(self.start, len(begins)))

    def spread(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _spread(x, self.of, self.n)

    def ordered(self, x: np.ndarray) -> np.ndarray:
        return x[np.lexsort((x, self.of))]

    def at(self, ordered: np.ndarray, q: float) -> np.ndarray:
        return _at(ordered, self.start, self.n, q)


def in_context(rows: pd.DataFrame, tracked: dict[str, str], style: list[str], size: int) -> dict[str, np.ndarray]:
    """The ``ctx_`` columns of whole documents, and for each row its document's means (``m_``) and scales (``s_``) of style and its number of sentences (``doc_n``)."""
    begins = rows["sent_id"].to_numpy() == 0
    doc = Runs(begins)
    para = rows["para_id"].to_numpy()
    opens = begins | np.append(True, para[1:] != para[:-1])
    x = {c: rows[c].to_numpy(np.float64) if c in rows else np.zeros(len(rows)) for c in {*tracked.values(), *style}}
    spread = {c: doc.spread(v) for c, v in x.items()}
    out, n = {}, doc.n[doc.of]
    before, after = ~begins, ~np.append(begins[1:], True)
    out["ctx_rel_position"] = rows["sent_id"].to_numpy() / np.maximum(n - 1, 1)
    out["ctx_doc_log_n_sentences"] = np.log1p(n)
    out["ctx_is_paragraph_first"] = opens.astype(np.float64)
    out["ctx_is_paragraph_last"] = np.append(opens[1:], True).astype(np.float64)
    for k, c in tracked.items():
        m, sd = (v[doc.of] for v in spread[c])
        flat = sd < 1e-9
        out[f"ctx_z_{k}"] = np.where(flat, 0.0, np.clip((x[c] - m) / np.where(flat, 1.0, sd), -6.0, 6.0))
    prev = lambda v: np.where(before, np.append(v[:1], v[:-1]), v)
    nxt = lambda v: np.where(after, np.append(v[1:], v[-1:]), v)
    length, lp = x["sty_n_words"], x["lm_mean_logprob"]
    out["ctx_abs_len_diff_prev"], out["ctx_abs_len_diff_next"] = np.abs(length - prev(length)), np.abs(length - nxt(length))
    out["ctx_rel_len_diff_prev"] = out["ctx_abs_len_diff_prev"] / np.maximum(prev(length), 1.0)
    out["ctx_logprob_diff_prev"], out["ctx_logprob_diff_next"] = lp - prev(lp), lp - nxt(lp)
    scale = {c: np.maximum(np.maximum(spread[c][1], np.abs(spread[c][0]) * 0.1), 1e-6)[doc.of] for c in style}
    distance = lambda other: sum(np.abs(x[c] - other(c)) / scale[c] for c in style) / size
    # a neighbour that is not there is the sentence itself: no distance
    to_prev, to_next = distance(lambda c: prev(x[c])), distance(lambda c: nxt(x[c]))
    zero = np.zeros(len(rows))
    out |= {"ctx_pos_js_to_doc": zero, "ctx_pos_cosine_to_doc": zero, "ctx_funcword_cosine_to_doc": rows["fw_cosine"].to_numpy(np.float64), "ctx_pos_js_to_prev": zero, "ctx_pos_js_to_paragraph": zero}
    out |= {"ctx_style_distance_to_doc": distance(lambda c: spread[c][0][doc.of]), "ctx_style_distance_to_prev": to_prev, "ctx_max_neighbour_style_distance": np.maximum(to_prev, to_next)}
    return out | {f"m_{c}": spread[c][0][doc.of] for c in style} | {f"s_{c}": scale[c] for c in style} | {"doc_n": n}


def summed_up(rows: pd.DataFrame, full: list[str], two: list[str]) -> dict[str, np.ndarray]:
    """Means and deviations of all columns by document, and minimum, maximum and quartiles of ``full``; a column that is not there is zero."""
    doc = Runs(rows["sent_id"].to_numpy() == 0)
    out = {"doc_id": rows["doc_id"].to_numpy()[doc.start]}
    zero = np.zeros(len(doc.n))
    x = {c: rows[c].to_numpy(np.float64) for c in [*full, *two] if c in rows}
    for c in [*full, *two]:
        out[f"agg_mean_{c}"], out[f"agg_std_{c}"] = doc.spread(x[c]) if c in x else (zero, zero)
    for c in full:
        ordered = doc.ordered(x[c]) if c in x else None
        for k, q in (("min", 0.0), ("max", 1.0), ("p25", 0.25), ("p75", 0.75)):
            out[f"agg_{k}_{c}"] = zero if ordered is None else doc.at(ordered, q)
    return out
