"""Language-model scoring: a gated recurrent network with a class-factored softmax.

Words are counted over the whole corpus by Spark.  The most frequent ones form the *head*: each has
an embedding and its own place in a class of similar frequency.  All other words, seen or not, fall
into *tail* classes by their last two bytes; inside a tail class a word's probability comes from the
corpus counts.  The network predicts the class from its state, then the word inside its class, so a
token costs one softmax over classes and one over the words of a single class.

A *token* is a lower-cased word, or the end that closes each document.  Words travel as 64-bit codes.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_text, bounded_rows, discard, kept
from tidemark.llm.suffixes import Chunk, chunks

#: Code of the end of a document; no word has it.
END = np.uint64(0)
#: Words in a head class.
CLASS_WORDS = 32
_NULL_ID = np.iinfo(np.int64).min


@dataclass
class Vocabulary:
    """Counts of the frequent words, the head among them, and the tail classes.

    ``codes`` is sorted; ``slot`` is a word's place in the head, or -1.  ``tail_of`` gives the tail
    class of an ending and ``tail_log`` log10(N + V + 1) of its tokens N and distinct words V.
    """

    codes: np.ndarray
    counts: np.ndarray
    slot: np.ndarray
    tokens: int
    distinct: int
    tail_of: np.ndarray
    tail_log: np.ndarray
    head_counts: np.ndarray
    tail_counts: np.ndarray
    _starts: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_starts": None}

    @property
    def head(self) -> int:
        return len(self.head_counts)

    @property
    def end(self) -> int:
        """Input and target number of the end token."""
        return int(self.slot[np.searchsorted(self.codes, END)])

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code, or -1: a table of leading bits, then a few comparisons."""
        bits = np.uint64(64 - max(1, len(self.codes).bit_length()))
        if self._starts is None:
            self._starts = np.searchsorted(self.codes >> bits, np.arange((1 << int(64 - bits)) + 1, dtype=np.uint64))
        lead = codes >> bits
        at, stop = self._starts[lead], self._starts[lead + np.uint64(1)]
        out = np.full(len(codes), -1, np.int64)
        left = np.flatnonzero(at < stop)
        while len(left):
            hit = self.codes[at[left]] == codes[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Dictionary index (or -1) and input number of each word: its head slot, or head + tail class."""
        at = self.find(c.codes)
        slot = np.where(at >= 0, self.slot[at], -1)
        return at, np.where(slot >= 0, slot, self.head + self.tail_of[c.endings])


def _lowered(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, ``row`` (0), and the text as bytes: what ``chunks`` takes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0) if row is None else row).cast("long").alias("row"), binary_text().alias("text"))


def _lower_chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Chunk]:
    lowered = (pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.as_py().lower() for t in b.column(2)], pa.binary())], names=["doc_id", "row", "text"]) for b in batches)
    return chunks(lowered, words)


def count_words(docs: DataFrame, chunk_words: int = 1_000_000) -> DataFrame:
    """``(code, ending, n)`` for every distinct token of ``docs(doc_id, text)``: counts over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _lower_chunks(batches, chunk_words):
            order = np.argsort(c.codes)
            run = c.codes[order]
            new = np.flatnonzero(np.diff(run, prepend=END))
            codes, n = np.append(run[new], END), np.append(np.diff(new, append=len(run)), len(c.ids))
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(np.append(c.endings[order[new]], 0).astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "ending", "n"])

    counted = _lowered(docs).mapInArrow(count, "code long, ending int, n long")
    return kept(counted.groupBy("code").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")), "word-counts")


def fit_vocabulary(counts: DataFrame, *, entries: int = 1 << 19, head: int = 2048, tail_classes: int = 64) -> Vocabulary:
    """Vocabulary of ``counts``: at most ``entries`` words are collected, the most frequent ones."""
    band = F.floor(F.log2("n") * 16)
    bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).orderBy(F.desc("band")).collect()
    least, room = None, entries
    for r in bands:
        if (room := room - r["v"]) < 0:
            break
        least = r["band"]
    none = counts.limit(0) if least is None else counts.where(band >= int(least))
    found = none.where("code <> 0").toArrow()
    codes, n, endings = (found[k].to_numpy() for k in ("code", "n", "ending"))
    codes = codes.view(np.uint64)
    ends = counts.where("code = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    codes, n, endings = np.append(codes, END), np.append(n, ends).astype(np.int64), np.append(endings, 0)
    order = np.argsort(codes)
    codes, n, endings = codes[order], n[order], endings[order]
    top = np.lexsort((codes, -n))
    top = np.append(top[top > 0][: head - 1], 0)  # the end is always in the head
    top = top[np.lexsort((codes[top], -n[top]))]
    slot = np.full(len(codes), -1, np.int32)
    slot[top] = np.arange(len(top))
    size, words = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        size[r["ending"]], words[r["ending"]] = r["n"], r["v"]
    np.subtract.at(size, endings[top], n[top])
    np.subtract.at(words, endings[top], (n[top] > 0).astype(np.int64))
    own = np.lexsort((np.arange(1 << 16), -size))[: tail_classes - 1]
    own = own[size[own] > 0]
    tail_of = np.full(1 << 16, len(own), np.int32)
    tail_of[own] = np.arange(len(own))
    tail_n, tail_v = (np.bincount(tail_of, x, len(own) + 1) for x in (size, words))
    return Vocabulary(codes, n, slot, sum(r["n"] for r in bands), sum(r["v"] for r in bands), tail_of, np.log10(tail_n + tail_v + 1), n[top], tail_n)


#: Tokens whose class probabilities are in memory at once.
_BLOCK = 2048
#: Logits within this bound need no shift before their exponentials are taken.
_SAFE = 60.0


def _softmax(h: np.ndarray, place: np.ndarray, w: np.ndarray, bias: np.ndarray, weigh: np.ndarray, safe: bool, back: bool) -> tuple:
    """Log probability of each row's place under ``softmax(h w.T + bias)``; ``weigh`` is exp(bias), at most 1.

    With ``back``, also the gradient of the losses by ``h``, and the share of all places in those by
    ``w`` and ``bias``: the rows' own places are left for the caller to subtract.
    """
    q = h @ w.T
    if not safe:
        q -= (q + bias).max(axis=1, keepdims=True)
    own = q.reshape(-1).take(np.arange(0, q.size, q.shape[1]) + place)
    np.exp(q, out=q)
    total = q @ weigh
    logs = own + bias.take(place) - np.log(total)
    if not back:
        return logs, None, None, None
    share = 1 / total
    dh = q @ (w * weigh[:, None])
    dh *= share[:, None]
    dh -= w.take(place, axis=0)
    return logs, dh, q.T @ (h * share[:, None]) * weigh[:, None], share @ q * weigh


@dataclass
class _Run:
    """States of a window, step after step, and what the backward pass needs."""

    before: np.ndarray
    a: np.ndarray
    zr: np.ndarray
    m: np.ndarray
    h: np.ndarray


def _logistic(a: np.ndarray) -> None:
    """``1 / (1 + exp(a))`` in place; an infinite exponential gives 0, as it should."""
    np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)


@np.errstate(over="ignore")
def _forward(recurrence: tuple[np.ndarray, np.ndarray], x: np.ndarray, fresh: np.ndarray, bounds: list[int], state: np.ndarray, back: bool = True) -> _Run:
    """The recurrence over the steps between ``bounds``; ``fresh`` marks tokens before which the state is zero.

    Without ``back`` all but the states are those of one step, in memory that every step uses again.
    """
    table, u = recurrence
    keep, n = ~fresh, u.shape[2]
    room = len(x) if back else max(np.diff(bounds), default=0)
    run = _Run(*(np.empty(s, table.dtype) for s in ((room, n), (3, room, n), (2, room, n), (room, n), (len(x), n))))
    restarts = np.add.reduceat(fresh, bounds[:-1], dtype=np.int64).tolist() if len(x) else []
    for i, j, some in zip(bounds, bounds[1:], restarts, strict=False):
        at = slice(i, j) if back else slice(j - i)
        before, a, zr, m, h, g = run.before[at], run.a[:, at], run.zr[:, at], run.m[at], run.h[i:j], table.take(x[i:j], axis=1)
        before[...] = state[: j - i]
        if some:
            before *= keep[i:j, None]
        np.matmul(before, u, out=a)
        np.add(g[:2], a[:2], out=zr)
        _logistic(zr)
        np.multiply(zr[1], a[2], out=m)
        m += g[2]
        _logistic(m)
        m *= 2
        m -= 1
        np.subtract(before, m, out=h)
        h *= zr[0]
        h += m
        state = h
    return run


@dataclass
class GatedLM:
    """Weights of the network over a vocabulary.

    ``E`` embeddings of inputs, ``W`` embedding to gates, ``U`` state to gates, ``b`` gate biases,
    ``C``, ``c`` state to classes, ``O``, ``o`` state to the words of the head.  The gates are
    update, reset and candidate.
    """

    vocabulary: Vocabulary
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, v: Vocabulary, hidden: int, embedding: int, seed: int = 1) -> GatedLM:
        """Random recurrent weights; output biases are the log counts of the whole corpus."""
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        classes = -(-v.head // CLASS_WORDS)
        padded = np.zeros(classes * CLASS_WORDS)
        padded[: v.head] = v.head_counts
        mass = np.append(padded.reshape(classes, CLASS_WORDS).sum(axis=1), v.tail_counts) + 1
        o = np.where(np.arange(len(padded)) < v.head, np.log(padded + 0.5), -30)
        inputs = v.head + len(v.tail_log)
        return cls(v, {
            "E": rng.normal(0, 0.3, (inputs, embedding)).astype(np.float32), "W": draw(embedding, 3 * hidden), "U": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "C": draw(hidden, len(mass)) * np.float32(0.1), "c": np.log(mass / mass.sum()).astype(np.float32),
            "O": draw(hidden, classes * CLASS_WORDS).T.reshape(classes, CLASS_WORDS, hidden) * np.float32(0.1), "o": o.reshape(classes, CLASS_WORDS).astype(np.float32),
        })

    def class_of(self, y: np.ndarray) -> np.ndarray:
        head = self.vocabulary.head
        return np.where(y < head, y // CLASS_WORDS, len(self.weights["o"]) + y - head)

    def recurrence(self) -> tuple[np.ndarray, np.ndarray]:
        """Gates of every input, (3, inputs, units), and state to gates, (3, units, units).

        As ``_logistic`` takes them: negative, the candidate twice over, for ``tanh(x)`` is ``2 / (1 + exp(-2 x)) - 1``.
        """
        w, n = self.weights, len(self.weights["U"])
        sign = np.array([-1, -1, -2], w["U"].dtype)[:, None, None]
        split = lambda a: a.reshape(-1, 3, n).transpose(1, 0, 2)
        return np.matmul(w["E"], split(w["W"]) * sign) + split(w["b"]) * sign, np.ascontiguousarray(split(w["U"]) * sign)

    def outputs(self, h: np.ndarray, y: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray | None, dict]:
        """Natural log probability of each target's class and, in the head, of its place in the class.

        With ``back``, also the gradients of the sum of the losses.  Tokens are taken in order of their
        targets, so the classes and the words of a class lie side by side.
        """
        w, head = self.weights, self.vocabulary.head
        order = np.argsort(y.astype(np.uint16) if len(w["E"]) <= 1 << 16 else y, kind="stable")
        hs, ys = h.take(order, axis=0), y.take(order)
        k = self.class_of(ys)
        out, dh = np.empty(len(y)), np.empty_like(hs) if back else None
        safe = bool(np.abs(w["C"]).sum(axis=0).max(initial=0) < _SAFE and np.abs(w["O"]).sum(axis=2).max(initial=0) < _SAFE)
        c, o = w["c"] - w["c"].max(), w["o"] - w["o"].max(axis=1, keepdims=True)
        c_weigh, o_weigh, to_class = np.exp(c), np.exp(o), np.ascontiguousarray(w["C"].T)
        gC, gc, gO, go = (np.zeros_like(w[name]) for name in "CcOo") if back else [None] * 4
        for i in range(0, len(ys), _BLOCK):
            at = slice(i, i + _BLOCK)
            out[at], d, gw, gb = _softmax(hs[at], k[at], to_class, c, c_weigh, safe, back)
            if back:
                dh[at] = d
                gC += gw.T
                gc += gb
        edges = np.searchsorted(k, np.arange(len(o) + 1))
        inside, sizes = slice(0, edges[-1]), np.diff(edges)
        spans = [(j, slice(edges[j], edges[j + 1])) for j in np.flatnonzero(sizes).tolist()]
        q = np.empty((edges[-1], CLASS_WORDS), hs.dtype)
        for j, at in spans:
            np.matmul(hs[at], w["O"][j].T, out=q[at])
        if not safe:
            q -= (q + np.repeat(o, sizes, axis=0)).max(axis=1, keepdims=True)
        own = q.reshape(-1).take(np.arange(0, q.size, CLASS_WORDS) + ys[inside] % CLASS_WORDS)
        np.exp(q, out=q)
        q *= np.repeat(o_weigh, sizes, axis=0)
        total = q @ np.ones(CLASS_WORDS, q.dtype)
        out[inside] += own + o.reshape(-1).take(ys[inside]) - np.log(total)
        if back:
            q *= (1 / total)[:, None]
            for j, at in spans:
                dh[at] += q[at] @ w["O"][j]
                gO[j], go[j] = q[at].T @ hs[at], q[at].sum(axis=0)
            dh[inside] -= w["O"].reshape(-1, hs.shape[1]).take(ys[inside], axis=0)
        logs = np.empty_like(out)
        logs[order] = out
        if not back:
            return logs, None, {}
        first = np.flatnonzero(np.diff(ys, prepend=-1))
        own, n = ys[first], np.diff(first, append=len(ys))
        sums = np.add.reduceat(hs, first, axis=0)
        k = self.class_of(own)
        of_class = np.flatnonzero(np.diff(k, prepend=-1))
        gC.T[k[of_class]] -= np.add.reduceat(sums, of_class, axis=0)
        gc[k[of_class]] -= np.add.reduceat(n, of_class)
        inside = own < head
        gO.reshape(-1, gO.shape[2])[own[inside]] -= sums[inside]
        go.reshape(-1)[own[inside]] -= n[inside]
        unsorted = np.empty_like(dh)
        unsorted[order] = dh
        return logs, unsorted, {"C": gC, "c": gc, "O": gO, "o": go}

    def score(self, c: Chunk, **options) -> dict[str, np.ndarray]:
        """Per document of the chunk: tokens, known tokens, base and model log10 probability; the rest.

        The rest are words outside the dictionary; their counts add ``log10(count + 1)`` to both
        probabilities.
        """
        found = self.count(c)
        return found | {"model": found["tail"] + self.run(found["n_tokens"], found["number"], **options)}

    def count(self, c: Chunk) -> dict[str, np.ndarray]:
        """What ``score`` takes from counts, and for ``run`` the number of every token, ends included."""
        v = self.vocabulary
        at, number = v.encode(c)
        sizes = np.diff(c.first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        seen = at >= 0
        count_log = np.where(seen, np.log10(v.counts[at] + 1.0), 0.0)
        tail = number >= v.head
        tail_log = np.where(tail, count_log - v.tail_log[np.maximum(number - v.head, 0)], 0.0)
        n = len(sizes)
        ends = v.counts[np.searchsorted(v.codes, END)]
        per_doc = lambda x: np.bincount(doc, x, n)
        rest = np.flatnonzero(~seen)
        return {
            "n_tokens": sizes + 1,
            "known": per_doc(seen).astype(np.int64) + int(ends > 0),
            "base": per_doc(count_log) + np.log10(ends + 1.0) - (sizes + 1) * np.log10(v.tokens + v.distinct + 1.0),
            "tail": per_doc(tail_log), "number": np.insert(number.astype(_number_type(self)), c.first[1:], v.end),
            "rest_doc": doc[rest], "rest_code": c.codes[rest],
        }

    def run(self, sizes: np.ndarray, number: np.ndarray, lanes: int = 512, window: int = 32) -> np.ndarray:
        """Log10 probability of the documents' classes and head words, given how many tokens each has and their numbers.

        Documents run side by side in lanes, one after another in each; the state is carried from
        window to window, so every token is scored given its whole document so far.  A window has
        ``window`` steps of all lanes, or more steps of fewer.
        """
        plan, starts = Lanes(sizes, lanes), np.cumsum(sizes) - sizes
        start = np.zeros(len(number), bool)
        start[starts] = True
        logs = np.empty(len(number))
        recurrence = self.recurrence()
        state = np.zeros((plan.lanes, len(self.weights["U"])), np.float32)
        done = np.cumsum(plan.active)
        t0 = 0
        while t0 < plan.steps:
            t1 = max(t0 + 1, int(np.searchsorted(done, done[t0] - plan.active[t0] + window * plan.lanes, side="right")))
            pos, bounds = plan.window(t0, t1)
            fresh = start[pos]
            x = np.where(fresh, self.vocabulary.end, number[pos - 1])
            h = _forward(recurrence, x, fresh, bounds, state, back=False).h
            state, t0 = h[bounds[-2] :], t1
            logs[pos] = self.outputs(h, number[pos].astype(np.int64))[0]
        return np.add.reduceat(logs, starts) / np.log(10) if len(sizes) else np.zeros(0)


def _sequences(first: np.ndarray, number: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (end first), targets (end last) and start marks of the documents, one after another."""
    sizes = np.diff(first)
    starts = first[:-1] + np.arange(len(sizes))
    y = np.insert(number, first[1:], end)
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[starts] = end
    mark = np.zeros(len(y), bool)
    mark[starts] = True
    return x, y, mark


class Lanes:
    """Documents dealt to lanes of about equal length, the longest lane first."""

    def __init__(self, sizes: np.ndarray, lanes: int) -> None:
        begin = np.cumsum(sizes) - sizes
        heap = [(0, k) for k in range(max(1, min(lanes, len(sizes))))]
        own: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-sizes, kind="stable").tolist():
            size, k = heapq.heappop(heap)
            own[k].append(d)
            heapq.heappush(heap, (size + int(sizes[d]), k))
        length = np.array([sizes[o].sum() for o in own])
        order = np.argsort(-length, kind="stable")
        self.lanes, self.steps = len(order), int(length.max(initial=0))
        self.active = np.searchsorted(-length[order], -np.arange(self.steps), side="left")
        self.begin = np.cumsum(length[order]) - length[order]
        runs = [np.arange(begin[d], begin[d] + sizes[d]) for k in order for d in own[k]]
        self.flat = np.concatenate(runs) if runs else np.empty(0, np.int64)

    def at(self, t: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token of each active lane at step ``t``, and the lanes in which a document starts."""
        pos = self.flat[self.begin[: self.active[t]] + t]
        return pos, np.flatnonzero(start[pos])

    def window(self, t0: int, t1: int) -> tuple[np.ndarray, list[int]]:
        """Tokens of the active lanes, step after step, and where the steps begin and end among them."""
        bounds = [0, *np.cumsum(self.active[t0:t1]).tolist()]
        return np.concatenate([self.flat[self.begin[: self.active[t]] + t] for t in range(t0, t1)]), bounds


def gradients(model: GatedLM, x: np.ndarray, y: np.ndarray, start: np.ndarray, plan: Lanes, state: np.ndarray, t0: int, t1: int) -> tuple[dict[str, np.ndarray], np.ndarray, int, float]:
    """Gradients of the sum of losses over steps ``t0`` to ``t1``, the state after them, tokens, and that sum.

    The state before the window is taken as given: backpropagation is truncated there.
    """
    w, n = model.weights, len(model.weights["U"])
    pos, bounds = plan.window(t0, t1)
    xs = x[pos]
    run = _forward(model.recurrence(), xs, start[pos], bounds, state)
    logs, dh_out, grads = model.outputs(run.h, y[pos], back=True)
    d_all = np.empty((len(pos), 4 * n), w["U"].dtype)  # candidate, update, reset, candidate by the state
    keep, back = ~start[pos], np.ascontiguousarray(w["U"].T)
    dh = np.zeros((0, n), w["U"].dtype)
    for i, j in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
        d, all_, m, z, r = dh_out[i:j], d_all[i:j], run.m[i:j], run.zr[0, i:j], run.zr[1, i:j]
        d[: len(dh)] += dh
        carried = d * z
        d -= carried
        dz = run.before[i:j] - m
        dz *= z
        np.multiply(dz, d, out=all_[:, n : 2 * n])
        dm = m * m
        np.subtract(1, dm, out=dm)
        dm *= d
        all_[:, :n] = dm
        dm *= r
        all_[:, 3 * n :] = dm
        dr = r - 1
        dr *= run.a[2, i:j]
        dr *= 0.5
        np.multiply(dr, dm, out=all_[:, 2 * n : 3 * n])
        dh = all_[:, n:] @ back
        dh += carried
        if not keep[i:j].all():
            dh *= keep[i:j, None]
    dgates = d_all[:, : 3 * n]
    in_order = np.concatenate([np.arange(n, 3 * n), np.arange(n)])  # update, reset, candidate
    order = np.argsort(xs.astype(np.uint16) if len(w["E"]) <= 1 << 16 else xs, kind="stable")
    own = xs[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    dx = dgates @ w["W"][:, np.argsort(in_order)].T
    grads |= {"U": run.before.T @ d_all[:, n:], "b": (np.ones(len(pos), d_all.dtype) @ dgates)[in_order], "W": (w["E"][xs].T @ dgates)[:, in_order], "E": np.zeros_like(w["E"])}
    grads["E"][own[first]] = np.add.reduceat(dx[order], first, axis=0)
    return grads, run.h[bounds[-2] :], len(pos), -float(logs.sum())


def train(model: GatedLM, texts: list[bytes], **options) -> GatedLM:
    """``train_sequences`` on whole texts."""
    c = Chunk(np.arange(len(texts), dtype=np.int64), np.zeros(len(texts), np.int64), texts)
    x, y, _ = _sequences(c.first, model.vocabulary.encode(c)[1], model.vocabulary.end)
    return train_sequences(model, x, y, np.diff(c.first) + 1, **options)


def train_sequences(model: GatedLM, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, *, passes: int, rate: float, lanes: int, window: int, least_steps: int = 100) -> GatedLM:
    """Truncated backpropagation over sequences of inputs and targets: gradients stop at windows, the state goes on.

    There are fewer than ``lanes`` lanes, but at least eight, where a pass would else take fewer than
    ``least_steps`` steps of the optimizer.
    """
    start = np.zeros(len(x), bool)
    start[np.cumsum(sizes) - sizes] = True
    w, plan = model.weights, Lanes(sizes, max(min(8, lanes), min(lanes, len(x) // (window * least_steps))))
    sizes = {k: a.size for k, a in w.items()}
    flat = np.concatenate([a.reshape(-1) for a in w.values()])
    cuts = np.cumsum([0, *sizes.values()])
    w |= {k: flat[i:j].reshape(w[k].shape) for k, i, j in zip(sizes, cuts, cuts[1:], strict=False)}
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    step, steps = 0, passes * -(-plan.steps // window)
    for _ in range(passes):
        state = np.zeros((plan.lanes, w["U"].shape[0]), flat.dtype)
        for t0 in range(0, plan.steps, window):
            grads, state, n, _ = gradients(model, x, y, start, plan, state, t0, min(t0 + window, plan.steps))
            g = np.concatenate([grads[k].reshape(-1) for k in sizes])
            step += 1
            now = rate * (1 - (step - 1) / steps) ** 0.5
            norm = np.sqrt(float(g @ g)) / n
            g *= np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / n)
            m1 *= np.float32(0.9)
            m1 += np.float32(0.1) * g
            g *= g
            m2 *= np.float32(0.99)
            g *= np.float32(0.01)
            m2 += g
            np.multiply(m2, np.float32(1 / (1 - 0.99**step)), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(m1, g, out=g)
            g *= np.float32(now / (1 - 0.9**step))
            flat -= g
    return model


def _pieces(shared: Broadcast, tokens: int, chunk_words: int):
    """Arrow function: texts as input numbers, cut into pieces of at most ``tokens`` targets, of even length.

    A piece holds its first input, then its targets, so the next one begins with its last target.
    ``nth`` tells apart rows of a chunk that have the same hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value.vocabulary
        for c in _lower_chunks(batches, chunk_words):
            x, y, _ = _sequences(c.first, v.encode(c)[1], v.end)
            size = np.diff(c.first) + 1
            parts = -(-size // tokens)
            doc = np.repeat(np.arange(len(size)), parts)
            no = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            stop = (np.cumsum(size) - size)[doc] + size[doc] * (no + 1) // parts[doc]
            flat = np.insert(x, stop, y[stop - 1]).astype(_number_type(shared.value))
            offsets = np.concatenate([[0], stop + np.arange(1, len(stop) + 1)]) * flat.itemsize
            again = np.arange(len(size)) - np.maximum.accumulate(np.where(np.diff(c.rows, prepend=~c.rows[:1]) != 0, np.arange(len(size)), 0))
            piece = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(c.rows[doc]), pa.array(again[doc]), pa.array(no), piece, pa.array(np.diff(stop, prepend=0))], names=["h", "nth", "no", "piece", "tokens"])

    return cut


def _deal(rounds: int, replicas: int) -> dict[str, Column]:
    """Round and replica of a piece, by two hashes: a quotient of one would be a double, which has lost its low bits."""
    dice = lambda k, n: F.pmod(F.xxhash64("h", "nth", "no", F.lit(k)), F.lit(n)).cast("int")
    return {"round": dice(1, rounds), "replica": dice(2, replicas)}


def _number_type(model: GatedLM) -> type:
    return np.uint16 if len(model.weights["E"]) <= 1 << 16 else np.uint32


def fit_lm(
    docs: DataFrame, counts: DataFrame, *, piece_words: int = 1024, replica_words: int = 1_000_000, fan_in: int = 16, rounds: int = 4,
    passes: int = 1, rate: float = 0.04, hidden: int = 24, embedding: int = 16, lanes: int = 512, window: int = 16, chunk_words: int = 1_000_000, **vocabulary,
) -> GatedLM:
    """Fit the model on every row of ``docs``: counts, biases and network.

    Each row trains once with its whole text, as numbers of two bytes a token.  Texts over
    ``piece_words`` tokens are trained in pieces; a piece starts from the word before it and the zero
    state.  The pieces are dealt to ``rounds`` rounds and as many replicas as ``replica_words`` asks
    for; in each round every replica trains from the shared weights on its part, and their weights,
    weighted by tokens, are averaged in a tree of Spark groups of ``fan_in``, so the driver meets a few
    sets of weights whatever the number of replicas.

    Null texts are empty ones, null doc_ids take part, repeated rows train as often as they occur.
    An empty table leaves the random weights with the biases of the counts.
    """
    model = GatedLM.start(fit_vocabulary(counts, **vocabulary), hidden, embedding)
    context = docs.sparkSession.sparkContext
    cut = _pieces(context.broadcast(model), piece_words, chunk_words)
    pieces = kept(_lowered(docs, F.xxhash64("doc_id", "text")).mapInArrow(cut, "h long, nth long, no long, piece binary, tokens long"), "lm-pieces")
    total = pieces.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    replicas = max(1, -(-total // (rounds * replica_words)))
    dealt = pieces.withColumns(_deal(rounds, replicas))
    for k in range(rounds):
        shared = context.broadcast(model)
        learn = _learner(shared, passes=passes, rate=rate / (1 + k), lanes=lanes, window=window)
        trained = kept(dealt.where(F.col("round") == k).groupBy("replica").applyInPandas(learn, "replica int, tokens long, weights binary"), "lm-weights")
        left = replicas
        while left > fan_in:
            left = -(-left // fan_in)
            trained = trained.groupBy(F.floor(F.col("replica") / fan_in).cast("int").alias("replica")).applyInPandas(_averaged, "replica int, tokens long, weights binary")
        found = bounded_rows(trained, fan_in, "the list of replicas")
        if not found:
            continue
        model.weights = _mean([(pickle.loads(r["weights"]), r["tokens"]) for r in sorted(found, key=lambda r: r["replica"])])
    discard(pieces)
    return model


def _mean(parts: list[tuple[dict[str, np.ndarray], int]]) -> dict[str, np.ndarray]:
    """Weights averaged by tokens."""
    total = sum(n for _, n in parts)
    return {k: sum(w[k] * np.float32(n / total) for w, n in parts) for k in parts[0][0]}


def _averaged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("replica")
    weights = _mean([(pickle.loads(w), int(n)) for w, n in zip(pdf["weights"], pdf["tokens"], strict=True)])
    return pd.DataFrame({"replica": [key[0]], "tokens": [pdf["tokens"].sum()], "weights": [pickle.dumps(weights, protocol=5)]})


def _learner(shared: Broadcast, **options) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Group function: the weights after training on a replica's part of the pieces."""

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "nth", "no"])
        model, sizes = GatedLM(shared.value.vocabulary, dict(shared.value.weights)), pdf["tokens"].to_numpy()
        flat = np.frombuffer(b"".join(pdf["piece"]), _number_type(model)).astype(np.int64)
        last = np.cumsum(sizes + 1) - 1
        own = train_sequences(model, np.delete(flat, last), np.delete(flat, last - sizes), sizes, **options)
        return pd.DataFrame({"replica": [key[0]], "tokens": [int(sizes.sum())], "weights": [pickle.dumps(own.weights, protocol=5)]})

    return learn


def _scorer(shared: Broadcast, chunk_words: int, run_words: int):
    """Arrow function: what the model and the dictionary say of each text, and its words outside the dictionary.

    Texts are parsed in chunks; the network runs over the numbers of many of them at once, so that
    few steps have long documents alone in their lanes.
    """

    def scored(found: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes, known, base, tail, number = (np.concatenate([s[k] for s in found]) for k in ("ids", "n_tokens", "known", "base", "tail", "number"))
        before = np.cumsum([0] + [len(s["ids"]) for s in found])
        doc, code = np.concatenate([s["rest_doc"] + n for s, n in zip(found, before, strict=False)]), np.concatenate([s["rest_code"] for s in found])
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(code, prepend=END) != 0))
        offsets = pa.array(np.searchsorted(doc[new], np.arange(len(ids) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(code[new].view(np.int64)), pa.array(np.diff(new, append=len(doc)).astype(np.int32)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == _NULL_ID), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(tail + shared.value.run(sizes, number)), *lists],
            names=["doc_id", "n_tokens", "known", "base", "model", "codes", "times"],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for c in _lower_chunks(batches, chunk_words):
            if found and size + c.words > run_words:
                yield scored(found)
                found, size = [], 0
            found.append(shared.value.count(c) | {"ids": c.ids})
            size += c.words
        if found:
            yield scored(found)

    return each


def score_documents(docs: DataFrame, model: GatedLM, counts: DataFrame, *, chunk_words: int = 1_000_000, run_words: int = 6_000_000) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Whole texts are scored, in log10.  ``base_score`` is the add-one unigram probability, ``score``
    the network's.  Words outside the broadcast dictionary are joined to ``counts`` by their code.

    Null and empty texts hold the end alone.  Repeated rows repeat; a null doc_id stays null.  An
    empty table gives an empty one; with nothing learned, every token has count 0.
    """
    each = _scorer(docs.sparkSession.sparkContext.broadcast(model), chunk_words, run_words)
    local = kept(_lowered(docs).mapInArrow(each, "doc_id long, n_tokens long, known long, base double, model double, codes array<long>, times array<int>").withColumn("uid", F.monotonically_increasing_id()), "lm-scores")
    rest = local.select("uid", F.explode(F.arrays_zip("codes", "times")).alias("w")).select("uid", F.col("w.codes").alias("code"), F.col("w.times").alias("times"))
    more = (
        rest.join(counts.select("code", "n"), "code")
        .groupBy("uid")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    )
    added = F.coalesce("more", F.lit(0.0))
    return local.drop("codes", "times").join(more, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(model.vocabulary.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + added).alias("base_score"), (F.col("model") + added).alias("score"),
    )
