"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_rows, kept

#: Characters read as Latin letters: Cyrillic and Greek look-alikes, digits and signs put for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝһʏѵгкмтвн", "aeopcyxijsdqwhyvrkmtbh", strict=True)) | dict(zip("αεοινκρτυχηωγ", "aeoivkptuxnwy", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}


SIGNS = {"!": "i", "$": "s"}
_BANG, _DOLLAR = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])"), re.compile(r"\$(?=[^\W\d_])")
_INSIDE, _OUTSIDE = str.maketrans(DIGITS), str.maketrans(dict.fromkeys(SIGNS, " "))


class _Fold(dict):
    """Code point to folded character: letters without accents; signs that may stand for one stay, all else is a space.  Filled as needed."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if 0xFF01 <= c <= 0xFF5E:  # full-width forms
            ch = chr(c - 0xFEE0).lower()
        base = unicodedata.normalize("NFD", ch)[0]
        ch = LOOKALIKES.get(ch, base if base.isascii() else ch)
        joined = c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF) or 0x300 <= c <= 0x36F
        self[c] = ch if ch.isalpha() or ch in DIGITS or ch in SIGNS else "" if joined else " "
        return self[c]


_FOLD = _Fold()


def _letters(word: str) -> list[str]:
    """The words in a run of letters, digits and signs: "!" counts between letters, "$" before one, digits and "@" beside letters."""
    runs = _DOLLAR.sub(SIGNS["$"], _BANG.sub(SIGNS["!"], word)).translate(_OUTSIDE).split()
    return [r.translate(_INSIDE) for r in runs if any(map(str.isalpha, r))]


def folded(text: str) -> str:
    """Lower case, accents off, look-alikes folded, words of letters set apart by single spaces, one at each end; numbers are no words."""
    words = text.lower().translate(_FOLD).split()
    return " " + " ".join(x for w in words for x in ((w,) if w.isalpha() else _letters(w))) + " "


@dataclass
class Lexicon:
    """Patterns with weights, exception phrases and the calibration of the score.

    A pattern starts at a word's start; one that ends with a space is a whole word, another a
    word's beginning.  At one start the longest pattern counts.  A hit inside an exception phrase
    does not count.
    """

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, ...] = (-3.0, 1.0, 1.0)
    _machine: object = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def _automaton(self):
        if self._machine is None:
            machine = ahocorasick.Automaton()
            for p, w in self.weights.items():
                machine.add_word(" " + p, (len(p) + 1, w, p))
            for p in self.exceptions:
                machine.add_word(phrase := folded(p), (len(phrase), None, p))
            machine.make_automaton()
            self._machine = machine
        return self._machine

    def found(self, line: str) -> dict[int, tuple[int, str]]:
        """Length and pattern of the hit that counts, by its start in the folded text."""
        best: dict[int, tuple[int, str]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w, p) in self._automaton().iter(line):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif n > best.get(start, (0, ""))[0]:
                best[start] = (n, p)
        if spared:
            spared.sort()
            starts = [a for a, _ in spared]
            reach = list(accumulate((b for _, b in spared), max))
            inside = lambda s, n: (k := bisect.bisect_right(starts, s)) > 0 and s + n - 1 <= reach[k - 1]
            best = {s: (n, p) for s, (n, p) in best.items() if not inside(s, n)}
        return best

    def hits(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, number of hits and of words; repeats of a pattern add less and less."""
        if not self.weights:
            return 0.0, 0, 0
        line = folded(text)
        best = self.found(line)
        times = Counter(p for _, p in best.values())
        return float(sum(self.weights[p] * (1 + math.log(c)) for p, c in times.items())), len(best), line.count(" ") - 1

    def features(self, text: str) -> list[float]:
        """1, log of the weight per 100 words, log of the weight."""
        total, _, words = self.hits(text)
        total = max(0.0, total)
        return [1.0, float(np.log1p(100 * total / max(20, words))), float(np.log1p(total))]

    def score(self, text: str) -> float:
        z = float(np.dot(self.coef, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _occurrences(lengths: tuple[int, ...]):
    """Documents by label for each whole word and word beginning of a batch of labelled texts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs = {0: Counter(), 1: Counter()}
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                words = set(folded(text or "").split())
                docs[y].update({w + " " for w in words} | {w[:n] for n in lengths for w in words if len(w) >= n})
            keys = list(docs[0].keys() | docs[1].keys())
            yield pd.DataFrame({"pattern": keys} | {f"d{y}": [docs[y][k] for k in keys] for y in (0, 1)})

    return of


def _contexts(lexicon: Broadcast):
    """Documents by label for each phrase of two or three words about a hit."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs = {0: Counter(), 1: Counter()}
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                line = folded(text or "")
                words, own = line.split(), set()
                edges = np.flatnonzero(np.array([c == " " for c in line]))
                for k in np.searchsorted(edges, sorted(lexicon.value.found(line))).tolist():
                    for a, b in ((k - 1, k + 1), (k, k + 2), (k - 1, k + 2)):
                        if a >= 0 and b <= len(words):
                            own.add(" ".join(words[a:b]))
                docs[y].update(own)
            keys = list(docs[0].keys() | docs[1].keys())
            yield pd.DataFrame({"phrase": keys} | {f"d{y}": [docs[y][k] for k in keys] for y in (0, 1)})

    return of


def _log_ratio(size: dict[int, int]) -> Column:
    """How much likelier a toxic document holds it than another: log of the ratio of the two rates."""
    return F.log((F.col("d1") + 0.5) / F.lit(float(size[1]))) - F.log((F.col("d0") + 0.5) / F.lit(float(size[0])))


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, *, rows_per_label: int = 6000, entries: int = 5000, phrases: int = 2000, lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8),
    least_docs: int = 6, least_weight: float = 1.2, exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learn pattern weights, exception phrases and the calibration from ``labels(doc_id, toxic)``.

    The sample has at most ``rows_per_label`` rows of each label, least by a hash of doc_id.  Two
    thirds of it give the weights, log ratios of the document rates in toxic and other texts, for
    at most ``entries`` patterns, the most significant ones.  The same two thirds give at most
    ``phrases`` exceptions beside those of ``exceptions``: two or three words about a hit that
    ``least_docs`` documents hold and that other texts hold oftener than toxic ones, by the weight a
    pattern needs.  The rest fits the logistic calibration, where each label weighs as in all of
    ``labels``, not as in the sample.

    Null labels and labels other than 0 and 1 are ignored; a doc_id labelled both ways is toxic.
    Rows repeated under one doc_id count once, with the least of their texts.  Patterns that tie
    in significance are taken in code point order.  Without both labels, as in empty tables, the
    lexicon is empty and every score is low.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("order", order)
    drawn = labels.where("toxic = 1").orderBy("order").limit(rows_per_label).unionAll(labels.where("toxic = 0").orderBy("order").limit(rows_per_label))
    drawn = drawn.withColumn("fold", F.conv(F.substring("order", 1, 6), 16, 10).cast("long") % 3)
    text = F.min(F.coalesce("text", F.lit("")))
    sample = kept(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic", "fold").agg(text.alias("text")), "toxic-sample")
    learned = sample.where("fold < 2").select("text", "toxic")
    size = {r["toxic"]: r["n"] or 0 for r in learned.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Lexicon({}, list(exceptions))
    share = float(size[1]) / (size[0] + size[1])
    expected = (F.col("d0") + F.col("d1")) * share
    counted = learned.mapInPandas(_occurrences(lengths), "pattern string, d0 long, d1 long")
    best = (
        counted.groupBy("pattern").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
        .withColumns({"weight": _log_ratio(size), "z": (F.col("d1") - expected) / F.sqrt(expected * (1 - share))})
        .where((F.col("d1") >= least_docs) & (F.col("weight") >= least_weight) & (F.col("z") >= 5) & (F.length("pattern") >= 3))
        .orderBy(F.desc("z"), "pattern").limit(entries)
    )
    lexicon = Lexicon({r["pattern"]: float(r["weight"]) for r in best.collect()}, list(exceptions))
    if lexicon.weights:
        about = learned.mapInPandas(_contexts(docs.sparkSession.sparkContext.broadcast(lexicon)), "phrase string, d0 long, d1 long")
        harmless = (
            about.groupBy("phrase").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
            .where((F.col("d0") >= least_docs) & (_log_ratio(size) <= -least_weight))
            .orderBy(F.desc("d0"), "phrase").limit(phrases)
        )
        lexicon = Lexicon(lexicon.weights, [*exceptions, *(r["phrase"] for r in harmless.collect())])
    rows = bounded_rows(_features(sample.where("fold = 2"), lexicon), 2 * rows_per_label, "the calibration sample")
    if rows:
        x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
        known = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        lexicon.coef = tuple(_logistic(x, y, np.array([known[t] / min(known[t], rows_per_label) for t in y.astype(int)])))
    return lexicon


def _features(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def x(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.features(t or "") for t in texts], dtype=object)

    return sample.select("toxic", x("text").alias("x"))


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; ``each`` says how many rows a row stands for."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (each * (y - p)) - ridge * w), -5, 5)
    return w


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) put in place of such columns.

    Null and empty texts score as texts without a hit.  Whole texts are matched.  Repeated rows
    repeat; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t or "") for t in texts], dtype=float)

    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
