"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_rows, unused

_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Texts of fewer bytes are encoded twice: alone they are stored raw, and all languages tie.
SHORT = 96
#: Longer texts are encoded in pieces of at most so many bytes: a dictionary saves a fixed amount on one encoding.
PIECE = 8 << 10


def plain(text: str) -> bytes:
    """Lower case, other characters than letters as one space: what dictionaries and texts share."""
    return (" " + _NO_LETTERS.sub(" ", text.lower()) + " ").encode()


class CompressionClassifier:
    """Sizes of a text under each language's raw-content dictionaries decide its language.

    Each language has ``dictionaries`` dictionaries of ``dictionary_bytes``, cut in turn from its
    sample.  The first of each judges; while the margin is below ``narrow`` the next ones are
    added.  Remaining ties go to the language with more learned rows.  A text is encoded in even
    pieces, each with the dictionary alone, and their sizes are summed: the margin does not fall with
    the length of the text.
    """

    def __init__(self, samples: dict[str, list[str]], counts: dict[str, int], *, dictionaries: int, dictionary_bytes: int, level: int, narrow: float) -> None:
        self.langs = sorted(samples, key=lambda k: (-counts.get(k, 0), k))
        self.narrow, self.level = narrow, level
        self.content: list[list[bytes]] = []
        for i in range(dictionaries):
            self.content.append([b"".join(plain(x) for x in samples[k][i::dictionaries])[-dictionary_bytes:] for k in self.langs])
        self._encoders: list[list] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoders": None}

    def _encoder(self, content: bytes):
        if len(content) < 8:  # zstandard refuses smaller dictionaries
            return zstandard.ZstdCompressor(level=self.level, write_content_size=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1 and margin; ``und`` without any letter."""
        raw = plain(text or "")
        if not any(map(str.isalpha, raw.decode())) or not self.langs:
            return "und", 0.0, 0.0
        if len(raw) < SHORT:
            raw *= 2
        if self._encoders is None:
            self._encoders = [[self._encoder(c) for c in row] for row in self.content]
        count = -(-len(raw) // PIECE)
        cuts = [len(raw) * i // count for i in range(count + 1)]
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        sizes, best, margin = [0] * len(self.langs), 0, 0.0
        for row in self._encoders:
            sizes = [n + sum(len(e.compress(x)) for x in pieces) for n, e in zip(sizes, row, strict=True)]
            best = sizes.index(min(sizes))
            second = min((n for i, n in enumerate(sizes) if i != best), default=None)
            margin = 1.0 if second is None else (second - sizes[best]) / second
            if margin >= self.narrow:
                break
        return self.langs[best], min(1.0, 0.5 + 5 * margin), margin


def fit_languages(
    labelled: DataFrame, *, rows_per_language: int = 300, chars_per_row: int = 2000, languages: int = 400,
    dictionaries: int = 8, dictionary_bytes: int = 32 << 10, level: int = 6, narrow: float = 0.03,
) -> CompressionClassifier:
    """Fit on a bounded sample of ``labelled(doc_id, text, lang)``.

    The sample has at most ``rows_per_language`` rows of each language, those least by a hash of
    doc_id and text, and ``chars_per_row`` characters from the middle of each.  Rows are drawn where
    they lie, by a threshold on that hash from the language's (estimated) number of different rows,
    so no task sees a whole language.  More than ``languages`` languages are refused.

    Counts of rows are over all of ``labelled``; they only order languages that tie.  Null texts and
    null languages are left out.  Rows repeated with doc_id, text and language are drawn as one; rows
    that share a doc_id and differ in text are different rows.  A table without any row gives a
    classifier that answers ``und``.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    top = 1 << 62
    labelled = labelled.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
    per_lang = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.03).alias("different"))
    found = bounded_rows(per_lang, languages, "the list of languages")
    if not found:
        return CompressionClassifier({}, {}, dictionaries=dictionaries, dictionary_bytes=dictionary_bytes, level=level, narrow=narrow)
    # half as many again as needed: the estimate is 3 % off, the draw a few standard deviations
    wanted = 1.5 * rows_per_language + 50
    limits = [(r["lang"], int(top * min(1.0, wanted / max(1, r["different"])))) for r in found]
    limit = F.create_map(*[F.lit(x) for pair in limits for x in pair])
    start = F.greatest(F.lit(1), ((F.length("text") - chars_per_row) / 2).cast("int") + 1)
    piece = F.substring("text", start, F.lit(chars_per_row))
    drawn = labelled.where(F.col("h") <= limit[F.col("lang")]).select("lang", "h", piece.alias("piece")).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    samples: dict[str, list[str]] = {}
    for r in sorted(bounded_rows(drawn, int(2 * wanted) * len(found), "the sample"), key=lambda r: (r["lang"], r["h"])):
        own = samples.setdefault(r["lang"], [])
        if len(own) < rows_per_language:
            own.append(r["piece"])
    counts = {r["lang"]: r["n"] for r in found}
    return CompressionClassifier(samples, counts, dictionaries=dictionaries, dictionary_bytes=dictionary_bytes, level=level, narrow=narrow)


def identify(docs: DataFrame, model: CompressionClassifier, reject_below: float = 0.005) -> DataFrame:
    """``docs`` with ``lang_pred, score, margin, rejected`` put in place of columns of those names.

    ``rejected`` marks ``und`` and texts whose margin, (second - best) / second of the compressed
    sizes, is below ``reject_below``.  Null texts and texts without a letter are ``und``, score 0.
    Whole texts are encoded: long ones in pieces of ``PIECE`` bytes, those under ``SHORT`` bytes twice
    over, for a shorter one would be stored raw under every dictionary.  Among equal sizes the
    language with more learned rows is predicted, with margin 0, hence rejected.  Repeated rows
    repeat; an empty table gives an empty one; without any learned language all is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.judge(t) for t in texts], columns=["lang_pred", "score", "margin"]).astype({"score": float, "margin": float, "lang_pred": object})

    for name in ("lang_pred", "score", "margin", "rejected"):
        docs = docs.drop(name)
    own = unused(docs, "_found")
    found = docs.withColumn(own, judge("text")).select("*", f"{own}.*").drop(own)
    return found.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < reject_below))
