"""Substring dedup by a sparse suffix array over word minimisers.

Of all word suffixes only those at minimiser positions are retained: in every window of ``length``
words the ``anchor``-word sequence with the least hash.  Equal windows have it at the same place, so
no repeat of ``length`` words is missed, and about one suffix in twenty is kept.  The retained
suffixes are sorted by a hash of their first ``anchor`` words; one without an equal neighbour
starts no repeat and goes.  The others travel with their words, as far to the left and right as the
windows they are the minimiser of reach.  There they are sorted by those words, with ranks by doubled
lengths as in the construction of a suffix array; neighbours of equal rank are a passage's copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept
from tidemark.llm.subtree import hashed, out
from tidemark.llm.suffixes import by_group, chunks, later_windows, minimisers, mixed, pack_runs, places, rolling, unpack, unpack_runs


def ranks(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` words from each place ``at``: equal for equal words and for no others.

    Ranks of one word become those of two, four, eight: a pair of ranks is ranked by sorting.
    ``words`` are exact numbers; only places whose words lie inside one run are looked at.
    """
    rank, size = words.astype(np.int64), 1
    pair = lambda a, b: np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]
    while 2 * size <= length:
        rank = pair(rank[: len(rank) - size], rank[size:])
        size *= 2
    return pair(rank[at], rank[at + length - size])


def _anchors(rows: DataFrame, length: int, anchor: int, chunk_words: int) -> DataFrame:
    """``(h, doc_id, row, at)``: hash and place of every retained suffix."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, chunk_words):
            _, own, hashes = minimisers(c, length, anchor)
            at = np.unique(own)
            doc = c.doc_of()[at]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(c.ids[doc]), pa.array(c.rows[doc]), pa.array((at - c.first[doc]).astype(np.int32))], names=["h", "doc_id", "row", "at"])

    return rows.mapInArrow(each, "h long, doc_id long, row long, at int")


def _windows(rows: DataFrame, length: int, anchor: int, groups: int, chunk_words: int) -> DataFrame:
    """``(key, blob)``: packed windows of the surviving suffixes, by group.

    ``rows`` has, beside doc_id, row and text, the surviving places and which of them are frequent.
    An anchor's windows go to one group; those of a frequent anchor are spread by their own hash.
    A chunk sends only the earliest of its equal windows and reports the others at once.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, r, at, often in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                    marks[(i, r)] = (at.values.to_numpy(), often.values.to_numpy(zero_copy_only=False))
                yield b

        for c in chunks(noted(), chunk_words):
            words = c.word_list()
            idx, at, hashes = minimisers(c, length, anchor)
            alive, often = np.zeros(c.words, bool), np.zeros(c.words, bool)
            for k, key in enumerate(zip(c.ids.tolist(), c.rows.tolist(), strict=True)):
                own, hot = marks.pop(key, (None, None))
                if own is not None:
                    alive[c.first[k] + own], often[c.first[k] + own] = True, hot
            idx, at = idx[alive[at]], at[alive[at]]
            doc = c.doc_of()[idx]
            later = later_windows(words, c.codes, idx, c.ids[doc], idx - c.first[doc], length, ranks)
            found = [(groups + block, blob) for block, blob in places(c.ids, c.rows, doc[later], (idx - c.first[doc])[later], groups)]
            idx, at = idx[~later], at[~later]
            cuts = often[at] | (np.diff(at, prepend=-1) != 0)
            spread = np.where(often[at], rolling(c.codes, length)[idx], hashes[at])
            for group, own in by_group((mixed(spread) % np.uint64(groups)).astype(np.int64)):
                found.append((group, pack_runs(c, words, idx[own], cuts[own], length)))
            if found:
                yield out(found)

    return rows.mapInArrow(each, "key long, blob binary")


def find_repeats(docs: DataFrame, *, length: int = 50, anchor: int = 10, frequent: int = 1000, group_words: int = 500_000, chunk_words: int = 400_000) -> DataFrame:
    """``doc_id, start, n_words``: passages of ``length`` words or more that occur earlier too.

    Words are kept as they are.  Earlier is a smaller doc_id, or an earlier start in the same
    document.  A row is a longest run of words that are each covered by a window of ``length``
    words that occurs earlier; ``start`` counts words from 0.

    Null and short texts have no row.  A null doc_id is the smallest and stays null.  Rows that
    share a doc_id are one place.  Repeated rows give their passages once; an empty table gives an
    empty result.
    """
    rows = hashed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min)))
    anchors = kept(_anchors(rows, length, anchor, chunk_words), "anchors")
    groups = max(1, -(-anchors.count() * (length - anchor) // (2 * group_words)))
    # written, so that the join below shuffles both sides anew and AQE can split a hot anchor
    repeated = kept(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > frequent).alias("often")), "repeated")
    placed = anchors.join(repeated, "h").groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "often")).alias("places"))
    marked = rows.dropDuplicates(["doc_id", "row"]).join(placed, ["doc_id", "row"]).select("doc_id", "row", "text", F.col("places.at").alias("at"), F.col("places.often").alias("often"))
    sent = _windows(marked, length, anchor, groups, chunk_words)

    def neighbours(key: tuple, members: pa.Table) -> pa.Table:
        if key[0].as_py() >= groups:  # found within their chunk
            return pa.table({"block": pa.array([key[0].as_py() - groups] * len(members), pa.int64()), "blob": members["blob"]})
        ids, own, starts, words, codes, at = unpack_runs((b.as_py() for b in members["blob"]), length)
        later = later_windows(words, codes, at, ids, starts, length, ranks)
        found = list(places(ids[later], own[later], np.arange(later.sum()), starts[later], groups))
        return pa.table({"block": pa.array([k for k, _ in found], pa.int64()), "blob": pa.array([b for _, b in found], pa.binary())})

    def runs(members: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in members["blob"]]
        ids, own, counts, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc, row = np.repeat(ids, counts), np.repeat(own, counts).astype(np.int64)
        order = np.lexsort((starts, row, doc))
        doc, row, starts = doc[order], row[order], starts[order]
        new = np.flatnonzero((np.diff(doc, prepend=~doc[:1]) != 0) | (np.diff(row, prepend=-1) != 0) | (np.diff(starts, prepend=0) > length))
        last = np.append(new[1:], len(doc)) - 1
        return pa.table({"doc_id": doc[new], "start": starts[new], "n_words": starts[last] - starts[new] + length})

    flags = sent.groupBy("key").applyInArrow(neighbours, "block long, blob binary")
    spans = flags.groupBy("block").applyInArrow(runs, "doc_id long, start long, n_words long")
    return spans.withColumn("doc_id", F.nullif("doc_id", F.lit(np.iinfo(np.int64).min)))
