"""Substring dedup by prefix-partitioned suffix trees.

The word suffixes of all documents form one suffix tree.  It is never held whole: suffixes are
partitioned by a variable-length prefix, so that each partition is a subtree that fits in a task's
memory.  The prefix is taken at the suffix's minimiser, the ``anchor``-word sequence of least hash
among its first ``length`` words: suffixes that agree so far have it at the same place, and
neighbouring suffixes mostly share it, so a run of suffixes travels to its subtree with its words
once.  Where a prefix is too frequent for one partition, it is lengthened to all ``length`` words.

A suffix whose hash of ``length`` words is alone in its subtree is a leaf that hangs above that depth.
The task sorts the others by their words and takes the lengths of the prefixes that
neighbours share.  Intervals of neighbours that share ``length`` words are the subtree's deep
internal nodes; every leaf below one but the earliest starts a repeated window, and windows that
follow each other in a document make up its maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_text
from tidemark.llm.suffixes import by_group, chunks, later_windows, minimisers, mixed, pack_runs, places, rolling, unpack, unpack_runs

#: Words of the shorter prefix.
ANCHOR = 4


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def hashed(docs: DataFrame) -> DataFrame:
    """What map tasks read: doc_id, a hash of the row, the text as bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row"), binary_text().alias("text"))


class Prefixes:
    """The partition of suffixes: the frequent short prefixes, by hash and ascending, and the number of groups."""

    def __init__(self, frequent: np.ndarray, groups: int) -> None:
        self.frequent, self.groups = frequent, groups

    def often(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are those of frequent prefixes."""
        if not len(self.frequent):
            return np.zeros(len(h), bool)
        return self.frequent[np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)] == h


def count_prefixes(rows: DataFrame, length: int, anchor: int, *, group_words: int, chunk_words: int, least: int = 64, entries: int = 50_000) -> Prefixes:
    """Count the suffixes and their frequent prefixes over all documents.

    A chunk reports the prefixes it has ``least`` times or more; Spark sums them.  A prefix is
    frequent from an eighth of a group on, and at most ``entries`` are, by that share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, chunk_words):
            idx, at, hashes = minimisers(c, length, anchor)
            key, n = np.unique(hashes[at], return_counts=True)
            key, n = key[n >= least], n[n >= least]
            sums = [pa.array(np.append(False, np.ones(len(key), bool))), pa.array(np.append(np.uint64(0), key).view(np.int64)), pa.array(np.append(len(idx), n).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(sums, names=["of_prefix", "prefix", "n"])

    seen = rows.mapInArrow(count, "of_prefix boolean, prefix long, n long").groupBy("of_prefix", "prefix").agg(F.sum("n").alias("n"))
    # the sum of all suffixes comes first: no prefix has more
    top = seen.where(~F.col("of_prefix")).first()
    total = top["n"] if top else 0
    often = seen.where(F.col("of_prefix") & (F.col("n") >= max(group_words // 8, total // entries, least))).select("prefix").collect()
    return Prefixes(np.sort(np.array([r["prefix"] for r in often], np.int64).view(np.uint64)), max(1, -(-total // group_words)))


def out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["key", "blob"])


def deep_nodes(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The node of each suffix at ``depth``: a number that suffixes share if, and only if, their first ``depth`` words are equal.

    The suffixes are sorted by their words; a node is an interval of neighbours that share ``depth`` words.
    """
    prefix = words[at[:, None] + np.arange(depth)]
    wide = np.pad(prefix, ((0, 0), (0, depth % 2))).astype(np.int64)
    order = np.lexsort((wide[:, 0::2] << 32 | wide[:, 1::2]).T[::-1])
    shared = np.ones(max(0, len(at) - 1), bool)  # neighbours whose longest common prefix reaches the depth
    for k in range(depth):
        column = prefix[order, k]
        shared &= column[1:] == column[:-1]
    node = np.empty(len(at), np.int64)
    node[order] = np.cumsum(np.append(np.zeros(min(1, len(at)), bool), ~shared))
    return node


def repeated_windows(rows: DataFrame, length: int, anchor: int, prefixes: Prefixes, chunk_words: int) -> DataFrame:
    """``(block, blob)``: packed places at which a window of ``length`` words starts that starts earlier too.

    A chunk is a small subtree of its own: it keeps only the earliest of its equal windows and
    reports the others at once, so a passage that a third of all documents hold reaches its
    partition once a chunk.
    """
    groups = prefixes.groups

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, chunk_words):
            words = c.word_list()
            idx, at, hashes = minimisers(c, length, anchor)
            doc = c.doc_of()[idx]
            later = later_windows(words, c.codes, idx, c.ids[doc], idx - c.first[doc], length, deep_nodes)
            rows = [(groups + block, blob) for block, blob in places(c.ids, c.rows, doc[later], (idx - c.first[doc])[later], groups)]
            idx, at = idx[~later], at[~later]
            often = prefixes.often(hashes[at])
            key = np.where(often, rolling(c.codes, length)[idx], hashes[at])
            cuts = often | (np.diff(at, prepend=-1) != 0)
            for group, own in by_group((mixed(key) % np.uint64(groups)).astype(np.int64)):
                rows.append((group, pack_runs(c, words, idx[own], cuts[own], length)))
            if rows:
                yield out(rows)

    def subtree(key: tuple, members: pa.Table) -> pa.Table:
        if key[0].as_py() >= groups:  # found within their chunk
            return pa.table({"block": pa.array([key[0].as_py() - groups] * len(members), pa.int64()), "blob": members["blob"]})
        ids, own, starts, words, codes, at = unpack_runs((b.as_py() for b in members["blob"]), length)
        later = later_windows(words, codes, at, ids, starts, length, deep_nodes)
        found = list(places(ids[later], own[later], np.arange(later.sum()), starts[later], groups))
        return pa.table({"block": pa.array([k for k, _ in found], pa.int64()), "blob": pa.array([b for _, b in found], pa.binary())})

    sent = rows.mapInArrow(suffixes, "key long, blob binary")
    return sent.groupBy("key").applyInArrow(subtree, "block long, blob binary")


def starts_by_row(blobs: pa.ChunkedArray) -> dict[tuple[int, int], list[np.ndarray]]:
    """Flagged starts of each (doc_id, row hash) of a block."""
    out: dict[tuple[int, int], list[np.ndarray]] = {}
    for b in blobs:
        ids, rows, counts, starts = unpack(b.as_py())
        ends = np.cumsum(counts)
        for i, r, s, e in zip(ids.tolist(), rows.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            out.setdefault((i, r), []).append(starts[s:e])
    return out


def covered(n: int, starts: list[np.ndarray], length: int) -> np.ndarray:
    """Which of ``n`` words some window covers."""
    at = np.concatenate(starts)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + length, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, *, length: int = 50, digest: bool = False, anchor: int = ANCHOR, group_words: int = 500_000, chunk_words: int = 500_000) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document; a null doc_id is the
    smallest.  Windows are judged on the input.  Returns ``docs`` with ``text`` cut: where words
    went, the kept words joined by one space, else the text as it was; ``n_words`` and
    ``n_removed`` are put in place of columns of those names.  With ``digest`` it returns
    ``doc_id, n_words, n_removed, kept_sha256`` instead, the hash over kept words joined by one space.

    Null and empty texts have no words and stay; texts under ``length`` words lose none.  Rows that
    share a doc_id are one place: equal windows at the same start of them do not remove each
    other.  Repeated rows stay repeated; an empty table gives an empty one.
    """
    rows = hashed(docs)
    prefixes = count_prefixes(rows, length, anchor, group_words=group_words, chunk_words=chunk_words)
    blocks = prefixes.groups
    flags = repeated_windows(rows, length, anchor, prefixes, chunk_words)
    docs = docs.drop("n_words", "n_removed")
    names = [] if digest else docs.columns
    carried = F.struct(*names).alias("_whole") if names else binary_text().alias("_text")
    picked = docs.select(F.col("doc_id").cast("long").alias("_id"), row_hash().alias("_row"), carried)
    picked = picked.withColumn("_block", F.col("_row").bitwiseAND(F.lit(0xFFFFFFFF)) % blocks)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        found = starts_by_row(right["blob"])
        n_words, n_removed, result = [], [], []
        texts = left["_text"] if digest else pc.cast(pc.struct_field(left["_whole"], "text"), pa.binary())
        for i, r, text in zip(left["_id"].to_pylist(), left["_row"].to_pylist(), texts, strict=True):
            words = (text.as_py() or b"").split()
            starts = found.get((np.iinfo(np.int64).min if i is None else i, r & 0xFFFFFFFF))
            gone = 0
            if starts:
                cover = covered(len(words), starts, length)
                gone = int(cover.sum())
                words = list(compress(words, (~cover).tolist()))
            n_words.append(len(words) + gone), n_removed.append(gone)
            joined = b" ".join(words)
            result.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode() if gone else None)
        own = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "_result": pa.array(result, pa.string())}
        return pa.table(({"doc_id": left["_id"]} if digest else {"_whole": left["_whole"]}) | own)

    head = "doc_id long" if digest else f"_whole {picked.schema['_whole'].dataType.simpleString()}"
    done = picked.groupBy("_block").cogroup(flags.groupBy("block")).applyInArrow(cut, f"{head}, n_words long, n_removed long, _result string")
    if digest:
        return done.select("doc_id", "n_words", "n_removed", F.col("_result").alias("kept_sha256"))
    return done.select(*(F.coalesce("_result", "_whole.text").alias("text") if c == "text" else F.col("_whole")[c].alias(c) for c in names), "n_words", "n_removed")
