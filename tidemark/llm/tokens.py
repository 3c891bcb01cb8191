"""Token ids as binary files of patched frame-of-reference blocks (op11).

A file holds the ids of whole documents, one after the other, cut into blocks of ``BLOCK`` ids.  All
numbers are little-endian::

    block      minimum u32 | width u8 | exceptions u16 | ids less the minimum, ``width`` low bits each
               | positions u16 of the exceptions | their full values less the minimum u32
    index      start of every block, u64, and the end of the last
    documents  doc_id i64 | null u8 | start of every document u64, and the end of the last
    trailer    blocks, ids, documents, start of the index, start of the documents u64 | block size u32 | magic

The width of a block is what a percentile of its ids needs; the wider ones are its exceptions.  The last
block is filled up with its first id.  A reader takes the trailer, then only the blocks it wants.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import kept, shared_dir

MAGIC, BLOCK = b"TIDEPFR1", 1024
_HEAD, _TRAILER = struct.Struct("<IBH"), struct.Struct("<5QI8s")
_MANIFEST = "part int, nth int, path string, documents long, tokens long, blocks long, bytes long"
#: Words whose ids a task remembers, the longest that is remembered, and bytes of text encoded in one go.
_REMEMBERED, _LONG_WORD, _SLICE = 600_000, 64, 4 << 20
#: A split that never lets letters and punctuation share a piece, as tokenizer files spell it, and
#: punctuation that no contraction of that split holds.
_LETTERS_APART, _TAIL = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class Encoder:
    """Ids of texts by a tokenizers file, with the ids of words met before remembered.

    Holds for tokenizers that never join or look across ASCII white space, as those that drop it
    before they split: the ids of a text are then those of its words in turn.  ``by_words=False``
    encodes whole texts instead.  Where the tokenizer also keeps letters and punctuation apart, a
    word of letters and its punctuation are remembered each for itself.
    """

    def __init__(self, path: str, by_words: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        marks = self.tokenizer.get_added_tokens_decoder().items()
        plain = [(i, t.content) for i, t in marks if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.mark, self.between = plain[0] if plain else (None, None)
        self.parts_tails = _LETTERS_APART in self.tokenizer.to_str() and not any(t.content.strip(_TAIL) != t.content for _, t in marks)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array in one row, and how many each text has."""
        if not self.by_words:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        table = self._ids(distinct)
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        start = np.cumsum(size) - size
        at = words.indices.to_numpy(zero_copy_only=False)
        sizes = size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], sizes)
        offsets = split.offsets.to_numpy()
        return np.frombuffer(b"".join(table), "<u4")[place], np.diff(ends[offsets - offsets[0]])

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.known) > _REMEMBERED:  # words not met since the last turn are forgotten
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        fresh = [w for w, ids in zip(words, found, strict=True) if ids is None]
        more = {w: self.older[w] for w in fresh if w in self.older}
        tailed, new = [], [w for w in fresh if w not in more]
        if self.parts_tails:
            cores = [w.rstrip(_TAIL) for w in new]
            tailed = [(w, c) for w, c in zip(new, cores, strict=True) if len(c) < len(w) and c.isalpha() and (c.isascii() or normalize("NFC", c).lower().isalpha())]
            pieces = {c for _, c in tailed} | {w[len(c) :] for w, c in tailed} | set(new).difference(w for w, _ in tailed)
            more |= {w: self.known[w] for w in pieces if w in self.known}
            new = [w for w in pieces if w not in more]
        alone = [w for w in new if self.mark is None or self.between in w]
        more |= dict(zip(alone, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)), strict=True))
        more |= self._joined([w for w in new if self.between not in w] if self.mark is not None else [])
        more |= {w: more[c] + more[w[len(c) :]] for w, c in tailed}
        self.known |= {w: ids for w, ids in more.items() if len(w) <= _LONG_WORD}
        return [more[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        """Words encoded in one call, a special token between them."""
        if not words:
            return {}
        ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
        raw, low, high = ids.tobytes(), (4 * (cut[:-1] + 1)).tolist(), (4 * cut[1:]).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, low, high, strict=True)}


@functools.lru_cache(maxsize=2)
def _encoder(path: str, by_words: bool) -> Encoder:
    return Encoder(path, by_words)


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pa.fs.LocalFileSystem(), path
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def pack_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """The blocks of ``ids``, whose number is a multiple of ``BLOCK``."""
    rows = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = rows.min(axis=1)
    gap = rows - low[:, None]
    at = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.frexp(np.partition(gap, at, axis=1)[:, at].astype(np.float64))[1].astype(np.uint8)
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(gap[own].astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        for k, row in enumerate(own):
            wide = np.flatnonzero(gap[row].astype(np.uint64) >> np.uint64(w))
            exceptions = wide.astype("<u2").tobytes() + gap[row][wide].astype("<u4").tobytes()
            out[row] = _HEAD.pack(int(low[row]), int(w), len(wide)) + packed[k].tobytes() + exceptions
    return out


def unpack_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of whole blocks."""
    heads = np.array([_HEAD.unpack_from(b) for b in blocks], np.int64).reshape(-1, 3)
    out = np.empty((len(blocks), BLOCK), np.uint32)
    for w in np.unique(heads[:, 1]):
        own = np.flatnonzero(heads[:, 1] == w)
        size = BLOCK * int(w) // 8
        packed = np.stack([np.frombuffer(blocks[k], np.uint8, size, _HEAD.size) for k in own])
        bits = np.zeros((len(own), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, int(w))
        out[own] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
        for k in own:
            n = int(heads[k, 2])
            at = np.frombuffer(blocks[k], "<u2", n, _HEAD.size + size)
            out[k, at] = np.frombuffer(blocks[k], "<u4", n, _HEAD.size + size + 2 * n)
    return (out + heads[:, 0].astype(np.uint32)[:, None]).ravel()


class _Writer:
    """One file; blocks are written as they fill, the index and the documents at the end."""

    def __init__(self, path: str, percentile: float) -> None:
        fs, place = _file_system(path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.path, self.percentile, self.out = path, percentile, fs.open_output_stream(place)
        self.blocks, self.ids, self.starts, self.waiting, self.held, self.tokens, self.size = [0], [], [0], [], 0, 0, 0

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        """One document, its ids in pieces."""
        self.ids.append(doc_id)
        self.waiting += ids
        n = sum(map(len, ids))
        self.held += n
        self.tokens += n
        self.starts.append(self.tokens)
        if self.held >= 256 * BLOCK:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, n: int) -> None:
        whole = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        for block in (b for at in range(0, n, 256 * BLOCK) for b in pack_blocks(whole[at : min(n, at + 256 * BLOCK)], self.percentile)):
            self._write(block)
            self.blocks.append(self.size)
        self.waiting, self.held = [whole[n:]], len(whole) - n

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple:
        if self.held % BLOCK:
            fill = BLOCK - self.held % BLOCK
            self.waiting.append(np.full(fill, next(w[0] for w in reversed(self.waiting) if len(w)), np.uint32))
            self.held += fill
        self._flush(self.held)
        index = self.size
        self._write(np.array(self.blocks, "<u8").tobytes())
        documents = self.size
        self._write(np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array([i is None for i in self.ids], np.uint8).tobytes() + np.array(self.starts, "<u8").tobytes())
        self._write(_TRAILER.pack(len(self.blocks) - 1, self.tokens, len(self.ids), index, documents, BLOCK, MAGIC))
        self.out.close()
        return self.path, len(self.ids), self.tokens, len(self.blocks) - 1, self.size


class TokenFile:
    """A file opened for reading."""

    def __init__(self, path: str) -> None:
        fs, place = _file_system(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        self.blocks, self.tokens, n, index, documents, block, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC or block != BLOCK:
            raise ValueError(f"{path} is not a token file of blocks of {BLOCK}")
        self.index = np.frombuffer(self._read(index, 8 * (self.blocks + 1)), "<u8").astype(np.int64)
        table = self._read(documents, 17 * n + 8)
        null = np.frombuffer(table, np.uint8, n, 8 * n)
        self.doc_ids = [None if z else int(i) for i, z in zip(np.frombuffer(table, "<i8", n), null, strict=True)]
        self.starts = np.frombuffer(table, "<u8", n + 1, 9 * n).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(int(n), int(at))

    def span(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the place ``first`` on: the index gives the bytes of their blocks."""
        n = max(0, min(n, self.tokens - first))
        if not n:
            return np.empty(0, np.uint32)
        low, high = first // BLOCK, -(-(first + n) // BLOCK)
        raw, base = self._read(self.index[low], self.index[high] - self.index[low]), self.index[low]
        blocks = [raw[self.index[k] - base : self.index[k + 1] - base] for k in range(low, high)]
        return unpack_blocks(blocks)[first - low * BLOCK :][:n]

    def pieces(self, size: int = 256 * BLOCK) -> Iterator[tuple[int, np.ndarray]]:
        """``(document number, ids)`` in order; a document that reaches over a read comes in pieces, an empty one once."""
        document, n = 0, len(self.doc_ids)
        for first in range(0, max(1, self.tokens), size):
            ids = self.span(first, size)
            stop = first + len(ids)
            while document < n and (self.starts[document] < stop or self.starts[document] == self.starts[document + 1]):
                low, high = max(first, self.starts[document]), min(stop, self.starts[document + 1])
                yield document, ids[low - first : high - first]
                if self.starts[document + 1] > stop:
                    break
                document += 1


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``_SLICE`` bytes of text, one at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _written(folder: str, tokenizer: str, by_words: bool, end_id: int, percentile: float, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer, by_words), np.array([end_id], np.uint32)
        part, made, writer = TaskContext.get().partitionId(), [], None
        for b in batches:
            for piece in _slices(b):
                ids, sizes = encode(piece.column("text"))
                for doc_id, own in zip(piece.column("doc_id").to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    if writer is None:
                        writer = _Writer(f"{folder}/part-{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.ids", percentile)
                    writer.add(doc_id, own, end)
                    if writer.tokens >= file_tokens:
                        made.append(writer.close())
                        writer = None
        if writer is not None:
            made.append(writer.close())
        kinds = pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
        rows = [(part, k, *m) for k, m in enumerate(made)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _MANIFEST.split(", ")])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, *, folder: str | None = None, end_id: int = 2, percentile: float = 0.9, file_tokens: int = 1 << 25, partition_bytes: int = 64 << 20, by_words: bool = True) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids in ascending doc_id order; returns the list of files.

    The list (columns ``part, nth, path, documents, tokens, blocks, bytes``) orders files by part and
    nth.  ``tokenizer`` is a path that every executor can open, special tokens are not added, and
    ``end_id`` follows each document.  Rows are range-partitioned by doc_id and text, so that a doc_id
    of many rows spreads too; a task encodes its range and writes files of about ``file_tokens`` ids.

    Files have new names in every attempt and only those of the attempt that Spark took are listed:
    what a lost executor left is never read.  ``folder`` must be one that driver and executors share.

    Null text is empty and has the end id alone; a null doc_id comes first; rows of one doc_id are
    ordered by text; an empty table gives an empty list.  doc_ids must be integers.  Other columns
    are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tables/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    partitions = max(1, -(-total // partition_bytes))
    ordered = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return kept(ordered.mapInArrow(_written(folder, tokenizer, by_words, end_id, percentile, file_tokens), _MANIFEST), "token-files")


def _placed(files: DataFrame) -> DataFrame:
    """Files with the number of ids before them, a partition each."""
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "nth", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return placed.repartition(max(1, files.count()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
            file = TokenFile(path)
            crc = np.zeros(len(file.doc_ids), np.int64)
            for document, ids in file.pieces():
                crc[document] = zlib.crc32(ids.astype("<u4"), int(crc[document]))
            columns = [pa.array(file.doc_ids, pa.int64()), pa.array(file.starts[:-1] + base), pa.array(np.diff(file.starts)), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
            file = TokenFile(path)
            held: list[np.ndarray] = []
            for document, ids in file.pieces():
                held.append(ids.astype(np.int64))
                if sum(map(len, held)) == file.starts[document + 1] - file.starts[document]:
                    row = [file.doc_ids[document]], [int(file.starts[document] + base)], [np.concatenate(held)]
                    held = []
                    yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])


def read_digests(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files: the crc is of its ids as 32-bit numbers."""
    return _placed(files).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document, from the files."""
    return _placed(files).mapInArrow(_documents, "doc_id long, start long, ids array<long>")
