"""Word suffixes of batches of documents as numpy arrays: hash codes, exact numbers, runs of windows and packed lists.

Hashes choose positions and groups; which windows are equal is decided by the words themselves.

Tasks hold a chunk of documents as flat arrays, so the cost of a word is a few nanoseconds and not a
Python object.  What tasks exchange is packed into a few binary rows for each chunk and group.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
_LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Documents in order of doc_id and their words.

    ``ids``, ``rows``: doc_id (null: the least long) and row hash of each document; ``first``:
    index of its first word, with the number of words as the last; ``codes``: a 64-bit code a word,
    never 0; ``endings``: its last two bytes.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, texts: list[bytes]) -> None:
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        texts = [texts[i] for i in order]
        self.texts = texts
        raw = b"\n".join(texts) + b"\n" + bytes(8)
        a = np.frombuffer(raw, np.uint8)[: len(raw) - 8]
        edge = np.diff(_SPACE[a].view(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(starts, at)
        self.codes = self._hash(raw, starts, ends - starts)
        self.words = len(starts)
        self.endings = a[ends - 1].astype(np.int32) | np.where(ends - starts > 1, a[ends - 2], 0).astype(np.int32) << 8

    @staticmethod
    def _hash(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
        h = sizes.astype(np.uint64) * _A
        h = mixed(h ^ (eight[starts] & _MASK[np.minimum(sizes, 8)]))
        left, k = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
        while len(left):
            s = sizes[left] - k
            h[left] = mixed((h[left] * _B) ^ (eight[starts[left] + k] & _MASK[np.minimum(s, 8)]))
            left, k = left[s > 8], k + 8
        for i in np.flatnonzero(sizes > _LONG):
            h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]], 7)
        return np.maximum(h, np.uint64(1))

    def word_list(self) -> list[bytes]:
        """The words themselves, in order."""
        return b"\n".join(self.texts).split()

    def doc_of(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of words that start a window of ``length`` words in their document; their hashes."""
        h = rolling(self.codes, length)
        end = np.repeat(self.first[1:], np.diff(self.first))
        idx = np.flatnonzero(np.arange(self.words) + length <= end)
        return idx, mixed(h[idx])


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash mod 2**64 of the ``length`` codes from each position, by doubling."""
    out, done, cur, size = None, 0, codes, 1
    power = lambda k: np.uint64(pow(_P, k, 1 << 64))
    while True:
        if length & size:
            part = cur[done:]
            out = cur if out is None else out[: len(part)] * power(size) + part[: len(out)]
            done += size
        if 2 * size > length:
            return out
        cur = cur[: max(0, len(cur) - size)] * power(size) + cur[size:]
        size *= 2


def chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Chunk]:
    """Chunks of about ``words`` words of batches ``(doc_id, row, text as bytes)``; a document stays whole."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    texts: list[bytes] = []
    size = 0

    def flush() -> Chunk:
        nonlocal size
        out = Chunk(np.concatenate(ids), np.concatenate(rows), list(texts))
        ids.clear(), rows.clear(), texts.clear()
        size = 0
        return out

    for b in batches:
        own = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        keys = b.column(1).to_numpy(zero_copy_only=False)
        at = 0
        for i, t in enumerate(b.column(2)):
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= 6 * words:
                ids.append(own[at : i + 1]), rows.append(keys[at : i + 1])
                at = i + 1
                yield flush()
        ids.append(own[at:]), rows.append(keys[at:])
    if texts:
        yield flush()


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes first: zero bytes then compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(raw: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def pack(ids: np.ndarray, rows: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> bytes:
    """Pack places ``(document, start)``, in that order."""
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    counts = np.diff(new, append=len(doc)).astype(np.uint32)
    steps = np.diff(starts, prepend=0)
    steps[new] = starts[new]
    own = doc[new]
    head = np.array([len(new), len(doc)], np.uint32).tobytes()
    body = _planes(ids[own]) + (rows[own] & 0xFFFFFFFF).astype(np.uint32).tobytes() + _planes(counts) + _planes(steps.astype(np.uint32))
    return head + body


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids, rows, counts`` of the documents and ``starts`` of the places."""
    m = memoryview(blob)
    nd, n = (int(x) for x in np.frombuffer(m, np.uint32, 2))
    at = 8
    ids = _numbers(m[at:], "<i8", nd)
    rows = np.frombuffer(m, np.uint32, nd, at + 8 * nd)
    at += 12 * nd
    counts = _numbers(m[at:], "<u4", nd).astype(np.int64)
    at += 4 * nd
    steps = _numbers(m[at:], "<u4", n).astype(np.int64)
    new = np.cumsum(counts) - counts
    run = np.cumsum(steps)
    starts = run - np.repeat(run[new] - steps[new], counts)
    return ids, rows, counts, starts


def minimisers(c: Chunk, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the position of each window's minimiser, and the hashes of all anchors.

    Among equal hashes the leftmost position counts, so it depends on the window's words alone.
    """
    idx, _ = c.windows(length)
    hashes = mixed(rolling(c.codes, anchor))
    order = np.argsort(hashes, kind="stable")  # equal hashes stay in order of position
    least = np.empty(len(order), np.int64)
    least[order] = np.arange(len(order))
    width, size = length - anchor + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return idx, order[np.minimum(least[idx], least[idx + width - size])], hashes


def by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group with the indices it has, in order."""
    if not len(group):
        return
    order = np.argsort(group.astype(np.uint16) if group.max() < 65536 else group, kind="stable")
    new = np.flatnonzero(np.diff(group[order], prepend=-1))
    for a, b in zip(new, np.append(new[1:], len(order)), strict=True):
        yield int(group[order[a]]), order[a:b]


def block_of(rows: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a row hash: of its low 32 bits, which is what packed places keep of it."""
    return (rows.astype(np.int64) & 0xFFFFFFFF) % blocks


def places(ids: np.ndarray, rows: np.ndarray, doc: np.ndarray, starts: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """Packed places ``(document, start)`` by block of their document."""
    order = np.lexsort((starts, doc))
    doc, starts = doc[order], starts[order]
    for block, own in by_group(block_of(rows[doc], blocks)):
        yield block, pack(ids, rows, doc[own], starts[own])


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges ``first[k] .. first[k] + sizes[k]``, one after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def pack_runs(c: Chunk, words: list[bytes], windows: np.ndarray, cuts: np.ndarray, length: int) -> bytes:
    """Windows that start at words ``windows``, as runs with their words; a run begins wherever ``cuts`` is set.

    Neighbouring windows share a run, so a word travels once a run and not once a window.
    """
    new = np.flatnonzero(cuts | (np.diff(windows, prepend=-2) != 1))
    counts = np.diff(new, append=len(windows))
    first = windows[new]
    doc = np.searchsorted(c.first, first, "right") - 1
    text = b"\n".join(map(words.__getitem__, _ragged(first, counts + length - 1).tolist()))
    own = (c.ids[doc], (c.rows[doc] & 0xFFFFFFFF).astype(np.uint32), (first - c.first[doc]).astype(np.uint32), counts.astype(np.uint32), text)
    return zstandard.compress(pickle.dumps(own, protocol=5), 3)


def unpack_runs(blobs: Iterator[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """``ids, rows, starts`` of every window of the runs, the words of all runs and their codes, and where in them each window starts."""
    heads, texts = [], []
    for b in blobs:
        *head, text = pickle.loads(zstandard.decompress(b))
        heads.append(head), texts.append(text)
    ids, rows, starts, counts = (np.concatenate(x) for x in zip(*heads, strict=True))
    counts = counts.astype(np.int64)
    sizes = counts + length - 1
    raw = b"\n".join(texts) + b"\n" + bytes(8)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8)[: len(raw) - 8] == 10)
    first = np.append(0, ends[:-1] + 1)
    return np.repeat(ids, counts), np.repeat(rows, counts), _ragged(starts.astype(np.int64), counts), raw[: len(raw) - 9].split(b"\n"), Chunk._hash(raw, first, ends - first), _ragged(np.cumsum(sizes) - sizes, counts)


def exact_numbers(words: list[bytes], needed: np.ndarray) -> np.ndarray:
    """A number for each needed word, equal for equal words and for no others; 0 for the rest."""
    known: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    at = np.flatnonzero(needed)
    out = np.zeros(len(words), np.int32)
    out[at] = np.fromiter(map(known.__getitem__, map(words.__getitem__, at.tolist())), np.int32, len(at))
    return out


Judge = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def later_windows(words: list[bytes], codes: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray, length: int, judge: Judge) -> np.ndarray:
    """Which windows of ``length`` words, starting at words ``at``, have equal words at an earlier place ``(id, start)``.

    A window whose hash is alone has no equal and is left out.  The others are told apart by their
    words: ``judge(numbers, at, length)`` gives equal windows, and no others, equal numbers.
    """
    own = np.flatnonzero(repeated(rolling(codes, length)[at]))
    edge = np.zeros(len(words) + length + 1, np.int32)
    np.add.at(edge, at[own], 1)
    np.add.at(edge, at[own] + length, -1)
    exact = exact_numbers(words, np.cumsum(edge)[: len(words)] > 0)
    later = np.zeros(len(at), bool)
    later[own] = later_copies(judge(exact, at[own], length), ids[own], starts[own])
    return later


def repeated(prints: np.ndarray) -> np.ndarray:
    """Which numbers occur more than once."""
    order = np.argsort(prints)
    run = prints[order]
    same = np.zeros(len(run) + 1, bool)
    same[1:-1] = run[1:] == run[:-1]
    out = np.empty(len(run), bool)
    out[order] = same[1:] | same[:-1]
    return out


def later_copies(node: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places have an equal ``node`` number at an earlier place ``(id, start)``."""
    _, rank = np.unique(ids, return_inverse=True)
    place = (rank.astype(np.uint64) << np.uint64(32)) | starts.astype(np.uint64)
    order = np.argsort(node, kind="stable")
    new = np.flatnonzero(np.diff(node[order], prepend=node[order[:1]] - 1 if len(order) else 0))
    sizes = np.diff(new, append=len(order))
    many = np.repeat(sizes > 1, sizes)
    order, sizes = order[many], sizes[sizes > 1]
    later = np.zeros(len(node), bool)
    if len(order):
        least = np.minimum.reduceat(place[order], np.cumsum(sizes) - sizes)
        later[order] = place[order] > np.repeat(least, sizes)
    return later
