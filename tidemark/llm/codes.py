"""Product codes of vectors: integer k-means over parts, with annular norm pruning (op12).

A vector is cut into equal parts and each part is stood for by the nearest entry of its position's
codebook.  Distance and norm are tied by ``| |x| - |c| | <= |x - c|``: with the entries sorted by
norm, a known distance ``d`` leaves only the entries whose norm lies in ``[|x| - d, |x| + d]``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept

#: Components are exact in 64 bits below this: eight squared differences of a part sum to less than 2 ** 60.
LARGEST = 1 << 27
_BROADCAST_LABELS = 1_000_000


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        squares = (entries * entries).sum(axis=1)
        self.order = np.argsort(squares, kind="stable")
        self.norms = np.sqrt(squares[self.order].astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of each row of ``x``, and how many entries were evaluated.

        The entry next in norm gives the first distance; a binary search gives the annulus that this
        distance allows, both ends included; every entry in it is evaluated in integers, ties to the
        lower index.  Norms are rounded, so the ends are moved outwards by more than their error.
        """
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        at = np.searchsorted(self.norms, norm)
        left, right = np.clip(at - 1, 0, None), np.clip(at, None, len(self.norms) - 1)
        probe = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        best = self.order[probe]
        distance = self._squared(x, best)
        radius = np.sqrt(distance.astype(np.float64))
        slack = (norm + radius) * 1e-12 + 1e-9
        low = np.searchsorted(self.norms, norm - radius - slack, "left")
        high = np.searchsorted(self.norms, norm + radius + slack, "right")
        for step in range(int((high - low).max(initial=0))):
            rows = np.flatnonzero(low + step < high)
            entry = self.order[low[rows] + step]
            d = self._squared(x[rows], entry)
            better = (d < distance[rows]) | ((d == distance[rows]) & (entry < best[rows]))
            best[rows[better]], distance[rows[better]] = entry[better], d[better]
        return best, distance, int((high - low).sum())

    def _squared(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x - self.entries[entry]
        return (gap * gap).sum(axis=1)


def _parts(column: pa.Array, parts: int, scale: int, width: int) -> np.ndarray:
    """Vectors as integers, ``rows x parts x width``."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != parts * width).any():
        raise ValueError(f"vectors have {parts * width} components, one has {int(sizes[sizes != parts * width][0])}")
    x = np.floor(scale * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component times {scale} must stay below {LARGEST}")
    return x.astype(np.int64).reshape(len(column), parts, width)


def _sums(books: list[np.ndarray], scale: int):
    """A task's sums and counts by part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        total = [np.zeros_like(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for b in batches:
            x = _parts(b.column("embedding"), len(books), scale, books[0].shape[1])
            for p, book in enumerate(made):
                entry, _, _ = book.nearest(x[:, p])
                np.add.at(total[p], entry, x[:, p])
                count[p] += np.bincount(entry, minlength=len(count[p]))
        rows = [(p, e, int(count[p][e]), i, int(s)) for p in range(len(books)) for e in np.flatnonzero(count[p]) for i, s in enumerate(total[p][e])]
        kinds = ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("total", pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return run


def _coded(books: list[np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        for b in batches:
            x = _parts(b.column("embedding"), len(books), scale, books[0].shape[1])
            found = [book.nearest(x[:, p]) for p, book in enumerate(made)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum((f[1] for f in found), np.zeros(len(x), np.int64))
            hexed = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), hexed, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor holds a null, NaN or infinite component."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & fine)


def fit_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> list[np.ndarray]:
    """One integer codebook a part position, from ``vectors(vec_id, embedding)``, after ``rounds`` of k-means.

    They start as the parts of the ``entries`` smallest vec_ids (equal ones in order of their
    vectors, null last).  A round is one scan: a task returns the sums of its parts by entry,
    Spark adds them up, and the driver, which sees ``entries`` times the vector's size, divides.
    """
    rows = usable(vectors).select("embedding")
    first = usable(vectors).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    if not len(first):
        return []
    size = len(first["embedding"][0])
    if size % parts:
        raise ValueError(f"{size} components do not cut into {parts} parts")
    start = _parts(first["embedding"].combine_chunks(), parts, scale, size // parts)
    books = [start[:, p].copy() for p in range(parts)]
    for _ in range(rounds):
        partial = rows.mapInArrow(_sums(books, scale), "part int, entry int, n long, at int, total long")
        merged = partial.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
        books = [b.copy() for b in books]
        for r in merged.collect():
            books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all components as decimal integers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, books: list[np.ndarray], scale: int = 4096) -> DataFrame:
    """``vec_id, label, code, error`` of every usable row of ``vectors(vec_id, label, embedding)``.

    ``code`` has two hex digits a part, ``error`` is the squared distance to what it stands for.
    """
    rows = usable(vectors).select("vec_id", "label", "embedding")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    if not books:
        return rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return rows.mapInArrow(_coded(books, scale), f"{kinds}, code string, error long")


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``: codebooks fitted on all of ``vectors``, every row coded.

    ``label_error`` is the error summed over the rows of equal label, nulls being one label.  Null
    and non-finite vectors are dropped; repeated rows count as often as they occur; a null vec_id is
    coded like any other; vectors of unequal size are an error, and so are components of 32,768 or
    more; fewer rows than ``entries`` give shorter codebooks; an empty table gives an empty one.
    Other columns are not looked at.
    """
    books = fit_codebooks(vectors, parts, entries, rounds, scale)
    coded = kept(encode_vectors(vectors, books, scale), "codes")
    by_label = kept(coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error")), "label-errors")
    side = F.broadcast(by_label) if by_label.count() <= _BROADCAST_LABELS else by_label
    return coded.join(side, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
