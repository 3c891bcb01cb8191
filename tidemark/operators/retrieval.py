"""Nearest chunks under the two clocks.

The clocks lie on the chunk, so the predicate is pushed into the scan and distances are computed for
surviving rows only.  One question is an ordinary ``orderBy(...).limit(k)``; a batch of questions is
scanned against the chunks in one pass, every task returning only its own ``k`` best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.clock import AsOf
from tidemark.functions.vectors import cosine_distance, doubles
from tidemark.operators.temporal import as_of, believed, one_clock

#: What a batch of questions is scanned under: both clocks, recorded time only, the day as believed now, neither.
SCOPES = ("as_of", "believed", "one_clock", "all")
#: The instants of a question that a scope looks at.
_DATED = {"as_of": ("valid_at", "known_at"), "believed": ("known_at",), "one_clock": ("valid_at",), "all": ()}
_OPEN = np.iinfo(np.int64).max


def with_distance(chunks: DataFrame, query: Column) -> DataFrame:
    return chunks.withColumn("distance", cosine_distance(doubles(F.col("embedding")), query)).drop("embedding")


def nearest(chunks: DataFrame, query: Column, k: int) -> DataFrame:
    """The ``k`` nearest of ``chunks(chunk_id, embedding, ...)``; ties go to the smaller chunk_id."""
    return with_distance(chunks, query).orderBy("distance", "chunk_id").limit(k)


def nearest_as_of(chunks: DataFrame, query: Column, at: AsOf, k: int = 5) -> DataFrame:
    """Filter before rank: candidates are what was in force and on record."""
    return nearest(as_of(chunks, at), query, k)


def nearest_believed(chunks: DataFrame, query: Column, at: AsOf, k: int = 5) -> DataFrame:
    """Valid time dropped: finds the rule that lapsed, to explain a refusal."""
    return nearest(believed(chunks, at), query, k)


def nearest_one_clock(chunks: DataFrame, query: Column, at: AsOf, k: int = 5) -> DataFrame:
    return nearest(one_clock(chunks, at), query, k)


def nearest_post_filtered(chunks: DataFrame, query: Column, at: AsOf, k: int = 5) -> DataFrame:
    """Rank before filter, wrong on purpose: the clocks apply to the ``k`` nearest of all."""
    top = nearest(chunks, query, k)
    return top.join(as_of(chunks, at).select("chunk_id"), "chunk_id", "left_semi")


def _days(c: pa.ChunkedArray | pa.Array, missing: int) -> np.ndarray:
    kind = pa.int32() if pa.types.is_date(c.type) else pa.int64()
    return c.cast(kind).cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def _matrix(c: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; a batch holds one size."""
    flat = c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(c), -1)


#: Distances computed at a time, and bytes of question vectors that a scan of the chunks holds.
_TILE, _RESIDENT = 4_000_000, 256 << 20


class _Best:
    """The ``k`` nearest of each question of a block so far, sorted by question, distance and id."""

    def __init__(self, questions: int, k: int) -> None:
        self.k, self.kth = k, np.full(questions, np.inf)
        self.own, self.distance, self.ids = np.empty(0, np.int64), np.empty(0), None

    def merge(self, own: list[np.ndarray], distance: list[np.ndarray], ids: list[np.ndarray]) -> None:
        if self.ids is not None:
            own, distance, ids = [self.own, *own], [self.distance, *distance], [self.ids, *ids]
        own, distance, ids = (np.concatenate(c) for c in (own, distance, ids))
        order = np.lexsort((ids, distance, own))
        own, distance, ids = own[order], distance[order], ids[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        rank = np.arange(len(own)) - np.repeat(starts, np.diff([*starts, len(own)]))
        best = rank < self.k
        self.own, self.distance, self.ids = own[best], distance[best], ids[best]
        last = np.flatnonzero(rank == self.k - 1)
        self.kth[own[last]] = distance[last]


def _scan(shared: list[Broadcast], scope: str, k: int):
    """A task's ``k`` nearest of every question of all blocks, one row each, after its last batch."""

    def distances(q: dict, rows: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        size = q["norms"][:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
        cos = np.divide(q["vectors"] @ x.T, size, out=np.zeros_like(size), where=size > 0)
        dist = np.round(1 - cos, 6) + 0.0  # no negative zero
        if scope in ("as_of", "one_clock"):
            start, end = _days(rows.column("valid_from"), _OPEN), _days(rows.column("valid_to"), _OPEN)
            dist[(start[None, :] > q["days"][:, None]) | (end[None, :] <= q["days"][:, None])] = np.inf
        if scope in ("as_of", "believed"):
            start, end = _days(rows.column("recorded_at"), _OPEN), _days(rows.column("recorded_until"), _OPEN)
            dist[(start[None, :] > q["moments"][:, None]) | (end[None, :] <= q["moments"][:, None])] = np.inf
        if scope == "one_clock":
            dist[:, ~rows.column("recorded_until").is_null().to_numpy(zero_copy_only=False)] = np.inf
        return dist

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(len(b.value["norms"]), k) for b in shared]
        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            x, kind = _matrix(b.column("embedding")), b.schema.field("chunk_id").type
            ids = b.column("chunk_id").to_numpy(zero_copy_only=False)
            for q, top in zip((s.value for s in shared), best, strict=True):
                if x.shape[1] != q["vectors"].shape[1]:
                    raise ValueError(f"chunks have {x.shape[1]} dimensions, questions {q['vectors'].shape[1]}")
                step = max(k, _TILE // len(q["norms"]))
                found: tuple[list, list, list] = [], [], []
                for at in range(0, b.num_rows, step):
                    dist = distances(q, b.slice(at, step), x[at : at + step])
                    limit = top.kth if dist.shape[1] <= k else np.minimum(top.kth, np.partition(dist, k - 1, axis=1)[:, k - 1])
                    own, near = np.nonzero((dist <= limit[:, None]) & (dist < np.inf))
                    for held, new in zip(found, (own, dist[own, near], ids[at + near]), strict=True):
                        held.append(new)
                top.merge(*found)
        for q, top in zip((s.value for s in shared), best, strict=True):
            if top.ids is not None and len(top.own):
                yield pa.RecordBatch.from_arrays([q["ids"].take(pa.array(top.own)), pa.array(top.ids, kind), pa.array(top.distance)], names=["question_id", "chunk_id", "distance"])

    return scan


def _possible(rows: DataFrame, asked: pa.Table, scope: str, stamp: str) -> DataFrame:
    """Rows that some instant of the block may hold for: a filter the scan can take, exact for a single instant."""

    def between(lower: str, upper: str, at: str, text: str) -> Column:
        ends = pc.min_max(asked[at].cast(pa.timestamp("us")) if at == "known_at" else asked[at]).as_py()  # a zoned timestamp becomes UTC
        first, last = (F.expr(text.format(ends[x])) for x in ("min", "max"))
        return (F.col(lower) <= last) & (F.col(upper).isNull() | (F.col(upper) > first))

    if scope in ("as_of", "one_clock"):
        rows = rows.where(between("valid_from", "valid_to", "valid_at", "DATE '{}'"))
    if scope in ("as_of", "believed"):
        rows = rows.where(between("recorded_at", "recorded_until", "known_at", "TIMESTAMP_NTZ '{}'" if stamp == "timestamp_ntz" else "TIMESTAMP '{}+00:00'"))
    return rows.where(F.col("recorded_until").isNull()) if scope == "one_clock" else rows


def batch_nearest(chunks: DataFrame, questions: DataFrame, k: int = 5, scope: str = "as_of", block: int = 4096, resident: int = _RESIDENT) -> DataFrame:
    """``question_id, rank, chunk_id, distance``: the ``k`` nearest chunks of every question.

    ``questions`` has ``question_id, embedding, valid_at, known_at``.  They are broadcast in blocks
    of at most ``block``; one scan of the chunks multiplies all blocks with each Arrow batch, tile by
    tile, and a task returns ``k`` rows a question, however many batches it saw, which a window then
    merges.  Only where the vectors take more than ``resident`` bytes is there another scan for each
    such part of them.  The span of the questions' instants is pushed into the scan.  Null vectors
    are left out, and questions without an instant where the scope needs one; vectors of another
    size are an error; ties go to the smaller chunk_id.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    spark = chunks.sparkSession
    stamp = chunks.schema["recorded_at"].dataType.simpleString() if scope != "all" else "timestamp"
    clocks = [c for c in ("valid_from", "valid_to", "recorded_at", "recorded_until") if c in chunks.columns]
    rows = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding", *clocks)
    kinds = [f"{c} {t.dataType.simpleString()}" for c, t in (("question_id", questions.schema["question_id"]), ("chunk_id", rows.schema["chunk_id"]))]
    for c in _DATED[scope]:
        questions = questions.where(F.col(c).isNotNull())
    wanted = questions.where(F.col("embedding").isNotNull()).select("question_id", "embedding", *(c if c in questions.columns else F.lit(None).cast("date" if c == "valid_at" else stamp).alias(c) for c in ("valid_at", "known_at")))
    typed = wanted.select("question_id", doubles(F.col("embedding")).alias("embedding"), "valid_at", F.col("known_at").cast(stamp).alias("known_at"))
    out = None
    for t in _resident(typed, block, resident):
        shared = [spark.sparkContext.broadcast(_block(t.slice(at, block).combine_chunks())) for at in range(0, len(t), block)]
        found = _possible(rows, t, scope, stamp).mapInArrow(_scan(shared, scope, k), ", ".join([*kinds, "distance double"]))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], ", ".join([kinds[0], "rank int", kinds[1], "distance double"]))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("distance", "chunk_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "distance")


def batch_nearest_once(chunks: DataFrame, questions: DataFrame, k: int = 5, scope: str = "as_of") -> DataFrame:
    """``batch_nearest``, with questions of one vector, and of the same instants where the scope has them, searched as one.

    The scan grows with the *different* questions; each question then gets the rows found for its
    like, so the result is the same, row by row.  ``question_id`` must be unique.
    """
    asked = questions.where(F.col("embedding").isNotNull())
    alike = ["embedding", *_DATED[scope]]
    first = asked.groupBy(*alike).agg(F.min("question_id").alias("question_id"))
    found = batch_nearest(chunks, first, k, scope).withColumnRenamed("question_id", "_first")
    named = first.select(F.col("question_id").alias("_of"), *(F.col(c).alias(f"_{c}") for c in alike))
    same = asked.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]).select("question_id", "_of")
    return same.join(found, F.col("_of").eqNullSafe(F.col("_first"))).select("question_id", "rank", "chunk_id", "distance")


def _resident(questions: DataFrame, block: int, resident: int) -> Iterator[pa.Table]:
    """The questions, sorted by id, in parts whose vectors take at most ``resident`` bytes; a first job tells how many there are."""
    first = questions.limit(block + 1).toArrow()
    if not len(first):
        return
    most = max(1, resident // max(1, 8 * len(first["embedding"][0])))
    if len(first) <= min(block, most):
        yield first.sort_by("question_id")
        return
    parts = -(-questions.count() // most)
    if parts == 1:
        yield questions.toArrow().sort_by("question_id")
        return
    parts *= 2  # half full on average: hashing is uneven
    for k in range(parts):
        t = questions.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == k).orderBy("question_id").toArrow()
        if len(t):
            yield t


def _block(t: pa.Table) -> dict:
    vectors = _matrix(t["embedding"].chunk(0))
    return {"ids": t["question_id"].chunk(0), "vectors": vectors, "norms": np.sqrt((vectors * vectors).sum(axis=1)), "days": _days(t["valid_at"].chunk(0), 0), "moments": _days(t["known_at"].chunk(0), 0)}


def _extremes(shared: list[Broadcast]):
    """A task's two best, worst and count of similarities of each question within its section."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [np.tile(np.array([[-np.inf], [-np.inf], [np.inf], [0.0]]), len(s.value["norms"])) for s in shared]
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("embedding"))
            coded = b.column("section_key").dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for c, section in enumerate(coded.dictionary.to_pylist()):
                rows = x[code == c]
                for q, top in zip((s.value for s in shared), state, strict=True):
                    at = q["of"].get(section)
                    if at is None:
                        continue
                    if rows.shape[1] != q["vectors"].shape[1]:
                        raise ValueError(f"chunks have {rows.shape[1]} dimensions, questions {q['vectors'].shape[1]}")
                    step = max(2, _TILE // len(at))
                    for part in (rows[k : k + step] for k in range(0, len(rows), step)):
                        size = q["norms"][at][:, None] * np.sqrt((part * part).sum(axis=1))[None, :]
                        cos = np.divide(q["vectors"][at] @ part.T, size, out=np.zeros_like(size), where=size > 0)
                        near = 1 - np.round(1 - cos, 6)
                        both = np.concatenate([top[:2, at].T, near if near.shape[1] < 3 else np.partition(near, -2, axis=1)[:, -2:]], axis=1)
                        top[:2, at] = np.sort(both, axis=1)[:, :-3:-1].T
                        top[2, at] = np.minimum(top[2, at], near.min(axis=1))
                        top[3, at] += near.shape[1]
        for q, top in zip((s.value for s in shared), state, strict=True):
            seen = np.flatnonzero(top[3] > 0)
            best = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1) * 2, pa.int32()), pa.array(top[:2, seen].T.ravel()))
            place = pa.array(seen)
            yield pa.RecordBatch.from_arrays([q["ids"].take(place), q["sections"].take(place), best, pa.array(top[2, seen]), pa.array(top[3, seen].astype(np.int64))], names=["question_id", "section_key", "best", "worst", "n"])

    return scan


def section_extremes(chunks: DataFrame, questions: DataFrame, block: int = 4096, resident: int = _RESIDENT) -> DataFrame:
    """``question_id, section_key, best, second, worst, versions``: a question's similarities within its own section.

    ``questions(question_id, section_key, embedding)`` are broadcast as in ``batch_nearest``; a scan
    multiplies the chunks of each section with the questions about it and keeps four numbers a
    question, so what a task returns grows with the questions and not with the pairs.  ``second`` is
    null for a section of one chunk; a question whose section has no chunk gets no row; null sections
    and vectors are left out.
    """
    spark = chunks.sparkSession
    rows = chunks.where("embedding is not null and section_key is not null").select(F.col("section_key").cast("string").alias("section_key"), "embedding")
    asked = questions.where("embedding is not null and section_key is not null").select("question_id", F.col("section_key").cast("string").alias("section_key"), doubles(F.col("embedding")).alias("embedding"))
    kind = questions.schema["question_id"].dataType.simpleString()
    out = None
    for t in _resident(asked, block, resident):
        shared = []
        for part in (t.slice(at, block).combine_chunks() for at in range(0, len(t), block)):
            vectors, sections = _matrix(part["embedding"].chunk(0)), part["section_key"].chunk(0)
            of: dict = {}
            for k, section in enumerate(sections.to_pylist()):
                of.setdefault(section, []).append(k)
            shared.append(spark.sparkContext.broadcast({"ids": part["question_id"].chunk(0), "sections": sections, "vectors": vectors, "norms": np.sqrt((vectors * vectors).sum(axis=1)), "of": {s: np.array(k) for s, k in of.items()}}))
        found = rows.mapInArrow(_extremes(shared), f"question_id {kind}, section_key string, best array<double>, worst double, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"question_id {kind}, section_key string, best double, second double, worst double, versions long")
    merged = out.groupBy("question_id", "section_key").agg(F.sort_array(F.flatten(F.collect_list("best")), asc=False).alias("best"), F.min("worst").alias("worst"), F.sum("n").alias("versions"))  # two numbers a task
    second = F.when(F.col("versions") > 1, F.get("best", 1))
    return merged.select("question_id", "section_key", F.get("best", 0).alias("best"), second.alias("second"), "worst", "versions")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        x = _matrix(b.column("embedding"))
        coded = b.column("section_key").dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for c, section in enumerate(coded.dictionary.to_pylist()):
            own = x[code == c]
            n, s = total.get(section, (0, 0.0))
            total[section] = n + len(own), s + own.sum(axis=0)
    if total:
        vectors = [s for _, s in total.values()]
        if len({len(v) for v in vectors}) > 1:
            raise ValueError("vectors have several sizes")
        offsets = pa.array(np.arange(len(vectors) + 1) * len(vectors[0]), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([n for n, _ in total.values()]), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(vectors)))], names=["section_key", "n", "total"])


def centroids_by_section(chunks: DataFrame) -> DataFrame:
    """``section_key, centroid``: the mean vector of each section.

    A task adds up whole vectors and returns one sum a section, which a second stage adds up again:
    no row a coordinate is made.  Null sections and vectors are left out.
    """
    rows = chunks.where("embedding is not null and section_key is not null").select(F.col("section_key").cast("string").alias("section_key"), "embedding")
    partial = rows.mapInArrow(_sums, "section_key string, n long, total array<double>")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for b in batches:
            for section, n, total in zip(b.column("section_key").to_pylist(), b.column("n").to_pylist(), b.column("total"), strict=True):
                had, s = found.get(section, (0, 0.0))
                found[section] = had + n, s + np.asarray(total.values)
        means = [s / n for n, s in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(means, pa.list_(pa.float64()))], names=["section_key", "centroid"])

    return partial.repartition("section_key").mapInArrow(merged, "section_key string, centroid array<double>")
