"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_text, discard, kept
from tidemark.llm.components import connected_components


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words, space-joined; fewer words give one shorter run."""
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) if len(words) >= width else [b" ".join(words)]


def fingerprint(raw: bytes, width: int, seed: int = 42, distinct: bool = False) -> bytes:
    """64-bit SimHash of a UTF-8 text as 8 big-endian bytes; no words give zero.

    ``distinct`` counts each shingle once.
    """
    words = raw.lower().split()
    if not words:
        return bytes(8)
    runs = shingles(words, width)
    runs = set(runs) if distinct else runs
    digests = b"".join(map(xxhash.xxh64_digest, runs, repeat(seed)))
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b"".join(fingerprint(x.as_py(), width, seed) for x in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text")).mapInArrow(each, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of every choice of ``blocks - distance`` of ``blocks`` bit blocks, as signed longs.

    Two fingerprints that differ in at most ``distance`` bits agree on all bits of some mask.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(parts, blocks - distance))]


def blocks_for(n: int, distance: int, members: int = 32) -> int:
    """Fewest blocks whose keys are long enough that ``n`` random fingerprints put about ``members`` under one.

    At distance 4 that is 15 keys a fingerprint up to 2**25 of them, 35 up to 2**31 and 70 up to 2**36.
    """
    m = distance + 2
    while m < 2 * distance and 64 * (m - distance) // m < n.bit_length() - members.bit_length() + 1:
        m += 1
    return m


def _forest(distance: int):
    """Group function: spanning links among a group's fingerprints, at most one a fingerprint."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        left = np.unique(pdf["fp"].to_numpy(np.int64))
        out: list[np.ndarray] = []
        queue: list[int] = []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            x = queue.pop()
            near = np.bitwise_count((left ^ np.int64(x)).view(np.uint64)) <= distance
            if near.any():
                out.append(np.column_stack([np.full(near.sum(), x, np.int64), left[near]]))
                queue += left[near].tolist()
                left = left[~near]
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 2), np.int64), columns=["u", "v"])

    return of


def links(distinct: DataFrame, distance: int, *, blocks: int | None = None, pairs_up_to: int = 64, chunk: int = 4096) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the fingerprints within ``distance`` bits of each other.

    A block with few members is joined with itself and the distance is verified in the join.  A
    larger block is cut by hash into chunks; each pair of chunks is one bounded group that returns
    only spanning links, so no block ever emits its pairs and no link between groups is lost.
    """
    masks = block_masks(blocks or blocks_for(distinct.count(), distance), distance)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "key"))
    # what is joined to hot keys is written first: then both sides shuffle anew and AQE can split them
    sizes = kept(keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = kept(keyed.join(sizes, ["c", "key"]), "blocks")
    few = shared.where(F.col("n") <= pairs_up_to).select("c", "key", "fp")
    diff = F.col("u").bitwiseXOR(F.col("v"))
    earlier = F.slice(F.array(*[F.lit(m) for m in masks]), F.lit(1), F.col("c"))
    pairs = (
        few.withColumnRenamed("fp", "u")
        .join(few.withColumnRenamed("fp", "v"), ["c", "key"])
        .where((F.col("u") < F.col("v")) & (F.bit_count(diff) <= distance))
        .where(F.forall(earlier, lambda m: diff.bitwiseAND(m) != 0))
        .select("u", "v")
    )
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    many = (
        shared.where(F.col("n") > pairs_up_to)
        .select("c", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("c", "key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    return pairs.unionByName(many.groupBy("c", "key", "lo", "hi").applyInPandas(_forest(distance), "u long, v long"))


def near_duplicates(docs: DataFrame, *, width: int = 5, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row a document: ``doc_id, fp, fingerprint, component_id``.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest doc_id reachable over links
    of at most ``distance`` differing bits, the document itself included.  Copies share a
    fingerprint and are one node; they are never expanded into pairs.

    Null and empty texts have fingerprint zero and link like any other.  A null doc_id is ignored
    when the smallest is taken.  Repeated rows give repeated rows.  An empty table gives an empty one.
    """
    rows = kept(fingerprints(docs, width, seed), "fingerprints")
    nodes = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    named = connected_components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp").join(nodes, "fp")
    groups = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = named.select("fp", "root").join(groups, "root").select("fp", "component")
    whole = kept(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "components")
    return rows.join(whole, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, hash of the row, two SimHashes of the distinct words, hash of the lower-cased words, bytes."""
    for b in batches:
        raw = [x.as_py().lower() for x in b.column(2)]
        longs = lambda parts: pa.array(np.frombuffer(b"".join(parts), ">i8").astype(np.int64))
        fps = [longs(fingerprint(x, 1, seed, distinct=True) for x in raw) for seed in (42, 43)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *fps, longs(xxhash.xxh64_digest(b" ".join(x.split()), 7) for x in raw), pa.array([len(x) for x in raw], pa.int64())], names=["doc_id", "row", "fp1", "fp2", "words", "bytes"])


def _proposed(texts: DataFrame, name: str, distance: int) -> DataFrame:
    """Links ``(u, v)`` between nodes of ``texts(node, name)`` whose fingerprints in ``name`` are equal or close."""
    least = kept(texts.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("least")), "fps")
    near = links(least.select("fp"), distance, blocks=blocks_for(least.count(), distance))
    at = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_least"))
    equal = texts.select("node", F.col(name).alias("fp")).join(least, "fp").where(F.col("node") != F.col("least"))
    return near.join(at("u"), "u").join(at("v"), "v").select(F.col("u_least").alias("u"), F.col("v_least").alias("v")).unionByName(equal.select(F.col("node").alias("u"), F.col("least").alias("v")))


def _similar(width: int, similarity: float):
    """Group function: spanning links among texts whose shingle sets have that Jaccard similarity.

    A text that was reached is compared with those not reached yet, through an index of their
    shingles; copies of one original are reached at once and never compared with each other.
    """

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        sets = [np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingles(t.lower().split(), width)], np.uint64)) for t in pdf["text"]]
        nodes, sizes = pdf["node"].to_numpy(np.int64), np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        left, out, queue = np.ones(len(sets), bool), [], []
        while queue or left.any():
            if not queue:
                queue = [int(np.argmax(left))]
                left[queue[0]] = False
            x = queue.pop()
            if 2 * left.sum() < len(np.unique(owner)):  # index only those that are left
                own = left[owner]
                every, owner = every[own], owner[own]
            lo, hi = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
            at = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())
            common = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero(left & (common >= similarity * (sizes + sizes[x] - common) - 1e-9))
            left[near] = False
            queue += near.tolist()
            out.append(np.column_stack([np.full(len(near), nodes[x]), nodes[near]]))
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 2), np.int64), columns=["u", "v"])

    return of


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles as signed longs, ascending; no words give none."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.int64)
    each = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    n = max(1, len(words) - width + 1)
    run = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        run = (run ^ each[k : k + n]) * _MULT[k % len(_MULT)]
        run ^= run >> np.uint64(29)
    return np.unique(run.view(np.int64))


def _frequent(texts: DataFrame, n: int, width: int, share: int = 8, entries: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur often in a sample of ``texts(row, text)``, ascending, and how often.

    They only order the shingles: a sample that misses one costs time and changes no result.  From
    ``8192 * share`` texts on, one in ``share`` is read, so what counts as frequent is the same at any size.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_shingle_hashes(x.as_py(), width) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], names=["s"])

    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(max(1, min(share, n // 8192)))) == 0).select("text")
    counted = sample.mapInArrow(each, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(entries).toArrow()
    s, times = counted["s"].to_numpy(), counted["n"].to_numpy()
    order = np.argsort(s)
    return s[order], times[order]


#: Bits of the short map that travels with every prefix row, and the sizes for which it can tell sets apart.
_SHORT, _SHORT_SIZES = 256, 640
_MAPS = [f"m{k}" for k in range(_SHORT // 64)]


def _parity(own: np.ndarray) -> np.ndarray:
    """Parity map of a set of hashes as bytes: a bit says whether an odd number of them falls there.

    Two maps differ in at most as many bits as the sets have members that are not in both.  There
    are four bits a member or more, a power of two, so that a longer map folds to a shorter one.
    """
    bits = max(_SHORT, 1 << (4 * len(own) - 1).bit_length())
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8))


def _folded(parity: np.ndarray, size: int) -> np.ndarray:
    """The parity map of the same set in ``size`` bytes."""
    return np.bitwise_xor.reduce(parity.reshape(-1, size), axis=0)


def _apart(u: bytes, v: bytes) -> int:
    """Least number of members in which the sets of two parity maps differ."""
    size = min(len(u), len(v))
    x, y = (_folded(np.frombuffer(m, np.uint8), size) for m in (u, v))
    return int(np.bitwise_count(x ^ y).sum())


def _unlike(similarity: float) -> float:
    """Largest share of the members of two sets, both sizes added, that may be in one set only."""
    return (1 - similarity) / (1 + similarity)


def _prefixes(width: int, similarity: float, frequent):
    """Arrow function: the rarest shingles of each text, as many as any similar text must share one of.

    Every row has the short parity map of the text's set (zeros where the set is too large for it),
    the row of rank 0 the whole map.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        for b in batches:
            parts, maps = [], []
            for x in b.column(2):
                own = _shingle_hashes(x.as_py(), width)
                often = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    often = np.where(known[at] == own, times[at], 0)
                n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                parts.append((len(own), own[np.argsort(often, kind="stable")[:n]]))
                maps.append(_parity(own))
            lengths = np.array([len(p) for _, p in parts], np.int64)
            sizes = np.array([n for n, _ in parts], np.int32)
            rank = np.concatenate([*map(np.arange, lengths), np.empty(0, np.int64)]).astype(np.int32)
            short = np.concatenate([*(_folded(m, _SHORT // 8) for m in maps), np.empty(0, np.uint8)]).view(np.int64).reshape(len(maps), len(_MAPS))
            short = np.where((sizes < _SHORT_SIZES)[:, None], short, 0)
            again = lambda c: pa.array(np.repeat(c, lengths))
            whole = pa.array([m.tobytes() for m in maps], pa.binary()).take(pa.array(np.repeat(np.arange(len(maps)), lengths), mask=rank > 0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*(p for _, p in parts), np.empty(0, np.int64)])), again(b.column(0).to_numpy()), again(b.column(1).to_numpy()),
                    again(sizes), pa.array(rank), *(again(short[:, k]) for k in range(len(_MAPS))), whole,
                ],
                names=["s", "node", "group", "size", "rank", *_MAPS, "parity"],
            )

    return of


def _crossing(similarity: float):
    """Group function: pairs of different groups among the texts with one shingle that sizes, ranks and short maps allow."""
    share = similarity / (1 + similarity)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("size")
        node, group, size, rest = (pdf[c].to_numpy(np.int64) for c in ("node", "group", "size", "rest"))
        maps = pdf[_MAPS].to_numpy(np.int64).view(np.uint64)
        out = [np.empty((0, 2), np.int64)]
        ends = np.searchsorted(size, size / similarity + 1e-6, "right")
        for i, end in enumerate(ends):
            near = i + 1 + np.flatnonzero((group[i + 1 : end] != group[i]) & (np.minimum(rest[i], rest[i + 1 : end]) >= share * (size[i] + size[i + 1 : end]) - 1e-6))
            apart = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1)
            near = near[(size[near] >= _SHORT_SIZES) | (apart <= _unlike(similarity) * (size[i] + size[near]) + 1e-6)]
            out.append(np.column_stack([np.minimum(node[i], node[near]), np.maximum(node[i], node[near])]))
        return pd.DataFrame(np.concatenate(out), columns=["u", "v"])

    return of


def _possible(similarity: float):
    """Arrow function: the pairs of ``(u, v, u_parity, v_parity, both)`` whose whole parity maps allow the similarity."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parity = zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True)
            right = [_apart(x.as_py(), y.as_py()) <= _unlike(similarity) * both + 1e-6 for x, y, both in parity]
            yield b.select(["u", "v"]).filter(pa.array(right, pa.bool_()))

    return of


def _verified(width: int, similarity: float):
    """Arrow function: the pairs of ``(u, v, u_text, v_text)`` whose shingle sets have that Jaccard similarity."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = _shingle_hashes(x.as_py(), width), _shingle_hashes(y.as_py(), width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                right.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield b.select(["u", "v"]).filter(pa.array(right, pa.bool_()))

    return of


def _remaining(whole: DataFrame, named: DataFrame, *, width: int, similarity: float, pairs_up_to: int = 64, chunk: int = 4096) -> DataFrame:
    """Links ``(u, v)`` between different groups of ``named(node, row, group)``: all similar pairs across groups.

    Two similar texts share one of the first ``n - ceil(similarity * n) + 1`` of their ``n`` shingles
    in any order common to all; here the rarest come first.  Texts with a shingle in common are
    paired if they are of different groups and sizes, ranks and short parity maps allow the
    similarity.  Maps are bounds, never estimates: no similar pair is lost.  The whole maps, far
    shorter than texts, are compared next, and every pair still left is compared on its texts.
    """
    texts = whole.select("row", "text")
    frequent = whole.sparkSession.sparkContext.broadcast(_frequent(texts, named.count(), width))
    nodes = texts.dropDuplicates(["row"]).join(named, "row").select("node", "group", "text")
    placed = kept(nodes.mapInArrow(_prefixes(width, similarity, frequent), f"s long, node long, group long, size int, rank int, {', '.join(f'{m} long' for m in _MAPS)}, parity binary"), "prefixes")
    parity = kept(placed.where("rank = 0").select("node", "size", "parity"), "parity")
    sizes = kept(placed.groupBy("s").agg(F.count("*").alias("n"), F.min("group").alias("a"), F.max("group").alias("b")).where("a != b").select("s", "n"), "sizes")
    shared = kept(placed.join(sizes, "s").select("s", "n", "node", "group", "size", (F.col("size") - F.col("rank")).alias("rest"), *_MAPS), "shared")
    discard(placed, sizes)
    few = shared.where(F.col("n") <= pairs_up_to)
    side = lambda c: few.select("s", *(F.col(x).alias(f"{c}_{x}") for x in ("node", "group", "size", "rest", *_MAPS)))
    apart = sum((F.bit_count(F.col(f"u_{m}").bitwiseXOR(F.col(f"v_{m}"))) for m in _MAPS), F.lit(0))
    both = F.col("u_size") + F.col("v_size")
    pairs = (
        side("u").join(side("v"), "s")
        .where((F.col("u_node") < F.col("v_node")) & (F.col("u_group") != F.col("v_group")))
        .where(F.least("u_size", "v_size") >= similarity * F.greatest("u_size", "v_size") - 1e-6)
        .where(F.least("u_rest", "v_rest") >= similarity / (1 + similarity) * both - 1e-6)
        .where((F.greatest("u_size", "v_size") >= _SHORT_SIZES) | (apart <= _unlike(similarity) * both + 1e-6))
        .select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    )
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    many = (
        shared.where(F.col("n") > pairs_up_to)
        .withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), parts - 1))})
        .select("s", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "group", "size", "rest", *_MAPS)
    )
    crossing = kept(pairs.unionByName(many.groupBy("s", "lo", "hi").applyInPandas(_crossing(similarity), "u long, v long")).distinct(), "crossing")
    discard(shared)
    at = lambda c: parity.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_parity"))
    mapped = crossing.join(at("u"), "u").join(at("v"), "v").select("u", "v", "u_parity", "v_parity", (F.col("u_size") + F.col("v_size")).alias("both"))
    asked = kept(mapped.mapInArrow(_possible(similarity), "u long, v long"), "asked")
    discard(crossing, parity)
    wanted = named.join(asked.select(F.col("u").alias("node")).unionByName(asked.select(F.col("v").alias("node"))).distinct(), "node").select("row", "node")
    read = kept(texts.join(wanted, "row").dropDuplicates(["node"]).select("node", "text"), "read")
    at = lambda c: read.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    return asked.join(at("u"), "u").join(at("v"), "v").select("u", "v", "u_text", "v_text").mapInArrow(_verified(width, similarity), "u long, v long")


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, distance: int = 6, chunk: int = 2048, chunk_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the smallest doc_id stays.

    Two texts are near duplicates when their sets of ``width``-word shingles, A-Z lower-cased, have
    a Jaccard similarity of ``similarity`` or more; groups are the connected components.  Two
    SimHash fingerprints of the distinct words propose: texts within ``distance`` bits in either
    meet in a block.  (Fingerprints of longer shingles would differ in up to 17 bits at that
    similarity, too many for blocks.)  Each component of proposals is then checked exactly on its
    texts' shingles, in chunks of ``chunk`` texts, pair of chunks by pair of chunks, so a large
    group meets in bounded tasks.  What the fingerprints miss, such as appended, cut or replaced
    passages, is found by a prefix-filter join on the rarest shingles across the groups so far.

    Equal texts are one node and never expanded.  Null and empty texts are copies of each other.  A
    null doc_id counts as the largest.  Of repeated rows one stays; rows that share doc_id and text
    but differ elsewhere count as repeated, and the one with the least hash of all its columns (maps
    left out) stays.  An empty table gives an empty one.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), binary_text().alias("text"))
    rows = whole.mapInArrow(_digests, "doc_id long, row long, fp1 long, fp2 long, words long, bytes long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    texts = kept(rows.groupBy("fp1", "fp2", "words").agg(first, F.max("bytes").alias("bytes")), "digests")
    texts = kept(texts.select("fp1", "fp2", "least", "bytes", F.monotonically_increasing_id().alias("node")), "texts")
    proposed = connected_components(_proposed(texts, "fp1", distance).unionByName(_proposed(texts, "fp2", distance)))
    named = kept(texts.select("node", "least", "bytes").join(proposed, "node", "left").select("node", "least", "bytes", "root"), "named")
    sizes = kept(named.where("root is not null").groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "sizes")
    parts = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    asked = named.drop("bytes").join(sizes, "root").select("root", "node", F.col("least.row").alias("row"), own.alias("own"), parts.alias("parts"))
    meet = (
        whole.select("row", "text").join(asked, "row")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "text")
    )
    same = connected_components(meet.groupBy("root", "lo", "hi").applyInPandas(_similar(width, similarity), "u long, v long")).select("node", F.col("root").alias("group"))
    grouped = kept(named.join(same, "node", "left").withColumn("group", F.coalesce("group", "node")).select("node", "least", "group"), "grouped")
    links_left = kept(_remaining(whole, grouped.select("node", F.col("least.row").alias("row"), "group"), width=width, similarity=similarity), "links")
    at = lambda c: grouped.select(F.col("node").alias(c), F.col("group").alias(f"{c}_group"))
    between = links_left.join(at("u"), "u").join(at("v"), "v").select(F.col("u_group").alias("u"), F.col("v_group").alias("v"))
    merged = connected_components(between).select(F.col("node").alias("group"), F.col("root").alias("merged"))
    grouped = grouped.join(merged, "group", "left").withColumn("group", F.coalesce("merged", "group"))
    stay = grouped.groupBy("group").agg(F.min("least").alias("least")).select(F.col("least.row").alias("_row"), F.col("least.doc_id").alias("_id"))
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    picked = docs.select(F.xxhash64("doc_id", "text").alias("_row"), F.xxhash64(*plain).alias("_order"), F.struct("*").alias("_whole"))
    picked = picked.join(stay, (picked["_row"] == stay["_row"]) & F.col("_whole.doc_id").cast("long").eqNullSafe(F.col("_id"))).select(picked["_row"], "_id", "_order", "_whole")
    return picked.groupBy("_row", "_id").agg(F.min_by("_whole", "_order").alias("_whole")).select("_whole.*")
