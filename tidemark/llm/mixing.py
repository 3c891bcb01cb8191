"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import kept, word_count


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2) -> DataFrame:
    """``(source, source_size, target)`` for every source of ``sizes(source, size)``.

    Sources by code point, null last, take ``weights`` in turn.  Together they get ``share`` times
    all sizes; no target exceeds ``epochs`` times its source, and the excess is reshared by weight.
    Resharing until none is above is water-filling: target = min(cap, level * weight), and the
    level is the first that fits when sources are taken in order of cap over weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    one = by_source.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = one.withColumn("level", level)
    # the level that holds is the one of the first source whose cap is not below it
    fits = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy())["level"]
    return filled.withColumn("fits", fits).select("source", "source_size", F.least("cap", F.coalesce(F.col("fits") * F.col("weight"), F.col("cap"))).alias("target"))


def range_digits(rows: int, range_rows: int) -> int:
    """Hex digits of a key prefix so that ``rows`` uniform keys put about ``range_rows`` under each; at least three."""
    digits = 3
    while rows > range_rows * 16**digits:
        digits += 1
    return digits


def mix(docs: DataFrame, size: Column | None = None, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2, seed: str = "mix", digits: int | None = None, range_rows: int = 50_000, whole: bool = False) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: the words the mix takes of each document.

    Documents of a source are ordered by a hash-random key, ``md5(doc_id:seed)``.  Key prefixes of
    ``digits`` hex digits are its range partitions: a source's keys are uniform, so even a hot
    source spreads over ``16 ** digits`` groups.  Unless given, ``digits`` follows the counted rows:
    one source with all of them would have ranges of about ``range_rows`` rows; three at least.
    The rows are the same for any ``digits``.  Sums of the groups give each its offset, a window
    inside the group gives the document's prefix sum, and the source's budget ``floor(target)`` is
    cut exactly there: full epochs first, then the documents before the cut once more, the one at
    the cut in part.  Reruns agree, as nothing depends on the partitioning.

    With ``whole``, every column of ``docs`` is returned too, the four computed ones put in place of
    columns of their names; texts are then shuffled once, to the document's range partition.

    Null source is a source of its own.  Null text has size 0 and takes 0.  Repeated doc_ids are
    ordered by size, then text, and share a key; equal rows are interchangeable.  An empty table gives an empty one.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "size", "source_size", "target", "taken")] if whole else []
    wide = docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *([F.struct(*rest).alias("rest")] if rest else []))
    sized = wide if whole else kept(wide, "sizes")
    if digits is None:
        digits = range_digits((docs if whole else sized).count(), range_rows)
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = kept(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "bucket-sizes")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    targets = source_targets(sums.select("source", F.col("bucket_size").alias("size")), weights, share, epochs)
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "bucket", "offset", "source_size", "target")
    inside = Window.partitionBy("s.source", "s.bucket").orderBy("key", "doc_id", "size", *([F.xxhash64(F.col("rest.text"))] if "text" in rest else [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.alias("s")
        .join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.bucket") == F.col("p.bucket")))
        .select("doc_id", "s.source", *(["rest"] if rest else []), "size", "source_size", "target", (F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"))
    )
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("start")))
    return placed.select("doc_id", "source", *(F.col("rest")[c].alias(c) for c in rest), "size", "source_size", "target", (full * F.col("size") + part).cast("long").alias("taken"))
