"""Audit of how the sources of a language diverge in their words (op13).

Counting and pair sums are SQL that DuckDB runs inside tasks, over shards by hash of language and
term; Spark shuffles the shards, adds up what they return and ranks it.  All arithmetic is on
integers, so neither the shards nor their number show in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, kept

#: A term is a run of letters A-Z, a-z and characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTS = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
_FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

# each (document, term) once, then by source; the empty term marks that the source occurs
_COUNT_CHUNK = f"""
INSERT INTO partial
WITH docs AS (SELECT row_number() OVER () AS doc, lang, source, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM chunk),
each AS (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM each GROUP BY ALL
UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM docs"""

_MERGE = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM partial GROUP BY ALL"

_COUNT_SHARD = """
SELECT shard, lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AND term <> '')::BIGINT AS first
FROM (SELECT shard, lang, source, term, sum(n)::BIGINT AS n, sum(sum(docs)) OVER (PARTITION BY lang, term) AS docs FROM rows GROUP BY shard, lang, source, term)
WHERE docs >= {least} OR term = ''"""

_NUMBER_SHARD = """
CREATE TABLE groups AS SELECT *, row_number() OVER () AS g FROM totals;
CREATE TABLE terms AS SELECT lang, term, sum(n) AS n, row_number() OVER () AS t, count(*) OVER (PARTITION BY lang) AS in_lang FROM counts GROUP BY lang, term;
CREATE TABLE cells AS SELECT t, g, c.n FROM counts c JOIN terms USING (lang, term) JOIN groups USING (lang, source)"""

_SHARE = "(1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * kept))::BIGINT"
_GAP = "((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)"

# all sources of a term's language, those without it too
_PAIRS_SLICE = f"""
WITH slice AS (SELECT t, lang FROM terms WHERE t > {{start}} AND t <= {{stop}}),
dense AS (SELECT s.t, r.g, {_SHARE.format(n="coalesce(c.n, 0)", total="total")} AS p FROM slice s JOIN groups r ON s.lang = r.lang LEFT JOIN cells c ON c.t = s.t AND c.g = r.g)
SELECT a.g AS a, b.g AS b, sum({_GAP})::BIGINT AS value FROM dense a JOIN dense b ON a.t = b.t AND a.g < b.g GROUP BY a.g, b.g"""

_PAIRS = "SELECT 'pair' AS part, x.lang, x.source, y.source AS item, sum(value)::BIGINT AS value FROM sums JOIN groups x ON x.g = a JOIN groups y ON y.g = b GROUP BY ALL"

_TERMS = f"""
WITH shares AS (SELECT g, term, {_SHARE.format(n="c.n", total="total")} AS p, {_SHARE.format(n="t.n", total="lang_total")} AS q FROM cells c JOIN terms t USING (t) JOIN groups USING (g) WHERE c.n > 0),
above AS (SELECT a.g, a.term, ((a.p - a.q) * (a.p - a.q)) // (a.p + a.q) AS value FROM shares a WHERE a.p > a.q),
top AS (SELECT * FROM above QUALIFY row_number() OVER (PARTITION BY g ORDER BY value DESC, term) <= {{ranks}})
SELECT 'term' AS part, lang, source, term AS item, value FROM top JOIN groups USING (g)"""


def _connect() -> duckdb.DuckDBPyConnection:
    """An own database in memory, one thread, nothing written to local disk."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _count(chunk_bytes: int, partial_rows: int):
    """Partial counts of a task's documents, merged until ``partial_rows`` are held."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            for start in range(0, b.num_rows, 64):  # a batch of long texts is cut too
                piece = b.slice(start, 64)
                held.append(piece)
                size += piece.nbytes
                if size >= chunk_bytes:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        empty = "CREATE OR REPLACE TABLE partial (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)"
        con.execute(empty)
        rows = 0
        for chunk in chunks(batches):
            con.register("chunk", chunk)
            rows += con.execute(_COUNT_CHUNK).fetchall()[0][0]
            con.unregister("chunk")
            if rows > partial_rows:
                con.execute(f"CREATE OR REPLACE TABLE partial AS {_MERGE}")
                rows = con.execute("SELECT count(*) FROM partial").fetchall()[0][0]
                if rows > partial_rows // 2:
                    yield from con.sql("FROM partial").to_arrow_table().cast(_PARTIAL).to_batches(50_000)
                    con.execute(empty)
                    rows = 0
        yield from con.sql(_MERGE).to_arrow_table().cast(_PARTIAL).to_batches(50_000)
        con.close()

    return run


def _count_shards(least: int):
    """Counts of the terms that enough documents of their language hold; a task reads its shards as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        con = _connect()
        con.register("rows", pa.RecordBatchReader.from_batches(first.schema, _chain(first, batches)))
        yield from con.sql(_COUNT_SHARD.format(least=int(least))).to_arrow_table().cast(_COUNTS).to_batches(50_000)
        con.close()

    return run


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _compare(ranks: int, cells: int):
    """Partial pair sums of a shard and its best terms, slices of terms at a time."""

    def run(counts: pa.Table, totals: pa.Table) -> pa.Table:
        if not counts.num_rows:
            return _FOUND.empty_table()
        con = _connect()
        con.register("counts", counts)
        con.register("totals", totals)
        con.execute(_NUMBER_SHARD)
        n, widest = con.execute("SELECT (SELECT count(*) FROM terms), (SELECT max(n) FROM (SELECT count(*) AS n FROM groups GROUP BY lang))").fetchall()[0]
        con.execute("CREATE TABLE sums (a BIGINT, b BIGINT, value BIGINT)")
        step = max(1, cells // widest)
        for start in range(0, n, step):
            con.execute("INSERT INTO sums " + _PAIRS_SLICE.format(start=start, stop=start + step))
        found = [con.sql(sql).to_arrow_table().cast(_FOUND) for sql in (_PAIRS, _TERMS.format(ranks=int(ranks)))]
        con.close()
        return pa.concat_tables(found)

    return run


def term_counts(docs: DataFrame, least: int = 10, *, chunk_bytes: int = 16 << 20, partial_rows: int = 1_500_000, shard_rows: int = 400_000) -> DataFrame:
    """``shard, lang, source, term, n, first``: occurrences of every term that ``least`` documents of its language hold.

    Tasks count their documents by chunks; the partial counts are dealt by hash of (lang, term) to
    as many shards as keep a shard near ``shard_rows`` of them.  Every (lang, source) that occurs
    has a row with the empty term; ``first`` is 1 in one row of each (lang, term).
    """
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = kept(text.mapInArrow(_count(chunk_bytes, partial_rows), "lang string, source string, term string, n long, docs long"), "term-partials")
    shards = max(1, -(-partial.count() // shard_rows))
    placed = partial.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return kept(placed.mapInArrow(_count_shards(least), "shard int, lang string, source string, term string, n long, first long"), "term-counts")


def source_divergence(docs: DataFrame, least: int = 10, ranks: int = 10, *, cells: int = 1_000_000, **sizes: int) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of each language of ``docs(lang, source, text)`` lie apart.

    With count occurrences of a term, N of all kept terms and V kept terms, a term's share is
    ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` and two shares differ by ``floor((p - q)^2 / (p + q))``.
    Part ``pair``: item is another source of the language, value the sum over all kept terms (0
    without any), every rank.  Part ``term``: item is a kept term more frequent here than in the
    language, value its difference, ``ranks`` of them.  Rank 1 is the greatest value, ties by the
    item's bytes.

    Null text, lang and source are empty text; a source without terms is a group with zero counts;
    repeated rows count as often as they occur, each as a document; texts are counted whole; other
    columns are not looked at; an empty table gives an empty one.  A shard's memory is its own counts
    plus ``cells`` shares at a time, whatever the number of sources.
    """
    counts = term_counts(docs, least, **sizes)
    by_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    whole = Window.partitionBy("lang")
    totals = kept(by_source.select("lang", "source", "total", F.sum("firsts").over(whole).alias("kept"), F.sum("total").over(whole).alias("lang_total")), "term-totals")
    terms = counts.where("term <> ''").select("shard", "lang", "source", "term", "n")
    present = terms.select(F.col("shard").alias("of"), F.col("lang").alias("_lang")).distinct()
    beside = present.join(totals, F.col("_lang") == F.col("lang")).select("of", "lang", "source", "total", "kept", "lang_total")
    compared = terms.groupBy("shard").cogroup(beside.groupBy("of")).applyInArrow(_compare(ranks, cells), "part string, lang string, source string, item string, value long")
    found = kept(compared, "term-gaps")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    near = ranked("pair", pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long"))))
    top = ranked("term", found.where("part = 'term'")).where(F.col("rank") <= ranks)
    return near.unionByName(top)
