"""Every query of the engine over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.clock import AsOf
from tidemark.functions import dates, fence
from tidemark.functions.vectors import literal, unit
from tidemark.operators import constraints, retrieval, scoring, temporal
from tidemark.operators.versions import KINDS, ingest_new, rebuild_versions
from tidemark.plans import ask as plan
from tidemark.plans import gate
from tidemark.plans.ingest import refolded, violations
from tidemark.plans.measure import exact, headline
from tidemark.plans.replay import replay
from tidemark.ship import ship
from tidemark.sources import derived
from tidemark.sources.corpus import clause_log, document_uid, parse_documents, published_index
from tidemark.sources.derived import table
from tidemark.sources.embedding import embed

AT = AsOf(date(2024, 1, 5), datetime(2024, 1, 10, tzinfo=UTC))
EARLY = AsOf(date(2024, 1, 3), datetime(2024, 1, 1, 8, tzinfo=UTC))
LATE = AsOf(date(2024, 1, 5), datetime(2024, 1, 25, tzinfo=UTC))
RECENT = AsOf(date(2024, 1, 28), datetime(2024, 2, 1, tzinfo=UTC))
NEVER = AsOf(date(2023, 6, 1), datetime(2023, 6, 1, tzinfo=UTC))
LAPSED = AsOf(date(2023, 6, 1), datetime(2024, 1, 25, tzinfo=UTC))
VECTOR_AT = AsOf(date(2025, 3, 1), datetime(2025, 6, 1, tzinfo=UTC))
PROBE = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Register a query and its SQL; ``days`` are columns of days, returned as ISO text by both."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir).withColumns({c: F.col(c).cast("string") for c in days})
        if sql is not None:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in days)}) FROM ({sql})" if days else sql
        return f

    return add


LOG_SQL = """
log AS (
  SELECT user_id::VARCHAR AS section_key, event_id AS n, event_id::VARCHAR AS document_id, ts AS recorded_at,
    CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1 THEN 'base' WHEN event_type = 'signup' THEN 'correction' ELSE 'amendment' END AS kind,
    ts::DATE + (event_id * 7 % 21 - 10)::INT AS start, event_type || ':' || event_id AS text
  FROM events),
clauses AS (
  SELECT section_key, document_id, recorded_at, kind, 0 AS clause_no, text, start AS valid_from, CASE WHEN kind = 'correction' THEN start + 10 END AS valid_to FROM log
  UNION ALL
  SELECT section_key, document_id, recorded_at, kind, 1, text || ':b', start + 10, CASE WHEN n % 3 = 0 THEN start + 20 END FROM log WHERE kind = 'correction')"""

VERSIONS_SQL = (
    LOG_SQL
    + """,
epochs AS (SELECT *, sum((kind = 'correction' AND clause_no = 0)::INT) OVER (PARTITION BY section_key ORDER BY recorded_at) AS epoch FROM clauses),
epoch_ends AS (SELECT section_key, epoch - 1 AS epoch, min(recorded_at) AS epoch_end FROM epochs WHERE kind = 'correction' GROUP BY ALL),
steps AS (
  SELECT section_key, document_id, clause_no, recorded_at AS t, NULL::DATE AS cut FROM epochs
  UNION ALL
  SELECT o.section_key, o.document_id, o.clause_no, a.recorded_at, a.valid_from FROM epochs o JOIN epochs a
    ON a.section_key = o.section_key AND a.epoch = o.epoch AND a.kind = 'amendment' AND a.recorded_at > o.recorded_at),
running AS (
  SELECT s.*, o.text, o.kind, o.valid_from, o.recorded_at AS origin, o.epoch,
    least(o.valid_to, min(s.cut) OVER (PARTITION BY s.section_key, s.document_id, s.clause_no ORDER BY s.t)) AS valid_to
  FROM steps s JOIN epochs o USING (section_key, document_id, clause_no)),
changed AS (
  SELECT *, lag(valid_to) OVER w AS before, row_number() OVER w AS nth FROM running WINDOW w AS (PARTITION BY section_key, document_id, clause_no ORDER BY t)),
spans AS (
  SELECT c.*, coalesce(lead(t) OVER (PARTITION BY c.section_key, c.document_id, c.clause_no ORDER BY t), e.epoch_end) AS recorded_until
  FROM changed c LEFT JOIN epoch_ends e USING (section_key, epoch)
  WHERE nth = 1 OR valid_to IS DISTINCT FROM before),
alive AS (SELECT *, t = origin AS fresh FROM spans WHERE valid_to IS NULL OR valid_to > valid_from),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY section_key ORDER BY t, fresh, CASE WHEN fresh THEN clause_no ELSE 0 END, valid_from)::INT AS version_no FROM alive),
replaced AS (
  SELECT n.section_key, n.version_no, arg_max(o.version_no, o.valid_from) AS old FROM numbered n JOIN numbered o
    ON o.section_key = n.section_key AND o.recorded_until = n.t AND o.valid_from <= n.valid_from
  WHERE n.fresh AND n.kind = 'amendment' GROUP BY ALL),
versions AS (
  SELECT n.section_key, n.version_no, text, valid_from, valid_to, t AS recorded_at, recorded_until, document_id,
    n.section_key || '@v' || r.old AS supersedes, n.section_key || '@v' || n.version_no AS version_id
  FROM numbered n LEFT JOIN replaced r USING (section_key, version_no))"""
)

CHUNKS_SQL = """
chunks AS (
  SELECT vec_id AS chunk_id, label::VARCHAR AS section_key, 'Clause ' || vec_id || ' of section ' || label || '. It holds for all.' AS text,
    DATE '2024-01-01' + (vec_id % 701)::INT AS valid_from,
    CASE WHEN vec_id % 20 < 11 THEN DATE '2024-01-01' + (vec_id % 701)::INT + (30 + vec_id % 471)::INT END AS valid_to,
    TIMESTAMP '2024-01-01' + to_days((vec_id * 13 % 701)::INT) AS recorded_at,
    CASE WHEN vec_id % 20 < 9 THEN TIMESTAMP '2024-01-01' + to_days((vec_id * 13 % 701)::INT) + to_days((30 + vec_id % 471)::INT) END AS recorded_until,
    embedding::DOUBLE[] AS v
  FROM embeddings),
asked AS (SELECT vec_id AS question_id, label::VARCHAR AS own, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"""

DISTANCE = "round(1 - list_cosine_similarity(v, {q}), 6) + 0.0"
HOLDS = "(valid_from <= DATE '{v}' AND (valid_to IS NULL OR valid_to > DATE '{v}'))"
KNOWN = "(recorded_at <= TIMESTAMP '{k}' AND (recorded_until IS NULL OR recorded_until > TIMESTAMP '{k}'))"


def holds_sql(at: AsOf) -> str:
    return HOLDS.format(v=at.valid_at)


def known_sql(at: AsOf) -> str:
    return KNOWN.format(k=at.known_utc)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_versions(derived.event_log(spark, sf_dir))


READ = ["section_key", "version_no", "text", "valid_from", "valid_to", "recorded_at"]


@query(f"WITH {VERSIONS_SQL} SELECT * FROM versions", days=("valid_from", "valid_to"))
def bt_rebuild_versions(spark, sf_dir):
    return versions(spark, sf_dir)


@query(f"WITH {VERSIONS_SQL} SELECT {', '.join(READ)} FROM versions WHERE {holds_sql(AT)} AND {known_sql(AT)}", days=("valid_from", "valid_to"))
def bt_asof_read(spark, sf_dir):
    return temporal.as_of(versions(spark, sf_dir), AT).select(*READ)


@query(f"WITH {VERSIONS_SQL} SELECT {', '.join(READ)} FROM versions WHERE {known_sql(AT)}", days=("valid_from", "valid_to"))
def bt_believed(spark, sf_dir):
    return temporal.believed(versions(spark, sf_dir), AT).select(*READ)


@query(f"WITH {VERSIONS_SQL} SELECT {', '.join(READ)} FROM versions WHERE recorded_until IS NULL AND {holds_sql(RECENT)}", days=("valid_from", "valid_to"))
def bt_one_clock(spark, sf_dir):
    return temporal.one_clock(versions(spark, sf_dir), RECENT).select(*READ)


@query(f"WITH {VERSIONS_SQL} SELECT {', '.join(READ)} FROM versions WHERE recorded_until IS NULL", days=("valid_from", "valid_to"))
def bt_current_belief(spark, sf_dir):
    return temporal.current_belief(versions(spark, sf_dir)).select(*READ)


def _requests(spark, sf_dir):
    section = temporal.sections(derived.event_documents(spark, sf_dir))
    probes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at.valid_at).alias("valid_at"), F.expr(f"TIMESTAMP_NTZ '{at.known_utc}'").alias("known_at")) for k, at in enumerate((EARLY, AT))])
    return section.select("section_key", F.explode(probes).alias("p")).select(F.concat_ws("/", "section_key", "p.k").alias("request_id"), "section_key", "p.valid_at", "p.known_at")


@query(f"""WITH {VERSIONS_SQL} SELECT v.version_id, o.version_id AS replaced, o.text AS replaced_text, o.valid_to AS replaced_valid_to, l.kind, l.recorded_at AS document_recorded_at
FROM versions v LEFT JOIN versions o ON o.version_id = v.supersedes JOIN log l ON l.document_id = v.document_id""", days=("replaced_valid_to",))
def bt_supersedes(spark, sf_dir):
    v = versions(spark, sf_dir)
    old = v.select(F.col("version_id").alias("replaced"), F.col("text").alias("replaced_text"), F.col("valid_to").alias("replaced_valid_to"))
    source = derived.event_documents(spark, sf_dir).select("document_id", "kind", F.col("recorded_at").alias("document_recorded_at"))
    joined = v.join(old, v["supersedes"] == old["replaced"], "left").join(source, "document_id")
    return joined.select("version_id", "replaced", "replaced_text", "replaced_valid_to", "kind", "document_recorded_at")


@query(f"""WITH {VERSIONS_SQL}, requests AS (SELECT section_key || '/' || k AS request_id, section_key, valid_at, known_at FROM (SELECT DISTINCT user_id::VARCHAR AS section_key FROM events),
  (VALUES (0, DATE '{EARLY.valid_at}', TIMESTAMP '{EARLY.known_utc}'), (1, DATE '{AT.valid_at}', TIMESTAMP '{AT.known_utc}')) p(k, valid_at, known_at)),
known AS (SELECT q.*, v.version_no, v.text, v.document_id, v.version_no IS NOT NULL AND v.valid_from <= q.valid_at AND (v.valid_to IS NULL OR v.valid_to > q.valid_at) AS force
  FROM requests q LEFT JOIN versions v ON v.section_key = q.section_key AND v.recorded_at <= q.known_at AND (v.recorded_until IS NULL OR v.recorded_until > q.known_at))
SELECT request_id, section_key, valid_at, known_at,
  CASE WHEN bool_or(force) THEN 'in-force' WHEN count(version_no) > 0 THEN 'no-rule-in-force' ELSE 'no-record' END AS outcome,
  coalesce(max(version_no) FILTER (force), 0) AS version_no, max(text) FILTER (force) AS text, max(document_id) FILTER (force) AS document_id
FROM known GROUP BY ALL""", days=("valid_at",))
def bt_read_outcomes(spark, sf_dir):
    return temporal.read_sections(_requests(spark, sf_dir), versions(spark, sf_dir)).withColumn("version_no", F.coalesce("version_no", F.lit(0)))


@query(f"WITH {VERSIONS_SQL} " + " UNION ALL ".join(f"""SELECT DATE '{at.valid_at}' AS valid_at, TIMESTAMP '{at.known_utc}' AS known_at,
  CASE WHEN bool_or({known_sql(at)} AND {holds_sql(at)}) THEN 'in-force' WHEN bool_or({known_sql(at)}) THEN 'no-rule-in-force' ELSE 'no-record' END AS outcome FROM versions""" for at in (EARLY, AT, NEVER, LAPSED)), days=("valid_at",))
def bt_coverage(spark, sf_dir):
    return temporal.coverage(versions(spark, sf_dir), [EARLY, AT, NEVER, LAPSED])


INSTANTS_SQL = "SELECT DISTINCT ts::DATE + (event_id * 11 % 61 - 30)::INT AS valid_at, ts + to_hours((event_id % 37 - 18)::INT) AS known_at FROM events"


@query(f"""WITH {VERSIONS_SQL}, instants AS ({INSTANTS_SQL}),
known AS (SELECT DISTINCT valid_at, known_at FROM instants JOIN versions ON recorded_at <= known_at AND coalesce(recorded_until, TIMESTAMP '9999-12-31') > known_at),
force AS (SELECT DISTINCT valid_at, known_at FROM instants JOIN versions ON recorded_at <= known_at AND coalesce(recorded_until, TIMESTAMP '9999-12-31') > known_at AND valid_from <= valid_at AND coalesce(valid_to, DATE '9999-12-31') > valid_at)
SELECT i.valid_at, i.known_at, CASE WHEN f.known_at IS NOT NULL THEN 'in-force' WHEN k.known_at IS NOT NULL THEN 'no-rule-in-force' ELSE 'no-record' END AS outcome
FROM instants i LEFT JOIN known k USING (valid_at, known_at) LEFT JOIN force f USING (valid_at, known_at)""", days=("valid_at",))
def bt_coverage_many(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.date_add(F.col("ts").cast("date"), (F.col("event_id") * 11 % 61 - 30).cast("int"))
    moment = F.timestamp_add("HOUR", (F.col("event_id") % 37 - 18).cast("int"), F.col("ts"))
    return temporal.coverage_of(versions(spark, sf_dir), e.select(day.alias("valid_at"), moment.alias("known_at")))


@query(f"WITH {VERSIONS_SQL} SELECT section_key, version_no, recorded_at, recorded_until, valid_from, valid_to, row_number() OVER (PARTITION BY section_key ORDER BY recorded_at, valid_from, version_no)::INT AS position FROM versions", days=("valid_from", "valid_to"))
def bt_history(spark, sf_dir):
    order = Window.partitionBy("section_key").orderBy("recorded_at", "valid_from", "version_no")
    return versions(spark, sf_dir).select("section_key", "version_no", "recorded_at", "recorded_until", "valid_from", "valid_to", F.row_number().over(order).alias("position"))


@query("SELECT DISTINCT user_id::VARCHAR AS section_key FROM events")
def bt_sections(spark, sf_dir):
    return temporal.sections(derived.event_documents(spark, sf_dir))


@query(f"WITH {VERSIONS_SQL} SELECT section_key, max(version_no)::INT + 1 AS next_version_no FROM versions GROUP BY section_key")
def bt_next_version(spark, sf_dir):
    return versions(spark, sf_dir).groupBy("section_key").agg((F.max("version_no") + 1).alias("next_version_no"))


@query(f"""WITH {VERSIONS_SQL} SELECT section_key, text, valid_from FROM versions WHERE {holds_sql(LATE)} AND {known_sql(LATE)}
EXCEPT ALL SELECT section_key, text, valid_from FROM versions WHERE {holds_sql(AT)} AND {known_sql(AT)}""", days=("valid_from",))
def bt_retroactive_diff(spark, sf_dir):
    return temporal.retroactive_changes(versions(spark, sf_dir), LATE, AT)


@query(f"WITH {VERSIONS_SQL} SELECT count(*) AS total, count(*) FILTER ({holds_sql(AT)} AND {known_sql(AT)}) AS matching, round(count(*) FILTER ({holds_sql(AT)} AND {known_sql(AT)}) / count(*), 6) AS selectivity FROM versions")
def bt_selectivity(spark, sf_dir):
    v = versions(spark, sf_dir)
    hit = temporal.holds(F.col("valid_from"), F.col("valid_to"), F.lit(AT.valid_at)) & temporal.holds(F.col("recorded_at"), F.col("recorded_until"), temporal.moment(AT, v))
    return v.agg(F.count("*").alias("total"), F.count_if(hit).alias("matching")).withColumn("selectivity", F.round(F.col("matching") / F.col("total"), 6))


def _with_faults(v: DataFrame) -> DataFrame:
    """Versions and, for each fifth current one, a copy recorded a second later."""
    extra = temporal.current_belief(v).where("version_no % 5 = 0")
    return v.unionByName(extra.withColumns({"recorded_at": F.col("recorded_at") + F.expr("INTERVAL 1 SECOND"), "version_no": F.col("version_no") + 1000000}))


FAULTS_SQL = """, faulty AS (SELECT * FROM versions UNION ALL SELECT * REPLACE (recorded_at + INTERVAL 1 SECOND AS recorded_at, version_no + 1000000 AS version_no) FROM versions WHERE recorded_until IS NULL AND version_no % 5 = 0)"""


@query(f"""WITH {VERSIONS_SQL} {FAULTS_SQL} SELECT DISTINCT b.section_key, b.version_no FROM faulty a JOIN faulty b ON a.section_key = b.section_key
  AND (a.recorded_at, a.version_no) < (b.recorded_at, b.version_no)
  AND a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31')
  AND a.recorded_at < coalesce(b.recorded_until, TIMESTAMP '9999-12-31') AND b.recorded_at < coalesce(a.recorded_until, TIMESTAMP '9999-12-31')""")
def bt_overlaps(spark, sf_dir):
    return constraints.overlaps(_with_faults(versions(spark, sf_dir)))


@query(f"""WITH {VERSIONS_SQL} {FAULTS_SQL}
SELECT 'overlap' AS constraint_name, count(*) AS violations FROM versions a JOIN versions b ON a.section_key = b.section_key AND a.version_no < b.version_no
  AND a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31')
  AND a.recorded_at < coalesce(b.recorded_until, TIMESTAMP '9999-12-31') AND b.recorded_at < coalesce(a.recorded_until, TIMESTAMP '9999-12-31')
UNION ALL SELECT 'interval', count(*) FROM versions WHERE valid_to <= valid_from OR recorded_until <= recorded_at
UNION ALL SELECT 'version_no_unique', count(*) FROM (SELECT 1 FROM versions GROUP BY section_key, version_no HAVING count(*) > 1)
UNION ALL SELECT 'version_id_unique', count(*) FROM (SELECT 1 FROM faulty GROUP BY version_id HAVING count(*) > 1)
UNION ALL SELECT 'kind_known', count(*) FROM (SELECT CASE WHEN n % 97 = 0 THEN 'memo' ELSE kind END AS kind FROM log) WHERE kind NOT IN ('base', 'amendment', 'correction')
UNION ALL SELECT 'document_exists', count(*) FROM versions WHERE document_id NOT IN (SELECT document_id FROM log WHERE n % 89 <> 0)
UNION ALL SELECT 'superseded_exists', count(*) FROM versions WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT version_id FROM versions)""")
def bt_constraints(spark, sf_dir):
    v, d = versions(spark, sf_dir), derived.event_documents(spark, sf_dir)
    return constraints.counted(
        overlap=constraints.overlaps(v),
        interval=constraints.bad_intervals(v),
        version_no_unique=constraints.duplicates(v, "section_key", "version_no"),
        version_id_unique=constraints.duplicates(_with_faults(v), "version_id"),
        kind_known=constraints.outside(d.withColumn("kind", F.when(F.col("n") % 97 == 0, "memo").otherwise(F.col("kind"))), "kind", KINDS),
        document_exists=constraints.orphans(v, "document_id", d.where("n % 89 <> 0"), "document_id"),
        superseded_exists=constraints.orphans(v, "supersedes", v, "version_id"),
    )


@query("""WITH history AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate::DATE AS valid_from, lead(o_orderdate::DATE) OVER w AS valid_to FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)),
facts AS (SELECT o_custkey, l_orderkey, l_linenumber, l_shipdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT h.o_orderpriority, count(*) AS items, count(*) FILTER (h.o_orderkey = f.l_orderkey) AS own_order FROM facts f JOIN history h ON f.o_custkey = h.o_custkey AND h.valid_from <= f.day AND (h.valid_to IS NULL OR h.valid_to > f.day) GROUP BY 1""")
def orders_asof_customer(spark, sf_dir):
    return _orders_asof(spark, sf_dir, None)


def _orders_asof(spark, sf_dir, hot):
    day = F.col("o_orderdate").cast("date")
    order = Window.partitionBy("o_custkey").orderBy(day, "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    history = orders.select("o_custkey", "o_orderkey", "o_orderpriority", day.alias("valid_from"), F.lead(day).over(order).alias("valid_to"), F.lit(0).alias("recorded_at"), F.lit(None).cast("int").alias("recorded_until"))
    facts = table(spark, sf_dir, "lineitem").join(orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("o_custkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), F.lit(0).alias("known"))
    joined = temporal.as_of_join(facts, history, "o_custkey", "day", "known", hot)
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("items"), F.count_if(F.col("o_orderkey") == F.col("l_orderkey")).alias("own_order"))


@query(SQL["orders_asof_customer"])
def orders_asof_hot(spark, sf_dir):
    return _orders_asof(spark, sf_dir, 80)


@query(SQL["bt_rebuild_versions"], days=("valid_from", "valid_to"))
def bt_rebuild_hot(spark, sf_dir):
    return rebuild_versions(derived.event_log(spark, sf_dir), hot=40)


@query(SQL["bt_overlaps"])
def bt_overlaps_hot(spark, sf_dir):
    return constraints.overlaps(_with_faults(versions(spark, sf_dir)), hot=60)


def _probe(spark, sf_dir) -> Column:
    found = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == PROBE).first()
    if found is None:
        raise ValueError(f"there is no vector {PROBE} to ask with")
    return literal(found["embedding"])


def _top_sql(where: str) -> str:
    return f"WITH {CHUNKS_SQL} SELECT chunk_id, section_key, {DISTANCE.format(q=f'(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {PROBE})')} AS distance FROM chunks WHERE {where} ORDER BY distance, chunk_id LIMIT 5"


TOP = ["chunk_id", "section_key", "distance"]


@query(_top_sql(f"{holds_sql(VECTOR_AT)} AND {known_sql(VECTOR_AT)}"))
def vec_topk_asof(spark, sf_dir):
    return retrieval.nearest_as_of(derived.vector_chunks(spark, sf_dir), _probe(spark, sf_dir), VECTOR_AT).select(*TOP)


@query(_top_sql(known_sql(VECTOR_AT)))
def vec_topk_believed(spark, sf_dir):
    return retrieval.nearest_believed(derived.vector_chunks(spark, sf_dir), _probe(spark, sf_dir), VECTOR_AT).select(*TOP)


@query(_top_sql(f"recorded_until IS NULL AND {holds_sql(VECTOR_AT)}"))
def vec_topk_one_clock(spark, sf_dir):
    return retrieval.nearest_one_clock(derived.vector_chunks(spark, sf_dir), _probe(spark, sf_dir), VECTOR_AT).select(*TOP)


@query(_top_sql("true"))
def vec_topk_unfiltered(spark, sf_dir):
    return retrieval.nearest(derived.vector_chunks(spark, sf_dir), _probe(spark, sf_dir), 5).select(*TOP)


@query(f"SELECT * FROM ({_top_sql('true')}) WHERE chunk_id IN (WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE {holds_sql(VECTOR_AT)} AND {known_sql(VECTOR_AT)})")
def vec_topk_post_filter(spark, sf_dir):
    return retrieval.nearest_post_filtered(derived.vector_chunks(spark, sf_dir), _probe(spark, sf_dir), VECTOR_AT).select(*TOP)


def _dated(spark, sf_dir):
    v = F.col("question_id")
    day = F.date_add(F.to_date(F.lit("2024-06-01")), (v * 7 % 500).cast("int"))
    return derived.vector_questions(spark, sf_dir).select("question_id", F.col("section_key").alias("own"), "embedding", day.alias("valid_at"), F.timestamp_add("DAY", F.lit(200), day.cast("timestamp_ntz")).alias("known_at"))


DATED_SQL = CHUNKS_SQL + """,
dated AS (SELECT *, DATE '2024-06-01' + (question_id * 7 % 500)::INT AS valid_at, (DATE '2024-06-01' + (question_id * 7 % 500)::INT)::TIMESTAMP + to_days(200) AS known_at FROM asked)"""
FORCE = "c.valid_from <= d.valid_at AND (c.valid_to IS NULL OR c.valid_to > d.valid_at)"
RECORD = "c.recorded_at <= d.known_at AND (c.recorded_until IS NULL OR c.recorded_until > d.known_at)"


def _batch_sql(name: str, where: str, k: int, asked: str = "dated") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT d.question_id, c.chunk_id, c.section_key, {DISTANCE.format(q='q')} AS distance,
  row_number() OVER (PARTITION BY d.question_id ORDER BY {DISTANCE.format(q='q')}, c.chunk_id)::INT AS rank FROM {asked} d, chunks c WHERE {where}) WHERE rank <= {k})"""


@query(f"WITH {DATED_SQL}, {_batch_sql('best', f'{FORCE} AND {RECORD}', 5)} SELECT question_id, rank, chunk_id, distance FROM best")
def vec_batch_topk(spark, sf_dir):
    return retrieval.batch_nearest(derived.vector_chunks(spark, sf_dir), _dated(spark, sf_dir), 5)


@query(f"WITH {DATED_SQL}, {_batch_sql('best', 'true', 5)} SELECT question_id, rank, chunk_id, distance FROM best")
def vec_batch_topk_unfiltered(spark, sf_dir):
    return retrieval.batch_nearest(derived.vector_chunks(spark, sf_dir), _dated(spark, sf_dir), 5, "all")


def _hits(spark, sf_dir, k):
    chunks, asked = derived.vector_chunks(spark, sf_dir), _dated(spark, sf_dir)
    found = retrieval.batch_nearest(chunks, asked, k, "all")
    right = temporal.holds(F.col("valid_from"), F.col("valid_to"), F.col("valid_at")) & temporal.holds(F.col("recorded_at"), F.col("recorded_until"), F.col("known_at"))
    same = F.col("section_key") == F.col("own")
    return found.join(chunks.drop("embedding", "text"), "chunk_id").join(asked.drop("embedding"), "question_id").select("question_id", F.col("own").alias("klass"), "rank", F.col("section_key").alias("section"), "distance", (same & right).alias("correct"), same.alias("same_section"))


HITS_SQL = f"""{_batch_sql('best', 'true', 5)}, hits AS (SELECT b.question_id, d.own AS klass, b.rank, b.section_key AS section, b.distance, b.section_key = d.own AND {FORCE} AND {RECORD} AS correct, b.section_key = d.own AS same_section
  FROM best b JOIN dated d USING (question_id) JOIN chunks c USING (chunk_id))"""


@query(f"""WITH {DATED_SQL}, {HITS_SQL}, scores AS (SELECT question_id, klass, min(rank) FILTER (correct) AS correct_rank, count(section) > count(DISTINCT section) AS blended, coalesce(bool_or(rank = 1 AND same_section AND NOT correct), false) AS superseded FROM hits GROUP BY ALL)
SELECT coalesce(klass, 'total') AS klass, count(*) AS n, count(*) FILTER (correct_rank = 1) AS top1, count(correct_rank) AS recalled, count(*) FILTER (superseded) AS superseded, count(*) FILTER (blended) AS blended FROM scores GROUP BY ROLLUP (klass)""")
def vec_class_scores(spark, sf_dir):
    return scoring.class_scores(scoring.question_scores(_hits(spark, sf_dir, 5)))


@query(f"""WITH {DATED_SQL}, {_batch_sql('ranked', 'c.section_key = d.own', 2)}
SELECT question_id, round(max(1 - distance) - min(1 - distance), 6) AS margin FROM ranked GROUP BY 1 HAVING count(*) = 2""")
def vec_margins(spark, sf_dir):
    return scoring.margins(_extremes(spark, sf_dir))


def _extremes(spark, sf_dir):
    return retrieval.section_extremes(derived.vector_chunks(spark, sf_dir), _dated(spark, sf_dir).withColumnRenamed("own", "section_key"))


@query(f"""WITH {DATED_SQL} SELECT d.question_id, c.section_key, round(max(1 - {DISTANCE.format(q='q')}) - min(1 - {DISTANCE.format(q='q')}), 6) AS spread, count(*) AS versions FROM dated d JOIN chunks c ON c.section_key = d.own GROUP BY ALL""")
def vec_spread(spark, sf_dir):
    return scoring.spread(_extremes(spark, sf_dir))


@query(f"""WITH {DATED_SQL}, {_batch_sql('ranked', 'c.section_key = d.own', 2)}, margins AS (SELECT question_id, round(max(1 - distance) - min(1 - distance), 6) AS margin FROM ranked GROUP BY 1 HAVING count(*) = 2),
sorted AS (SELECT list(margin ORDER BY margin) AS m FROM margins)
SELECT m[len(m) // 2 + 1] AS upper_median, m[least(floor(0.95::DOUBLE * len(m)), len(m) - 1)::INT + 1] AS p95, list_max(m) AS greatest FROM sorted""")
def vec_margin_stats(spark, sf_dir):
    return scoring.order_statistics(vec_margins(spark, sf_dir), "margin", upper_median=0.5, p95=0.95)


@query(f"""WITH {DATED_SQL}, {_batch_sql('truth', f'{FORCE} AND {RECORD}', 5)}, {_batch_sql('any_', 'true', 5)},
mine AS (SELECT a.* FROM any_ a JOIN dated d USING (question_id) JOIN chunks c USING (chunk_id) WHERE {FORCE} AND {RECORD}),
ratio AS (SELECT question_id, avg(m.distance) AS mine FROM mine m GROUP BY 1), exact AS (SELECT question_id, avg(distance) AS exact FROM truth GROUP BY 1)
SELECT round((SELECT count(*) FROM mine JOIN truth USING (question_id, chunk_id)) / (SELECT count(*) FROM truth), 6) AS recall,
  (SELECT round(avg(r.mine / e.exact), 6) FROM ratio r JOIN exact e USING (question_id) WHERE e.exact > 0) AS distance_ratio""")
def vec_post_filter_recall(spark, sf_dir):
    chunks, asked = derived.vector_chunks(spark, sf_dir), _dated(spark, sf_dir)
    truth = plan.candidates(chunks, asked, plan.Options(k=5))
    return scoring.recall(plan.candidates(chunks, asked, plan.broken("post-filter", k=5)), truth)


@query(f"""WITH {CHUNKS_SQL}, coordinates AS (SELECT section_key, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM chunks), means AS (SELECT section_key, i, avg(x) AS x FROM coordinates GROUP BY ALL),
centroids AS (SELECT section_key, list(x ORDER BY i) AS c FROM means GROUP BY 1)
SELECT *, own <= other / 2 AS separates FROM (SELECT round(avg(1 - list_cosine_similarity(v, o.c)), 5) AS own, round(avg(1 - list_cosine_similarity(v, x.c)), 5) AS other FROM chunks k JOIN centroids o ON o.section_key = k.section_key JOIN centroids x ON x.section_key::INT = (k.section_key::INT + 1) % 10)""")
def vec_separation(spark, sf_dir):
    chunks = derived.vector_chunks(spark, sf_dir)
    following = ((F.col("section_key").cast("int") + 1) % 10).cast("string")
    apart = scoring.separation(chunks, retrieval.centroids_by_section(chunks), following)
    return scoring.judged_separation(apart)


FLOORS = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)


def _nearest_by_topic(spark, sf_dir):
    asked = _dated(spark, sf_dir)
    best = retrieval.batch_nearest(derived.vector_chunks(spark, sf_dir), asked, 1)
    return best.select("distance", (F.col("question_id") % 3 != 0).alias("on_topic"))


@query(f"""WITH {DATED_SQL}, {_batch_sql('best', f'{FORCE} AND {RECORD}', 1)} SELECT floor, count(*) FILTER (question_id % 3 = 0 AND distance > floor) AS off_topic_refused, count(*) FILTER (question_id % 3 <> 0 AND distance <= floor) AS on_topic_answered
FROM best, (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in FLOORS)}]) AS floor) GROUP BY floor""")
def floor_sweep(spark, sf_dir):
    return scoring.threshold_sweep(_nearest_by_topic(spark, sf_dir), FLOORS)


@query(f"WITH {DATED_SQL}, {_batch_sql('best', f'{FORCE} AND {RECORD}', 1)} SELECT question_id % 3 <> 0 AS on_topic, min(distance) AS least, round(quantile_cont(distance, 0.5), 6) AS median, max(distance) AS greatest, count(*) AS n FROM best GROUP BY 1")
def floor_stats(spark, sf_dir):
    return scoring.distance_stats(_nearest_by_topic(spark, sf_dir))


@query(f"WITH {VERSIONS_SQL}, kept AS (SELECT DISTINCT text FROM versions WHERE version_no <= 2) SELECT DISTINCT sha256(text) AS text_sha, text FROM versions WHERE text NOT IN (SELECT text FROM kept)")
def idx_missing_vectors(spark, sf_dir):
    v = versions(spark, sf_dir)
    kept = v.where("version_no <= 2").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha")).distinct()
    return plan.missing_vectors(v, kept)


TEMPLATES = (
    "Who may swim before the reorg?", "Were the doors open on 2031-12-24?", "Who paid in 2030?", "Compare 2031-01-01 and 7 July 2031.", "What did we print on 2031-05-05?", "Is the 2030 tariff charged these days?",
    "Since may 2031, who cleans?", "Is it shut on 2031-02-30?", "According to your records then, 2031-08-08?", "Who keeps the keys?", "Did it open on 24 December 2031?", "Was it dearer last year?", "What cost 3 on 1 June 2031?", "What will be charged soon?",
)
NOW = "2026-06-01 12:00:00"
_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]"


_DATES_SQL = f"""WITH q AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || [{', '.join(f"'{t}'" for t in TEMPLATES)}][((conv_id * 7 + turn) % {len(TEMPLATES)} + 1)::INT] AS s FROM conversations),
m AS (SELECT conv_id, turn, s, regexp_extract_all(s, '(?i){dates._ISO}', 1) AS iso, regexp_extract_all(s, '(?i){dates._DMY}', 1) AS dmy, regexp_extract_all(s, '(?i){dates._MY}', 1) AS my,
  regexp_extract(s, '(?i){dates.phrase(dates.UNRESOLVABLE)}', 1) AS gesture, regexp_extract(s, '(?i){dates._YEAR}', 1) AS year,
  regexp_matches(s, '(?i){dates.phrase(dates.TODAY)}') AS today, regexp_matches(s, '(?i){dates.phrase(dates.RECOLLECTION)}') AS recalls FROM q),
p AS (SELECT *, list_concat(iso, dmy, my) AS texts, list_concat(list_transform(iso, lambda x: try_cast(x AS DATE)),
  list_transform(list_concat(dmy, my), lambda x: try_cast(string_split(regexp_replace(x, '\\s+', ' ', 'g'), ' ')[-1] || '-' || list_position({_MONTH_LIST}, lower(string_split(regexp_replace(x, '\\s+', ' ', 'g'), ' ')[-2])) || '-' ||
    CASE WHEN len(string_split(regexp_replace(x, '\\s+', ' ', 'g'), ' ')) = 3 THEN string_split(x, ' ')[1] ELSE '1' END AS DATE))) AS ds FROM m),
r AS (SELECT *, CASE WHEN gesture <> '' THEN 'ambiguous-date' WHEN len(list_filter(ds, lambda d: d IS NULL)) > 0 THEN 'ambiguous-date' WHEN len(list_distinct(ds)) > 1 THEN 'ambiguous-date' WHEN len(ds) = 0 AND year <> '' AND NOT today THEN 'ambiguous-date' WHEN len(ds) = 0 THEN 'assumed-today' ELSE 'stated' END AS outcome FROM p)"""


@query(_DATES_SQL + f"""
SELECT conv_id, turn, outcome, CASE outcome WHEN 'stated' THEN ds[1] WHEN 'assumed-today' THEN DATE '2026-06-01' END AS valid_at,
  CASE WHEN outcome = 'stated' AND recalls THEN ds[1]::TIMESTAMP + INTERVAL 12 HOUR WHEN outcome <> 'ambiguous-date' THEN TIMESTAMP '{NOW}' END AS known_at,
  CASE WHEN outcome = 'stated' THEN texts[1] END AS matched FROM r""", days=("valid_at",))
def resolve_question(spark, sf_dir):
    return _resolved(spark, sf_dir).select("conv_id", "turn", "r.outcome", "r.valid_at", F.col("r.known_at").cast("timestamp_ntz").alias("known_at"), "r.matched")


def _questions(spark, sf_dir) -> DataFrame:
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(TEMPLATES) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").withColumn("question", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), template))


def _resolved(spark, sf_dir) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", dates.resolve(F.col("question"), F.lit(NOW).cast("timestamp")).alias("r"))


MARKERS = ("<<<untrusted:0000>>>", "<<</UNTRUSTED : x>>>", "<<<untrustеd:1>>>", "<<<un​trusted:2>>>", "＜<<untrusted：abc>>＞", "<<<untrusted:" + "y" * 65 + ">>>")


@query(f"""WITH marked AS (SELECT doc_id, coalesce(text, '') || [{', '.join(f"'{m}'" for m in MARKERS)}][(doc_id % {len(MARKERS)} + 1)::INT] || coalesce(text, '') AS t FROM documents),
clean AS (SELECT doc_id, t, regexp_replace(t, '{fence.marker_pattern("(?i)")}', '{fence.REDACTED}', 'g') AS c FROM marked)
SELECT doc_id, t <> c AS changed, length(c)::INT AS n_chars, sha256(c) AS sha FROM clean""")
def fence_neutralise(spark, sf_dir):
    marker = F.element_at(F.array(*map(F.lit, MARKERS)), (F.col("doc_id") % len(MARKERS) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(text, marker, text).alias("t")).withColumn("c", fence.neutralise(F.col("t")))
    return t.select("doc_id", (F.col("t") != F.col("c")).alias("changed"), F.length("c").alias("n_chars"), F.sha2(F.col("c").cast("binary"), 256).alias("sha"))


@query(f"SELECT doc_id, '<<<untrusted:' || substr(sha256('{fence.PREFIX}' || doc_id), 1, 16) || '>>>' AS opener, '<<</untrusted:' || substr(sha256('{fence.PREFIX}' || doc_id), 1, 16) || '>>>' AS closer FROM documents")
def fence_token(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", fence.opener(i).alias("opener"), fence.closer(i).alias("closer"))


def _documents(spark, sf_dir):
    return derived.event_documents(spark, sf_dir).select("recorded_at", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


REV_SQL = "rev AS (SELECT substr(md5(string_agg(sha256(event_type || ':' || event_id), ',' ORDER BY ts, sha256(event_type || ':' || event_id))), 1, 12) AS corpus_rev FROM events)"


@query(f"WITH {REV_SQL} SELECT * FROM rev")
def corpus_rev(spark, sf_dir):
    return scoring.corpus_revision(_documents(spark, sf_dir))


ASKED_AT = "2025-06-01 12:00:00"
ENGINE = plan.Options(floor=0.7)


def _answers(spark, sf_dir, options=ENGINE):
    return plan.ask(derived.vector_questions(spark, sf_dir).drop("section_key"), derived.vector_chunks(spark, sf_dir), _documents(spark, sf_dir), F.lit(ASKED_AT).cast("timestamp"), options)


_USER = r"""'as-of ' || d.valid_at || ' recorded-by ' || strftime(d.known_at, '%Y-%m-%dT%H:%MZ') || chr(10) || 'task: ' || d.question || chr(10)
  || string_agg('[' || b.rank || '] ' || c.section_key || ' | ' || c.valid_from || ' .. ' || coalesce(c.valid_to::VARCHAR, 'open') || chr(10) || '<<<untrusted:' || tok || '>>>' || chr(10) || c.text || chr(10) || '<<</untrusted:' || tok || '>>>', chr(10) ORDER BY b.rank)"""
_SYSTEM_SQL = "'" + plan.SYSTEM.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
ASK_SQL = f"""WITH {CHUNKS_SQL}, {REV_SQL},
told(i, question, resolution, valid_at, known_at, reason) AS (VALUES
  (0, '{derived.QUESTIONS[0]}', 'stated', DATE '2025-03-01', TIMESTAMP '{ASKED_AT}', NULL), (1, '{derived.QUESTIONS[1]}', 'ambiguous-date', NULL, NULL, 'more than one date is named (2025-03-01, 2025-03-01)'),
  (2, '{derived.QUESTIONS[2]}', 'assumed-today', DATE '2025-06-01', TIMESTAMP '{ASKED_AT}', NULL), (3, '{derived.QUESTIONS[3]}', 'ambiguous-date', NULL, NULL, '''back then'' cannot be turned into a date'),
  (4, '{derived.QUESTIONS[4]}', 'ambiguous-date', NULL, NULL, '2024 is a year, and a rule can change within one')),
fixed AS (SELECT i, question, CASE WHEN i = 1 THEN 'stated' ELSE resolution END AS resolution, CASE WHEN i = 1 THEN DATE '2025-03-01' ELSE valid_at END AS valid_at, CASE WHEN i = 1 THEN TIMESTAMP '2025-03-01 12:00:00' ELSE known_at END AS known_at, CASE WHEN i <> 1 THEN reason END AS reason FROM told),
d AS (SELECT a.question_id, a.q, f.*, substr(sha256('{fence.PREFIX}' || a.question_id), 1, 16) AS tok FROM asked a JOIN fixed f ON f.i = (a.question_id / 20)::INT % 5),
{_batch_sql('best', f'{FORCE} AND {RECORD}', 3, 'd')}, {_batch_sql('lapse', RECORD, 1, 'd')},
prompts AS (SELECT d.question_id, min(b.distance) AS nearest, arg_min(c.section_key, b.rank) AS section, arg_min(c.text, b.rank) AS text, {_USER} AS usr, count(*)::INT AS n FROM d JOIN best b USING (question_id) JOIN chunks c USING (chunk_id) GROUP BY d.question_id, d.question, d.valid_at, d.known_at),
j AS (SELECT d.question_id, d.question, d.resolution, d.valid_at, d.known_at, d.reason, p.nearest, p.section, p.text, p.usr, p.n, l.distance AS ld, l.section_key AS ls,
  (SELECT CASE WHEN bool_or({FORCE} AND {RECORD}) THEN 2 WHEN bool_or({RECORD}) THEN 1 ELSE 0 END FROM chunks c) AS cov FROM d LEFT JOIN prompts p USING (question_id) LEFT JOIN lapse l USING (question_id)),
o AS (SELECT *, coalesce(nearest - ld > 0.05 AND ld <= 0.7 AND ls <> section, false) AS gone, CASE WHEN resolution = 'ambiguous-date' THEN 'ambiguous-date' WHEN cov = 0 THEN 'no-record' WHEN cov = 1 OR n IS NULL THEN 'no-rule-in-force'
  WHEN coalesce(nearest - ld > 0.05 AND ld <= 0.7 AND ls <> section, false) THEN 'no-rule-in-force' WHEN nearest > 0.7 THEN 'no-passage-on-topic' ELSE 'answered' END AS outcome FROM j),
answers AS (SELECT question_id, question, resolution, valid_at, known_at, outcome, corpus_rev,
  CASE WHEN outcome = 'answered' THEN NULL WHEN resolution = 'ambiguous-date' THEN reason WHEN cov = 0 THEN 'nothing was on record at ' || known_at::DATE WHEN cov = 1 THEN 'no rule was in force on ' || valid_at WHEN n IS NULL THEN 'no passage was in force on ' || valid_at
    WHEN gone THEN 'section ' || ls || ' covers this and was not in force on ' || valid_at ELSE 'the nearest passage is ' || printf('%.3f', nearest) || ' away, past the floor of 0.7' END AS refusal_reason,
  CASE WHEN outcome = 'answered' THEN split_part(text, '. ', 1) || '. (section ' || section || ')' END AS answer_text, CASE WHEN outcome = 'answered' THEN 'scripted' END AS model,
  CASE WHEN outcome = 'answered' THEN sha256({_SYSTEM_SQL}) END AS system_sha256, CASE WHEN outcome = 'answered' THEN sha256({_SYSTEM_SQL} || chr(10) || '---' || chr(10) || usr) END AS prompt_sha256,
  substr(sha256('{fence.PREFIX}' || question_id), 1, 16) AS fence_token, CASE WHEN outcome = 'answered' THEN n ELSE 0 END AS n_citations FROM o, rev)"""


@query(ASK_SQL + " SELECT * FROM answers", days=("valid_at",))
def ask_outcome(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.withColumns({"n_citations": F.coalesce(F.size("citations"), F.lit(0)), "known_at": F.col("known_at").cast("timestamp_ntz")}).drop("citations")


@query(ASK_SQL + " SELECT question_id, b.rank AS position, b.chunk_id AS version_id, c.section_key, c.valid_from, c.valid_to FROM answers JOIN best b USING (question_id) JOIN chunks c USING (chunk_id) WHERE outcome = 'answered'", days=("valid_from", "valid_to"))
def citations_flat(spark, sf_dir):
    return plan.citations(_answers(spark, sf_dir))


@query(ASK_SQL + """ SELECT question_id, CASE WHEN question_id % 140 = 0 THEN 'not-reproducible' WHEN outcome <> 'answered' THEN 'reproduced'
  WHEN question_id % 60 = 0 THEN 'system-prompt-changed'
  WHEN (SELECT bool_or(b.chunk_id % 7 = 0) FROM best b WHERE b.question_id = answers.question_id) THEN 'passages-changed' ELSE 'reproduced' END AS verdict FROM answers""")
def replay_verdict(spark, sf_dir):
    a = _answers(spark, sf_dir)
    older = F.col("question_id") % 60 == 0
    kept = a.where("question_id % 140 <> 0").withColumns({k: F.when(older & F.col(k).isNotNull(), F.sha2(F.concat(F.lit("old"), F.col(k)).cast("binary"), 256)).otherwise(F.col(k)) for k in ("system_sha256", "prompt_sha256")})
    now = derived.vector_chunks(spark, sf_dir).withColumn("text", F.when(F.col("chunk_id") % 7 == 0, F.concat("text", F.lit(" As amended."))).otherwise(F.col("text")))
    return replay(a.select("question_id"), plan.answer_rows(kept, F.lit(ASKED_AT).cast("timestamp")), plan.citations(kept), now, ENGINE)


def _cases(spark, sf_dir):
    i = (F.col("question_id") / 20).cast("int") % 5
    return derived.vector_questions(spark, sf_dir).select(F.col("question_id").alias("case_id"), F.concat(F.lit("class "), i.cast("string")).alias("klass"), F.when(i >= 3, dates.AMBIGUOUS).otherwise(plan.ANSWERED).alias("expected"), F.array(F.concat(F.lit("section "), "section_key")).alias("must_contain"), F.array(F.lit("As amended")).alias("must_not_contain"))


GATE_SQL = ASK_SQL + """, gate AS (SELECT question_id, 'class ' || ((question_id / 20)::INT % 5) AS klass, CASE WHEN (question_id / 20)::INT % 5 >= 3 THEN 'ambiguous-date' ELSE 'answered' END AS expected, outcome,
  CASE WHEN outcome = CASE WHEN (question_id / 20)::INT % 5 >= 3 THEN 'ambiguous-date' ELSE 'answered' END AND (outcome <> 'answered' OR contains(answer_text, 'section ' || own)) THEN 'ok' ELSE 'REGRESSION' END AS status FROM answers JOIN asked USING (question_id))"""


@query(GATE_SQL + " SELECT klass, count(*) AS n, count(*) FILTER (status = 'ok') AS passed FROM gate GROUP BY 1")
def gate_by_class(spark, sf_dir):
    return gate.by_class(gate.scored(_cases(spark, sf_dir), _answers(spark, sf_dir)))


@query(GATE_SQL + " SELECT count(*) FILTER (expected <> 'answered') AS should_refuse, count(*) FILTER (expected <> 'answered' AND outcome <> 'answered') AS refused, count(*) FILTER (expected = 'answered') AS should_answer, count(*) FILTER (expected = 'answered' AND outcome = 'answered') AS answered FROM gate")
def refusal_pair(spark, sf_dir):
    return gate.refusal_pair(gate.scored(_cases(spark, sf_dir), _answers(spark, sf_dir)))


@query(f"""WITH {VERSIONS_SQL}, truth AS (SELECT section_key, text FROM versions WHERE {holds_sql(AT)} AND {known_sql(AT)}), cases AS (SELECT DISTINCT user_id::VARCHAR AS section_key FROM events)
SELECT section_key AS case_id, array_to_string(CASE WHEN text IS NULL THEN ['nothing in force'] ELSE list_concat(CASE WHEN contains(text, ':') THEN [] ELSE ['missing :'] END, CASE WHEN contains(text, 'click') THEN ['blended with click'] ELSE [] END) END, '; ') AS faults
FROM cases LEFT JOIN truth USING (section_key) WHERE text IS NULL OR contains(text, 'click') OR NOT contains(text, ':')""")
def gold_disagreements(spark, sf_dir):
    cases = temporal.sections(derived.event_documents(spark, sf_dir)).select(F.col("section_key").alias("case_id"), "section_key", F.lit(AT.valid_at).alias("valid_at"), F.expr(f"TIMESTAMP_NTZ '{AT.known_utc}'").alias("known_at"), F.array(F.lit(":")).alias("must_contain"), F.array(F.lit("click")).alias("must_not_contain"))
    return gate.gold_disagreements(cases, versions(spark, sf_dir)).withColumn("faults", F.array_join("faults", "; "))


def _markdown(spark, sf_dir) -> DataFrame:
    """Each event's document written out as Markdown with front matter; every 50th lacks its date, every 77th has an unknown kind."""
    d = derived.event_documents(spark, sf_dir)
    later, quote = F.date_add("start", 10).cast("string"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    day = F.when(F.col("n") % 50 == 0, F.lit("")).otherwise(F.col("start").cast("string"))
    kind = F.when(F.col("n") % 77 == 0, "memo").otherwise(F.col("kind"))
    section = F.concat(F.lit("\n  - section: "), quote(F.col("section_key")))
    plain = F.concat(F.lit("effective_from: "), day, F.when(F.col("kind") == "base", "\nsections:").otherwise("\namends:"), section, F.lit("\n    text: "), quote(F.col("text")))
    end = F.when(F.col("n") % 3 == 0, F.concat(F.lit("\n        valid_to: "), F.date_add("start", 20).cast("string"))).otherwise("")
    spans = F.concat(F.lit("corrects:"), section, F.lit("\n    versions:\n      - valid_from: "), day, F.lit("\n        valid_to: "), later, F.lit("\n        text: "), quote(F.col("text")), F.lit("\n      - valid_from: "), later, end, F.lit("\n        text: "), quote(F.concat("text", F.lit(":b"))))
    head = F.concat(F.lit('---\nid: "'), F.col("document_id"), F.lit('"\nkind: '), kind, F.lit("\ntitle: Event "), F.col("document_id"), F.lit("\nrecorded_at: "), F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("\n"))
    content = F.concat(head, F.when(F.col("kind") == "correction", spans).otherwise(plain), F.lit("\n---\nNoted as "), F.col("text"), F.lit(".\n"))
    return d.select("n", content.alias("content"))


def _parsed(spark, sf_dir) -> DataFrame:
    return parse_documents(_markdown(spark, sf_dir).select("content"), strict=False)


@query(f"""WITH {LOG_SQL}, good AS (SELECT *, n % 50 = 0 OR n % 77 = 0 AS bad FROM log),
firsts AS (SELECT document_id, min(valid_from) AS first_day, count(*) AS clauses FROM clauses GROUP BY 1)
SELECT CASE WHEN NOT bad THEN document_id END AS doc_id, CASE WHEN NOT bad THEN kind END AS kind, CASE WHEN NOT bad THEN 'Event ' || document_id END AS title, CASE WHEN NOT bad THEN first_day END AS effective_from,
  CASE WHEN NOT bad THEN recorded_at END AS recorded_at, CASE WHEN NOT bad THEN 'Noted as ' || text || '.' END AS body, CASE WHEN bad THEN 0 ELSE clauses END AS clauses, bad AS refused FROM good JOIN firsts USING (document_id)""", days=("effective_from",))
def src_parse_documents(spark, sf_dir):
    d = _parsed(spark, sf_dir)
    return d.select("doc_id", "kind", "title", "effective_from", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), "body", F.coalesce(F.size("clauses"), F.lit(0)).cast("long").alias("clauses"), F.col("error").isNotNull().alias("refused"))


@query(f"""WITH {LOG_SQL} SELECT section_key, kind, recorded_at, document_id, clause_no, text, valid_from, valid_to FROM clauses WHERE document_id::BIGINT % 50 <> 0 AND document_id::BIGINT % 77 <> 0""", days=("valid_from", "valid_to"))
def src_clause_log(spark, sf_dir):
    return clause_log(_parsed(spark, sf_dir).where("error is null")).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))


def _hashed(spark, sf_dir) -> DataFrame:
    d = derived.event_documents(spark, sf_dir)
    return d.select("document_id", "n", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


_UID_SQL = "concat_ws('-', u[1:8], u[9:12], u[13:16], u[17:20], u[21:32])"


@query(f"""WITH h AS (SELECT event_id, sha256(event_type || ':' || event_id) AS content_hash FROM events), k AS (SELECT *, sha256('tidemark-document:' || content_hash) AS u FROM h)
SELECT event_id::VARCHAR AS document_id, content_hash, {_UID_SQL} AS document_uid FROM k WHERE event_id % 3 <> 0""")
def ingest_only_new(spark, sf_dir):
    d = _hashed(spark, sf_dir)
    return ingest_new(d.where("n % 3 = 0"), d.unionByName(d)).select("document_id", "content_hash", document_uid(F.col("content_hash")).alias("document_uid"))


def _faulty(v: DataFrame) -> DataFrame:
    """Versions with every fault a constraint is there for: empty ranges, references to nothing, overlapping copies, numbers taken twice."""
    closed, no = F.col("recorded_until").isNotNull(), F.col("version_no")
    v = v.withColumns({
        "recorded_until": F.when(closed & (no % 11 == 3), F.col("recorded_at")).otherwise(F.col("recorded_until")),
        "supersedes": F.when(no % 13 == 5, F.concat(F.lit("gone@v"), no)).otherwise(F.col("supersedes")),
    })
    twice = v.where(F.col("recorded_until").isNotNull() & (no % 17 == 4)).withColumn("recorded_until", F.col("recorded_at"))
    return _with_faults(v).unionByName(twice)


@query(f"""WITH {VERSIONS_SQL}, spoilt AS (SELECT * REPLACE (CASE WHEN recorded_until IS NOT NULL AND version_no % 11 = 3 THEN recorded_at ELSE recorded_until END AS recorded_until,
  CASE WHEN version_no % 13 = 5 THEN 'gone@v' || version_no ELSE supersedes END AS supersedes) FROM versions),
v AS (SELECT * FROM spoilt UNION ALL SELECT * REPLACE (recorded_at + INTERVAL 1 SECOND AS recorded_at, version_no + 1000000 AS version_no) FROM spoilt WHERE recorded_until IS NULL AND version_no % 5 = 0
  UNION ALL SELECT * REPLACE (recorded_at AS recorded_until) FROM spoilt WHERE recorded_until IS NOT NULL AND version_no % 17 = 4),
full_ranges AS (SELECT * FROM v WHERE valid_from < coalesce(valid_to, DATE '9999-12-31') AND recorded_at < coalesce(recorded_until, TIMESTAMP '9999-12-31')),
d AS (SELECT document_id, CASE WHEN n % 97 = 0 THEN 'memo' ELSE kind END AS kind, sha256(text) AS content_hash FROM log WHERE n % 89 <> 0 UNION ALL SELECT document_id || '-copy', kind, sha256(text) FROM log WHERE n % 31 = 0)
SELECT 'overlap' AS constraint_name, count(*) AS violations FROM (SELECT DISTINCT b.section_key, b.version_no FROM full_ranges a JOIN full_ranges b ON a.section_key = b.section_key AND (a.recorded_at, a.version_no) < (b.recorded_at, b.version_no)
  AND a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31')
  AND a.recorded_at < coalesce(b.recorded_until, TIMESTAMP '9999-12-31') AND b.recorded_at < coalesce(a.recorded_until, TIMESTAMP '9999-12-31'))
UNION ALL SELECT 'interval', count(*) FROM v WHERE valid_to <= valid_from OR recorded_until <= recorded_at
UNION ALL SELECT 'version_no_unique', count(*) FROM (SELECT 1 FROM v GROUP BY section_key, version_no HAVING count(*) > 1)
UNION ALL SELECT 'version_id_unique', count(*) FROM (SELECT 1 FROM v GROUP BY version_id HAVING count(*) > 1)
UNION ALL SELECT 'content_unique', count(*) FROM (SELECT 1 FROM d GROUP BY content_hash HAVING count(*) > 1)
UNION ALL SELECT 'kind_known', count(*) FROM d WHERE kind NOT IN ('base', 'amendment', 'correction')
UNION ALL SELECT 'document_exists', count(*) FROM v WHERE document_id NOT IN (SELECT document_id FROM d)
UNION ALL SELECT 'superseded_exists', count(*) FROM v WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT version_id FROM v)""")
def ingest_violations(spark, sf_dir):
    d = derived.event_documents(spark, sf_dir).select("n", F.col("document_id").alias("doc_id"), "kind", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    kept = d.where("n % 89 <> 0").withColumn("kind", F.when(F.col("n") % 97 == 0, "memo").otherwise(F.col("kind")))
    copies = d.where("n % 31 = 0").withColumn("doc_id", F.concat("doc_id", F.lit("-copy")))
    return violations(_faulty(versions(spark, sf_dir)), kept.unionByName(copies))


@query(f"WITH {VERSIONS_SQL} SELECT section_key, version_no, text, valid_from, valid_to, recorded_at, recorded_until, document_id, supersedes FROM versions", days=("valid_from", "valid_to"))
def ingest_refolded(spark, sf_dir):
    log = derived.event_log(spark, sf_dir)
    late = F.col("document_id").cast("long") % 1000 == 7
    old = log.where(~late)
    return refolded(rebuild_versions(old), old, log.where(late)).drop("version_id")


@query(f"""WITH {LOG_SQL} SELECT document_id || ':' || section_key AS chunk_id, section_key, CASE WHEN kind = 'base' THEN text ELSE 'Event ' || document_id || chr(10) || 'Noted as ' || text || '.' END AS text, document_id
FROM log WHERE n % 50 <> 0 AND n % 77 <> 0""")
def idx_published(spark, sf_dir):
    return published_index(_parsed(spark, sf_dir).where("error is null"))


@query(f"WITH {VERSIONS_SQL} SELECT version_id AS chunk_id, section_key, text, document_id, version_no, row_number() OVER (PARTITION BY section_key ORDER BY version_no)::INT AS position FROM versions")
def idx_versions(spark, sf_dir):
    from tidemark.sources.corpus import version_index

    return version_index(versions(spark, sf_dir)).withColumn("position", F.row_number().over(Window.partitionBy("section_key").orderBy("version_no")))


def _text_vectors(v: DataFrame) -> DataFrame:
    return v.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding")).distinct()


_INDEX_SQL = "version_id AS chunk_id, section_key, valid_from, valid_to, recorded_at, recorded_until, length(text)::DOUBLE AS first"


@query(f"WITH {VERSIONS_SQL} SELECT {_INDEX_SQL} FROM versions", days=("valid_from", "valid_to"))
def idx_build(spark, sf_dir):
    v = versions(spark, sf_dir)
    return plan.build_index(v, _text_vectors(v), 2).select("chunk_id", "section_key", "valid_from", "valid_to", "recorded_at", "recorded_until", F.get("embedding", 0).alias("first"))


@query(f"WITH {VERSIONS_SQL} SELECT {_INDEX_SQL}, 'lengths' AS model FROM versions WHERE NOT (version_no <= 3 AND version_no <> 2)", days=("valid_from", "valid_to"))
def idx_build_missing(spark, sf_dir):
    v = versions(spark, sf_dir)
    had = v.where("version_no <= 3").select(F.col("version_id").alias("chunk_id"), F.when(F.col("version_no") == 2, "other").otherwise("lengths").alias("model"))
    built = plan.build_index(v, _text_vectors(v), 2, model="lengths", existing=had)
    return built.select("chunk_id", "section_key", "valid_from", "valid_to", "recorded_at", "recorded_until", F.get("embedding", 0).alias("first"), "model")


@query(_DATES_SQL + f""",
said AS (SELECT *, CASE WHEN gesture <> '' THEN '''' || gesture || ''' cannot be turned into a date' WHEN len(list_filter(ds, lambda d: d IS NULL)) > 0 THEN 'the question names a date that does not exist'
    WHEN len(list_distinct(ds)) > 1 THEN 'more than one date is named (' || array_to_string(list_transform(list_sort(list_distinct(ds)), lambda d: d::VARCHAR), ', ') || ')'
    ELSE year || ' is a year, and a rule can change within one' END AS reason,
  CASE WHEN outcome = 'stated' AND recalls THEN ds[1]::TIMESTAMP + INTERVAL 12 HOUR ELSE TIMESTAMP '{NOW}' END AS known_at FROM r)
SELECT conv_id, turn, CASE outcome WHEN 'ambiguous-date' THEN 'no single day: ' || reason WHEN 'stated' THEN ds[1] || ', taken from the question; record of ' || strftime(known_at, '%Y-%m-%d %H:%M')
  ELSE '2026-06-01, the day of asking; record of ' || strftime(known_at, '%Y-%m-%d %H:%M') END AS described FROM said""")
def date_describe(spark, sf_dir):
    return _resolved(spark, sf_dir).select("conv_id", "turn", dates.describe(F.col("r")).alias("described"))


_FOLD_SQL = f"translate({{c}}, '{fence.LOOKALIKES}{fence.INVISIBLE}', '{fence.STAND_FOR}')"


@query(f"""WITH marked AS (SELECT doc_id, coalesce(text, '') || [{', '.join(f"'{m}'" for m in MARKERS)}][(doc_id % {len(MARKERS)} + 1)::INT] AS t FROM documents)
SELECT doc_id, sha256({_FOLD_SQL.format(c='t')}) AS folded, sha256('<<<untrusted:' || substr(sha256('{fence.PREFIX}' || doc_id), 1, 16) || '>>>' || chr(10) || 'text: ' || regexp_replace(t, '{fence.marker_pattern("(?i)")}', '{fence.REDACTED}', 'g') || chr(10) || '<<</untrusted:' || substr(sha256('{fence.PREFIX}' || doc_id), 1, 16) || '>>>') AS wrapped FROM marked""")
def fence_wrap(spark, sf_dir):
    marker = F.element_at(F.array(*map(F.lit, MARKERS)), (F.col("doc_id") % len(MARKERS) + 1).cast("int"))
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), marker).alias("t"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return t.select("doc_id", sha(fence.fold(F.col("t"))).alias("folded"), sha(fence.wrap(F.col("doc_id").cast("string"), {"text": F.col("t")})).alias("wrapped"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) + 0.0 AS unit_sum FROM embeddings")
def vec_unit(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(add(F.transform(v, lambda x: x * x))), 5).alias("norm"), (F.round(add(unit(v)), 5) + 0.0).alias("unit_sum"))


@query(f"""WITH {DATED_SQL}, {_batch_sql('everything', 'true', 1)}, {_batch_sql('current', f"c.recorded_until IS NULL AND {FORCE}", 1)}, {_batch_sql('two_clocks', f'{FORCE} AND {RECORD}', 1)},
found AS (SELECT 'all' AS scope, * FROM everything UNION ALL SELECT 'one_clock', * FROM current UNION ALL SELECT 'as_of', * FROM two_clocks)
SELECT scope, count(*) AS n, count(*) FILTER (c.section_key = d.own) AS right_section, count(*) FILTER (c.section_key = d.own AND {FORCE} AND {RECORD}) AS right_version FROM found f JOIN dated d USING (question_id) JOIN chunks c USING (chunk_id) GROUP BY scope""")
def vec_headline(spark, sf_dir):
    chunks, asked = derived.vector_chunks(spark, sf_dir), _dated(spark, sf_dir)
    right = temporal.holds(F.col("valid_from"), F.col("valid_to"), F.col("valid_at")) & temporal.holds(F.col("recorded_at"), F.col("recorded_until"), F.col("known_at"))
    found = None
    for scope in ("all", "one_clock", "as_of"):
        best = retrieval.batch_nearest(chunks, asked, 1, scope).select(F.lit(scope).alias("scope"), "question_id", "chunk_id")
        found = best if found is None else found.unionByName(best)
    rows = found.join(chunks.drop("embedding", "text"), "chunk_id").join(asked.drop("embedding"), "question_id")
    same = F.col("section_key") == F.col("own")
    return rows.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(same).alias("right_section"), F.count_if(same & right).alias("right_version"))


@query(f"""WITH r AS (SELECT * FROM ({SQL['resolve_question']})), c AS (SELECT *, (conv_id + turn) % 3 AS k FROM r),
e AS (SELECT conv_id || '/' || turn AS case_id, outcome, CASE k WHEN 0 THEN 'stated' WHEN 1 THEN 'assumed-today' ELSE 'ambiguous-date' END AS expected, CASE WHEN k = 1 THEN '2026-06-01' END AS day, k = 0 AS moves, valid_at, known_at IS NOT NULL AND known_at <> TIMESTAMP '{NOW}' AS moved FROM c)
SELECT case_id, expected, outcome, CASE WHEN outcome = expected AND (day IS NULL OR valid_at IS NOT DISTINCT FROM day) AND moved = moves THEN 'ok' ELSE 'REGRESSION' END AS status FROM e""")
def gate_resolutions(spark, sf_dir):
    return gate.resolution_scored(_resolution_cases(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("case_id", "expected", "outcome", "status")


def _resolution_cases(spark, sf_dir) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 3
    expected = F.when(k == 0, dates.STATED).when(k == 1, dates.ASSUMED).otherwise(dates.AMBIGUOUS)
    return _questions(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("case_id"), "question", expected.alias("expected"), F.when(k == 1, F.lit("2026-06-01").cast("date")).alias("valid_at"), (k == 0).alias("moves_known_at"))


@query(GATE_SQL + f""", res AS ({SQL['gate_resolutions']}) SELECT klass, count(*) AS n, count(*) FILTER (status = 'ok') AS passed FROM (SELECT klass, status FROM gate UNION ALL SELECT 'resolution', status FROM res) GROUP BY 1""")
def gate_all_outcomes(spark, sf_dir):
    answers = gate.scored(_cases(spark, sf_dir).withColumn("case_id", F.col("case_id").cast("string")), _answers(spark, sf_dir).withColumn("question_id", F.col("question_id").cast("string")))
    return gate.by_class(gate.all_outcomes(answers, gate.resolution_scored(_resolution_cases(spark, sf_dir), F.lit(NOW).cast("timestamp"))))


@query(f"SELECT count(*) AS replayed, count(*) FILTER (verdict = 'reproduced') AS reproduced FROM ({SQL['replay_verdict']})")
def replayed_count(spark, sf_dir):
    return gate.replayed(replay_verdict(spark, sf_dir))


_STRICT_SQL = ASK_SQL.replace("nearest > 0.7", "nearest > 0.4").replace("ld <= 0.7", "ld <= 0.4")


@query(GATE_SQL + f""", strict AS (SELECT question_id FROM ({_STRICT_SQL} SELECT question_id, outcome, answer_text, own FROM answers JOIN asked USING (question_id))
  WHERE NOT (outcome = CASE WHEN (question_id / 20)::INT % 5 >= 3 THEN 'ambiguous-date' ELSE 'answered' END AND (outcome <> 'answered' OR contains(answer_text, 'section ' || own))))
SELECT 'strict-floor' AS break_name, count(DISTINCT question_id) AS newly_red FROM strict WHERE question_id NOT IN (SELECT question_id FROM gate WHERE status <> 'ok') HAVING count(*) > 0""")
def ablation_newly_red(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    red = lambda options: gate.scored(cases, _answers(spark, sf_dir, options)).where("status <> 'ok'")
    return gate.newly_failed(red(plan.Options(floor=0.4)).withColumn("break_name", F.lit("strict-floor")), red(ENGINE))


def _mixed(vectors: DataFrame, rows: DataFrame, near: Column, far: Column, share: float) -> DataFrame:
    """``rows`` with a vector that lies near one of 500 stored vectors, moved a little towards another.

    No other stored vectors can meet a remainder, so those travel to the rows and no row with a vector is shuffled.
    """
    met = vectors.where(F.abs("vec_id") < 500)
    a = met.select(F.col("vec_id").alias("_a"), F.col("embedding").cast("array<double>").alias("_x"))
    b = met.select(F.col("vec_id").alias("_b"), F.col("embedding").cast("array<double>").alias("_y"))
    joined = rows.withColumns({"_a": near % 500, "_b": far % 500}).join(F.broadcast(a), "_a").join(F.broadcast(b), "_b")
    return joined.withColumn("embedding", F.zip_with("_x", "_y", lambda x, y: x + F.lit(share) * y)).drop("_a", "_b", "_x", "_y")


def _documents_with_clauses(spark, sf_dir) -> DataFrame:
    log = derived.event_log(spark, sf_dir)
    clause = F.struct(F.col("section_key").alias("section"), F.lit(None).cast("string").alias("heading"), "text", "valid_from", "valid_to")
    grouped = log.groupBy("document_id", "kind").agg(F.array_sort(F.collect_list(F.struct("clause_no", clause.alias("c")))).alias("cs"))
    return grouped.select(F.col("document_id").alias("doc_id"), "kind", F.concat(F.lit("Event "), "document_id").alias("title"), F.lit("Noted.").alias("body"), F.transform("cs", lambda c: c["c"]).alias("clauses"))


_MIX_SQL = "list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE + {share}::DOUBLE * b.embedding[i]::DOUBLE)"
_HEADLINE_SQL = f"""WITH {VERSIONS_SQL},
vectors AS (SELECT document_id, section_key, {_MIX_SQL.format(share=0.05)} AS v FROM log JOIN embeddings a ON a.vec_id = section_key::BIGINT * 7 % 500 JOIN embeddings b ON b.vec_id = document_id::BIGINT % 500),
cases AS (SELECT section_key AS question_id, section_key AS own, version_id, document_id AS source, {_MIX_SQL.format(share=0.02)} AS q
  FROM versions JOIN embeddings a ON a.vec_id = section_key::BIGINT * 7 % 500 JOIN embeddings b ON b.vec_id = section_key::BIGINT * 3 % 500 WHERE {holds_sql(AT)} AND {known_sql(AT)}),
published AS (SELECT document_id || ':' || section_key AS chunk_id, section_key, document_id, v FROM vectors),
every AS (SELECT version_id AS chunk_id, n.section_key, document_id, v FROM versions n JOIN vectors USING (document_id)),
current AS (SELECT * FROM every WHERE chunk_id IN (SELECT version_id FROM versions WHERE {holds_sql(AT)} AND {known_sql(AT)})),
pool AS (SELECT 'published' AS index_name, * FROM published UNION ALL SELECT 'versions', * FROM every UNION ALL SELECT 'as_of', * FROM current),
ranked AS (SELECT * FROM (SELECT index_name, c.*, p.chunk_id, p.section_key, p.document_id, row_number() OVER (PARTITION BY index_name, question_id ORDER BY {DISTANCE.format(q='q')}, p.chunk_id) AS rank FROM cases c, pool p) WHERE rank <= 5),
hits AS (SELECT *, CASE WHEN index_name = 'published' THEN section_key = own AND document_id = source ELSE chunk_id = version_id END AS correct FROM ranked),
scores AS (SELECT index_name, question_id, min(rank) FILTER (correct) AS correct_rank, count(section_key) > count(DISTINCT section_key) AS blended, bool_or(rank = 1 AND section_key = own AND NOT correct) AS superseded FROM hits GROUP BY ALL)
SELECT index_name, count(*) AS n, count(*) FILTER (correct_rank = 1) AS top1, count(correct_rank) AS recalled, count(*) FILTER (superseded) AS superseded, count(*) FILTER (blended) AS blended FROM scores GROUP BY index_name"""


@query(_HEADLINE_SQL)
def idx_headline(spark, sf_dir):
    """The published index, the index of all versions, and all versions under the clocks, searched for the rule in force."""
    from tidemark.sources.corpus import version_index

    vectors, v = table(spark, sf_dir, "embeddings"), versions(spark, sf_dir).persist()  # folded once for all indexes and cases
    section, document = F.col("section_key").cast("long"), F.col("document_id").cast("long")
    published = _mixed(vectors, published_index(_documents_with_clauses(spark, sf_dir)), section * 7, document, 0.05)
    every = _mixed(vectors, version_index(v, "valid_from", "valid_to", "recorded_at", "recorded_until"), section * 7, document, 0.05)
    force = temporal.as_of(v, AT).select(F.col("section_key").alias("question_id"), "section_key", F.col("version_id").alias("chunk_id"), "document_id")
    cases = _mixed(vectors, force, section * 7, section * 3, 0.02).withColumns({"valid_at": F.lit(AT.valid_at), "known_at": temporal.moment(AT, v)})
    return headline({"published": (published, exact(published), False), "versions": (every, exact(every), True), "as_of": (every, exact(every, "as_of"), True)}, cases)


def _broken_sql(name: str) -> str:
    """``ASK_SQL`` of an engine without one layer."""
    best, fixed = _batch_sql("best", f"{FORCE} AND {RECORD}", 3, "d"), "resolution = 'ambiguous-date'"
    tops = {"drop-temporal-predicate": "d.valid_at IS NOT NULL", "collapse-two-clocks": f"c.recorded_until IS NULL AND {FORCE}"}
    lapse = "coalesce(nearest - ld > 0.05 AND ld <= 0.7 AND ls <> section, false)"
    sql = ASK_SQL
    if name in tops:
        sql = sql.replace(best, _batch_sql("best", tops[name], 3, "d"))
    elif name == "post-filter":
        sql = sql.replace(best, _batch_sql("any_", "d.valid_at IS NOT NULL", 3, "d") + f""", best AS (SELECT a.question_id, a.chunk_id, a.section_key, a.distance, row_number() OVER (PARTITION BY a.question_id ORDER BY a.rank)::INT AS rank
  FROM any_ a JOIN d USING (question_id) JOIN chunks c USING (chunk_id) WHERE {FORCE} AND {RECORD})""")
    elif name == "default-missing-date-to-today":
        today = f"SELECT i, question, 'assumed-today' AS resolution, DATE '2025-06-01' AS valid_at, TIMESTAMP '{ASKED_AT}' AS known_at, NULL AS reason FROM fixed_ WHERE {fixed}"
        sql = sql.replace("fixed AS (", "fixed_ AS (", 1).replace("\nd AS (SELECT", f"\nfixed AS (SELECT * FROM fixed_ WHERE NOT ({fixed}) UNION ALL {today}),\nd AS (SELECT", 1)
    elif name == "drop-distance-floor":
        sql = sql.replace("nearest > 0.7", "nearest > 1.0").replace("ld <= 0.7", "ld <= 1.0")
    elif name == "drop-lapse-detector":
        sql = sql.replace(lapse, "false")
    elif name == "drop-coverage-check":
        sql = sql.replace(f"(SELECT CASE WHEN bool_or({FORCE} AND {RECORD}) THEN 2 WHEN bool_or({RECORD}) THEN 1 ELSE 0 END FROM chunks c) AS cov", "2 AS cov")
    elif name == "fixed-fence-token":
        sql = sql.replace("|| a.question_id), 1, 16) AS tok", "|| 'fixed'), 1, 16) AS tok").replace("|| question_id), 1, 16) AS fence_token", "|| 'fixed'), 1, 16) AS fence_token")
    cited = "0" if name == "drop-citation-storage" else "n_citations"
    return f"SELECT '{name}' AS engine, question_id, outcome, answer_text, prompt_sha256, fence_token, {cited} AS cited FROM ({sql} SELECT * FROM answers)"


_RED = """outcome IS DISTINCT FROM CASE WHEN (question_id / 20)::INT % 5 >= 3 THEN 'ambiguous-date' ELSE 'answered' END OR (outcome = 'answered' AND NOT contains(answer_text, 'section ' || own))"""


@query(f"""WITH told AS ({' UNION ALL '.join(_broken_sql(n) for n in ('whole', *plan.BREAKS))}),
rows AS (SELECT t.*, {_RED} AS red FROM told t JOIN (SELECT vec_id AS question_id, label::VARCHAR AS own FROM embeddings WHERE vec_id % 20 = 0) USING (question_id))
SELECT b.engine AS break_name, count(*) FILTER (b.red AND NOT w.red) AS newly_red,
  count(*) FILTER ((b.outcome, b.answer_text, b.prompt_sha256, b.fence_token, b.cited) IS DISTINCT FROM (w.outcome, w.answer_text, w.prompt_sha256, w.fence_token, w.cited)) AS changed
FROM rows b JOIN rows w USING (question_id) WHERE b.engine <> 'whole' AND w.engine = 'whole' GROUP BY 1""")
def ablation_ten(spark, sf_dir):
    """Every named break of the engine, asked together in one plan."""
    engines = {"whole": ENGINE} | {name: plan.broken(name, **({} if name == "drop-distance-floor" else {"floor": 0.7})) for name in plan.BREAKS}
    asked = derived.vector_questions(spark, sf_dir).drop("section_key")
    answers = plan.ask_each(asked, derived.vector_chunks(spark, sf_dir), _documents(spark, sf_dir), F.lit(ASKED_AT).cast("timestamp"), engines)
    return gate.ablation_matrix(_cases(spark, sf_dir), answers, "whole")


@query(f"""WITH {VERSIONS_SQL} SELECT section_key, count(*) FILTER ({holds_sql(AT)} AND {known_sql(AT)}) AS in_force FROM versions GROUP BY 1""")
def bt_exactly_one(spark, sf_dir):
    """How many versions of each section are in force, an error beyond one."""
    v = versions(spark, sf_dir)
    force = temporal.holds(F.col("valid_from"), F.col("valid_to"), F.lit(AT.valid_at)) & temporal.holds(F.col("recorded_at"), F.col("recorded_until"), temporal.moment(AT, v))
    return v.groupBy("section_key").agg(F.count_if(force).alias("n")).select("section_key", constraints.exactly_one(F.col("n"), "version in force").alias("in_force"))


@query("""WITH texts AS (SELECT DISTINCT sha256(text) AS text_sha, text FROM documents WHERE text IS NOT NULL)
SELECT text_sha, 'letters-26' AS model, list_transform(range(26), lambda i: (length(text) - length(replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr((97 + i)::INT), '')))::VARCHAR).array_to_string(',') AS counts FROM texts""")
def src_embedded(spark, sf_dir):
    """The distinct texts through a registered embedder."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), "text")
    made = embed(texts, "letters-26", 26)
    return made.select("text_sha", "model", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("counts"))
