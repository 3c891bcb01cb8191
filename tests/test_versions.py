"""The version fold against golden rows and against a plain sequential model."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import constraints
from tidemark.operators.versions import ingest_new, rebuild_versions
from tidemark.sources.corpus import clause_log, read_documents

CORPUS = f"{__file__.rpartition('/')[0]}/corpus"
LOG = "section_key string, kind string, recorded_at timestamp, document_id string, clause_no int, text string, valid_from date, valid_to date"


def model(log):
    """Rows of one section applied one document at a time to a list of versions."""
    rows, out = [], []
    seen = None
    for _, kind, t, doc, _, text, start, end in sorted(log, key=lambda r: (r[2], r[3], r[4])):
        if kind == "correction" and doc != seen:
            for r in rows:
                r["until"] = t
            rows = []
        seen, sup = doc, None
        if kind == "amendment":
            hit = sorted((r for r in rows if r["end"] is None or r["end"] > start), key=lambda r: r["start"])
            for r in hit:
                r["until"] = t
                rows.remove(r)
                sup = r["no"] if r["start"] <= start else sup
                if r["start"] < start:
                    rows.append({**r, "no": len(out) + 1, "end": start, "t": t, "until": None, "sup": None})
                    out.append(rows[-1])
            end = None
        rows.append({"no": len(out) + 1, "text": text, "start": start, "end": end, "t": t, "until": None, "doc": doc, "sup": sup})
        out.append(rows[-1])
    return out


def test_fold_equals_sequential_model(spark):
    rng, log = random.Random(5), []
    for s in range(60):
        day, n = date(2025, 1, 1), rng.randint(1, 14)
        for d in range(n):
            t, start = datetime(2025, 1, 1) + timedelta(hours=d * 7 + 1), day + timedelta(days=rng.randint(0, 30))
            kind = "base" if d == 0 else rng.choice(["amendment"] * 4 + ["correction"])
            doc = f"d{d:02d}"
            if kind == "correction":
                gap = rng.choice([0, 3])
                log.append((f"s{s}", kind, t, doc, 0, f"{s}/{d}a", start, start + timedelta(days=8)))
                log.append((f"s{s}", kind, t, doc, 1, f"{s}/{d}b", start + timedelta(days=8 + gap), rng.choice([None, start + timedelta(days=20)])))
            else:
                log.append((f"s{s}", kind, t, doc, 0, f"{s}/{d}", start, rng.choice([None, start + timedelta(days=15)]) if kind == "base" else None))
    versions = rebuild_versions(spark.createDataFrame(log, LOG)).cache()
    got = {(r.section_key, r.version_no): (r.text, r.valid_from, r.valid_to, r.recorded_at, r.recorded_until, r.document_id, r.supersedes) for r in versions.collect()}
    want = {}
    for s in {r[0] for r in log}:
        for r in model([x for x in log if x[0] == s]):
            want[(s, r["no"])] = (r["text"], r["start"], r["end"], r["t"], r["until"], r["doc"], f"{s}@v{r['sup']}" if r["sup"] else None)
    assert got == want
    assert constraints.overlaps(versions).count() == 0
    assert constraints.bad_intervals(versions).count() == 0


def test_rule_book_of_the_baths(spark):
    docs = read_documents(spark, CORPUS)
    assert [r.doc_id for r in docs.collect()] == ["CHARTER", "ANNEX", "AUTUMN", "AUDIT", "EVENINGS", "NOTICE"]
    rows = rebuild_versions(clause_log(docs)).orderBy("section_key", "version_no").collect()
    spans = {}
    for r in rows:
        spans.setdefault(r.section_key, []).append(f"{r.valid_from}/{r.valid_to or ''} {r.document_id}{' closed' if r.recorded_until else ''}{f' for {r.supersedes}' if r.supersedes else ''}")
    split = lambda a, b, old, new, section: [f"{a}/ {old} closed", f"{a}/{b} {old}", f"{b}/ {new} for {section}@v1"]
    lockers = split("2031-03-01", "2031-10-01", "CHARTER", "AUTUMN", "lockers")
    assert spans == {
        "sauna": ["2031-03-01/2031-11-01 CHARTER"],
        "lanes": split("2031-03-01", "2031-10-01", "CHARTER", "AUTUMN", "lanes"),
        "cafe": split("2031-07-01", "2031-09-01", "ANNEX", "EVENINGS", "cafe"),
        "towels": split("2031-08-15", "2032-04-01", "ANNEX", "NOTICE", "towels"),
        "lockers": [lockers[0], "2031-03-01/2031-10-01 CHARTER closed", "2031-10-01/ AUTUMN closed for lockers@v1", "2031-03-01/2031-05-01 AUDIT", "2031-05-01/2031-10-01 AUDIT", "2031-10-01/ AUDIT"],
    }


def test_ingest_is_idempotent(spark):
    docs = read_documents(spark, CORPUS)
    twice = docs.unionByName(docs)
    assert clause_log(twice).count() == clause_log(docs).count()
    assert ingest_new(docs.where("doc_id <> 'AUDIT'"), twice).select("doc_id").collect()[0][0] == "AUDIT"


def test_plan_has_one_shuffle(spark):
    from tidemark.sources.derived import event_log

    spark.catalog.clearCache()
    plan = rebuild_versions(event_log(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(section_key") == 1


def test_null_start_is_an_error_and_empty_log_is_empty(spark):
    empty = spark.createDataFrame([], LOG)
    assert rebuild_versions(empty).count() == 0
    bad = spark.createDataFrame([("s", "base", datetime(2025, 1, 1), "d", 0, "x", None, None)], LOG)
    with pytest.raises(Exception, match="valid_from is null"):
        rebuild_versions(bad).collect()


def test_overlap_on_one_clock_is_fine(spark):
    row = lambda no, start, end, t, until: ("s", no, date(2025, 1, start), date(2025, 1, end), datetime(2025, 1, t), datetime(2025, 1, until) if until else None)
    schema = "section_key string, version_no int, valid_from date, valid_to date, recorded_at timestamp, recorded_until timestamp"
    fine = [row(1, 1, 10, 1, 5), row(2, 1, 10, 5, None), row(3, 10, 20, 6, None)]
    assert constraints.overlaps(spark.createDataFrame(fine, schema)).count() == 0
    clash = fine + [row(4, 9, 12, 7, None)]
    assert [r.version_no for r in constraints.overlaps(spark.createDataFrame(clash, schema)).collect()] == [4]
    counts = constraints.counted(a=constraints.duplicates(spark.createDataFrame(clash + clash, schema), "section_key", "version_no"), b=constraints.bad_intervals(spark.createDataFrame([row(1, 5, 5, 1, None)], schema)))
    assert {r.constraint_name: r.violations for r in counts.collect()} == {"a": 4, "b": 1}


def test_exactly_one(spark):
    one = spark.range(1).select(constraints.exactly_one(F.lit(1).cast("long"), "row").alias("n"))
    assert one.first()["n"] == 1
    with pytest.raises(Exception, match="more than one row"):
        spark.range(1).select(constraints.exactly_one(F.lit(2).cast("long"), "row").alias("n")).collect()


def test_clock_filters_and_pruned_columns_reach_the_scan(spark, tmp_path):
    from datetime import UTC

    from tidemark.clock import AsOf
    from tidemark.operators.temporal import as_of
    from tidemark.sources.derived import event_log

    rebuild_versions(event_log(spark, DATA)).write.parquet(f"{tmp_path}/v")
    read = as_of(spark.read.parquet(f"{tmp_path}/v"), AsOf(date(2024, 1, 5), datetime(2024, 1, 10, tzinfo=UTC))).select("section_key", "version_no")
    plan = read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert all(c in pushed for c in ("LessThanOrEqual(valid_from", "Or(IsNull(valid_to)", "LessThanOrEqual(recorded_at", "Or(IsNull(recorded_until)"))
    assert "text:" not in next(line for line in plan.splitlines() if "ReadSchema" in line)
