"""The store: one bucket a document, one winner a commit, nothing half done."""

import os

import pytest

from tidemark.operators.versions import rebuild_versions
from tidemark.plans.ingest import StaleStore, commit, documents_of, ingest, latest, prepare, versions_of
from tidemark.sources.corpus import clause_log, parse_documents


def doc(k, section="s", kind="amendment", start=None):
    head = f'---\nid: "{k}"\nkind: {kind}\ntitle: t\neffective_from: {start or f"2031-02-{k:02d}"}\nrecorded_at: 2031-01-{k:02d}T00:00:00\n'
    return head + f"{'sections' if kind == 'base' else 'amends'}:\n  - section: {section}\n    text: rule {k}\n---\nx"


@pytest.fixture
def docs(spark):
    return lambda *texts: parse_documents(spark.createDataFrame([(t,) for t in texts], "content string"))


def rows(df):
    return sorted(str(tuple(r)) for r in df.select("version_id", "text", "valid_from", "valid_to", "recorded_at", "recorded_until", "document_id", "supersedes").collect())


def test_one_document_rewrites_one_bucket(spark, docs, tmp_path):
    store = f"{tmp_path}/s"
    with pytest.raises(ValueError, match="nothing has been ingested"):
        versions_of(spark, store)
    first = [doc(k, f"s{k}", "base") for k in range(1, 13)]
    assert ingest(spark, docs(*first, first[0]), store, buckets=16) == 12 and ingest(spark, docs(*first), store) == 0
    before = latest(spark, store)
    assert before.number == 1 and before.buckets == 16 and len(before.versions) > 4
    assert ingest(spark, docs(doc(20, "s3"), first[2]), store) == 1
    after = latest(spark, store)
    changed = {b for b in after.versions if after.versions[b] != before.versions.get(b)}
    assert len(changed) == 1 and after.number == 2 and len(os.listdir(f"{store}/{after.log[-1]}/")) == len([*changed, "_SUCCESS", "._SUCCESS.crc"])
    assert rows(versions_of(spark, store)) == rows(rebuild_versions(clause_log(docs(*first, doc(20, "s3"))))) and documents_of(spark, store).count() == 13
    # a document recorded before others of its section is put in its place
    assert ingest(spark, docs(doc(15, "s3")), store) == 1
    assert rows(versions_of(spark, store)) == rows(rebuild_versions(clause_log(docs(*first, doc(20, "s3"), doc(15, "s3")))))


def test_offence_leaves_the_store_as_it_was(spark, docs, tmp_path):
    store = f"{tmp_path}/s"
    assert ingest(spark, docs(doc(1, kind="base")), store) == 1
    had = rows(versions_of(spark, store)), sorted(os.listdir(store))
    with pytest.raises(ValueError, match="overlap"):
        ingest(spark, docs(doc(2, kind="base"), doc(3, "other", "base")), store)
    assert (rows(versions_of(spark, store)), sorted(os.listdir(store))) == had and documents_of(spark, store).count() == 1


def test_losing_writer_fails_cleanly(spark, docs, tmp_path):
    store = f"{tmp_path}/s"
    assert ingest(spark, docs(doc(1, kind="base")), store) == 1
    mine, theirs = prepare(spark, docs(doc(2)), store), prepare(spark, docs(doc(3)), store)
    commit(spark, store, theirs)
    won = rows(versions_of(spark, store))
    with pytest.raises(StaleStore):
        commit(spark, store, mine)
    assert rows(versions_of(spark, store)) == won and mine.folder not in os.listdir(store)
    assert ingest(spark, docs(doc(2), doc(3)), store, retries=1) == 1
    assert rows(versions_of(spark, store)) == rows(rebuild_versions(clause_log(docs(doc(1, kind="base"), doc(2), doc(3)))))


def test_old_states_are_cleared(spark, docs, tmp_path):
    store = f"{tmp_path}/s"
    assert ingest(spark, docs(doc(1, kind="base")), store, buckets=1) == 1
    for k in range(2, 5):
        commit(spark, store, prepare(spark, docs(doc(k)), store), keep=2)
    assert [n for n in sorted(os.listdir(f"{store}/manifests")) if n.endswith("json")] == ["00000003.json", "00000004.json"]
    held = [c for c in os.listdir(store) if c.startswith("commit-") and os.path.isdir(f"{store}/{c}/versions/bucket=0")]
    assert len(held) == 2 and documents_of(spark, store).count() == 4
    assert rows(versions_of(spark, store)) == rows(rebuild_versions(clause_log(docs(doc(1, kind="base"), *(doc(k) for k in range(2, 5))))))


def test_a_name_is_created_once(spark, tmp_path):
    from tidemark.sources import files

    path = f"{tmp_path}/m/1.json"
    assert files.create_text(spark, path, "a ü") and not files.create_text(spark, path, "b")
    assert files.read_text(spark, path) == "a ü" and files.names(spark, f"{tmp_path}/m") == ["1.json"] or files.names(spark, f"{tmp_path}/m") == [".1.json.crc", "1.json"]
    files.delete(spark, path)
    assert files.names(spark, f"{tmp_path}/none") == []
