import pytest
from pyspark.sql import functions as F

from leafwright.common import new_folder
from leafwright.operators.incremental import VersionedTable, diff_manifests, due_files, process

LISTING = "scan_id int, name string, checksum string, listed_at string, extra string"
LEDGER = "log_id long, name string, checksum string, status string, ts string, recorded_at string, scan_id int"


def test_due_files(spark):
    listing = spark.createDataFrame(
        [
            (1, "gone", "x", "1", ""), (2, "new", "AA", "1", ""), (2, "same", "sha256:BB", "1", ""), (2, "changed", "cc", "1", ""), (2, "changed", "dd", "2", ""),
            (2, "failed", "ee", "1", ""), (2, "unknown", None, "1", ""), (2, "same", "sha256:BB", "1", ""), (2, "late", "ff", "1", ""),
        ],
        LISTING,
    )
    ledger = spark.createDataFrame(
        [
            (1, "same", "bb", "Completed", "1", "1", 0), (2, "changed", "cc", "completed", "1", "1", 0), (3, "failed", "ee", "error", "1", "1", 0),
            (4, "unknown", "gg", "completed", "1", "1", 0), (5, "late", "ff", "completed", "2", "1", 0), (6, "late", "old", "completed", "1", "9", 0), (5, "late", "ff", "completed", "2", "1", 0),
        ],
        LEDGER,
    )
    assert {r.name: r.change for r in due_files(listing, ledger).collect()} == {"new": "added", "changed": "changed", "failed": "added", "unknown": "changed"}
    assert due_files(listing.limit(0), ledger).count() == 0 and due_files(listing, ledger.limit(0)).count() == 6


def test_diff_empty_and_null(spark):
    a = spark.createDataFrame([("k", "1"), (None, "1"), ("n", None)], "k string, f string")
    assert {(r.k, r.change) for r in diff_manifests(a, a, "k", "f").collect()} == {("n", "changed")}
    assert diff_manifests(a.limit(0), a.limit(0), "k", "f").count() == 0


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_and_deletion_vectors(spark):
    t = VersionedTable(spark, new_folder(spark, "table"))
    assert t.version() == 0 and t.manifest()["files"] == []
    t.commit(added=spark.range(10).withColumn("v", F.lit("a")))
    t.commit(delete=lambda df: df.where("id < 3"))
    t.commit(added=spark.range(100, 102).withColumn("v", F.lit("b")), delete=lambda df: df.where("id = 9"))
    assert [r[0] for r in rows(t.read())] == [3, 4, 5, 6, 7, 8, 100, 101] and t.read(1).count() == 10
    assert rows(t.changes(2, 3).select("id", "_change")) == [(9, "removed"), (100, "added"), (101, "added")]
    assert rows(t.changes(0, 3).select("id", "_change")) == [(i, "added") for i in (3, 4, 5, 6, 7, 8, 100, 101)]
    assert t.changes(3, 3) is None
    t.replace(t.read())
    assert t.read().count() == 8 and {r[0] for r in t.changes(3, 4).groupBy("_change").count().select("count").collect()} == {8}


def test_process_neither_skips_nor_repeats(spark):
    source, sink = VersionedTable(spark, new_folder(spark, "source")), VersionedTable(spark, new_folder(spark, "sink"))
    f = lambda df: df.select("id", "_change")
    source.commit(added=spark.range(5).toDF("id"))
    process(source, sink, f)
    source.commit(added=spark.range(5, 7).toDF("id"))
    source.commit(delete=lambda df: df.where("id = 0"))

    def fails(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        process(source, sink, fails)
    process(source, sink, f)
    process(source, sink, f)
    got = rows(sink.read())
    assert got == sorted([(i, "added") for i in range(7)] + [(0, "removed")])
    assert sink.manifest()["processed"] == {source.path: 3}


def test_commits_dont_overwrite(spark):
    t = VersionedTable(spark, new_folder(spark, "race"))
    t.commit(added=spark.range(1))
    with pytest.raises(RuntimeError):
        t._commit(1, {"files": [], "deleted": [], "processed": {}})


def test_changes_open_only_the_files_named(spark):
    t = VersionedTable(spark, new_folder(spark, "files"))
    for i in range(6):
        t.commit(added=spark.range(10 * i, 10 * i + 10).coalesce(1))
    at = t.commit(delete=lambda df: df.where("id in (3, 47)"))
    opened = []
    raw = t._raw
    t._raw = lambda files: opened.append(files) or raw(files)
    assert rows(t.changes(at - 1).select("id", "_change")) == [(3, "removed"), (47, "removed")]
    assert [len(f) for f in opened] == [2]


def test_manifests_hold_differences_and_vectors_are_put_together(spark, monkeypatch):
    from leafwright.operators import incremental

    monkeypatch.setattr(incremental, "SNAPSHOT", 4)
    monkeypatch.setattr(incremental, "MOST_VECTORS", 2)
    t = VersionedTable(spark, new_folder(spark, "long"))
    for i in range(7):
        t.commit(added=spark.range(5 * i, 5 * i + 5).coalesce(1), delete=lambda df, i=i: df.where(F.col("id") == i))
    assert [len(t._step(v)["files"]) for v in range(1, 8)] == [1, 1, 1, 1, 5, 1, 1]
    assert len(t.manifest()["deleted"]) <= 4 and [len(t.manifest(v)["files"]) for v in range(8)] == list(range(8))
    assert [r[0] for r in rows(t.read())] == [i for i in range(35) if i not in range(1, 7) or i == 0]
    assert rows(t.changes(3, 7).where("_change = 'removed'").select("id")) == [(3,), (4,), (5,), (6,)]


def test_merge_writes_only_what_differs(spark):
    t = VersionedTable(spark, new_folder(spark, "merge"))
    table = lambda *r: spark.createDataFrame(list(r), "k string, f string")
    t.merge(table(("a", "1"), ("b", "1"), ("c", None)), "k", "f")
    t.merge(table(("a", "1"), ("b", "2"), ("d", "1"), ("c", None)), "k", "f")
    assert rows(t.changes(1).select("k", "_change")) == [("b", "added"), ("b", "removed"), ("c", "added"), ("c", "removed"), ("d", "added")]
    assert sorted(r.k for r in t.read().collect()) == ["a", "b", "c", "d"]


def test_taking_due_files_neither_skips_nor_repeats(spark, monkeypatch):
    from leafwright.operators import incremental

    listing = spark.createDataFrame([(2, "new", "AA", "1", ""), (2, "same", "sha256:BB", "1", ""), (2, "changed", "cc", "1", ""), (2, None, "zz", "1", "")], LISTING)
    ledger = spark.createDataFrame([(1, "same", "bb", "Completed", "1", "1", 0), (2, "changed", "c0", "completed", "1", "1", 0), (3, "gone", "ee", "completed", "1", "1", 0)], LEDGER)
    source, sink = VersionedTable(spark, new_folder(spark, "folder")), VersionedTable(spark, new_folder(spark, "taken"))
    real, calls = sink.commit, []

    def failing(**k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(**k)

    sink.commit = failing
    with pytest.raises(RuntimeError):
        incremental.take_due(listing, ledger, source, sink)
    take = lambda new: {r.name for r in incremental.take_due(new, ledger, source, sink).collect()}
    assert take(listing) == {"new", "changed"} == {r.name for r in due_files(listing, ledger).collect()}
    assert take(listing) == set()
    later = listing.unionByName(spark.createDataFrame([(3, "new", "AA", "3", ""), (3, "newer", "11", "3", ""), (3, "same", "b2", "3", "")], LISTING))
    assert take(later) == {"newer", "same"}
    assert sorted(r.name for r in sink.read().where("due").collect()) == ["changed", "new", "newer", "same"]
