"""Tables of versions: folds beside a writer, bounded reading, repeated batches."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from waybill.sources import files
from waybill.sources.versions import VersionedTable

SCHEMA = StructType([StructField("day", DateType()), StructField("k", StringType()), StructField("n", LongType()), StructField("ts", LongType())])


def store(tmp_path, partition="day"):
    return VersionedTable(str(tmp_path / "t"), SCHEMA, ["day", "k"], ["ts"], partition)


def rows(spark, *given):
    return spark.createDataFrame([(date(2024, 1, d), k, n, ts) for d, k, n, ts in given], SCHEMA)


def read(table, spark):
    return sorted((r.day.day, r.k, r.n) for r in table.read(spark).collect())


@pytest.mark.parametrize("partition", ["day", None])
def test_newest_version_wins_whatever_is_folded(spark, tmp_path, partition):
    t = store(tmp_path, partition)
    assert read(t, spark) == []
    t.fold(spark)
    t.write(rows(spark, (1, "a", 1, 10), (1, "b", 1, 10), (2, "a", 5, 10)), 0)
    t.write(rows(spark, (1, "a", 2, 20), (1, "b", 0, 5)), 1)
    want = [(1, "a", 2), (1, "b", 1), (2, "a", 5)]
    assert read(t, spark) == want
    t.fold(spark)
    assert read(t, spark) == want and t.committed(spark) == 1
    t.write(rows(spark, (2, "a", 6, 20), (3, "c", 7, 1)), 2)
    for _ in range(2):
        t.write(rows(spark, (2, "a", 7, 20)), 3)  # a tie: the later batch counts
    want = [(1, "a", 2), (1, "b", 1), (2, "a", 7), (3, "c", 7)]
    assert read(t, spark) == want
    t.fold(spark, 2)
    assert read(t, spark) == want
    t.write(rows(spark), 4)
    t.fold(spark)
    t.fold(spark)
    assert read(t, spark) == want and t.committed(spark) == 4


def test_a_batch_stored_while_a_fold_is_written_is_not_lost(spark, tmp_path, monkeypatch):
    t = store(tmp_path)
    t.write(rows(spark, (1, "a", 1, 1)), 0)
    before = t.versions(spark)
    mark = files.mark

    def late(session, path):
        # Between the fold's reading and its commit.
        t.write(rows(spark, (1, "a", 9, 9), (2, "b", 1, 1)), 1)
        mark(session, path)

    monkeypatch.setattr(files, "mark", late)
    t.fold(spark)
    assert t.committed(spark) == 0
    assert read(t, spark) == [(1, "a", 9), (2, "b", 1)]
    # A reader that began before the commit still finds its files.
    assert before.count() == 1


def test_an_uncommitted_fold_is_not_read(spark, tmp_path):
    t = store(tmp_path)
    t.write(rows(spark, (1, "a", 1, 1)), 0)
    rows(spark, (1, "a", 99, 99)).write.parquet(f"{t.path}/folds/batch_id=0")
    assert read(t, spark) == [(1, "a", 1)]
    t.fold(spark)
    assert read(t, spark) == [(1, "a", 1)]


def test_what_is_read_and_kept_stays_bounded(spark, tmp_path):
    t = store(tmp_path)
    seen, kept = [], []
    for k in range(0, 12, 3):
        for b in range(k, k + 3):
            t.write(rows(spark, *[(d, x, b, b) for d in (1, 2) for x in "abc"]).coalesce(1), b)
        t.fold(spark)
        seen.append(len(t.versions(spark).inputFiles()))
        kept.append((len(t.batches(spark)), len(files.names(spark, f"{t.path}/folds")), len(files.names(spark, f"{t.path}/commits"))))
    assert seen[-1] == seen[-2] <= 4 and max(kept[1:]) <= (6, 3, 2)
    assert read(t, spark) == [(d, x, 11) for d in (1, 2) for x in "abc"]


def test_a_fold_leaves_days_nobody_changed(spark, tmp_path):
    t = store(tmp_path)
    t.write(rows(spark, *[(d, "a", d, 1) for d in range(1, 11)]), 0)
    t.fold(spark)
    t.write(rows(spark, (4, "a", 44, 2)), 1)
    t.fold(spark)
    assert files.names(spark, f"{t.path}/folds/batch_id=1") == ["day=2024-01-04"]
    assert read(t, spark) == [(d, "a", 44 if d == 4 else d) for d in range(1, 11)]
    for n in (2, 3):
        t.write(rows(spark, (4, "a", n, n + 1)), n)
        t.fold(spark)
    assert read(t, spark) == [(d, "a", 3 if d == 4 else d) for d in range(1, 11)]
    assert "day=2024-01-04" not in files.names(spark, f"{t.path}/folds/batch_id=0")


def test_dims_are_folded_while_the_stream_runs(spark, tmp_path):
    import json

    from waybill import schemas
    from waybill.plans.streams import as_stream, finish
    from waybill.streaming import dims

    log = [({"op": "u", "before": {"id": str(i % 3)}, "after": {"id": str(i % 3), "name": f"n{i}"}, "source": {"table": "a"}, "ts_ms": i}, i) for i in range(24)]
    raw = as_stream(spark, spark.createDataFrame([(json.dumps(e), i) for e, i in log], "value string, at long"), "dims", ["at"], 8)
    config = spark.createDataFrame([("a", "dim_a", None, "id,name", "id", None)], schemas.CONFIG_DIM)
    root = str(tmp_path / "dims")
    finish(dims.start_dims(raw.select("value"), lambda: config, root, str(tmp_path / "ck"), {"availableNow": True}, fold_every=2))
    table = dims.dim_store(root)
    assert table.committed(spark) == 7 and len(table.batches(spark)) <= 4
    assert sorted(tuple(r) for r in dims.current_dim(spark, root, "dim_a", ["id", "name"]).collect()) == [("0", "n21"), ("1", "n22"), ("2", "n23")]


def test_a_fold_prunes_to_the_changed_days(spark, tmp_path):
    t = store(tmp_path)
    t.write(rows(spark, *[(d, "a", d, 1) for d in range(1, 11)]), 0)
    t.fold(spark)
    one = t.versions(spark).where(F.col("day") == date(2024, 1, 3))
    assert one.collect()[0].n == 3
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()
