"""Streams over many files come in few micro-batches, whatever comes last."""

import pytest
from pyspark.sql import functions as F

from waybill.plans import catalog, standins, streams
from waybill.sources import files


@pytest.fixture
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "22")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def batches(stream, seen):
    streams.finish(stream.writeStream.foreachBatch(lambda batch, n: seen.append([r.id for r in batch.select("id").collect()])).trigger(availableNow=True).start())
    return seen


def table(spark, n):
    return spark.range(n).withColumn("ts", F.timestamp_millis(F.col("id") * 1000))


def test_late_rows_come_alone_after_a_batch_without_rows(many):
    """One batch for each of 22 files, and late rows in one file, before."""
    df, late = table(many, 2200), table(many, 700).withColumn("id", F.col("id") + 10_000)
    *first, blank, last = batches(streams.as_stream(many, df, "late", late=late), [])
    assert len(first) == 5 and blank == []
    assert [min(b) for b in first] == sorted(min(b) for b in first) and sorted(sum(first, [])) == list(range(2200))
    assert sorted(last) == list(range(10_000, 10_700))


def test_a_copied_file_reads_as_the_first(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a"))
    (name,) = files.names(spark, str(tmp_path / "a"))
    files.copy(spark, str(tmp_path / "a" / name), str(tmp_path / "a" / f"k-{name}"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6


def test_a_topic_is_kept_once_and_packed(spark, sf_dir, tmp_path, monkeypatch):
    """The topic and what is read from it take less than a third of its text; both were as large as the text before."""
    monkeypatch.setattr(catalog, "shared_dir", lambda _, purpose: str(tmp_path / purpose))
    size = lambda folder: sum(f.stat().st_size for f in (tmp_path / folder).rglob("*") if f.is_file())
    text = standins.order_log(spark, sf_dir).agg(F.sum(F.length("value"))).first()[0]
    catalog.topic_round_trip(spark, sf_dir)
    assert size("topic-log") + size("topic-read") < text / 3
