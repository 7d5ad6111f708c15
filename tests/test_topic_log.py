"""The raw log of orders as it is written to topics."""

from pyspark.sql import functions as F

from waybill.plans import catalog, standins, streams
from waybill.session import shared_dir
from waybill.sources import changes, files


def test_log_of_arranged_changes(spark, sf_dir):
    """The messages are the same, made after the changes were put in order: parts follow each other in time and are sorted."""
    plain = standins.order_log(spark, sf_dir)
    runs = standins.order_log(spark, sf_dir, lambda changes: changes.repartitionByRange(5, "ts").sortWithinPartitions("ts"))
    assert runs.count() == plain.count() and runs.exceptAll(plain).isEmpty()
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "StructsToJson" in above and "StructsToJson" not in below
    at = F.get_json_object("value", "$.ts_ms").cast("long")
    parts = runs.select(at.alias("at"), F.spark_partition_id().alias("part")).collect()
    assert len({r.part for r in parts}) == 5
    assert [r.at for r in parts] == sorted(r.at for r in parts)


def test_rows_are_made_once_after_they_were_cut(spark):
    """Where runs begin is found on the rows before; what is made of them is made once, and lies in the run of its row."""
    made = spark.sparkContext.accumulator(0)

    def long(batches):
        for part in batches:
            made.add(len(part))
            yield part.assign(text=part["id"].astype(str) * 3)

    rows = spark.range(500).withColumn("ts", F.col("id") * -1)
    inbox, slices = streams.write_slices(
        spark, rows, "test-made", ["ts"], 5, made=lambda cut: cut.mapInPandas(long, "id bigint, ts bigint, slice int, text string"), compression="zstd")
    assert slices == 5 and made.value == 500
    found = spark.read.parquet(inbox)
    assert sorted((r.id, r.text) for r in found.collect()) == [(k, str(k) * 3) for k in range(500)]
    spans = found.groupBy("slice").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).orderBy("slice").collect()
    assert len(spans) == 5 and all(a["last"] < b["first"] for a, b in zip(spans, spans[1:]))


def test_every_third_part_is_sent_twice(spark, sf_dir):
    """The topic has all messages of the log, each at a place of its own, and a third of them again."""
    root = shared_dir(spark, "test").rpartition("/")[0]
    before = set(files.names(spark, root))
    twice = catalog.topic_twice(spark, sf_dir)
    topic, = [n for n in files.names(spark, root) if n.startswith("waybill-twice-log-") and n not in before]
    sent = spark.read.text(f"{root}/{topic}")
    place = changes.place_of(F.struct(*[F.get_json_object("value", f"$.source.{c}").alias(c) for c in ("file", "pos", "row")]))
    times = [r.n for r in sent.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()]
    log = standins.order_log(spark, sf_dir)
    assert len(times) == sent.distinct().count() == log.distinct().count() == log.count()
    assert set(times) == {1, 2} and 0 < times.count(2) < len(times)
    assert twice.count() == catalog.log_order_facts(spark, sf_dir).count()
