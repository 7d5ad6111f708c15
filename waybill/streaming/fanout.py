"""Several typed outputs of one pass, one sink each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waybill.operators.facts import TOPICS
from waybill.operators.snapshots import SLOT


def fan_out(batch: DataFrame, root: str, batch_id: int, fmt: str = "parquet", by: str = "fact", prefix: str = "", key: str = "order_id", **options: str) -> None:
    """Write the rows of a micro-batch to the sink their `by` column names, all in one job.

    On a broker the sinks are topics (`prefix` before the names of TOPICS) and the rows JSON text, keyed by `key` so that those of one
    waybill stay in order; otherwise they are folders, and a repeated batch replaces what it wrote before.
    """
    if fmt == "kafka":
        topics = F.create_map(*[F.lit(part) for pair in TOPICS.items() for part in pair])
        rest = [c for c in batch.columns if c != by]
        keyed = [F.col(key).cast("string").alias("key")] if key in batch.columns else []
        messages = batch.select(F.concat(F.lit(prefix), topics[F.col(by)]).alias("topic"), *keyed, F.to_json(F.struct(*rest)).alias("value"))
        messages.write.format("kafka").options(**options).save()
    else:
        target = f"{root.rstrip('/')}/batch_id={batch_id}"
        batch.write.format(fmt).options(**options).mode("overwrite").partitionBy(by).save(target)


def start_fan_out(
    df: DataFrame, root: str, checkpoint: str, fmt: str = "parquet", trigger: dict | None = None, **options: str
) -> StreamingQuery:
    """Run `fan_out` on every micro-batch of a stream."""
    writer = df.writeStream.foreachBatch(lambda batch, batch_id: fan_out(batch, root, batch_id, fmt, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": SLOT})).start()


def read_sink(spark: SparkSession, root: str, name: str, by: str = "fact") -> DataFrame:
    """Rows of one sink; only its folders are read."""
    return spark.read.parquet(root).where(F.col(by) == name).drop("batch_id", by)
