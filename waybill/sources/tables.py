"""Tables: dimension tables, the routing table and the serving tables of the summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators.routing import latest_by_key


def ensure_dim(spark: SparkSession, name: str, columns: str | list[str], location: str | None = None) -> None:
    """Create a dimension table unless it exists. All columns are text; `seq` orders the versions of
    a row and `batch_id` tells which micro-batch wrote them."""
    names = columns.split(",") if isinstance(columns, str) else list(columns)
    body = ", ".join(f"`{c}` string" for c in names) + ", seq bigint, batch_id bigint"
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({body}) USING parquet PARTITIONED BY (batch_id){at}")


def ensure_dims(spark: SparkSession, config: DataFrame) -> None:
    """Create the tables of all routing rows (one per dimension) that do not exist yet."""
    for row in config.select("sink_table", "sink_columns").toLocalIterator():
        ensure_dim(spark, row.sink_table, row.sink_columns)


def upsert_dim(batch: DataFrame, path: str, columns: list[str], batch_id: int, seq: str = "seq", table: str | None = None) -> None:
    """Write the new versions of dimension rows of one micro-batch.

    Only the batch is written, never the whole dimension. A repeated batch replaces its own folder,
    so a retry leaves the same table. `read_dim` gives one row per key. `table` is the catalog's name of the dimension, if `ensure_dim`
    made it at `path`: the batch is then one of its partitions.
    """
    rows = batch.select(*[F.col(c).cast("string").alias(c) for c in columns], F.col(seq).alias("seq"))
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    if table:
        spark = batch.sparkSession
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (batch_id = {batch_id})")
        spark.catalog.refreshTable(table)


def read_dim(spark: SparkSession, path: str, pk: str) -> DataFrame:
    """Current rows of a dimension: the greatest `seq` of each key wins."""
    versions = spark.read.parquet(path)
    # A row without a sequence number sorts first; the batch breaks ties.
    return latest_by_key(versions, [pk], ["seq", "batch_id"]).drop("seq", "batch_id")


def compact_dim(spark: SparkSession, path: str, target: str, pk: str) -> None:
    """Current rows of a dimension nobody writes to as the first folder of a new one; readers then switch over. Beside a writer, use
    `sources.versions.VersionedTable`."""
    versions = latest_by_key(spark.read.parquet(path), [pk], ["seq", "batch_id"]).drop("batch_id")
    versions.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id=-1")


def read_config(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Routing rows from a bounded scan (`fmt='jdbc'` for a database)."""
    reader = spark.read.format(fmt).options(**options)
    return reader.option("dbtable", source).load() if fmt == "jdbc" else reader.load(source)


def write_summary(
    df: DataFrame, target: str, columns: list[str], fmt: str = "parquet", batch_id: int | None = None, **options: str
) -> None:
    """Append summary rows to a serving table: the named columns in table order, helpers left out.

    Files of a micro-batch go to a folder of that batch, so a retried batch does not double them.
    """
    rows = df.select(*columns)
    if fmt == "jdbc":
        # Fixed value: rows per insert batch.
        rows.write.format("jdbc").options(**{"batchsize": "5000", "dbtable": target, **options}).mode("append").save()
    elif batch_id is None:
        rows.write.format(fmt).options(**options).mode("append").save(target)
    else:
        rows.write.format(fmt).options(**options).mode("overwrite").save(f"{target.rstrip('/')}/batch_id={batch_id}")
