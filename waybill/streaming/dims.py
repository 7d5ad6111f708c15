"""Dimension branch as a stream: routed rows of all dimensions in one write per micro-batch, compacted while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from waybill.operators.routing import ROUTING, dim_rows, latest_by_key, loaded_versions, route_dims, route_dims_as_of, routing_versions
from waybill.operators.snapshots import SLOT
from waybill.schemas import DIM_IMAGE
from waybill.sources.changes import dim_changes, routing_changes
from waybill.sources.tables import ensure_dim, upsert_dim
from waybill.sources.versions import BATCH, VersionedTable

# Micro-batches after which the stored versions are folded together.
FOLD_EVERY = 10

_ROW = StructType([
    StructField("sink_table", StringType()), StructField("row_key", StringType()), StructField("columns", DIM_IMAGE),
    StructField("ts", LongType()), StructField("place", StringType())])


def dim_store(root: str) -> VersionedTable:
    """Versions of the rows of all dimensions; a fold has a folder for each dimension."""
    return VersionedTable(root, _ROW, ["sink_table", "row_key"], ["ts", "place"], "sink_table")


def store_dims(routed: DataFrame, root: str, batch_id: int) -> None:
    """Append routed rows; a repeated batch replaces its own rows."""
    dim_store(root).write(routed, batch_id)


def current_dim(spark: SparkSession, root: str, sink_table: str, columns: list[str]) -> DataFrame:
    """Current rows of one dimension: the newest version of each key."""
    store = dim_store(root)
    newest = store.newest(store.versions(spark).where(F.col("sink_table") == sink_table))
    return dim_rows(newest, sink_table, columns).drop("seq")


def start_dims(
    raw: DataFrame, config: Callable[[], DataFrame], root: str, checkpoint: str, trigger: dict | None = None, fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Route a raw stream into dimensions. `config` is called for every micro-batch, so routing
    changes apply while the stream runs. After every `fold_every` micro-batches (0: never) their versions are folded into one per key."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        store_dims(route_dims(dim_changes(batch), config()), root, batch_id)
        if fold_every and batch_id % fold_every == fold_every - 1:
            dim_store(root).fold(batch.sparkSession, batch_id)

    writer = raw.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": SLOT})).start()


def start_dim_tables(
    raw: DataFrame, loaded: DataFrame, name: Callable[[str], str], root: str, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """A raw stream of dimension and routing changes into catalog tables that the routing rows of the stream itself create.

    `loaded` are the routing rows of a bounded scan at the start; those of the stream come on top, from the next micro-batch on as from this one.
    A table is created when its routing row first comes, at `root`, under the catalog name `name` gives to its sink. The rows of a dimension follow the
    routing that was in force at their place in the log; routing changes seen so far are kept beside the tables.
    """
    spark = raw.sparkSession
    history = VersionedTable(f"{root.rstrip('/')}/routing", ROUTING, ["source_table", "ts", "place"], [])

    def emit(batch: DataFrame, batch_id: int) -> None:
        history.write(routing_versions(routing_changes(batch)), batch_id)
        versions = history.versions(spark, before=batch_id + 1).drop(BATCH)
        versions = versions.unionByName(loaded_versions(loaded))
        routed = route_dims_as_of(dim_changes(batch), versions)
        routed.persist()
        try:
            named = latest_by_key(versions.where("op <> 'd'"), ["sink_table"], ["ts", "place"])
            for route in named.toLocalIterator():  # a row per dimension
                table, path = name(route.sink_table), f"{root.rstrip('/')}/tables/{route.sink_table}"
                ensure_dim(spark, table, route.sink_columns, path)
                columns = [c for c in spark.table(table).columns if c not in ("seq", BATCH)]
                upsert_dim(dim_rows(routed, route.sink_table, columns), path, columns, batch_id, table=table)
        finally:
            routed.unpersist()

    writer = raw.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": SLOT})).start()
