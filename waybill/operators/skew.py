"""Keys that hold too many rows for one task, and an in-order carry that survives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from waybill.session import shared_dir

# A key with more rows than this is cut into slices, however many such keys there are.
MAX_ROWS = 2_000_000

SLICE = "_slice"

# Hot keys up to this number are told from the others by a join.
FEW = 100_000


# Keys that a summary of the rows tracks, and the share of all rows that a key must have to be told apart from the others by it. Tracking
# t keys misses none with more than 2.7 / t of the rows.
TRACKED = 1024
TOLD_APART = 4 / TRACKED


def written_once(rows: DataFrame, key: str, max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows as a table in the shared folder, and the keys with more than `max_rows` rows as a table of one column (None: there is none).

    While the rows are written, each task keeps a summary of its most frequent keys, which Spark merges: the source is read once. Only keys that
    the merged summary names are then counted, in the written column. Where a hot key's share of all rows is too small for the
    summary, the written column is counted as a whole. Which keys are listed changes the split of the work, never a result.
    """
    spark, path, seen = rows.sparkSession, shared_dir(rows.sparkSession, "keyed-rows"), Observation()
    frequent = F.expr(f"filter(approx_top_k(`{key}`, {TRACKED}, {TRACKED}), k -> k.count > {max_rows})")
    rows.observe(seen, F.count("*").alias("n"), frequent.alias("frequent")).write.parquet(path, compression="zstd")
    table = spark.read.schema(rows.schema).parquet(path)
    if seen.get["n"] <= max_rows:
        return table, None
    if max_rows >= seen.get["n"] * TOLD_APART:
        likely = [k["item"] for k in seen.get["frequent"] or []]
        return table, hot_keys(table.where(F.col(key).isin(likely)), key, max_rows) if likely else None
    return table, hot_keys(table, key, max_rows)


def hot_keys(rows: DataFrame, key: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """The keys with more than `max_rows` rows, as a table of one column, however many they are."""
    path = shared_dir(rows.sparkSession, "hot-keys")
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max_rows).select(key)
    counts.write.parquet(path)
    return rows.sparkSession.read.schema(counts.schema).parquet(path)


def listed(keys: DataFrame) -> int:
    """How many keys there are, up to one more than FEW."""
    return keys.limit(FEW + 1).count()


def slice_rows(hot_rows: DataFrame, key: str, order: list[str], slices: int | None = None) -> DataFrame:
    """Rows of hot keys with a slice number: consecutive runs of about equal size in (key, order).

    Spark cuts the runs by sampling all the order columns, so even rows of one instant are spread.
    The rows are written to the shared folder: that fixes their slices, and their source (parsing a
    log, joining tables) need not run again for the passes that follow.
    """
    spark = hot_rows.sparkSession
    slices = slices or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = shared_dir(spark, "hot-rows")
    hot_rows.repartitionByRange(slices, key, *order).withColumn(SLICE, F.spark_partition_id()).write.parquet(path, compression="zstd")
    return spark.read.parquet(path)


def slice_ends(rows: DataFrame, key: str) -> list[str]:
    """The keys that a slice begins or ends with. All rows of any other key are in one slice."""
    ends = rows.groupBy(SLICE).agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()  # a row per slice
    return sorted({k for r in ends for k in (r["first"], r["last"])})


def last_before(df: DataFrame, value: Column, out: str, key: str, order: list[str], ends: list[str] | None) -> DataFrame:
    """Newest non-null `value` among the earlier rows of the key, in the given order.

    Without slices this is one window. With slices (`slice_rows`) the window runs inside a slice, and
    a small table with one row per (key, slice) carries the value over from the earlier slices, for the keys in `ends` (`slice_ends`) alone.
    """
    sliced = ends is not None
    groups = [key, SLICE] if sliced else [key]
    earlier = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    valued = df.withColumn("_value", value)
    inside = valued.withColumn("_inside", F.last("_value", ignorenulls=True).over(earlier))
    if not sliced:
        return inside.withColumn(out, F.col("_inside")).drop("_value", "_inside")

    by_slice = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    carried = (
        valued.where(F.col(key).isin(ends)).groupBy(key, SLICE).agg(newest.alias("_newest"))
        .withColumn("_carried", F.last("_newest", ignorenulls=True).over(by_slice))
        .drop("_newest")
    )
    # The window already placed and sorted the rows by (key, slice), so this join moves only `carried`.
    return (
        inside.join(carried, [key, SLICE], "left")
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_value", "_inside", "_carried")
    )
