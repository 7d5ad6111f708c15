"""Streaming queries run to completion over the given tables.

Logs that have to exist as files before a stream can read them are written to the shared folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from waybill.functions.scalars import local_day
from waybill.operators import facts, reports
from waybill.operators.order_join import SEQUENCE, join_orders_batch, narrow_images, wanted_fields
from waybill.plans import standins
from waybill.session import shared_dir
from waybill.sources import files
from waybill.sources.changes import order_changes, read_changes
from waybill.streaming import dims, events, fanout, jobs, series
from waybill.streaming.order_join import join_orders

ONCE = {"availableNow": True}
# A table comes in at least so many micro-batches.
LEAST_BATCHES = 4
# Bytes of the files of a micro-batch (compressed) for each part of the state.
PART_BYTES = 16 << 20


def files_at_once(n: int) -> int:
    """Files of a micro-batch, for `n` files in LEAST_BATCHES of them. Every micro-batch runs a task for each part of the state, so their number must not grow with the files."""
    return max(1, n // LEAST_BATCHES)


def as_stream(
    spark: SparkSession, df: DataFrame, name: str, by: list[str] = ["ts"], slices: int | None = None, late: DataFrame | None = None,
    order: Callable[[int], list[int]] = lambda n: list(range(n)),
) -> DataFrame:
    """A table as a stream of LEAST_BATCHES micro-batches (or of one per slice, where `slices` are given), in the order of `by`.

    All slices are written at once, cut by range partitioning into consecutive runs of one file each; the files' times then say in which
    order the stream takes them up. There are as many slices as shuffle partitions. `order` may name another one of their
    places. `late` rows come after all others.
    """
    inbox, n = write_slices(spark, df, name, by, slices)
    return read_slices(spark, df.schema, inbox, n, late, order, 1 if slices else files_at_once(n))


def write_slices(
    spark: SparkSession, df: DataFrame, name: str, by: list[str], slices: int | None = None, made: Callable[[DataFrame], DataFrame] = lambda cut: cut, **options: str,
) -> tuple[str, int]:
    """A folder of files, each a consecutive run of the rows, and how many there are.

    To find where runs begin, Spark makes all rows once before it makes them for writing. What is long, or takes long to make of a row, is
    `made` of the rows after they were cut (with their `slice`).
    """
    inbox = shared_dir(spark, f"{name}-inbox")
    slices = slices or max(LEAST_BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The writer wants its folders' rows together: sorted by the folder first, they need no second sort.
    cut = df.repartitionByRange(slices, *by).withColumn("slice", F.spark_partition_id()).sortWithinPartitions("slice", *by)
    made(cut).write.options(**options).partitionBy("slice").parquet(inbox)
    return inbox, slices


def read_slices(
    spark: SparkSession, schema: T.StructType, inbox: str, slices: int, late: DataFrame | None = None,
    order: Callable[[int], list[int]] = lambda n: list(range(n)), files_per_batch: int = 1,
) -> DataFrame:
    """The files of `write_slices` as a stream; `late` rows come in a micro-batch of their own."""
    begin, found = int(time.time() * 1000) - 3_600_000, 0
    for place, number in enumerate(order(slices)):
        found += _timed(spark, f"{inbox}/slice={number}", begin + 1000 * place)
    if late is not None:
        # Late is what the watermark before the last batch says, so one batch without rows comes first, after files without rows that fill the one before.
        blank = f"{inbox}/slice={slices}"
        late.limit(0).coalesce(1).write.parquet(blank)
        empty = files.names(spark, blank)[0]
        for k in range(1, -found % files_per_batch + files_per_batch):
            files.copy(spark, f"{blank}/{empty}", f"{blank}/{k}-{empty}")
        late.repartition(files_per_batch).write.parquet(f"{inbox}/slice={slices + 1}")
        for number in (slices, slices + 1):
            _timed(spark, f"{inbox}/slice={number}", begin + 1000 * number)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{inbox}/*")


def _timed(spark: SparkSession, folder: str, millis: int) -> int:
    """Give the files of a folder their time; how many there are."""
    found = files.names(spark, folder)
    for file in found:
        files.set_time(spark, f"{folder}/{file}", millis)
    return len(found)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_to_table(spark: SparkSession, name: str, start: Callable[[str, str], StreamingQuery]) -> DataFrame:
    """Run a streaming job until its input is used up and read what it wrote."""
    root = shared_dir(spark, name)
    finish(start(f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out")


def in_tasks_of(spark: SparkSession, size: int, job: Callable[[], None]) -> None:
    """Run a job whose tasks read so many bytes of files each, where rows are more work than their bytes say."""
    name = "spark.sql.files.maxPartitionBytes"
    given = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        job()
    finally:
        spark.conf.set(name, given)


def with_parts(spark: SparkSession, parts: int, start: Callable[[str, str], StreamingQuery]) -> Callable[[str, str], StreamingQuery]:
    """The start of a stream whose state lies in at most so many parts: a query takes the number over when it starts and keeps it."""
    name = "spark.sql.shuffle.partitions"

    def run(out: str, checkpoint: str) -> StreamingQuery:
        given = spark.conf.get(name)
        spark.conf.set(name, str(min(int(given), parts)))
        try:
            return start(out, checkpoint)
        finally:
            spark.conf.set(name, given)

    return run


def parts_for(spark: SparkSession, *folders: str) -> int:
    """Parts of the state of a stream over the files of some folders: one for each core, as each opens and commits its store (and may start a Python worker) in
    every micro-batch, and more where a micro-batch has more than PART_BYTES for each."""
    size = sum(files.size(spark, folder) for folder in folders)
    return max(spark.sparkContext.defaultParallelism, -(-size // (LEAST_BATCHES * PART_BYTES)))


def _event_day(spark: SparkSession, stream: DataFrame) -> DataFrame:
    totals = events.running_summary(stream, ["event_type"], {
        "event_count": F.count("*"), "amount": F.sum(F.col("value").cast("decimal(20,2)"))})
    columns = ["cur_date", "event_type", "event_count", "amount", "ts"]
    emitted = run_to_table(spark, "event-day", lambda out, ck: events.start_summary(totals, out, columns, ck, trigger=ONCE))
    return events.newest(emitted, ["event_type"])


def stream_event_day(spark, sf_dir):
    rows = standins.table(spark, sf_dir, "events")
    return _event_day(spark, as_stream(spark, rows, "events"))


def stream_late_rows(spark, sf_dir):
    """All events of closed days come a second time, after the others, and change nothing."""
    rows = standins.table(spark, sf_dir, "events")
    last = rows.agg(local_day(F.max("ts")).alias("last"))
    late = rows.join(F.broadcast(last), local_day(F.col("ts")) < F.col("last")).drop("last")  # one row
    return _event_day(spark, as_stream(spark, rows, "events", late=late))


def end_marker(df: DataFrame, **values) -> DataFrame:
    """One row two days after the last one, with nulls but for `values`: it moves the watermark past all rows."""
    last = df.agg((F.max("ts") + F.expr("interval 2 days")).cast(df.schema["ts"].dataType).alias("ts"))
    given = {"ts": F.col("ts"), **{c: F.lit(v) for c, v in values.items()}}
    return last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])


def stream_event_series(spark, sf_dir):
    """The running totals of events, fired by event time; the marker's own key never comes out."""
    rows = standins.table(spark, sf_dir, "events").select("event_type", "ts")
    stream = as_stream(spark, rows, "events", late=end_marker(rows))
    totals = series.event_series(stream, ["event_type"], {"event_count": "1"})
    # Keys are types of events and days, each with the slots of a day at most, so more parts than cores would only be more Python workers to start.
    start = lambda out, ck: totals.writeStream.format("parquet").option("checkpointLocation", ck).trigger(**ONCE).start(out)
    return run_to_table(spark, "event-series", with_parts(spark, spark.sparkContext.defaultParallelism, start))


# Order and cargo columns the summaries read from each fact.
_NEEDED = {
    "detail": ["cargo_type", "sender_district_id", "sender_city_id", "amount"],
    "bound_finish": [], "dispatch": [],
    "deliver": ["receiver_district_id", "receiver_city_id", "receiver_province_id"],
    "receive": ["sender_district_id", "sender_city_id", "sender_province_id"],
}


def _fact_table(spark: SparkSession, sf_dir: str, fact: str) -> DataFrame:
    if fact == "sort":
        return facts.bound_facts(standins.bound_changes(spark, sf_dir))["sort"]
    if fact == "trip_finish":
        return facts.trip_finish(standins.trip_changes(spark, sf_dir))
    changes = narrow_images(standins.order_changes(spark, sf_dir), _NEEDED[fact])
    return facts.waybill_detail(join_orders_batch(changes, fact=fact), fact, _NEEDED[fact])


def late_dims(spark: SparkSession, sf_dir: str, dim: str) -> Callable[[], jobs.Dims]:
    """Dimensions as a stream of facts sees them: every third row of `dim` (organisations or trucks) is only there from the third look on, and
    every fifth one belongs to another district or model at first."""
    at = {"base_organ": "region_id", "truck_info": "truck_model_id"}[dim]
    names = ("base_organ", "base_region_info", "base_dic", "truck_info", "truck_model")
    looks = []

    def now() -> jobs.Dims:
        looks.append(1)
        dims = {name: getattr(standins, name)(spark, sf_dir) for name in names}
        if len(looks) < 3:
            number = F.col("id").cast("long")
            moved = F.when(number % 5 == 0, F.concat(F.substring(at, 1, 3), F.lit("1"))).otherwise(F.col(at))
            dims[dim] = dims[dim].where(number % 3 != 0).withColumn(at, moved)
        return dims

    return now


def few_groups(job: jobs.DaySummary | jobs.BoundSummary) -> bool:
    """Whether the groups of a summary are days, and districts or types of cargo: their number does not grow with that of facts, organisations or trucks."""
    return job.key == "district" if isinstance(job, jobs.BoundSummary) else set(job.keys) <= {"cargo_type"}


def _day_summary(name: str):
    job = jobs.DAY_SUMMARIES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stream = as_stream(spark, _fact_table(spark, sf_dir, job.fact), job.fact)
        tables = lambda: {
            dim: getattr(standins, dim)(spark, sf_dir)
            for dim in ("base_organ", "base_region_info", "base_dic", "truck_info", "truck_model")}
        # Organisations and trucks that come while facts do: rows under what was known before are taken back.
        look = late_dims(spark, sf_dir, "truck_info" if job.key == "truck_id" else "base_organ") if isinstance(job, jobs.BoundSummary) else tables
        start = lambda out, ck: jobs.start_day_summary(name, stream, look, out, ck, ONCE)
        # Districts and days, or types of cargo and days, are few beside the facts; more parts than cores would only be more tasks with next to nothing to do.
        emitted = run_to_table(spark, name, with_parts(spark, spark.sparkContext.defaultParallelism, start) if few_groups(job) else start)
        return jobs.standing(emitted, name)

    return query


def near_shuffled(n: int) -> list[int]:
    """Places turned round in groups of three."""
    return [k for a in range(0, n, 3) for k in reversed(range(a, min(a + 3, n)))]


def lag_of(slices: DataFrame, order: list[int]) -> int:
    """Milliseconds by which a file's first row is behind the newest row of the files before it; slices: slice, first, last."""
    spans = {r["slice"]: (r["first"], r["last"]) for r in slices.collect()}  # a row per file
    newest, lag = None, 0
    for n in order:
        if n in spans:
            lag = max(lag, (newest or spans[n][0]) - spans[n][0])
            newest = max(newest or spans[n][1], spans[n][1])
    return lag


def span_of(batches: DataFrame) -> int:
    """Milliseconds by which a batch's first row is at most behind the newest row up to its end; batches: batch_id, first, last."""
    span, newest = 0, None
    for r in batches.orderBy("batch_id").collect():  # a row per batch
        newest = max(newest or r["last"], r["last"])
        span = max(span, newest - r["first"])
    return span


def stream_order_join(spark, sf_dir):
    """The order join over files that come out of their order in time."""
    log = narrow_images(standins.order_changes(spark, sf_dir), ["order_id", "amount"])
    inbox, slices = write_slices(spark, log, "order-log", SEQUENCE)
    written = spark.read.schema(T.StructType([*log.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(inbox)
    spans = written.groupBy("slice").agg(F.unix_millis(F.min("ts")).alias("first"), F.unix_millis(F.max("ts")).alias("last"))
    lag = lag_of(spans, near_shuffled(slices))
    at_once = files_at_once(slices)
    at_once -= at_once > 1 and at_once % 3 == 0  # so that some groups of three lie in two micro-batches
    marker = end_marker(written.drop("slice"), tbl="order_cargo").withColumn("ts", F.col("ts") + F.expr(f"interval {lag} milliseconds"))
    stream = read_slices(spark, log.schema, inbox, slices, marker, near_shuffled, at_once)
    detail = facts.waybill_detail(join_orders(stream, delay=f"{lag + 1} milliseconds"), columns=["order_id", "amount"])
    start = lambda out, ck: fanout.start_fan_out(detail, out, ck, trigger=ONCE)
    return run_to_table(spark, "order-join", with_parts(spark, parts_for(spark, inbox), start)).drop("batch_id")


def wired_chain(spark, sf_dir):
    """From a topic of raw messages to the report: a stream joins orders and cargo and fans facts out, a second one reads the sink of placed
    orders and keeps the summary of organisations, some of which come late; the amounts per day are read from its versions."""
    root, columns = shared_dir(spark, "chain"), ["sender_district_id", "sender_city_id", "amount"]
    slices = max(LEAST_BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The time of the last message is seen while the messages are written: they are made once, after the changes were put in order.
    seen = Observation()
    in_order = lambda changes: changes.repartitionByRange(slices, "ts").sortWithinPartitions("ts").observe(seen, F.unix_millis(F.max("ts")).alias("last"))
    standins.order_log(spark, sf_dir, in_order).write.text(f"{root}/topic", compression="gzip")
    # A message two days after all others that belongs to no waybill.
    last = spark.range(1).select(F.to_json(F.struct(
        F.lit("c").alias("op"), F.struct(F.lit("end").alias("id")).alias("after"), F.struct(F.lit("order_cargo").alias("table")).alias("source"),
        F.lit(seen.get["last"] + 2 * 86_400_000).alias("ts_ms"))).alias("value"))
    begin, found = int(time.time() * 1000) - 3_600_000, files.names(spark, f"{root}/topic")
    for place, name in enumerate(found):
        files.set_time(spark, f"{root}/topic/{name}", begin + 1000 * place)
    last.coalesce(1).write.mode("append").text(f"{root}/topic")

    raw = read_changes(spark, f"{root}/topic", "dwd", fmt="text", maxFilesPerTrigger=str(files_at_once(len(found))))
    detail = facts.waybill_detail(join_orders(order_changes(raw, wanted_fields(columns))), columns=columns)
    join = lambda out, ck: fanout.start_fan_out(detail, out, ck, trigger=ONCE)
    finish(with_parts(spark, parts_for(spark, f"{root}/topic"), join)(f"{root}/facts", f"{root}/join"))

    schema = detail.drop("fact").schema
    sinks = [f"{root}/facts/{batch}/fact=detail" for batch in files.names(spark, f"{root}/facts")]
    at_once = files_at_once(sum(len(files.names(spark, sink)) for sink in sinks))
    placed = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(f"{root}/facts/*/fact=detail")
    # The files of one micro-batch of the join hold the same span of time and may come in several of the summary.
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType()), T.StructField("fact", T.StringType())])).parquet(f"{root}/facts")
    spans = written.where("fact = 'detail'").groupBy("batch_id").agg(F.unix_millis(F.min("ts")).alias("first"), F.unix_millis(F.max("ts")).alias("last"))
    delay = f"{86_400_000 + span_of(spans)} milliseconds"
    fold = lambda out, ck: jobs.start_day_summary("org_order_day", placed, late_dims(spark, sf_dir, "base_organ"), out, ck, ONCE, delay=delay)
    # Districts and days, as in `few_groups`.
    finish(with_parts(spark, spark.sparkContext.defaultParallelism, fold)(f"{root}/summary", f"{root}/fold"))
    return reports.order_amount_by_day(jobs.standing(spark.read.parquet(f"{root}/summary"), "org_order_day").withColumn("version", F.lit(0)), "version")


def stream_fan_out(spark, sf_dir):
    stream = as_stream(spark, facts.narrow_bounds(standins.bound_changes(spark, sf_dir)), "bound-log", ["after.id", "op", "after.outbound_time"])
    steps = facts.bound_steps(stream)
    return run_to_table(
        spark, "fan-out", lambda out, ck: fanout.start_fan_out(steps, out, ck, trigger=ONCE)).drop("batch_id")


def stream_dims(spark, sf_dir):
    raw = as_stream(spark, standins.dim_log(spark, sf_dir), "dim-log", ["value"])
    root = shared_dir(spark, "dims")
    finish(dims.start_dims(raw, lambda: standins.routing_rows(spark), f"{root}/out", f"{root}/checkpoint", ONCE))
    return dims.current_dim(
        spark, f"{root}/out", "dim_user_info", ["id", "real_name", "phone_num", "email", "birthday"])


QUERIES = {
    "stream_event_day": stream_event_day,
    "stream_late_rows": stream_late_rows,
    "stream_event_series": stream_event_series,
    **{f"stream_{name}": _day_summary(name) for name in jobs.DAY_SUMMARIES},
    "stream_order_join": stream_order_join,
    "wired_chain": wired_chain,
    "stream_fan_out": stream_fan_out,
    "stream_dims": stream_dims,
}
