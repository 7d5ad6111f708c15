"""The eight daily summaries as streaming jobs over their fact streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from waybill.operators.lookups import city_province, first_by_key, lookup, org_city
from waybill.operators.snapshots import SLOT, stamp
from waybill.operators.summaries import MONEY, SUMMARY_COLUMNS, fold_first
from waybill.sources.tables import write_summary
from waybill.sources.versions import VersionedTable
from waybill.streaming.events import newest, running_summary, start_summary

# Micro-batches after which the versions a summary keeps are folded.
FOLD_EVERY = 10

Dims = dict[str, DataFrame]


@dataclass(frozen=True)
class DaySummary:
    """Fact it reads, grouping, measures, and the names looked up after the grouping."""

    fact: str
    keys: list[str]
    measures: Callable[[], dict[str, Column]]
    name: Callable[[DataFrame, Dims], DataFrame] = field(default=lambda df, dims: df)


@dataclass(frozen=True)
class BoundSummary:
    """A summary whose groups depend on a dimension.

    The stream adds up what the facts hold by themselves (`held`: names of the fact's columns by their names in the summary, the `key` of the
    dimension among them), per day. `binding` maps that key to the columns in `bound`, and only what is emitted is grouped by them.
    """

    fact: str
    key: str
    held: dict[str, str]
    first: list[str]
    bound: list[str]
    keys: list[str]
    measures: dict[str, tuple[Callable[[], Column], str]]
    binding: Callable[[Dims], DataFrame]
    name: Callable[[DataFrame, Dims], DataFrame]

    def columns(self) -> list[str]:
        """Columns of a part: one group of what the facts hold, on one day."""
        return ["cur_date", *self.held, "first_ts", *self.measures]


def _org_of_district(dims: Dims) -> DataFrame:
    organ = first_by_key(dims["base_organ"].select("id", "org_name", "region_id"), "region_id")
    return organ.select(F.col("region_id").alias("district"), F.col("id").alias("org_id"), "org_name")


def _model_of_truck(dims: Dims) -> DataFrame:
    return dims["truck_info"].select(F.col("id").alias("truck_id"), "truck_model_id")


def _region_name(key: str, name: str) -> Callable[[DataFrame, Dims], DataFrame]:
    return lambda df, dims: lookup(df, dims["base_region_info"], key, {"name": name})


def _count_all() -> Column:
    return F.count("*")


def _side(fact: str, side: str, measure: str) -> BoundSummary:
    def name(df: DataFrame, dims: Dims) -> DataFrame:
        return _region_name("province_id", "province_name")(_region_name("city_id", "city_name")(df, dims), dims)

    held = {"district": f"{side}_district_id", "city_id": f"{side}_city_id", "province_id": f"{side}_province_id"}
    return BoundSummary(
        fact, "district", held, ["city_id", "province_id"], ["org_id", "org_name"], ["org_id", "org_name"],
        {measure: (_count_all, "bigint")}, _org_of_district, name)


def _count(fact: str, measure: str) -> DaySummary:
    return DaySummary(fact, [], lambda: {measure: F.count("*")})


def _truck_names(df: DataFrame, dims: Dims) -> DataFrame:
    named = lookup(df, dims["truck_model"], "truck_model_id", {"model_name": "truck_model_name"})
    return _region_name("city_id", "city_name")(org_city(named, dims["base_organ"], name=None), dims)


DAY_SUMMARIES: dict[str, DaySummary | BoundSummary] = {
    "bound_org_sort_day": DaySummary(
        "sort", ["org_id"], lambda: {"sort_count": F.count("*")},
        name=lambda df, dims: city_province(org_city(df, dims["base_organ"]), dims["base_region_info"])),
    "cargo_type_order_day": DaySummary(
        "detail", ["cargo_type"], lambda: {"order_amount": F.sum("amount").cast(MONEY), "order_count": F.count("*")},
        name=lambda df, dims: lookup(df, dims["base_dic"], "cargo_type", {"name": "cargo_type_name"})),
    "org_order_day": BoundSummary(
        "detail", "district", {"district": "sender_district_id", "city_id": "sender_city_id"}, ["city_id"], ["org_id", "org_name"], ["org_id", "org_name"],
        {"order_amount": (lambda: F.sum("amount").cast(MONEY), MONEY), "order_count": (_count_all, "bigint")},
        _org_of_district, _region_name("city_id", "city_name")),
    "bound_finish_day": _count("bound_finish", "bound_finish_count"),
    "dispatch_day": _count("dispatch", "dispatch_count"),
    "org_deliver_suc_day": _side("deliver", "receiver", "deliver_count"),
    "org_receive_day": _side("receive", "sender", "receive_count"),
    "org_truck_model_day": BoundSummary(
        "trip_finish", "truck_id", {"truck_id": "truck_id", "org_id": "start_org_id", "org_name": "start_org_name"}, ["org_name"], ["truck_model_id"], ["org_id", "truck_model_id"],
        {"finish_count": (_count_all, "bigint"), "finish_distance": (lambda: F.sum("actual_distance").cast(MONEY), MONEY),
         "finish_dur_ms": (lambda: F.sum("transport_time"), "bigint")},
        _model_of_truck, _truck_names),
}


def counted(name: str) -> str:
    """The measure that counts a summary's facts: no row has 0 of them but one that was taken back."""
    job = DAY_SUMMARIES[name]
    return next(m for m in job.measures if m.endswith("_count")) if isinstance(job, BoundSummary) else next(m for m in job.measures() if m.endswith("_count"))


def start_day_summary(
    name: str, facts: DataFrame, dims: Callable[[], Dims], target: str, checkpoint: str, trigger: dict | None = None,
    delay: str = "0 seconds", fold_every: int = FOLD_EVERY, **options: str,
) -> StreamingQuery:
    """Run one summary over the stream of its facts and append its versions to `target`.

    `dims` is called for every micro-batch, so what it holds now decides names, and organisations of districts and models of trucks as well: where one
    of these changes, rows under the old one are taken back by a version with no facts (see `standing`) and come again under the new one.
    """
    job = DAY_SUMMARIES[name]
    if isinstance(job, BoundSummary):
        return _start_bound(name, job, facts, dims, target, checkpoint, trigger, delay, fold_every, options)
    totals = running_summary(facts, job.keys, job.measures(), delay=delay)
    return start_summary(
        totals, target, SUMMARY_COLUMNS[name], checkpoint, lambda batch: job.name(batch, dims()), trigger, **options)


def standing(versions: DataFrame, name: str) -> DataFrame:
    """Newest version of each row of a summary, without rows that were taken back."""
    return newest(versions, DAY_SUMMARIES[name].keys).where(F.col(counted(name)) > 0)


def _start_bound(name, job, facts, dims, target, checkpoint, trigger, delay, fold_every, options) -> StreamingQuery:
    measures = {"first_ts": F.min("ts"), **{m: make() for m, (make, _) in job.measures.items()}}
    held = facts.withColumns({c: F.col(source) for c, source in job.held.items()})
    totals = running_summary(held, list(job.held), measures, delay=delay).select(job.columns())
    state = RebindingState(job, totals.schema, f"{checkpoint.rstrip('/')}-parts", f"{checkpoint.rstrip('/')}-binding")

    def emit(batch: DataFrame, batch_id: int) -> None:
        current = dims()
        rows = state.apply(batch, job.binding(current), batch_id)
        write_summary(stamp(job.name(rows, current)), target, SUMMARY_COLUMNS[name], batch_id=batch_id, **options)
        if fold_every and batch_id % fold_every == fold_every - 1:
            state.fold(rows.sparkSession, batch_id - 1)

    writer = totals.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": SLOT})).start()


class RebindingState:
    """Totals of what facts hold, per day, and the binding that was last emitted, both as tables of versions in the shared folder.

    `apply` gives the rows of all groups that a micro-batch or a changed binding touches; groups that nothing belongs to any more come with no facts.
    It reads the days touched, and depends on batches before its own only, so that a repeated batch gives the same rows.
    """

    def __init__(self, job: BoundSummary, schema: StructType, parts: str, binding: str) -> None:
        self.job = job
        self.parts = VersionedTable(parts, schema, ["cur_date", *job.held], [], "cur_date")
        self.binding = VersionedTable(binding, StructType([schema[job.key], *[StructField(c, StringType()) for c in job.bound]]), [job.key], [])

    def apply(self, batch: DataFrame, binding: DataFrame, batch_id: int) -> DataFrame:
        # The stream's own session doesn't adapt its plans to what they read, that of the dimensions does.
        job, spark = self.job, binding.sparkSession
        now = binding.select(job.key, *job.bound)
        before = self.binding.read(spark, before=batch_id)
        moved = self._moved(now, before)
        self.parts.write(batch, batch_id)
        self.binding.write(moved.select(job.key, *job.bound), batch_id)
        # What was written is what is read, so that a changing dimension gives one binding for the whole batch, and its totals are not made again from the facts.
        now, parts = self.binding.read(spark, before=batch_id + 1), self.parts.versions(spark, before=batch_id + 1)
        moved = self.binding.rows_of(spark, batch_id).select(job.key)
        days = self.parts.rows_of(spark, batch_id).select("cur_date", job.key).union(parts.join(moved, job.key, "left_semi").select("cur_date", job.key)).distinct()
        # Groups may have columns that facts hold beside the bound ones, so what is touched is looked up among the parts.
        touched = self.parts.newest(parts.join(days, ["cur_date", job.key], "left_semi"))
        groups = reduce(DataFrame.union, [self._bound(touched, b).select("cur_date", *job.keys) for b in (now, before)]).distinct()
        members = self._bound(self.parts.newest(parts.join(days.select("cur_date").distinct(), "cur_date", "left_semi")), now)
        groups = groups.withColumnsRenamed({k: f"_{k}" for k in job.keys}).withColumnRenamed("cur_date", "_date")
        same = lambda rows: [rows["cur_date"] == groups["_date"], *[rows[k].eqNullSafe(groups[f"_{k}"]) for k in job.keys]]
        folded = fold_first(members.join(groups, same(members), "left_semi"), job.keys, job.first, {m: kind for m, (_, kind) in job.measures.items()})
        left = groups.join(folded, same(folded), "left")
        return left.select(
            F.col("_date").alias("cur_date"), *[F.col(f"_{k}").alias(k) for k in job.keys], *job.first,
            *[F.coalesce(m, F.lit(0)).cast(kind).alias(m) for m, (_, kind) in job.measures.items()])

    def _bound(self, rows: DataFrame, binding: DataFrame) -> DataFrame:
        return lookup(rows, binding, self.job.key, {c: c for c in self.job.bound}, pk=self.job.key)

    def _moved(self, now: DataFrame, before: DataFrame) -> DataFrame:
        """Rows of the binding that are new, different or gone (then with nulls)."""
        job = self.job
        old = before.withColumnsRenamed({c: f"_{c}" for c in (job.key, *job.bound)}).withColumn("_had", F.lit(True))
        both = now.join(old, now[job.key] == old[f"_{job.key}"], "full_outer")
        changed = F.lit(False)
        for c in job.bound:
            changed |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        return both.where(F.col("_had").isNull() | changed).select(
            F.coalesce(job.key, f"_{job.key}").alias(job.key), *job.bound)

    def fold(self, spark: SparkSession, upto: int) -> None:
        """Fold the versions up to a batch that will not be repeated."""
        self.parts.fold(spark, upto)
        self.binding.fold(spark, upto)
