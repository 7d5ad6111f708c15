"""Order rows meet the cargo row of the same waybill, whichever comes first (batch form).

Rules, row by row in log order within a waybill:
* a cargo row replaces the held cargo; if an order waits for less than the time limit, both make a placement;
* a created order makes a placement with the held cargo, else it starts waiting;
* an updated order makes the fact of its status change with the held cargo, else it is lost;
* a cancel clears the held cargo, and so does signing, after which nothing is expected.
The held cargo and the waiting order are the newest earlier rows of their kind, so two windows over
one partitioning and sort order say it all. `streaming.order_join` is the same rule with kept state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators import skew
from waybill.operators.facts import CARGO_COLUMNS, ORDER_COLUMNS, status_fact

# Order of changes within a waybill: time, cargo before order, create before update.
SEQUENCE = ["ts", "tbl", "op", "order.status", "cargo.id"]
# Where the log has it, the place in the database's log orders changes of one instant.
PLACED = [SEQUENCE[0], "place", *SEQUENCE[1:]]
# Image fields the rules themselves read.
_RULE_FIELDS = {"order": {"status", "update_time"}, "cargo": {"id", "order_id", "create_time"}}
CLEARING_FACTS = ("cancel", "sign")
# Fixed value: how long a created order waits for its cargo.
WAIT = "5 seconds"


def wanted_fields(columns: list[str]) -> dict[str, set[str]]:
    """Fields of the order and cargo images that the named detail columns and the join need."""
    source = {name: c for c, name in CARGO_COLUMNS.items()}
    return {
        "order": {c for c in columns if c in ORDER_COLUMNS} | _RULE_FIELDS["order"],
        "cargo": {source[c] for c in columns if c in source} | _RULE_FIELDS["cargo"],
    }


def narrow_images(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Only the image fields that the named detail columns and the join need.

    Images travel through the shuffle as a whole, so a summary that reads five columns of the detail
    should not ship all of them. `sources.changes.order_changes` can leave the others out of the parse already.
    """
    for image, names in wanted_fields(columns).items():
        kept = [F.col(f"{image}.{f}").alias(f) for f in changes.schema[image].dataType.names if f in names]
        changes = changes.withColumn(image, F.when(F.col(image).isNotNull(), F.struct(*kept)))
    return changes


def relevant(changes: DataFrame, fact: str | None = None, clear_on: tuple[str, ...] = CLEARING_FACTS) -> DataFrame:
    """Rows that can make a fact or change what is held, with the fact of an update's status change.

    Reads of orders and updates nobody reports do neither, so they are dropped before the shuffle. Where only one fact is wanted, so are
    the orders' rows that make another one, but for those that free the held cargo.
    """
    is_order, op = F.col("tbl") == "order_info", F.col("op")
    status = F.when(is_order & (op == "u"), status_fact(F.col("before_status"), F.col("order.status")))
    placed = is_order & (op == "c")
    if fact is None:
        orders = placed | F.col("_status").isNotNull()
    else:
        # A created order makes no other fact than its placement, and changes what waits for a cargo row only.
        orders = (placed if fact == "detail" else F.lit(False)) | F.col("_status").isin(fact, *clear_on)
    kept = (F.col("tbl") == "order_cargo") | orders
    return changes.where("order_id is not null").withColumn("_status", status).where(kept)


def join_orders_batch(
    changes: DataFrame, ttl: str = WAIT, sequence: list[str] | None = None, clear_on: tuple[str, ...] = CLEARING_FACTS,
    max_rows: int = skew.MAX_ROWS, slices: int | None = None, fact: str | None = None,
) -> DataFrame:
    """(fact, cargo, order) rows of a change log (see `sources.changes.order_changes`), of all facts or of the one named `fact`.

    The rows that matter are written once to the shared folder; the log is not read again. Waybills with more than `max_rows` of
    them, more than one task should sort, are found while they are written and worked in `slices` consecutive runs (default: as many as shuffle partitions).
    """
    # Fields of images as flat columns, so that both windows see the same sort order and the second one sorts nothing.
    sequence = sequence or (PLACED if "place" in changes.columns else SEQUENCE)
    flat = {f"_s{i}" if "." in c else c: F.col(c) for i, c in enumerate(sequence)}
    rows, hot = skew.written_once(relevant(changes, fact, clear_on).drop("before_status"), "order_id", max_rows)
    rows = rows.withColumns({name: c for name, c in flat.items() if name not in rows.columns})
    listed = 0 if hot is None else skew.listed(hot)
    if listed == 0:
        return of_fact(_joined(rows, ttl, list(flat), clear_on, sliced=False), fact)
    if listed > skew.FEW:
        # Keys may be sliced that need not be, which costs less than to part the rows by a long list of keys.
        return of_fact(_joined(skew.slice_rows(rows, "order_id", list(flat), slices), ttl, list(flat), clear_on, sliced=True), fact)
    cold = _joined(rows.join(hot, "order_id", "left_anti"), ttl, list(flat), clear_on, sliced=False)
    runs = skew.slice_rows(rows.join(hot, "order_id", "left_semi"), "order_id", list(flat), slices)
    return of_fact(cold.unionByName(_joined(runs, ttl, list(flat), clear_on, sliced=True)), fact)


def of_fact(joined: DataFrame, fact: str | None) -> DataFrame:
    return joined if fact is None else joined.where(F.col("fact") == fact)


def _joined(rows: DataFrame, ttl: str, sequence: list[str], clear_on: tuple[str, ...], sliced: bool) -> DataFrame:
    is_cargo = F.col("tbl") == "order_cargo"
    created = (F.col("tbl") == "order_info") & (F.col("op") == "c")

    # A wrapped null says "cleared", which must not be skipped like "nothing happened".
    nothing = F.lit(None).cast(rows.schema["cargo"].dataType)
    held = (F.when(is_cargo, F.struct(F.col("cargo").alias("cargo")))
            .when(F.col("_status").isin(*clear_on), F.struct(nothing.alias("cargo"))))
    ends = skew.slice_ends(rows, "order_id") if sliced else None
    rows = skew.last_before(rows, held, "_held", "order_id", sequence, ends)
    has_cargo = F.col("_held.cargo").isNotNull()

    waits = F.when(created & ~has_cargo, F.struct(F.col("order").alias("order"), F.col("ts").alias("since")))
    rows = skew.last_before(rows, waits, "_waiting", "order_id", sequence, ends)
    in_time = F.col("ts") - F.col("_waiting.since") < F.expr(f"interval {ttl}")

    fact = (F.when(created & has_cargo, F.lit("detail"))
            .when(F.col("_status").isNotNull() & has_cargo, F.col("_status"))
            .when(is_cargo & in_time, F.lit("detail")))
    return rows.select(
        fact.alias("fact"),
        F.when(is_cargo, F.col("cargo")).otherwise(F.col("_held.cargo")).alias("cargo"),
        F.when(is_cargo, F.col("_waiting.order")).otherwise(F.col("order")).alias("order"),
    ).where("fact is not null")
