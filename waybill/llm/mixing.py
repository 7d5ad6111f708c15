"""Mixing sources to target weights by systematic sampling.

Targets fill up like water: each source gets its weight's share, none gets more than `limit` times its size. Every
document of a source has the same expected number of copies. These are summed up along the source's documents, shortest
first; one random offset is added, and a document is emitted once for each integer its stretch of the sum crosses.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import BUCKETS, WORD, ranked, staged

#: Weights of the sources by code point, repeating, and the share of all words that the mix has.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0


def offset_of(seed: int) -> float:
    return random.Random(seed).random()


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Adds target to (source, source_size), one row per source; null is a source, the last one.

    With sources by limit * size / weight, let level i be what is left for the weights from i on if all before are full. The
    highest of these levels is the water's: sources below it are full, the others get weight * level.
    """
    place = "row_number() over (order by source is null, source) - 1"
    weight = f"element_at(array({', '.join(f'{float(w)!r}D' for w in weights)}), cast({place} as int) % {len(weights)} + 1)"
    order = "order by source_size / weight, source is null, source"
    full = f"{limit!r}D * (sum(source_size) over ({order} rows between unbounded preceding and current row) - source_size)"
    rest = f"sum(weight) over ({order} rows between current row and unbounded following)"
    level = f"({share!r}D * sum(source_size) over () - {full}) / {rest}"
    # One row per source, so one task.
    return (
        sources.withColumn("weight", F.expr(weight)).withColumn("level", F.expr(level))
        .withColumn("level", F.expr("max(level) over ()"))
        .withColumn("target", F.expr(f"least({limit!r}D * source_size, weight * level)")).drop("weight", "level"))


def words_in(text: str) -> Column:
    """The number of words of a whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of `docs` (doc_id, source, text).

    The size is the number of words of the whole text, 0 for null. Rows that repeat a doc_id are rows of their own; those equal in source, size and doc_id
    are interchangeable. A source without words has target 0 and no copies; an empty table gives no rows. Reruns agree.
    """
    sized = staged(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words_in("text").alias("size")), "sizes")
    per_size = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    # A source has one row per distinct size here.
    per_size = per_size.withColumn("shorter", F.expr(
        "sum(n) over (partition by source order by size rows between unbounded preceding and current row) - n"))
    sources = with_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    known = per_size.alias("p").join(sources.alias("s"), F.expr("p.source <=> s.source")).selectExpr(
        "p.source as _source", "p.size as _size", "shorter", "source_size", "target",
        "case when source_size > 0 then target / source_size else 0D end as rate")
    rows = ranked(sized, ["source", "size"], ["doc_id"], F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(BUCKETS)))
    upto = f"floor({offset_of(seed)!r}D + (shorter + rank {{}}) * rate)"
    copies = f"least({upto.format('+ 1')} - {upto.format('+ 0')}, ceil(rate))"
    return rows.join(known, F.expr("source <=> _source and size = _size")).select(
        "doc_id", "source", "size", "source_size", "target", F.expr(copies).cast("long").alias("copies"))


def taken_words(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, repeats counted."""
    return plan(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of the mix, with all columns: each row of `docs` as often as it is emitted."""
    keys = ["doc_id", "source", "size"]
    numbered = lambda order: F.expr(f"row_number() over (partition by {', '.join(keys)} order by {order})")
    copies = plan(docs, seed).where("copies > 0").select(*keys, "copies").withColumn("n", numbered("copies desc"))
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.expr("cast(row.doc_id as long)").alias("doc_id"), F.expr("cast(row.source as string)").alias("source"), words_in("row.text").alias("size"))
    rows = rows.withColumn("n", numbered("xxhash64(row.text)"))
    same = F.expr(" and ".join(f"r.{k} <=> c.{k}" for k in [*keys, "n"]))
    both = rows.alias("r").join(copies.alias("c"), same)
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c.copies").cast("int")))).select("r.row.*")


def oracle(seed: int = 1) -> str:
    """DuckDB SQL for `taken_words` of the table documents."""
    u = repr(offset_of(seed))
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
sources as (
  select source, source_size, ([3.0, 1.0, 2.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from (select source, sum(size)::bigint as source_size from sized group by source)),
levels as (
  select *, ({SHARE!r}::double * sum(source_size) over ()::double - {LIMIT!r}::double * (sum(source_size) over (order by source_size / weight, source nulls last
      rows between unbounded preceding and current row) - source_size)::double)
    / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as level
  from sources),
targets as (
  select source, source_size, least({LIMIT!r}::double * source_size, weight * (select max(level) from levels)) as target from levels),
placed as (
  select *, row_number() over (partition by source order by size, (coalesce(doc_id, 0) % {BUCKETS} + {BUCKETS}) % {BUCKETS}, doc_id) - 1 as rank from sized),
rated as (
  select p.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate
  from placed p join targets t on p.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (least(floor({u}::double + (rank + 1) * rate) - floor({u}::double + rank * rate), ceil(rate)) * size)::bigint as taken
from rated"""
