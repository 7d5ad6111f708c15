"""Helpers of the operators: staged tables, whole-text batches, words, and ranks within hot groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.session import shared_dir

#: Fixed value: a word, as the contracts of the operators define it.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a group are dealt to this many buckets, so that a group that holds a third of all rows is never one task.
BUCKETS = 4096

#: Characters of text that a Python step holds in arrays at once, unless a single text is longer.
BLOCK_CHARS = 1 << 20


#: Rows and bytes that a Python step receives at once, unless a single row has more; texts may be long.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 25


def bounded_batches(spark: SparkSession) -> None:
    """Keeps what Spark hands to a Python step at once small, for this session from now on: queries are run after they are built."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written to a table in the folder all executors share and read from there.

    It cuts the lineage: what took long is not computed twice, and a lost executor costs no more than its
    running tasks.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text. bytes.split() parts at exactly the six characters that WORD leaves out."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `chars` characters each; one longer text is a range of its own."""
    first = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def texts_of(column: pd.Series) -> list[str]:
    """Whole texts; null is empty."""
    return ["" if text is None else text for text in column]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one after another, and the n + 1 borders between them."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return joined, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranked(df: DataFrame, group: list[str], order: list[str], bucket: Column, rank: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row within its group, by bucket and then by `order`; null is a group, too.

    Counts per (group, bucket) are added up to each bucket's first rank, then rows are numbered within the bucket.
    A hot group is so split over BUCKETS tasks. `bucket` must be a number that depends on the row alone. `df` is read twice: stage it before.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    same = lambda a, b, names: [a[f"{k}"].eqNullSafe(b[f"_{k}"]) for k in names]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = (
        "sum(_n) over (partition by {} order by _bucket rows between unbounded preceding and current row) - _n"
        .format(", ".join(f"`{k}`" for k in group) or "1"))
    firsts = counts.withColumn("_first", F.expr(before)).select(*[F.col(k).alias(f"_{k}") for k in keys], "_first")
    within = "row_number() over (partition by {} order by {})".format(
        ", ".join(f"`{k}`" for k in keys), ", ".join(f"`{k}`" for k in order))
    numbered = df.withColumn("_within", F.expr(within))
    return (
        numbered.join(firsts, same(numbered, firsts, keys), "left")
        .withColumn(rank, F.col("_first") + F.col("_within") - 1)
        .drop("_bucket", "_first", "_within", *[f"_{k}" for k in keys]))
