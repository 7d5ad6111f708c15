"""Tables of versions: every batch appends new versions of rows, readers want the newest one of each key.

A batch is one folder; a repeated batch replaces its own. `fold` keeps what is read small: it writes the newest versions of what came since the last
fold (and of the older folds' rows in the same partitions) to a new folder and commits that by one small file. A reader takes all
committed folds and the batches after the newest of them, so a batch stored while a fold is written is neither lost nor read twice. What a
commit replaced is deleted at the next one, when readers that began before it are done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.operators.routing import latest_by_key
from waybill.sources import files

BATCH = "batch_id"


@dataclass(frozen=True)
class VersionedTable:
    """`schema` is that of the rows, `order` ranks the versions of a key (`batch_id` breaks ties); with `partition`, folds are parted by that column and a fold rewrites
    only its values that changed, so its cost grows with the changes and not with the table."""

    path: str
    schema: T.StructType
    keys: list[str]
    order: list[str]
    partition: str | None = None

    def _folder(self, kind: str) -> str:
        return f"{self.path.rstrip('/')}/{kind}"

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self._folder('batches')}/{BATCH}={batch_id}")

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        return sorted(int(n.split("=")[-1]) for n in files.names(spark, self._folder(kind)))

    def committed(self, spark: SparkSession) -> int:
        """Batches up to this one are in folds; -1 where nothing was folded."""
        return max(self._numbers(spark, "commits"), default=-1)

    def batches(self, spark: SparkSession) -> list[int]:
        return self._numbers(spark, "batches")

    def folds(self, spark: SparkSession) -> list[int]:
        """Folds that readers take."""
        done = self.committed(spark)
        return [n for n in self._numbers(spark, "folds") if n <= done]

    def versions(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Rows of the committed folds and of later batches (those before `before`), with `batch_id`. Keys may have several versions."""
        done = self.committed(spark)
        fresh = [n for n in self.batches(spark) if n > done and (before is None or n < before)]
        return self._rows(spark, self.folds(spark), fresh)

    def _rows(self, spark: SparkSession, folds: list[int], batches: list[int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        parts = []
        for kind, numbers in (("folds", folds), ("batches", batches)):
            if numbers:
                folder = self._folder(kind)
                rows = spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/{BATCH}={n}" for n in numbers])
                parts.append(rows.select(*schema.names))
        if not parts:
            return spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def rows_of(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Rows that one batch wrote."""
        return self._rows(spark, [], [batch_id]).drop(BATCH)

    def newest(self, versions: DataFrame) -> DataFrame:
        return latest_by_key(versions, self.keys, [*self.order, BATCH])

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Newest version of each key, without `batch_id`."""
        return self.newest(self.versions(spark, before)).drop(BATCH)

    def fold(self, spark: SparkSession, upto: int | None = None) -> None:
        """Fold the batches up to `upto` (default: those there now). Batches may be stored meanwhile."""
        done = self.committed(spark)
        upto = max(self.batches(spark), default=-1) if upto is None else upto
        fresh = [n for n in self.batches(spark) if done < n <= upto]
        if not fresh:
            return
        rows, old = self._rows(spark, [], fresh), self.folds(spark)
        if old:
            kept = self._rows(spark, old, [])
            if self.partition:
                # Partitions nobody changed stay in the folds they are in; the few values changed prune the scan.
                kept = kept.join(rows.select(self.partition).distinct(), self.partition, "left_semi")
            rows = rows.union(kept.select(*rows.columns))
        folded = self.newest(rows).drop(BATCH)
        writer = folded.write.mode("overwrite")
        if self.partition:
            # A day is one file, not one of each task.
            writer = folded.repartition(self.partition).write.mode("overwrite").partitionBy(self.partition)
        writer.parquet(f"{self._folder('folds')}/{BATCH}={upto}")
        files.mark(spark, f"{self._folder('commits')}/{upto}")
        self._drop_replaced(spark, done)

    def _drop_replaced(self, spark: SparkSession, done: int) -> None:
        """Delete what the commit before the newest one replaced: batches it folded and, of each partition, all folds but its newest by then."""
        for n in self.batches(spark):
            if n <= done:
                files.drop(spark, f"{self._folder('batches')}/{BATCH}={n}")
        held: set[str] = set()
        for n in sorted((n for n in self._numbers(spark, "folds") if n <= done), reverse=True):
            folder = f"{self._folder('folds')}/{BATCH}={n}"
            parts = [p for p in files.names(spark, folder) if "=" in p] if self.partition else [""]
            for part in parts:
                if part in held:
                    files.drop(spark, f"{folder}/{part}".rstrip("/"))
                held.add(part)
            if self.partition and not [p for p in files.names(spark, folder) if "=" in p]:
                files.drop(spark, folder)
        for n in self._numbers(spark, "commits"):
            if n < done:
                files.drop(spark, f"{self._folder('commits')}/{n}")
