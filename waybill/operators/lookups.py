"""Dimension lookups as left joins: a miss keeps the row with nulls.

No join is forced to broadcast. Dimension tables are read from files whose size Spark knows, so it
broadcasts the small ones, checks again at run time and otherwise joins by shuffle, splitting hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, key: str, columns: dict[str, str], pk: str = "id") -> DataFrame:
    """Columns of the dimension row whose primary key equals `key`; `columns` maps dim name -> result name."""
    side = dim.select(F.col(pk).alias("_pk"), *[F.col(c).alias(name) for c, name in columns.items()])
    return df.join(side, df[key] == side["_pk"], "left").drop("_pk")


def first_by_key(dim: DataFrame, fk: str) -> DataFrame:
    """One row per foreign key: the first in text order of `id`; rows without the key are left out."""
    rest = [c for c in dim.columns if c != fk]
    first = F.min_by(F.struct(*rest), F.col("id").cast("string")).alias("_first")
    return dim.where(F.col(fk).isNotNull()).groupBy(fk).agg(first).select(fk, "_first.*")


def lookup_first(df: DataFrame, dim: DataFrame, key: str, fk: str, columns: dict[str, str]) -> DataFrame:
    """Columns of the first dimension row whose foreign key `fk` equals `key`."""
    return lookup(df, first_by_key(dim.select(*{"id", fk, *columns}), fk), key, columns, pk=fk)


def first_by_id(organ: DataFrame) -> DataFrame:
    """One row per organisation: where rows share an id, one without a parent, as only its region is a city; then the first in text order."""
    rest = [c for c in organ.columns if c != "id"]
    order = F.struct(F.col("org_parent_id").isNotNull(), *[F.col(c) for c in rest])
    return organ.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("_first")).select("id", "_first.*")


def org_city(df: DataFrame, organ: DataFrame, key: str = "org_id", name: str | None = "org_name") -> DataFrame:
    """City of an organisation: the region of its parent, or its own where it has none.

    Adds `city_id` and, unless `name` is None, the organisation's name. The two hops are joined on
    the dimension side first, so the rows themselves are joined once.
    """
    organ = first_by_id(organ)
    parent = organ.select(F.col("id").alias("_join_id"), F.col("region_id").alias("city_id"))
    hops = organ.withColumn("_join_org", F.coalesce("org_parent_id", "id"))
    cities = hops.join(parent, F.col("_join_org") == F.col("_join_id"), "left")
    wanted = {"city_id": "city_id"} if name is None else {"org_name": name, "city_id": "city_id"}
    return lookup(df, cities, key, wanted)


def city_province(df: DataFrame, region: DataFrame, key: str = "city_id") -> DataFrame:
    """Name of a city, and its province when the region is a city."""
    province = region.select(F.col("id").alias("_province"), F.col("name").alias("province_name"))
    cities = region.select(
        F.col("id"), F.col("name").alias("city_name"),
        F.when(F.col("dict_code") == "City", F.col("parent_id")).alias("province_id"))
    both = cities.join(province, F.col("province_id") == F.col("_province"), "left")
    return lookup(df, both, key, {c: c for c in ("city_name", "province_id", "province_name")})
