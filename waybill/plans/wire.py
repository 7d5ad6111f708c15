"""Report form of a result: plain texts and numbers only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.functions.scalars import millis, text_time

# Instants under these names are versions or event times and go out as epoch milliseconds.
STAMPS = {"ts", "version"}


def as_wire(df: DataFrame) -> DataFrame:
    """Decimals as doubles, days as `yyyy-MM-dd`, instants as `yyyy-MM-dd HH:mm:ss` or milliseconds."""

    def out(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return (millis(c) if field.name in STAMPS else text_time(c)).alias(field.name)
        return c

    return df.select(*[out(f) for f in df.schema])
