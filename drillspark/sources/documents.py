"""Form of rows as documents: ISO times, no NaN, lists of one value unwrapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import iso_z


def _document_value(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast(field.dataType)).alias(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.date_format(c, "yyyy-MM-dd").alias(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return iso_z(c).alias(field.name)
    return c


def to_documents(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, NaN as null."""
    return df.select(*[_document_value(f) for f in df.schema.fields])


def unwrap(df: DataFrame) -> DataFrame:
    """Lists become their first element, empty lists null."""
    return df.select(
        *[
            F.try_element_at(F.col(f"`{f.name}`"), F.lit(1)).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
