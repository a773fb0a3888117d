"""Result rows as JSON text that any reader takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_set(values: Column) -> Column:
    """A collected set as a list, ordered by the values' text."""
    keyed = F.transform(
        F.array_distinct(values), lambda v: F.struct(v.cast("string").alias("text"), v.alias("v"))
    )
    return F.transform(F.array_sort(keyed), lambda pair: pair["v"])


def _iso(moment: Column) -> Column:
    """ISO text; the fraction appears only where there is one."""
    seconds = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def json_safe(value: Column, dtype: T.DataType) -> Column:
    """Days and moments as ISO text, whole decimals as integers, others as doubles."""
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return _iso(value)
    if isinstance(dtype, T.DecimalType):
        whole = value.cast(T.DecimalType(dtype.precision, 0)).cast("variant")
        return F.when(value == F.floor(value), whole).otherwise(
            value.cast("double").cast("variant")
        )
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: json_safe(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        named = F.transform_keys(value, lambda k, _: k.cast("string"))
        return F.transform_values(named, lambda _, v: json_safe(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [json_safe(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def report_json(df: DataFrame, keep_nulls: bool = True, name: str = "report") -> DataFrame:
    """One JSON object per row, NULL fields kept as ``null`` by default."""
    columns = [
        json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields
    ]
    options = {"ignoreNullFields": str(not keep_nulls).lower()}
    return df.select(F.to_json(F.struct(*columns), options).alias(name))
