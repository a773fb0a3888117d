"""Record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("json", "ndjson", "parquet")


def read_records(
    spark: SparkSession, path: str | list[str], format: str = "json", schema: StructType | None = None
) -> DataFrame:
    """Request records from files.

    ``json`` is one array (or one document) per file, so a file is the unit of
    parallel work; ``ndjson`` is one record per line and splits at any size.
    The two are not told apart by guessing: read as the other, all lines but
    the first would be lost. Without a schema the names come from the files
    and all values stay text. A given schema states the *source's* names;
    aliases are resolved afterwards.
    """
    if format not in FORMATS:
        raise ValueError("Unsupported file type")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if format == "parquet":
        return reader.parquet(*([path] if isinstance(path, str) else path))
    return reader.option("primitivesAsString", True).json(path, multiLine=format == "json")
