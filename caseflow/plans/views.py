"""Request records over an order-processing star schema.

A line item is a request. Attributes are looked up in the other tables by left
joins on their keys, and only the tables that the wanted fields need are
joined. Join strategies are left to Spark: it broadcasts a side only below its
size threshold and splits skewed partitions of a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = ("agency", "complaint_type", "borough", "status")
ALL_FIELDS = ("unique_key", "created", "due", "closed", *SEGMENTS)


# the columns in use; a stated schema saves reading file footers to plan a query
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_brand string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _tickets(spark: SparkSession, sf_dir: str, segments: Sequence[str]) -> DataFrame:
    """Line items with the attributes that the wanted segments come from."""
    orders = table(spark, sf_dir, "orders")
    if {"agency", "borough"} & set(segments):
        customer = table(spark, sf_dir, "customer")
        if "borough" in segments:
            area = table(spark, sf_dir, "nation").join(
                table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
            )
            customer = customer.join(area, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    tickets = table(spark, sf_dir, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey"), "left"
    )
    if "complaint_type" in segments:
        part = table(spark, sf_dir, "part")
        tickets = tickets.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return tickets


def _key() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def _due() -> Column:
    return F.expr("timestampadd(DAY, 30 * int(substring(o_orderpriority, 1, 1)), o_orderdate)")


def _closed(value: Column) -> Column:
    return F.when(F.col("l_linestatus") == "F", value)


_SEGMENT_SOURCE = {
    "agency": "c_mktsegment",
    "complaint_type": "p_brand",
    "borough": "r_name",
    "status": "o_orderstatus",
}


def requests(
    spark: SparkSession, sf_dir: str, segments: Sequence[str] = SEGMENTS
) -> DataFrame:
    """Typed records: times are parsed already."""
    return _tickets(spark, sf_dir, segments).select(
        _key().alias("unique_key"),
        F.col("o_orderdate").alias("created_ts"),
        _due().alias("due_ts"),
        _closed(F.col("l_shipdate")).alias("closed_ts"),
        *[F.col(_SEGMENT_SOURCE[s]).alias(s) for s in SEGMENTS if s in segments],
    )


_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def iso_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid raw records: all fields are text, times in one format."""
    typed = requests(spark, sf_dir)
    return typed.select(
        F.col("unique_key").cast("string").alias("unique_key"),
        *[F.date_format(f"{t}_ts", _ISO).alias(f"{t}_date") for t in ("created", "due", "closed")],
        *SEGMENTS,
    )


def _untidy(moment: Column, k: Column) -> Column:
    """Mixed formats, NULLs and unreadable text, decided by a number of the row."""
    return (
        F.when(k % 20 == 0, None)
        .when(k % 20 == 1, "bad-date")
        .when(k % 3 == 0, F.date_format(moment, _ISO))
        .when(k % 3 == 1, F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(moment, "yyyy-MM-dd"))
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as they come: text fields, untidy dates, NULL types, duplicate keys."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    return _tickets(spark, sf_dir, SEGMENTS).select(
        _key().cast("string").alias("unique_key"),
        _untidy(F.col("o_orderdate"), part).alias("created_date"),
        _untidy(_due(), supplier).alias("due_date"),
        _closed(_untidy(F.col("l_shipdate"), part + supplier)).alias("closed_date"),
        F.col("c_mktsegment").alias("agency"),
        F.when(part % 50 != 0, F.col("p_brand")).alias("complaint_type"),
        F.col("r_name").alias("borough"),
        F.col("o_orderstatus").alias("status"),
    )


def aliased_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records under names that are only accepted aliases."""
    return raw_requests(spark, sf_dir).withColumnsRenamed(
        {
            "unique_key": "uniqueKey",
            "created_date": "created_ts",
            "due_date": "due_dt",
            "closed_date": "closedDate",
            "agency": "agency_name",
            "complaint_type": "complaint_category",
            "borough": "borough_name",
        }
    )
