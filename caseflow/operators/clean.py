"""Row filter and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def drop_undated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("created_date").isNotNull())


def keep_first(df: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the smallest by ``order`` with NULLs last.

    ``order`` defaults to all other columns, so rows that still tie are equal
    and the result does not depend on how the data is split. NULL keys form one
    group. Spark keeps only the first row per key on the map side already
    (``WindowGroupLimit ... Partial``), so a key that holds a large share of
    all rows sends one row per map task through the shuffle.
    """
    order = [c for c in df.columns if c != key] if order is None else order
    ranked = Window.partitionBy(key).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order])
    return df.withColumn("_position", F.row_number().over(ranked)).filter(
        F.col("_position") == 1
    ).drop("_position")


PAGE_BITS = 32768
FILTER_BITS = 1 << 28


def _shared_cells(df: DataFrame, key: str, pages: int) -> DataFrame:
    """(page, bits): of each page of the filter, the cells into which more than one row falls."""
    hits = df.select(*_cell(key, pages)).groupBy("__page", "__cell").agg(F.count("*").alias("hits"))
    shared = hits.filter("hits > 1").groupBy("__page")
    return shared.agg(F.bitmap_construct_agg("__cell").alias("__bits"))


def _cell(key: str, pages: int) -> tuple[Column, Column]:
    page = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(pages))
    cell = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(1)), F.lit(PAGE_BITS))
    return page.alias("__page"), cell.alias("__cell")


def keep_first_narrow(
    df: DataFrame, key: str, order: Sequence[str] | None = None, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The rows of ``keep_first``; rows whose key surely occurs once are not shuffled.

    For wide rows with few repeated keys. Pass one reads the key alone and counts the
    rows that fall into each of ``filter_bits`` cells of its hash; the cells with more
    than one row are broadcast as bitmaps, ``filter_bits / 8`` bytes at most (32 MB by
    default). Pass two sends rows of other cells straight through, and only the rest
    through ``keep_first``. With n rows some n / filter_bits of the keys that occur
    once share a cell with another and take the longer way, so state more bits for
    more rows. No result depends on the bits.

    ``df`` is read by both passes, and by both branches of the second, so it has to
    give the same rows each time, as files do. A key of a collation by which different
    texts are equal goes by ``keep_first`` alone.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, StringType) and not kind.isUTF8BinaryCollation():
        return keep_first(df, key, order)
    order = [c for c in df.columns if c != key] if order is None else order
    pages = max(1, filter_bits // PAGE_BITS)
    cells = _shared_cells(df, key, pages)
    own = "_" * max(len(c) for c in df.columns)  # so that no column of the caller has these names
    page, cell = (c.alias(own + n) for c, n in zip(_cell(key, pages), ("page", "cell")))
    cells = cells.toDF(f"{own}page", f"{own}bits")
    marked = df.select("*", page, cell).join(F.broadcast(cells), f"{own}page", "left")
    place = F.col(f"{own}cell")
    byte = F.conv(F.hex(F.substring(f"{own}bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    shared = F.coalesce(F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in df.columns]
    repeated = keep_first(marked.filter(shared).select(*columns), key, order)
    return marked.filter(~shared).select(*columns).unionByName(repeated)


def clean(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Dated records, one per ``unique_key``; ``narrow`` picks them by ``keep_first_narrow``."""
    keep = keep_first_narrow if narrow else keep_first
    return keep(drop_undated(df), "unique_key")
