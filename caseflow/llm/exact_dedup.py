"""Exact dedup by two passes over a Bloom filter.

Pass one counts the filter cells that the text hashes fall into (two narrow numbers a
row are shuffled, added up on the map side first); cells hit more than once form a
second filter, kept as bitmaps. Pass two tests every row against
it: rows that miss a cell are surely unique and pass straight through, and only
the rest ("possibly repeated") is shuffled and compared by full hash.

The filter is blocked: both cells of a hash lie in one page of 32,768 bits, so a
test is one lookup. Its size follows the row count up to ``MAX_FILTER_BITS`` (128
MB), the proven bound of what is broadcast. Beyond that many rows more unique
rows are taken for possible repeats and shuffled; results stay exact.

Defined results: a null text counts as empty, and all empty texts are equal. Among
equal texts the largest id stays; null ids rank lowest. Rows that repeat text and
id count in ``group_size`` and share a verdict; ``deduplicate`` keeps one of them.
Other columns are carried by ``deduplicate`` and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import ascii_lower, cut

PAGE_BITS = 32768
MAX_FILTER_BITS = 1 << 30
BITS_PER_ROW = 32


def text_sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lowered; null counts as empty."""
    return F.sha2(ascii_lower(text), 256)


def filter_pages(rows: int) -> int:
    """Pages for ``rows`` hashes: 32 bits a row, rounded up to a power of two, bounded."""
    bits = max(PAGE_BITS, min(MAX_FILTER_BITS, rows * BITS_PER_ROW))
    return 1 << ((bits // PAGE_BITS) - 1).bit_length()


def _page(sha: Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(pages))


def _cells(sha: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(PAGE_BITS)) for i in (1, 2)]


def repeated_cells(keys: DataFrame, pages: int) -> DataFrame:
    """Pass one: (page, bits), the bitmap of the cells hit at least twice."""
    hits = keys.select(
        _page(F.col("sha"), pages).alias("page"),
        F.explode(F.array_distinct(F.array(*_cells(F.col("sha"))))).alias("cell"),
    )
    repeated = hits.groupBy("page", "cell").agg(F.count("*").alias("hits")).where("hits > 1")
    return repeated.groupBy("page").agg(F.bitmap_construct_agg("cell").alias("bits"))


def _is_set(bits: Column, cell: Column) -> Column:
    byte = F.substring(bits, (cell / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (cell % 8).cast("int")) == 1


def possibly_repeated(df: DataFrame, sha: str, cells: DataFrame, pages: int, name: str) -> DataFrame:
    """Pass two: ``df`` with a boolean ``name``. The broadcast is bounded by the filter's size."""
    found = cells.select(F.col("page").alias("__page"), F.col("bits").alias("__bits"))
    tested = df.join(F.broadcast(found), _page(F.col(sha), pages) == F.col("__page"), "left")
    first, second = (_is_set(F.col("__bits"), c) for c in _cells(F.col(sha)))
    return tested.withColumn(name, F.coalesce(first & second, F.lit(False))).drop("__page", "__bits")


def _groups(repeated: DataFrame, rows: int) -> DataFrame:
    groups = repeated.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return cut(groups, rows)


def _tested_keys(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    """The keys with ``maybe``, the filter, its pages, and the number of rows."""
    keys = cut(df.select(F.col(id_col).alias("id"), text_sha256(F.col(text_col)).alias("sha")))
    rows = keys.count()
    pages = filter_pages(rows)
    cells = cut(repeated_cells(keys, pages), rows)
    return possibly_repeated(keys, "sha", cells, pages, "maybe"), cells, pages, rows


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Groups of possible repeats are aggregated on the map side first, so a group
    with a third of all rows sends one row per task; joined back to the rows, a
    large group is split by adaptive execution (both sides come from tables).
    """
    tested, _, _, rows = _tested_keys(df, id_col, text_col)
    groups = _groups(tested.where("maybe"), rows)
    shuffled = tested.where("maybe").join(groups, "sha").select("id", "sha", "keep_id", "group_size")
    through = tested.where("not maybe").select(
        "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return through.unionByName(shuffled).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Unique rows pass through without a shuffle; of the others, the row to keep is
    found by joining on hash and id, a key that no two groups share.
    """
    tested, cells, pages, n_rows = _tested_keys(df, id_col, text_col)
    keepers = _groups(tested.where("maybe"), n_rows).select(
        F.col("sha").alias("__keep_sha"), F.col("keep_id").alias("__keep_id")
    )
    rows = df.withColumn("__sha", text_sha256(F.col(text_col)))
    rows = possibly_repeated(rows, "__sha", cells, pages, "__maybe")
    kept = rows.where("__maybe").join(
        keepers,
        (F.col("__sha") == F.col("__keep_sha")) & F.col(id_col).eqNullSafe(F.col("__keep_id")),
        "left_semi",
    )
    kept = kept.dropDuplicates(["__sha"])
    return rows.where("not __maybe").unionByName(kept).drop("__sha", "__maybe")
