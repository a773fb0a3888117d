"""Small helpers shared by the operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words by white space: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The scratch folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. A local session without that setting (as in
    tests) gets a temporary folder once; a cluster without it is an error, since
    its executors would each write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="caseflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Small tables are written by at most LEAST_FILES tasks, larger ones by a task per so many rows.
LEAST_FILES = 8
ROWS_PER_FILE = 200_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage in a way that survives lost executors, lets later passes agree
    on the same rows, and gives Spark the size by which it chooses join strategies.
    The folder is scratch space: files stay until it is emptied after the job.
    ``rows``, a bound on the row count, keeps a small shuffled table from being
    written as one file per shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, rows // ROWS_PER_FILE))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and no other letters, in lower case; null becomes empty.

    ``lower`` is fast but changes all letters, so only plain ASCII texts take it.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(slow)


def words(text: Column, separators: str) -> Column:
    """The non-empty pieces of ``text`` between runs of ``separators``."""
    return F.array_remove(F.split(text, separators), "")


def with_result(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``; a column that has this name is kept as ``<name>_given``."""
    taken = {c.lower() for c in df.columns}
    clash = next((c for c in df.columns if c.lower() == name.lower()), None)
    if clash is None:
        return df.withColumn(name, value)
    kept = f"{name}_given"
    while kept.lower() in taken:
        kept += "_given"
    others = [F.col(f"`{c}`").alias(kept) if c == clash else F.col(f"`{c}`") for c in df.columns]
    return df.select(*others, value.alias(name))


#: Rows of ids up to which a set of ids is broadcast (some tens of MB as a hash table).
BROADCAST_ROWS = 1_000_000


def text_key(text: Column) -> Column:
    """A 64-bit hash that, with the id, tells apart rows that share an id."""
    return F.xxhash64(text)


def draw(seed: int, *columns: Column) -> Column:
    """A fixed number in [0, 1) per row, by hash: below p lies a share p of different rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


def without_rows(df: DataFrame, id_col: str, text_col: str, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows whose id and text key are in ``dropped`` (two columns); nulls match nulls.

    The keys are broadcast only if counted and few; otherwise both sides are shuffled.
    """
    keys = cut(dropped.toDF("__id", "__key"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (text_key(F.col(text_col)) == F.col("__key"))
    return df.join(keys, same, "left_anti")
