"""Snapshots of raw and processed records as folders of JSON lines."""

from __future__ import annotations

import tempfile
import warnings
from collections.abc import Callable, Sequence
from datetime import datetime
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Times keep their microseconds in JSON lines.
TIME_FORMATS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for data that all executors reach.

    A local session that names none, as in tests, gets one of its own. On a
    cluster that is an error: every executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="caseflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def snapshot_path(base: str, kind: str, at: datetime | None = None) -> str:
    """``base/kind_YYYYmmdd_HHMMSS``, unique also within a second."""
    stamp = (at or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return f"{base.rstrip('/')}/{kind}_{stamp}_{uuid4().hex[:8]}"


#: Names what a published folder holds; written before the folder gets its name.
MANIFEST = "_manifest"


def _place(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``, whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_published(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was finished: its manifest and every part that it names are there."""
    files, place = _place(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not files.exists(place):
        return False
    stream = files.open(place)
    try:
        named = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")[1:]
    finally:
        stream.close()
    return all(files.exists(_place(spark, f"{path.rstrip('/')}/{name}")[1]) for name in named)


def staged(spark: SparkSession, path: str) -> str:
    """A folder beside ``path`` that no reader looks into."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_staging-{name}-{uuid4().hex}" if parent or path.startswith("/") else f"_staging-{name}-{uuid4().hex}"


def publish(spark: SparkSession, staging: str, path: str, rows: int) -> str:
    """Gives a finished folder its name, with a manifest of its rows and parts.

    Readers that ask ``is_published`` accept the folder only if it is whole, also in a
    store where renaming a folder moves its files one by one.
    """
    files, source = _place(spark, staging)
    target = _place(spark, path)[1]
    if files.exists(target):
        raise FileExistsError(f"{path} exists already")
    parts = sorted(f.getPath().getName() for f in files.listStatus(source) if f.isFile())
    out = files.create(_place(spark, f"{staging}/{MANIFEST}")[1])
    try:
        out.write(bytearray("\n".join([str(rows), *(p for p in parts if p.startswith("part-"))]).encode()))
    finally:
        out.close()
    if target.getParent() is not None:
        files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{staging} cannot be renamed to {path}")
    return path


def published(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published folders in ``folder``, in order."""
    files, place = _place(spark, folder)
    if not files.exists(place):
        return []
    names = sorted(f.getPath().getName() for f in files.listStatus(place) if f.isDirectory())
    return [name for name in names if not name.startswith("_") and is_published(spark, f"{folder.rstrip('/')}/{name}")]


def discard(spark: SparkSession, staging: str) -> None:
    """Removes a staging folder of our own."""
    files, place = _place(spark, staging)
    files.delete(place, True)


def _figures(seen: Observation) -> dict | None:
    """What was observed; None if the optimizer knew that there is nothing to observe."""
    try:
        return seen.get
    except Py4JJavaError:
        return None


def publish_rows(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> str:
    """Writes ``df`` by ``write(frame, folder)`` to a staging folder and publishes it."""
    spark = df.sparkSession
    if _place(spark, path)[0].exists(_place(spark, path)[1]):
        raise FileExistsError(f"{path} exists already")
    staging, seen = staged(spark, path), Observation()
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")), staging)
        return publish(spark, staging, path, (_figures(seen) or {"rows": 0})["rows"])
    except Exception:
        discard(spark, staging)
        raise


#: Records of one part; a compressed part is read by one task.
RECORDS_PER_PART = 200_000


def write_snapshot(
    df: DataFrame,
    path: str,
    partitions: int | None = None,
    max_records: int | None = RECORDS_PER_PART,
    compression: str = "lz4",
) -> str:
    """Publish a new folder of JSON-line parts, never merged into one file.

    By default every task writes the rows it holds; ``partitions`` spreads
    them evenly over so many files, which costs a shuffle. ``max_records``
    bounds the size of a file without one. JSON repeats all names in every record, so
    parts are compressed, by a codec that costs next to no time; ``compression`` names
    another one, or ``none``, for readers that do not know it. NULL fields are left out, so read
    back with ``read_snapshot`` and the written schema. A write that fails half-way
    leaves no folder of this name.
    """

    def write(frame: DataFrame, folder: str) -> None:
        writer = (frame if partitions is None else frame.repartition(partitions)).write
        if max_records:
            writer = writer.option("maxRecordsPerFile", max_records)
        writer.mode("errorifexists").options(**TIME_FORMATS).json(folder, compression=compression)

    return publish_rows(df, path, write)


def write_rows(df: DataFrame, path: str, day_column: str | None = None) -> DataFrame:
    """A run's own intermediate: Parquet, read again; by ``day_column`` in folders if given."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(day_column) if day_column else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # stated, as no rows may mean no files


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a published snapshot; any other folder is an error."""
    if not is_published(spark, path):
        raise ValueError(f"{path} holds no finished snapshot")
    return spark.read.schema(schema).options(**TIME_FORMATS).json(path)


def try_write_snapshot(df: DataFrame, path: str | None, **options) -> str | None:
    """Write if a path is given; a failed write is a warning, the run goes on."""
    if path is None:
        return None
    try:
        return write_snapshot(df, path, **options)
    except Exception as problem:  # noqa: BLE001 - any failed write is only a warning here
        _warn(problem)
        return None


def _warn(problem: Exception) -> None:
    warnings.warn(f"snapshot not written: {problem}", stacklevel=3)


def _ran_again(spark: SparkSession, group: str) -> bool:
    """Whether a stage of the group's jobs was run again, say after a lost executor."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for job in jobs if job for s in job.stageIds]
    return any(stage is not None and stage.currentAttemptId > 0 for stage in stages)


def try_stage_observed(
    df: DataFrame, path: str, observed: DataFrame, counts: Sequence[Column], then
) -> tuple[str | None, dict | None]:
    """(folder, counts): Parquet of ``then(observed)`` in a staging folder of ``path``, and figures of ``observed``.

    One pass reads, counts and writes. Counts are None if a stage had to run again (its
    rows may then have been counted twice) or nothing was read; the caller counts anew. A failed
    write is a warning, without a folder.
    """
    spark, seen = df.sparkSession, Observation()
    staging, group = staged(spark, path), f"observed-{uuid4().hex}"
    before = {k: spark.sparkContext.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    try:
        rows = then(observed.observe(seen, *counts))
        spark.sparkContext.setJobGroup(group, "records read, counted and written")
        rows.write.mode("errorifexists").parquet(staging)
    except Exception as problem:  # noqa: BLE001 - any failed write is only a warning here
        discard(spark, staging)
        _warn(problem)
        return None, None
    finally:
        for key, value in before.items():
            spark.sparkContext.setLocalProperty(key, value)
    return staging, None if _ran_again(spark, group) else _figures(seen)


def try_publish(spark: SparkSession, staging: str, path: str) -> DataFrame | None:
    """The rows of a staging folder under their own name; a failure is a warning."""
    try:
        return spark.read.parquet(publish(spark, staging, path, spark.read.parquet(staging).count()))
    except Exception as problem:  # noqa: BLE001 - any failed write is only a warning here
        discard(spark, staging)
        _warn(problem)
        return None
