"""Reports over batches of records that are read once and kept as cells."""

from __future__ import annotations

from datetime import date
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import cells, kpis
from caseflow.sources import snapshots


class KeptReports:
    """A folder of batches, each the cells and sketch states of its records.

    A batch has a name, say its day. It is published whole or not at all, and adding a
    name again changes nothing, so a run that is repeated after a failure counts no
    record twice. A record belongs to one batch: duplicates are settled inside a batch.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, batch: str, rows: DataFrame, sketch_keys: tuple[str, ...] = ()) -> bool:
        """Keeps ``measures`` rows as a batch; False if it is kept already.

        With ``sketch_keys``, sketch states per these keys are kept beside the cells. The
        cells are published last, and a batch without them does not count.
        """
        name = quote(batch, safe="")
        if snapshots.is_published(self.spark, f"{self.folder}/cells/{name}"):
            return False

        def write(frame: DataFrame, folder: str) -> None:
            frame.write.parquet(folder)

        if sketch_keys and not snapshots.is_published(self.spark, f"{self.folder}/sketches/{name}"):
            snapshots.publish_rows(cells.sketch_states(rows, sketch_keys), f"{self.folder}/sketches/{name}", write)
        snapshots.publish_rows(cells.day_cells(rows), f"{self.folder}/cells/{name}", write)
        return True

    def batches(self) -> list[str]:
        return [unquote(name) for name in snapshots.published(self.spark, f"{self.folder}/cells")]

    def _read(self, kind: str, batches: list[str] | None) -> DataFrame:
        kept = self.batches()
        names = kept if batches is None else batches
        if missing := [b for b in names if b not in kept]:
            raise ValueError(f"not kept: {', '.join(missing)}")
        if not names:
            raise ValueError("no batch is kept")
        return self.spark.read.parquet(*[f"{self.folder}/{kind}/{quote(b, safe='')}" for b in names])

    def cells(self, start: date | None = None, end: date | None = None, batches: list[str] | None = None) -> DataFrame:
        """The cells of the batches (all of them by default), of records created from ``start`` to ``end``."""
        found = self._read("cells", batches)
        if start is not None:
            found = found.filter(F.col("created_day") >= F.lit(start))
        if end is not None:
            found = found.filter(F.col("created_day") <= F.lit(end))
        return cells.add_cells(found)

    def pack(self, as_of: str | date | None = None, limits: kpis.Limits = kpis.Limits(), **chosen) -> DataFrame:
        """The KPI pack over the kept records, with ages at ``as_of``; no record is read."""
        return kpis.kpi_pack(cells.cube_of_cells(self.cells(**chosen), as_of, limits))

    def quantiles(self, keys: tuple[str, ...], batches: list[str] | None = None) -> DataFrame:
        """Median and 90 % quantile of the resolution days per key, from merged sketches."""
        return cells.sketched_quantiles(cells.merge_sketches(self._read("sketches", batches), keys))
