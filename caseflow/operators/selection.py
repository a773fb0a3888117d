"""The first rows of a table by a total order, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values that split the candidates of a round, and the sample they are taken from.
PIVOTS = 64
SAMPLE = 512
#: Candidates that are ranked as rows rather than narrowed further, at most.
SETTLE = 10_000

_NUMBERS = (T.NumericType, T.BooleanType)


@dataclass(frozen=True)
class Cut:
    """Where the first rows end: rows that are ``certain`` to be in, and ``open`` ones of which ``places`` are."""

    certain: Column
    open: Column
    places: int


def narrow_keys(df: DataFrame, name: str) -> list[Column]:
    """Columns whose values can be sent to the driver and back, with the order of ``name``; none if there are none.

    NaN, the largest fraction, is a key of its own: statistics of files and caches leave it
    out, so a filter on the column itself could skip rows that hold it.
    """
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return [F.unix_date(column)]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return [F.unix_micros(column.cast("timestamp"))]
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        double = column.cast("double")
        return [F.when(column.isNotNull(), F.isnan(double).cast("int")), F.nanvl(double, F.lit(0.0))]
    return [column] if isinstance(kind, (*_NUMBERS, T.StringType)) else []


def _bin(key: Column, pivots: Sequence[object], low: int = 0, high: int | None = None) -> Column:
    """The number of pivots below ``key``, by binary search."""
    high = len(pivots) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key <= F.lit(pivots[mid]), _bin(key, pivots, low, mid)).otherwise(_bin(key, pivots, mid + 1, high))


def _pivots(keys: DataFrame, n: int, seed: int) -> list:
    """Up to ``PIVOTS`` distinct values in order, from some ``SAMPLE`` rows drawn of ``n``."""
    drawn = keys.sample(min(1.0, SAMPLE / n), seed).distinct().sort("key").collect()
    step = max(1, -(-len(drawn) // PIVOTS))
    return [r["key"] for r in drawn[step // 2 :: step]]


def _histogram(keys: DataFrame, pivots: Sequence[object]) -> list[tuple[int, bool, int]]:
    """(bin, equal, rows) in order: rows between two pivots, then those equal to the upper one."""
    at = _bin(F.col("key"), pivots)
    equal = F.coalesce(F.col("key") == F.try_element_at(F.array(*map(F.lit, pivots)), at + 1), F.lit(False))
    counts = keys.groupBy(at.alias("bin"), equal.alias("equal")).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["bin"], r["equal"], r["n"]) for r in counts.collect())


def find_cut(df: DataFrame, keys: Sequence[Column], limit: int, settle: int = SETTLE) -> Cut:
    """Where the first ``limit`` rows by ``keys``, each ascending with NULLs last, end.

    Key by key, the candidates are narrowed by histograms: values drawn from them split
    them into some 2 x ``PIVOTS`` cells, and only the cell in which the limit is reached
    is split again. A cell holds either the values between two pivots or one value; if it
    is one value, the next key tells its rows apart. A round reads the candidates' one key
    twice, sends one row per cell and task through the shuffle, and leaves a share of some
    1 / ``PIVOTS``; it ends when ``settle`` candidates or no keys are left. The draw only
    decides how fast the rounds get there.
    """
    certain, scope, places = F.lit(False), F.lit(True), limit
    for key in keys:
        found = df.filter(scope).agg(F.count(F.lit(1)), F.count(key)).first()
        n, valued = found[0], found[1]
        if n <= places:
            return Cut(certain | scope, F.lit(False), 0)
        if n <= settle:
            return Cut(certain, scope, places)
        if places >= valued:
            certain |= scope & key.isNotNull()
            scope &= key.isNull()
            places -= valued
            if places == 0:
                return Cut(certain, F.lit(False), 0)
            continue
        scope &= key.isNotNull()
        n, seed, one_value = valued, 0, False
        while not one_value:
            candidates = df.filter(scope).select(key.alias("key"))
            pivots, seed = _pivots(candidates, n, seed), seed + 1
            if not pivots:
                continue
            before = 0
            for at, one_value, n in _histogram(candidates, pivots):
                if before + n >= places:
                    break
                before += n
            if one_value:
                certain |= scope & (key < F.lit(pivots[at]))
                scope &= key == F.lit(pivots[at])
            else:
                if at > 0:
                    certain |= scope & (key <= F.lit(pivots[at - 1]))
                    scope &= key > F.lit(pivots[at - 1])
                if at < len(pivots):
                    scope &= key < F.lit(pivots[at])
            places -= before
            if n == places:
                return Cut(certain | scope, F.lit(False), 0)
            if n <= settle:
                return Cut(certain, scope, places)
    return Cut(certain, scope, places)


def leading_rows(df: DataFrame, by: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows: limited per split, then per bucket of splits, then together."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_bucket", F.spark_partition_id() % buckets)
    ranked = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by))
    leading = dealt.withColumn("_place", ranked).filter(F.col("_place") <= limit)
    return leading.drop("_bucket", "_place").orderBy(*by).limit(limit)


def smallest_rows(
    df: DataFrame, order: Column, ties: Sequence[str], limit: int, ordered: bool = True, settle: int | None = None
) -> DataFrame:
    """The first ``limit`` rows by a numeric key and then ``ties``, NULLs last, for limits of any size.

    The cut is searched when this is called (its jobs send back counts and drawn keys only), and
    the result is a lazy filter: rows before the cut come as they are read, and the at most
    ``settle`` candidates around it are ranked. So no task sees more than
    a share of the result: ``ordered`` rows are ranged over all shuffle partitions.
    Ties beyond the first column that is neither number, text nor time (or among rows that
    are the same in every column) are left to the ranking, whose last task then
    sees the missing rows of each bucket.

    ``df`` is read several times and must give the same rows each time.
    """
    if limit <= 0:
        return df.limit(0)
    by = [order.asc_nulls_last(), *[F.col(f"`{c}`").asc_nulls_last() for c in ties]]
    keys = [order]
    for name in ties:
        found = narrow_keys(df, name)
        if not found:
            break
        keys += found
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = find_cut(df, keys, limit, max(1, min(SETTLE, limit // buckets)) if settle is None else settle)
    rows = df.filter(cut.certain)
    if cut.places:
        rows = rows.unionByName(leading_rows(df.filter(cut.open), by, cut.places))
    return rows.orderBy(*by) if ordered else rows
