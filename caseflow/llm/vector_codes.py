"""Vector code compression: product codes by Lloyd's rounds over cover trees.

Vectors become integers, floor(``SCALE`` x), and are cut into ``PARTS`` equal parts.
Each part position has a codebook of up to ``ENTRIES`` entries, at first the parts of
the vectors with the smallest ids. A round assigns every part to its nearest entry and
moves each entry to the floor of its parts' mean; a vector's code is its parts' final
entries.

Every task builds cover trees over its own vectors, ``CHUNK`` at a time, one for each
part position: a node covers its points from a centre, its children's centres are more
than half of its radius apart, and points lie in tree order, so that cumulative sums
give the sum of any subtree. The trees are written once and serve all rounds. To
assign, a node's centre is compared with the codebook. If the nearest entry is nearer
than the next one by more than twice the node's radius, the triangle inequality gives
that entry to the whole subtree, which adds its sum and count in one step. Only
ambiguous nodes descend, at last to exact comparisons of integers. A round's sums have
a fixed size (parts x entries x components), so nothing else leaves the tasks.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped. Ties go to the entry with the lower index. Entries start in order of id (null
last, then vector, then label); there are as many as kept rows if these are fewer than
``ENTRIES``. Rows that repeat an id are coded row by row. Null labels are one label. An
empty table gives an empty result. Vectors of different lengths, of a length that is no
multiple of ``PARTS``, or with components of ``LARGEST`` or more are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import BROADCAST_ROWS, cut

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = float(1 << 18)  # so that squared distances stay far inside 64 bits
CHUNK = 8192
LEAF = 32


# --- cover trees ------------------------------------------------------------------------


@dataclass
class CoverTree:
    """Points in tree order; node i covers points begin[i] to end[i] within radius[i] of its centre."""

    points: np.ndarray
    order: np.ndarray  # of each point its row in the chunk
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray  # as a place in points
    radius: np.ndarray
    first: np.ndarray  # first child
    children: np.ndarray

    KINDS = (np.int32, np.int32, np.int32, np.int32, np.float64, np.int32, np.int32)

    def pack(self) -> bytes:
        """The arrays in a row, points in the smallest integers that hold them."""
        kind = next(k for k in ("int16", "int32", "int64") if not self.points.size or np.abs(self.points).max() <= np.iinfo(k).max)
        head = np.array([*self.points.shape, len(self.begin), np.dtype(kind).itemsize], np.int64)
        rest = (self.order, self.begin, self.end, self.centre, self.radius, self.first, self.children)
        return b"".join([head.tobytes(), self.points.astype(kind).tobytes(), *(x.astype(k).tobytes() for x, k in zip(rest, self.KINDS))])

    @classmethod
    def unpack(cls, data: bytes) -> CoverTree:
        n, width, nodes, size = np.frombuffer(data, np.int64, 4).tolist()
        at = 32 + n * width * size
        points = np.frombuffer(data, f"i{size}", n * width, 32).astype(np.int64).reshape(n, width)
        rest = []
        for kind, count in zip(cls.KINDS, (n, *[nodes] * 6)):
            rest.append(np.frombuffer(data, kind, count, at))
            at += count * np.dtype(kind).itemsize
        return cls(points, *rest)

    def sums(self) -> np.ndarray:
        """Cumulative sums: those of points a to b are sums[b] - sums[a]."""
        return np.concatenate((np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0)))


def _squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points from all others."""
    found = np.zeros((len(points), len(others)), np.int64)
    for k in range(points.shape[1]):
        found += (points[:, k, None] - others[None, :, k]) ** 2
    return found


def build(points: np.ndarray) -> CoverTree:
    """A cover tree of the rows of ``points``, by halving radii from the top."""
    order = np.arange(len(points))
    begin, end, centre, radius, first, children = [0], [len(points)], [0], [], [], []
    node = 0
    while node < len(begin):
        a, b = begin[node], end[node]
        own, middle = order[a:b], centre[node]
        away = ((points[own] - points[middle]) ** 2).sum(axis=1)
        most = int(away.max(initial=0))
        radius.append(float(np.sqrt(most)))
        if b - a <= LEAF or most == 0:
            first.append(0)
            children.append(0)
        else:
            child = np.where(4 * away <= most, 0, -1)
            middles, left = [middle], np.flatnonzero(child < 0)
            while len(left):  # the next centre is beyond half the radius of all before
                middles.append(own[left[0]])
                near = 4 * ((points[own[left]] - points[middles[-1]]) ** 2).sum(axis=1) <= most
                child[left[near]] = len(middles) - 1
                left = left[~near]
            order[a:b] = own[np.argsort(child, kind="stable")]
            bounds = a + np.concatenate(([0], np.cumsum(np.bincount(child, minlength=len(middles)))))
            first.append(len(begin))
            children.append(len(middles))
            begin.extend(bounds[:-1].tolist())
            end.extend(bounds[1:].tolist())
            centre.extend(middles)
        node += 1
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    nodes = [np.array(x, np.int64) for x in (begin, end)]
    middles = place[np.array(centre, np.int64)] if len(points) else np.zeros(1, np.int64)
    return CoverTree(points[order], order, *nodes, middles, np.array(radius), np.array(first, np.int64), np.array(children, np.int64))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each start, counts of them, in a row."""
    total = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(total[-1]) - np.repeat(total[:-1] - starts, counts)


def assign(tree: CoverTree, book: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((nodes, entries), (points, entries)): subtrees given to an entry as a whole, and points compared exactly."""
    wholes, singles = [], []
    level = np.zeros(int(len(tree.points) > 0), np.int64)
    while len(level):
        squares = _squares(tree.points[tree.centre[level]], book)
        best = squares.argmin(axis=1)
        if len(book) > 1:
            two = np.sqrt(np.partition(squares, 1, axis=1)[:, :2].astype(np.float64))
            reach = 2 * tree.radius[level]
            sure = two[:, 1] - two[:, 0] > reach + 1e-9 * (1 + reach + two[:, 1])
        else:
            sure = np.ones(len(level), bool)
        wholes.append((level[sure], best[sure]))
        level = level[~sure]
        leaf = tree.children[level] == 0
        at = _spread(tree.begin[level[leaf]], (tree.end - tree.begin)[level[leaf]])
        singles.append((at, _squares(tree.points[at], book).argmin(axis=1)))
        level = _spread(tree.first[level[~leaf]], tree.children[level[~leaf]])

    def joined(pairs: list) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.asarray(p[k], np.int64) for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))

    return joined(wholes), joined(singles)


def entry_sums(tree: CoverTree, book: np.ndarray) -> np.ndarray:
    """Per entry: how many points it gets, and the sum of each component."""
    (nodes, whole), (at, single) = assign(tree, book)
    found, total = np.zeros((len(book), 1 + tree.points.shape[1]), np.int64), tree.sums()
    np.add.at(found[:, 0], whole, (tree.end - tree.begin)[nodes])
    np.add.at(found[:, 1:], whole, total[tree.end[nodes]] - total[tree.begin[nodes]])
    np.add.at(found[:, 0], single, 1)
    np.add.at(found[:, 1:], single, tree.points[at])
    return found


def entries_of(tree: CoverTree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point, by row of the chunk."""
    (nodes, whole), (at, single) = assign(tree, book)
    entry = np.empty(len(tree.points), np.int64)
    sizes = (tree.end - tree.begin)[nodes]
    entry[_spread(tree.begin[nodes], sizes)] = np.repeat(whole, sizes)
    entry[at] = single
    far = ((tree.points - book[entry]) ** 2).sum(axis=1) if len(entry) else np.zeros(0, np.int64)
    by_row = np.empty((2, len(entry)), np.int64)
    by_row[:, tree.order] = entry, far
    return by_row[0], by_row[1]


# --- on Spark ---------------------------------------------------------------------------


def kept_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows whose vector is whole and finite."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.coalesce(finite, F.lit(False)))


def _grow(rows: DataFrame, parts: int) -> DataFrame:
    """Chunks of rows with their cover trees: ids, labels, trees (one per part), as a written table."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    types = [pa.list_(rows.select(c).limit(0).toArrow().schema.field(0).type) for c in ("id", "label")]

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def chunks() -> Iterator[pa.Table]:
            nonlocal held
            for batch in batches:
                held.append(pa.Table.from_batches([batch]))
                while sum(map(len, held)) >= CHUNK:
                    whole = pa.concat_tables(held)
                    yield whole.slice(0, CHUNK)
                    held = [whole.slice(CHUNK)]
            if sum(map(len, held)):
                yield pa.concat_tables(held)

        for chunk in chunks():
            vectors = chunk.column(2).combine_chunks()
            values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).reshape(len(chunk), -1)
            trees = [build(np.ascontiguousarray(x)).pack() for x in np.split(values, parts, axis=1)]
            columns = [pa.array([chunk.column(k).to_pylist()], types[k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    return cut(rows.mapInArrow(grown, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees array<binary>"))


def _round(chunks: DataFrame, books: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The codebooks moved to the floors of their parts' means; unused entries stay."""
    shape = (len(books), len(books[0]), 1 + books[0].shape[1])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for trees in batch.column(0).to_pylist():
                for part, packed in enumerate(trees):
                    total[part] += entry_sums(CoverTree.unpack(packed), books[part])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["place", "value"])

    sums = chunks.select("trees").mapInArrow(summed, "place long, value long").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(shape, np.int64)
    for r in sums.collect():  # one number per part, entry and component
        total.ravel()[r["place"]] = r["value"]
    moved = []
    for book, found in zip(books, total):
        used = found[:, 0] > 0
        moved.append(np.where(used[:, None], found[:, 1:] // np.maximum(found[:, :1], 1), book))
    return moved


def _codes(chunks: DataFrame, books: Sequence[np.ndarray], id_kind: str, label_kind: str) -> DataFrame:
    """(id, label, code, error) of every row."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(batch.column(2).to_pylist()):
                found = [entries_of(CoverTree.unpack(packed), book) for packed, book in zip(trees, books)]
                entries = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                error = np.sum([f[1] for f in found], axis=0)
                columns = [batch.column(k)[i].values for k in (0, 1)]
                codes = pa.array([row.tobytes().hex() for row in entries], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, codes, pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return chunks.mapInArrow(coded, f"id {id_kind}, label {label_kind}, code string, error long")


def digest(books: Sequence[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, in decimal."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def learn(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(chunks with their trees, final codebooks); no codebooks for an empty table."""
    rows = kept_rows(df, id_col, vector_col, label_col)
    low, high, most = rows.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if low is None:
        return None, []
    if low != high or low % parts or (most or 0) >= LARGEST:
        raise ValueError(f"Vectors of one length, a multiple of {parts}, and components under {LARGEST:g} are asked for.")
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), "vector", F.col("label").asc_nulls_last())
    seeds = np.array([r["vector"] for r in ordered.limit(entries).select("vector").collect()], np.float64).reshape(-1, low)
    books = [np.ascontiguousarray(x) for x in np.split(np.floor(SCALE * seeds).astype(np.int64), parts, axis=1)]
    chunks = _grow(rows, parts)
    for _ in range(rounds):
        books = _round(chunks, books)
    return chunks, books


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: id, code, error, label_error, codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError(f"A code has one byte per part, so 1 to 256 entries, not {entries}.")
    id_kind, label_kind = (df.schema[c].dataType.simpleString() for c in (id_col, label_col))
    chunks, books = learn(df, id_col, vector_col, label_col, parts, entries, rounds)
    if chunks is None:
        schema = f"`{id_col}` {id_kind}, code string, error long, label_error long, codebooks_sha256 string"
        return df.sparkSession.createDataFrame([], schema)
    coded = cut(_codes(chunks, books, id_kind, label_kind))
    by_label = cut(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")))
    if by_label.count() <= BROADCAST_ROWS:
        by_label = F.broadcast(by_label)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("same")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
