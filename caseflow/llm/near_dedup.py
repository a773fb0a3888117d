"""Near duplicates by a MinHash LSH forest, links confirmed on full shingle sets.

1. Sketch: every text becomes its set of distinct five-word shingles (64-bit
   hashes), the set's own hash, and a MinHash signature. Texts with equal sets form
   one class; only one member per class goes on.
2. Forest: each of its trees sorts all classes by its own rotation of the whole
   signature. Classes that share the first ``DEPTH`` positions are a region of the
   sorted order. Neighbours in a region are candidates if their whole signatures
   agree well enough. A crowded region is cut at deeper common prefixes, as deep as
   the signature goes (adaptive depth); neighbouring cuts overlap, and the linked
   parts of a region's cuts meet again through one class each. Sorting is by range
   over tree, signature and class, so that no region, however hot, meets in one task.
   Where a task or a batch ends within a region, the rows on both sides meet.
3. Families: the candidates' connected components. They are wider than the result.
4. Confirmation: the full sets of a family are dealt to blocks of some ``BLOCK``
   classes or ``BLOCK_BYTES``. A few classes of the family, its anchors, are in every
   block. All pairs of a block are tested at once, as a matrix product. Only families
   of several blocks that fall apart are tested further: every class outside the
   family's largest part against all of the family. So every pair is tested or
   joined already, and a family of near copies costs as much as it has members.
5. Components of the confirmed links give the answer.

The caller states the least similarity of a link in percent, ``PERCENT`` if not. The
number of trees and the agreement asked of candidates follow from it: a pair at the
threshold shares no region with probability (1 - s**4)**trees, below ``LOSS``, and
agrees too little with a probability below ``LOSS``. A pair is lost only if no chain of
candidates joins it either.

Defined results: null and wordless texts have no shingles and link with nothing,
each its own component. Texts of fewer than five words have their word sequence as
the only shingle. Rows that repeat id and text are judged alike. Null ids never name a
component unless all ids of it are null. Set hashes have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import BROADCAST_ROWS, cut, text_key, without_rows
from caseflow.llm.word_arrays import Group, groups, mix, random_numbers

SHINGLE = 5
PERCENT = 80
LOSS = 1e-5
DEPTH = 4
KEY = 8
REGION = 512
OVERLAP = 8
BLOCK = 256
BLOCK_BYTES = 32 << 20
ANCHORS = 8
ROWS_PER_TASK = 500_000

_U = np.uint64
_PLACES = random_numbers(SHINGLE, 211)


@dataclass(frozen=True)
class Forest:
    """A least similarity, and the trees and agreement that find pairs of it."""

    percent: int
    trees: int
    agree: int  # signature positions, of all, that candidates must share
    region: int = REGION  # rows of a region from which on it is cut deeper

    @property
    def hashes(self) -> int:
        return self.trees * DEPTH


def forest_for(percent: int) -> Forest:
    """The fewest trees, and the strictest agreement, that each lose under LOSS of the pairs at ``percent``."""
    if not 1 <= percent <= 100:
        raise ValueError(f"The least similarity is 1 to 100 percent, not {percent}.")
    share = percent / 100
    miss = 1 - share**DEPTH
    trees = max(2, math.ceil(math.log(LOSS) / math.log(miss))) if miss > 0 else 2
    hashes, agree, below = trees * DEPTH, 0, 0.0
    while agree < hashes:
        below += math.comb(hashes, agree) * share**agree * (1 - share) ** (hashes - agree)
        if below > LOSS:
            break
        agree += 1
    return Forest(percent, trees, agree)


# --- shingles and signatures ------------------------------------------------------------


def shingle_sets(group: Group) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the group."""
    hashes = group.hashes(lower=True)
    full = np.zeros(0, np.uint64)
    if len(hashes) >= SHINGLE:
        full = sum(hashes[j : len(hashes) - SHINGLE + 1 + j] * _PLACES[j] for j in range(SHINGLE))
        full = mix(full)
    for a, b in zip(group.word_bounds[:-1], group.word_bounds[1:]):
        if b - a >= SHINGLE:
            yield np.unique(full[a : b - SHINGLE + 1])
        elif b > a:
            short = (hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True) + _U(b - a)
            yield mix(short)
        else:
            yield full[:0]


def set_hash(values: np.ndarray) -> int:
    """A hash of a whole sorted set."""
    steps = np.arange(1, len(values) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    total = mix(values + steps).sum(keepdims=True) + _U(len(values))
    return int(mix(total).view(np.int64)[0])


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A 32-bit minimum hash per factor."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 2048):
        part = values[a : a + 2048]
        least = np.minimum(least, (part[:, None] * factors[None, :]).min(axis=0))
    return (mix(least) >> _U(32)).astype(np.uint32)


def sketch(df: DataFrame, id_col: str, text_col: str, hashes: int) -> DataFrame:
    """Per row: id, text_key, n_shingles, node (set hash; null without shingles), signature, low bytes."""
    factors = random_numbers(hashes, 101)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, signatures, lows = [], [], [], []
            for group in groups(batch.column(1)):
                for values in shingle_sets(group):
                    counts.append(len(values))
                    own = signature(values, factors) if len(values) else None
                    nodes.append(set_hash(values) if len(values) else None)
                    signatures.append(None if own is None else own.astype(">u4").tobytes())
                    lows.append(None if own is None else own.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(signatures, pa.binary()), pa.array(lows, pa.binary())],
                names=["id", "text_key", "n_shingles", "node", "signature", "low"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text_key long, n_shingles long, node long, signature binary, low binary"
    rows = df.select(F.col(id_col).alias("id"), text_col, text_key(F.col(text_col)).alias("text_key"))
    return rows.mapInArrow(sketched, schema)


# --- forest -----------------------------------------------------------------------------


def _linked_parts(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row of its connected part."""
    label = np.arange(len(close))
    close = close | np.eye(len(close), dtype=bool)
    while True:
        new = np.where(close, label[None, :], len(close)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cuts(keys: np.ndarray, depth: int, low: int, high: int, region: int | None = None) -> Iterator[tuple[int, int]]:
    """Cuts a sorted region into runs of at most ``region`` rows, at the shallowest prefixes.

    Rows that share all columns, and so agree everywhere, are cut by count.
    """
    region = region or REGION
    if high - low <= region:
        yield low, high
        return
    if depth == keys.shape[1]:
        for a in range(low, high, region):
            yield a, min(a + region, high)
        return
    part = keys[low:high, depth]
    edges = [low, *(np.flatnonzero(part[1:] != part[:-1]) + low + 1).tolist(), high]
    start = low
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > region:
            if a > start:
                yield start, a
            yield from _cuts(keys, depth + 1, a, b, region)
            start = b
        elif b - start > region:
            yield start, a
            start = a
    if start < high:
        yield start, high


def _close(low: np.ndarray, least: int) -> np.ndarray:
    agree = np.zeros((len(low), len(low)), np.uint16)
    for column in low.T:
        agree += column[:, None] == column[None, :]
    return agree >= least


def _stars(part: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the row of its part's smallest node: (centre rows, rows that are not centres)."""
    order = np.lexsort((nodes, part))
    firsts = np.concatenate(([True], part[order][1:] != part[order][:-1]))
    centres = order[firsts]
    centre = np.empty(len(part), np.int64)
    centre[order] = centres[np.cumsum(firsts) - 1]
    return centre, np.flatnonzero(nodes[centre] != nodes)


def _region_links(
    keys: np.ndarray, nodes: np.ndarray, low: np.ndarray, least: int, region: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Links of one region, and the rows that stand for its largest parts.

    Parts of neighbouring cuts meet in the rows by which the cuts overlap. Then one
    row of each part goes on to cuts of such rows, until one cut holds them all or
    nothing joins any more.
    """
    at, found = np.arange(len(nodes)), []
    sizes = np.ones(len(nodes), np.int64)
    if len(nodes) > region:
        deep = np.concatenate((keys, low[:, keys.shape[1] :]), axis=1)
        runs = list(_cuts(deep, DEPTH, 0, len(nodes), region))
    else:
        runs = [(0, len(nodes))]
    while True:
        stand = []
        for a, b in runs:
            rows = at[max(0, a - OVERLAP) : b]
            centre, moved = _stars(_linked_parts(_close(low[rows], least)), nodes[rows])
            if len(moved):
                found.append((nodes[rows][centre[moved]], nodes[rows][moved]))
            own = np.arange(len(rows)) >= len(rows) - (b - a)
            weights = np.bincount(centre[own], sizes[rows[own]], len(rows)).astype(np.int64)
            held = rows[weights > 0]
            sizes[held] = np.maximum(sizes[held], weights[weights > 0])
            stand.append(held)
        stand = np.unique(np.concatenate(stand))
        if len(runs) == 1 or len(stand) == len(at):
            return found, stand[np.argsort(-sizes[stand], kind="stable")]
        at = stand
        runs = [(a, min(a + region, len(at))) for a in range(0, len(at), region)]


def _pair_links(nodes, low, firsts, least):
    """Links of the regions of two rows, which are most, all at once."""
    agree = (low[firsts] == low[firsts + 1]).sum(axis=1) >= least
    a, b = nodes[firsts[agree]], nodes[firsts[agree] + 1]
    return np.minimum(a, b), np.maximum(a, b)


def _batch_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([np.asarray(p[0], np.int64) for p in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([np.asarray(p[1], np.int64) for p in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: Sorted rows of the forest: the zone (tree), the first KEY positions, the low bytes of all
#: positions in the tree's rotation, the node.
ROWS = "zone long, key binary, low binary, node long"


def _sorted_links(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[tuple[pa.RecordBatch, pa.Table]]:
    """(links, rows that took part) of the regions in rows sorted by ROWS, some batches at a time.

    A region that runs on beyond what is held goes on with its last rows and with those
    that stand for its largest parts.
    """
    least, held = forest.agree, None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = _arrays(batch)
        arrays = arrays if held is None else tuple(np.concatenate(x) for x in zip(held, arrays))
        zones, keys, low, own = arrays
        same = (zones[1:] == zones[:-1]) & (keys[1:, :DEPTH] == keys[:-1, :DEPTH]).all(axis=1)
        edges = np.concatenate(([0], np.flatnonzero(~same) + 1))
        last, crowded = edges[-1], len(own) - edges[-1] >= 16 * forest.region
        found = list(_links_of_regions(edges[:-1], last, keys, own, low, least, forest.region))
        kept = np.arange(last, len(own))
        if crowded:
            links, stand = _region_links(keys[last:], own[last:], low[last:], least, forest.region)
            found += links
            kept = np.union1d(last + stand[:OVERLAP], kept[-OVERLAP:])
        yield _batch_of(found)
        held = tuple(x[kept] for x in arrays)
    if held is not None and len(held[3]):
        _, keys, low, own = held
        yield _batch_of(list(_links_of_regions(np.zeros(1, np.int64), len(own), keys, own, low, least, forest.region)))


def candidates(nodes: DataFrame, forest: Forest) -> DataFrame:
    """Candidate links (a, b) between nodes; links may repeat."""
    spark = nodes.sparkSession

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seam = TaskContext.get().partitionId()
        first, last = None, None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal first, last
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                if first is None or len(first) < OVERLAP:
                    first = rows.slice(0, OVERLAP) if first is None else pa.concat_tables([first, rows]).slice(0, OVERLAP)
                last = rows if last is None else pa.concat_tables([last, rows])
                last = last.slice(max(0, len(last) - OVERLAP)).combine_chunks()
                yield batch

        for found in _sorted_links(seen(), forest):
            yield _outcome(found, None, None)
        if last is not None:
            yield _outcome(None, seam - 1, first)
            yield _outcome(None, seam, last)

    def seam_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sorted_links(batches, forest)

    places = forest.hashes
    twice = [F.concat(c, c).alias(c) for c in ("signature", "low")]
    trees = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("zone")
    rows = nodes.select(trees, "node", *twice).selectExpr(
        "cast(zone as long) as zone",
        f"substring(signature, zone * {4 * DEPTH} + 1, {4 * KEY}) as key",
        f"substring(low, zone * {DEPTH} + 1, {places}) as low",
        "node",
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * forest.trees // ROWS_PER_TASK)
    order = ["zone", "key", "low", "node"]
    ranged = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    found = cut(ranged.mapInArrow(links, f"a long, b long, seam int, {ROWS}"))
    seams = found.where("seam is not null").select((F.col("seam").cast("long") * forest.trees + F.col("zone")).alias("zone"), *order[1:])
    # one seam has at most 2 * OVERLAP rows; a zone of these is a tree at a seam
    seams = seams.repartition(tasks, "zone").sortWithinPartitions(*order)
    return found.where("seam is null").select("a", "b").union(seams.mapInArrow(seam_links, "a long, b long"))


def _outcome(found: pa.RecordBatch | None, seam: int | None, rows: pa.Table | None) -> pa.RecordBatch:
    """Links, or rows at a seam, as a batch of columns for both."""
    n = len(found) if rows is None else len(rows)
    nothing = lambda kind: pa.nulls(n, kind)
    links = [found.column(0), found.column(1)] if rows is None else [nothing(pa.int64()), nothing(pa.int64())]
    place = nothing(pa.int32()) if rows is None else pa.array([seam] * n, pa.int32())
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
    if rows is None:
        held = [nothing(kind) for kind in kinds]
    else:
        held = [pa.array(rows.column(i).to_pylist(), kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*links, place, *held], names=["a", "b", "seam", "zone", "key", "low", "node"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def fixed(column: pa.Array, kind: str) -> np.ndarray:
        joined = b"".join(column.to_pylist())
        return np.frombuffer(joined, kind).reshape(len(column), -1)

    return (
        batch.column(0).to_numpy(zero_copy_only=False),
        fixed(batch.column(1), ">u4"),
        fixed(batch.column(2), "u1"),
        batch.column(3).to_numpy(zero_copy_only=False),
    )


def _links_of_regions(edges, last, keys, nodes, low, least, region) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the regions that begin at ``edges``; the last one ends at ``last``."""
    sizes = np.diff(np.append(edges, last))
    yield _pair_links(nodes, low, edges[sizes == 2], least)
    for a, size in zip(edges[sizes > 2], sizes[sizes > 2]):
        yield from _region_links(keys[a : a + size], nodes[a : a + size], low[a : a + size], least, region)[0]


# --- components -------------------------------------------------------------------------


def contract(links: DataFrame) -> DataFrame:
    """Links (low, high), low < high, with the same components, where every high has one low.

    In a round, the smaller ends of a node's links and the node itself are linked with
    the least of these instead. Links only merge, never multiply: a round joins every
    link with one row of its larger end, and adaptive execution splits hot ends. Nodes
    are hashes, so a chain shrinks by a share in every round.
    """
    edges = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    edges = cut(edges.where("low < high").distinct())
    while True:
        ends = edges.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("n"))
        if ends.where("n > 1").isEmpty():
            return edges
        merged = F.when(F.col("low") == F.col("least"), F.col("high")).otherwise(F.col("low"))
        edges = cut(edges.join(ends, "high").select(F.col("least").alias("low"), merged.alias("high")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes with links (a, b), a table; the smallest node names a component.

    Contracted links point every node but the smallest of a component at one smaller node;
    these pointers are doubled (pointer jumping) until they reach the smallest.
    """
    up = contract(links)
    while True:
        onward = up.select(F.col("high").alias("low"), F.col("low").alias("next"))
        jumped = up.join(onward, "low", "left").select(F.coalesce("next", "low").alias("low"), "high", F.col("next").isNotNull().alias("far"))
        jumped = cut(jumped)
        if jumped.where("far").isEmpty():
            break
        up = jumped.select("low", "high")
    tops = up.select("low").distinct()
    return up.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        tops.select(F.col("low").alias("node"), F.col("low").alias("component"))
    )


# --- confirmation -----------------------------------------------------------------------


def intersection_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """All pairwise intersection sizes, as a product of the sets' indicator matrix."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(uses > 1) - 1
    keep = uses[at] > 1
    owners, at = owners[keep], shared[at[keep]]
    order = np.argsort(at, kind="stable")
    owners, at = owners[order], at[order]
    sizes = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, (1 << 22) // len(sets))
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        low, high = np.searchsorted(at, (a, a + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owners[low:high], at[low:high] - a] = 1
        sizes += part @ part.T
    return sizes.astype(np.int64)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets are similar enough."""
    sizes = np.array([len(s) for s in sets])
    common = intersection_sizes(sets)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def family_sets(df: DataFrame, sketches: DataFrame, families: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(component, node, values): the full shingle sets of all nodes of ``families``, as a written table."""
    first_ids = sketches.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    members = families.count()
    wanted = cut(families.join(first_ids, "node"), members)
    ids = wanted.select(F.col("id").alias("__id"))
    if members <= BROADCAST_ROWS:
        wanted, ids = F.broadcast(wanted), F.broadcast(ids)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups(batch.column(1)):
                sets = [s for s in shingle_sets(group) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "values"],
                )

    sets = rows.mapInArrow(sets_of, "node long, values binary")
    return cut(sets.join(wanted.select("node", "component"), "node").select("component", "node", "values"))


def _blocks(members: Column, size: Column) -> Column:
    """Into how many blocks so many members with so many bytes go."""
    return F.greatest(F.ceil(members / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")


def _dealt(blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), blocks).cast("int")


def _tested(cells: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b), as a written table: each linked class of a cell with the smallest of its part."""
    spark = cells.sparkSession
    keys = ["component", "i", "j"]
    dealt = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for *own, node, values in zip(*columns):
                if own != key:
                    out.append(_cell_links(nodes, sets, percent))
                    key, nodes, sets = own, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(values, np.uint64))
            yield _batch_of(out)
        yield _batch_of([_cell_links(nodes, sets, percent)])

    ordered = dealt.select(*keys, "node", "values").sortWithinPartitions(*keys, "node")
    return cut(ordered.mapInArrow(links, "a long, b long"))


def confirm(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) by links confirmed on the full sets of the families in ``sets``."""
    families = sets.groupBy("component").agg(
        _blocks(F.count("*"), F.sum(F.octet_length("values"))).alias("blocks"), F.count("*").alias("members")
    )
    families = cut(families)
    wide = families.where("blocks > 1")
    place = sets.join(families.select("component", "blocks"), "component").select("component", "node", "values", "blocks")
    own = place.select("component", _dealt(F.col("blocks"), 1).alias("i"), F.lit(0).alias("j"), "node", "values")
    nth = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    anchors = sets.select("component", "node").join(wide.select("component"), "component", "left_semi")
    anchors = anchors.withColumn("nth", nth).where(f"nth <= {ANCHORS}").drop("nth")
    spread = place.join(anchors, ["component", "node"], "left_semi").select(
        "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), "node", "values"
    )
    links = _tested(own.union(spread), percent)
    parts = components(links)
    if wide.isEmpty():
        return parts

    # families that lie in several blocks and several parts
    nodes = sets.select("component", "node", F.octet_length("values").alias("size"))
    nodes = nodes.join(wide.select("component", "blocks"), "component")
    nodes = nodes.join(parts.select("node", F.col("component").alias("part")), "node", "left")
    nodes = cut(nodes.withColumn("part", F.coalesce("part", "node")))
    sizes = nodes.groupBy("component", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("component").agg(F.max(F.struct("n", "part")).alias("most")).select("component", F.col("most.part").alias("largest"))
    rest = cut(nodes.join(largest, "component").where("part <> largest").select("component", "node", "size", "blocks"))
    if rest.isEmpty():
        return parts
    shares = rest.groupBy("component").agg(_blocks(F.count("*"), F.sum("size")).alias("rest_blocks"))
    placed = sets.join(wide.select("component", "blocks"), "component").join(shares, "component")
    i, j = _dealt(F.col("rest_blocks"), 2), _dealt(F.col("blocks"), 3)
    over_rest = placed.select("component", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("i"), j.alias("j"), "node", "values")
    over_all = placed.join(rest.select("component", "node"), ["component", "node"], "left_semi").select(
        "component", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "values"
    )
    return components(links.union(_tested(over_rest.union(over_all), percent)))


def _cell_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    if len(nodes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes = np.array(nodes, np.int64)
    centre, moved = _stars(_linked_parts(linked(sets, percent)), nodes)
    return nodes[centre[moved]], nodes[moved]


# --- whole runs -------------------------------------------------------------------------


def _judged(df: DataFrame, id_col: str, text_col: str, percent: int, forest: Forest | None = None) -> DataFrame:
    """One row per row of ``df``: id, text_key, n_shingles, component_id, kept."""
    forest = forest or forest_for(percent)
    sketches = cut(sketch(df, id_col, text_col, forest.hashes))
    with_set = sketches.where("node is not null")
    rows = sketches.count()
    nodes = cut(with_set.dropDuplicates(["node"]).select("node", "signature", "low"), rows)
    families = cut(components(candidates(nodes, forest)))
    parts = confirm(family_sets(df, sketches, families, id_col, text_col), percent)
    least = with_set.groupBy("node").agg(F.min("id").alias("id"))
    classes = cut(least.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), rows)
    names = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    named = cut(classes.join(names, "component").select(F.col("node").alias("__node"), "component_id"), rows)
    joined = sketches.drop("signature", "low").join(named, F.col("node") == F.col("__node"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.col("id").eqNullSafe(component)
    return joined.select("id", "text_key", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, forest: Forest | None = None
) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (smallest id), kept.

    ``forest`` is the one that ``forest_for`` gives for ``percent``, unless stated.
    """
    return _judged(df, id_col, text_col, percent, forest).drop("text_key").withColumnRenamed("id", id_col)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay: of each component, the one with the smallest id."""
    dropped = _judged(df, id_col, text_col, percent).where("not kept")
    return without_rows(df, id_col, text_col, dropped.select("id", "text_key"))
