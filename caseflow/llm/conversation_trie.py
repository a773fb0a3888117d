"""Conversation prefix trie, rolled up by bands of depth.

Conversations are rebuilt: the first h turns of conversation c - c % ``FAMILY``, then
c's own turns after its first h, with h from a hash of c. Every distinct sequence of
first turns is a node; a node is named by its smallest member and its depth.

1. Numbering. Turns are ranged by conversation, turn and text digest, counted within
   each task, and counts of earlier tasks are added, so that a conversation of any
   length is spread over tasks. Texts stay where they are read; digests and sizes move.
2. Prefixes. The same running pass xors hashes of place and digest to a 128-bit key
   of each prefix. Grouping by it gives the nodes, their members and parents.
3. Depth bands. Depths fall into bands of a fixed height. A node's values explode to
   its ancestors within the band only, first summed along its conversation, so a
   conversation emits at most one row per depth of a band. Then totals of the nodes at
   a band's top are complete for the deepest band, and go up band by band: a round a
   band, over tops alone. Last, each top's complete total explodes once to its ancestors
   in the band above. The height is ``BAND``, or the root of the greatest depth if that
   is more, which bounds both rounds and rows per node.
4. Ends. Conversations that end in a node are ranged by id; batches of their joined ids
   are hashed in order, one batch of text at a time, however many there are.

Defined results: turns are ordered by turn (null first), ties by a digest of role and
text; null role and text count as empty; rows that repeat each other are turns of their
own. Rows without a conversation id belong to none. An empty table has no node, not
even a root. Keys of prefixes have 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import cut

FAMILY = 5
HEADS = 9
BAND = 32
SEED = 31
PREFIX = ("p1", "p2")
EMPTY = hashlib.sha256(b"").hexdigest()


def head_turns(conv: Column) -> Column:
    """How many first turns conversation ``conv`` takes from the first one of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- running counts and keys -------------------------------------------------------------


def _in_task(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, h1, h2, ...) -> with the task, and running count and xors of each conversation."""
    part = TaskContext.get().partitionId()
    last, held = None, np.zeros(3, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        sizes = np.diff(np.append(starts, len(conv)))
        n = np.arange(1, len(conv) + 1) - np.repeat(starts, sizes)
        xors = []
        for h in (h1, h2):
            run = np.bitwise_xor.accumulate(h)
            before = np.where(starts > 0, run[starts - 1], 0)
            xors.append(run ^ np.repeat(before, sizes))
        if conv[0] == last:
            first = slice(0, sizes[0])
            n[first] += held[0]
            xors[0][first] ^= held[1]
            xors[1][first] ^= held[2]
        last, held = conv[-1], np.array([n[-1], xors[0][-1], xors[1][-1]])
        place = pa.array(np.full(len(conv), part, np.int32))
        columns = [place, pa.array(conv), pa.array(n), pa.array(xors[0]), pa.array(xors[1]), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def running(df: DataFrame, order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Per row of ``df`` (conv, h1, h2, ...): conv, running n, x1 and x2 by ``order``, and ``carried`` columns.

    A conversation may lie in any number of tasks. Only the first and last conversation
    of a task can go on elsewhere, so what is broadcast has two rows per task.
    """
    names = ["part", "conv", "n", "x1", "x2", *carried]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carried)
    # rows that tie are alike; the salt lets a range end among them
    ranged = df.withColumn("__salt", F.rand(SEED)).repartitionByRange(_tasks(df), *order, "__salt")
    ranged = ranged.sortWithinPartitions(*order, "__salt").select("conv", "h1", "h2", *carried)
    schema = "part int, conv long, n long, x1 long, x2 long" + (f", {kinds}" if kinds else "")
    found = cut(ranged.mapInArrow(lambda batches: _in_task(batches, names), schema))
    ends = found.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    totals = found.join(F.broadcast(ends), "part").where("conv = low or conv = high").groupBy("part", "conv")
    totals = totals.agg(F.max("n").alias("m"), F.max_by("x1", "n").alias("y1"), F.max_by("x2", "n").alias("y2"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = totals.select(
        "part", "conv", F.sum("m").over(before).alias("m"), F.bit_xor("y1").over(before).alias("y1"), F.bit_xor("y2").over(before).alias("y2")
    ).where("m is not null")
    whole = found.join(F.broadcast(cut(held)), ["part", "conv"], "left")
    return whole.select(
        "conv", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"),
        F.col("x1").bitwiseXOR(F.coalesce("y1", F.lit(0))).alias("x1"), F.col("x2").bitwiseXOR(F.coalesce("y2", F.lit(0))).alias("x2"), *carried,
    )


def numbered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, n, mark, size): turns numbered from 1, a digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"),
        F.col(turn_col).alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size"),
    )
    return cut(running(rows, ["conv", "turn", "mark"], ["mark", "size"]).select("conv", "n", "mark", "size"))


def rebuilt_turns(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, mark, size) of the rebuilt conversations; ``lengths`` has conv and its number of own turns."""
    convs = lengths.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), head_turns(F.col("conv")).alias("h"))
    bases = lengths.select(F.col("conv").alias("base"), F.col("turns").alias("there"))
    convs = cut(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = turns.where(F.col("n") < HEADS).select(F.col("conv").alias("base"), F.col("n").alias("depth"), "mark", "size")
    heads = convs.where("taken > 0").join(heads, "base").where("depth <= taken").select("conv", "depth", "mark", "size")
    own = turns.where(F.col("n") > head_turns(F.col("conv"))).join(convs.select("conv", "h", "taken"), "conv")
    return heads.union(own.select("conv", (F.col("n") - F.col("h") + F.col("taken")).alias("depth"), "mark", "size"))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, size, p1, p2, q1, q2): the keys of each prefix and of the one before, as a written table."""
    keys = [F.xxhash64(F.lit(SEED + k), "depth", "mark").alias(f"h{k}") for k in (1, 2)]
    rows = rebuilt.select("conv", *keys, "depth", "size", *[k.alias(f"g{i}") for i, k in enumerate(keys, 1)])
    found = running(rows, ["conv", "depth"], ["depth", "size", "g1", "g2"])
    return cut(found.select(
        "conv", "depth", "size", F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("x1").bitwiseXOR(F.col("g1")).alias("q1"), F.col("x2").bitwiseXOR(F.col("g2")).alias("q2"),
    ))


# --- nodes -------------------------------------------------------------------------------


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row per node below the root: depth, key, rep (smallest member), up (the parent's), n_convs, size, children."""
    nodes = cut(rows.groupBy("depth", *PREFIX).agg(
        F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    ))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("up"))
    named = nodes.join(above, ["depth", "q1", "q2"], "left")
    kids = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    return cut(named.join(kids.agg(F.count("*").alias("children")), ["depth", *PREFIX], "left").fillna({"children": 0}))


def _paths(rows: DataFrame, nodes: DataFrame, height: int, root: int, root_leaf: int) -> DataFrame:
    """(conv, band, path): for conversations that name nodes, the nodes along them, by band, as a written table.

    An entry of ``path`` is (depth, rep, leaf, saved); the last two are the node's own,
    and 0 unless the conversation names it. The root is at depth 0 of band 0.
    """
    own = rows.join(nodes.select(F.col("rep").alias("conv")).distinct(), "conv", "left_semi")
    leaf, saved = (F.col("children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    met = own.select("conv", "depth", *PREFIX).join(nodes.select("depth", *PREFIX, "rep", leaf.alias("leaf"), saved.alias("saved")), ["depth", *PREFIX])
    named = F.col("rep") == F.col("conv")
    entry = F.struct("depth", "rep", F.when(named, F.col("leaf")).otherwise(0).alias("leaf"), F.when(named, F.col("saved")).otherwise(0).alias("saved"))
    grouped = met.groupBy("conv", F.floor(F.col("depth") / height).alias("band")).agg(F.sort_array(F.collect_list(entry)).alias("path"))
    top = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(root).alias("rep"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved")))
    return cut(grouped.withColumn("path", F.when(F.col("band") == 0, F.concat(top, "path")).otherwise(F.col("path"))))


def _within_bands(paths: DataFrame, root: int, root_leaf: int) -> DataFrame:
    """(rep, depth, leaves, saved): each node's sums over its subtree inside its band, as a written table."""
    sums = """transform(path, e -> struct(e.rep AS rep, e.depth AS depth,
      aggregate(path, 0L, (s, x) -> s + if(x.depth >= e.depth, x.leaf, 0L)) AS leaves,
      aggregate(path, 0L, (s, x) -> s + if(x.depth >= e.depth, x.saved, 0L)) AS saved))"""
    named = paths.where("exists(path, e -> e.rep = conv AND e.depth > 0)")
    own = named.selectExpr(f"inline({sums})")
    first = paths.sparkSession.createDataFrame([(root, 0, root_leaf, 0)], "rep long, depth long, leaves long, saved long")
    return cut(own.union(first).groupBy("rep", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))


def rolled_up(rows: DataFrame, nodes: DataFrame, depth: int, root: int, band: int = BAND) -> DataFrame:
    """(rep, depth, leaves, saved) of every node, the root too: sums over its whole subtree."""
    height = max(band, math.isqrt(depth) + 1)
    root_leaf = int(depth == 0)
    paths = _paths(rows, nodes, height, root, root_leaf)
    inside = _within_bands(paths, root, root_leaf)
    last = depth // height
    if last == 0:
        return inside
    # tops: nodes at the first depth of a band, and the top of the band above
    tops = inside.where((F.col("depth") > 0) & (F.col("depth") % height == 0))
    above = paths.select(F.col("conv").alias("rep"), ((F.col("band") + 1) * height).alias("depth"), F.col("path")[0]["rep"].alias("above"))
    tops = cut(tops.join(above, ["rep", "depth"]))
    done = []
    for k in range(last, 0, -1):
        level = tops.where(F.col("depth") == k * height)
        if done:
            below = done[-1].groupBy(F.col("above").alias("rep")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            level = level.join(below, "rep", "left").select(
                "rep", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), "above",
            )
        done.append(cut(level, 1))
    whole = done[0]
    for level in done[1:]:
        whole = whole.unionByName(level)
    over = paths.select(F.col("conv").alias("rep"), ((F.col("band") + 1) * height).alias("depth"), "path")
    spread = whole.join(over, ["rep", "depth"]).selectExpr("leaves", "saved", "explode(path) AS e")
    spread = spread.select(F.col("e.rep").alias("rep"), F.col("e.depth").alias("depth"), "leaves", "saved")
    both = inside.union(spread).groupBy("rep", "depth")
    return both.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


# --- ends --------------------------------------------------------------------------------


def ends_digests(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of (conv, rep, depth): ids joined in ascending order, then hashed."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).to_pandas()
                pieces = table.groupby(["rep", "depth"], sort=False)["conv"].agg(lambda ids: ",".join(map(str, ids))).reset_index()
                pieces["part"], pieces["batch"] = part, at
                yield pa.RecordBatch.from_pandas(pieces[["rep", "depth", "part", "batch", "conv"]], preserve_index=False).rename_columns(
                    ["rep", "depth", "part", "batch", "ids"]
                )
                at += 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, None
        for batch in batches:
            done = []
            for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids"))):
                if (rep, depth) != node:
                    if own is not None:
                        done.append((*node, own.hexdigest()))
                    node, own = (rep, depth), hashlib.sha256(ids.encode())
                else:
                    own.update(b"," + ids.encode())
            yield _digests(done)
        if own is not None:
            yield _digests([(*node, own.hexdigest())])

    tasks = _tasks(ends)
    ranged = ends.select("conv", "rep", "depth").repartitionByRange(tasks, "conv").sortWithinPartitions("conv")
    pieces = ranged.mapInArrow(joined, "rep long, depth long, part long, batch long, ids string")
    order = ["rep", "depth", "part", "batch"]
    pieces = pieces.repartition(tasks, "rep", "depth").sortWithinPartitions(*order)
    return pieces.mapInArrow(hashed, "rep long, depth long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["rep", "depth", "ends_sha256"])


# --- the trie ----------------------------------------------------------------------------


def prefix_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", band: int = BAND
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = numbered_turns(df, conv_col, turn_col, role_col, text_col)
    lengths = cut(turns.groupBy("conv").agg(F.max("n").alias("turns")))
    convs, root = lengths.agg(F.count("*"), F.min("conv")).first()
    if not convs:
        schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return df.sparkSession.createDataFrame([], schema)
    rows = prefixes(rebuilt_turns(turns, lengths))
    nodes = trie_nodes(rows)
    depth, firsts = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count_if(F.col("depth") == 1)).first()
    totals = rolled_up(rows, nodes, depth, root, band)

    last = rows.groupBy("conv").agg(F.max("depth").alias("depth"))
    deepest = rows.join(last, ["conv", "depth"]).join(nodes.select("depth", *PREFIX, "rep"), ["depth", *PREFIX])
    turnless = lengths.join(last, "conv", "left_anti").select("conv", F.lit(root).alias("rep"), F.lit(0).cast("long").alias("depth"))
    ends = ends_digests(deepest.select("conv", "rep", "depth").union(turnless))

    top = df.sparkSession.createDataFrame([(root, 0, None, convs, firsts)], "rep long, depth long, up long, n_convs long, children long")
    up = F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("up")).alias("up")
    every = nodes.select("rep", "depth", up, "n_convs", "children").union(top)
    found = every.join(totals, ["rep", "depth"]).join(ends, ["rep", "depth"], "left")
    return found.select(
        F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
