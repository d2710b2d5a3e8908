"""Conversation prefix trie: what conversations share from their start, by pointer jumping over digest-keyed edges.

Every conversation is rebuilt: its first turns are those of the conversation that opens its block of ids, the rest its
own. Each distinct sequence of first turns is a node, keyed by a digest of the sequence, and so is its parent; a row of
one turn has both keys, and nothing has to look for its parent. Leaves and saved tokens are then summed over subtrees by
doubling: in round k a node adds what the nodes 2^k below it have summed so far, and every pointer jumps from the
ancestor 2^k above to that one's own. Depth d takes log2(d) rounds, whatever the shape.

A sequence's digest is a sum of SHA-256 digests of (place, turn), in four sums of 64-bit parts, hashed again: sums can be
taken by blocks of ``BLOCK`` turns, so that no conversation has to lie in one task, and the parent's digest
is the sum less the last turn's part.

Skew: turns are placed in their conversation after a sort by range, which splits a conversation of any length (counts of the parts are
carried over, at most one row a partition); texts are not shuffled, only their digests. Nodes are counted with partial sums.
The two joins in which a key may hold many rows (a conversation's turns with its block, nodes with their parent) have at
most one row for it on the other side, and adaptive execution splits them. Ids that end at one node are joined to chunks of text where they
lie sorted by range; only the chunks meet in one task, which hashes them as they stream by, as SHA-256 is a chain.

Defined results: rows without conv_id belong to no conversation and are left out; null role or text counts as empty, null turn comes first; turns of
the same number come in order of their SHA-256 (of role and text), and repeated rows are turns each; texts of any length count whole; an empty table has no
node; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import cut, stored

#: Conversations in a block of ids, and one more than the turns that one takes from the block's first at most.
FAMILY, HEADS = 20, 4
#: Turns whose digests are summed in one window.
BLOCK = 1024
#: Ids in a chunk of text.
CHUNK = 4096
PARTS = ("s0", "s1", "s2", "s3")
_SUM = "decimal(38,0)"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and words of every turn; the text itself is read here only."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))


def _ordinals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id with the partition and each row's place in its conversation's part there."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        first = np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        place = np.arange(len(ids)) - first + 1
        if ids[0] == last:
            place[first == 0] += seen
        last, seen = ids[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("digest"), batch.column("words"), pa.array(np.full(len(ids), part), pa.int32()), pa.array(place, pa.int64())], ["conv_id", "digest", "words", "part", "place"])


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and words, by turn (null first), then digest."""
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words").mapInArrow(_ordinals, "conv_id long, digest binary, words long, part int, place long")
    rows = stored(rows, "trie-turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A partition continues one conversation at most, its first: no more rows than partitions.
    carried = parts.withColumn("before", before).where("before is not null").select("conv_id", "part", "before")
    return rows.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, convs: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """conv_id, pos, digest and words of rebuilt conversations; ``convs`` holds every conv_id once."""
    base = F.col("conv_id") - F.col("conv_id") % family
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    opening = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    lengths = opening.groupBy("base").agg(F.max("pos").alias("there"))
    inherited = convs.select("conv_id", base.alias("base"), taken.alias("taken")).join(opening, "base").where("pos <= taken").select("conv_id", "pos", "digest", "words")
    own = turns.withColumn("base", base).withColumn("taken", taken).where("pos > taken").join(lengths, "base", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("taken") + F.least("taken", F.coalesce("there", F.lit(0)))).alias("pos"), "digest", "words")
    return inherited.union(own)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]), 256))


def root_key() -> Column:
    return _key(F.lit(0), [F.lit(0).cast(_SUM)] * len(PARTS))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent and words for every first d turns, d at least 1."""
    own = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("digest")), 256)
    rows = turns.withColumn("h", own).select("conv_id", "pos", "words", F.expr(f"(pos - 1) div {BLOCK}").alias("block"), *[F.conv(F.substr("h", F.lit(16 * i + 1), F.lit(16)), 16, 10).cast("decimal(20,0)").alias(p) for i, p in enumerate(PARTS)])
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(p).cast(_SUM).alias(p) for p in PARTS])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.sum(p).over(earlier).cast(_SUM).alias(f"{p}_before") for p in PARTS]).where("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(p).over(within).cast(_SUM).alias(f"{p}_within") for p in PARTS]).join(carried, ["conv_id", "block"], "left")
    rows = rows.select("conv_id", "pos", "words", *PARTS, *[(F.col(f"{p}_within") + F.coalesce(f"{p}_before", F.lit(0).cast(_SUM))).cast(_SUM).alias(f"{p}_sum") for p in PARTS])
    sums = [F.col(f"{p}_sum") for p in PARTS]
    return rows.select("conv_id", F.col("pos").alias("depth"), _key(F.col("pos"), sums).alias("key"), _key(F.col("pos") - 1, [(s - F.col(p)).cast(_SUM) for s, p in zip(sums, PARTS, strict=True)]).alias("parent"), "words")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by (key, conv_id) as comma-joined chunks: key, the chunk's first id, text."""
    now, ids = None, []

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "text"])

    for batch in batches:
        out = []
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != now or len(ids) == CHUNK:
                if ids:
                    out.append(chunk())
                now, ids = key, []
            ids.append(conv)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if ids:
        yield chunk()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, first) to the digest of each key's text; one chunk is held at a time."""
    now, state = None, None
    for batch in batches:
        keys, digests = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key == now:
                state.update(b"," + text.encode())
                continue
            if state is not None:
                keys.append(now)
                digests.append(state.hexdigest())
            now, state = key, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """key and the SHA-256 of the ids (conv_id) that end there, ascending and comma-joined."""
    chunks = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key binary, first long, text string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "text").mapInArrow(_hashes, "key binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """key and the sums of ``columns`` over each node's subtree, itself included; ``nodes`` has key, parent (null for the root) and depth.

    After round k a node's sums cover what lies less than 2^(k+1) below it, and ``up`` points 2^(k+1) above.
    """
    now = nodes.select("key", "depth", F.col("parent").alias("up"), *columns)
    deepest, reach = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0, 1
    while reach <= deepest:
        below = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(*[F.sum(c).alias(f"{c}_below") for c in columns])
        summed = now.join(below, "key", "left").select("key", "depth", "up", *[(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in columns])
        # Only nodes at least twice as deep as the reach have an ancestor there; the others point nowhere, without a look.
        jumps = now.select(F.col("key").alias("up"), F.col("up").alias("next")).where("next is not null")
        on = F.when(F.col("depth") >= 2 * reach, F.col("up"))
        high = summed.where(F.col("depth") < 2 * reach).withColumn("up", F.lit(None).cast("binary"))
        deep = summed.where(on.isNotNull()).join(jumps, "up").select("key", "depth", F.col("next").alias("up"), *columns)
        now, reach = cut(high.union(deep)), 2 * reach
    return now.select("key", *columns)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stored(placed(turns_of(conversations)), "trie-placed")
    convs = turns.select("conv_id").distinct()
    rows = prefixes(rebuilt(turns, convs))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root_key().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    rows = stored(roots.union(rows), "trie-rows")
    nodes = rows.groupBy("key", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.select("key", "depth", "parent", "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "trie-nodes")
    ends = end_hashes(rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key")))
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
