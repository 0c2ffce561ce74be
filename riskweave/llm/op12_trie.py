"""Prefix trie of conversations by vertical bitmaps.

Conversations are numbered within shards: ``WIDE`` consecutive ids by ``DEEP`` consecutive positions, so a shard
holds a bounded number of rows however long or common a conversation is. In a shard, an index maps
(position, turn) to the bitset of the conversations that have this turn there. Depth first, a node's bitset is
intersected with the postings of the next position: each result is a child, its popcount the members, its lowest bit
the smallest member, and its common bits with the conversations that end there the end list. What comes in from
earlier positions is grouped by a fingerprint of the turns so far.

Nodes of different shards are one if (depth, fingerprint) is; a fingerprint is the exclusive or of two 64-bit hashes of
(turn, position) over the turns so far, so it can be summed up in parts. Shards are merged by sums and minima.

Sums over subtrees need no walk. Each node belongs to its smallest member; what the nodes of a conversation
add up to is the conversation's total. A node's sum is the totals of its members (per shard the bitset picks them
from a vector of at most ``WIDE`` totals), but for its own conversation the part from the node's depth on.

A conversation's turns are ordered by (turn, nulls first; then a hash of role and text, for ties) with a range
shuffle that may cut a conversation, so one that holds a third of all rows spreads over tasks.

Rules: null role or text counts as empty; rows without conv_id belong to no conversation and are left out; repeated
rows are turns each; an empty table has no node, not even the root; other columns are not read. End hashes
are streamed in the order of ids: one node's digest is sequential by its definition, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.shared import ship, stored

#: Conversations and positions of a shard.
WIDE_BITS, DEEP_BITS = 10, 6
WIDE, DEEP = 1 << WIDE_BITS, 1 << DEEP_BITS
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
KEY = ("depth", "z1", "z2")
_ORDER = ("conv_id", "turn", "k1", "k2")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, k1, k2, bytes): the turns in order, the content as two hashes and its text's UTF-8 bytes."""
    ship(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    thin = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("k1"),
        F.xxhash64(text, F.lit(1), role, F.octet_length(role)).alias("k2"), F.octet_length(text).cast("long").alias("bytes"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            new = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
            starts = np.flatnonzero(new)
            at = np.arange(len(ids))
            begin = np.zeros(len(ids), dtype=np.int64)
            if len(starts):
                begin = starts[np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)]
            local = np.where(at < (starts[0] if len(starts) else len(ids)), run + at + 1, at - begin + 1)
            last, run = int(ids[-1]), int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], ["conv_id", "k1", "k2", "bytes", "part", "local"])

    dealt = thin.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    dealt = dealt.select("conv_id", "k1", "k2", "bytes", F.spark_partition_id().cast("long").alias("part"))
    rows = stored(dealt.mapInArrow(number, "conv_id long, k1 long, k2 long, bytes long, part long, local long"), "turns")
    here = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = here.withColumn("offset", F.sum("n").over(earlier)).where("offset > 0").select("conv_id", "part", "offset")
    # a task's first conversation alone can begin before it: at most one row per task
    rows = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "k1", "k2", "bytes")


def rebuilt(turns: DataFrame, leader: Column | None = None, shared: Column | None = None, most_shared: int = 8) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, k1, k2, bytes, len) and (conv_id, len): every conversation as the first ``shared`` turns of its leader
    and its own turns after as many. ``shared`` is at most ``most_shared``; both are expressions over conv_id."""
    conv = F.col("conv_id")
    leader = conv - conv % 5 if leader is None else leader
    shared = F.crc32(conv.cast("string").cast("binary")) % 9 if shared is None else shared
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    plans = lengths.select("conv_id", "own", leader.cast("long").alias("leader"), shared.cast("long").alias("shared"))
    given = lengths.select(F.col("conv_id").alias("leader"), F.col("own").alias("given"))
    plans = plans.join(given, "leader", "left").withColumn("head", F.least("shared", F.coalesce("given", F.lit(0))))
    plans = stored(plans.withColumn("len", F.col("head") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))), "plans")
    heads = turns.where(F.col("pos") <= most_shared).withColumnRenamed("conv_id", "leader")
    heads = heads.join(plans.select("conv_id", "leader", "head", "len"), "leader").where("pos <= head")
    # a conversation's plan is handed to each DEEP of its turns, so no join key holds more rows than that
    parts = plans.select("conv_id", "shared", "head", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("own", DEEP_BITS))).alias("part"))
    own = turns.withColumn("part", F.shiftright("pos", DEEP_BITS)).join(parts, ["conv_id", "part"]).where("pos > shared")
    own = own.withColumn("pos", F.col("head") + F.col("pos") - F.col("shared"))
    columns = ("conv_id", "pos", "k1", "k2", "bytes", "len")
    return heads.select(*columns).unionByName(own.select(*columns)), plans.select("conv_id", "len")


def _shard(table: pa.Table) -> pa.Table:
    """The nodes of one shard. Rows: conv_id, pos, z1, z2, bytes, len; pos -1 carries the fingerprint before the shard."""
    conv, pos, z1, z2, size, length = (table.column(c).to_numpy() for c in ("conv_id", "pos", "z1", "z2", "bytes", "len"))
    base = int(conv[0]) // WIDE * WIDE
    place = (conv - base).astype(np.int64)
    first = int(pos.max()) // DEEP * DEEP
    turn = pos >= 0

    def bitset(places: np.ndarray) -> int:
        mask = np.zeros(WIDE, dtype=np.uint8)
        mask[places] = 1
        return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")

    # postings: (position, turn) -> bitset, and the posting of each conversation at each position
    rows = np.flatnonzero(turn)
    rows = rows[np.lexsort((z2[rows], z1[rows], pos[rows]))]
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (pos[rows[1:]] == pos[rows[:-1]]) & (z1[rows[1:]] == z1[rows[:-1]]) & (z2[rows[1:]] == z2[rows[:-1]])
    starts = np.append(np.flatnonzero(~same), len(rows))
    which = np.full((DEEP, WIDE), -1, dtype=np.int64)
    which[pos[rows] - first, place[rows]] = np.cumsum(~same) - 1
    postings = [1 << int(place[rows[a]]) if b - a == 1 else bitset(place[rows[a:b]]) for a, b in zip(starts[:-1], starts[1:])]
    said = [(int(z1[rows[a]]), int(z2[rows[a]]), int(size[rows[a]])) for a in starts[:-1]]
    alive = [bitset(np.flatnonzero(level >= 0)) for level in which] + [0]
    ending = [0] * DEEP
    for p in range(DEEP):
        ends = place[turn & (pos == first + p) & (length == first + p)]
        if len(ends):
            ending[p] = bitset(ends)
    which = which.tolist()

    # the nodes above the shard, by what their members have said so far
    stack = []
    if first == 0:
        stack.append((0, alive[0], 0, 0, True))
    else:
        before: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(~turn):
            key = (int(z1[i]), int(z2[i]))
            before[key] = before.get(key, 0) | 1 << int(place[i])
        stack += [(0, bits, *key, False) for key, bits in before.items()]
    out: list[tuple] = []
    while stack:
        p, parent, x1, x2, top = stack.pop()
        rest = parent & alive[p]
        while rest:
            at = which[p][(rest & -rest).bit_length() - 1]
            child = parent & postings[at]
            rest ^= child
            a1, a2, weight = said[at]
            y1, y2, members = x1 ^ a1, x2 ^ a2, child.bit_count()
            ends = child & ending[p]
            out.append((first + p, y1, y2, None if top else x1, None if top else x2, base + (child & -child).bit_length() - 1, members, weight,
                        child.to_bytes((child.bit_length() + 7) // 8, "little") if members > 1 else None,
                        ends.to_bytes((ends.bit_length() + 7) // 8, "little") if ends else None))
            if p + 1 < DEEP:
                stack.append((p + 1, child, y1, y2, False))
    kinds = [pa.int64()] * 8 + [pa.binary()] * 2
    names = ["depth", "z1", "z2", "p1", "p2", "conv_id", "n", "bytes", "members", "ends"]
    columns = list(zip(*out)) or [()] * len(names)
    made = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    return made.add_column(0, "shard", pa.array(np.full(len(made), base // WIDE), pa.int64()))


_NODE = "shard long, depth long, z1 long, z2 long, p1 long, p2 long, conv_id long, n long, bytes long, members binary, ends binary"


def local_nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of every shard, stored: the depth-first intersection of ``_shard``."""
    ship(rows.sparkSession)
    turns = rows.select("conv_id", "pos", F.xxhash64("k1", "k2", "pos").alias("z1"), F.xxhash64("pos", "k2", "k1", F.lit(2)).alias("z2"), "bytes", "len")
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("pos"), zero.alias("z1"), zero.alias("z2"), zero.alias("bytes"), "len")
    block = F.shiftright("pos", DEEP_BITS)
    parts = turns.where(F.col("len") >= DEEP).withColumn("block", block).groupBy("conv_id", "block").agg(
        F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.max("len").alias("len"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "block", F.bit_xor("z1").over(earlier).alias("z1"), F.bit_xor("z2").over(earlier).alias("z2"), "len").where("block > 0")
    carried = carried.select("conv_id", F.lit(-1).cast("long").alias("pos"), "z1", "z2", zero.alias("bytes"), "len", "block")
    every = turns.unionByName(roots).withColumn("block", block).unionByName(carried)
    every = every.withColumn("shard", F.shiftright("conv_id", WIDE_BITS))
    return stored(every.groupBy("shard", "block").applyInArrow(_shard, _NODE), "trie-shards")


def _bits(raw: bytes, width: int = WIDE) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=width)


def _member_sums(nodes: pa.Table, totals: pa.Table) -> pa.Table:
    """For each shared node of a shard the sums of its members' totals."""
    value, leaves = np.zeros(WIDE, dtype=np.int64), np.zeros(WIDE, dtype=np.int64)
    place = totals.column("place").to_numpy()
    value[place], leaves[place] = totals.column("total").to_numpy(), totals.column("leaves").to_numpy()
    sums, counts = [], []
    own = nodes.column("conv_id").to_numpy() % WIDE
    for raw, at in zip(nodes.column("members").to_pylist(), own):
        if raw is None:
            sums.append(int(value[at]))
            counts.append(int(leaves[at]))
        else:
            picked = np.flatnonzero(_bits(raw))
            sums.append(int(value[picked].sum()))
            counts.append(int(leaves[picked].sum()))
    return pa.table([nodes.column(k) for k in KEY] + [pa.array(sums, pa.int64()), pa.array(counts, pa.int64())], [*KEY, "total", "leaves"])


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each run of equal keys; the state of the last run is carried over batches."""
    names, kinds = [*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]
    current, state, begun, rows = None, None, False, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for depth, a, b, shard, raw in zip(*columns):
            if (depth, a, b) != current:
                if state is not None:
                    rows.append((*current, state.hexdigest()))
                current, state, begun = (depth, a, b), hashlib.sha256(), False
            ids = np.flatnonzero(_bits(raw)) + shard * WIDE
            state.update((("," if begun else "") + ",".join(map(str, ids.tolist()))).encode())
            begun = True
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
            rows = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*current, state.hexdigest()), kinds)], names)


def nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, pos, k1, k2, bytes, len) and (conv_id, len): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    local = local_nodes(rows, lengths)
    merged = local.groupBy(*KEY).agg(F.min("conv_id").alias("conv"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"),
                                     F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    merged = stored(merged, "trie-merged")
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("z1"), F.col("p2").alias("z2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    known = merged.join(children, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = known.withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes"))
    known = stored(known.select(*KEY, "conv", "n_convs", "n_children", "weight"), "trie-nodes")
    block = F.shiftright("depth", DEEP_BITS)

    # totals of conversations, handed to every block of positions that a conversation reaches
    totals = known.groupBy("conv").agg(F.sum("weight").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"),
                                       F.max(block).alias("last"))
    totals = totals.where("total > 0 or leaves > 0").select(
        F.shiftright("conv", WIDE_BITS).alias("shard"), F.col("conv").bitwiseAND(WIDE - 1).alias("place"), "total", "leaves",
        F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    shared = known.where("n_convs > 1").select(*KEY, "conv", "n_convs", "weight")
    seen = stored(local.join(shared, list(KEY)).select("shard", *KEY, "conv_id", "members", "conv", block.alias("block")), "trie-shared")
    summed = seen.select("shard", "block", *KEY, "conv_id", "members").groupBy("shard", "block").cogroup(
        totals.groupBy("shard", "block")).applyInArrow(_member_sums, "depth long, z1 long, z2 long, total long, leaves long")
    summed = summed.groupBy(*KEY).agg(F.sum("total").alias("total"), F.sum("leaves").alias("leaves"))

    # of a node's own conversation, what lies above the node: sums by block, then within the block
    chain = shared.select("conv", "depth", "weight", block.alias("block"))
    above = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = chain.groupBy("conv", "block").agg(F.sum("weight").alias("w")).select(
        "conv", "block", F.coalesce(F.sum("w").over(above), F.lit(0)).alias("earlier"))
    inner = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    higher = shared.select(*KEY, "conv", "weight", block.alias("block")).withColumn("inside", F.coalesce(F.sum("weight").over(inner), F.lit(0)))
    higher = higher.join(blocks, ["conv", "block"], "left").select(*KEY, (F.col("inside") + F.coalesce("earlier", F.lit(0))).alias("higher"))

    # the smallest member of the parent, looked up in the shard of the node's smallest member
    home = local.select("shard", *KEY, "p1", "p2", F.col("conv_id").alias("conv"))
    parents = seen.select("shard", F.col("depth").alias("up"), F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("conv").alias("parent"))
    home = home.withColumn("up", F.col("depth") - 1).join(parents, ["shard", "up", "p1", "p2"], "left").select(*KEY, "conv", "parent")
    ended = local.where(F.col("ends").isNotNull()).select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    ended = ended.mapInArrow(_end_hashes, "depth long, z1 long, z2 long, ends_sha256 string")

    every = known.join(home, [*KEY, "conv"], "left").join(summed, list(KEY), "left").join(higher, list(KEY), "left").join(ended, list(KEY), "left")
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"), "n_convs",
        "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.coalesce("total", F.lit(0)) - F.coalesce("higher", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return nodes(*rebuilt(ordered_turns(conversations)))
