"""Conversation prefix trie by vertical bitmaps.

Every distinct sequence of first turns (role and text) is a node, from the root without a turn; it has
the conversations that start with it, and knows how many children and leaves there are below it, which
conversations end at it, and how many bytes are saved where all members share what it and the nodes
below it say.

*Shards of vertical bitmaps.* Conversations are cut into blocks of BLOCK turns, which carry what stands
before them as a digest of the prefix. Sorted by prefix and turns, each run of SHARD blocks of a task is
a shard. In it, (position, turn) indexes the set of blocks that have this turn there, as the bits of one
integer. Depth first, a node's set meets the posting of the next turn of its lowest block: that is a
child, and what is left makes the others, so that a shard takes one intersection a node. Popcounts
count members, and those whose turns end there are listed.

*Merging.* A node is known by its depth and a digest of its prefix: two 64-bit hashes, each the exclusive or of the
hashes of all (position, turn). So equal nodes of different shards meet by a group-by, with one row a
shard, however many conversations share them. Sums over subtrees are formed within shards, each node
counting in one shard (its home) and what follows a block being added where the block ends; the shards'
sums are added up. Lists of ends are put in order in ranges, written out as text by range, and digested
range by range: a node where a third of all conversations end is no row of its own.

A turn's position, and the prefix of a block of a long conversation, come from ranges (``ranks``), so a
conversation of any length is spread over tasks. Texts stay where they are read, but for turns of equal numbers.

Defined results: null role or text is empty; of equal turn numbers, role and text decide; turns without
a number come first; repeated rows are turns of their own; rows without a conversation id belong to no
conversation and make no node; an empty table gives an empty one; columns other than the four are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from .common import cut, map_rows

#: Turns of a block, and blocks of a shard.
BLOCK, SHARD = 256, 512
_NODE = ["depth", "a", "b"]


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``pos`` (from 1), two hashes of what is said and ``bytes`` of the text, of every turn."""
    said = [F.coalesce(df[c], F.lit("")) for c in (role, text)]
    rows = df.where(df[conv].isNotNull()).select(df[conv].cast("bigint").alias("conv"), df[turn].alias("turn"), said[0].alias("role"), said[1].alias("text"))
    hashes = {n: F.xxhash64(F.lit(k), "role", "text") for k, n in ((1, "h1"), (2, "h2"))}
    rows = rows.withColumns(hashes | {"bytes": F.octet_length("text").cast("bigint"), "tie": F.lit(1).cast("bigint")})
    facts = ["conv", "turn", "h1", "h2", "bytes", "tie"]
    # Texts are moved only where turns have equal numbers.
    tied = cut(rows.groupBy(F.col("conv").alias("_c"), F.col("turn").alias("_t")).agg(F.count("*").alias("n")).where("n > 1"))
    made = rows.select(facts)
    if not tied.isEmpty():
        same = (F.col("conv") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t"))
        in_order = ranks.placed(rows.join(tied, same, "left_semi"), ["conv", "turn"], [F.asc("role"), F.asc("text")], "tie")
        made = made.join(tied, same, "left_anti").unionByName(in_order.select(facts))
    return ranks.placed(made, ["conv"], [F.asc_nulls_first("turn"), F.asc("tie")], "pos").select("conv", "pos", "h1", "h2", "bytes")


def rebuilt(rows: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Turns in which each conversation c begins as conversation c - c % ``group`` does.

    The first h turns are that conversation's (as many as it has), h being crc32(c) % ``most``; c's own
    turns after its first h follow. ``pos`` is null in the one row of a conversation without turns.
    """
    rows = cut(rows)
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = rows.where("pos = 1").select("conv", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(group))).alias("base"))
    # Few turns of each conversation can stand at the head of another.
    heads = rows.where(F.col("pos") < most).withColumnsRenamed({"conv": "base"})
    taken = convs.join(heads, "base").where("pos <= h").select("conv", "pos", "h1", "h2", "bytes")
    # Each conversation has at most ``most`` turns from its base.
    at = convs.join(taken.groupBy("conv").agg(F.count("*").alias("n")), "conv", "left").select("conv", "h", F.coalesce("n", F.lit(0)).alias("n"))
    own = rows.join(at, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "h1", "h2", "bytes")
    out = cut(taken.unionByName(own))
    none = convs.select("conv").join(out.where("pos = 1").select("conv"), "conv", "left_anti")
    return out.unionByName(none, allowMissingColumns=True)


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks (``conv``, ``block``) with the digest of what stands before (``e1``, ``e2``), their turns, and whether the conversation ends.

    A turn is told by two hashes of its position and what is said.
    """
    at = [F.when(F.col("pos").isNotNull(), F.xxhash64("pos", h)).alias(h) for h in ("h1", "h2")]
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "h1", "h2", "bytes"))
    by = rows.select("conv", "pos", *at, "bytes").withColumn("block", F.coalesce(F.floor((F.col("pos") - 1) / BLOCK), F.lit(0)).cast("bigint"))
    blocks = by.groupBy("conv", "block").agg(F.array_sort(F.collect_list(item)).alias("t"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.max("pos").alias("upto"))
    last = by.groupBy("conv").agg(F.max("block").alias("last"))
    blocks = cut(blocks.join(last, "conv"))
    alone = blocks.where("last = 0").select("*", F.lit(0).cast("bigint").alias("e1"), F.lit(0).cast("bigint").alias("e2"))
    long = blocks.where("last > 0")
    if not long.isEmpty():
        xor = {n: (F.bit_xor, Column.bitwiseXOR, c) for n, c in (("e1", "x1"), ("e2", "x2"))}
        long = ranks.running(long, ["conv"], [F.asc("block")], xor)
        alone = alone.unionByName(long.withColumns({"e1": F.col("e1").bitwiseXOR(F.col("x1")), "e2": F.col("e2").bitwiseXOR(F.col("x2"))}))
    arrays = [F.col("t")[f].alias(f) for f in ("h1", "h2", "bytes")]
    return alone.select("conv", "block", "e1", "e2", *arrays, (F.col("block") == F.col("last")).alias("done"))


def shard_nodes(blocks: list[tuple], size: int) -> list[list]:
    """The nodes of one shard, parents first: depth, digest, parent's digest, popcount, smallest member, bytes of the last turn, ends, and the number of the last node below.

    ``blocks``: conv, block (of ``size`` turns), e1, e2, h1s, h2s, bytes, done. What a block follows is a node only if it is the root.
    """
    postings: dict[tuple, int] = {}
    ended: dict[int, int] = {}
    entries: dict[tuple, int] = {}
    for i, (_, block, e1, e2, h1, h2, _, done) in enumerate(blocks):
        bit = 1 << i
        entries[block, e1, e2] = entries.get((block, e1, e2), 0) | bit
        for pos, turn in enumerate(zip(h1, h2)):
            postings[pos, turn] = postings.get((pos, turn), 0) | bit
        if done:
            ended[len(h1)] = ended.get(len(h1), 0) | bit
    members = lambda s: [blocks[i][0] for i in _bits(s)]
    out: list[list] = []
    for (block, e1, e2), all_ in entries.items():
        # (set, position in the block, digest, parent's digest); none: the nodes since that number are below it.
        stack: list = [(all_, 0, (e1, e2), (None, None))]
        while stack:
            s, pos, digest, parent = stack.pop()
            if s is None:
                out[pos][-1] = len(out) - 1
                continue
            ends = s & ended.get(pos, 0)
            if pos or not block:
                low = blocks[(s & -s).bit_length() - 1]
                mine = members(s)
                stack.append((None, len(out), None, None))
                # A block's end is no conversation's if others follow it.
                out.append([block * size + pos, *digest, *parent, len(mine), min(mine), low[6][pos - 1] if pos else 0, members(ends), 0])
            left, children = s & ~ended.get(pos, 0), []
            while left:
                low = (left & -left).bit_length() - 1
                h1, h2 = blocks[low][4:6]
                if pos == len(h1):  # the conversation goes on in another block
                    left &= left - 1
                    continue
                child = left & postings[pos, (h1[pos], h2[pos])]
                left &= ~child
                children.append((child, pos + 1, (digest[0] ^ h1[pos], digest[1] ^ h2[pos]), digest))
            stack.extend(reversed(children))
    return out


def _bits(s: int) -> Iterator[int]:
    while s:
        low = s & -s
        yield low.bit_length() - 1
        s ^= low


def _local(blocks: DataFrame) -> DataFrame:
    """The nodes of all shards; ``shard`` and ``no`` (in preorder) tell them apart."""
    kinds = {"depth": "bigint", "a": "bigint", "b": "bigint", "pa": "bigint", "pb": "bigint", "n": "bigint", "conv": "bigint", "bytes": "bigint", "ends": "array<bigint>", "last": "bigint", "no": "bigint", "of": "bigint"}
    types = [pa.list_(pa.int64()) if k.startswith("array") else pa.int64() for k in kinds.values()]

    size, most = BLOCK, SHARD

    def made(held: list[tuple], of: int) -> pa.RecordBatch:
        rows = [(*r, k, of) for k, r in enumerate(shard_nodes(held, size))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(kinds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "e1", "e2", "h1", "h2", "bytes", "done"))):
                held.append(row)
                if len(held) == most:
                    yield made(held, of)
                    held, of = [], of + 1
        if held:
            yield made(held, of)

    # Blocks of one prefix stand together; the conversation's number spreads equal ones over tasks.
    by = ["block", "e1", "e2", "h1", "h2", "conv"]
    rows = blocks.repartitionByRange(*by).sortWithinPartitions(*by)
    nodes = map_rows(rows, run, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return cut(nodes.withColumn("shard", F.concat_ws("-", F.spark_partition_id().cast("string"), F.col("of").cast("string"))).drop("of"))


def _shard_sums(rows: DataFrame) -> DataFrame:
    """Sums of ``leaf`` and ``save`` from each node (``no``) to the last one below it, a shard at a time."""

    def sums(held: list[tuple]) -> pa.RecordBatch:
        t = np.array(held, np.int64)
        no, last = t[:, 3], t[:, 4]
        assert (no == np.arange(len(t))).all()
        out = [pa.array(t[:, i]) for i in range(3)]
        for c in (5, 6):
            so_far = np.concatenate([[0], np.cumsum(t[:, c])])
            out.append(pa.array(so_far[last + 1] - so_far[no]))
        return pa.RecordBatch.from_arrays(out, [*_NODE, "leaf", "save"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", *_NODE, "no", "last", "leaf", "save"))):
                if shard != now and held:
                    yield sums(held)
                    held = []
                now = shard
                held.append(row)
        if held:
            yield sums(held)

    rows = rows.select("shard", *_NODE, "no", "last", "leaf", "save").repartition("shard").sortWithinPartitions("shard", "no")
    return map_rows(rows, run, "depth bigint, a bigint, b bigint, leaf bigint, save bigint")


def _end_digests(local: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at a node, of the nodes that have any."""
    ends = local.select(*_NODE, F.explode("ends").alias("conv"))
    by = [*_NODE, "conv"]

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one node that follow each other become one piece of text."""
        for batch in batches:
            d, a, b, c = (batch.column(x).to_numpy() for x in by)
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(d) else np.zeros(0, np.int64)
            text = [",".join(map(str, c[i:j].tolist())) for i, j in zip(new.tolist(), [*new[1:].tolist(), len(d)])]
            yield pa.RecordBatch.from_arrays([pa.array(d[new]), pa.array(a[new]), pa.array(b[new]), pa.array(c[new]), pa.array(text, pa.string())], [*by, "text"])

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for *node, text in zip(*(batch.column(x).to_pylist() for x in (*_NODE, "text"))):
                if node == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                sha.update(text.encode())
            yield _digests(done)
        if now is not None:
            yield _digests([(*now, sha.hexdigest())])

    pieces = map_rows(ends.repartitionByRange(*by).sortWithinPartitions(*by), listed, "depth bigint, a bigint, b bigint, conv bigint, text string")
    pieces = pieces.repartition(*_NODE).sortWithinPartitions(*by)
    return map_rows(pieces.select(*_NODE, "text"), digested, "depth bigint, a bigint, b bigint, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [*_NODE, "ends_sha256"])


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row a node of the trie of ``rows`` (``conv``, ``pos``, ``h1``, ``h2``, ``bytes``): see the module."""
    blocks = cut(_blocks(rows))
    local = _local(blocks)
    nodes = local.groupBy(*_NODE).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("bytes").alias("bytes"), F.min("shard").alias("home"))
    nodes = cut(nodes.withColumn("save", (F.col("n_convs") - 1) * F.col("bytes")))
    above = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    children = above.groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("bigint")))
    at_home = nodes.select(*_NODE, F.col("home").alias("shard"), "leaf", "save")
    more = blocks.where("block > 0")
    if not more.isEmpty():
        # A node counts with its smallest member: what a block's conversation counts for in later blocks is added where the block ends.
        later = nodes.where(F.col("depth") > BLOCK).groupBy(F.col("conv_id").alias("conv"), F.floor((F.col("depth") - 1) / BLOCK).cast("bigint").alias("block")).agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save"))
        later = more.select("conv", "block", "e1", "e2").join(later, ["conv", "block"], "left").fillna(0, ["leaf", "save"])
        plus = {n: (F.sum, Column.__add__, c) for n, c in (("leaves", "leaf"), ("saves", "save"))}
        later = ranks.running(later, ["conv"], [F.desc("block")], plus)
        extra = later.groupBy((F.col("block") * BLOCK).alias("depth"), F.col("e1").alias("a"), F.col("e2").alias("b")).agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))
        at_home = at_home.join(extra, _NODE, "left").select(*_NODE, "shard", (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("leaf"), (F.col("save") + F.coalesce("saves", F.lit(0))).alias("save"))
    counted = local.select("shard", *_NODE, "no", "last").join(at_home, ["shard", *_NODE], "left").fillna(0, ["leaf", "save"])
    sums = _shard_sums(counted).groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("save").alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["depth", "pa", "pb"], "left").join(sums, _NODE).join(_end_digests(local), _NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
