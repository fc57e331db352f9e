"""Mixing sources to target weights, in blocks of words.

Each source's documents form one stream of words, cut into blocks of a fixed length. A source's
target in words becomes a number of slots. Slots are dealt to output shards by multinomial draws of
source counts, conditional on each source's total: a tree halves the range of shards, and at each
node a multivariate hypergeometric draw, seeded by the node, says how many slots of each source go
left. The draw gives every slot a mark in thought: those with marks below a bound are counted by
binomial draws, and the few that these are off by are drawn one by one; so it is the same, and
exact, for nodes of any size. Every shard walks down from the root by itself, so shards need no
common state and a rerun makes the same draws. A slot's number within its source goes through a pseudorandom permutation of
the source's blocks (a new one for each pass over them) and is joined to the block by its number.

Targets: the weighted shares of ``total``, where a source stops at ``repeats`` times its size and
the excess is shared again by weight.

Defined results: null text and text without words have size 0 and are taken 0 times; null source is
a source of its own; repeated rows, and rows without an id, count as rows of their own, in an order
that hangs on their ids and texts; without words nothing is taken; an empty table gives an empty mix.
Other columns, whatever their names, come back as they were. Documents never go to the driver; the
plan does, which is a name and five numbers for each source, and grows with their count alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_rows

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4_096
SEED = 17
#: Sources up to which a table with a row for each is broadcast; larger ones are joined by a shuffle.
FEW_SOURCES = 50_000
#: Documents that share one range of a source's stream, on average.
RANGE_ROWS = 2_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sizes: list[int], weights: list[float], total: float, repeats: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``repeats`` times its size."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > repeats * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = repeats * float(sizes[i])
            left -= out[i]
        open_ -= full
    return out


@dataclass(frozen=True)
class Plan:
    """Per source, by its number: words, target words, blocks and slots."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    slots: list[int]

    @property
    def shards(self) -> int:
        return -(-sum(self.slots) // SHARD_SLOTS)


def plan(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0) -> Plan:
    """Sources in code point order, null last, with the weights in turn."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    n = [sizes[s] for s in names]
    targets = water_fill(n, [float(weights[i % len(weights)]) for i in range(len(n))], share * sum(n), repeats)
    blocks = [-(-x // BLOCK_WORDS) for x in n]
    slots = [min(int(repeats * b), round(t * b / x)) if x else 0 for t, b, x in zip(targets, blocks, n)]
    return Plan(names, n, targets, blocks, slots)


def _chosen(pool: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` members of a pool drawn without putting back, counted by source; in time that goes with ``n``."""
    ends = np.cumsum(pool)
    if 2 * n > ends[-1]:
        return pool - _chosen(pool, int(ends[-1]) - n, rng)
    got = np.zeros(0, np.int64)
    while len(got) < n:  # whatever came up before is drawn again
        got = np.unique(np.concatenate([got, rng.integers(0, ends[-1], n - len(got))]))
    return np.bincount(np.searchsorted(ends, got, side="right"), minlength=len(pool))


@lru_cache(4_096)
def _left_share(counts: tuple[int, ...], take: int, node: tuple[int, int]) -> np.ndarray:
    """How many slots of each source are among ``take`` of them, drawn without putting back."""
    rng, have = np.random.default_rng([SEED, *node]), np.array(counts, np.int64)
    left = rng.binomial(have, take / max(1, int(have.sum())))
    off = int(left.sum()) - take
    return left - _chosen(left, off, rng) if off > 0 else left + _chosen(have - left, -off, rng)


def shard_counts(slots: np.ndarray, shards: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and before it."""
    lo, hi, counts, before = 0, shards, slots.astype(np.int64), np.zeros(len(slots), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _left_share(tuple(counts.tolist()), min((mid - lo) * SHARD_SLOTS, int(counts.sum())), (lo, hi))
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, before = mid, counts - left, before + left
    return counts, before


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)`` at the given places: a Feistel network, walked until within."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng([SEED, key]).integers(1, 2**63, 4, dtype=np.uint64)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> shift, x[todo] & mask
            for k in keys:
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                left, right = right, left ^ ((f >> np.uint64(40)) & mask)
            x[todo] = (left << shift) | right
            todo = todo[x[todo] >= size]
    return x.astype(np.int64)


def slots(spark: SparkSession, p: Plan) -> DataFrame:
    """(shard, slot, source_no, pass_no, block) of every slot of the mix."""
    counts, blocks = np.array(p.slots, np.int64), np.array(p.blocks, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n, before = shard_counts(counts, p.shards, shard)
                src = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + before[src]
                turn, at = number // blocks[src], number % blocks[src]
                block = np.empty(len(src), np.int64)
                for s in np.flatnonzero(n):
                    for t in np.unique(turn[src == s]):
                        here = (src == s) & (turn == t)
                        block[here] = permuted(at[here], int(blocks[s]), int(s) * 1_000 + int(t))
                place = np.random.default_rng([SEED, 7, shard]).permutation(len(src))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), shard)), pa.array(place), pa.array(src), pa.array(turn), pa.array(block)], ["shard", "slot", "source_no", "pass_no", "block"])

    parts = max(1, min(p.shards, 10_000, -(-p.shards // 16)))
    return map_rows(spark.range(0, p.shards, 1, parts), run, "shard bigint, slot bigint, source_no bigint, pass_no bigint, block bigint")


@dataclass
class Mix:
    """``docs``: each row's place in its source's stream; ``slots``: what the mix takes."""

    plan: Plan
    docs: DataFrame
    slots: DataFrame


def small(per_source: DataFrame, p: Plan) -> DataFrame:
    """A table with a row a source, marked for broadcast if these are few."""
    return F.broadcast(per_source) if len(p.sources) <= FEW_SOURCES else per_source


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **rules) -> Mix:
    """Lay out the streams and draw the mix.

    ``docs`` has doc_id, source, source_no, size, tie (a hash of the text) and first (the words
    before the row in its source). Sizes are summed per source and range of hashed rows, then over
    the ranges, so no source's rows, and no rows without an id, ever meet in one task.
    """
    rows = cut(df.select(df[doc_id].alias("doc_id"), df[source].alias("source"), n_words(df[text]).alias("size"), F.xxhash64(df[text]).alias("tie")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("k")).collect()
    p = plan({r["source"]: r["n"] for r in sums}, **rules)
    ranges = max(1, sum(r["k"] for r in sums) // RANGE_ROWS)
    numbers = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(p.sources)], "source string, source_no bigint") if p.sources else None
    if numbers is None:
        docs = rows.select("doc_id", "source", F.lit(0).cast("bigint").alias("source_no"), "size", "tie", F.lit(0).cast("bigint").alias("first"))
        return Mix(p, docs, slots(df.sparkSession, p))
    rows = rows.join(small(numbers, p), rows["source"].eqNullSafe(numbers["source"])).drop(numbers["source"])
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(ranges)))
    over = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source_no", "range").agg(F.sum("size").alias("n")).select("source_no", "range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("start"))
    within = Window.partitionBy("source_no", "range").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["source_no", "range"])
    docs = rows.select("doc_id", "source", "source_no", "size", "tie", (F.col("first") + F.col("start")).alias("first"))
    return Mix(p, docs, slots(df.sparkSession, p))


def pieces(m: Mix) -> DataFrame:
    """(source_no, first, block, from_word, n_words): the part of each document that lies in each block."""
    last = F.col("first") + F.col("size")
    d = m.docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK_WORDS), F.floor((last - 1) / BLOCK_WORDS))))
    start = F.greatest(F.col("first"), F.col("block") * BLOCK_WORDS)
    end = F.least(last, (F.col("block") + 1) * BLOCK_WORDS)
    return d.select("source_no", "first", "block", (start - F.col("first")).alias("from_word"), (end - start).alias("n_words"))


def taken(m: Mix) -> DataFrame:
    """(source_no, first, taken): the words that the mix takes of each document, repeats counted."""
    times = m.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # Spark can't tell how many slots a shard makes, so it is told not to broadcast them.
    return pieces(m).join(times.hint("merge"), ["source_no", "block"]).groupBy("source_no", "first").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))


def mixed_documents(df: DataFrame, m: Mix | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mix as documents: for each pass over its source, a row with the document's blocks of that pass.

    A document taken whole twice is there twice, as it was; one of which a pass takes some blocks has the words
    of those, in order, with one space between two words.
    Ids repeat where rows do. All columns of ``df`` are returned, with ``n_chars`` counted anew.
    """
    m = m or mix(df, doc_id, text, source)
    parts = pieces(m).join(m.slots.select("source_no", "block", "pass_no").hint("merge"), ["source_no", "block"])
    parts = parts.groupBy("source_no", "first", "pass_no").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("ranges"))
    keys = ["id", "source", "size", "tie"]
    chosen = parts.hint("merge").join(m.docs.where("size > 0").select("source_no", "first", F.col("doc_id").alias("id"), "source", "size", "tie"), ["source_no", "first"])
    # Rows of one id, source and text share the places that these have, in an order that a rerun repeats.
    chosen = chosen.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy("first")))
    chosen = chosen.groupBy(*keys, "place").agg(F.collect_list("ranges").alias("passes"))
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), df[doc_id].alias("id"), df[source].alias("source"), n_words(df[text]).alias("size"), F.xxhash64(df[text]).alias("tie")).where("size > 0")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row"))))
    a, b = rows.alias("a"), chosen.hint("merge").alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "place")]
    out = a.join(b, reduce(Column.__and__, same)).select("a.row", "a.size", F.explode("b.passes").alias("ranges"))
    whole = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["n_words"]) == F.col("size")
    said = F.col("row")[text]
    words = F.split(F.trim(F.regexp_replace(said, r"[\x20\x09-\x0D]+", " ")), " ")
    some = F.array_join(F.transform("ranges", lambda r: F.array_join(F.slice(words, r["from_word"].cast("int") + 1, r["n_words"].cast("int")), " ")), " ")
    out = out.withColumn("said", F.when(whole, said).otherwise(some))
    made = {text: F.col("said")}
    if n_chars in df.columns:
        made[n_chars] = F.length("said").cast(df.schema[n_chars].dataType)
    return out.select(*(made.get(c, F.col("row")[c]).alias(c) for c in df.columns))
