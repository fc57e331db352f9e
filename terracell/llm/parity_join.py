"""Exact n-gram Jaccard join on parity sketches, and the groups that its links make.

A text's set holds its distinct word n-grams (hashed to 64 bits). Texts with equal sets are one
node from the start. For the others:

1. *Parity sketches.* A set is dealt over P words; each n-gram flips bits in the one word that its
   hash names. Two sets that differ in D n-grams differ in at most D words, and in at most D bits of
   any sketch in which an n-gram flips one bit.
2. *Pigeonhole join per size band.* Sizes fall into bands; a set is entered in its own band and in
   those above in which it may have a partner. The threshold bounds D for a band's largest sets, and
   P is larger than that, so similar sets have at least P - D words in common. All words of all sets
   stand in one order: those that more n-grams made come first, then by their hash. The first common
   word of two sets is preceded by at most D others in either, so each set is entered under its first
   D + 1 words only, D being the most that its own size allows. Sets that share an entry are
   candidates. Words made by few n-grams, which say little, are the ones left out.
3. *Verify in rounds.* Every word that two nodes or more share gets a leader: its node of the best
   support, which is the number of its words that are shared. The others are held against it, by bit
   sketches first (one of 512 bits, one with some bits for each n-gram), then by exact intersection.
   The links found make components, and the leader, done with, leaves the word. While a round still
   finds links, the next one takes words whose nodes lie in different components and leads them by
   the largest component that has not led there yet. Support picks the text that the others are
   copies of, so that a round or two find nearly all components.
4. *Pair what is left.* Words whose nodes still lie in different components are joined with
   themselves; the sketches are part of that join's condition, so that it yields only pairs of
   different components which are all but sure to link. Those are intersected as well. Pairs whose
   link could change nothing are never made, so that a group of thousands of near copies does not
   become millions of pairs. Only comparing sketches, within such a word, takes time in proportion to
   the pairs of nodes of different components.

Defined results: null text, or text without a word, has an empty set and links with nothing, itself
included; a text with fewer than n words has its whole word sequence as its one n-gram; rows with
equal sets are always linked, whatever their ids; rows without an id, or with a repeated one, stand
for themselves, and their texts are found by a hash of id and text, so that they lose no link. Other
columns are not read, whatever their names. Empty tables give empty results; ties between leaders go
to the larger node. Sets, nodes, n-grams and rows (id and text) are known by 64-bit hashes. Nothing is
capped. Words are counted with partial aggregation before any shuffle, and joins on a word or a node
that many rows share are split by Spark's adaptive skew joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, map_rows, mix64, slices, text_bytes

#: A band's largest size as a multiple of its smallest.
BAND = 1.6
#: Links that a file of a round of components holds, on average.
LINKS_A_FILE = 200_000
#: Words kept for each word that must be entered.
SPARE = 1.25
#: Words of the short bit sketch, 64 bits each, and bits that the long one has for each n-gram at least.
SKETCH, BITS = 8, 4
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CODES[_SPACE] = 0
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Join:
    """Words to an n-gram, the least similarity as ``num`` / ``den``, and passes in which words are counted.

    Each pass takes a share of all words, so that no more than this share is on disks at a time.
    """

    ngram: int = 5
    num: int = 80
    den: int = 100
    passes: int = 1

    def differing(self, size: int) -> int:
        """The most n-grams in which two linked sets of at most this size differ."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """What a set is entered under: sets that are similar enough have one of these in common."""
        return sketch_words(s, self)

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(number, D for this size, P) of the bands in which a set of this size is entered."""
        out, lo, k = [], 1, 0
        while True:
            hi = max(lo, int(lo * BAND))
            if lo > size and size * self.den < self.num * lo:
                return out
            if size <= hi:
                largest = min(hi, size * self.den // self.num)
                d = (size + largest) * (self.den - self.num) // (self.den + self.num)
                out.append((k, d, math.ceil(SPARE * (self.differing(hi) + 1))))
            lo, k = hi + 1, k + 1


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: runs of bytes other than space and tab to CR, A-Z lower-cased."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    before = np.r_[False, inside[:-1]]
    before[offs[:-1][offs[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = np.diff(np.r_[starts, len(raw)])
    at = np.arange(starts[0], len(raw)) - np.repeat(starts, run)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(int(run.max()), _STEP, np.uint64)])
        terms = _CODES[_LOWER[raw[starts[0] :]]] * powers[at]
        sums = np.add.reduceat(terms, starts - starts[0])
    return mix64(sums), np.searchsorted(offs, starts, side="right") - 1


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each row's distinct n-gram hashes, ascending."""
    raw, offs = text_bytes(texts)
    words, row = word_hashes(raw, offs)
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        if len(words) >= n:
            acc = np.zeros(len(words) - n + 1, np.uint64)
            for i in range(n):
                acc = (acc + words[i : len(words) - n + 1 + i]) * _STEP
                acc ^= acc >> np.uint64(29)
            grams = mix64(acc)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                acc = np.uint64(b - a)
                for w in words[a:b]:
                    acc = (acc + w) * _STEP
                    acc ^= acc >> np.uint64(29)
                out.append(mix64(np.array([acc], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int | None:
    """A node's name: a hash of its set; none for an empty one."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        both = mix64(s + np.uint64(len(s))).sum(dtype=np.uint64) + np.bitwise_xor.reduce(mix64(s ^ _STEP)) * np.uint64(3)
    return int(mix64(np.array([both], np.uint64)).view(np.int64)[0])


def bit_sketch(s: np.ndarray, bits: int = 64 * SKETCH) -> np.ndarray:
    """Parity of the n-grams that name each of a power of two of bits."""
    count = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").view(np.int64)


def long_sketch(s: np.ndarray) -> np.ndarray:
    return bit_sketch(s, max(64 * SKETCH, 1 << (BITS * max(1, len(s)) - 1).bit_length()))


def sketch_words(s: np.ndarray, join: Join) -> np.ndarray:
    """Keys of the parity words under which a set is entered."""
    out, code = [], mix64(s ^ _STEP)
    for band, d, parts in join.bands(len(s)):
        if not d:
            continue
        part = (((code >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(part, minlength=parts)
        word = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(word, part, mix64(code))
        key = mix64(word ^ mix64(np.arange(parts, dtype=np.uint64) ^ np.uint64(band << 40)))
        out.append(key[np.lexsort((key, -count))[: d + 1]])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _described(df: DataFrame, join: Join) -> DataFrame:
    """id, row key, size and node of every row, and the keys of its words; a task lists a node's keys once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets, keys = ngram_sets(part.column("text"), join.ngram), []
                nodes = [set_hash(s) for s in sets]
                for s, node in zip(sets, nodes):
                    known = node is None or node in seen
                    keys.append(None if known else join.keys(s))
                    if not known and len(seen) < 500_000:
                        seen.add(node)
                arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), *arrays], ["id", "row", "size", "node", "keys"])

    kind = df.schema["id"].dataType.simpleString()
    return map_rows(df, run, f"id {kind}, row bigint, size bigint, node bigint, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """node, size, bit sketches and n-grams of the rows whose keys are wanted."""
    cols = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = ngram_sets(part.column("text"), join.ngram)
                sk = np.stack([bit_sketch(s) for s in sets])
                arrays = [pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(sk[:, i]) for i in range(SKETCH))]
                wide, grams = pa.array([long_sketch(s) for s in sets], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*arrays, wide, grams], ["node", "size", *cols, "wide", "grams"])

    texts = docs.join(wanted, "row", "left_semi").select("text")
    made = map_rows(texts, run, "node bigint, size bigint, " + ", ".join(f"{c} bigint" for c in cols) + ", wide array<bigint>, grams binary")
    # A row key stands for equal rows.
    return made.where("node is not null").dropDuplicates(["node"])


def _most(join: Join, a: str, b: str) -> Column:
    return F.floor((F.col(f"{a}.size") + F.col(f"{b}.size")) * (join.den - join.num) / (join.den + join.num))


def _near(join: Join, a: str, b: str) -> Column:
    """What linked nodes must meet: sizes within the threshold, and short sketches within D bits."""
    size = lambda x: F.col(f"{x}.size")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)])
    return (F.least(size(a), size(b)) * join.den >= F.greatest(size(a), size(b)) * join.num) & (differ <= _most(join, a, b))


def _within(join: Join, a: str, b: str) -> Column:
    """Long sketches within D bits; the longer one is folded, sizes being less than a factor 2 apart."""
    x, y = F.col(f"{a}.wide"), F.col(f"{b}.wide")
    half = lambda w: (F.size(w) / 2).cast("int")
    folded = lambda w: F.zip_with(F.slice(w, 1, half(w)), F.slice(w, half(w) + 1, half(w)), lambda p, q: p.bitwiseXOR(q))
    shorter = lambda w, v: F.when(F.size(w) > F.size(v), folded(w)).otherwise(w)
    bits = F.zip_with(shorter(x, y), shorter(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return (F.size(x) > 2 * F.size(y)) | (F.size(y) > 2 * F.size(x)) | (F.aggregate(bits, F.lit(0), lambda n, z: n + z) <= _most(join, a, b))


def _verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Those of the pairs of nodes whose sets are similar enough, by exact intersection."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(join.den * common >= join.num * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return map_rows(both.select("a", "b", "x", "y"), meet, "a bigint, b bigint")


def components(links: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """``node`` and ``comp``, the smallest node reachable, for every node that has a link.

    Large-star and small-star steps alternate until the links no longer change; each step joins the
    links with their nodes' smallest neighbours, so no neighbourhood is gathered in one place.
    """
    e, before = cut(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct()), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v")).distinct())
        # Few links need few files, whatever the session's count of partitions.
        before, files = now, 1 + now[0] // LINKS_A_FILE
        e = e.coalesce(files)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u != v").distinct().coalesce(files))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What rows of one id (or none) and one text have in common."""
    return F.xxhash64(id_col, text_col)


def has_word(text_col: str = "text") -> Column:
    """Whether a row has a set that is not empty."""
    return F.coalesce(F.col(text_col).rlike(r"[^ \t-\r]"), F.lit(False))


def _labelled(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members with the component of their node; a node without a link is its own."""
    if comp is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _leaders(members: DataFrame, led: DataFrame | None) -> DataFrame:
    """key, ``leader`` and its component ``of``, of keys with several: the largest one not in ``led`` (key, comp)."""
    if led is None:  # every node is a component
        by = members.select("key", "comp", F.lit(1).alias("n"), F.struct("support", "node").alias("best"), F.lit(1).alias("fresh"))
    else:
        by = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max(F.struct("support", "node")).alias("best"))
        by = by.join(led.withColumn("_led", F.lit(0)), ["key", "comp"], "left").withColumn("fresh", F.coalesce("_led", F.lit(1)))
    top = by.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("fresh", "n", "best", "comp")).alias("top"))
    return top.where("comps > 1").select("key", F.col("top.best.node").alias("leader"), F.col("top.comp").alias("of"))


def _linked(df: DataFrame, join: Join, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its node; every node with its component and its leading row (smallest id, none last)."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"), row_key(id_col, text_col).alias("row"))
    rows = cut(_described(docs, join))
    lead = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "row")).alias("lead"))
    sketch = [f"s{i}" for i in range(SKETCH)]

    entries = rows.select("node", F.explode("keys").alias("key"))
    parts = []
    for i in range(join.passes):
        some = entries.where(F.pmod("key", F.lit(join.passes)) == i) if join.passes > 1 else entries
        shared = cut(some.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("key"))
        free(df.sparkSession)
        parts.append(cut(some.join(shared, "key", "left_semi").distinct()))
        del some, shared
        free(df.sparkSession)
    members = reduce(DataFrame.union, parts)
    support = members.groupBy("node").agg(F.count("*").alias("support"))
    members = members.join(support, "node")
    del entries, parts
    free(df.sparkSession)
    sets = cut(_sets(docs, lead.join(support, "node", "left_semi").select("lead.row"), join))
    facts = sets.select("node", "size", *sketch, "wide")
    del support
    free(df.sparkSession)

    def near_pairs(pairs: DataFrame) -> DataFrame:
        both = pairs.join(facts.alias("p"), F.col("a") == F.col("p.node")).join(facts.alias("q"), F.col("b") == F.col("q.node"))
        return both.where(_near(join, "p", "q") & _within(join, "p", "q")).select("a", "b")

    stale = False  # whether links are missing in the components
    links, comp, tried, led, found, all_ = None, None, None, None, 1, 1
    # Rounds go on while one finds a tenth of all links or more; what is left is exact in any case.
    while 10 * found >= all_:
        now = _labelled(members, comp)
        leaders = _leaders(now, None if led is None else _labelled(led, comp).select("key", "comp").distinct())
        members = cut(now.join(leaders, "key").where("node != leader"))
        stars = members.where("comp != of").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        near = cut(near_pairs(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti")))
        own = members.select("key", F.col("leader").alias("node")).distinct()
        led = own if led is None else led.union(own)
        members = members.select("key", "node", "support")
        held_against = near.count()
        del now, leaders, stars
        free(df.sparkSession)
        if not held_against:
            break
        near = near.coalesce(1 + held_against // LINKS_A_FILE)
        more = cut(_verified(near, sets, join))
        found = more.count()
        more = more.coalesce(1 + found // LINKS_A_FILE)
        tried = near if tried is None else tried.union(near)
        if not found:
            break
        links = more if links is None else links.union(more)
        all_ = found if comp is None else all_ + found
        stale = 10 * found < all_
        if not stale:
            comp = cut(components(links))
        free(df.sparkSession)

    # Leaders were held against all of their words' nodes, so only the other nodes can still make pairs.
    # Few links of the last round are missing in the components; their pairs are among those tried.
    now = _labelled(members, comp)
    mixed = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    rest = cut(now.select("key", "node", "comp").join(mixed, "key", "left_semi").join(facts, "node"))
    p, q = rest.alias("p"), rest.alias("q")
    apart = (F.col("p.key") == F.col("q.key")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.comp") != F.col("q.comp"))
    crossing = p.join(q, apart & _near(join, "p", "q") & _within(join, "p", "q")).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    crossing = cut(crossing if tried is None else crossing.join(tried, ["a", "b"], "left_anti"))
    left = crossing.count()
    del now, mixed, p, q
    free(df.sparkSession)
    more = cut(_verified(crossing.coalesce(1 + left // LINKS_A_FILE), sets, join)) if left else None
    if more is not None and more.count():
        links, stale = more if links is None else links.union(more), True
    if stale:
        comp = cut(components(links))
    free(df.sparkSession)
    if comp is None:
        return rows, lead.withColumn("comp", F.col("node"))
    return rows, lead.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def groups(df: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every row."""
    rows, ids = _linked(df, join, id_col, text_col)
    first = ids.groupBy("comp").agg(F.min("lead.id").alias("first"))
    rows = rows.select("id", "size", "node")
    # Rows without a word meet nobody, and must not meet each other in one task.
    out = rows.where("node is not null").join(ids.join(first, "comp").select("node", "first"), "node").select("id", "size", "first")
    out = out.union(rows.where("node is null").select("id", "size", "id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))


def leading(df: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``: the key of the leading row of each component; rows without a word have none."""
    _, ids = _linked(df, join, id_col, text_col)
    return ids.groupBy("comp").agg(F.min("lead").alias("lead")).select("lead.row")
