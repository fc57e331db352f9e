"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into phrases, each the shortest stretch that no earlier phrase
equals, as in LZ78. The set of phrases stands for what a compressor would learn from the text. It is
hashed, and the smallest hash in each of BINS bins makes the signature; the share of equal bins of
two signatures estimates the overlap of the phrase sets.

A phrase's beginnings are phrases themselves, so phrases form a trie that is walked a byte at a time.
Phrases are hashed all at once, from running sums of a polynomial over the text.

Defined results: null text is empty text, whose signature has empty bins only; two empty signatures
are alike to degree 1, an empty and another one to 0; equal texts have equal fingerprints. Rows without
an id, or with one that is no integer, come after all others, rows of equal ids in the order of a hash
of their text; only rows of one id and one text must share a range. Empty tables give empty results; carried columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, mix64, ship, slices

BINS = 64
#: Hex digits of a bin, and what an empty bin has.
DIGITS, EMPTY = 4, "ffff"
#: Bytes of text that are hashed at once.
SLICE = 500_000
_CODE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93
#: More than any hash in a bin.
_NONE = np.uint64((1 << 64) - 1)
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Rows that a range holds at least on average, when texts are put beside their neighbours, while there
#: are no more ranges than the session has shuffle partitions.
RANGE_ROWS = 4_000
#: Pieces that make a range, and bytes that a row counts for beside its text.
PIECES, ROW_BYTES = 16, 100


def parse(data: bytes) -> list[int]:
    """Where each phrase ends; a rest that is a phrase already is left to itself as the last one.

    Phrases are the nodes of a trie, kept as one table from node and byte to node.
    """
    trie: dict[int, int] = {}
    get, node, made, ends = trie.get, 0, 256, []
    end = ends.append
    for at, byte in enumerate(data, 1):
        step = node + byte
        node = get(step)
        if node is None:
            trie[step] = made
            made += 256
            node = 0
            end(at)
    if node:
        end(len(data))
    return ends


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)])
    return _powers[0], _powers[1]


def signatures(texts: list[str | None]) -> list[str]:
    """The signature of each whole text, DIGITS hex digits a bin."""
    data = [(t or "").encode() for t in texts]
    ends, doc, at = [], [], 0
    for i, d in enumerate(data):
        e = parse(d)
        ends.append(np.array(e, np.int64) + at)
        doc.append(np.full(len(e), i))
        at += len(d)
    least = np.full(len(data) * BINS, _NONE, np.uint64)
    if at:
        # Phrases follow each other without gaps, from the first text to the last.
        ends, doc = np.concatenate(ends), np.concatenate(doc)
        starts = np.concatenate([[0], ends[:-1]])
        up, down = _power(at)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODE[np.frombuffer(b"".join(data), np.uint8)] * up[:at])])
            h = mix64((sums[ends] - sums[starts]) * down[starts])
        np.minimum.at(least, doc * BINS + (h >> np.uint64(58)).astype(np.int64), h & np.uint64((1 << 58) - 1))
    digest = np.where(least == _NONE, np.uint64(0xFFFF), mix64(least) % np.uint64(0xFFFF)).astype(">u2").tobytes()
    size = BINS * 2
    return [digest[i : i + size].hex() for i in range(0, len(digest), size)]


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """The rows with the signature of ``text`` in ``out``; ``keep`` names the other columns of the result."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = df.select(keep).schema.add(out, "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                made = pa.array(signatures(part.column(text).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], [*keep, out])

    return map_rows(df.select(list(dict.fromkeys([*keep, text]))), run, schema)


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bins among those that either signature fills."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    pair = F.transform(bins, lambda i: F.struct(F.substring(a, i * DIGITS + 1, F.lit(DIGITS)).alias("x"), F.substring(b, i * DIGITS + 1, F.lit(DIGITS)).alias("y")))
    filled = F.filter(pair, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    return F.when(F.size(filled) == 0, F.lit(1.0)).otherwise(F.size(F.filter(filled, lambda p: p["x"] == p["y"])) / F.size(filled))


def places(edges: np.ndarray, at: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many of the ascending pairs ``edges`` are not above each pair of ``at`` and ``tie``."""
    low, high = np.searchsorted(edges[:, 0], at, side="left"), np.searchsorted(edges[:, 0], at, side="right")
    out = low.copy()
    for a in np.unique(low[low < high]):
        same = (low == a) & (low < high)
        out[same] = a + np.searchsorted(edges[a : high[same][0], 1], tie[same], side="right")
    return out


def edited_by_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] = (), ids: DataFrame | None = None) -> DataFrame:
    """doc_id, ``carry``, ``edited`` and ``next_<c>`` of each carried column, for every row.

    ``edited`` is the text whose last floor(n/2) code points gave way to the first as many of the
    next document's, in descending order of ids and, after the last, the first. Rows are cut into a
    range for each task, by id and, within an id, by a hash of the text, so that rows without an id or
    of one id are spread as well. A range is sorted and walked over, and the first row of each range is
    also sent to the range before it. So texts cross the network once, and neither all rows nor all
    texts of a range are held.

    About PIECES rows a task, drawn by hash, cut the rows into pieces, and consecutive pieces of about
    as many bytes in all make a range: that is all the driver sees. ``ids`` may name a table that has
    the same ids and texts and is cheaper to read than ``df``.
    """
    import pandas as pd

    spark, names = df.sparkSession, list(carry)
    ship(spark)
    texts = lambda d: F.coalesce(d[text], F.lit(""))
    at = lambda d: F.coalesce(d[doc_id].cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    tie = lambda d: F.bitwise_not(F.xxhash64(texts(d)))
    source = df if ids is None else ids
    alone = source.select(at(source).alias("at"), tie(source).alias("tie"), (F.octet_length(texts(source)) + F.lit(ROW_BYTES)).alias("bytes"))
    n = source.count()
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // RANGE_ROWS))
    one_of = max(1, n // (PIECES * tasks))
    edges = np.array(sorted(tuple(r) for r in alone.where(F.pmod(F.xxhash64("at", "tie"), F.lit(one_of)) == 0).select("at", "tie").distinct().collect()), np.int64).reshape(-1, 2)

    @F.pandas_udf("int")
    def piece_of(at, tie):
        return pd.Series(places(edges, at.to_numpy(), tie.to_numpy()).astype(np.int32))

    pieces = alone.withColumn("piece", piece_of("at", "tie")).groupBy("piece").agg(F.sum("bytes").alias("bytes"), F.max(F.struct("at", "tie")).alias("top")).collect()
    whole, part, so_far, top = sum(p["bytes"] for p in pieces), np.zeros(len(edges) + 1, np.int32), 0, {}
    for p in sorted(pieces, key=lambda p: p["piece"]):
        part[p["piece"]] = tasks * so_far // whole
        so_far += p["bytes"]
        top[int(part[p["piece"]])] = tuple(p["top"])
    order, tops, before = sorted(top), np.zeros((tasks, 2), np.int64), np.zeros(tasks, np.int32)
    for i, p in enumerate(order):
        tops[p], before[p] = top[p], order[(i + 1) % len(order)]

    @F.pandas_udf("part int, before int")
    def range_of(at, tie):
        p = part[places(edges, at.to_numpy(), tie.to_numpy())]
        first = (tops[p, 0] == at.to_numpy()) & (tops[p, 1] == tie.to_numpy())
        return pd.DataFrame({"part": p, "before": np.where(first, before[p], -1).astype(np.int32)})

    # Carried columns travel in a struct, so that their names cannot clash with those used here.
    rows = df.select(df[doc_id].alias("id"), F.struct(F.lit(0).alias("_"), *(df[c] for c in names)).alias("more"), texts(df).alias("text"), at(df).alias("at"), tie(df).alias("tie"))
    rows = rows.withColumn("to", range_of("at", "tie"))
    here = F.struct("to.part", F.lit(0).alias("seam"))
    both = F.when(F.col("to.before") >= 0, F.array(here, F.struct(F.col("to.before").alias("part"), F.lit(1).alias("seam")))).otherwise(F.array(here))
    rows = rows.select("id", "more", "text", "at", "tie", F.explode(both).alias("p")).select("id", "more", "text", "at", "tie", "p.part", "p.seam")
    rows = rows.repartitionById(tasks, F.col("part")).sortWithinPartitions("part", "seam", F.desc("at"), F.desc("tie"))
    schema = df.select(df[doc_id].alias("id"), *names).schema.add("edited", "string")
    for c in names:
        schema = schema.add(f"next_{c}", df.schema[c].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            more = [dict(zip(names, m)) for m in zip(*(pc.struct_field(batch.column("more"), [i + 1]).to_pylist() for i in range(len(names))))] if names else [{}] * len(batch)
            for *row, own in zip(*(batch.column(c).to_pylist() for c in ("part", "seam", "text", "id")), more):
                if held is not None and held[0] == row[0] and not held[1]:
                    half = len(held[2]) // 2
                    out.append((held[3], *held[4].values(), held[2][: len(held[2]) - half] + row[2][:half], *own.values()))
                held = (*row, own)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], labels)

    from pyspark.sql.pandas.types import to_arrow_type

    types, labels = [to_arrow_type(f.dataType) for f in schema], [f.name for f in schema]
    return map_rows(rows, run, schema).withColumnRenamed("id", doc_id)
