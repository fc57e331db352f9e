"""Target-distribution importance resampling over hashed word n-grams.

A text's features are all runs of 1 to 3 consecutive words, each put into a bucket by its CRC-32. How
often the buckets occur in the raw texts and in texts of the target distribution gives each bucket a
gain, the logarithm of the two smoothed shares' ratio; a text's weight is the sum of its features'
gains. Gumbel noise, which an id's digest decides, is added, and the texts of the highest scores are
drawn: that is sampling without replacement in proportion to the weights' exponentials.

*Words by byte table*: one 256-byte table lower-cases A-Z and blanks whatever separates words, on UTF-8
as it is (bytes over 0x7F are parts of words); ``bytes.split`` yields the words. *Chained CRCs*: an
n-gram's CRC starts from that of the n-gram without its last word, so that no n-gram is ever put
together. *Counters* add up buckets: one for a few texts at a time, whose sums leave the task, and one
for each text in the second pass.

Two passes read the texts: one counts buckets (a row a bucket and task, pre-aggregated), one weighs.
Only the gains (one number a bucket) pass through the driver. The draw ranks the scores in ranges (see
``ranks.placed``), so that no task holds all of them, and repeated rows are spread.

Defined results: null text has no features and weight 0; texts of any length are read whole; a row
without an id has the noise of the id ``""`` and comes after all ids in ties; rows of one id have equal
noise, and of equal rows either is drawn first; tables without features give gains of their smoothed
zeros; an empty table gives an empty one. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from .common import cut, map_rows, slices

#: What ``bytes.translate`` makes of each byte: digits, letters (lower-cased) and all of UTF-8 beyond ASCII stay.
TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Resampler:
    """Words of the longest n-gram, buckets, the least words of a text that may be drawn, percent drawn, and the noise's seed."""

    ngram: int = 3
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 5
    seed: int = 42


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def feature_crcs(words: list[bytes], longest: int) -> Iterator[int]:
    """CRC-32 of every run of 1 to ``longest`` words, joined by one space."""
    now = list(map(crc32, words))
    yield from now
    after = [b" " + w for w in words[1:]]
    for _ in range(longest - 1):
        now = list(map(crc32, after, now))
        yield from now
        after = after[1:]


def bucket_counter(words: list[bytes], r: Resampler) -> Counter[int]:
    return Counter(map(r.buckets.__rmod__, feature_crcs(words, r.ngram)))


def _texts(part: pa.RecordBatch) -> list[bytes]:
    """UTF-8 of a text column, nulls as empty."""
    return part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()


def bucket_counts(df: DataFrame, r: Resampler = Resampler(), text: str = "text") -> DataFrame:
    """(bucket, n) of the features of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                crcs = chain.from_iterable(feature_crcs(words_of(t), r.ngram) for t in _texts(part))
                counts.update(map(r.buckets.__rmod__, crcs))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["bucket", "n"])

    return map_rows(df.select(df[text].alias("text")), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], r: Resampler = Resampler()) -> list[int]:
    """Each bucket's floor(1000 ln(share in the target / share in the raw texts)), shares smoothed by 1."""
    s_all, t_all = float(sum(raw.values()) + r.buckets), float(sum(target.values()) + r.buckets)
    one = lambda s, t: math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
    return [one(raw.get(b, 0), target.get(b, 0)) for b in range(r.buckets)]


def learn(raw: DataFrame, target: DataFrame, r: Resampler = Resampler(), raw_text: str = "text", target_text: str = "text") -> list[int]:
    """Gains of all buckets; their counts, at most a row a bucket and side, come to the driver."""
    side = lambda df, c: {x["bucket"]: x["n"] for x in bucket_counts(df, r, c).collect()}
    return gains(side(raw, raw_text), side(target, target_text), r)


def weighted(df: DataFrame, gain: Sequence[int], r: Resampler = Resampler(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every row."""
    kind = df.schema[doc_id].dataType.simpleString()
    gain = list(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_features, weight = [], [], []
                for t in _texts(part):
                    words = words_of(t)
                    n_words.append(len(words))
                    n_features.append(sum(max(0, len(words) - k) for k in range(r.ngram)))
                    weight.append(sum(gain[b] * n for b, n in bucket_counter(words, r).items()))
                made = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], ["id", "n_words", "n_features", "weight"])

    rows = df.select(df[doc_id].alias("id"), df[text].alias("text"))
    return map_rows(rows, run, f"id {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("id", doc_id)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def drawn(weights: DataFrame, r: Resampler = Resampler(), doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``weighted`` with ``score`` and ``rank``: 1 to the count drawn by score, then id, else null."""
    rows = cut(weights.withColumn("score", F.col("weight") + noise(F.col(doc_id), r.seed)))
    may = rows.where(F.col("n_words") >= r.least_words)
    most = may.count() * r.percent // 100
    ranked = ranks.placed(may, [], [F.desc("score"), F.asc_nulls_last(doc_id)], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.unionByName(rows.where(F.col("n_words") < r.least_words).withColumn("rank", F.lit(None).cast("bigint")))


def resample(df: DataFrame, target: DataFrame, r: Resampler = Resampler(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts drawn: the rows of ``df``, once each, whose rows of ``drawn`` have a rank, with ``score`` and ``rank``.

    Rows of one id and one text share their place with each other and are drawn together or not at all.
    """
    alone = df.dropDuplicates([doc_id, text])
    key = lambda d: F.xxhash64(d[doc_id], d[text])
    keyed = alone.select(F.struct(doc_id, key(alone).alias("key")).alias("own"), alone[text].alias("text"))
    made = weighted(keyed, learn(df, target, r, text), r, "own", "text")
    made = made.select(F.col(f"own.{doc_id}").alias("id"), F.col("own.key").alias("key"), "n_words", "n_features", "weight")
    won = drawn(made, r, "id").where("rank is not null").select(F.col("key").alias("_drawn"), "score", "rank")
    rows = alone.select(*(c for c in alone.columns if c not in ("score", "rank")), key(alone).alias("_key"))
    return rows.join(won, F.col("_key") == F.col("_drawn")).drop("_key", "_drawn")
