"""Exact top-k inner products by block-at-a-time pruning.

Vectors of integers stand in document ranges that keep like ones together: centroids, fitted on a
bounded sample, give each vector a cluster, and a cluster is cut into shelves of about SHELF vectors,
a shelf into blocks of BLOCK. A block has a forward index (its vectors, row by row) and, for each term
(dimension), the largest and the smallest value in it; a shelf has the same of all its blocks. For a
query, a bound is the sum over terms of the larger of the query's weight times either. Blocks are
taken in descending order of their bounds and scored whole, until the next bound is below the query's
k-th best score. A bound equal to it is still scored, since ties go to the smaller id.

Every shelf is built once, as one row. Queries are packed into rows of about GROUP of one cluster, too.
A group first searches a shelf of its own cluster, which gives each query a k-th score to beat. Then
the bounds of all shelves, in chunks of CHUNK, are held against each group, and a group meets only
the shelves whose bound one of its queries may still be beaten by, with the scores to beat at hand.
Each yields at most k rows a query, of which the best k are kept. No side is broadcast, and vectors
travel again only to the groups that their shelf's bound admits.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors
of another length than the query's have no inner product with it, and are no candidates of it;
repeated ids, and rows without an id, are candidates of their own (those without one come last among
equal scores), and queries that share an id share the k places (a query's own id is never its
candidate); fewer than k candidates are all returned; ranks start at 1. An empty table gives an empty
result; other columns are not read. Empty vectors all score 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows, ship

BLOCK = 128
#: Vectors that a shelf holds, queries that a group holds, and shelves that a chunk of bounds holds, on average.
SHELF, GROUP, CHUNK = 4_096, 1_024, 1_024
#: Vectors that centroids are fitted on, at most, and centroids.
SAMPLE, CENTROIDS = 20_000, 64
#: Stands for a missing id, and comes after all others.
NO_ID = (1 << 63) - 1
_KEY = "d int, cluster int, part bigint"


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as a double; null if any is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint")))


def bound(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and range, what no inner product with the range's vectors exceeds."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search(queries: np.ndarray, q_ids: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Each query's k best that may be among its k best with scores of ``least`` or more, and the blocks scored."""
    cuts = range(0, len(ids), BLOCK)
    high = np.stack([vectors[c : c + BLOCK].max(axis=0) for c in cuts])
    low = np.stack([vectors[c : c + BLOCK].min(axis=0) for c in cuts])
    bounds = bound(queries, high, low)
    for i, q in enumerate(queries):
        best_s, best_i, scored = np.zeros(0), np.zeros(0, np.int64), 0
        for b in np.argsort(-bounds[i], kind="stable"):
            if bounds[i, b] < least[i] or len(best_s) >= k and bounds[i, b] < best_s[k - 1]:
                break
            rows, scored = slice(b * BLOCK, b * BLOCK + BLOCK), scored + 1
            # A query without an id has no row of its own to leave out by it.
            other = (ids[rows] != q_ids[i]) | (q_ids[i] == NO_ID)
            s = np.concatenate([best_s, (vectors[rows] @ q)[other]])
            n = np.concatenate([best_i, ids[rows][other]])
            top = np.lexsort((n, -s))[:k]
            best_s, best_i = s[top], n[top]
        yield i, best_i, best_s, scored


def centroids(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centroids of the vectors of each length in a sample of at most SAMPLE, by a few rounds of k-means."""
    got = rows.select("id", "v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r["id"], r["v"])):
        by.setdefault(len(r["v"]), []).append(r["v"])
    out, rng = {}, np.random.default_rng(3)
    for d, vs in by.items():
        x = np.array(vs, np.float64).reshape(len(vs), d)
        c = x[rng.choice(len(x), min(CENTROIDS, max(1, len(x) // BLOCK)), replace=False)]
        for _ in range(8):
            near = _nearest(x, c)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        out[d] = c
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def _clustered(rows: DataFrame, fitted: dict[int, np.ndarray]) -> DataFrame:
    """Rows with their cluster among the vectors of their length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = batch.column("v").to_pylist()
            out = np.zeros(len(vs), np.int32)
            for d in {len(v) for v in vs} & set(fitted):
                at = [i for i, v in enumerate(vs) if len(v) == d]
                out[at] = _nearest(np.array([vs[i] for i in at], np.float64).reshape(len(at), d), fitted[d])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "q", "v")), pa.array([len(v) for v in vs], pa.int32()), pa.array(out)], ["id", "q", "v", "d", "cluster"])

    return map_rows(rows.select("id", "q", "v"), run, "id bigint, q boolean, v array<bigint>, d int, cluster int")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Vectors of one length and cluster in rows of about ``size``: ids and vectors as bytes, ranges of each term."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        v = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), int(key[0]))
        return pd.DataFrame({"d": [key[0]], "cluster": [key[1]], "part": [key[2]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "v": [v.tobytes()], "high": [v.max(axis=0).tobytes()], "low": [v.min(axis=0).tobytes()]})

    count = rows.groupBy("d", "cluster").agg(F.count("*").alias("n"))
    rows = rows.join(count, ["d", "cluster"])
    # Spread by row, so that rows of one id, or equal ones, do not meet in one shelf.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.round(F.col("n") / size).cast("bigint"))))
    return rows.groupBy("d", "cluster", "part").applyInPandas(pack, f"{_KEY}, ids binary, v binary, high binary, low binary")


def _read(cell: pa.Scalar, d: int, kind: type = np.int64) -> np.ndarray:
    flat = np.frombuffer(cell.as_buffer(), kind)
    return flat.reshape(-1, d).astype(np.float64) if d >= 0 else flat


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Of groups (q_ids, qv, least) and shelves (ids, v) beside each other, each query's k best in the shelf."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(len(batch)):
                d = batch.column("d")[j].as_py()
                q_ids, ids = _read(batch.column("q_ids")[j], -1), _read(batch.column("ids")[j], -1)
                shape = lambda c, n: _read(batch.column(c)[j], d).reshape(n, d) if d else np.zeros((n, 0))  # noqa: B023, E731
                least = _read(batch.column("least")[j], -1, np.float64)
                n, s, c = [], [], []
                for i, best_i, best_s, _ in search(shape("qv", len(q_ids)), q_ids, least, ids, shape("v", len(ids)), k):
                    n.append(np.full(len(best_i), q_ids[i]))
                    s.append(best_s.astype(np.int64))
                    c.append(best_i)
                flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([flat(n), flat(c), flat(s)], ["query_id", "vec_id", "score"])

    return map_rows(pairs.select("d", "q_ids", "qv", "least", "ids", "v"), run, "query_id bigint, vec_id bigint, score bigint")


def _thresholds(pairs: DataFrame, k: int) -> DataFrame:
    """Groups with ``least``: each query's k-th score in the shelf beside it, minus infinity without one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for j in range(len(batch)):
                d, q_ids = batch.column("d")[j].as_py(), _read(batch.column("q_ids")[j], -1)
                ids = _read(batch.column("ids")[j], -1)
                shape = lambda c, n: _read(batch.column(c)[j], d).reshape(n, d) if d else np.zeros((n, 0))  # noqa: B023, E731
                least = np.full(len(q_ids), -np.inf)
                for i, _, s, _ in search(shape("qv", len(q_ids)), q_ids, least.copy(), ids, shape("v", len(ids)), k):
                    if len(s) >= k:
                        least[i] = s[k - 1]
                out.append(least.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "cluster", "part", "q_ids", "qv")), pa.array(out, pa.binary())], ["d", "cluster", "part", "q_ids", "qv", "least"])

    return map_rows(pairs.select("d", "cluster", "part", "q_ids", "qv", "ids", "v"), run, f"{_KEY}, q_ids binary, qv binary, least binary")


def _admitted(groups: DataFrame, shelves: DataFrame) -> DataFrame:
    """(d, cluster, part) of groups and (s_cluster, s_part) of the shelves that they must meet."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda c: b"".join(pdf[c])
        return pd.DataFrame({"d": [key[0]], "chunk": [key[1]], "clusters": [pdf["cluster"].to_numpy(np.int64).tobytes()], "parts": [pdf["part"].to_numpy(np.int64).tobytes()], "high": [join("high")], "low": [join("low")]})

    count = shelves.groupBy("d").agg(F.ceil(F.count("*") / CHUNK).cast("bigint").alias("chunks"))
    bounds = shelves.select("d", "cluster", "part", "high", "low").join(count, "d").withColumn("chunk", F.pmod(F.xxhash64("cluster", "part"), "chunks"))
    chunks = bounds.groupBy("d", "chunk").applyInPandas(pack, "d int, chunk bigint, clusters binary, parts binary, high binary, low binary")
    asked = groups.join(count, "d").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(len(batch)):
                d, cluster, part = (batch.column(c)[j].as_py() for c in ("d", "cluster", "part"))
                clusters, parts = (_read(batch.column(c)[j], -1) for c in ("clusters", "parts"))
                least = _read(batch.column("least")[j], -1, np.float64)
                shape = lambda c, n: _read(batch.column(c)[j], d).reshape(n, d) if d else np.zeros((n, 0))  # noqa: B023, E731
                meets = (bound(shape("qv", len(least)), shape("high", len(parts)), shape("low", len(parts))) >= least[:, None]).any(axis=0)
                n = int(meets.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, cluster, np.int32)), pa.array(np.full(n, part, np.int64)), pa.array(clusters[meets].astype(np.int32)), pa.array(parts[meets])], ["d", "cluster", "part", "s_cluster", "s_part"])

    both = asked.join(chunks, ["d", "chunk"]).select("d", "cluster", "part", "qv", "least", "clusters", "parts", "high", "low")
    return map_rows(both, run, f"{_KEY}, s_cluster int, s_part bigint")


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of each query's k best among all other vectors.

    Components are kept as integers and multiplied as doubles, in which sums below 2**53 are exact.
    """
    ship(df.sparkSession)
    rows = df.select(F.coalesce(df[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), scaled(df[vector_col]).alias("v")).where("v is not null")
    # Numbers of rows that are stored do not change when a task runs again.
    rows = cut(_clustered(rows, centroids(rows))).withColumn("row", F.monotonically_increasing_id())
    shelves = cut(_packed(rows, SHELF))
    groups = _packed(rows.where("q").select("id", "v", "q", "d", "cluster").distinct().withColumn("row", F.xxhash64("id", "v")), GROUP).withColumnsRenamed({"ids": "q_ids", "v": "qv"}).drop("high", "low")
    # A query is a candidate as well, so every group's cluster has shelves.
    shelf_count = shelves.groupBy("d", "cluster").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("part")).alias("parts"))
    home = groups.join(shelf_count, ["d", "cluster"]).withColumn("s_part", F.col("parts")[F.pmod("part", "n").cast("int")])
    own = home.alias("g").join(shelves.alias("s"), (F.col("g.d") == F.col("s.d")) & (F.col("g.cluster") == F.col("s.cluster")) & (F.col("s_part") == F.col("s.part")))
    groups = cut(_thresholds(own.select("g.d", "g.cluster", "g.part", "q_ids", "qv", "s.ids", "s.v"), k))
    pairs = _admitted(groups, shelves).join(groups, ["d", "cluster", "part"]).select("d", F.col("s_cluster").alias("cluster"), F.col("s_part").alias("part"), "q_ids", "qv", "least")
    found = _searched(pairs.join(shelves.select("d", "cluster", "part", "ids", "v"), ["d", "cluster", "part"]), k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return ranked.select(named("query_id").alias("query_id"), "rank", named("vec_id").alias(id_col), "score")
