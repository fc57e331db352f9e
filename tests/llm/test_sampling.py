"""Importance resampling and MinHash near-dedup against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from terracell.llm import minhash, parity_join, registry, resample

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, id string, n_words int, score double, rank int, node string, key string"
HARD = [
    (1, None), (2, ""), (3, " \t\n -- "), (4, "one"), (5, "one two"), (5, "one two"), (6, "ONE two three \U0001f600 étÉ x9"),
    (7, "word " * 6000 + "end"), (8, "word " * 6000 + "end."), (None, "no id at all " * 9), (None, "no id at all " * 9), (None, None),
    (9, "x" * 40_000), *((10, " ".join(f"w{i}" for i in range(40))) for _ in range(12)), (11, " ".join(f"w{i}" for i in range(41))), (12, "a b c d e"), (13, "a b c d e f"), (14, "a b c d"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 0.5, 1, "n", "k") for i, t in rows], DOCS)


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


# --- Importance resampling -----------------------------------------------------------------------


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, text in docs:
        words, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: 5 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_of_the_tables(spark):
    got = registry.op11_importance_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled([(d["doc_id"], d["text"]) for d in table("documents")], [b["text"] for b in table("benchmark")])


def test_resampling_of_awkward_rows(spark):
    docs = HARD * 3  # enough rows to draw among ties and repeats
    target = [None, "", "w1 w2 w3 word word end", "one two"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    df = frame(spark, docs)
    got = resample.drawn(resample.weighted(df, resample.learn(df, goal))).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, target)
    none = df.limit(0)
    assert resample.drawn(resample.weighted(none, resample.learn(none, goal.limit(0)))).count() == 0
    r = resample.Resampler(percent=50, least_words=2)
    won = resample.resample(df, goal, r)
    assert {"id", "n_words", "node", "key", "text"} <= set(won.columns) and won.count() == won.select("doc_id", "text").distinct().count()
    alone = [d for d in dict.fromkeys(docs) if len(features(d[1])[0]) >= 2]
    assert won.count() == len(alone) // 2 and sorted(x["rank"] for x in won.collect()) == list(range(1, len(alone) // 2 + 1))


def test_crcs_are_those_of_whole_features():
    words = resample.words_of("AÉ b-c_d 中文 9z".encode())
    assert words == ["aÉ".encode(), b"b", b"c", b"d", "中文".encode(), b"9z"]
    whole = [zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1)]
    assert list(resample.feature_crcs(words, 4)) == whole and list(resample.feature_crcs([], 3)) == [] and len(list(resample.feature_crcs(words[:1], 3))) == 1


# --- MinHash near-dedup --------------------------------------------------------------------------


def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def grouped(docs, join):
    """Every pair of rows, and union-find."""
    sets = [grams(t, join.ngram) for _, t in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, j in {p for rows in where.values() for p in itertools.combinations(rows, 2)}:
        both = len(sets[i] & sets[j])
        if join.den * both >= join.num * (len(sets[i]) + len(sets[j]) - both):
            up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)), d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def deduped(df, join):
    got = minhash.deduplicated(df, join)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_dedup_of_the_table(spark):
    docs = [(d["doc_id"], d["text"]) for d in table("documents")]
    got = sorted((tuple(r) for r in registry.op12_minhash_dedup(spark, SF).collect()), key=str)
    assert got == grouped(docs, registry.NEAR_DEDUP)


def test_dedup_of_awkward_rows(spark):
    docs = [d for d in HARD if d[1] is None or d[0] is not None]
    assert deduped(frame(spark, docs), registry.NEAR_DEDUP) == grouped(docs, registry.NEAR_DEDUP)
    assert minhash.deduplicated(frame(spark, docs).limit(0)).count() == 0


def test_dedup_at_the_threshold(spark):
    """Copies with more and more words changed, so that many pairs are just within or just beyond the threshold."""
    rng, docs = random.Random(5), []
    for base in range(12):
        words = [f"b{base}w{i}" for i in range(rng.choice([9, 40, 120, 400]))]
        for k in range(25):
            new = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 14))):
                new[rng.randrange(len(new))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(new)))
    rng.shuffle(docs)
    join = minhash.NearDedup(passes=3)
    assert deduped(frame(spark, docs), join) == grouped(docs, join)


def test_signatures_within_the_distance_share_an_entry():
    join, rng = minhash.NearDedup(), np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, join.chunks * join.width).astype(np.uint64)
        b = a.copy()
        wrong = rng.choice(len(a), join.distance, replace=False)
        b[wrong] ^= np.uint64(1)
        assert set(join.entries(a)) & set(join.entries(b))
    s = np.unique(rng.integers(0, 1 << 63, 9000).astype(np.uint64))
    near = np.unique(np.concatenate([s[:8000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)]))
    j = len(np.intersect1d(s, near)) / len(np.union1d(s, near))
    assert (join.signature(s) == join.signature(near)).mean() == pytest.approx(j, abs=0.12)
    assert len(set(join.entries(join.signature(s)))) == join.chunks * join.width
    assert not len(join.keys(s[:3])) and len(join.keys(s[:4]))
    assert parity_join.Join().keys(s).size
