"""Each operator against a brute-force version, on small and awkward rows."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.llm import bpe, chat, html, langid, lz, mixing, parity_join, pii, registry, topk, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, odds double"
HARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\u000b ", None, "a"), (4, "12345 !!", "en", None),
    (5, "one two", "en", "b"), (5, "one two", "en", "b"), (6, "ONE two\u00a0three \U0001f600 \u00e9", "fr", "b"),
    (7, "word " * 6000 + "end", "de", "hot"), (8, "word " * 6000 + "end.", "de", "hot"), (None, "no id at all", "en", "hot"),
    (9, "x" * 40_000, "en", "c"), (10, "a@b.co 10.0.0.1 4111 1111 1111 1111 +1 (743) 555-3824", "en", "c"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, l, s, len(t) if t else None, "clash", 0.5) for i, t, l, s in HARD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


# --- URL filters ---------------------------------------------------------------------------------

URLS = ["http://www.Example.ORG/es/1?x=1", "https://a.org", "https://b.org/x#y", "http://m.spam-farm.example.net/en/1", "https://freebets.example.net", "http://x.example.com/fr/2", "http://x.example.com/de/2", "http://example.org/en/12", "http://therh.example.net/en/7?page=2&ref=x", None, "", "nourl", "http://casinowin.net/a/b", "http://example.net/some/article.html", "x://"]


def test_urls(spark, empty):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id int, url string, host string, row string")
    got = {r["page_id"]: r for r in rows(urls.judge_urls(df, registry.RULES))}
    assert len(got) == len(URLS) and all(r["row"] == "r" and r["url"] == URLS[i] for i, r in got.items())
    expect = {0: ("www.example.org", "/es/1", "example.org/es/", "block"), 1: ("a.org", "", None, "allow"), 2: ("b.org", "/x", "org/", "allow"), 5: ("x.example.com", "/fr/2", "com/fr/", "allow"), 6: ("x.example.com", "/de/2", "com/de/", "block"), 7: ("example.org", "/en/12", "example.org/en/1", "block")}
    for i, e in expect.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == e
    for i in (9, 10, 11, 14):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == ("", "", None, "allow")
    assert urls.judge_urls(empty.withColumn("url", F.col("text"))).count() == 0
    assert urls.judge_urls(df.union(df)).count() == 2 * len(URLS)


def splits(token):
    """All ways to cut a token into parts."""
    yield [token]
    for k in range(1, len(token)):
        for rest in splits(token[k:]):
            yield [token[:k], *rest]


def test_segments_and_odds(spark):
    texts = spark.createDataFrame([("free books bookstore and bets, freebooks? the middle Theatre",), (None,), ("books books men menu women the",)], "text string")
    counts = urls.unigrams(texts)
    n = {r["word"]: r["n"] for r in rows(counts)}
    assert n["books"] == 3 and n["the"] == 2 and n["theatre"] == 1
    judge = urls.Judge()
    total = sum(n.values())
    known = {w: max(n.get(w, 0), urls.SEEDED * total / 1e6) if w in judge.odds else n[w] for w in {*n, *judge.odds} if len(w) >= urls.LEAST}
    tokens = ["freebooks", "freebetscasino", "essex", "netflix", "womenmenu", "thebooksbooks", "middletheatre", "casinocasinopoker", "megacasino", "zcasinoz"]
    long = "x" * 400 + "casino"
    got = {r["token"]: r for r in rows(urls.split_tokens(spark.createDataFrame([(t,) for t in [*tokens, long]], "token string"), counts))}
    cost = lambda w: sum(-np.log(known[p] / total) + 1e-9 if p in known else np.log(total / 10) + len(p) * np.log(10) for p in w)
    for t in tokens:
        if t in got:
            assert cost(got[t]["words"]) == pytest.approx(min(map(cost, splits(t)))) and "".join(got[t]["words"]) == t
            assert got[t]["odds"] == pytest.approx(sum(judge.odds.get(w, 0.0) for w in got[t]["words"]))
        else:
            assert not any(p in known for w in splits(t) for p in w)
    assert got["freebetscasino"]["words"] == ["free", "bets", "casino"] and got[long]["words"] == ["x" * 400, "casino"]
    b, a = (collections.Counter(" ".join(x).split()) for x in (judge.block, judge.allow))
    every = len({*b, *a})
    for w in ("casino", "library"):
        assert judge.odds[w] == pytest.approx(np.log((b[w] + 0.1) / (b.total() + 0.1 * every)) - np.log((a[w] + 0.1) / (a.total() + 0.1 * every)))


def test_urls_of_any_length(spark):
    """A quarter of a megabyte of random letters, which has no known word but the one that ends it."""
    rng = random.Random(1)
    letters = "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=250_000))
    df = spark.createDataFrame([("http://a.net/" + letters + "casino",), ("http://" + letters[:60_000],), ("http://casino.net/",)], "url string")
    counts = spark.createDataFrame([(w, 50) for w in ("the", "free", "mega", "casino")] + [(f"w{i}", 1000) for i in range(1000)], "word string, n bigint")
    got = rows(urls.judge_urls(df, (), counts))
    assert sorted((len(r["url"]), r["verdict"]) for r in got) == [(18, "block"), (60_007, "allow"), (250_019, "block")]


def test_judge_learns_from_what_the_rules_decide(spark):
    """Words that only blocked urls of the rules have speak against other urls, and the verdicts of whole urls are those of a plain judge."""
    rules = (urls.Rule("block", "bad.org/"), urls.Rule("allow", "good.org/"))
    bad, good, rest = ["zorgle", "plimsy", "common"], ["wimble", "fennel", "common"], ["zorgle", "wimble", "plimsywimble", "casino", "library", "zorglezorgle", "common", "unseen"]
    rng = random.Random(3)
    seen = [f"http://{rng.choice('abc')}.bad.org/{rng.choice(bad)}/{rng.choice(bad)}?q" for _ in range(60)] + [f"https://good.org/{rng.choice(good)}-{rng.choice(good)}" for _ in range(80)]
    asked = [f"http://{a}.example.net/{b}" for a in rest for b in rest]
    df = spark.createDataFrame([(u,) for u in seen + asked], "url string")
    counts = spark.createDataFrame([(w, 500) for w in ("zorgle", "plimsy", "wimble", "fennel", "common", "unseen")], "word string, n bigint")
    judge = urls.learn(df, rules, counts)
    n = [collections.Counter(), collections.Counter()]
    for u in set(x.partition("?")[0].partition("://")[2] for x in seen):
        for t in re.findall("[a-z]+", u):
            if len(t) >= 3 and t not in ("bad", "good", "org"):
                n["good.org" in u][t] += 1
    assert {w: (b, a) for w, b, a in judge.learned} == {w: (n[0][w], n[1][w]) for w in {*n[0], *n[1]}}
    assert judge.odds["zorgle"] > 1 > -1 > judge.odds["wimble"]
    known = {"zorgle", "plimsy", "wimble", "fennel", "common", "unseen", *judge.odds}
    best = lambda t: [t] if t in judge.odds else next(([t[:k], t[k:]] for k in range(3, len(t) - 2) if t[:k] in known and t[k:] in known), [t])
    plain = lambda u: judge.start + sum(judge.odds.get(w, 0.0) for t in re.findall("[a-z]+", u.partition("://")[2]) for w in best(t))
    got = {r["url"]: r for r in rows(urls.judge_urls(df, rules, counts, judge))}
    for u in asked:
        assert got[u]["odds"] == pytest.approx(plain(u)) and got[u]["verdict"] == ("block" if plain(u) > 0 else "allow"), u
    # Without a line of topic words the labelled urls are enough.
    bare = urls.learn(df, rules, counts, urls.Judge((), (), ()))
    assert bare.odds["zorgle"] > 1 > -1 > bare.odds["fennel"] and set(bare.odds) == {*bad, *good}
    assert urls.learn(df.limit(0), rules, counts).odds == urls.Judge().odds


def test_names_are_no_words(spark):
    hosts = {"linux.org.uk": "allow", "unix.example.net/kernel": "allow", "netflix.com": "allow", "matrix.org": "allow", "fedex.com": "allow", "essex.ac.uk": "allow", "cashmere.shop": "allow", "wincom.de": "allow", "universitylibrary.edu/casino": "allow", "online-poker.biz": "block", "freecasino.net/bonus": "block", "viagrapills.x": "block", "megacasino777.com": "block", "luckyroulette.com": "block", "replicawatches.com": "block", "sussex.ac.uk": "allow", "specialist.org": "allow", "alphabets.com": "allow", "grapefruit.net": "allow"}
    df = spark.createDataFrame([("http://" + h,) for h in hosts], "url string")
    counts = urls.unigrams(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {r["url"][7:]: r["verdict"] for r in rows(urls.judge_urls(df, (), counts))} == hosts


def test_urls_of_the_table(spark):
    got = rows(registry.op1_url_filter(spark, SF))
    pages = {p["page_id"]: p["url"] for p in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        host, path = re.match(r"^.*?://([^/?#]*)([^?#]*)", pages[r["page_id"]]).groups()
        fits = [x for x in registry.RULES if (host.lower() == x.host or host.lower().endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, best and best.text) and r["verdict"] in ("allow", "block")
        assert best is None or r["verdict"] == best.verdict


# --- Byte-level BPE ------------------------------------------------------------------------------


def tik():
    b = bpe.ByteBpe(registry.rank_file(), public_tokenizers.PATTERN)
    return b, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_bpe_pieces():
    own, ref = tik()
    assert own.self_encoding()
    rng = random.Random(3)
    tokens = [t for t in own.ranks if len(t) > 1]
    for _ in range(400):
        n = rng.choice([2, 3, 9, 40])
        piece = rng.choice([b"".join(rng.choice(tokens) for _ in range(n)), rng.choice(tokens) * n, bytes(rng.choices(b"aeinorst", k=8 * n))])
        assert [own.ranks[t] for t in own.encode_piece(piece)] == ref._encode_single_piece(piece)


def test_bpe_joins_whole_documents(monkeypatch):
    own, ref = tik()
    texts = [d["text"] for d in documents()]
    joined, plain = [0], own.product
    monkeypatch.setattr(own, "product", lambda a, b: (lambda out: (joined.__setitem__(0, joined[0] + 1), out)[1])(plain(a, b)))
    through = all_ = 0
    for t in texts:
        joined[0] = 0
        ids = own.encode(t)
        assert ids == np.array(ref.encode_ordinary(t), "<u4").tobytes() and own.decode(ids) == t.encode()
        all_ += len(ids)
        through += len(ids) * (joined[0] > 0)
    assert through > 0.8 * all_
    # Cuts everywhere: short parts, and texts made of what the pattern looks ahead for.
    monkeypatch.setattr(bpe, "PART", 8)
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "'", "l", "a", "B", "\u00e9", "\uff11", "12", "\u0301", "\U0001f600", "!", "...", "_", "\u4e2d", "'v", "e", " \n ", "\u3000"]
    for k in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) if k % 5 else rng.choice("ab 1!\n'") * rng.randrange(600)
        assert own.encode(t) == np.array(ref.encode_ordinary(t), "<u4").tobytes(), t


def test_bpe_documents(spark, hard, empty):
    own, ref = tik()
    ranks = registry.rank_file()
    got = rows(bpe.decode_documents(bpe.encode_documents(hard, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN))
    key = lambda r: (str(r[0]), r[1])
    expect = [(i, np.array(ref.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in HARD]
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got), key=key) == sorted(expect, key=key)
    assert bpe.encode_documents(empty, ranks, public_tokenizers.PATTERN).count() == 0
    once = rows(bpe.round_trip_documents(hard, ranks, public_tokenizers.PATTERN))
    assert sorted(map(repr, once)) == sorted(map(repr, got))
    assert bpe.round_trip_documents(empty, ranks, public_tokenizers.PATTERN).count() == 0
    texts = {d["doc_id"]: d["text"] for d in documents()}
    for r in rows(registry.op2_byte_bpe(spark, SF)):
        ids = np.array(ref.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, sha(ids), sha(texts[r["doc_id"]].encode()))


# --- Lempel-Ziv fingerprints ---------------------------------------------------------------------


def phrases(data):
    out, at = [], 0
    known = set()
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            out.append(end)
            at = end
    return out + [len(data)] * (at < len(data))


def test_lz(spark, hard, empty):
    for t in [d["text"] for d in documents()[:40]] + ["a" * 100, "é" * 9]:
        assert lz.parse(t.encode()) == phrases(t.encode())
        assert lz.signatures([t, t]) == lz.signatures([t]) * 2
    got = rows(lz.fingerprints(hard).select("doc_id", "text", "fingerprint"))
    assert len({r["fingerprint"] for r in got if not r["text"]}) == 1
    assert len(got) == len(HARD) and lz.fingerprints(empty).count() == 0
    assert lz.edited_by_next(empty, carry=["n_chars"]).count() == 0
    clash = hard.selectExpr("doc_id", "text", "1 AS at", "2 AS part", "3 AS seam", "4 AS p", "doc_id AS more")
    out = rows(lz.edited_by_next(clash, carry=["at", "part", "seam", "p", "more"]))
    assert len(out) == len(HARD) and all((r["at"], r["next_part"], r["seam"], r["p"], r["more"]) == (1, 2, 3, 4, r["doc_id"]) for r in out)


def test_signature_by_brute_force():
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    for text in ["", "a", "abababab", "one two one two", documents()[3]["text"][:700], "\u00e9\U0001f600"]:
        data, at, least = text.encode(), 0, [None] * lz.BINS
        for end in phrases(data):
            h = mix(sum(mix(b + 1) * pow(lz._BASE, i, 1 << 64) for i, b in enumerate(data[at:end])) & mask)
            k, low = h >> 58, h & ((1 << 58) - 1)
            least[k] = low if least[k] is None else min(least[k], low)
            at = end
        expect = "".join("ffff" if x is None else f"{mix(x) % 0xFFFF:04x}" for x in least)
        assert lz.signatures([text]) == [expect]


@pytest.mark.parametrize("size", [4_000, 30])
def test_lz_neighbours(spark, size, monkeypatch):
    monkeypatch.setattr(lz, "RANGE_ROWS", size)
    docs = sorted(documents(), key=lambda d: -d["doc_id"])
    sig = {d["doc_id"]: lz.signatures([d["text"]])[0] for d in docs}
    alike = lambda a, b: np.mean([a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4) if (a[i : i + 4], b[i : i + 4]) != ("ffff", "ffff")])
    got = {r["doc_id"]: r for r in rows(registry.op3_lz_fingerprint(spark, SF))}
    for a, b in zip(docs, docs[1:] + docs[:1]):
        h = len(a["text"]) // 2
        edited = a["text"][: len(a["text"]) - h] + b["text"][:h]
        r = got[a["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(a["text"]), sha(edited.encode()), sig[a["doc_id"]])
        assert r["near_next"] == pytest.approx(alike(sig[a["doc_id"]], sig[b["doc_id"]]))
        assert r["near_edited"] == pytest.approx(alike(sig[a["doc_id"]], lz.signatures([edited])[0]))


def test_lz_hot_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lz, "RANGE_ROWS", 30)
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} {'x' * (i % 50)}") for i in range(400)] + [(None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    made = lz.edited_by_next(df, carry=["text"])
    got = rows(made)
    # Rows of one id stand in the order of some hash: walk the ring of rows as it came out, and check that order too.
    tie = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    ring = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), tie[d[1]]))
    expect = []
    for a, b in zip(ring, ring[1:] + ring[:1]):
        t, u = a[1] or "", b[1] or ""
        expect.append((a[0], a[1], t[: len(t) - len(t) // 2] + u[: len(t) // 2], b[1]))
    assert sorted(map(repr, expect)) == sorted(repr((r["doc_id"], r["text"], r["edited"], r["next_text"])) for r in got)
    sizes = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 3 and max(sizes) < 130


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-3, 3)), max_size=12), st.lists(st.tuples(st.integers(-1, 5), st.integers(-4, 4)), max_size=12))
@settings(deadline=None)
def test_places(edges, pairs):
    edges = sorted(set(edges))
    at, tie = np.array(pairs, np.int64).reshape(-1, 2).T
    assert lz.places(np.array(edges, np.int64).reshape(-1, 2), at, tie).tolist() == [sum(e <= p for e in edges) for p in pairs]


# --- Chat formatting -----------------------------------------------------------------------------


def test_chat_round_trip():
    t = chat.Template()
    for text in ["", "\\", "</turn>", "\\</turn>", "<\\/turn>", "<turn:user>\n", "<</turn>", "</turn", "\\### Assistant: </turn> ok", "a\\\\<turn:</turn>\n"]:
        for role in ("user", "assistant", "", "a>b", "</turn>\\"):
            whole = "".join(x for x, _ in t.segments(role, text) + t.segments("user", text))
            assert t.turns(whole) == [(role, text), ("user", text)]


def test_chat(spark, empty):
    said = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "</turn>"), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, None, "x"), (None, 0, "user", "y"), (4, 0, "user", "long " * 20_000)]
    df = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_turns(df)))}
    assert {k: (r["n_turns"], r["valid"]) for k, r in got.items()} == {1: (3, True), 2: (3, False), 3: (1, False), None: (1, True), 4: (1, True)}
    assert got[1]["turns_sha256"] == sha(b"system\ns\nuser\n\nassistant\n</turn>\n") and got[1]["loss_sha256"] == sha(b"</turn>") and got[1]["loss_chars"] == 7
    assert got[2]["loss_sha256"] == sha(b"bb")
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# --- Mixing --------------------------------------------------------------------------------------


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 45, 2) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.water_fill([0, 4], [1, 1], 6, 2) == [0, 6]


def test_shards_add_up():
    slots = np.array([5_000, 123, 0, 40_000])
    n = -(-slots.sum() // mixing.SHARD_SLOTS)
    per = [mixing.shard_counts(slots, n, i) for i in range(n)]
    assert (sum(c for c, _ in per) == slots).all() and all(c.sum() == mixing.SHARD_SLOTS for c, _ in per[:-1])
    assert all((per[i + 1][1] == per[i][0] + per[i][1]).all() for i in range(n - 1))
    # Draws are the same kind at every size: near the proportion, never beyond what there is.
    huge = np.array([3 * 10**12, 10**12, 5, 0], np.int64)
    left = mixing._left_share(tuple(huge.tolist()), 2 * 10**12, (0, 9))
    assert left.sum() == 2 * 10**12 and (left <= huge).all() and 0 < abs(int(left[0]) - 15 * 10**11) < 10**7
    small = np.array([mixing._left_share((6, 4), 5, (i, i + 1))[0] for i in range(2_000)])
    assert abs(small.mean() - 3) < 0.08 and abs(small.var() - 2 / 3) < 0.1 and small.min() >= 1
    for size in (1, 2, 7, 1_000):
        assert sorted(mixing.permuted(np.arange(size), size, 5)) == list(range(size))


def test_mix(spark, hard, empty):
    for sf in (SF, "/root/testdata/sf0.01"):
        got = rows(registry.op5_mix_sources(spark, sf))
        again = rows(registry.op5_mix_sources(spark, sf))
        assert sorted(map(str, got)) == sorted(map(str, again))
        by = collections.defaultdict(list)
        for d, r in zip(sorted(pq.read_table(f"{sf}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"]), sorted(got, key=lambda r: r["doc_id"])):
            assert r["size"] == len(re.findall(r"[^ \t-\r]+", d["text"])) and 0 <= r["taken"] <= 2 * r["size"]
            by[d["source"]].append(r)
        names = sorted(by)
        sizes = [sum(r["size"] for r in by[s]) for s in names]
        expect = mixing.water_fill(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
        for s, n, t in zip(names, sizes, expect):
            assert all(r["source_size"] == n and r["target"] == pytest.approx(t) for r in by[s])
            assert abs(sum(r["taken"] for r in by[s]) - t) <= max(3 * mixing.BLOCK_WORDS, 0.01 * t)


def test_mixed_documents(spark, hard, empty):
    m = mixing.mix(hard)
    out = rows(mixing.mixed_documents(hard, m))
    taken = sum(r["taken"] for r in rows(mixing.taken(m)))
    assert sum(len(re.findall(r"[^ \t-\r]+", r["text"])) for r in out) == taken
    assert set(out[0]) == set(hard.columns) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mix(empty).docs.count() == 0
    names = ["_id", "id", "source", "size", "tie", "place", "passes", "ranges", "row", "said", "first", "block", "from_word"]
    clash = hard.select("doc_id", "text", "n_chars", "source", *(F.lit(i).alias(c) for i, c in enumerate(names) if c != "source"))
    got = rows(mixing.mixed_documents(clash))
    assert len(got) == len(out) and all(r[c] == i for r in got for i, c in enumerate(names) if c != "source")
    lost = spark.createDataFrame([(None, f"text {i} " * 70, "s") for i in range(40)], "doc_id bigint, text string, source string")
    m = mixing.mix(lost)
    assert len({r["first"] for r in rows(m.docs)}) == 40
    blank = hard.where("doc_id in (2, 3)")
    assert mixing.mixed_documents(blank).count() == 0


# --- N-gram Jaccard join -------------------------------------------------------------------------


def linked(docs, join):
    sets, parent = [], {}
    lower = {i: i + 32 for i in range(65, 91)}
    for i, t in docs:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(lower))
        n = join.ngram
        sets.append((i, frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and min(len(a), len(b)) * join.den >= max(len(a), len(b)) * join.num and len(a & b) * join.den >= len(a | b) * join.num:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("join", [parity_join.Join(3, 90, 100), parity_join.Join(5, 80, 100), parity_join.Join(1, 50, 100)])
def test_join(spark, join):
    rng = random.Random(7)
    docs = [(d["doc_id"], d["text"]) for d in documents()]
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    for k in range(90):  # a group of near copies, most of them at different distances
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(900)}"
        docs.append((10_000 + k, " ".join(w)))
    docs += [(20_000, None), (20_001, ""), (20_002, " \t"), (20_003, "a b"), (20_004, "A  b"), (20_005, "a")]
    docs += [(20_010 + k, " ".join(f"v{j}" for j in range(k))) for k in range(1, 24)]
    got = sorted(tuple(r) for r in parity_join.groups(spark.createDataFrame(docs, "doc_id bigint, text string"), join).collect())
    assert got == linked(docs, join)


def test_join_awkward_rows(spark, hard, empty):
    got = [tuple(r) for r in parity_join.groups(hard, registry.SHINGLES).collect()]
    assert len(got) == len(HARD) and got.count((5, 1, 5)) == 2 and {g[2] for g in got if g[0] in (7, 8)} == {7, 8}
    assert (None, 2, None) in got and (1, 0, 1) in got
    assert parity_join.groups(empty, registry.SHINGLES).count() == 0


def test_join_rows_without_an_id(spark):
    word = lambda k, n=60: [f"{k}{j}" for j in range(n)]
    a, b, c = word("a"), word("b"), word("c")
    near = lambda w: " ".join([*w[:-1], "other"])
    docs = [(None, " ".join(a)), (5, near(a)), (None, " ".join(b)), (6, " ".join(c)), (6, near(b)), (7, near(c))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in rows(parity_join.groups(df, registry.SHINGLES)))
    assert got == {(None, 5): 1, (5, 5): 1, (None, 6): 1, (6, 6): 2, (7, 6): 1}


# --- Personal data -------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def spans_of(text):
    out = []
    for at, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), at, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_pii(spark, empty):
    rng = random.Random(2)
    texts = [d["text"] for d in documents()] + [t for _, t, *_ in HARD]
    texts += ["".join(rng.choice(["a", "@", ".", "1", "4111111111111111", "+1 555 123 4567", "10.0.0.256", "10.0.0.25", " ", "-", "é", "\U0001f600", "b@c.de", "+", "(", "7"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["1.2.3.4 " * 500, "a" * 50_000, "1" * 50_000, "1." * 20_000, "+" + " " * 20_000, "a@b.com_x@c.de", "0000001.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    for r in rows(pii.with_spans(df)):
        t = r["text"] or ""
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == spans_of(t), t[:200]
    assert pii.with_spans(empty).count() == 0 and pii.redact(empty).count() == 0


def test_pii_added_kinds_and_redaction(spark, hard):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "my ssn is 536-22-1234", "536-22-1234", "mail x@y.org, 4111-1111-1111-1111", None, "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: [s["kind"] for s in r["spans"] if not s["base"]] for r in rows(pii.with_spans(df))}
    assert got == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: [], 5: [], 6: []}
    red = {r["i"]: r["text"] for r in rows(pii.redact(df))}
    assert red == {0: "IBAN <IBAN> ok", 1: texts[1], 2: "my ssn is <SSN>", 3: texts[3], 4: "mail <EMAIL>, <CARD>", 5: None, 6: "nothing"}
    assert pii.redact(hard).columns == hard.columns and pii.redact(hard).where("spans = 'clash'").count() == len(HARD)


def test_pii_lists_behind_one_word(spark):
    ssn, iban = "536-22-1234", "DE89370400440532013000"
    texts = [f"SSN: {ssn}, 536-22-1235", f"SSN: 000-22-1234 {ssn}", f"IBAN {iban}; {iban}", f"SSN: {ssn}{' ' * 40}536-22-1235", f"SSN {ssn} {ssn} {ssn} {ssn} {ssn}", f"{ssn}, {ssn} SSN", "\U0001f600" * 50 + f" ssn \U0001f600{ssn} {ssn}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    red = {r["i"]: r["text"] for r in rows(pii.redact(df))}
    # The fifth number of a list stands more than 40 characters after the word.
    assert red == {0: "SSN: <SSN>, <SSN>", 1: "SSN: 000-22-1234 <SSN>", 2: "IBAN <IBAN>; <IBAN>", 3: f"SSN: <SSN>{' ' * 40}536-22-1235", 4: f"SSN <SSN> <SSN> <SSN> <SSN> {ssn}", 5: "<SSN>, <SSN> SSN", 6: "\U0001f600" * 50 + " ssn \U0001f600<SSN> <SSN>"}
    for r in rows(pii.with_spans(df)):
        added = [s for s in r["spans"] if not s["base"]]
        assert len(added) == red[r["i"]].count("<")
        for s in added:
            t = texts[r["i"]]
            near = (t[max(0, s["start"] - 40) : s["start"]] + "|" + t[s["end"] : s["end"] + 40]).lower()
            assert t[s["start"] : s["end"]][-4:].isdigit() and s["score"] == (0.7 if s["kind"] == "ssn" else 1.0 if "iban" in near else 0.7)


def added_spans(text):
    """Bank accounts and social security numbers with their scores, character by character."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        s = m[0].replace(" ", "")
        if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            out.append(("iban", m.start(), m.end(), 0.7, "iban|account|konto|compte|cuenta|bank", 0.3))
    for m in re.finditer(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])", text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            out.append(("ssn", m.start(), m.end(), 0.2, "ssn|social security|social-security|tax id", 0.5))
    scored = lambda a, b, base, words, bonus: base + bonus * any(re.search(words, x.lower()) for x in (text[max(0, a - 40) : a], text[b : b + 40]))
    made = [(k, a, b, round(scored(a, b, *rest), 6)) for k, a, b, *rest in out]
    return sorted((x for x in made if x[3] >= 0.5), key=lambda x: (x[1], x[0]))


def test_pii_added_spans_by_brute_force(spark):
    rng = random.Random(12)

    def iban():
        body = "".join(rng.choices("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=rng.randint(11, 24)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97 + (rng.random() < 0.2)
        s = f"DE{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    part = lambda: rng.choice([iban, lambda: f"{rng.choice([0, 78, 536, 666, 899, 900]):03d}-{rng.choice([0, 22]):02d}-{rng.choice([0, 1234]):04d}", lambda: rng.choice(["SSN", "ssn:", "my Social Security no", "IBAN", "bank", "Konto", "-", "x", ".", "😀", "word " * rng.randint(1, 12)])])()
    texts = [rng.choice([" ", ", ", "\n"]).join(part() for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["536-22-1234 " * 300 + "ssn", "ssn" + " 536-22-1234" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    got = {r["i"]: [(s["kind"], s["start"], s["end"], round(s["score"], 6)) for s in r["spans"] if not s["base"]] for r in rows(pii.with_spans(df))}
    for i, t in enumerate(texts):
        assert got[i] == added_spans(t), t[:300]
    assert sum(map(len, got.values())) > 400


def test_pii_columns_of_any_name(spark):
    names = ["_text", "_hits", "_parts", "_tails", "_heads", "_starts", "_row", "_", "_email", "at", "spans", "a.b"]
    df = spark.createDataFrame([("mail x@y.org", *map(str, range(12)))] * 2 + [(None, *[None] * 12)], "text string, " + ", ".join(f"`{n}` string" for n in names))
    red = pii.redact(df)
    assert red.columns == df.columns and sorted(map(str, red.collect())) == sorted(map(str, (r if r["text"] is None else type(r)(**{**r.asDict(), "text": "mail <EMAIL>"}) for r in df.collect())))
    found = pii.with_spans(df)
    assert found.columns == [c for c in df.columns if c != "spans"] + ["spans"] and [len(r["spans"]) for r in found.collect()] == [1, 1, 0]
    assert {tuple(r[n] for n in names if n != "spans") for r in found.where("text is not null").collect()} == {tuple(str(i) for i, n in enumerate(names) if n != "spans")}


# --- HTML ----------------------------------------------------------------------------------------


def test_html():
    m = html.default_model()
    pages = html.drawn_pages(120, seed=77)
    labels = [(y, b.label) for p in pages for b, y in zip(p, m.decode(p))]
    assert np.mean([a == b for a, b in labels]) > 0.97
    page = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>One<b>two</b>\n three.<br><p>Four</article><section class='comments'><div class='comment'>Nice post.</div></section><aside>Related</aside><footer>&copy; me</footer><script>var x='</p>';</script>"
    assert html.main_text(page, m) == "A & B Onetwo three. Four"
    for awkward in (None, "", "<", "</p></div>", "<p", "&amp;", "\x00<p>x", "<article>" * 3_000):
        html.main_text(awkward, m)
    inside = lambda x: f"<article><p>It is a long enough text to stay in here. {x}It ends.</p></article>"
    for awkward in ('<i data-y="abc">', "<i data-y>", '<i data-y="0">', "<![foo[ x ]]>", "<!-->", "<!--->", "<!-- no -->", "<!foo>", "<?php no ?>", "</>"):
        assert html.main_text(inside(awkward), m) == "It is a long enough text to stay in here. It ends.", awkward
    assert html.main_text(inside("") + "<!-- no <p>no", m) == html.main_text(inside("") + "<p class='x", m) == "It is a long enough text to stay in here. It ends."


def test_html_adverts_and_menus_in_articles():
    m, long = html.default_model(), "It is a paragraph that is long enough to belong to the text of the page, and it ends here."
    for name in ("advert", "ad", "ads", "sponsored", "promo"):
        assert html.main_text(f"<body><article><h1>On birds</h1><p>{long}</p><div class='{name}'>Buy our boots now.</div><p>{long}</p></article></body>", m) == f"On birds {long} {long}", name
    menu = "<table><tr><td><a href=/a>Home</a></td><td><a href=/b>News</a></td><td><a href=/c>About us</a></td></tr></table>"
    assert html.main_text(f"<body>{menu}<article><h1>On birds</h1><p>{long}</p><table><tr><td>Wren</td><td>9 g</td></tr></table></article></body>", m) == f"On birds {long} Wren 9 g"


def test_html_of_any_size():
    m, began, n = html.default_model(), time.perf_counter(), 60_000
    for page in ("<b>" * n + "</i>" * n, "<a " * n, "".join(f"<div class=c{i}>t" for i in range(n)), "<div>" * n + "x" + "</div>" * n, "<svg>" * n + "</p>" * n, "<!--" * n, "</" * n, "<" * n, "<p>word " * n):
        html.main_text(page, m)
    assert time.perf_counter() - began < 120
    page = "<p>A sentence of a page, with some words in it.</p>" * 100_000
    assert len(html.leaf_blocks(page, m)) == 100_000


def test_field_by_brute_force():
    """Viterbi against all labellings, and the gradient step against a numeric one."""
    import itertools

    m, rng = html.default_model(), np.random.default_rng(8)
    for page in html.drawn_pages(30, seed=9):
        blocks = page[:9]
        s = m.scores(blocks)
        worth = lambda ys: sum(v for v, y in zip(s, ys) if y) + sum(m.moves[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        assert worth(m.decode(blocks)) == pytest.approx(max(map(worth, itertools.product((0, 1), repeat=len(blocks)))))
    page = [html.Block("t", tuple(f"f{k}" for k in range(4) if rng.random() < 0.6), int(rng.integers(2))) for _ in range(5)]
    fitted = html.train([page], epochs=1, rate=1e-4, decay=0.0)

    def loss(w, moves):
        total = lambda ys: sum(w.get(f, 0.0) for b, y in zip(page, ys) if y for f in b.features) + sum(moves[a, b] for a, b in zip(ys, ys[1:]))
        every = [total(ys) for ys in itertools.product((0, 1), repeat=len(page))]
        return total([b.label for b in page]) - np.log(np.exp(every).sum())

    base, zero = loss({}, np.zeros((2, 2))), np.zeros((2, 2))
    for f in {f for b in page for f in b.features}:
        assert fitted.weights.get(f, 0.0) / 1e-4 == pytest.approx((loss({f: 1e-5}, zero) - base) / 1e-5, abs=1e-3)


def test_html_left_out_ends():
    text = lambda page: " ".join(b.text for b in html.leaf_blocks(page))
    body = "<article><p>Hello.</p></article></body></html>"
    for head in ("<title>t</title>", "<title>t</title><meta name=a><script>x</script><style>y</style><noscript><img src=z></noscript>", "<title>t", "<noscript>", "<template><p>no</p></template>"):
        assert text(f"<html><head>{head}<body>{body}") == "Hello." == text(f"<html><head>{head}</head><body>{body}"), head
    assert text(f"<html><head><title>t</title>{body}") == "Hello." == text("<head><title>t</title> Hello.") == text("<head><title>t</title><span>Hello.</span>")
    assert text("<html><head><title>t</title><div/>Hello.") == "Hello."
    for tag in ("noscript", "iframe", "object", "svg", "canvas", "textarea", "template"):
        assert text(f"<body><div><{tag}>no{body}") == "Hello.", tag
        assert text(f"<body><p>One<{tag}>no<p>Two</p><{tag}>no</{tag}>{body}") == "One Two Hello.", tag
        assert text(f"<body><div><{tag}>no</div>{body}") == "Hello.", tag
        assert text(f"<body><{tag}><p>no</p><div>no</div></{tag}>{body}") == "Hello.", tag
    assert html.main_text("<html><head><title>t</title><body><article><p>Hello.</p></article></body></html>", html.default_model()) == "Hello."


def test_html_of_the_table(spark, empty):
    pages = {p["page_id"]: p["html"] for p in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    import html as h

    for r in rows(registry.op8_html_text(spark, SF)):
        x = pages[r["page_id"]]
        x = x[x.find("<article>") : x.find("</article>") if "</article>" in x else len(x)]
        x = re.sub("</?b>", "", x)
        expect = " ".join(h.unescape(re.sub("<[^>]*>", " ", x)).split())
        assert " ".join(r["text"].split()) == expect and r["n_chars"] == len(r["text"])
    assert html.extract(empty.withColumn("html", F.col("text"))).count() == 0


# --- Exact top-k ---------------------------------------------------------------------------------


@pytest.mark.parametrize("shelf,group", [(16_384, 512), (60, 3)])
def test_top_k(spark, shelf, group, monkeypatch):
    monkeypatch.setattr(topk, "SHELF", shelf)
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(4)
    vecs = [[float(z) for z in rng.normal(0, 0.1, 8)] for _ in range(600)]
    vecs[100:160] = [vecs[100]] * 60
    data = [(i, v, 1.0) for i, v in enumerate(vecs)] + [(700, None, 1.0), (750, [None] * 8, 1.0), (800, [float("nan")] * 8, 0.0), (850, [float("inf")] * 8, 0.0), (900, [1.0], 0.0)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, score double")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    x = np.floor(256 * np.array([np.float32(v) for v in vecs], np.float64)).astype(int)
    expect = []
    for q in range(0, 600, 50):
        s = x @ x[q]
        best = sorted((-s[i], i) for i in range(600) if i != q)[:5]
        expect += [(q, r + 1, i, -n) for r, (n, i) in enumerate(best)]
    assert got == sorted(expect)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2


def test_top_k_prunes():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 60, (20, 16))
    x = np.floor(centres[rng.integers(0, 20, 6_000)] + rng.normal(0, 12, (6_000, 16)))
    near = topk._nearest(x, centres)
    order = np.lexsort((np.arange(len(x)), near))
    asked = np.arange(0, len(x), 50)
    found = list(topk.search(x[asked], asked, np.full(len(asked), -np.inf), order, x[order], 5))
    assert sum(n for *_, n in found) < 0.5 * len(asked) * -(-len(x) // topk.BLOCK)
    for i, ids, scores, _ in found:
        s = x @ x[asked[i]]
        assert [(-v, j) for v, j in zip(scores, ids)] == sorted((-v, j) for j, v in enumerate(s) if j != asked[i])[:5]


def test_top_k_of_awkward_rows(spark):
    data = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (0, [2.0, 1.0]), (50, [1.0]), (3, [2.0]), (4, []), (100, [])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 2 * 65_536), (0, 2, None, 2 * 65_536), (0, 3, 1, 65_536), (50, 1, 3, 2 * 65_536), (100, 1, 4, 0)]


def test_top_k_spreads_equal_rows(spark, monkeypatch):
    """Half of all rows are one repeated row: no shelf grows with it, and results are those of all pairs."""
    monkeypatch.setattr(topk, "SHELF", 128)
    rng = np.random.default_rng(6)
    vecs = [[float(z) for z in rng.normal(0, 0.2, 4)] for _ in range(1500)]
    data = [(i, v) for i, v in enumerate(vecs)] + [(7, vecs[7])] * 1500
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(6)
    sizes, real = [], topk._packed

    def packed(rows_, size):
        out = real(rows_, size)
        sizes.append([len(r["ids"]) // 8 for r in out.select("ids").collect()])
        return out

    monkeypatch.setattr(topk, "_packed", packed)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert sum(sizes[0]) == 3000 and max(sizes[0]) < 2 * 128
    x = np.floor(256 * np.array([v for _, v in data])).astype(int)
    expect = []
    for q in range(0, 1500, 50):
        best = sorted((-int(n), i) for n, (i, _) in zip(x @ x[q], data) if i != q)[:5]
        expect += [(q, r + 1, i, -n) for r, (n, i) in enumerate(best)]
    assert got == sorted(expect)


def test_top_k_prunes_by_fitted_centroids(spark, monkeypatch):
    """On vectors in clusters, through the whole operator, most groups never meet most shelves."""
    monkeypatch.setattr(topk, "SHELF", 64)
    monkeypatch.setattr(topk, "GROUP", 8)
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 6_000)] + rng.normal(0, 0.05, (6_000, 16))
    met, real = [], topk._admitted

    def admitted(groups, shelves):
        out = real(groups, shelves)
        met.append((out.count(), groups.count() * shelves.count()))
        return out

    monkeypatch.setattr(topk, "_admitted", admitted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert met[0][0] < 0.3 * met[0][1]
    w = np.floor(256 * x).astype(int)
    for q in range(0, 6_000, 50):
        best = sorted((-int(n), i) for i, n in enumerate(w @ w[q]) if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -n) for n, i in best]


# --- Language ------------------------------------------------------------------------------------


def test_language(spark, hard, empty):
    got = rows(registry.op10_language(spark, "/root/testdata/sf0.01"))
    lang = {d["doc_id"]: d["lang"] for d in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.98
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    # The network by its definition: filters over each window, their largest values, softmax.
    text = documents()[0]["text"][:600]
    raw, total = text.encode(), np.zeros(len(model.classes))
    for a in range(0, len(raw), langid.WINDOW):
        piece = raw[a : a + langid.WINDOW]
        w = np.frombuffer(piece + bytes(langid.WINDOW - len(piece)), np.uint8)
        span = range(langid.WINDOW - max(langid.WIDTHS) + 1)
        best = np.concatenate([np.max([sum(t[j][w[i + j]] for j in range(len(t))) for i in span], axis=0) for t in model.tables])
        z = np.maximum(best + model.bias, 0) @ model.dense + model.offset
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(piece)
    one = langid.Scorer(model).predict(pa.array([text]))
    assert one[0] == [model.classes[total.argmax()]] and one[1][0] == pytest.approx(total.max() / len(raw), abs=1e-4)
    out = rows(langid.identify(hard, model))
    assert len(out) == len(HARD) and {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 4)} == {"und"}
    assert {r["lang_pred"] for r in rows(langid.identify(hard, langid.fit(empty)))} == {"und"}
    assert langid.identify(empty, model).count() == 0


# --- Pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, hard, empty):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_ = {d["doc_id"]: d for d in documents()}
    kept = cp.language(spark, docs, SF)
    assert {r["doc_id"] for r in rows(kept)} == {i for i, d in all_.items() if re.search(r"[^\W\d_]", d["text"])}
    near = rows(cp.near_copies(spark, docs, SF))
    groups = linked([(i, d["text"]) for i, d in all_.items()], cp.NEAR)
    assert sorted(r["doc_id"] for r in near) == sorted(i for i, _, c in groups if i == c)
    out = rows(cp.run(spark, SF))
    assert out and all(r["round_trip"] for r in out) and set(cp.language(spark, hard, SF).columns) == set(cp.COLUMNS)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        stage(spark, hard, SF).count()


def test_near_copies_of_repeated_and_missing_ids(spark):
    import corpus_pipeline as cp

    texts = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "abcdefg"}
    near = {k: t + " more" for k, t in texts.items()}
    docs = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (None, near["b"]), (None, texts["c"]), (1, near["c"])]
    docs += [(2, texts["d"]), (2, texts["e"]), (2, near["a"]), (3, texts["f"]), (4, near["f"]), (4, texts["g"]), (4, texts["g"].upper())]
    docs += [(None, None), (None, ""), (None, " \t"), (9, ""), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in rows(cp.near_copies(spark, df, SF))]
    worded = [k for k in kept if (k[1] or "").strip()]
    b, g = [k for k in worded if k[1].startswith("b")], [k for k in worded if k[1].lower().startswith("g")]
    assert len(b) == 1 and b[0][0] is None and len(g) == 1 and g[0][0] == 4
    assert sorted(k for k in worded if k not in b + g) == [(1, near["c"]), (2, near["a"]), (2, texts["d"]), (2, texts["e"]), (3, texts["f"])]
    assert sorted(map(str, (k for k in kept if k not in worded))) == sorted(map(str, docs[-5:]))


def test_languages_are_as_many_as_the_sample_holds(spark):
    labelled = spark.range(1, 1_201).selectExpr("id AS doc_id", "concat('word', id % 600, ' ', id % 600) AS text", "concat('l', id % 600) AS lang", "'clash' AS share", "1 AS n")
    seen = {r["lang"] for r in labelled.where(~langid.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    model = langid.fit(labelled)
    assert len(seen) > 500 and set(model.classes) == seen
    assert {r["lang_pred"] for r in langid.identify(labelled, model).collect()} <= seen
    assert len(langid.fit(labelled, max_rows=40).classes) == 40
