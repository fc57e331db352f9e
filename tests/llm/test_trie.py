"""The conversation trie against one built turn by turn."""

import hashlib
import random
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from terracell.llm import registry, trie

SF = "/root/testdata/sf0.001"
ROWS = "conv_id bigint, turn int, role string, text string, pos int, bytes string, depth int, n int"


def brute(rows):
    """Rows of the contract from (conv_id, turn, role, text)."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    whole = {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}
    up, no, facts = {}, {(): 0}, {}
    nodes, kids = [()], {}
    path = {}
    for c, ts in whole.items():  # nodes get numbers, so that long conversations cost no long keys
        at = 0
        path[c] = [0]
        for t in ts:
            if (at, t) not in up:
                up[at, t] = len(nodes)
                nodes.append((at, t))
                kids.setdefault(at, []).append(up[at, t])
            at = up[at, t]
            path[c].append(at)
    if not own:
        return []
    members, ends, depth = {}, {}, {}
    for c, p in path.items():
        for d, v in enumerate(p):
            members.setdefault(v, []).append(c)
            depth[v] = d
        ends.setdefault(p[-1], []).append(c)
    leaves, saved = {}, {}
    for v in reversed(range(len(nodes))):
        below = kids.get(v, [])
        leaves[v] = sum(leaves[k] for k in below) if below else 1
        mine = (len(members[v]) - 1) * len(nodes[v][1][1].encode()) if v else 0
        saved[v] = mine + sum(saved[k] for k in below)
    out = []
    for v in range(len(nodes)):
        text = ",".join(map(str, sorted(ends.get(v, []))))
        out.append((min(members[v]), depth[v], min(members[nodes[v][0]]) if v else None, len(members[v]), len(kids.get(v, [])), leaves[v], saved[v], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def built(spark, rows):
    df = spark.createDataFrame([(*r, 1, "b", 2, 3) for r in rows], ROWS)
    return trie.prefix_trie(trie.rebuilt(trie.turns(df)))


def test_trie_of_the_table(spark):
    out = registry.op13_conversation_trie(spark, SF)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in out.dtypes if c != "ends_sha256"} == {"bigint"}
    table = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    assert got(out) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table])


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_trie_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    expect = con.execute(registry.oracle_sql()["op13_conversation_trie"])
    assert [d[0] for d in expect.description] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(registry.op13_conversation_trie(spark, sf)) == sorted(expect.fetchall(), key=str)


def awkward():
    """Shared beginnings, ties, repeats, nulls, absent bases, a conversation of a third of all rows, and equal ones."""
    rng, rows = random.Random(2), []
    for c in [*range(0, 60), *range(100, 112), 201, 203, 999, -3]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é中"]) * rng.randint(1, 2)))
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(3)]
    rows += [(400, None, "user", None), (400, None, None, "x"), (400, 1, "user", "y"), (400, 1, "user", "y"), (400, 1, "assistant", "z"), (None, 1, "user", "lost"), (None, None, None, None), (401, 7, None, None)]
    rows += [(c, t, "user", f"long {t % 7}") for c in (500, 505, 510) for t in range(130 + c % 3)]
    rows += [(515, t, "user", f"long {t % 7}") for t in range(600)] + [(520, t, "user", f"long {t % 7}" if t < 300 else "other") for t in range(420)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,shard", [(256, 512), (16, 8), (3, 5)])
def test_trie_of_awkward_rows(spark, monkeypatch, block, shard):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SHARD", shard)
    rows = awkward()
    assert got(built(spark, rows)) == brute(rows)


def test_empty_and_turnless(spark):
    assert built(spark, []).count() == 0 and built(spark, [(None, 1, "user", "x")]).count() == 0
    # A conversation whose turns all give way to those of one that is absent.
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "x"), (c, 1, "user", "y")]
    assert got(built(spark, rows)) == brute(rows) and brute(rows)[0][3:5] == (1, 0)


def test_a_shard_takes_one_intersection_a_node():
    """Postings of one shard, by hand: two share a first turn, and one ends there."""
    blocks = [(7, 0, 0, 0, [1], [1], [4], True), (3, 0, 0, 0, [1, 2], [1, 2], [4, 9], True), (5, 0, 0, 0, [8], [8], [1], True)]
    out = sorted(map(tuple, trie.shard_nodes(blocks, 256)))
    assert out == sorted([(0, 0, 0, None, None, 3, 3, 0, [], 3), (1, 1, 1, 0, 0, 2, 3, 4, [7], 2), (2, 3, 3, 1, 1, 1, 3, 9, [3], 2), (1, 8, 8, 0, 0, 1, 5, 1, [5], 3)], key=lambda r: (r[0], r[1]))
