"""The conversation trie against plain dictionaries, over shards of many sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from leadtime.llm import conversation_trie as ct
from leadtime.llm import queries as q
from leadtime.llm.conversation_trie import TernaryTree, medians, prefix_trie, shared_heads, turn_sequences

SCHEMA = "conv_id bigint, turn bigint, role string, text string, keys int, seq string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def key(row):
    role, text = row[2] or "", row[3] or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def sequences(rows, heads=True):
    """The (role, text) turns of each conversation."""
    own = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            own[row[0]].append(row)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(found, key=lambda r: (r[1] is not None, r[1] or 0, key(r)))] for c, found in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + w[h[c] :] for c, w in own.items()} if heads else own


def nodes(seqs):
    members = defaultdict(list)
    for c, w in seqs.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        parts = [below[x] for x in children[p]]
        below[p] = (sum(x[0] for x in parts) or 1, sum(x[1] for x in parts) + own)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), *below[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def talk(seed, n=60):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]) if rng.random() < 0.9 else None, rng.choice(["é" * 3, "b", "", None, "long " * 20]), 1, "x", 2) for c in range(n) for t in range(rng.randrange(1, 9))]
    same = [(c, t, "user", f"turn {t}", 1, "x", 2) for c in range(n, n + 40) for t in range(12)]
    odd = [(7, None, "user", "null turn", 1, "x", 2), (7, None, "user", "null turn", 1, "x", 2), (8, 0, "bot", "tie", 1, "x", 2), (None, 1, "bot", "nobody", 1, "x", 2), (10**15 + 1, 5, "bot", "far", 1, "x", 2)]
    return rows + same + odd


@pytest.mark.parametrize("shard_turns,shard_paths", [(1 << 18, 1000), (200, 1000), (40, 6), (12, 4)])
def test_nodes_by_dictionaries(spark, shard_turns, shard_paths):
    rows = talk(shard_turns)
    for heads in (True, False):
        seqs = turn_sequences(spark.createDataFrame(rows, SCHEMA))
        found = prefix_trie(shared_heads(seqs) if heads else seqs, shard_turns=shard_turns, least_turns=10**9, shard_paths=shard_paths)
        assert rows_of(found) == nodes(sequences(rows, heads))


def test_ends_over_id_ranges(spark, monkeypatch):
    monkeypatch.setattr(ct, "ID_RANGE", 7)
    rows = [(c, t, "user", f"{t}", 1, "x", 2) for c in range(0, 500, 5) for t in range(3)]
    found = prefix_trie(turn_sequences(spark.createDataFrame(rows, SCHEMA)), shard_turns=2, least_turns=10**9, shard_paths=4)
    assert rows_of(found) == nodes(sequences(rows, heads=False))


def test_a_prefix_that_ends_a_shard(spark):
    """a, a b, a b c ...: each is the parent of the next, over shards of one path."""
    rows = [(c, t, "user", f"{t}", 1, "x", 2) for c in range(30) for t in range(c + 1)]
    for shard_turns in (3, 40, 1000):
        found = prefix_trie(turn_sequences(spark.createDataFrame(rows, SCHEMA)), shard_turns=shard_turns, least_turns=10**9, shard_paths=5)
        assert rows_of(found) == nodes(sequences(rows, heads=False))


def test_turnless_and_empty(spark):
    short = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(short, 0, "user", "gone", 1, "x", 2)]
    found = rows_of(prefix_trie(shared_heads(turn_sequences(spark.createDataFrame(rows, SCHEMA)))))
    assert found == [(short, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
    assert prefix_trie(shared_heads(turn_sequences(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_long_conversation(spark):
    rows = [(c, t, "user", f"{t}", 1, "x", 2) for c in (5, 6) for t in range(30_000 + c)]
    found = {(r["depth"], r["conv_id"]): r for r in prefix_trie(turn_sequences(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(found) == 30_007 and found[(30_005, 5)]["n_convs"] == 2 and found[(30_006, 6)]["parent_conv_id"] == 5
    assert found[(0, 5)]["saved_tokens"] == sum(len(str(t)) for t in range(30_005)) and found[(0, 5)]["n_leaves"] == 1


def test_trees_by_medians_are_balanced():
    assert sorted(medians(10)) == list(range(10)) and list(medians(3)) == [1, 0, 2] and list(medians(0)) == []
    tree = TernaryTree()
    ends = {i: tree.insert([i, 1]) for i in medians(1023)}
    assert [tree.line(ends[5])[1:] == [tree.parent[ends[5]], ends[5]], len(tree.turn)] == [True, 2047]

    def height(k):
        return 0 if k < 0 else 1 + max(height(tree.low[k]), height(tree.high[k]))

    assert height(tree.down[0]) == 10


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame(talk(3), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({q.ORACLE['op12_conversation_trie']})").fetchall()
    assert rows_of(q.op12_conversation_trie(spark, str(tmp_path))) == sorted(tuple(-1 if x is None else x for x in r) for r in want) == nodes(sequences(talk(3)))
