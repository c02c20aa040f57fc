"""A prefix trie of conversations: ternary search trees of range shards, whose boundary nodes merge.

A turn is a key of 20 bytes (a 128-bit hash of role and text, and the text's length), a conversation the keys of its turns end
to end. Sorted by these bytes, the conversations that share a prefix are neighbours, so a range of them has nearly all nodes
to itself: only the prefixes of its first and its last conversation may go on in other ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

KEY_BYTES = 20
#: Members of a sequence are gathered from ranges of so many conversation ids.
ID_RANGE = 1 << 13
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = {"key": "binary", "parent_key": "binary", "conv_id": "bigint", "depth": "int", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}
#: A sequence with what is known of some of its prefixes, by depth: members, the least one, children, leaves and savings that aren't among the other paths'.
PATH = {"seq": "binary", "at": "array<int>", "members": "array<bigint>", "least": "array<bigint>", "kids": "array<bigint>", "leaves": "array<bigint>", "saved": "array<bigint>", "ends": "array<string>"}
ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def turn_sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, keys: the keys of the turns of each conversation (in hex) in the order of ``turn``, null first.

    Null roles and texts are empty. Rows of the same turn all count, in the order of their hashes, equal rows too. Rows without a
    conversation id belong to none and are left out. A conversation is one row of 20 bytes a turn, however long its texts are.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    named = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    key = F.concat(named, F.lpad(F.hex(F.octet_length(text).cast("bigint")), 8, "0"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), key.alias("key")).alias("place"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("place")).alias("places")).select("conv_id", F.col("places.key").alias("keys"))


def shared_heads(sequences: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id, keys: conversations that begin like others.

    Conversation c gets the first h turns of c - c % ``family`` (all if it has fewer, none if there is no such conversation), then its
    own turns after its first h; h is crc32 of c in decimal, modulo ``most``.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("keys", 1, most))).over(Window.partitionBy("base"))
    own = F.slice(F.col("keys"), h + 1, F.greatest(F.size("keys") - h, F.lit(0)))
    both = sequences.withColumn("base", base).withColumn("head", F.coalesce(head, F.array().cast("array<string>")))
    return both.select("conv_id", F.concat(F.slice(F.col("head"), F.lit(1), h), own).alias("keys"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """The distinct sequences as paths: members, the least of them, and the SHA-256 of their ids in order.

    Ids are gathered in ranges of bounded size, whose texts are hashed one after the other, so a sequence of any number of
    conversations is no group of its own size.
    """
    rows = stage(sequences.select("conv_id", F.unhex(F.array_join("keys", "")).alias("seq")), "sequences")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    ranges = rows.groupBy(F.md5("seq").alias("name"), F.floor(F.col("conv_id") / ID_RANGE).alias("range_no")).agg(
        F.first("seq").alias("seq"), F.count("*").alias("members"), F.min("conv_id").alias("least"), ids.alias("ids")
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seq, members, least, digest = None, b"", 0, None, None
        for batch in batches:
            done = []
            for row_name, row_seq, n, first, ids in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if row_name != name:
                    if name is not None:
                        done.append((seq, members, least, digest.hexdigest()))
                    name, seq, members, least, digest = row_name, row_seq, 0, first, hashlib.sha256()
                else:
                    digest.update(b",")
                members += n
                least = min(least, first)
                digest.update(ids.encode())
            yield paths([(s, [len(s) // KEY_BYTES], [n], [first], [0], [0], [0], [ends]) for s, n, first, ends in done])
        if name is not None:
            yield paths([(seq, [len(seq) // KEY_BYTES], [members], [least], [0], [0], [0], [digest.hexdigest()])])

    placed = ranges.repartition("name").sortWithinPartitions("name", "range_no").select("name", "seq", "members", "least", "ids")
    return placed.mapInArrow(fold, ", ".join(f"{c} {kind}" for c, kind in PATH.items()))


def paths(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[kind]) for i, kind in enumerate(PATH.values())], names=list(PATH))


def medians(n: int) -> Iterator[int]:
    """The middle of 0..n-1, then the middles of both halves, and so on."""
    todo = [(0, n)] if n else []
    while todo:
        halves = []
        for a, b in todo:
            middle = (a + b) // 2
            yield middle
            halves += [(x, y) for x, y in ((a, middle), (middle + 1, b)) if x < y]
        todo = halves


class TernaryTree:
    """A trie whose nodes hold the children of their parent as a binary tree; node 0 is the root, children come after parents."""

    def __init__(self):
        self.turn, self.low, self.high, self.down, self.parent = [-1], [-1], [-1], [-1], [-1]

    def add(self, turn: int, parent: int) -> int:
        self.turn.append(turn)
        self.parent.append(parent)
        for link in (self.low, self.high, self.down):
            link.append(-1)
        return len(self.turn) - 1

    def insert(self, turns: list[int]) -> int:
        """The node at the end of these turns; a sorted set of them inserted by medians keeps the binary trees balanced."""
        own, low, high, down = self.turn, self.low, self.high, self.down
        at = 0
        for turn in turns:
            link, place, k = down, at, down[at]
            while k >= 0 and own[k] != turn:
                link, place = (low, k) if turn < own[k] else (high, k)
                k = link[k]
            if k < 0:
                k = self.add(turn, at)
                link[place] = k
            at = k
        return at

    def line(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def shard_nodes(table: pa.Table, whole: bool, keyed: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The nodes of a range of sorted paths that no other range has, and its boundary paths (none if the range is ``whole``).

    With ``keyed``, nodes have keys, by which nodes that were done before find their parents.
    """
    seqs = table["seq"].to_pylist()
    size = np.array([len(s) // KEY_BYTES for s in seqs], np.int64)
    joined = np.frombuffer(b"".join(seqs), f"S{KEY_BYTES}")
    known, turns = np.unique(joined, return_inverse=True)
    bytes_of = np.frombuffer(known.tobytes(), ">u4").reshape(-1, KEY_BYTES // 4)[:, -1].astype(np.int64).tolist() if len(known) else []
    bounds, turns = np.r_[0, np.cumsum(size)].tolist(), turns.reshape(-1).tolist()
    tree, ends_at = TernaryTree(), [0] * len(seqs)
    for i in medians(len(seqs)):
        ends_at[i] = tree.insert(turns[bounds[i] : bounds[i + 1]])
    n = len(tree.turn)
    members, least, kids, leaves, saved, ends = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [None] * n
    for end, *partial in zip(ends_at, *(table[c].to_pylist() for c in list(PATH)[1:])):
        line = tree.line(end)
        for d, m, first, k, x, s, sha in zip(*partial):
            t = line[d]
            members[t] += m
            least[t] = first if least[t] is None else least[t] if first is None else min(least[t], first)
            kids[t] += k
            leaves[t] += x
            saved[t] += s
            ends[t] = sha or ends[t]
    edges = [] if whole else [(seqs[i], tree.line(ends_at[i])) for i in dict.fromkeys((0, len(seqs) - 1))]
    open_nodes = {t for _, line in edges for t in line}
    parent, depth = tree.parent, [0] * n
    for t in range(1, n):
        depth[t] = depth[parent[t]] + 1
    for t in range(n - 1, -1, -1):
        if t in open_nodes:
            continue
        leaves[t] = leaves[t] if kids[t] else 1
        if t:
            p = parent[t]
            saved[t] += (members[t] - 1) * bytes_of[tree.turn[t]]
            members[p] += members[t]
            least[p] = least[t] if least[p] is None else min(least[p], least[t])
            kids[p] += 1
            leaves[p] += leaves[t]
            saved[p] += saved[t]
    keys: dict[int, bytes] = {}
    for seq, line in [(seqs[i], tree.line(end)) for i, end in enumerate(ends_at)] if keyed else edges:
        digest = hashlib.md5()
        for d, t in enumerate(line):
            digest.update(seq[(d - 1) * KEY_BYTES : d * KEY_BYTES] if d else b"")
            keys[t] = digest.digest()
    done = [t for t in range(n) if t not in open_nodes]
    above = [parent[t] for t in done]
    columns = [
        [keys.get(t) if keyed else None for t in done], [keys[p] if p in open_nodes else None for p in above], [least[t] for t in done], [depth[t] for t in done],
        [None if p < 0 or p in open_nodes else least[p] for p in above], [members[t] for t in done], [kids[t] for t in done], [leaves[t] for t in done], [saved[t] for t in done],
        [ends[t] or NO_ENDS for t in done],
    ]
    nodes = pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, kind in zip(columns, NODE.values())], names=list(NODE))
    told, rest = set(), []
    for seq, line in edges:
        mine = [(d, t) for d, t in enumerate(line) if t not in told]
        told.update(line)
        rest.append((seq, [d for d, _ in mine], *([values[t] for _, t in mine] for values in (members, least, kids, leaves, saved, ends))))
    return nodes, paths(rest)


def folded(whole: bool, keyed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            nodes, rest = shard_nodes(pa.Table.from_batches(held), whole, keyed)
            for part in (nodes, rest):
                columns = [part.column(part.schema.names.index(c)) if c in part.schema.names else pa.nulls(len(part), ARROW[kind]) for c, kind in (NODE | PATH).items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*NODE, *PATH])

    return run


def prefix_trie(sequences: DataFrame, shard_turns: int = 1 << 18, least_turns: int = 1 << 14, shard_paths: int = 1000) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, keys; see :func:`turn_sequences`), each distinct prefix of a conversation, from the empty one.

    conv_id (the least of its members, the conversations that begin with it), depth, parent_conv_id (the parent's conv_id, null for
    the root), n_convs (members), n_children, n_leaves (nodes of its subtree without children), saved_tokens (over its subtree, bytes
    of a node's last text times members but one), ends_sha256 (of the ids, in order, of members that end there). Ids of conversations
    are integers and occur once. No conversations, no nodes.

    Distinct sequences are put in order over ranges of at most about ``shard_turns`` turns (fewer, down to ``least_turns``, as
    long as there are less ranges than cores). A task encodes the turns of its range as numbers, builds a ternary search tree by
    medians and sums up from the leaves. Nodes on the first and the last path of a range go on as two paths with
    partial sums, which ranges of ``shard_paths`` paths fold in the same way until one range is left.
    """
    cores = sequences.sparkSession.sparkContext.defaultParallelism
    table = stage(distinct_sequences(sequences), "distinct")
    turns = (table.agg(F.sum(F.length("seq") / KEY_BYTES + 1)).first()[0]) or 0
    shards = max(1, -(-int(turns) // shard_turns), min(cores, int(turns) // least_turns))
    levels: list[DataFrame] = []
    while True:
        placed = table.coalesce(1) if shards == 1 else table.repartitionByRange(shards, "seq")
        found = stage(placed.sortWithinPartitions("seq").mapInArrow(folded(shards == 1, bool(levels)), ", ".join(f"{c} {kind}" for c, kind in (NODE | PATH).items())), "nodes")
        levels.append(found.where("depth is not null").select(*NODE))
        if shards == 1:
            break
        table = found.where("seq is not null").select(*PATH)
        shards = -(-table.count() // shard_paths)
    out = [c for c in NODE if c not in ("key", "parent_key")]
    parents = None
    for level in levels[1:]:
        keyed = level.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
        parents = keyed if parents is None else parents.unionByName(keyed)
    result = None
    for level in levels:
        parts = [level.where("parent_key is null").select(*out)]
        if parents is not None:
            parts.append(level.where("parent_key is not null").drop("parent_conv_id").join(parents, "parent_key").select(*out))
        for part in parts:
            result = part if result is None else result.unionByName(part)
    return result
