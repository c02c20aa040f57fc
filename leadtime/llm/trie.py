"""Dynamic programs over all segmentations of words into vocabulary pieces, shared along a trie of the words.

The distinct words of a batch form a trie. What a program knows about a prefix is computed once per trie node,
level by level, for all nodes of a level at once; words only read their last node. Words of more than LONG bytes
would be levels of one node each; they are run one by one instead, in time in proportion to their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbytes import mix, powers

#: Odd, so it has an inverse.
BASE = np.uint64(0x100000001B3 * 0x10001 + 2)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Longer words are not put in the trie.
LONG = 256
#: Pieces are looked up for so many bytes of a long word at once.
SPAN = 1 << 16


class Pieces:
    """A vocabulary of byte strings, looked up by the hash of a stretch of a trie path. Every single byte is in it."""

    FILTER_BITS = 16

    def __init__(self, pieces: list[bytes]):
        known = dict.fromkeys(pieces)
        for b in range(256):
            known.setdefault(bytes([b]))
        self.pieces = list(known)
        self.longest = max(map(len, self.pieces))
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {}
        for n, ids in by_length.items():
            raw = np.frombuffer(b"".join(self.pieces[i] for i in ids), np.uint8).reshape(-1, n)
            hashes = np.zeros(len(ids), np.uint64)
            for j in range(n):
                hashes = hashes * BASE + raw[:, j] + np.uint64(1)
            order = np.argsort(hashes)
            maybe = np.zeros(1 << self.FILTER_BITS, bool)
            maybe[mix(hashes) >> np.uint64(64 - self.FILTER_BITS)] = True
            self.tables[n] = (hashes[order], np.array(ids)[order], maybe)

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches of n bytes with these hashes are pieces, and which."""
        if n not in self.tables:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, ids, maybe = self.tables[n]
        at = np.flatnonzero(maybe[mix(hashes) >> np.uint64(64 - self.FILTER_BITS)])
        if not len(at):
            return at, at
        slot = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
        hit = keys[slot] == hashes[at]
        return at[hit], ids[slot[hit]]


def found_pieces(word: bytes, pieces: Pieces) -> Iterator[tuple[list[int], list[int], list[int], int]]:
    """For each span of a long word: where the pieces that end at its k-th byte begin in the lists, their lengths, their numbers, and how many bytes.

    The list of places has one entry more than the span has bytes. A span is hashed with the bytes before it that pieces may reach.
    """
    data = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = powers(BASE, SPAN + pieces.longest + 1), powers(INVERSE, SPAN + pieces.longest + 1)
    for lo in range(0, len(data), SPAN):
        begin, hi = max(0, lo - pieces.longest), min(len(data), lo + SPAN)
        n_bytes = hi - begin
        prefix = np.r_[np.uint64(0), np.cumsum(data[begin:hi] * down[:n_bytes])]
        ends, lengths, numbers = [], [], []
        for n in pieces.tables:
            if n > n_bytes:
                continue
            at, ids = pieces.find(n, (prefix[n:] - prefix[:-n]) * up[n - 1 : n_bytes])
            inside = at + n > lo - begin
            ends.append(at[inside] + n - 1 - (lo - begin))
            lengths.append(np.full(int(inside.sum()), n))
            numbers.append(ids[inside])
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        places = np.searchsorted(end[order], np.arange(hi - lo + 1))
        yield places.tolist(), np.concatenate(lengths)[order].tolist(), np.concatenate(numbers)[order].tolist(), hi - lo


def best_of_long(word: bytes, pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """The numbers of the pieces of a word's best segmentation, last one first."""
    value = scores.tolist()
    score, count, last = [0], [0], np.zeros((len(word) + 1, 2), np.int32)
    t = 0
    for places, lengths, numbers, n_bytes in found_pieces(word, pieces):
        for k in range(n_bytes):
            t += 1
            best, fewest, at = None, 0, 0
            for j in range(places[k], places[k + 1]):
                s, c = score[t - lengths[j]] + value[numbers[j]], count[t - lengths[j]] + 1
                if best is None or s > best or s == best and c < fewest:
                    best, fewest, at = s, c, j
            score.append(best)
            count.append(fewest)
            last[t] = lengths[at], numbers[at]
    out = np.empty(count[-1], np.int64)
    for k in range(count[-1]):
        out[k] = last[t, 1]
        t -= int(last[t, 0])
    return out


def forward_of_long(word: bytes, pieces: Pieces, log_p: np.ndarray) -> list[float]:
    """The log-probability of a word, summed over all its segmentations, for each column of ``log_p``."""
    rows = log_p.tolist()
    columns = range(log_p.shape[1])
    alpha = [[0.0] * log_p.shape[1]]
    for places, lengths, numbers, n_bytes in found_pieces(word, pieces):
        for k in range(n_bytes):
            terms = [(alpha[-lengths[j]], rows[numbers[j]]) for j in range(places[k], places[k + 1])]
            new = []
            for c in columns:
                logs = [a[c] + p[c] for a, p in terms]
                top = max(logs)
                new.append(top + math.log(sum([math.exp(x - top) for x in logs])) if len(logs) > 1 else top)
            alpha.append(new)
        del alpha[: -pieces.longest]
    return alpha[-1]


@dataclass
class Level:
    """The nodes of one depth: the hash of each node's path, its parent's place in the level above, and the words that end here."""

    hashes: np.ndarray
    parent: np.ndarray
    words: np.ndarray  # the number of each word that ends here
    nodes: np.ndarray  # the node it ends at


class Trie:
    """The trie of ``words`` (distinct), each after ``prefix``."""

    def __init__(self, words: pa.Array, prefix: bytes = b""):
        order = pc.array_sort_indices(words)
        words = words.take(order)
        rank = order.to_numpy().astype(np.int64)
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        lengths = np.diff(off)
        self.size = len(words)
        is_long = lengths > LONG
        self.long = {int(rank[k]): prefix + data[off[k] : off[k + 1]].tobytes() for k in np.flatnonzero(is_long)}
        self.levels: list[Level] = [Level(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for b in prefix:
            self.levels.append(Level(self.levels[-1].hashes * BASE + np.uint64(b + 1), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
        active = np.flatnonzero(~is_long)
        node = np.zeros(len(active), np.int64)
        ended = lengths[active] == 0
        depth = 0
        while True:
            if ended.any():
                level = self.levels[-1]
                level.words, level.nodes = rank[active[ended]], node[ended]
                active, node = active[~ended], node[~ended]
            if not len(active):
                break
            byte = data[off[active] + depth]
            new = np.r_[True, (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])]
            parent = node[new]
            self.levels.append(Level(self.levels[-1].hashes[parent] * BASE + byte[new] + np.uint64(1), parent, np.zeros(0, np.int64), np.zeros(0, np.int64)))
            node = np.cumsum(new) - 1
            depth += 1
            ended = lengths[active] == depth

    def steps(self, pieces: Pieces) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
        """For each depth, the pieces that end at its nodes: (piece length, nodes, their ancestors where it begins, piece numbers)."""
        power = powers(BASE, pieces.longest + 1)
        above: list[np.ndarray] = []  # for each length, the ancestors of this level's nodes
        for d in range(1, len(self.levels)):
            level = self.levels[d]
            above = [level.parent, *(x[level.parent] for x in above[: pieces.longest - 1])]
            found = []
            for n, ancestor in enumerate(above, 1):
                nodes, ids = pieces.find(n, level.hashes - self.levels[d - n].hashes[ancestor] * power[n])
                if len(nodes):
                    found.append((n, nodes, ancestor[nodes], ids))
            yield d, found

    def best(self, pieces: Pieces, scores: np.ndarray) -> Best:
        """The segmentation of each path with the highest sum of (integer) scores; of equal ones, the one of fewest pieces."""
        score, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        last: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(1, np.int64),) * 3]
        for d, found in self.steps(pieces):
            k = len(self.levels[d].hashes)
            s, c = np.full(k, np.iinfo(np.int64).min), np.zeros(k, np.int64)
            piece, length, origin = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
            for n, nodes, ancestor, ids in found:
                s_new, c_new = score[d - n][ancestor] + scores[ids], count[d - n][ancestor] + 1
                better = (s_new > s[nodes]) | (s_new == s[nodes]) & (c_new < c[nodes])
                to = nodes[better]
                s[to], c[to] = s_new[better], c_new[better]
                piece[to], length[to], origin[to] = ids[better], n, ancestor[better]
            score.append(s)
            count.append(c)
            last.append((piece, length, origin))
        return Best(self, count, last, {k: best_of_long(word, pieces, scores) for k, word in self.long.items()})

    def forward(self, pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
        """For each word, a row of log-probabilities summed over all its segmentations, one for each column of ``log_p``."""
        columns = log_p.shape[1]
        alpha = [np.zeros((1, columns))]
        out = np.zeros((self.size, columns))
        for level in self.levels[:1]:
            out[level.words] = alpha[0][level.nodes]
        for d, found in self.steps(pieces):
            total = np.full((len(self.levels[d].hashes), columns), -np.inf)
            for n, nodes, ancestor, ids in found:
                total[nodes] = np.logaddexp(total[nodes], alpha[d - n][ancestor] + log_p[ids])
            alpha.append(total)
            if d >= pieces.longest:
                alpha[d - pieces.longest] = total[:0]  # no piece reaches back there
            out[self.levels[d].words] = total[self.levels[d].nodes]
        for k, word in self.long.items():
            out[k] = forward_of_long(word, pieces, log_p)
        return out


class Best:
    def __init__(self, trie: Trie, count: list[np.ndarray], last: list[tuple[np.ndarray, np.ndarray, np.ndarray]], long: dict[int, np.ndarray]):
        self.trie, self.count, self.last, self.long = trie, count, last, long

    def tokens(self) -> np.ndarray:
        """How many pieces each word has; stored at the node where it ends."""
        out = np.zeros(self.trie.size, np.int64)
        for level, count in zip(self.trie.levels, self.count, strict=True):
            out[level.words] = count[level.nodes]
        for k, numbers in self.long.items():
            out[k] = len(numbers)
        return out

    def piece_counts(self, weights: np.ndarray, n_pieces: int) -> np.ndarray:
        """How often each piece occurs if each word occurs ``weights`` times."""
        out = np.zeros(n_pieces)
        on = [np.zeros(len(level.hashes)) for level in self.trie.levels]
        for d in range(len(on) - 1, 0, -1):
            level = self.trie.levels[d]
            on[d] += np.bincount(level.nodes, weights[level.words], len(on[d]))
            piece, length, origin = self.last[d]
            out += np.bincount(piece, on[d], n_pieces)
            for n in np.unique(length):
                at = length == n
                on[d - n] += np.bincount(origin[at], on[d][at], len(on[d - n]))
        for k, numbers in self.long.items():
            out += np.bincount(numbers, minlength=n_pieces) * weights[k]
        return out
