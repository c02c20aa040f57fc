"""The cut suffix tree against its definition."""

import random

import numpy as np
import pyarrow as pa
import pytest

from leadtime.llm.substring_dedup import deep_nodes, repeats


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(6))
def test_deep_nodes_are_classes_of_suffixes(seed):
    rng, size = random.Random(seed), 3
    texts = [[rng.randrange(2 + seed % 3) for _ in range(rng.randrange(0, 25))] for _ in range(12)] + [[], [1] * 20]
    codes, off = np.array([x for t in texts for x in t], np.int64), np.r_[0, np.cumsum([len(t) for t in texts])]
    tree = deep_nodes(codes, off, size)
    suffixes = {int(off[i]) + k: t[k:] for i, t in enumerate(texts) for k in range(len(t) - size + 1)}
    classes = {}
    for at, words in suffixes.items():
        classes.setdefault(tuple(words[:size]), set()).add(at)
    got = np.split(tree.suffix, tree.first[1:])
    assert {frozenset(x.tolist()) for x in got} == {frozenset(x) for x in classes.values()}
    for nodes, depth in zip(got, tree.depth, strict=True):
        first = suffixes[int(nodes[0])]
        assert depth == min(shared(first, suffixes[int(k)]) for k in nodes)


def test_empty_tree():
    assert len(deep_nodes(np.zeros(0, np.int64), np.zeros(1, np.int64), 3).suffix) == 0


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_segments(seed):
    rng, size = random.Random(seed), 3
    segments = [" ".join(rng.choices(["a", "b", "ab", "é"], k=rng.randrange(3, 12))) for _ in range(30)]
    segments += segments[:5]
    ids = np.array([rng.randrange(9) for _ in segments])
    least = {}
    for s, i in zip(segments, ids):
        w = s.split()
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, 99), i)
    want = {(n, k) for n, (s, i) in enumerate(zip(segments, ids)) for k in range(len(s.split()) - size + 1) if least[tuple(s.split()[k : k + size])] < i}
    *found, others = repeats(pa.array([s.encode() for s in segments], pa.large_binary()), ids, size)
    runs = list(zip(*(x.tolist() for x in found)))
    got = [(n, k + j) for n, k, length in runs for j in range(length)]
    assert len(got) == len(set(got)) and set(got) == want
    assert [len(s.split()) - size + 1 > sum(x == n for x, _ in got) for n, s in enumerate(segments)] == others.tolist()
    assert not {(n, k + length) for n, k, length in runs} & {(n, k) for n, k, _ in runs}  # runs are maximal
