"""The trie programs against plain dynamic programs over single words."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from leadtime.llm.trie import Pieces, Trie
from leadtime.llm.unigram import STEPS, WORD_MARK, rank_scores


@pytest.fixture(scope="module")
def vocab():
    rng = random.Random(5)
    return Pieces(list(dict.fromkeys(bytes(rng.choices(b"abcd", k=rng.randint(1, 6))) for _ in range(300))) + [WORD_MARK, WORD_MARK + b"ab"])


@pytest.fixture(scope="module")
def words():
    rng = random.Random(7)
    return list(dict.fromkeys([bytes(rng.choices(b"abcdz", k=rng.randint(1, 12))) for _ in range(500)] + [b"a" * 300, "é".encode(), b"a", b"ab"]))


def plain_best(word, index, scores):
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[k][0] + scores[index[word[k:end]]], best[k][1] - 1) for k in range(end) if word[k:end] in index]
        best[end] = max(options)
    return -best[-1][1]


def plain_forward(word, index, log_p):
    alpha = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        terms = [alpha[k] + log_p[index[word[k:end]]] for k in range(end) if word[k:end] in index]
        top = max(terms)
        alpha[end] = top + math.log(sum(math.exp(x - top) for x in terms))
    return alpha[-1]


def test_best_counts_pieces(vocab, words):
    scores = rank_scores(vocab)
    index = {p: i for i, p in enumerate(vocab.pieces)}
    got = Trie(pa.array(words, pa.large_binary()), WORD_MARK).best(vocab, scores).tokens()
    assert got.tolist() == [plain_best(WORD_MARK + w, index, scores) for w in words]


def test_forward_sums_segmentations(vocab, words):
    log_p = rank_scores(vocab) / STEPS
    index = {p: i for i, p in enumerate(vocab.pieces)}
    got = Trie(pa.array(words, pa.large_binary()), WORD_MARK).forward(vocab, np.stack([log_p, log_p - 1], axis=1))
    assert np.allclose(got[:, 0], [plain_forward(WORD_MARK + w, index, log_p) for w in words])
    assert np.allclose(got[:, 1], [plain_forward(WORD_MARK + w, index, log_p - 1) for w in words])


def test_piece_counts_add_up(vocab, words):
    best = Trie(pa.array(words, pa.large_binary()), WORD_MARK).best(vocab, rank_scores(vocab))
    weights = np.arange(len(words), dtype=float)
    counts = best.piece_counts(weights, len(vocab))
    assert counts.sum() == (weights * best.tokens()).sum()
    assert sum(len(p) * n for p, n in zip(vocab.pieces, counts)) == sum((len(w) + len(WORD_MARK)) * n for w, n in zip(words, weights))


def test_empty_trie(vocab):
    assert Trie(pa.array([], pa.large_binary()), WORD_MARK).best(vocab, rank_scores(vocab)).tokens().tolist() == []
