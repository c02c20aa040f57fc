"""Groups of near copies around the threshold: every link of all pairs is found, whatever number of holders makes a shingle rare."""

import random

import pytest

from leadtime.llm import minhash_dedup
from leadtime.llm.minhash_dedup import near_duplicates


def edited(words, edits, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = rng.choice(["common", "usual"]) if rng.random() < 0.3 else f"w{rng.random()}"
    return words


@pytest.mark.parametrize("rare", [1, 4, 64])
def test_no_link_is_lost(spark, rare, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "RARE", rare)
    rng = random.Random(2)
    docs = []
    for n_words, copies in ((120, 70), (60, 40)):
        core = [f"c{n_words}x{k}" for k in range(n_words)]
        docs += [edited(core, rng.choice([1, 2, 3, 4, 5, 6]) * n_words // 100 + rng.choice([0, 1]), rng) for _ in range(copies)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(table).collect()}
    assert got == {i: find(i) for i in range(len(docs))}
    assert links > 50 and len(set(got.values())) > 20
