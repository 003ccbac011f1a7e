"""Skip-gram vectors: pairs, the gradient, planted analogies against Spark's own model."""

import random
from collections import Counter

import numpy as np
import pytest

from lexigrove.operators import embeddings


def planted():
    """Places and lands that share a pair's words with each other and a kind's words with their like."""
    rng, rows = random.Random(3), []
    for _ in range(5000):
        i, kind = rng.randrange(12), rng.random() < 0.5
        own = [f"cap{i}", f"p{i}a", f"p{i}b", "city", "mayor", "street"] if kind else [f"land{i}", f"p{i}a", f"p{i}b", "border", "army", "nation"]
        row = [own[0], *rng.sample(own, 4), *(f"f{rng.randrange(200)}" for _ in range(3))]
        rng.shuffle(row)
        rows.append((row,))
    return rows


def analogies(found):
    words = list(found)
    m = np.array([found[w] for w in words])
    m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-12
    right = 0
    for i in range(12):
        for j in set(range(12)) - {i}:
            asked = [words.index(w) for w in (f"cap{i}", f"land{i}", f"land{j}")]
            near = m @ (m[asked[0]] - m[asked[1]] + m[asked[2]])
            near[asked] = -9
            right += words[int(near.argmax())] == f"cap{j}"
    return right / (12 * 11)


def test_analogies(spark):
    docs = spark.createDataFrame(planted(), "tokens array<string>").repartition(3)
    own = {r["word"]: r["vector"] for r in embeddings.skip_gram(docs, size=24, window=5, negative=8, sample=1e-2, rounds=8, rate=0.05).collect()}
    from pyspark.ml.feature import Word2Vec

    other = Word2Vec(vectorSize=24, windowSize=5, minCount=5, inputCol="tokens", outputCol="v", seed=1, maxIter=8, stepSize=0.05, numPartitions=3).fit(docs)
    theirs = {r["word"]: r["vector"].toArray() for r in other.getVectors().collect()}
    assert set(own) == set(theirs) and analogies(own) > max(0.9, analogies(theirs))


def test_pairs_lie_within_windows():
    rng, rows = np.random.default_rng(1), [[1, 2, 3, 4, 5, 6], [], [7], [8, 9]]
    seen = Counter()
    for _ in range(200):
        left, right = embeddings.pairs(rows, 3, rng)
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            assert a != b and (a <= 6 and b <= 6 and abs(a - b) <= 3 or {a, b} == {8, 9})
            seen[abs(a - b)] += 1
    # a width is drawn evenly, so the next word is always a neighbour and the third one in a third of cases
    assert seen[1] == 200 * 12 and seen[3] == pytest.approx(200 * 6 / 3, rel=0.2)


def test_a_step_is_the_gradient():
    rng = np.random.default_rng(2)
    own, other = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    a, b = own.copy(), other.copy()
    draw = np.array([0.0, 0.0, 0.0, 0.0, 1.0])  # every draw is word 4
    embeddings.learned((own, other), np.array([0]), np.array([1]), draw, 2, 0.1, rng)
    s = lambda x: 1 / (1 + np.exp(-x))
    up, down = 0.1 * (1 - s(a[0] @ b[1])), -0.1 * s(a[0] @ b[4])
    assert np.allclose(own[0], a[0] + up * b[1] + 2 * down * b[4]) and np.allclose(other[1], b[1] + up * a[0]) and np.allclose(other[4], b[4] + 2 * down * a[0])
    assert np.allclose(own[1:], a[1:]) and np.allclose(other[[0, 2, 3]], b[[0, 2, 3]])


def test_vocabulary_by_kinds(spark):
    docs = spark.createDataFrame([(["a"] * 6 + ["E#b"] * 6 + ["c"] * 3,), (None,), ([],)], "tokens array<string>")
    assert embeddings.vocabulary(docs, "tokens", 5) == [("E#b", 6), ("a", 6)] and embeddings.vocabulary(docs, "tokens", 3, {"E#": 7}) == [("a", 6), ("c", 3)]
    assert embeddings.skip_gram(docs.limit(0), size=3).count() == 0 and [len(r["vector"]) for r in embeddings.skip_gram(docs, size=3, rounds=1).collect()] == [3, 3]
