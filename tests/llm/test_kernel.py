"""Kernel, landmarks and SVM against plain computations, and the differencing of shards."""

from itertools import combinations

import numpy as np

from quadframe.llm import sharding, toxicity

WORDS = ["stupid", "stxupid", "stu-pid", "table", "so", "a", "\u00fcmlaut", "wonderful"]


def plain_kernel(v, w):
    """All subsequences of three or four characters inside six, each weighed by the length that it spans."""

    def weights(word):
        word, out = f"^{word}$", {}
        for n in (3, 4):
            for at in combinations(range(len(word)), n):
                if at[-1] - at[0] < toxicity.SPAN:
                    out.setdefault("".join(word[i] for i in at), []).append(toxicity.DECAY ** (at[-1] - at[0] + 1))
        norm = np.sqrt(sum(x * x for xs in out.values() for x in xs)) or 1.0
        return {k: sum(xs) / norm for k, xs in out.items()}

    x, y = weights(v), weights(w)
    return sum(x[k] * y[k] for k in x.keys() & y.keys())


def test_kernel_and_landmarks():
    marks = toxicity._Landmarks(WORDS)
    expected = np.array([[plain_kernel(v, w) for w in WORDS] for v in WORDS])
    assert np.allclose(marks.vectors.T @ marks.vectors, expected, atol=1e-5)
    mapped = marks.map(WORDS)
    assert np.allclose(mapped @ mapped.T, expected, atol=1e-2)
    assert expected[0, 1] > 0.3 and expected[0, 2] > 0.3 and expected[0, 3] < 0.05
    w = np.linspace(-1, 1, mapped.shape[1])
    assert np.allclose(toxicity.weigh(WORDS, marks.weights(w)), mapped @ w, atol=1e-2)


def test_svm_reaches_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    weight = rng.uniform(0.5, 2, 80)
    w, b = toxicity.svm(x, y, weight)

    def loss(v):
        return v[:-1] @ v[:-1] + 1e-3 * v[-1] ** 2 + (weight * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()

    best = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + 1e-3 * d) >= best - 1e-9 for d in rng.normal(size=(200, 5)))


def test_letters_set_apart():
    assert "idiot" in toxicity.spans("you i d i o t now") and "idiot" in toxicity.spans("I  D\ti\no t")
    assert toxicity.spans("a b") == ["a", "b"]


def test_witnesses_alone_become_toxic():
    """Words that only chance puts into toxic documents stay clean."""
    toxic = [(f"grumble{x}", 9.0 - k / 10, 20) for k, x in enumerate("abcdefgh")] + [(f"plain{x}", 1.0, 1) for x in "abcdefgh"]
    clean = [(f"plain{x}{y}", 5) for x in "klmnopqrst" for y in "abcdef"]
    weights, bias = toxicity.train_words(toxic, clean, [[k, 8 + k] for k in range(8)])
    score = toxicity.weigh(["grumbler", "gruxmbled", "plainx", "plaina"], weights) + bias
    assert (score[:2] > 0).all() and (score[2:] < 0).all()


def plain_differencing(sizes, parts):
    """The largest spreads are joined first, oppositely ordered."""
    open_ = [sorted([0] * (parts - 1) + [s]) for s in sizes]
    while len(open_) > 1:
        open_.sort(key=lambda p: p[0] - p[-1])
        a, b = open_.pop(0), open_.pop(0)
        open_.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return open_[0][-1] - open_[0][0]


def test_differencing_against_a_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 1000, 40).tolist()
        sums, held = sharding.difference([(s,) for s in sizes], 4)
        assert sorted(sums) == sorted(sum(sizes[i] for i, _ in h) for h in held) and sorted(i for h in held for i, _ in h) == list(range(40))
        greedy = [0] * 4
        for s in sorted(sizes, reverse=True):
            greedy[greedy.index(min(greedy))] += s
        assert max(sums) - min(sums) <= max(plain_differencing(sizes, 4), max(greedy) - min(greedy))
