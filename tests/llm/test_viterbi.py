"""Labels of words against the best of all labellings."""

import itertools

import numpy as np


def best(scores, prior, switch):
    """The largest total of a labelling, by trying them all."""
    n, langs = scores.shape
    total = lambda y: prior[y[0]] + sum(scores[k, y[k]] for k in range(n)) - switch * sum(a != b for a, b in itertools.pairwise(y))
    return max(total(y) for y in itertools.product(range(langs), repeat=n))


def value(labels, scores, prior, switch):
    return prior[labels[0]] + scores[np.arange(len(labels)), labels].sum() - switch * (np.diff(labels) != 0).sum()


def test_every_labelling():
    from quill.llm.language import viterbi

    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = rng.integers(0, 8, 4)
        scores = rng.normal(0, 2, (counts.sum(), 3)).astype(np.float32)
        prior, switch = rng.normal(0, 1, 3).astype(np.float32), float(rng.uniform(0, 3))
        for long in (1000, 2):  # at once, and in stretches
            labels = viterbi(scores, counts, prior, switch, long)
            at = 0
            for n in counts:
                if n:
                    own = slice(at, at + n)
                    assert abs(value(labels[own], scores[own], prior, switch) - best(scores[own], prior, switch)) < 1e-3
                at += n


def test_stretches_of_a_long_row():
    from quill.llm.language import viterbi

    rng = np.random.default_rng(4)
    scores = np.repeat(rng.normal(0, 3, (40, 4)), 50, axis=0).astype(np.float32) + rng.normal(0, 1, (2000, 4)).astype(np.float32)
    prior = np.zeros(4, np.float32)
    a, b = (viterbi(scores, np.array([2000]), prior, 5.0, long) for long in (5000, 10))
    assert len(set(a)) > 1 and abs(value(a, scores, prior, 5.0) - value(b, scores, prior, 5.0)) < 1e-2
