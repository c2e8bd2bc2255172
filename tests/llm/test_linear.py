"""The sparse sums: the same as whole products, in less memory."""

import tracemalloc

import numpy as np
import pytest

from predio.llm import linear


def made(seed, n=4000, most=600, size=1 << 16):
    rng = np.random.default_rng(seed)
    return [np.unique(rng.integers(0, size, rng.integers(0, most))) for _ in range(n)]


@pytest.mark.parametrize("size", [1 << 16, 1 << 18])
def test_sums_are_those_of_whole_products(size, monkeypatch):
    rows, rng = made(1, 300, 90, size), np.random.default_rng(2)
    values = [rng.normal(size=len(r)) for r in rows]
    w, g = rng.normal(size=size), rng.normal(size=len(rows))
    for given in (None, values):
        x = linear.Sparse.of(rows, given)
        each = [np.ones(len(r)) if given is None else v for r, v in zip(rows, values, strict=True)]
        back = np.zeros(size)
        for r, v, one in zip(rows, each, g, strict=True):
            back[r] += v * one
        for run in (1, 50, 1 << 18):
            monkeypatch.setattr(linear, "RUN", run)
            np.testing.assert_allclose(x.dot(w), [(w[r] * v).sum() for r, v in zip(rows, each, strict=True)], atol=1e-9)
            np.testing.assert_allclose(x.back(g, size), back, atol=1e-9)


def test_a_fit_needs_little_memory_beside_its_rows():
    rows = made(3)
    entries = sum(map(len, rows))
    tracemalloc.start()
    x = linear.Sparse.of(rows)
    built = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    x.back(x.dot(np.ones(1 << 16)), 1 << 16)
    summed = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert built < 12 * entries + 4e6, built / entries
    assert summed < 2 * entries + 6e6, summed / entries
