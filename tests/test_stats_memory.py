"""Resampling holds a bounded number of draws and takes the numbers that it took at once."""

import tracemalloc

import numpy as np

from recallgrid.operators import stats as B


def peak(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_draws_by_rows_are_those_at_once(monkeypatch):
    values = np.random.default_rng(3).normal(0.1, 1, 1001)
    sums, counts = values * 3, np.arange(1001) % 5 + 1.0
    every = lambda: (B.bootstrap(values, 700), B.cluster_bootstrap(sums, counts, 700), B.randomization_p(values, 1500))
    monkeypatch.setattr(B, "HELD", 1 << 40)
    at_once = every()
    for held in (1, 5000, 1 << 20):
        monkeypatch.setattr(B, "HELD", held)
        assert every() == at_once


def test_memory_does_not_grow_with_draws_times_values():
    values = np.random.default_rng(4).normal(0, 1, 40_000)
    assert peak(lambda: B.randomization_p(values, 1024)) < 80e6
    assert peak(lambda: B.bootstrap(values, 512)) < 80e6
    assert peak(lambda: B.cluster_bootstrap(values, np.abs(values) + 1, 512)) < 80e6
