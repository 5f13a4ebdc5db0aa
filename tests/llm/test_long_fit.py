"""Budgets of sources whose documents are longer than the programme's own budget."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import mixing


@pytest.mark.parametrize("budget", [6000, 12000, 20000])
def test_long_documents_fit_exactly(budget):
    lengths = np.array([5000, 6000, 7000, 8000, 9000])
    assert int((mixing.fit(lengths, np.ones(5, np.int64), budget) * lengths).sum()) == budget


def test_few_documents_fit_as_well_as_every_choice():
    rng = random.Random(1)
    for n in range(150):
        lengths = np.array(sorted(rng.sample(range(4097 if n % 2 else 1000, 20000), rng.randint(1, 7))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()))
        sums = {0}
        for length, count in zip(lengths.tolist(), counts.tolist()):
            sums |= {s + k * length for s in sums for k in range(1, count + 1) if s + k * length <= budget}
        take = mixing.fit(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all() and int((lengths * take).sum()) == max(sums)
