"""Signs by halves are those by full enumeration, ties included."""

import numpy as np
import pytest

from ledger_jobs.operators import trail


@pytest.mark.parametrize("k", [2, 5, 9, 10, 13])
@pytest.mark.parametrize("most", [3, 100_000])
def test_halves_equal_whole(k, most):
    rng = np.random.default_rng(k * most)
    amounts, credit = rng.integers(1, most + 1, (60, k)), rng.integers(0, 2, (60, k)).astype(bool)
    true = rng.integers(0, 2, (60, k)) * 2 - 1
    deltas = (amounts * true).sum(1)
    deltas[::5] += 1  # some that no signs give
    want, got = trail._whole(amounts, credit, deltas), trail._by_halves(amounts, credit, deltas)
    assert (want[1] == got[1]).all() and (want[0][want[1]] == got[0][got[1]]).all() and got[1].sum() >= 40
    assert ((2 * got[0] - 1) * amounts).sum(1)[got[1]].tolist() == deltas[got[1]].tolist()


def test_sixteen_rows():
    rng = np.random.default_rng(1)
    amounts, credit = rng.integers(1, 10**6, (2000, 16)), rng.integers(0, 2, (2000, 16)).astype(bool)
    deltas = (amounts * (rng.integers(0, 2, (2000, 16)) * 2 - 1)).sum(1)
    signs, found = trail.best_signs(amounts, credit, deltas)
    assert found.all() and ((2 * signs - 1) * amounts).sum(1).tolist() == deltas.tolist()
