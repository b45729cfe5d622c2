"""The exact discrepancy against all pairs, on more rows than the heuristic takes."""

import numpy as np
import pandas as pd
import pytest

from vantagrain.operators import density


def test_mmd_exact_sums_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, (2300, 2)), rng.normal(0.2, 1.3, (2200, 2))
    x, y = (spark.createDataFrame(pd.DataFrame({"id": range(len(v)), "u": v[:, 0], "v": v[:, 1]})) for v in (a, b))
    got = density.mmd_exact(x, y, "id", ("u", "v"), sigma=1.1).first()
    both = np.concatenate((a, b))
    a, b = ((v - both.mean(axis=0)) / both.std(axis=0, ddof=1) for v in (a, b))
    k = lambda p, q: np.exp(-sum((p[:, j, None] - q[None, :, j]) ** 2 for j in range(2)) / (2 * 1.1**2))
    n, m = len(a), len(b)
    want = (k(a, a).sum() - n) / (n * (n - 1)) + (k(b, b).sum() - m) / (m * (m - 1)) - 2 * k(a, b).mean()
    assert got.mmd2 == pytest.approx(want, abs=1e-9)
    assert 0.5 < density.mmd_exact(x, y, "id", ("u", "v")).first().sigma < 3
