"""Distribution functions against tabulated values."""

import math

import pytest

from vantagrain.functions import special as sp


@pytest.mark.parametrize(("x", "df", "p"), [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0)])
def test_chi_square(x, df, p):
    assert sp.chi2_sf(x, df) == pytest.approx(p, abs=1e-10)
    if x:
        assert sp.chi2_ppf(1 - p, df) == pytest.approx(x, rel=1e-9)


@pytest.mark.parametrize(("df", "q"), [(1, 12.706204736432095), (10, 2.2281388519649385), (1000, 1.9623390808264078)])
def test_t_quantile(df, q):
    assert sp.t_ppf(0.975, df) == pytest.approx(q, rel=1e-8)
    assert sp.t_ppf(0.025, df) == pytest.approx(-q, rel=1e-8)


def test_kolmogorov_and_wilson():
    assert sp.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, abs=1e-6)
    assert sp.kolmogorov_sf(0.9999999) == pytest.approx(sp.kolmogorov_sf(1.0000001), abs=1e-6)
    low, high = sp.wilson(50, 100)
    assert (low, high) == (pytest.approx(0.4038315, abs=1e-6), pytest.approx(0.5961685, abs=1e-6))
    assert sp.wilson(0, 0) == (0.0, 1.0)


def test_residual_risk():
    assert sp.residual_risk(0.5, 0.2) == pytest.approx(0.375)
    assert sp.residual_risk(0.1, 0.2) == 0.0
    assert sp.residual_risk(1.0, 1.0) == 0.0


def test_negative_binomial_sums_to_one():
    assert math.fsum(sp.neg_binomial_pmf(k, 2.5, 0.4) for k in range(400)) == pytest.approx(1.0, abs=1e-9)
