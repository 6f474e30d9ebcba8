import math

import pytest

from cohortlens.functions import dist


# values printed by the regression and variance tables of a known 150-row study
@pytest.mark.parametrize("t, df, p", [(-0.21415, 147, 0.83073), (-1.12817, 147, 0.26109)])
def test_t_tails(t, df, p):
    assert dist.t_two_sided(t, df) == pytest.approx(p, abs=5e-6)


@pytest.mark.parametrize("f, p", [(0.04568, 0.83106), (1.28524, 0.25879), (0.42271, 0.51661)])
def test_f_tails(f, p):
    assert dist.f_sf(f, 1, 146) == pytest.approx(p, abs=6e-6)


def test_textbook_values():
    assert dist.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert dist.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)


def test_beta_symmetry():
    for a, b, x in [(0.5, 3, 0.2), (10, 2, 0.9), (50, 60, 0.4)]:
        assert dist.beta_inc(a, b, x) + dist.beta_inc(b, a, 1 - x) == pytest.approx(1.0, abs=1e-12)


@pytest.mark.parametrize("both, covered, positive, total", [
    (27, 46, 72, 150), (3, 10, 30, 100), (1, 10, 30, 100), (0, 5, 5, 20), (5, 5, 5, 20), (9, 10, 15, 20)])
def test_fisher_against_exact_sum(both, covered, positive, total):
    exact = sum(
        math.comb(positive, k) * math.comb(total - positive, covered - k)
        for k in range(both, min(covered, positive) + 1) if covered - k <= total - positive
    ) / math.comb(total, covered)
    assert dist.fisher_greater(both, covered, positive, total) == pytest.approx(exact, rel=1e-9)
