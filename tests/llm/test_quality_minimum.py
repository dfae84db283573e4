"""The classifier's fit against an independent minimum of its risk, and its prior against a known one."""

import numpy as np
import pytest

from tessera.llm import quality


def samples(seed, prior, n=3000, d=5, apart=1.0):
    r = np.random.default_rng(seed)
    shift = np.linspace(0.2, 0.6, d) * apart
    positive = r.normal(size=(n, d)) + shift
    mixed = r.normal(size=(n, d)) + np.where(r.random(n) < prior, 1, -1)[:, None] * shift
    return positive, mixed


def risk(theta, xp, xu, prior, decay=1e-4):
    """Unbiased risk with the logistic loss: convex, since the two losses of a positive differ by its margin."""
    zp, zu = xp @ theta[:-1] + theta[-1], xu @ theta[:-1] + theta[-1]
    return -prior * zp.mean() + np.logaddexp(0, zu).mean() + decay / 2 * theta[:-1] @ theta[:-1]


@pytest.mark.parametrize("prior", [0.3, 0.6])
def test_fit_reaches_the_minimum(prior):
    xp, xu = samples(1, prior)
    theta = np.zeros(xp.shape[1] + 1)
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u, ridge = one(xp), one(xu), np.append(np.full(xp.shape[1], 1e-4), 0)
    for _ in range(60):  # Newton's method, with steps that lower the risk
        s = 1 / (1 + np.exp(-(u @ theta)))
        grad = -prior * p.mean(axis=0) + u.T @ s / len(u) + ridge * theta
        step, size = np.linalg.solve(u.T @ (u * (s * (1 - s))[:, None]) / len(u) + np.diag(ridge + 1e-9), grad), 1.0
        while size > 1e-6 and risk(theta - size * step, xp, xu, prior) > risk(theta, xp, xu, prior):
            size /= 2
        theta = theta - size * step
    assert np.abs(grad).max() < 1e-6
    # The minimum has a negative part above 0, so the non-negative risk is this one there.
    assert np.logaddexp(0, u @ theta).mean() > prior * np.logaddexp(0, p @ theta).mean()
    weight, bias = quality._descend(xp, xu, prior, np.zeros(xp.shape[1]), 0.0, 600)
    got = np.append(weight, bias)
    assert risk(got, xp, xu, prior) - risk(theta, xp, xu, prior) < 1e-3
    assert np.allclose(got, theta, atol=0.1)


def test_negative_part_stays_near_zero():
    """With more weights than rows the unbiased risk falls without end; the non-negative one is held."""
    r = np.random.default_rng(2)
    xp, xu = r.normal(size=(20, 60)) + 0.2, r.normal(size=(25, 60))
    weight, bias = quality._descend(xp, xu, 0.5, np.zeros(60), 0.0, 600)
    assert np.logaddexp(0, xu @ weight + bias).mean() - 0.5 * np.logaddexp(0, xp @ weight + bias).mean() > -0.2


@pytest.mark.parametrize("prior", [0.25, 0.5, 0.75])
def test_prior_is_estimated(prior):
    # The estimate is a bound, met where the best scores are of positives alone.
    xp, xu = samples(3, prior, 8000, apart=2.0)
    w, c = quality._descend(xp[::2], xu[::2], 0.5, np.zeros(xp.shape[1]), 0.0, 300)
    assert quality.estimated_prior(xp[1::2] @ w + c, xu[1::2] @ w + c) == pytest.approx(prior, abs=0.06)
