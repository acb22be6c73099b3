"""Numerical integrals for tests."""

import numpy as np


def posterior(n: int, m: int, threshold: float) -> float:
    """P(similarity >= threshold | m of n agree) with a uniform prior, by integration."""
    x = (np.arange(2_000_000) + 0.5) / 2_000_000
    log = m * np.log(x) + (n - m) * np.log(1 - x)
    density = np.exp(log - log.max())
    return float(density[x >= threshold].sum() / density.sum())
