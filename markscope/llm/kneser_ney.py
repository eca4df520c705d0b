"""Interpolated modified Kneser-Ney discounts, shared by the word and the character models."""

from __future__ import annotations

import numpy as np


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3+ from the numbers of n-grams seen 1 to 4 times.

    Where the counts of counts are too thin for the estimate, 0.5, 1 and 1.5 are used; a discount is
    positive and never more than its count.
    """
    if n1 <= 0 or n2 <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 > 0 else 1.5
    out = []
    for k, d in enumerate((d1, d2, d3), 1):
        out.append(float(min(max(d, 0.05), k - 0.05)))
    return out[0], out[1], out[2]


def discount_of(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The discount that applies to each count (0 for count 0)."""
    return np.array([0.0, *d])[np.minimum(c, 3)]
