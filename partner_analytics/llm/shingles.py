"""Sets of word shingles."""

from __future__ import annotations

import numpy as np

from partner_analytics.llm.common import grams, hashed, words

SHINGLE = 5


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; all words as one where there are fewer."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(grams(hashed(tokens), min(n, len(tokens))))
