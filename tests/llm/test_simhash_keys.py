"""Prefix keys of texts of near sets."""

import numpy as np

from brindle.llm import simhash


def test_keys_of_sets_whose_first_shingles_differ_meet():
    """The first hashes of each set are its own, and yet two sets of resemblance 0.9 share a key."""
    both, own = np.arange(1000, 1900, dtype=np.int64), np.arange(100, dtype=np.int64)
    a, b = np.concatenate([own[::2], both]), np.concatenate([own[1::2], both])
    none = np.zeros((0, 2), dtype=np.int64)
    assert len(np.intersect1d(simhash._keys(a, none), simhash._keys(b, none)))
