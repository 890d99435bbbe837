import numpy as np
import pytest

from attnlens.llm.fmindex import FMIndex, suffix_array


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_count_and_locate_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, rng.integers(2, 7), rng.integers(1, 80))
    if seed % 3 == 0:
        text = np.tile(text[:5], 9)
    suffixes = [tuple(text[i:]) for i in range(len(text))]
    assert list(suffix_array(text)) == sorted(range(len(text)), key=lambda i: suffixes[i])
    index = FMIndex(text)
    for length in range(1, 6):
        patterns = rng.integers(0, 7, (8, length))
        for pattern, low, high in zip(patterns, *index.count(patterns), strict=True):
            want = [i for i in range(len(text) - length + 1) if tuple(text[i : i + length]) == tuple(pattern)]
            assert sorted(index.locate(np.arange(low, high))) == want
