"""No alignment with half of an item's words in place is missed, however the replaced words lie."""

import numpy as np
import pytest

from pointweave.llm import decontaminate as d


def found(size, kept):
    """Matched words of each row of ``kept`` (words in place) that is reported, amid other words; 0 where it is not."""
    item = " ".join(f"w{k}" for k in range(size))
    index = d.Index([(7, item), (8, "a passage of other words that no document here holds")])
    rng = np.random.default_rng(size)
    words = rng.integers(1, 1 << 60, (len(kept), size + 10), np.uint64)
    own = d.words(np.frombuffer(item.encode(), np.uint8), np.array([0, len(item)]), d.non_letters())[0]
    words[:, 5 : 5 + size] = np.where(kept, own, words[:, 5 : 5 + size])
    got = np.zeros(len(kept), int)
    for row, i, n, n_item, _ in index.leaks(words.ravel(), np.arange(len(kept) + 1) * (size + 10)):
        assert (i, n_item) == (0, size)
        got[row] = n
    return got


@pytest.mark.parametrize("size", [7, 8, 9, 11, 13, 14, 15, 16, 17])
def test_every_pattern_of_replaced_words(size):
    kept = (np.arange(1 << size)[:, None] >> np.arange(size)) & 1 == 1
    n = kept.sum(1)
    enough = n >= max(d.SHARE * size, min(d.WEIGHT, size))
    assert (found(size, kept) == np.where(enough, n, 0)).all()


@pytest.mark.parametrize("size", [20, 23, 30, 37, 40, 59, 60, 200])
def test_patterns_of_longer_items(size):
    rng = np.random.default_rng(size)
    half = np.argsort(rng.random((5000, size)), 1) < -(-size // 2)
    step = np.arange(size)[None] % np.arange(2, 8)[:, None]
    regular = np.concatenate([step != phase for phase in range(7)] + [np.arange(size)[None] % 2 == phase for phase in range(2)])
    kept = np.concatenate([half, regular])
    n = kept.sum(1)
    kept, n = kept[n >= d.SHARE * size], n[n >= d.SHARE * size]
    assert (found(size, kept) == n).all()


def test_no_long_set_avoids_the_masks():
    """The most words in place without any mask, by a walk over the last seven places, at every length."""
    masks = [int(m, 2) for m in d.MASKS]
    best = {0: 0}
    for size in range(1, 400):
        new = {}
        for state, n in best.items():
            for bit in (0, 1):
                last = state << 1 | bit
                if all(last & m != m for m in masks):
                    new[last & 127] = max(new.get(last & 127, 0), n + bit)
        best = new
        assert size < d.WEIGHT or max(best.values()) < max(d.SHARE * size, min(d.WEIGHT, size))
