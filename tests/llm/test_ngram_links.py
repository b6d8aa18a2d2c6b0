"""Links of nested sets that grow beyond a hub's size range, against brute force."""

from collections import Counter

import numpy as np
import pytest

from gleaner.llm import ngram_join


@pytest.mark.parametrize("num,den,sizes", [(9, 10, (104, 112, 121)), (8, 10, (109, 130, 155))])
@pytest.mark.parametrize("two_sides", [False, True])
def test_links_beyond_a_hubs_size_range(num, den, sizes, two_sides):
    near = [frozenset(range(100)), *(frozenset(range(100)) - {i} | {1000 + i} for i in range(10))]
    sets = [*near, *(frozenset(range(n)) for n in sizes)]
    side = np.arange(len(sets)) % 2 if two_sides else None
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and not (two_sides and side[i] == side[j])]
    degree = Counter(x for p in pairs for x in p)
    root, count = ngram_join.links([np.array(sorted(s), np.uint64) for s in sets], np.ones(len(sets), np.int64), side, num, den)
    assert count.tolist() == [degree[i] for i in range(len(sets))]
    assert all(root[i] == root[j] for i, j in pairs) and degree[len(sets) - 1] > 0
