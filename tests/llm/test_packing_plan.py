import random
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from sparkseek.llm.packing import plan_packing


def unroll(counts, capacity):
    runs, sequences = plan_packing(dict(counts), capacity)
    bins = defaultdict(list)
    for length, first, last, sequence, per, offset in runs:
        for r in range(first, last):
            bins[sequence + (r - first) // per].append((offset + (r - first) % per * length, length))
    assert sorted(bins) == list(range(sequences))
    placed = Counter()
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
            placed[length] += 1
        assert at <= capacity
    assert placed == Counter({k: n for k, n in counts.items() if n})
    return sequences


def optimum(items, capacity):
    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        head, rest = left[0], left[1:]
        found = {()}
        for x in rest:
            found |= {(*f, x) for f in found}
        out = len(left)
        for f in found:
            if head + sum(f) <= capacity:
                remain = list(rest)
                for x in f:
                    remain.remove(x)
                out = min(out, 1 + best(tuple(remain)))
        return out

    return best(tuple(sorted(items, reverse=True)))


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_feasible_and_near_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 16])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    used = unroll(Counter(items), capacity)
    assert used <= optimum(items, capacity) + 1


def test_perfect_pairs_are_fixed():
    assert unroll({6: 5, 4: 5}, 10) == 5
    assert unroll({5: 7}, 10) == 4


def test_empty_and_large_counts():
    assert plan_packing({}, 8) == ([], 0)
    assert unroll({1: 1000, 3: 500, 7: 300, 8: 11}, 8) == -(-(1000 + 1500 + 2100 + 88) // 8)
