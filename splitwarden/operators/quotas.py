"""How many groups of each size go to each split or fold.

Groups of equal size and class are interchangeable, so the choice needs only a histogram
(size -> number of groups). That histogram has at most about sqrt(2 * rows) entries and is
the one thing that reaches the driver; the groups themselves are ranked and assigned by
Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np

Histogram = Mapping[int, int]
Quota = dict[int, tuple[int, int]]  # size -> (groups to test, groups to validation)

# Candidates looked at over all sizes, and at least per size; bounds the driver's time and memory.
CANDIDATES = 12_000_000
LEAST_CANDIDATES = 20_000
# Branches that the tree search opens at most.
NODES = 200_000
# Combinations of each half that the search from the middle lists at most.
MIDDLE = 1_000_000
# Ways of dealing one size that are tried from every partial total.
WAYS = 600


def _ways(count: int, share_test: float, share_val: float) -> tuple[np.ndarray, bool]:
    """(test, validation) counts tried for a size, nearest to the shares first; and whether all."""
    reach = count if (count + 1) * (count + 2) // 2 <= WAYS else 5
    a0, b0 = round(count * share_test), round(count * share_val)
    pairs = [
        (a, b)
        for a in range(max(0, a0 - reach), min(count, a0 + reach) + 1)
        for b in range(max(0, b0 - reach), min(count - a, b0 + reach) + 1)
    ]
    pairs.sort(key=lambda p: (abs(p[0] - a0) + abs(p[1] - b0), p))
    whole = len(pairs) == (count + 1) * (count + 2) // 2
    return np.array(pairs[: None if whole else WAYS], np.int64).reshape(-1, 2), whole


def _finish(test: np.ndarray, val: np.ndarray, size: int, count: int, goal: tuple[int, int]):
    """Counts of the last size that bring each partial total closest to the goal."""
    found = []
    for up_a in (0, 1):
        a = np.clip((goal[0] - test) // size + up_a, 0, count)
        for up_b in (0, 1):
            b = np.clip((goal[1] - val) // size + up_b, 0, count - a)
            found.append((a, b))
            found.append((np.minimum(a, count - np.minimum(b, count)), np.minimum(b, count)))
    # Where the groups do not suffice for both goals, what is missing is shared evenly.
    even = (goal[0] - test - goal[1] + val + count * size) // (2 * size)
    for up in (0, 1):
        a = np.clip(even + up, 0, count)
        found.append((a, count - a))
    return found


def _score(test: np.ndarray, val: np.ndarray, goal: tuple[int, int], total: int) -> np.ndarray:
    """Sort key: absolute, then maximum, then joint error; last when a part is empty."""
    dt, dv = np.abs(test - goal[0]), np.abs(val - goal[1])
    empty = (test <= 0) | (val <= 0) | (test + val >= total)
    return np.lexsort((np.abs(test + val - sum(goal)), np.maximum(dt, dv), dt + dv, empty))


def wide_search(histogram: Histogram, target_test: int, target_val: int) -> tuple[Quota, bool]:
    """(quotas, proven) by partial totals kept side by side, for what the tree does not settle.

    Sizes are dealt from the largest to the smallest;
    every partial total is kept once, and where there are more than the budget allows, those
    nearest to a proportional deal stay. The smallest size is dealt by the difference that is
    left. The result is proven when no partial total and no way of dealing was left out, or
    when the error equals the bound that the common divisor of the sizes sets.
    """
    total = sum(size * count for size, count in histogram.items())
    sizes = sorted((s for s, n in histogram.items() if n > 0), reverse=True)
    goal, limit = (target_test, target_val), sizes[0]
    budget = max(LEAST_CANDIDATES, CANDIDATES // len(sizes))
    keep = budget // 10
    test, val = np.zeros(1, np.int64), np.zeros(1, np.int64)
    trail: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    whole, done = True, 0
    for size in sizes:
        count = histogram[size]
        ways, all_ways = _ways(count, target_test / total, target_val / total)
        parts = [(np.full(len(test), a), np.full(len(test), b)) for a, b in ways.tolist()]
        if size == sizes[-1] and not all_ways:
            parts += _finish(test, val, size, count, goal)
            all_ways = True
        elif len(test) * len(parts) > budget:
            parts, all_ways = parts[: max(9, budget // len(test))], False
        whole &= all_ways
        parent = np.tile(np.arange(len(test)), len(parts))
        a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        new_test, new_val = test[parent] + a * size, val[parent] + b * size
        inside = np.flatnonzero((new_test <= target_test + limit) & (new_val <= target_val + limit))
        order = inside[np.lexsort((new_val[inside], new_test[inside]))]
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(new_test[order]) != 0) | (np.diff(new_val[order]) != 0)
        order = order[first]
        done += size * count
        if len(order) > keep:
            whole = False
            ahead = np.abs(new_test[order] - target_test * done / total)
            ahead += np.abs(new_val[order] - target_val * done / total)
            if size == sizes[-1]:
                ahead = np.abs(new_test[order] - target_test) + np.abs(new_val[order] - target_val)
            order = np.sort(order[np.argsort(ahead, kind="stable")[:keep]])
        trail.append((parent[order], a[order], b[order]))
        test, val = new_test[order], new_val[order]
    at = int(_score(test, val, goal, total)[0])
    if test[at] <= 0 or val[at] <= 0 or test[at] + val[at] >= total:
        raise ValueError("no assignment leaves all three parts non-empty")
    error = abs(int(test[at]) - target_test) + abs(int(val[at]) - target_val)
    divisor = math.gcd(*sizes)
    least = sum(min(g % divisor, -g % divisor) for g in goal)
    quota: Quota = {}
    for size, (parent, a, b) in zip(reversed(sizes), reversed(trail)):
        if a[at] or b[at]:
            quota[size] = (int(a[at]), int(b[at]))
        at = int(parent[at])
    return quota, whole or error == least


def _off_lattice(x: int, divisor: int) -> int:
    """Distance of a remainder from the totals that the sizes left can make, given their divisor."""
    if x < 0:
        return -x
    return min(x % divisor, -x % divisor) if divisor else x


def _candidates(rest: int, size: int, count: int, share: float) -> list[int]:
    """How many groups of a size to give to a part, nearest to its proportional share first.

    More than one group beyond the remainder only moves away from it.
    """
    high = max(0, min(count, rest // size + 1))
    near = min(high, round(count * share))
    return [near] + [a for d in range(1, high + 1) for a in (near - d, near + d) if 0 <= a <= high]


def tree_search(
    histogram: Histogram, target_test: int, target_val: int, budget: int = NODES
) -> tuple[Quota | None, bool]:
    """(quotas, proven) by branch and bound over the sizes, from the largest to the smallest.

    Each size is dealt near its proportional share first. What is left for the smaller sizes
    cannot come closer than their common divisor and their number of rows allow: a branch whose
    bound is not below the best error is cut, a state met before is not opened twice, and the
    search ends when the best error equals the bound of all sizes together.
    """
    sizes = sorted((s for s, n in histogram.items() if n > 0), reverse=True)
    total = sum(s * histogram[s] for s in sizes)
    divisors, rows = [0] * (len(sizes) + 1), [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        divisors[i] = math.gcd(divisors[i + 1], sizes[i])
        rows[i] = rows[i + 1] + sizes[i] * histogram[sizes[i]]

    def bound(i: int, test: int, val: int) -> int:
        """Least error that the sizes from i on can leave of the remainders."""
        least = _off_lattice(test, divisors[i]) + _off_lattice(val, divisors[i])
        return max(least, max(0, test) + max(0, val) - rows[i])

    floor = bound(0, target_test, target_val)
    best: tuple | None = None
    chosen: Quota | None = None
    path: list[tuple[int, int]] = []
    seen: set[tuple[int, int, int]] = set()
    steps: list[Iterator[tuple[int, int]]] = []

    def options(i: int, test: int, val: int) -> Iterator[tuple[int, int]]:
        size, count = sizes[i], histogram[sizes[i]]
        share_test = max(0, test) / rows[i]
        for a in _candidates(test, size, count, min(1.0, share_test)):
            share_val = max(0, val) / max(1, rows[i] - a * size)
            for b in _candidates(val, size, count - a, min(1.0, share_val)):
                yield a, b

    state = [(target_test, target_val)]
    steps.append(options(0, target_test, target_val))
    nodes = 0
    while steps:
        pick = next(steps[-1], None)
        if pick is None:
            steps.pop()
            state.pop()
            if path:
                path.pop()
            continue
        nodes += 1
        if nodes > budget:
            return chosen, False
        i = len(steps) - 1
        test, val = state[-1][0] - pick[0] * sizes[i], state[-1][1] - pick[1] * sizes[i]
        least = bound(i + 1, test, val)
        if best is not None and least > best[0]:
            continue
        if i + 1 == len(sizes):
            error = abs(test) + abs(val)
            used_test, used_val = target_test - test, target_val - val
            if used_test <= 0 or used_val <= 0 or used_test + used_val >= total:
                continue
            score = (error, max(abs(test), abs(val)), abs(test + val))
            if best is None or score < best:
                best = score
                dealt = [*path, pick]
                chosen = {s: p for s, p in zip(sizes, dealt) if p != (0, 0)}
                if error == floor:
                    return chosen, True
            continue
        if (i + 1, test, val) in seen:
            continue
        seen.add((i + 1, test, val))
        path.append(pick)
        state.append((test, val))
        steps.append(options(i + 1, test, val))
    return chosen, True


def _half_sums(moves: list[tuple[int, int, int]]) -> np.ndarray:
    """All sums of size * step, one axis per (size, least step, most steps)."""
    sums = np.zeros((), np.int64)
    for size, low, high in moves:
        sums = np.add.outer(sums, np.arange(low, high + 1, dtype=np.int64) * size)
    return sums


def _closest_moves(moves: list[tuple[int, int, int]], rest: int) -> list[int]:
    """Steps whose sum is closest to ``rest``, by meeting in the middle of the sizes."""
    halves: list[list[int]] = [[], []]
    ways = [1, 1]
    for k, (_, low, high) in enumerate(moves):
        side = 0 if ways[0] <= ways[1] else 1
        if ways[side] * (high - low + 1) <= MIDDLE:
            halves[side].append(k)
            ways[side] *= high - low + 1
    one, two = (_half_sums([moves[k] for k in half]) for half in halves)
    order = np.argsort(one, axis=None, kind="stable")
    ascending = one.ravel()[order]
    wanted = rest - two.ravel()
    at = np.searchsorted(ascending, wanted)
    best = None
    for slot in (np.minimum(at, len(ascending) - 1), np.maximum(at - 1, 0)):
        away = np.abs(ascending[slot] - wanted)
        k = int(away.argmin())
        if best is None or away[k] < best[0]:
            best = (int(away[k]), int(order[slot[k]]), k)
    steps = [0] * len(moves)
    for half, sums, flat in ((halves[0], one, best[1]), (halves[1], two, best[2])):
        for k, place in zip(half, np.unravel_index(flat, sums.shape)):
            steps[k] = moves[k][1] + int(place)
    return steps


def middle_search(histogram: Histogram, target_test: int, target_val: int) -> Quota:
    """A proportional deal whose remainders are settled by a few sizes, one part after the other.

    The smallest sizes move by some groups; two halves of their moves are combined by a search in
    a sorted list, so about ``MIDDLE`` squared combinations are covered.
    """
    total = sum(size * count for size, count in histogram.items())
    sizes = sorted(s for s, n in histogram.items() if n > 0)
    parts: list[dict[int, int]] = [{}, {}]
    for part, target in zip(parts, (target_test, target_val)):
        done = given = 0
        for s in reversed(sizes):  # what rounding left over is carried to the next size
            done += s * histogram[s]
            free = histogram[s] - (parts[0][s] if part is parts[1] else 0)
            part[s] = max(0, min(free, round((done * target / total - given) / s)))
            given += s * part[s]
    reach = math.isqrt(MIDDLE) // 2
    for part, target in zip(parts, (target_test, target_val)):
        other = parts[1] if part is parts[0] else parts[0]
        moves = [(s, -min(part[s], reach), min(histogram[s] - part[s] - other[s], reach)) for s in sizes]
        rest = target - sum(s * n for s, n in part.items())
        for s, step in zip(sizes, _closest_moves(moves, rest)):
            part[s] += step
    return {s: (parts[0][s], parts[1][s]) for s in sizes if parts[0][s] or parts[1][s]}


def solve_quotas(histogram: Histogram, target_test: int, target_val: int) -> tuple[Quota, bool]:
    """(quotas, proven): the closest totals found, and whether nothing can be closer.

    A short tree search settles most histograms at once, a search from the middle most others:
    their error equals the bound that the common divisor of the sizes sets. Then the tree is
    searched on for a proof, and last the wide search looks for something closer. The caller is
    told whether the result is proven.
    """
    total = sum(size * count for size, count in histogram.items())
    if target_test < 1 or target_val < 1:
        raise ValueError("test and validation targets must both be positive")
    if target_test + target_val >= total:
        raise ValueError("the train part would be empty")
    found, proven = tree_search(histogram, target_test, target_val, NODES // 10)
    if not proven:
        divisor = math.gcd(*[s for s, n in histogram.items() if n > 0])
        least = _off_lattice(target_test, divisor) + _off_lattice(target_val, divisor)
        other = middle_search(histogram, target_test, target_val)
        if _error(other, target_test, target_val) == least and _whole(other, total):
            return other, True
        again, proven = tree_search(histogram, target_test, target_val, NODES)
        if proven:
            found = again
        else:
            whole = [q for q in (found, again, other) if q and _whole(q, total)]
            found = min(whole, default=None, key=lambda q: _error(q, target_test, target_val))
    if proven:
        if found is None:
            raise ValueError("no assignment leaves all three parts non-empty")
        return found, True
    other, proven = wide_search(histogram, target_test, target_val)
    if found is None or _error(other, target_test, target_val) < _error(found, target_test, target_val):
        found = other
    return found, proven


def _whole(quota: Quota, total: int) -> bool:
    """All three parts hold something."""
    test = sum(size * a for size, (a, _) in quota.items())
    val = sum(size * b for size, (_, b) in quota.items())
    return test > 0 and val > 0 and test + val < total


def _error(quota: Quota, target_test: int, target_val: int) -> int:
    test = sum(size * a for size, (a, _) in quota.items())
    val = sum(size * b for size, (_, b) in quota.items())
    return abs(test - target_test) + abs(val - target_val)


def fold_quotas(histogram: Histogram, k: int) -> dict[int, list[int]]:
    """Groups of each size per fold: largest first, always to the fold with fewest rows.

    Runs of equal sizes are dealt in bulk: once the loads are within one group of each
    other, whole rounds give every fold one group and keep the order of loads.
    """
    loads = [0] * k
    quotas: dict[int, list[int]] = {}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        dealt = [0] * k
        while left and max(loads) - min(loads) > size:
            # Lift the lowest folds towards the highest in one go.
            low = loads.index(min(loads))
            others = sorted(loads)[1] if k > 1 else loads[0]
            lift = max(1, min(left, (others - loads[low]) // size))
            loads[low] += lift * size
            dealt[low] += lift
            left -= lift
        rounds = left // k
        loads = [load + rounds * size for load in loads]
        dealt = [d + rounds for d in dealt]
        for _ in range(left - rounds * k):
            low = loads.index(min(loads))
            loads[low] += size
            dealt[low] += 1
        quotas[size] = dealt
    return quotas
