"""A plain version of the adaptive tree cut, merge by merge over a whole distance matrix, to measure the engine's against."""

import math

import numpy as np

SHARES = (0.64, 0.73, 0.82, 0.91, 0.95)


def average_linkage(d):
    """Merges (left, right, height) in the order of height; merge k makes node n + k."""
    n = len(d)
    dist = {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n)}
    size, alive, out = dict.fromkeys(range(n), 1), set(range(n)), []
    while len(alive) > 1:
        (a, b), h = min(dist.items(), key=lambda e: (e[1], e[0]))
        node = n + len(out)
        alive -= {a, b}
        for c in alive:
            x, y = dist.pop((min(a, c), max(a, c))), dist.pop((min(b, c), max(b, c)))
            dist[c, node] = (size[a] * x + size[b] * y) / (size[a] + size[b])
        del dist[a, b]
        size[node] = size[a] + size[b]
        alive.add(node)
        out.append((a, b, h))
    return out


class Branch:
    def __init__(self, members):
        self.members, self.basics, self.top = list(members), None, None  # basics: of a composite branch


def adaptive_cut(d, min_size, deep_split=2):
    """A cluster number (0 for none) for each item."""
    n, merges = len(d), average_linkage(d)
    heights = [h for _, _, h in merges]
    ref = heights[max(0, round(0.05 * len(heights)) - 1)]
    cut = 0.99 * (heights[-1] - ref) + ref
    share = float(np.interp(deep_split, range(5), SHARES))
    most, gap = ref + share * (cut - ref), (1 - share) * 0.75 * (cut - ref)
    below = [m for m in enumerate(merges) if m[1][2] <= cut]
    if len(below) < min_size:
        return np.zeros(n, int)

    def scatter(b):
        base = min_size / 2 + 1
        k = len(b.members) if len(b.members) <= base else math.floor(base + math.sqrt(len(b.members) - base))
        core = d[np.ix_(b.members[:k], b.members[:k])]
        return core.sum() / (k * (k - 1)) if k > 1 else 0.0

    fails = lambda b, h: b.basics is None and (len(b.members) < min_size or scatter(b) > most or h - scatter(b) < gap)
    branch, basics = {}, []
    for k, (a, b, h) in below:
        x, y = branch.pop(a, a), branch.pop(b, b)
        if not isinstance(x, Branch) and not isinstance(y, Branch):
            made = Branch([x, y])
            basics.append(made)
        elif not isinstance(x, Branch) or not isinstance(y, Branch):
            made, item = (x, y) if isinstance(x, Branch) else (y, x)
            if made.basics is None:
                made.members.append(item)
        else:
            small, large = sorted((x, y), key=lambda s: len(s.members))
            if fails(small, h) or fails(large, h):
                gone, made = (small, large) if fails(small, h) else (large, small)
                basics.remove(gone)
                if made.basics is None:
                    made.members += gone.members
            else:
                made = Branch(small.members + large.members)
                made.basics = [s for one in (small, large) for s in (one.basics or [one])]
                for s in (small, large):
                    if s.basics is None:
                        s.top = h
        branch[n + k] = made
    label, number = np.zeros(n, int), 0
    for b in basics:
        s = scatter(b)
        if len(b.members) >= min_size and s < most and (b.top or cut) - s > gap:
            number += 1
            label[b.members] = number
    # items that are left go to the nearest cluster, if they are nearer than its diameter or the cut
    fixed = label.copy()
    for i in np.flatnonzero(fixed == 0) if number else []:
        mean = [d[i, fixed == c].mean() for c in range(1, number + 1)]
        c = int(np.argmin(mean)) + 1
        own = d[np.ix_(fixed == c, fixed == c)]
        if mean[c - 1] < max(cut, own.sum(1).max() / (len(own) - 1)):
            label[i] = c
    return label


def agreement(a, b):
    """The adjusted Rand index of two labellings."""
    table = np.zeros((max(a) + 1, max(b) + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, rows, columns, total = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    chance = rows * columns / total
    return 1.0 if rows == columns == chance else (both - chance) / ((rows + columns) / 2 - chance)
