"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

SPACE = rb"[^\x20\x09-\x0D]+"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def spaced(text):
    return re.findall(SPACE, (text or "").encode())


def order(i):
    return i is None, i or 0


def substring_dedup(docs, n=13):
    first = {}
    for i, text in sorted(docs, key=lambda d: order(d[0])):
        w = spaced(text)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, text in docs:
        w, gone = spaced(text), set()
        for k in range(len(w) - n + 1):
            if order(first[tuple(w[k : k + n])]) < order(i):
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def suffix_dedup(docs, n=400):
    digest = lambda w: hashlib.blake2b(w, digest_size=16).digest()
    seen = Counter(digest(b[k : k + n]) for _, t in docs for b in [(t or "").encode()] for k in range(len(b) - n + 1))
    out = []
    for i, t in docs:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - n + 1):
            if seen[digest(b[k : k + n])] > 1:
                gone.update(range(k, k + n))
        spans = sum(k - 1 not in gone for k in gone)
        out.append((i, len(b), len(gone), spans, sha(bytes(x for k, x in enumerate(b) if k not in gone))))
    return out


def line_dedup(docs, n=3):
    """docs with different ids only."""
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: order(d[0])):
        ls, gone = (t.split("\n") if t else []), set()
        for k in range(len(ls) - n + 1):
            if tuple(ls[k : k + n]) in seen:
                gone.update(range(k, k + n))
            seen.add(tuple(ls[k : k + n]))
        out.append((i, len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone) if gone else t))
    return out


def shingles(t, n):
    w = spaced(t)
    return frozenset([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])


def jaccard(docs, threshold=0.8, n=5):
    sets, links, up = defaultdict(list), Counter(), {}
    for i, t in docs:
        if s := shingles(t, n):
            sets[s].append(i)
    name = {s: min((i for i in v if i is not None), default=None) for s, v in sets.items()}

    def find(s):
        while s in up:
            s = up[s]
        return s

    for a, b in combinations(sets, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
            if find(a) != find(b):
                up[find(a)] = find(b)
    groups = defaultdict(list)
    for s, ids in sets.items():
        groups[find(s)] += [i for i in ids if i is not None]
    out = []
    for i, t in docs:
        s = shingles(t, n)
        out.append((i, name[s], len(sets[s]), links[s], min(groups[find(s)], default=None)) if s else (i, i, 1, 0, i))
    return out


def decontaminate(docs, items, n=10):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(str(item) if item is not None else "")
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def clause_patterns(words, symbol, g):
    """The toxicity patterns of one clause, found by looking around each word."""
    s, out = [symbol(w) for w in words], []
    for k, x in enumerate(s):
        phrase = k >= 2 and s[k - 2 : k] == [g.MEASURE, g.LINK]
        before = s[max(0, k - g.REACH) : k]
        if x == g.INSULT:
            kind = "strong_insult" if phrase or (k and s[k - 1] == g.STRESS) else "insult"
        elif x == g.REFUSE and phrase:
            kind = "strong_insult"
        elif x == g.THREAT:
            kind = "threat" if g.INTENTION in before else "violence"
        else:
            continue
        aimed = g.TARGET in before + s[k + 1 : k + 1 + g.REACH]
        out.append(kind + "_at_target" * aimed + ("_reported" if g.REPORT in s[:k] else "_negated" if g.NEGATION in before else ""))
    return out
