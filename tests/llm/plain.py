"""Brute-force versions of what the operators compute, one document or pair at a time."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(rows, size, percent):
    """{id: (set size, smallest linked id)} by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def exact(rows):
    """{id: (keep, size, kept, sha)} for distinct ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for plain, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(plain.encode()).hexdigest())
    return out


def targets(sizes):
    """{source: target} from {source: tokens}: weights 5, 2, 1 in turn, stop at three times the size, share out the rest."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in rest)
        got = {s: left * weight[s] / w for s in rest}
        over = [s for s in rest if got[s] > 3 * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: 3.0 * sizes[s] for s in over}


def least_capacity(groups, shards):
    """Smallest capacity of contiguous shards over ordered group sizes, by trying."""
    low, high = max(groups, default=0), sum(groups)
    while low < high:
        mid = (low + high) // 2
        used, at = 1, 0
        for g in groups:
            if at + g > mid:
                used, at = used + 1, 0
            at += g
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def base_spans(text):
    """The plain rules of the secret scan on a string, span by span."""
    text = text or ""
    out = []
    kinds = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", r"AKIA[A-Z0-9]+"),
        ("hex", r"[0-9a-f]+"),
    )
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= (8, 16, 32)[k]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def without_repeats(pages, run=8, least=3):
    """Texts of one host's pages, each (id, blocks), without windows of ``run`` tokens on other pages and short blocks on ``least``."""
    on = {}
    for i, blocks in pages:
        for words in map(str.split, blocks):
            for k in range(max(len(words) - run + 1, 1)):
                on.setdefault(tuple(words[k : k + run]), set()).add((i, " ".join(blocks)))
    n = {k: min(len({i for i, _ in v}), len({s for _, s in v})) for k, v in on.items()}
    out = []
    for _, blocks in pages:
        kept = []
        for words in map(str.split, blocks):
            if len(words) < run:
                kept += [" ".join(words)] * (n[tuple(words)] < least)
                continue
            gone = {k + j for k in range(len(words) - run + 1) if n[tuple(words[k : k + run])] > 1 for j in range(run)}
            kept.append(" ".join(w for j, w in enumerate(words) if j not in gone))
        out.append("\n".join(k for k in kept if k))
    return out


def rates(sizes, target, cap=3.0):
    """min(cap, exp(x * size)) with the x that brings the words of one source to its target, by bisection."""
    total = sum(sizes)
    if not total:
        return [0.0] * len(sizes)
    if target >= cap * total * (1 - 1e-12):
        return [cap] * len(sizes)
    rate = lambda x, n: cap if x * n > 700 else min(cap, math.exp(x * n))
    lo, hi = -50.0, 50.0
    for _ in range(200):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if sum(n * rate(x, n) for n in sizes) < target else (lo, x)
    return [rate(hi, n) for n in sizes]
