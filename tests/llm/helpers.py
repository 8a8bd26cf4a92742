"""Small documents with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import re

AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one two three"),
    (5, "one two three"),
    (6, "ONE two  three"),
    (7, "a" * 30_000),
    (8, "The quick brown fox jumps over the lazy dog, again and again and again."),
    (9, "é中文 ½² don't \x00 stop<|endoftext|> 12 345"),
    (None, "no id here"),
]


def spaced(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", _lower(text or "")) if w]


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text or ""))


def _lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingles(text, width=5):
    words = spaced(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def components(texts):
    """Smallest id reachable over links of similarity 0.85, by comparing sets that share a shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d in sorted(texts):
        common = collections.Counter(o for s in sets[d] for o in holders[s])
        for o, n in common.items():
            if 100 * n >= 85 * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: find(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def hits(text, items, width=13):
    """Marked word positions and the positions in ``items`` of items that occur."""
    words = plain(text)
    marked, found = set(), set()
    for n, item in enumerate(items):
        held = plain(item)
        if not held:
            continue
        k = min(width, len(held))
        windows = {tuple(held[s : s + k]) for s in range(len(held) - k + 1)}
        for s in range(len(words) - k + 1):
            if tuple(words[s : s + k]) in windows:
                marked.update(range(s, s + k))
                found.add(n)
    return words, marked, found


def without_hits(text, items):
    """The text without marked stretches, cut again until none is left."""
    while True:
        _, marked, _ = hits(text, items)
        if not marked:
            return text
        spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        out, at = [], 0
        for k in sorted(marked):
            if k - 1 not in marked:
                out.append(text[at : spots[k][0]])
            at = spots[k][1]
        text = "".join(out) + text[at:]


SECRETS = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets(text):
    found = [
        (m.start(), k, m.end())
        for k, (_, pattern, group, least) in enumerate(SECRETS)
        for m in pattern.finditer(text or "")
        if len(m.group(group)) >= least
    ]
    return [(SECRETS[k][0], a, b) for a, k, b in sorted(found)]
