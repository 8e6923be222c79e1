"""Plain versions of the training-data operators, for small tables."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def components(texts, k, percent):
    """Component number of each text, by comparing all pairs."""
    sets = [shingle_set(t, k) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))], sets


def decontamination(text, items):
    """(words, hit words, ids) of one text against (id, text) items."""
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for name, value in items:
        v = ALNUM.findall((value or "").translate(LOWER))
        k = min(13, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add("null" if name is None else str(name))
    return len(w), len(hit), sorted(ids)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def shares(tree, budget):
    """Budgets of the leaves of ``tree`` (name -> (weight, tokens or subtree)), siblings first."""

    def room(node):
        return sum(room(n) for _, n in node.values()) if isinstance(node, dict) else node

    out = {}

    def fill(node, amount, path):
        if not isinstance(node, dict):
            out[path] = amount
            return
        given, open_ = {}, dict(node)
        while open_:
            rest = amount - sum(given.values())
            total = sum(w for w, _ in open_.values())
            full = {n: room(c) for n, (w, c) in open_.items() if total == 0 or room(c) <= rest * w / total}
            if not full:
                given.update({n: rest * w / total for n, (w, _) in open_.items()})
                break
            given.update(full)
            open_ = {n: x for n, x in open_.items() if n not in full}
        for n, (_, c) in node.items():
            fill(c, given[n], (*path, n))

    fill(tree, min(budget, room(tree)), ())
    return out


def shard_bits(rows, limit, bits=60):
    """Prefix length of each (hash, bytes) row."""
    out = []
    for h, _ in rows:
        for b in range(bits + 1):
            if sum(s for g, s in rows if g >> (bits - b) == h >> (bits - b)) <= limit or b == bits:
                out.append(b)
                break
    return out
