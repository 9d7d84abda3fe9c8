"""Plain-Python versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    found = WORD.findall(text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found] if lower else found


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near(rows, k, per_cent):
    """{(doc_id, text): (n_shingles, component_id)} by all pairs that share a shingle."""
    sets = {r: shingle_set(r[1], k) for r in rows}
    posts = defaultdict(list)
    for r, s in sets.items():
        for x in s:
            posts[x].append(r)
    parent = {r: r for r in sets}

    def root(r):
        while parent[r] != r:
            r = parent[r]
        return r

    shared = Counter()
    for own in posts.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for r in sets:
        groups[root(r)].append(r[0])
    return {r: (len(s), min((i for i in groups[root(r)] if i is not None), default=None) if s else r[0]) for r, s in sets.items()}


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text, False)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + d for i, x in enumerate(windows) if seen[x] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def line_dedup(rows):
    """{doc_id: (text, n_lines, n_removed)}; doc_ids are distinct."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:]):
            key = (a[1], b[1], c[1])
            if key in seen:
                gone.update(range(a[0], c[0] + 1))
            seen.add(key)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def tiling(item, text, least):
    """Greedy string tiling without hashing: mark the longest unmarked common run until none is left."""
    free_p, free_t, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and free_p[p + n] and free_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return covered
        free_p[p : p + n] = free_t[t : t + n] = [False] * n
        covered += n
