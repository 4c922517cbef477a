"""Plain restatements of what the operators must give, for small inputs."""

import re
from collections import Counter, defaultdict

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def measures(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def deleted_lines(rows, min_words):
    """rows in order of (id, ...); the lines each loses to a longer earlier run."""
    ids, seq = {}, []
    for n, (_, text) in enumerate(rows):
        for p, line in enumerate(text.split("\n")):
            seq.append((ids.setdefault(line, len(ids)), n, p, len(WORD.findall(line))))
    where, out = defaultdict(list), defaultdict(set)
    for x, (a, n, p, _) in enumerate(seq):
        best = 0
        for y in where[a]:
            k = 0
            while x + k < len(seq) and seq[x + k][1] == n and seq[y + k][1] == seq[y][1] and seq[x + k][0] == seq[y + k][0]:
                k += 1
            best = max(best, k)
        if best and sum(s[3] for s in seq[x : x + best]) >= min_words:
            out[n] |= set(range(p, p + best))
        where[a].append(x)
    return [sorted(out[n]) for n in range(len(rows))]


def components(rows, n, num, den):
    """id -> (set size, least id reachable)."""
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = list(sets.items())
    for a, (i, s) in enumerate(items):
        for j, t in items[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
