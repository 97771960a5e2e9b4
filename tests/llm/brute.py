"""Plain versions of the operators, for small inputs."""

import math
import re


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def joined(nodes, links):
    """The least node that each node reaches."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def jaccard_classes(rows, percent=90):
    sets = {i: shingles(t) for i, t in rows}
    ids, links = sorted(sets), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in joined(ids, links).items()}


def kept_bytes(rows, length=100):
    """doc_id -> (bytes, removed, runs, kept) by looking up every window."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            else:
                seen[w] = (i, p)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g))
    return out


BASE_PATTERNS = (
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"()(AKIA[A-Z0-9]+)", 18),
    ("hex", r"()([0-9a-f]+)", 16),
)


def base_secrets(text):
    """(start, kind, end) of the three fixed kinds, as the contract words them."""
    found = [(m.start(), k, m.end()) for k, (_, p, least) in enumerate(BASE_PATTERNS) for m in re.finditer(p, text) if len(m[2]) >= least]
    return sorted(found)


def entropy_runs(text, candidate, inner, classes, allowed, width):
    """Spans of high entropy by looking at every window and every allowed string."""
    out = []
    for m in candidate.finditer(text):
        s = m[0]
        if "://" in text[max(0, m.start() - 8) : m.start()]:
            continue
        covered = set()
        for at, part in [(0, s), *((x.start(), x[0]) for x in inner.finditer(s))]:
            least = next(c[2] for c in classes if c[1].fullmatch(part))
            for i in range(len(part) - width + 1):
                w = part[i : i + width]
                bits = -sum(w.count(c) / width * math.log2(w.count(c) / width) for c in set(w))
                places = [(p, p + len(a)) for a in allowed for p in range(len(s)) if s.startswith(a, p)]
                if bits >= least - 1e-9 and not any(a < at + i + width and at + i < b for a, b in places):
                    covered |= set(range(m.start() + at + i, m.start() + at + i + width))
        runs = sorted(covered)
        starts = [i for i in runs if i - 1 not in covered]
        out += [(a, 3, next(i for i in range(a, len(text) + 1) if i not in covered)) for a in starts]
    return out
