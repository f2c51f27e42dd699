"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return (text or "").encode().split()


def shingle_set(text, k=5):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(docs, percent=75):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def substring(docs, length=50):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    first, rows = {}, sorted((d, words(t)) for d, t in docs)
    for d, w in rows:
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i:i + length]), d)
    out = {}
    for d, w in rows:
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < d:
                keep[i:i + length] = [False] * length
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def repeated_lines(docs, percent=75):
    """{doc_id: [line numbers]} of lines that match an earlier one."""
    earlier, out = [], defaultdict(list)
    for d, text in sorted(docs):
        for at, line in enumerate((text or "").split("\n")):
            w = [x for x in re.split("[\x20\x09-\x0d]+", line.lower()) if x]
            if not w:
                continue
            s = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
            if any(100 * len(s & e) >= percent * len(s | e) for e in earlier):
                out[d].append(at)
            earlier.append(s)
    return out


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    found = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if found[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def base_secrets(text):
    """Spans (start, kind, end) of the base patterns."""
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return sorted([(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
                  + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
                  + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])
