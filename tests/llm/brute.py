"""Plain versions of the operators, by their definitions, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix_dedup(docs, length=200):
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256"""
    texts = [(i, (t or "").encode()) for i, t in docs]
    count = defaultdict(int)
    for _, t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] += 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return sorted(out, key=str)


def substring_dedup(docs, width=13):
    """doc_id, n_words, n_removed, kept_sha256"""
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    least = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def near_dedup(docs, width=2, percent=80):
    """doc_id, n_shingles, component_id"""
    sets = [(i, shingles(t, width)) for i, t in docs]
    root = {k: k for k in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for k, (_, s) in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for other in holders[g]:
                both[other] += 1
        for other, n in both.items():
            if other < k and 100 * n >= percent * (len(s) + len(sets[other][1]) - n):
                a, b = sorted((find(k), find(other)))
                root[b] = a
    group = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        group[find(k)].append(i)
    return sorted(((i, len(s), min(group[find(k)])) for k, (i, s) in enumerate(sets)), key=str)


def decontaminate(docs, items, width=13):
    """doc_id, n_words, n_hit, items"""
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(item)
    sizes = {len(g) for g in windows}
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def known_secrets(text):
    """kind:start:end of the base spans"""
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def quality_kept(text):
    """Whether the default quality rules keep a text."""
    import unicodedata

    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    seen = defaultdict(list)
    for k in range(len(words) - 4):
        seen[tuple(words[k : k + 5])].append(k)
    repeated = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    kinds = [unicodedata.category(c) for c in text]
    letters, upper = sum(k[0] == "L" for k in kinds), kinds.count("Lu")
    return not (
        len(words) < 10
        or 100 * len(repeated) > 20 * len(words)
        or 10 * sum(c in "#*$%&|<>" for c in text) > chars
        or 2 * (len(lines) - len(set(lines))) > text.count("\n") + 1
        or 2 * upper > letters + 10
        or 2 * letters < chars
    )
