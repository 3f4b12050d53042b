"""Plain Python versions of the operators' contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(int(c) for c in digits[::-1])) % 10 == 0


def digits(x):
    return re.sub("[^0-9]", "", x)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m.group())) <= 15),
]
SECRETS = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]


def spans(text, kinds):
    found = sorted((m.start(), r, m.end(), k) for r, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def windows(items, n=10):
    out = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            out[tuple(w[k : k + n])].add(i)
    return out


def contamination(text, wins):
    w, hit, items = words(text), set(), set()
    for size in {len(k) for k in wins}:
        for k in range(len(w) - size + 1):
            if found := wins.get(tuple(w[k : k + size])):
                hit |= set(range(k, k + size))
                items |= found
    return len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)


def fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Sets:
    def __init__(self, names):
        self.parent = {n: n for n in names}

    def root(self, a):
        while self.parent[a] != a:
            a = self.parent[a]
        return a

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def components(prints, radius=4):
    """``prints``: id -> fingerprint; id -> smallest id reachable."""
    ids = sorted(prints)
    arr, sets = np.array([prints[i] for i in ids], dtype=np.uint64), Sets(ids)
    for a in range(len(ids)):
        for b in np.nonzero(np.bitwise_count(arr[a] ^ arr[a + 1 :]) <= radius)[0]:
            sets.join(ids[a], ids[a + 1 + b])
    return {i: sets.root(i) for i in ids}


def unigram(texts):
    """``texts``: id -> text; id -> (held out, tokens, known, N, score)."""
    toks = {i: (t or "").encode().lower().split() + [b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i in toks if not held[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    return {
        i: (held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in toks.items()
    }


def near_lines(lines, shingle=7, limit=0.8):
    sets = [{x[k : k + shingle] for k in range(max(1, len(x) - shingle + 1))} for x in lines]
    out = []
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            common = len(sets[i] & sets[j])
            if common >= limit * (len(sets[i]) + len(sets[j]) - common):
                out.append((i, j))
    return out
