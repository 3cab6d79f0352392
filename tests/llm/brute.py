"""Plain versions of the contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(rows, window=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def near_duplicates(rows, shingle=3, level=90):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            inverted[s].append(d)
    for d in sorted(sets):
        for e, k in Counter(e for s in sets[d] for e in inverted[s] if e > d).items():
            if 100 * k >= level * (len(sets[d]) + len(sets[e]) - k):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (d, len(sets[d]), root(d)) for d in sets}


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def pii_holds(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 10 <= len(d) <= 15 if kind == "phone" else True


def pii(text):
    return sorted((m.start(), r, m.end()) for r, (k, p) in enumerate(PII) for m in re.finditer(p, text or "") if pii_holds(k, m[0]))


def ppm(rows, order=4):
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    low = lambda t: (t or "").encode().lower()
    count, contexts = Counter(), defaultdict(Counter)
    for d, t in rows:
        if not held[d]:
            count.update(low(t).split())
            count[b" "] += 1
            s = b"\0" * order + low(t) + b"\0"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    contexts[s[i - k : i]][s[i]] += 1
    n, v, out = sum(count.values()), len(count), {}
    for d, t in rows:
        toks = [*low(t).split(), b" "]
        s, total = b"\0" * order + low(t) + b"\0", 0.0
        for i in range(order, len(s)):
            gone, p = set(), 1.0
            for k in range(order, -1, -1):
                left = {x: c for x, c in contexts.get(s[i - k : i], {}).items() if x not in gone}
                if not left:
                    continue
                room = sum(left.values()) + len(left)
                if s[i] in left:
                    p *= left[s[i]] / room
                    break
                p *= len(left) / room
                gone |= set(left)
            else:
                p /= 256 - len(gone)
            total += math.log10(p)
        out[d] = (d, held[d], len(toks), sum(count[w] > 0 for w in toks), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks), total)
    return out


def base_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if times[t] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed
