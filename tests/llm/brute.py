"""Plain versions of the operators over lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter


def low(text):
    return (text or "").encode().lower()


def exact(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(low(t), []).append(k)
    return sorted(((k, max(m), len(m), k == max(m), hashlib.sha256(x).hexdigest()) for x, m in groups.items() for k in m), key=str)


def shingles(text, n):
    w = low(text).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(rows, words, percent):
    sets = [(k, shingles(t, words)) for k, t in rows]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[top(i)] = min(k, least.get(top(i), k))
    return sorted((k, len(s), least[top(i)], k == least[top(i)]) for i, (k, s) in enumerate(sets))


BASE = ((r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "assign"), (r"AKIA[A-Z0-9]+", "access"), (r"[0-9a-f]+", "hex"))


def secrets(text):
    found = []
    for order, (pattern, kind) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            if len(m[2 if kind == "assign" else 0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), order, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(found)]


def linked(text, patterns, reach=160):
    """All spans of a text, the weak parts by looking at every pair of parts. `patterns` are those of
    names, mixed tokens and endpoints."""
    meets = lambda s, lo, hi: s[0] < hi and s[1] > lo
    base = secrets(text)
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    parts = {"name": [(m.start(1), m.end(1), "name") for m in patterns[0].finditer(text)]}
    parts |= {k: [(m.start(), m.end(), k) for m in p.finditer(text)] for k, p in (("mixed", patterns[1]), ("endpoint", patterns[2]))}
    held = list(base)
    for kind in ("name", "mixed", "endpoint"):
        parts[kind] = [s for s in parts[kind] if not any(meets(x, s[0], s[1]) for x in held)]
        held += parts[kind]
    ids = [s for s in base if s[2] == "access"] + parts["name"]
    keys = [s for s in base if s[2] != "access"] + parts["mixed"]

    def near(span, others):
        lo = max([span[0] - reach, 0, *(b for b in breaks if b <= span[0])])
        hi = min([span[1] + reach, len(text), *(b for b in breaks if b > span[0])])
        return any(meets(x, lo, hi) for x in others)

    weak = [s for s in parts["name"] if near(s, keys)] + [s for s in parts["mixed"] if near(s, ids)] + [s for s in parts["endpoint"] if near(s, ids) and near(s, keys)]
    order = ["assign", "access", "hex", "name", "mixed", "endpoint"]
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + weak, key=lambda s: (s[0], order.index(s[2]))))


def language(net, text, window=256, filters=((2, 8), (3, 12), (4, 12))):
    """Label and score of a text, window by window, position by position, filter by filter."""
    raw, pad = text.encode(), net.embed.shape[0] - 1
    total = [0.0] * len(net.labels)
    for lo in range(0, len(raw), window):
        piece = [*raw[lo : lo + window], *[pad] * (window - len(raw[lo : lo + window]) + 3)]
        hidden, at = [], 0
        for width, n in filters:
            for f in range(at, at + n):
                most = max(sum(float(net.embed[piece[i + k]] @ net.filters[k][:, f]) for k in range(width)) for i in range(window))
                hidden.append(max(most + float(net.bias[f]), 0.0))
            at += n
        z = [sum(h * float(net.dense[i][c]) for i, h in enumerate(hidden)) + float(net.shift[c]) for c in range(len(net.labels))]
        e = [math.exp(x - max(z)) for x in z]
        for c, x in enumerate(e):
            total[c] += x / sum(e) * len(raw[lo : lo + window])
    best = max(range(len(total)), key=total.__getitem__)
    return net.labels[best], total[best] / len(raw)


def removed(rows, units, window):
    """Per row, in order: flags of the units that a window covers which a smaller identifier has."""
    first, whole = {}, [(k, units(t)) for k, t in rows]
    for k, u in whole:
        for i in range(len(u) - window + 1):
            key = bytes(u[i : i + window]) if isinstance(u, bytes) else tuple(u[i : i + window])
            first[key] = min(k, first.get(key, k))
    out = []
    for k, u in whole:
        flags = [False] * len(u)
        for i in range(len(u) - window + 1):
            key = bytes(u[i : i + window]) if isinstance(u, bytes) else tuple(u[i : i + window])
            if first[key] < k:
                flags[i : i + window] = [True] * window
        out.append((k, u, flags))
    return out


def leaks(rows, items, width=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for name, t in items:
        w = words(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for k, t in rows:
        w, ids = words(t), set()
        flags = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    ids |= found
                    flags[i : i + n] = [True] * n
        out.append((k, len(w), sum(flags), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(flags)))
    return sorted(out)


def kneser_ney(rows, folds=5, fold=1):
    """Per row: identifier, tokens, known, training tokens, base score, score."""
    texts = [(k, [*low(t).split(), None]) for k, t in rows]
    train = [t for k, t in texts if zlib.crc32(str(k).encode()) % folds != fold]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([0, *t], t, strict=False))

    def discounts(values):
        n = [sum(1 for v in values if v == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
        return [0, *(min(max(x, 0.01), k) for k, x in enumerate(d, 1))]

    total, mass = Counter(), Counter()
    d = discounts(pairs.values())
    for (v, _), c in pairs.items():
        total[v] += c
        mass[v] += d[min(c, 3)]
    follows = Counter(w for _, w in pairs)
    e, s = discounts(follows.values()), sum(follows.values())
    spare = sum(e[min(c, 3)] for c in follows.values()) / s / (len(follows) + 1) if s else 1.0

    def p(v, w):
        lower = (follows[w] - e[min(follows[w], 3)]) / max(s, 1) + spare
        return ((pairs[v, w] - d[min(pairs[v, w], 3)]) + mass[v] * lower) / total[v] if total[v] else lower

    n, size = sum(count.values()), len(count)
    return [(k, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (size + 1))) for w in t), sum(math.log10(p(v, w)) for v, w in zip([0, *t], t, strict=False))) for k, t in texts]


def mix_targets(sizes, share=1.5, most=2.0):
    """Target of each source by sharing again and again."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        unit = left / sum(weight[k] for k in free) if free else 0
        over = [k for k in free if weight[k] * unit > most * sizes[k]]
        if not over:
            return fixed | {k: weight[k] * unit for k in free}
        for k in over:
            fixed[k] = most * sizes[k]
            left -= fixed[k]
