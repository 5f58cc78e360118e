"""Plain versions of conversation repair, personal data and the Merkle manifest."""

import hashlib
import heapq
import re
import zlib

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    """Conversations of (turn, role, text) after the damage."""
    talks = {}
    for conv, turn, role, text in rows:
        kept = talks.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        kept += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return talks


def cheapest(rows, faults):
    """(cost, audit, lines) by uniform-cost search over all edits; of the ways to a state after the same
    rows, the twelve best are followed."""
    heap, tried = [(0, "", 0, "", ())], {}
    while True:
        cost, audit, i, at, lines = heapq.heappop(heap)
        if i == len(rows) and at in ("", "a"):
            return cost, audit, lines
        ways = tried.setdefault((i, at), set())
        if audit in ways or len(ways) >= 12:
            continue
        ways.add(audit)
        if not audit.endswith("III"):
            for x, name in NAMES.items():
                if (at, x) in STEPS:
                    heapq.heappush(heap, (cost + 2, audit + "I", i, STEPS[at, x], (*lines, f"{name}:")))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, at, lines))
        if faults[i] in ("blank", "duplicate"):
            continue
        _, role, text = rows[i]
        more = faults[i] == "truncated"
        if (at, role[:1]) in STEPS:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEPS[at, role[:1]], (*lines, f"{role}:{text}")))
        for x, name in NAMES.items():
            if (at, x) in STEPS:
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, STEPS[at, x], (*lines, f"{name}:{text}")))


def repairs(rows):
    out = []
    for conv, talk in damaged(rows).items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in talk:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(talk, talk[1:], strict=False))
        cost, audit, lines = cheapest(talk, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """The base spans of a text."""
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


_IN = r"""\x20\x09-\x0D:="'()<>\[\],;|"""


def found(texts, rounds=3, seeds=3, confident=0.7, prior=1.0):
    """The spans of each text that contexts add: tokens, patterns and scores with dicts and loops."""
    kinds, slots = list(PERSONAL), []
    squeezed = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", s.lower()).strip(" ")
    for n, text in enumerate(texts):
        text = text or ""
        base = personal(text)
        for kind in [*kinds, None]:
            every = [m.span() for m in re.finditer(PERSONAL[kind] if kind else rf"[^{_IN}]+", text) if kind or re.search("[0-9@]", m[0])]
            for i, (a, b) in enumerate(every):
                lo, hi = every[i - 1][1] if i else 0, every[i + 1][0] if i + 1 < len(every) else len(text)
                before, after = squeezed(text[max(lo, a - 64) : a]).split(" "), squeezed(text[b : min(hi, b + 64)]).split(" ")
                if kind and (kind, a, b) not in base:
                    continue
                if kind is None:
                    a += len(re.match("[^0-9A-Za-z+@]*", text[a:b])[0])
                    b -= len(text[a:b]) - len(re.sub("(?<=[0-9A-Za-z])[^0-9A-Za-z]+$", "", text[a:b]))
                    if b - a > 64 or not re.search("[0-9@]", text[a:b]) or any(x < b and y > a for _, x, y in base):
                        continue
                w2, w1, r1 = (re.sub("[0-9]", "0", w) for w in (before[-2] if len(before) > 1 else "", before[-1], after[0]))
                names = ({f"{w2} {w1} _"} if w2 and w1 else set()) | ({f"{w1} _ {r1}"} if w1 and r1 else set())
                slots.append((n, kind, a, b, text[a:b].lower(), names))
    members, known = {}, {}
    for _, kind, _, _, value, names in slots:
        for p in names:
            members.setdefault(p, {}).setdefault(value, set()).add(kind)
    for p in members:
        for v, ks in members[p].items():
            known.setdefault(v, set()).update(ks - {None})
    score = {v: {k: float(k in ks) for k in kinds} for v, ks in known.items()}
    for step in range(rounds):
        trust = {}
        for p, vs in members.items():
            sums = {k: sum(score[v][k] for v in vs) for k in kinds}
            c = {k: round(s / (len(vs) + prior), 9) if s >= seeds else 0.0 for k, s in sums.items()}
            if max(c.values()) >= confident:
                trust[p] = c
        for v in score:
            if not known[v] and step < rounds - 1:
                for k in kinds:
                    left = 1.0
                    for p in members:
                        if v in members[p] and p in trust and trust[p][k] >= confident:
                            left *= 1 - trust[p][k]
                    score[v][k] = round(1 - left, 9)
    out = [[] for _ in texts]
    for n, kind, a, b, _, names in slots:
        best = max(((trust[p][k], -i) for p in names if p in trust for i, k in enumerate(kinds)), default=None)
        if kind is None and best:
            out[n].append((f"found_{kinds[-best[1]]}", a, b))
    return [sorted(set(s), key=lambda x: (kinds.index(x[0][6:]), x[1])) for s in out]


def joint(hashes):
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def leaf(row):
    return joint("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[f] for f in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(hashes):
    """The top and the path of each: (place in its run, run), from below."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + 8] for i in range(0, len(hashes), 8)]
        for path, a in zip(paths, at, strict=True):
            path.append((a % 8, runs[a // 8]))
        at, hashes = [a // 8 for a in at], [joint(r) for r in runs]
    return hashes[0], paths


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    root, above = tree([trees[x][0] for x in langs]) if langs else (None, [])
    out = []
    for lang, up in zip(langs, above, strict=True):
        top, paths = trees[lang]
        for r, path in zip(groups[lang], paths, strict=True):
            struck = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            h = leaf({**r, "text": r["text"].translate(LOWER)} if struck else r)
            for i, run in path + up:
                h = joint([*run[:i], h, *run[i + 1 :]])
            out.append((r["doc_id"], leaf(r), top, root, joint(x for i, run in path + up for j, x in enumerate(run) if j != i), h, h == root))
    return out
