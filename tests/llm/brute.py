"""Plain single-machine versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def grouped(n, pairs):
    """Smallest member's number of each item's group."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def jaccard_links(texts, threshold=0.8):
    sets, holders = [shingles(t) for t in texts], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                yield i, j


def repeats_removed(texts, window=35):
    every = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    for w in every:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        yield len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def quality_counts(text):
    w, text = words(text), text or ""
    threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()]
    twice = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[::-2]) + sum(twice)) % 10 == 0


def personal_data(text):
    digits = lambda s: sum(c.isdigit() for c in s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= digits(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= digits(s) <= 15),
    ]
    for kind, pattern, check in kinds:
        for m in re.finditer(pattern, text or ""):
            if check(m.group()):
                yield kind, m.start(), m.end()


def language_model(rows, order, prior):
    """(doc, held out, tokens, known, training tokens, base, score) of every (doc, text)."""
    lower, counts, every = str.maketrans(string.ascii_uppercase, string.ascii_lowercase), [Counter() for _ in range(order + 1)], []
    for doc, text in rows:
        seq = [1, *words((text or "").translate(lower)), 2]
        held = zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2
        every.append((doc, held, seq))
        if not held:
            for k in range(1, order + 1):
                counts[k].update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
    single = {k[0]: n for k, n in counts[1].items() if k != (1,)}
    total, types = sum(single.values()), len(single)

    def p(context, w):
        if not context:
            return (single.get(w, 0) + 1) / (total + types + 1)
        n = counts[len(context)][context]
        return (counts[len(context) + 1][(*context, w)] + prior * p(context[1:], w)) / (n + prior) if n else p(context[1:], w)

    for doc, held, seq in every:
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        yield doc, held, len(seq) - 1, sum(w in single for w in seq[1:]), total, base, score


def spans(tokens):
    at = 0
    for t in tokens:
        yield at, at + len(t)
        at += len(t)


def alignment(rows, encode_a, encode_b):
    """(doc, a, b, groups, links, best, sum, digest); the encoders give (id, bytes) of each token of a text."""
    out, counts = [], Counter()
    for doc, text in rows:
        a, b, wanted = encode_a(text or ""), encode_b(text or ""), (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in x) != wanted for x in (a, b)):
            out.append((doc, [], [], [], []))
            continue
        at_a, at_b = list(spans([t for _, t in a])), list(spans([t for _, t in b]))
        links = [(a[i][0], b[j][0]) for i, (p, q) in enumerate(at_a) for j, (r, s) in enumerate(at_b) if p < s and r < q]
        cuts = sorted({q for _, q in at_a} & {s for _, s in at_b})
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            sides = [[str(x[i][0]) for i, (p, q) in enumerate(at) if low <= p and q <= high] for x, at in ((a, at_a), (b, at_b))]
            groups.append(",".join(sides[0]) + "|" + ",".join(sides[1]))
        counts.update(links)
        out.append((doc, a, b, groups, links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    for doc, a, b, groups, links in out:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best, total = sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)
        yield doc, len(a), len(b), len(groups), len(links), best, total, digest


def hard_negatives(rows):
    """(anchor, positive, rank, negative, positive score, negative score) of (vec_id, components, label) rows, in order."""
    kept = []
    for i, (vec, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        moved = (label + 1) % 10 if vec is not None and vec % 7 == 0 else label
        kept.append((i, vec, moved, [math.floor(256 * c) for c in x]))
    for i, vec, label, x in kept:
        if vec is None or vec % 100:
            continue
        met = [(-sum(p * q for p, q in zip(x, y, strict=False)), w is None, w or 0, j, w, m) for j, w, m, y in kept if j != i]
        met.sort(key=lambda r: r[:4])
        for p in [r for r in met if r[5] == label][:5]:
            window = [r for r in met if r[5] != label and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0]]
            for rank, r in enumerate(window[:10], 1):
                yield vec, p[4], rank, r[4], -p[0], -r[0]
