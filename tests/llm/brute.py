"""Plain versions of operators, for small tables."""

import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1))))


def jaccard_classes(rows, threshold=0.8):
    """{doc_id: (class, links)} of rows of (doc_id, text) with ids that differ."""
    sets = [(i, shingles(t)) for i, t in rows]
    label, links = {i: i for i, _ in sets}, {i: 0 for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if (not a and not b) or (both and both >= threshold * (len(a) + len(b) - both) - 1e-9):
                links[i] += 1
                links[j] += 1
                r, s = root(i), root(j)
                label[max(r, s)] = min(r, s)
    return {i: (root(i), links[i]) for i, _ in sets}


def repeats(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)} of rows of (doc_id, text), ids that differ."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        drop = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                drop[p : p + length] = b"\1" * length
            else:
                seen.add(s)
        spans = len([1 for p in range(len(data)) if drop[p] and not (p and drop[p - 1])])
        out[i] = (len(data), sum(drop), spans, bytes(b for b, d in zip(data, drop, strict=True) if not d))
    return out


def plain(rows, columns):
    """Rows of two engines made comparable: columns by name, values as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return "null" if v is None else f"{float(v):.4f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def fingerprint(text, least=3, length=64):
    """Context-triggered pieces by a loop over the bytes."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    data = text.encode()
    hashes = []
    for e in range(len(data)):
        h = sum(data[e - k] * 0x01000193**k for k in range(7) if e >= k) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        hashes.append(h ^ h >> 13)

    def signature(block, most):
        out, at = "", 0
        for e, h in enumerate(hashes):
            if h % block == block - 1 and len(out) < most - 1:
                out += alphabet[zlib.crc32(data[at : e + 1]) & 63]
                at = e + 1
        return out + (alphabet[zlib.crc32(data[at:]) & 63] if at < len(data) else "")

    block = least
    while block * length < len(data):
        block *= 2
    while block > least and sum(h % block == block - 1 for h in hashes) < length // 2:
        block //= 2
    return f"{block}:{signature(block, length)}:{signature(2 * block, length // 2)}"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def likeness(a, b, run=7):
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0

    def alike(x, y):
        shorter = min(len(x), len(y))
        if not shorter:
            return 0.0
        near = 1 - edits(x, y) / max(len(x), len(y))
        if shorter < run:
            return near * shorter / run
        return near if any(x[i : i + run] in y for i in range(len(x) - run + 1)) else 0.0

    (p, x1, x2), (q, y1, y2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    return max(alike(x1, y1), alike(x2, y2)) if p == q else alike(x1, y2) if p == 2 * q else alike(x2, y1) if q == 2 * p else 0.0


def gram_buckets(text, bits=18, sizes=(3, 4, 5)):
    """The buckets of the n-grams of a text's lower-cased bytes between two spaces."""
    data, out = f" {(text or '').lower()} ".encode(), set()
    for n in sizes:
        for i in range(len(data) - n + 1):
            h = 0
            for c in data[i : i + n]:
                h = (h * 0x100000001B3 + c) % 2**64
            out.add((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - bits)
    return out


def toxic_ratios(rows, smooth=1.0):
    """{bucket: (log-count ratio, separation)} of rows of (text, toxic), of buckets in three rows."""
    n1, n0, counts = sum(t for _, t in rows), sum(1 - t for _, t in rows), {}
    for text, toxic in rows:
        for b in gram_buckets(text):
            counts.setdefault(b, [0, 0])[toxic] += 1
    out = {}
    for b, (c0, c1) in counts.items():
        if c0 + c1 >= 3:
            p0, p1, p = (c0 + smooth) / (n0 + 2 * smooth), (c1 + smooth) / (n1 + 2 * smooth), (c0 + c1) / (n0 + n1)
            out[b] = math.log(p1 / p0), abs(p1 - p0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    return out


def toxic_score(text, model):
    total = model.intercept + sum(model.weight[model.number[b]] for b in gram_buckets(text) if model.number[b] >= 0)
    return 1 / (1 + math.exp(-total))


def targets(sizes, cycle=(3, 1, 2), share=1.5, cap=2.0):
    """{source: target words} of {source: words}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: cycle[i % 3] for i, s in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = (left - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in names}
        full |= set(over)
