"""Plain versions of the operators' contracts, and awkward rows to try them on."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}

#: Every column clashes with a name that some operator adds.
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, score string, fp string, base string, added string, size string, "
        "row string, n_tokens string, ids string, key string, copy string, component_id string, host string, kept string, margin string, `_t` string")
CLASH = ["x"] * 14


def remainder(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def component_of(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return ["%s:%d:%d" % s for s in out]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_scores(rows):
    """{index: (tokens, known, base)} and training tokens for (doc_id, text) rows."""
    count = Counter()
    for doc_id, text in rows:
        if remainder(doc_id, 7) not in (None, 2):
            count.update(words(text))
            count["\n"] += 1
    total = sum(count.values())
    below = math.log10(total + len(count) + 1)
    out = []
    for _, text in rows:
        w = [*words(text), "\n"]
        out.append((len(w), sum(count[x] > 0 for x in w), sum(math.log10(count[x] + 1) - below for x in w)))
    return out, total


def targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in full]
        left = total - sum(2 * sizes[n] for n in full)
        share = {n: left * weight[n] / sum(weight[f] for f in free) for n in free}
        over = {n for n in free if share[n] > 2 * sizes[n]}
        if not over:
            return {n: 2 * sizes[n] if n in full else share[n] for n in names}
        full |= over


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    plain = "The cat of the house and the dog are in the garden with a bird that sings for them all day. "
    german = "Die Katze und der Hund sind mit dem Vogel in dem Garten, der für alle singt und schön ist. "
    rows = [
        (1, plain * 3, "en", "a"), (2, plain * 3, "en", "a"), (2, plain * 3, "en", "a"), (3, "", "en", "b"), (4, None, "en", None),
        (5, " \t\n", None, "b"), (None, plain * 2, "en", "a"), (None, plain * 2, "en", "a"), (None, None, None, None),
        (6, german * 4, "de", "c"), (7, german * 4 + "Ende", "de", "c"), (8, "x", None, "c"), (9, "1234 !!! 5678", "de", "a"),
        (10, plain * 3000, "en", "a"), (11, "a" * 30000, "en", "d"), (12, "7" * 30000, None, "d"), (13, "mail a.b@c.de, +1 (456) 555-2186; 4111 1111 1111 1111 10.0.0.1 😀 z@y.x", "en", "é"),
        (14, "4111111111111111 300.1.1.1 1.2.3.4.5.6.7.8 a@b.c_d@e.f +12 5 00010.1.1.0001", "en", "é"), (15, "the <|endoftext|> é\x00\u2003 end ", "fr", "Z"),
        (16, german * 5, "de", "c"), (17, plain * 7, "en", "b"), (18, plain * 9 + "zebra", None, "b"), (-5, "Von", "de", ""),
    ]
    return [(i, t, lang, s, None if i == 1 else len(t or ""), *CLASH, "y") for i, t, lang, s in rows]


def unit_vectors(n, dim, rng):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passages(text, size):
    """Features of each passage of ``size`` words, one word after the other."""
    kinds = [b" \t\v\f\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"|",
             b"\"'()[]{}:;-", bytes(range(128, 256))]
    raw = (text or "").encode() + b"\n"
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    found = [bytes(b | 32 for b in raw[a:z]) for a, z in spans]
    out = []
    for lo in range(0, max(1, len(spans)), size):
        own, part = found[lo:lo + size], spans[lo:lo + size]
        begin = part[0][0] if lo else 0
        end = spans[lo + size][0] if lo + size < len(spans) else len(raw)
        piece, n = raw[begin:end], max(1, len(own))
        counts = [sum(piece.count(c) for c in (bytes([b]) for b in kind)) for kind in kinds]
        row = [c / len(piece) for c in [*counts, len(piece) - sum(counts)]]
        row.append(sum(z - a for a, z in part) / n / 10)
        row.append((len(own) - len(set(own))) / n)
        row.append((len(found) - len(set(found))) / max(1, len(found)))
        row.append(sum(lo + i > 0 and found[lo + i - 1] == w for i, w in enumerate(own)) / n)
        row.append(sum(z - a <= 2 for a, z in part) / n)
        row.append(sum(65 <= raw[a] <= 90 for a, _ in part) / n)
        row.append(sum(z - a > 20 for a, z in part) / n)
        row.append(math.log1p(len(own)) / 4)
        out.append(row)
    return out


def attention(rows, mean, scale, w):
    """Score of one bag of passages by gated attention, number by number."""
    codes, raws = [], []
    for row in rows:
        x = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(row, mean, scale, strict=True)]
        code = [math.tanh(sum(x[i] * w["W"][i][h] for i in range(len(x))) + w["b"][h]) for h in range(len(w["b"]))]
        value = [math.tanh(sum(code[h] * w["V"][h][g] for h in range(len(code)))) for g in range(len(w["a"]))]
        gate = [1 / (1 + math.exp(-sum(code[h] * w["U"][h][g] for h in range(len(code))))) for g in range(len(w["a"]))]
        codes.append(code)
        raws.append(sum(v * g * a for v, g, a in zip(value, gate, w["a"], strict=True)))
    shares = [math.exp(r - max(raws)) for r in raws]
    pooled = [sum(s * code[h] for s, code in zip(shares, codes, strict=True)) / sum(shares) for h in range(len(w["c"]))]
    return 1 / (1 + math.exp(-sum(p * c for p, c in zip(pooled, w["c"], strict=True)) - w["d"][0]))
