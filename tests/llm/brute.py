"""Plain versions of the operators on lists of ``(id, text)``, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fingerprint(text: str | None) -> int:
    w = SPACED.findall((text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints: list[int], distance: int = 3) -> list[int]:
    """For each place the first place that it is linked to."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def contamination(docs, items, window: int = 13):
    """Per row: words, hit words, items with occurring windows."""
    grams = defaultdict(set)
    for name, text in items:
        w = LETTERS.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i : i + window])].add(str(name))
    out = []
    for _, text in docs:
        w, hit, names = LETTERS.findall((text or "").translate(LOW)), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if found := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), names))
    return out


def repeats(docs, window: int = 20):
    """Per row (ids distinct): words and the kept text."""
    first, words = {}, [SPACED.findall(t or "") for _, t in docs]
    for i in sorted(range(len(docs)), key=lambda i: docs[i][0]):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone |= set(range(s, s + window))
        out.append((len(w), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def language_model(docs, training, order: int = 3, discount: float = 0.5, least: int = 2):
    """Per row: tokens, known tokens, base score, score; and the training tokens."""
    tokens = [SPACED.findall((t or "").translate(LOW)) + ["\0"] for _, t in docs]
    counts = [Counter() for _ in range(order)]
    for w, use in zip(tokens, training):
        for n in range(order if use else 0):
            counts[n].update(zip(*(w[k:] for k in range(n + 1))))
    total, distinct = sum(counts[0].values()), len(counts[0])
    kept = [{g: c for g, c in level.items() if c >= least} for level in counts]
    left = defaultdict(lambda: 1.0)
    for n in range(1, order):
        for g, c in kept[n].items():
            left[g[:-1]] -= (c - discount) / counts[n - 1][g[:-1]]

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 0.5) / (total + 0.5 * (distinct + 1))
        n = len(gram) - 1
        share = (kept[n][gram] - discount) / counts[n - 1][gram[:-1]] if gram in kept[n] else 0.0
        return share + left.get(gram[:-1], 1.0) * p(gram[1:])

    out = []
    for w in tokens:
        base = sum(math.log10(p((x,))) for x in w)
        own = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))
        out.append((len(w), sum((x,) in counts[0] for x in w), base, own))
    return out, total


def fold(id, folds: int) -> int:
    return zlib.crc32(str(id).encode()) % folds


def near_vectors(rows, threshold: float = 0.93):
    """Per row of ``(id, vector, label)``: linked rows and the smallest id reachable."""
    good = [v is not None and l is not None and any(v) and all(x is not None and math.isfinite(x) for x in v) for _, v, l in rows]

    def linked(i, j):
        (_, a, k), (_, b, l) = rows[i], rows[j]
        if not (good[i] and good[j]) or k != l or len(a) != len(b):
            return False
        a, b = [x / max(map(abs, a)) for x in a], [x / max(map(abs, b)) for x in b]
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b)) >= threshold

    near = [[j for j in range(len(rows)) if j != i and linked(i, j)] for i in range(len(rows))]
    least = [None] * len(rows)
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        least[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return [len(x) for x in near], least


def hard_negatives(rows, anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256):
    """``(anchor, positive, rank, negative, positive score, negative score)`` of rows ``(id, vector, label)``."""
    own = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, x, l) in enumerate(own):
        if not anchor(a):
            continue
        ranked = sorted((-sum(p * q for p, q in zip(x, y)), math.inf if i is None else i, m) for m, (i, y, _) in enumerate(own) if m != n)
        for s, _, m in [r for r in ranked if own[r[2]][2] == l][:positives]:
            found = [(t, k) for t, _, k in ranked if own[k][2] != l and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, own[m][0], r, own[k][0], -s, -t) for r, (t, k) in enumerate(found, 1)]
    return out


def collocations(rows, least: int = 100, longest: int = 5, keep: int = 2000):
    """``(lang, rank, phrase, a, l, r, n, score)`` of rows ``(text, lang)``."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang or "und" if lang != "" else ""] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und" if lang != "" else ""].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) >= 2}
        inside = {}
        for p, a in often.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    inside[p[s : s + k]] = max(a, inside.get(p[s : s + k], 0))
        found = []
        for p, a in often.items():
            if inside.get(p, 0) < a:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:keep], 1)]
    return out
