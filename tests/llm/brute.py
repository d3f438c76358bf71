"""Plain versions of operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def katz(rows, k=5):
    """rows: (doc_id, text, held_out). Returns doc_id -> (n_tokens, n_known, train_tokens, base, score), and P(w|v)."""
    tokens = {i: [*spaced(t), None] for i, t, _ in rows}
    train = [tokens[i] for i, _, h in rows if not h]
    uni = Counter(w for t in train for w in t)
    pair = Counter((v, w) for t in train for v, w in zip(["<s>", *t], t))
    after, total = Counter(), sum(uni.values())
    words = {}
    for (v, w), n in pair.items():
        after[v] += n
        words.setdefault(v, []).append(w)

    def discount(counts):
        n = Counter(counts)
        d = {r: total / (total + 1) for r in range(1, k + 2)}
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        for r in range(1, k + 1):
            if n[r] and 0 < common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < x < d[r]:
                    d[r] = x
        return lambda r: d[min(r, k + 1)]

    d1, d2 = discount(uni.values()), discount(pair.values())
    unknown = 1 - sum(d1(c) * c / total for c in uni.values()) if total else 1.0
    one = lambda w: d1(uni[w]) * uni[w] / total if uni[w] else unknown
    alpha = {}

    def p(w, v):
        if pair[v, w]:
            return d2(pair[v, w]) * pair[v, w] / after[v]
        if not after[v]:
            return one(w)
        if v not in alpha:
            seen = words[v]
            alpha[v] = (1 - sum(d2(pair[v, x]) * pair[v, x] for x in seen) / after[v]) / (1 - sum(map(one, seen)))
        return alpha[v] * one(w)

    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t)
        out[i] = (len(t), sum(uni[w] > 0 for w in t), total, base, sum(math.log10(p(w, v)) for v, w in zip(["<s>", *t], t)))
    return out, p, uni


def licenses(texts, templates, rare, posted=24):
    """For each text the sorted (label, place, words, share) of the templates found in it."""
    words = [plain(t) for t in texts]
    often = Counter(w for x in words for w in set(x))
    idf = lambda w: math.log((1 + len(texts)) / (1 + often[w]))
    at = lambda x, phrase, i: i >= 0 and x[i : i + len(phrase)] == phrase
    out = []
    for x in words:
        found = []
        for t in templates:
            own, keys = plain(t.text), [plain(k) for k in t.keys]
            index = sorted(set(own), key=lambda w: (-idf(w), own.index(w)))[: max(4, min(posted, (len(set(own)) + 1) // 2))]
            need, there = min(2, len(index)), [w for w in index if w in x]
            if len(there) < need:
                continue
            votes = {}
            for w in there[:rare]:
                for i in (i for i, y in enumerate(x) if y == w):
                    for p in (p for p, y in enumerate(own) if y == w):
                        votes.setdefault(i - p, set()).add(w)
            places = [next(i for i in range(len(own)) if at(own, k, i)) for k in keys]
            for start, v in votes.items():
                if len(v) >= need and all(at(x, k, start + p) for k, p in zip(keys, places)):
                    share = sum(0 <= start + i < len(x) and x[start + i] == w for i, w in enumerate(own)) / len(own)
                    found.append((t.label, start, len(own), share))
        out.append(sorted(found))
    return out


def url_features(url, host, path):
    """The lexical features of a URL, in order."""
    u, size = url or "", max(len(url or ""), 1)
    query = re.search(r"\?([^#]*)", u)
    query = query.group(1) if query else ""
    labels = host.split(".")
    entropy = -sum(u.count(c) / size * math.log2(u.count(c) / size) for c in set(u))
    return [
        len(u), len(host), len(path), path.count("/"), len(labels), sum(c in "0123456789" for c in u) / size, entropy,
        query.count("&") + 1 if query else 0, u.count("-"), max(map(len, labels)), len(labels[-1]), sum(c in "aeiou" for c in host) / max(len(host), 1), float(u.startswith("https")),
    ]


def tree(text):
    """A decision tree from the text that MLlib prints, as a function of the features."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node():
        line = lines.pop(0)
        if line.startswith("Predict"):
            value = float(line.split(":")[1])
            return lambda x: value
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        lines.pop(0)
        high = node()
        return lambda x: low(x) if x[int(feature)] <= float(bound) else high(x)

    return node()


def gram_vector(text, dims):
    """Counts of the hashed n-grams of a text's bytes: letters as they are, runs of all else as one space."""
    data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in lower(text).encode()]
    data = [b for i, b in enumerate(data) if b != 32 or i == 0 or data[i - 1] != 32]
    out, mask = Counter(), 0xFFFFFFFF
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            if all(b == 32 for b in data[i : i + n]):
                continue
            code = data[i]
            for b in data[i + 1 : i + n]:
                code = (code * 0x9E3779B1 + b) & mask
            code ^= code >> 15
            out[((code * 0x85EBCA6B & mask) >> 8) % dims] += 1
    return out


def nearest_centroid(training, asked, clusters, dims, rounds=12):
    """(language, cosine) of each asked text, from (text, language) pairs: TF-IDF, spherical k-means, largest cosine."""
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    unit = lambda v: {k: x / norm(v) for k, x in v.items()}
    dot = lambda a, b: sum(x * b.get(k, 0.0) for k, x in a.items())
    counts = [gram_vector(t, dims) for t, _ in training]
    often = Counter(k for c in counts for k in c)
    idf = lambda k: math.log((1 + len(counts)) / (1 + often[k])) + 1e-3 if often[k] else math.log1p(len(counts))
    vector = lambda c: unit({k: math.log1p(n) * idf(k) for k, n in c.items()})

    def total(vectors):
        out = Counter()
        for v in vectors:
            for k, x in v.items():
                out[k] += x
        return out

    centroids = []
    for lang in sorted({x for _, x in training}):
        own = [vector(c) for c, (_, x) in zip(counts, training) if x == lang]
        middle = total(own)
        start = [max(range(len(own)), key=lambda i: dot(own[i], middle))]
        while len(start) < min(clusters, len(own)):
            start.append(min(range(len(own)), key=lambda i: max(dot(own[i], own[s]) for s in start)))
        found = [own[s] for s in start]
        for _ in range(rounds):
            nearest = [max(range(len(found)), key=lambda c: dot(v, found[c])) for v in own]
            found = [unit(total(v for v, n in zip(own, nearest) if n == c)) if c in nearest else found[c] for c in range(len(found))]
        centroids += [(lang, c) for c in found]
    out = []
    for t in asked:
        v = vector(gram_vector(t, dims))
        best = max(centroids, key=lambda c: dot(v, c[1]))
        out.append((best[0], dot(v, best[1])))
    return out


def katz_of_order(train, texts, order, k=5):
    """log10 probability of each text, and P(w | context), by recursion from ``order - 1`` words of context."""
    padded = lambda t: ["<s>"] * (order - 1) + [*spaced(t), None]
    counts = [Counter() for _ in range(order + 1)]
    for t in map(padded, train):
        for i in range(order - 1, len(t)):
            for n in range(1, order + 1):
                counts[n][tuple(t[i - n + 1 : i]), t[i]] += 1
    total = sum(counts[1].values())
    d = [None]
    for n in range(1, order + 1):
        m, own = Counter(counts[n].values()), {r: max(total, 1) / (max(total, 1) + 1) for r in range(1, k + 2)}
        common = (k + 1) * m[k + 1] / m[1] if m[1] else 1
        for r in range(1, k + 1):
            if m[r] and 0 < common < 1:
                x = ((r + 1) * m[r + 1] / (r * m[r]) - common) / (1 - common)
                if 0 < x < own[r]:
                    own[r] = x
        d.append(own)
    after = Counter()
    words = {}
    for n in range(2, order + 1):
        for (c, w), r in counts[n].items():
            after[c] += r
            words.setdefault(c, []).append(w)
    after[()] = total
    kept = lambda n, r: d[n][min(r, k + 1)] * r
    unknown = 1 - sum(kept(1, r) for r in counts[1].values()) / total if total else 1.0

    def p(w, c):
        n = len(c) + 1
        r = counts[n][c, w]
        if r:
            return kept(n, r) / after[c]
        if n == 1:
            return unknown
        if not after[c]:
            return p(w, c[1:])
        alpha = (1 - sum(kept(n, counts[n][c, x]) for x in words[c]) / after[c]) / (1 - sum(p(x, c[1:]) for x in words[c]))
        return alpha * p(w, c[1:])

    scores = [sum(math.log10(p(t[i], tuple(t[i - order + 1 : i]))) for i in range(order - 1, len(t))) for t in map(padded, texts)]
    return scores, p, [*{w for _, w in counts[1]}, "never seen"]
