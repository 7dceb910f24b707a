"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids, linked):
    """Smallest id reachable for each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def base_spans(text):
    """By the stated patterns, every match tried and the failing ones dropped."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(texts):
    """``{id: (fingerprint, smallest id)}`` by comparing all pairs."""
    fp = {i: fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    value = np.array([fp[i] for i in ids], np.uint64)
    linked = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.bitwise_count(value[:, None] ^ value[None, :]) <= 4), strict=True) if a < b]
    comp = components(ids, linked)
    return {i: (format(fp[i], "016x"), comp[i]) for i in ids}


def similar_components(texts, limit, keys):
    """``{id: smallest id}``: 128-bit fingerprints of five-word shingles link at ``limit`` bits if their ``keys`` meet."""
    fp = {}
    for i, t in texts.items():
        w = words(t.translate(LOWER))
        shingles = [" ".join(w[j : j + 5]) for j in range(len(w) - 4)] or [" ".join(w)]
        h = [xxhash.xxh3_128_intdigest(s.encode(), 42) for s in shingles] if w else []
        fp[i] = sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h))
    own = {i: keys(v >> 64) for i, v in fp.items()}
    ids = sorted(fp)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fp[a] ^ fp[b]).bit_count() <= limit and own[a] & own[b]]
    return components(ids, linked)


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by their definitions."""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def targets(sizes, weights=(3, 1, 2)):
    """Water filling by repeated sharing of what is over the limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while left > 1e-6 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


class Ppm:
    """Prediction by partial matching, one byte at a time."""

    def __init__(self, texts, order=4):
        self.order = order
        self.counts = [defaultdict(Counter) for _ in range(order + 1)]
        for text in texts:
            b = b"\xff" * order + text.translate(LOWER).encode() + b"\xff"
            for p in range(order, len(b)):
                for k in range(order + 1):
                    self.counts[k][b[p - k : p]][b[p]] += 1

    def byte(self, history, symbol):
        total, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = {s: n for s, n in self.counts[k].get(history[len(history) - k :], {}).items() if s not in excluded}
            if not seen:
                continue
            room = sum(seen.values()) + len(seen)
            if symbol in seen:
                return total + math.log10(seen[symbol] / room)
            total += math.log10(len(seen) / room)
            excluded |= set(seen)
        return total - math.log10(256 - len(excluded))

    def text(self, text):
        b = b"\xff" * self.order + text.translate(LOWER).encode() + b"\xff"
        return sum(self.byte(b[p - self.order : p], b[p]) for p in range(self.order, len(b)))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def kneser_ney(sequences, classes):
    """``p(a, b, c)``: modified Kneser-Ney trigram probability of ``c`` after ``a, b``; sequences of symbols."""
    three, two, one = Counter(), Counter(), Counter()
    for seq in sequences:
        padded = [0, *seq]
        three.update(zip(padded, padded[1:], padded[2:]))
    for _, b, c in three:
        two[b, c] += 1
    for _, c in two:
        one[c,] += 1

    def discounts(counts):
        n = [max(sum(v == k for v in counts.values()), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [min(max(v, 0.1), k - 0.1) for k, v in enumerate(d, 1)]

    def level(counts, lower):
        d = discounts(counts)
        followers = defaultdict(dict)
        for gram, n in counts.items():
            followers[gram[:-1]][gram[-1]] = n

        def p(*gram):
            seen = followers.get(gram[:-1])
            if not seen:
                return lower(*gram[1:])
            total = sum(seen.values())
            cut = lambda n: d[min(n, 3) - 1]
            n = seen.get(gram[-1], 0)
            return ((n - cut(n)) if n else 0) / total + sum(map(cut, seen.values())) / total * lower(*gram[1:])

        return p

    return level(three, level(two, level(one, lambda *_: 1 / classes)))


def spelling(rows):
    """``word -> (n, n_near, form, form_n, root)`` of ``(doc_id, text)``, some runs misspelt."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: set() for w in words}
    holes = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if b != a}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda y: (-words[y], y), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (words[w], len(near[w]), form.get(w), words.get(form.get(w)), root)
    return out


def runs(w):
    """Every maximal periodic run, by trying all periods and all smaller ones."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, size = i - q, j - i + q
            if size >= max(6, 4 * q) and not any(all(w[t] == w[t - d] for t in range(start + d, j)) for d in range(1, q)):
                out.append((start, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """The row of the periodic-run query, by the definition."""
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def without_repeats(texts, length):
    """``(bytes, removed, spans, kept digest)`` of each text, by counting all strings of ``length`` bytes."""
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mask = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if mask[i] and not (i and mask[i - 1]))
        out.append((len(r), sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(r, mask, strict=True) if not m)).hexdigest()))
    return out
