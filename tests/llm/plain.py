"""Plain Python versions of the operators, and documents with the awkward cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, length long, n_words string, piece int"


def awkward_texts(seed: int = 3, n: int = 60) -> list[str | None]:
    """Nulls, blanks, repeats, near copies, one long text, characters beyond ASCII."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gämma", "δέλτα", "9", "of", "the", "\U0001F600", "to", "x.y", "in"]
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "one two three"]
    for _ in range(n):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))))
    base = [f"w{k}" for k in range(120)]
    for k in range(12):
        copy = list(base)
        for at in rng.sample(range(120), k % 7):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[8], texts[8], "long " + " ".join(rng.choice(words) for _ in range(30_000)), "a" * 100_000]
    return texts


def documents(spark, texts, first=0):
    rows = [(first + k, t, ["en", "de", None][k % 3], "s", len(t or ""), k, "own", 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def white_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w]


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, width=5, similarity=80):
    sets = {}
    for k, text in rows:
        w = white_words(text)
        sets[k] = ({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}) if w else set()
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    part = components(ids, edges)
    return {k: (len(sets[k]), part[k], part[k] == k) for k in ids}


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def contamination(rows, items, window=13):
    patterns = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w and item is not None else 0):
            patterns[tuple(w[k:k + size])].add(str(item))
    out = {}
    for doc, text in rows:
        w, hit, found = item_words(text), set(), set()
        for p, owners in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= owners
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, expression) in enumerate(EXPRESSIONS.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def kneser_ney(train, rows):
    """(n_tokens, n_known, base, score) of each text under an interpolated modified Kneser-Ney bigram model."""
    sentences = [[*white_words(t), "\0end"] for t in train]
    pair = Counter(p for s in sentences for p in zip(["\0begin", *s], s))
    count, kinds, after = Counter(), Counter(), defaultdict(list)
    for (u, w), c in pair.items():
        count[w] += c
        kinds[w] += 1
        after[u].append(c)
    total, v, types = sum(count.values()), len(count), len(pair)

    def discounts(values):
        n = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0, .5, .5, .5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2, 0), k + 1) for k in range(3))]
    d, k = discounts(pair.values()), discounts(kinds.values())

    def low(w):
        spare = sum(k[min(x, 3)] for x in kinds.values()) / types if types else 1
        return (max(kinds[w] - k[min(kinds[w], 3)], 0) / types if types else 0) + spare / (v + 1)

    def p(u, w):
        seen = after.get(u)
        if not seen:
            return low(w)
        c = pair[u, w]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in seen) * low(w)) / sum(seen)
    out = []
    for t in rows:
        s = [*white_words(t), "\0end"]
        out.append((len(s), sum(count[w] > 0 for w in s),
                    sum(math.log10((count[w] + .1) / (total + .1 * (v + 1))) for w in s),
                    sum(math.log10(p(u, w)) for u, w in zip(["\0begin", *s], s))))
    return out, p, sorted(count)


def ppm_bits(train, text, order=3):
    """The code length of a text in bits after the counts of some texts (bytes, A-Z folded)."""
    after = defaultdict(Counter)
    for t in train:
        b = b"\n" * order + t.translate(FOLD).encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                after[b[i - k:i]][b[i]] += 1
    b, bits = b"\n" * order + text.translate(FOLD).encode(), 0.0
    for i in range(order, len(b)):
        gone: set[int] = set()
        for k in range(order, -1, -1):
            seen = after.get(b[i - k:i])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in gone}
            whole = sum(left.values()) + len(left)
            if b[i] in left:
                bits -= math.log2(left[b[i]] / whole)
                break
            if left:
                bits -= math.log2(len(left) / whole)
            gone = set(seen)
        else:
            bits += math.log2(256 - len(gone))
    return bits
