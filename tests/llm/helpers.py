"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Rows that every document operator must take: nulls, empty and odd texts, repeats.
ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "..."),
    (5, "word"),
    (6, "Two words"),
    (6, "Two words"),
    (7, "x" * 30_000),
    (8, "lorem ipsum dolor sit amet " * 4000),
    (9, "Ünïcödé ﬁ Ω Σ 漢字 😀 \u0000 end"),
    (None, "no id"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, score double, size string, fp string, spans string, _id string, _text string"


def odd_documents(spark):
    rows = [(i, t, None, None, None, "s", "f", "p", "i", "t") for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, ODD_SCHEMA)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = WORD.findall(ascii_lower(text))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs):
    """Smallest member of its group for every node of the pairs."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def near_groups(prints):
    """Component id of each id, from (id, fingerprint)."""
    linked = [(a, b) for a, f in prints for b, g in prints if (f ^ g).bit_count() <= 3]
    return groups(linked)


def shingles(text, n=5):
    words = WORD.findall(ascii_lower(text))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar_groups(texts, least=0.8):
    """Component id of each id, from (id, text), by Jaccard similarity of five-word runs."""
    sets = [(i, shingles(t)) for i, t in texts]
    linked = []
    for a, s in sets:
        for b, t in sets:
            both = len(s & t)
            if s == t or both >= least * (len(s) + len(t) - both):
                linked.append((a, b))
    return groups(linked)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), place, m.end(), kind))
    return sorted(out)


def mixture(rows, weights=(5, 2, 1), epochs=3):
    """(id, size, source size, target, copies) from (id, text, source)."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    total = {n: sum(z for z, (*_, s) in zip(size, rows, strict=True) if s == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(size) - sum(target.values())
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > epochs * total[n]}
        if not over:
            target |= share
            break
        target |= {n: float(epochs * total[n]) for n in over}
        open_ -= over
    out = []
    for n in names:
        whole = int(target[n] // total[n]) if total[n] else 0
        need, at = target[n] - whole * total[n], 0
        keyed = sorted(
            (hashlib.md5(f"mix-1:{'' if i is None else i}:{t or ''}".encode()).hexdigest(), i, z)
            for (i, t, s), z in zip(rows, size, strict=True)
            if s == n
        )
        words = {}
        for key, _, z in keyed:
            words[key] = words.get(key, 0) + z
        extra = {}
        for key in sorted(words):
            extra[key] = at + words[key] / 2 <= need
            at += words[key]
        out += [(i, z, total[n], target[n], (whole + extra[key]) * (z > 0)) for key, i, z in keyed]
    return out


def best(vectors, query, k):
    """Ids of the k largest inner products, ties to smaller ids."""
    scores = sorted(((-float(np.dot(vectors[query], v)), i) for i, v in vectors.items() if i != query))
    return [(i, -s) for s, i in scores[:k]]
