"""Plain versions that the operators are held against, and awkward rows."""

import hashlib
import re

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 4000

#: doc_id, text, lang, source, n_chars: nulls in every column, empty and long texts, repeated rows, a clash of ids.
AWKWARD = [
    (1, "the cat sat on the mat and then the cat went home again", "en", "a", 10),
    (1, "the cat sat on the mat and then the cat went home again", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "en", "b", 4),
    (None, "the cat sat on the mat and then the cat went home again", "en", "a", 10),
    (None, None, None, None, None),
    (5, LONG, "la", "b", len(LONG)),
    (6, "ein kurzer Satz \u00fcber \U0001f600 Dinge", "de", None, 25),
    (1, "another text under the same id with some more words in it", "en", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of names that operators use inside.
CLASHES = ["f", "label", "part", "text_hash", "score", "lang_pred", "copies", "size", "payload", "base", "at", "n", "key", "a", "b", "_id", "_h", "_t", "predicted", "a.b", "p", "h", "id", "row", "times", "v", "hash", "fit"]


def words(text):
    return WORDS.findall(text or "")


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]] if total else []
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cosine_links(vectors, labels, cosine=0.93):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= cosine) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(near, False)
    return near
