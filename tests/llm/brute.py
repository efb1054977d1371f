"""Plain restatements of the operators' contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text, size):
    w = words((text or "").translate(A_TO_Z))
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(texts, size, percent=80):
    sets = {d: shingles(t, size) for d, t in texts.items()}
    least = {d: d for d in texts}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def removed(texts):
    first = {}
    for d in sorted(texts):
        w = words(texts[d])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i: i + 13]), d)
    out = {}
    for d, text in texts.items():
        w = words(text)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i: i + 13])] < d for j in range(i, i + 13)}
        out[d] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def repetition(text):
    w = words(text)
    count = Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if count[tuple(w[i: i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))


def longest_repeat(text):
    w = words(text)
    n = 0
    while len({tuple(w[i: i + n + 1]) for i in range(len(w) - n)}) < len(w) - n:
        n += 1
    return n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    only = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only(m)) <= 19 and luhn(only(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only(m)) <= 15)]
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m.group())] for k, p, ok in kinds]


def shingles_cased(text, size):
    w = words(text)
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
