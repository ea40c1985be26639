"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def listed(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{e}" for a, k, e in sorted(spans))


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(digits)) % 10 == 0


PII = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def personal(text: str | None) -> list[tuple[int, int, int]]:
    digits = lambda v: sum(c in "0123456789" for c in v)
    good = [lambda v: True, lambda v: all(int(x) <= 255 for x in v.split(".")), lambda v: 14 <= digits(v) <= 19 and luhn(v), lambda v: 10 <= digits(v) <= 15]
    return [(m.start(), k, m.end()) for k in range(4) for m in re.finditer(PII[k], text or "") if good[k](m[0])]


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    w = SPACED.findall(t)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    held = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(held), len(w) < 10 or 100 * len(held) > 20 * len(w)


def contaminated(texts: list[str | None], items: list[tuple[object, str | None]]) -> list[tuple[int, int, int, str, bool]]:
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    out = []
    for t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[x]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def deduplicated(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def near(docs: dict[int, str | None], size: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in docs.items():
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def least_padding(lengths: list[int], buckets: int) -> int:
    from itertools import combinations

    values = sorted(set(lengths))
    best = None
    for n in range(1, min(buckets, len(values)) + 1):
        for cut in combinations(values[:-1], n - 1):
            bounds = [*cut, values[-1]]
            cost = sum(next(b for b in bounds if b >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


def passages(texts: list[str | None], length: int) -> list[tuple[int, int]]:
    """(words in passages of `length` words that another text holds, such passages) of each text."""
    words = [SPACED.findall((t or "").translate(LOWER)) for t in texts]
    held = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - length + 1):
            held[tuple(w[i : i + length])].add(k)
    out = []
    for w in words:
        covered = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if len(held[tuple(w[i : i + length])]) > 1:
                covered[i : i + length] = b"\1" * length
        out.append((sum(covered), len(re.findall(b"\1+", bytes(covered)))))
    return out
