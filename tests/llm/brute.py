"""Plain versions of the contracts, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def licenses(text: str | None) -> tuple:
    words = PLAIN_WORD.findall((text or "").translate(UP))
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def contamination(docs: list[str | None], items: list[tuple[int, str | None]]) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = PLAIN_WORD.findall((text or "").translate(UP))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        w = PLAIN_WORD.findall((text or "").translate(UP))
        hit, got = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    got |= own
        out.append((len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit)))
    return out


def near(docs: list[tuple[int, str | None]], width: int = 5) -> dict[int, tuple]:
    sets = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(UP))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def _key(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join([_key("password"), _key("passwd"), _key("secret"), _key("token"), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]) + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text: str | None) -> tuple:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    count = Counter(k for _, k, _ in spans)
    names = ("assign", "access", "hex")
    return count[0], count[1], count[2], sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)))


def quality(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
