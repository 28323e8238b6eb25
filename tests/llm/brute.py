"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def components(ids: Iterable[int], links: Iterable[tuple[int, int]]) -> dict[int, int]:
    parent = {i: i for i in ids}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a == b:
            continue
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in parent}


def similar(texts: dict[int, str | None], size: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, size) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    named = components(sets, links)
    return {i: (len(sets[i]), named[i]) for i in sets}


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def pii(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                found.append((kind, m.start(), m.end()))
    return found
