"""String similarity that Spark lacks."""

from __future__ import annotations

import re


def jaro(a: str, b: str) -> float:
    """Matches within half the longer length, less half the share that is out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    from_a, hit = [], [False] * len(b)
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == ch and not hit[j]:
                hit[j] = True
                from_a.append(ch)
                break
    m = len(from_a)
    if not m:
        return 0.0
    from_b = [ch for ch, h in zip(b, hit, strict=True) if h]
    off = sum(x != y for x, y in zip(from_a, from_b, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - off) / m) / 3


def jaro_winkler(a: str, b: str, scaling: float = 0.1) -> float:
    """Jaro raised towards 1 by up to four equal first letters."""
    base = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * scaling * (1 - base)


def normal_name(name: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", " ", (name or "").lower())).strip()


def tokens(name: str | None) -> list[str]:
    return normal_name(name).split()
