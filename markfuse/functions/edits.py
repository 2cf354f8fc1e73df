"""Least number of edits between two sequences, in plain Python for the workers.

Both are cut by what they begin and end with alike; the rest goes through Myers' bit-vector recurrence (1999), in
which one integer holds a column's differences, so a step costs a few operations on all of a strip's elements.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from operator import ne

# Elements of the longer sequence worked on at once; bounds the bit masks, one for each distinct element of a strip.
STRIP = 4096


def alike(a: Sequence, b: Sequence) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def differing(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both without their common beginning and then without their common end; no edit is ever needed there."""
    if (n := alike(a, b)) > 0:
        a, b = a[n:], b[n:]
    if a and b and (n := alike(a[::-1], b[::-1])) > 0:
        a, b = a[: len(a) - n], b[: len(b) - n]
    return a, b


def apart(a: Sequence, b: Sequence) -> int:
    """Least number of insertions, deletions and replacements that make one sequence the other."""
    return _rest(*differing(a, b))


def scores(a: str | None, b: str | None, lower_a: str | None, lower_b: str | None, with_words: bool) -> tuple:
    """Edits between two texts, and between them in lower case; with words, also words of either and word edits.
    Nulls if a text is null."""
    if a is None or b is None:
        return (None,) * (5 if with_words else 2)
    if a == b:
        return (0, 0, n := len(a.split()), n, 0) if with_words else (0, 0)
    rest, lower = differing(a, b), differing(lower_a, lower_b)
    n = _rest(*rest)
    # worked out once where case has no part in what differs
    chars = (n, n if rest == lower else _rest(*lower))
    if not with_words:
        return chars
    v, w = a.split(), b.split()
    return *chars, len(v), len(w), apart(v, w)


def _rest(a: Sequence, b: Sequence) -> int:
    if len(a) < len(b):
        a, b = b, a
    if len(b) < 2:
        return len(a) - (1 if b and b[0] in a else 0)
    if len(a) == len(b):
        # replacing in place is one way, and no way has fewer edits than elements that lack a partner
        most = sum(map(ne, a, b))
        if most == (Counter(a) - Counter(b)).total():
            return most
    # by element of b: what the edits up to it grow by along the strip's upper edge
    edge = [1] * len(b)
    for start in range(0, len(a), STRIP):
        part = a[start : start + STRIP]
        masks: dict = {}
        for i, x in enumerate(part):
            masks[x] = masks.get(x, 0) | 1 << i
        full, top = (1 << len(part)) - 1, len(part) - 1
        more, less = full, 0
        for j, x in enumerate(b):
            same, above = masks.get(x, 0), edge[j]
            down = same | less
            if above < 0:
                same |= 1
            across = (((same & more) + more) ^ more) | same
            up, back = less | full & ~(across | more), more & across
            edge[j] = (up >> top & 1) - (back >> top & 1)
            up, back = up << 1, back << 1 & full
            if above > 0:
                up |= 1
            elif above < 0:
                back |= 1
            more, less = back | full & ~(down | up), up & down
    return len(a) + sum(edge)
