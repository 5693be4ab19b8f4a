"""The plate functions that a task needs between two images, as plain Python: what `plate` says in columns."""

from __future__ import annotations

import re

from . import plate as P

_OTHER, _TURNED = re.compile("[^A-Z0-9]"), re.compile("([0-9]{4}|[0-9][A-Z][0-9]{2})[A-Z]{3}")
_VALID = re.compile(P.VALID.replace(r"\z", r"\Z"))
_LETTER, _DIGIT = str.maketrans(*P.TO_LETTER), str.maketrans(*P.TO_DIGIT)
_CONFUSED = frozenset(x for pair in P.CONFUSED.split() for x in (pair, pair[::-1]))


def is_valid(text: str) -> bool:
    return _VALID.match(text) is not None


def clean(text: str) -> str:
    bare = _OTHER.sub("", text.upper())
    return bare[4:] + bare[:4] if _TURNED.fullmatch(bare) else bare


def mask_of(plate: str | None) -> str | None:
    bare = _OTHER.sub("", (plate or "").upper())
    return None if len(bare) != 7 else P.NEW if bare[4].isalpha() else P.OLD


def fit_mask(text: str, mask: str) -> str:
    return "".join(c.translate(_LETTER if m == "L" else _DIGIT) for c, m in zip(text, mask, strict=True))


def normalize(text: str, mask: str | None = None) -> str:
    own = clean(text)
    if is_valid(own) or len(own) < 7:
        return own
    for start in range(len(own) - 7, -1, -1):
        for m in (mask,) if mask else (P.OLD, P.NEW):
            made = fit_mask(own[start : start + 7], m)
            if is_valid(made):
                return made
    return own[:7]


def distance(expected: str, read: str) -> float:
    a, b = clean(expected), clean(read)
    if not a or not b:
        return P.UNREAD_COST
    row = [100 * j for j in range(len(b) + 1)]
    for x in a:
        above, row = row, [row[0] + 100]
        for j, y in enumerate(b):
            row.append(min(above[j + 1] + 100, row[j] + 100, above[j] + (0 if x == y else 35 if x + y in _CONFUSED else 100)))
    return row[-1] / 100


def matches(expected: str, read: str) -> int:
    a, b = clean(expected), clean(read)
    return 0 if b == P.UNREAD.upper().replace(" ", "") else sum(min(a.count(x), b.count(x)) for x in set(a))
