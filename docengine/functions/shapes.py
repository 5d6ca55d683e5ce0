"""Documents of one shape: equal but for the digits of integers that stand as values at the ends of lines.

What a reader makes of such documents differs in the texts and values of these integers alone, so it
is found once for a shape, with other digits in their places, and filled in after that. A shape has the
integers' lengths, so places in the text are the same too. A shape is tried when it comes the second time,
is compared with what the reader makes of that document, and is given up if it does not hold: then, and for
shapes that come once, each document is read. Only texts that ``yamlparse.quick`` reads have shapes.
"""

from __future__ import annotations

import re

from docengine.functions import yamlparse as Y

#: Up to 18 digits: 64 bits hold them.
INTEGER = re.compile(r"(?<=[:-] )(0|[1-9][0-9]{0,17})(?=\n|\Z)")
#: Rows or texts that a task keeps, and the length of texts that are cut.
KEPT, SHORT = 1 << 16, 1024
#: Integers of a shape at most; each is tried by itself.
MOST = 64


class Shapes:
    """What ``build`` (parts, integers) gives for each shape that came twice, or None; kept apart for each task."""

    def __init__(self, build, size=lambda made: 1):
        self.build, self.size = build, size
        self.known, self.once, self.held = {}, set(), 0

    def __getstate__(self):
        return {"build": self.build, "size": self.size, "known": {}, "once": set(), "held": 0}

    def find(self, text: str):
        """(what was built, integers) of a text; None for one that must be read."""
        if len(text) > SHORT:
            return None
        cut = INTEGER.split(text)
        integers = cut[1::2]
        key = ("\0".join(cut[::2]), *map(len, integers))
        made = self.known.get(key, self)
        if made is self:
            if self.held >= KEPT or key[0].count("\0") != len(integers):
                return None
            mark = hash(key)
            if mark not in self.once:
                if len(self.once) < KEPT:
                    self.once.add(mark)
                return None
            ones = fills(cut[::2], integers)
            made = None if len(integers) > MOST or Y.quick(ones[0]) is None else self.build(text, ones, integers)
            self.known[key] = made
            self.held += 1 if made is None else self.size(made)
        return None if made is None else (made, integers)


def fills(parts: list[str], integers: list[str]) -> list[str]:
    """The text with ones for all digits, and for each integer the text with twos for its digits."""
    out = []
    for j in range(-1, len(integers)):
        digits = [("2" if i == j else "1") * len(x) for i, x in enumerate(integers)]
        out.append("".join(p + d for p, d in zip(parts, [*digits, ""], strict=True)))
    return out


def different(text: str) -> str:
    """The text with digits for its integers that change from one to the next."""
    cut = INTEGER.split(text)
    cut[1::2] = [str(3 + j % 7) * len(x) for j, x in enumerate(cut[1::2])]
    return "".join(cut)


def places(texts: list[str], integers: list[str]) -> list | None:
    """How a text is put together, as literals and numbers of integers, from the texts made of ``fills``; None if it is not by them alone."""
    base, found = texts[0], []
    for j, (other, digits) in enumerate(zip(texts[1:], integers, strict=True)):
        if len(other) != len(base):
            return None
        at, n = 0, len(digits)
        while at < len(base):
            if base[at] == other[at]:
                at += 1
                continue
            if base[at : at + n] != "1" * n or other[at : at + n] != "2" * n:
                return None
            found.append((at, at + n, j))
            at += n
    out, at = [], 0
    for start, end, j in sorted(found):
        if start < at:
            return None
        out += [base[at:start], j]
        at = end
    return [*out, base[at:]]


def filled(pieces: list, integers: list[str]) -> str:
    return "".join([x if isinstance(x, str) else integers[x] for x in pieces])


def text_of(one):
    """``build`` for a function from text to text."""

    def build(text, ones, integers):
        made = [one(x) for x in ones]
        pieces = places(made, integers) if all(isinstance(x, str) for x in made) else None
        return pieces if pieces is not None and filled(pieces, integers) == one(text) else None

    return build


def rows_of(make, kinds: list[str]):
    """``build`` for a function from text to rows: (rows, {column: for each row the number of the integer that it holds, or -1})."""

    def value(kind, digits):
        return digits if kind == "string" else int(digits) if kind == "bigint" else float(digits) if kind == "double" else None

    def rows(text):
        return [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in make(text)]

    def build(text, ones, integers):
        first, same = rows(ones[0]), rows(text)
        # where other digits change nothing, no integer stands in the rows, and none is tried by itself
        if first == same == rows(different(text)):
            return first, {}
        others = map(rows, ones[1:])
        held: dict[int, list[int]] = {}
        for j, found in enumerate(others):
            if len(found) != len(first):
                return None
            n = len(integers[j])
            for at, (a, b) in enumerate(zip(first, found, strict=True)):
                for c in range(len(kinds)) if a != b else ():
                    if a[c] != b[c]:
                        if value(kinds[c], "1" * n) is None or a[c] != value(kinds[c], "1" * n) or b[c] != value(kinds[c], "2" * n):
                            return None
                        held.setdefault(c, [-1] * len(first))[at] = j
        filled = [list(r) for r in first]
        for c, of in held.items():
            for at, j in enumerate(of):
                if j >= 0:
                    filled[at][c] = value(kinds[c], integers[j])
        return (first, held) if [tuple(r) for r in filled] == same else None

    return build
