"""Occurrences of a document's own literals, found by one automaton over the text.

Every document has its own literals (sensitive values, their words, rule findings).  One Aho-Corasick
automaton over them finds all their occurrences in one pass, however many there are, so residual
occurrences and the replaced text cost the text's length plus the occurrences.

Case-insensitive means what Python's ``re.IGNORECASE`` means: characters of one case class are equal, one
by one, so a folded text keeps its length and offsets (``ſ`` equals ``s``, ``ß`` does not equal ``ss``).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Sequence

_FOLD: dict[int, str] = {}
#: Cased scripts end before this code point.
_CASED = 0x1F000
#: Up to so many characters (of the text, once a literal) a text is searched literal by literal.
_LITTLE = 1 << 16
_SOLID = re.compile(r"\S+")
#: ASCII as it is masked: white space stays.
_CROSS = "".join(chr(c) if chr(c).isspace() else "x" for c in range(128))

Literal = tuple[str, bool]  # the literal, and whether it must stand as a whole word


def _fold_table() -> dict[int, str]:
    """Each cased character's representative: the first lower-case one with the same upper case."""
    if not _FOLD:
        first: dict[str, str] = {}
        keys = []
        for c in map(chr, range(_CASED)):
            low = c.lower()[0]
            if low == c and c.upper() == c:
                continue
            key = low.upper()
            keys.append((c, key))
            if low == c:
                first.setdefault(key, c)
        _FOLD.update({ord(c): first[key] for c, key in keys if first.get(key, c) != c})
    return _FOLD


def fold(text: str) -> str:
    """The text with every character replaced by its case class's representative; same length."""
    return text.lower() if text.isascii() else text.translate(_fold_table())


def _folds(texts: Sequence[str]) -> list[str]:
    """``fold`` of each text; ASCII ones in one go."""
    whole = "\0".join(texts)
    if whole.isascii() and whole.count("\0") == len(texts) - 1:
        return whole.lower().split("\0")
    return [fold(x) for x in texts]


def find_all(folded: str, literals: Iterable[str]) -> dict[str, Sequence[int]]:
    """Start of every occurrence, also overlapping ones, of each folded literal that occurs, ascending."""
    literals = [x for x in set(literals) if x and len(x) <= len(folded)]
    found: dict[str, Sequence[int]] = {}
    if len(literals) * len(folded) <= _LITTLE:
        for x in literals:
            at = folded.find(x)
            if at >= 0:
                starts = found[x] = array("q")
                while at >= 0:
                    starts.append(at)
                    at = folded.find(x, at + 1)
        return found
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for x in literals:
        machine.add_word(x, (x, len(x) - 1))
    machine.make_automaton()
    for end, (x, back) in machine.iter(folded):
        if x not in found:
            found[x] = array("q")
        found[x].append(end - back)
    return found


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _edge(left: str, right: str) -> bool:
    """Whether a word boundary lies between two neighbouring characters ('' beyond the text)."""
    return (left != "" and _is_word(left)) != (right != "" and _is_word(right))


def _stands(text: str, at: int, end: int) -> bool:
    return _edge(text[at - 1: at], text[at: at + 1]) and _edge(text[end - 1: end], text[end: end + 1])


def _matches(text: str, starts: Sequence[int], size: int, word: bool) -> Iterable[int]:
    """Starts of the non-overlapping matches from the left."""
    last = 0
    for at in starts:
        if at >= last and (not word or _stands(text, at, at + size)):
            yield at
            last = at + size


def residual(text: str, literals: Sequence[Literal], found: dict | None = None, lows: Sequence[str] | None = None) -> list[tuple[int, str]]:
    """(start, string) of every match of each literal, in literal order, then text order."""
    lows = [fold(x) for x, _ in literals] if lows is None else lows
    found = find_all(fold(text), lows) if found is None else found
    return [(at, text[at: at + len(x)]) for (x, word), low in zip(literals, lows) if low in found for at in _matches(text, found[low], len(x), word)]


def scrubbed(text: str, literals: Sequence[Literal]) -> tuple[list[tuple[int, str]], str]:
    """D8 and D9 of one search."""
    lows = _folds([x for x, _ in literals])
    found = find_all(fold(text), lows)
    if not found:  # nothing to replace, and so nothing new to match either
        return [], text
    return residual(text, literals, found, lows), replaced(text, literals, found, lows)


def replaced(text: str, literals: Sequence[Literal], found: dict | None = None, lows: Sequence[str] | None = None) -> str:
    """The literals replaced in turn, each match by as many ``Q``; a match sees what earlier ones replaced."""
    lows = [fold(x) for x, _ in literals] if lows is None else lows
    found = find_all(fold(text), lows) if found is None else found
    gone, spans, done = bytearray(len(text)), [], {}

    def neighbours(at: int) -> tuple[str, str]:
        return tuple("Q" if 0 <= k < len(text) and gone[k] else text[max(k, 0): k + 1] for k in (at - 1, at))

    for (x, word), low in zip(literals, lows):
        size = len(x)
        met = bool(spans) and "q" in low  # only such a literal can match what was put in
        if not met and low not in found:
            continue
        seen = done.get((low, word))
        if seen is not None and (seen == len(spans) or not (met or word)):
            continue  # a repeated literal finds more only if its surroundings have changed
        starts = find_all(fold(_painted(text, spans)), [low]).get(low, ()) if met else found.get(low, ())
        last, new = 0, []
        for at in starts:
            end = at + size
            if at >= last and (met or gone.find(1, at, end) < 0) and (not word or (_edge(*neighbours(at)) and _edge(*neighbours(end)))):
                new.append((at, end))
                last = end
        for at, end in new:
            gone[at: end] = b"\1" * size
        done[low, word] = len(spans)
        spans += new
    return _painted(text, spans)


def _painted(text: str, spans: Iterable[tuple[int, int]], paint=lambda part: "Q" * len(part)) -> str:
    """The text with the union of the spans painted over."""
    parts, last = [], 0
    for at, end in sorted(spans):
        at = max(at, last)
        if end > at:
            parts += [text[last: at], paint(text[at: end])]
            last = end
    return "".join(parts) + text[last:]


def _crossed(part: str) -> str:
    return part.translate(_CROSS) if part.isascii() else _SOLID.sub(lambda m: "x" * len(m.group()), part)


def masked(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """Every character but white space inside a span becomes ``x``; spans may overlap."""
    return _painted(text, spans, _crossed)
