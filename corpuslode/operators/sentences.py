"""Where sentences end: a few rules over each place that could be an end. Spans are exact; nothing of a text is changed."""

from __future__ import annotations

import bisect
import re

Span = tuple[int, int]

# Rules as data. Abbreviations stand without their last full stop, in lower case.
#: Before a name: a sentence never ends after these.
BEFORE_NAMES = frozenset("mr mrs ms dr prof rev hon gen col maj capt lt sgt cpl gov sen rep pres supt messrs mme mlle st mt ft hr fr bzw nr sr sra srta dra".split())
#: Before a number: no end if one follows.
BEFORE_NUMBERS = frozenset("no nos nr n° fig figs vol vols p pp ch chap sec sect art ver v eq ref refs tab ex op para s".split())
#: Within sentences, whatever follows.
WITHIN = frozenset("e.g i.e cf vs viz al approx ca resp incl excl z.b d.h u.a o.ä p.ej vgl bspw ggf usw.-".split())
#: Within sentences or at their ends: an end if a capital follows.
EITHER = frozenset("etc inc ltd co corp llc jr sr esq ph.d m.d b.a m.a a.m p.m u.s u.k u.n e.u d.c jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun dept est ave blvd rd usw bd".split())
#: Pairs within which nothing ends, if both are in one paragraph and at most this far apart.
PAIRS, FAR = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}, 400

#: Characters before a mark that are looked at; no abbreviation is longer.
LONGEST = 40

_END = re.compile(r"(\.{2,}|…|[.!?]+|[。！？]+)([\"'”’»)\]]*)(?=\s|$|(?<=[。！？]))")
_BREAK = re.compile(r"\n[ \t]*\n\s*|\n(?=[ \t]*(?:[-*•+]|\d{1,3}[.)]|[a-zA-Z][.)]|\([a-z0-9]{1,3}\))[ \t]+\S)|\n(?=#{1,6} )")
_MARK = re.compile(r"(?:^|\n)[ \t]*(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})$")
_SIDE = re.compile("[" + re.escape("".join([*PAIRS, *PAIRS.values(), '"'])) + "]|\n(?=\n)")
_WORD = re.compile(r"[^\s(\[{“„«\"'‘]+$")
_NEXT = re.compile(r"\s*[\"'“‘«„(\[]*(\S?)")


def _protected(text: str) -> list[Span]:
    """Stretches in brackets and quotes, outermost ones, in order."""
    out: list[Span] = []
    stack: list[tuple[str, int]] = []
    quote = -1
    for m in _SIDE.finditer(text):
        i, c = m.start(), m[0]
        if c == "\n":
            stack, quote = [], -1
        elif stack and c == stack[-1][0]:
            _, start = stack.pop()
            if i - start <= FAR and not stack:
                out.append((start, i))
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
        elif c == '"':
            if quote < 0:
                quote = i
            else:
                if i - quote <= FAR:
                    out.append((quote, i))
                quote = -1
    return sorted(out)


def _ends(text: str, start: int, m: re.Match) -> bool:
    """Whether a sentence that began at start ends with the marks of m."""
    marks, after = m[1], text[m.end() : m.end() + 1]
    if not after:
        return True
    nxt = _NEXT.match(text, m.end())[1]
    if marks[0] in "。！？":
        return True
    if nxt.islower():
        return False
    if marks != ".":
        return True
    if m.start() - start <= 12 and _MARK.search(text[start : m.start()]) and len(text[start : m.start()].strip()) <= 5:
        return False
    word = _WORD.search(text, max(start, m.start() - LONGEST), m.start())
    own = word[0] if word else ""
    low = own.lower()
    if low in BEFORE_NAMES or low in WITHIN:
        return False
    if low in BEFORE_NUMBERS and nxt.isdigit():
        return False
    if low in EITHER:
        return nxt.isupper()
    if not own and nxt:
        return False  # a full stop by itself: of a spaced ellipsis
    if len(own) == 1 and own.isupper():
        before = text[start : m.start() - 1].split()[-1:]
        if own != "I" or len(before) == 1 and before[0][0].isupper() and before[0].isalpha():
            return False  # an initial
    if re.fullmatch(r"(?:[A-Z]\.)+[A-Z]", own):
        return nxt.isupper() and len(own) > 3  # initials of a name, or a longer abbreviation at an end
    return True


def spans(text: str, start: int = 0, end: int | None = None) -> list[Span]:
    """The sentences of text[start:end], without blanks around them."""
    part = text[start:end]
    held = _protected(part)
    opens = [i for i, _ in held]
    edges, at = [], 0
    cuts = sorted([(m.start(), 0, m) for m in _BREAK.finditer(part)] + [(m.end(), 1, m) for m in _END.finditer(part)], key=lambda x: x[:2])
    for place, mark, m in cuts:
        if place < at:
            continue
        k = bisect.bisect_left(opens, m.start()) - 1
        if k >= 0 and held[k][0] < m.start() and m.end() <= held[k][1]:
            continue
        if not mark or _ends(part, at, m):
            edges.append((at, place))
            at = place
    out = []
    for i, j in [*edges, (at, len(part))]:
        own = part[i:j]
        a, b = i + len(own) - len(own.lstrip()), j - len(own) + len(own.rstrip())
        if a < b:
            out.append((start + a, start + b))
    return out


def split(text: str) -> list[str]:
    return [text[i:j] for i, j in spans(text)]
