"""Chunkers: each document becomes rows (doc_id, chunk_index, text, heading, level, start_char, end_char).

A chunker maps one text to chunks; chunked() applies it to a table in one pass without a shuffle. All of them work on spans
of the text, so offsets are exact. Null, empty and blank texts give no rows. Sizes in tokens count as 0.75 words each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from math import sqrt
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from corpuslode.operators.sentences import spans as sentence_spans

SCHEMA = "doc_id long, chunk_index int, text string, heading string, level int, start_char int, end_char int"
HEADING = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t]*$", re.M)
BLANK = re.compile(r"\n\s*\n")
WORD = re.compile(r"\S+")
TOKEN = re.compile(r"\w+(?:[-_]\w+)*|\S")
# What ends a sentence, and where windows and recursive pieces are cut, in this order.
ENDS = (".", "!", "?", '."', '?"', '!"')
STOPS = (". ", ".\n", "! ", "? ", "\n\n")
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")

Span = tuple[int, int]


class Chunk(NamedTuple):
    text: str
    heading: str | None
    level: int
    start: int
    end: int


class Section(NamedTuple):
    heading: str | None
    level: int
    path: tuple[str, ...]
    start: int
    end: int


def n_words(text: str) -> int:
    return len(text.split())


def n_tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def trimmed(text: str, start: int, end: int) -> Span:
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())


def between(text: str, gap: re.Pattern, start: int = 0, end: int | None = None) -> list[Span]:
    """The non-blank spans that gaps leave, without outer blanks."""
    end = len(text) if end is None else end
    edges, at = [], start
    for m in gap.finditer(text, start, end):
        edges.append((at, m.start()))
        at = m.end()
    spans = (trimmed(text, i, j) for i, j in [*edges, (at, end)])
    return [(i, j) for i, j in spans if i < j]


def sections(text: str, deepest: int = 6) -> list[Section]:
    """The text before the first heading and below each heading of at most `deepest` levels, with the path of headings."""
    found = [m for m in HEADING.finditer(text) if len(m[1]) <= deepest]
    out, path = [Section(None, 0, (), 0, found[0].start() if found else len(text))], {}
    for m, then in zip(found, [*found[1:], None]):
        level = len(m[1])
        path = {k: v for k, v in path.items() if k < level} | {level: m[2]}
        out.append(Section(m[0].strip(), level, tuple(path.values()), m.end(), then.start() if then else len(text)))
    return out


def word_cuts(text: str, start: int, end: int, most: int, back: float, overlap: int = 0, ends: tuple[str, ...] = (".", "!", "?")) -> Iterator[Span]:
    """Spans of at most `most` words; each ends a sentence where one ends past the share `back` of it."""
    at = [(m.start() + start, m.end() + start) for m in re.finditer(r"\S+", text[start:end])]
    i = 0
    while i < len(at):
        j = min(i + most, len(at))
        if j < len(at):
            j = next((q for q in range(j, i + max(1, int(most * back)), -1) if text[at[q - 1][0] : at[q - 1][1]].endswith(ends)), j)
        yield at[i][0], at[j - 1][1]
        i = j if j == len(at) else max(j - overlap, i + 1)


def counted(text: str, unit: re.Pattern, start: int = 0, end: int | None = None) -> Callable[[int, int], int]:
    """The number of units of text[i:j], for any i and j that cut no unit; units are looked for once."""
    starts = [m.start() for m in unit.finditer(text, start, len(text) if end is None else end)]
    return lambda i, j: bisect_left(starts, j) - bisect_left(starts, i)


def counted_words(text: str) -> Callable[[int, int], int]:
    """n_words(text[i:j]) for any i and j; what a word is cut to at i counts too."""
    n = counted(text, WORD)
    return lambda i, j: n(i, j) + (0 < i < j and not text[i].isspace() and not text[i - 1].isspace())


def filled(spans: list[Span], size: Callable[[int, int], int], most: int, overlap: int = 0) -> Iterator[Span]:
    """Neighbouring spans joined up to `most`; the next starts with the last spans of the one before, up to `overlap`."""
    own: list[Span] = []
    for s in spans:
        if own and size(own[0][0], s[1]) > most:
            yield own[0][0], own[-1][1]
            while own and (size(own[0][0], own[-1][1]) > overlap or size(own[0][0], s[1]) > most):
                own.pop(0)
        own.append(s)
    if own:
        yield own[0][0], own[-1][1]


def whole(text: str) -> list[Chunk]:
    return [Chunk(text, None, 0, 0, len(text))]


def _merged(text: str, headings: bool, least: int, most: int) -> list[Chunk]:
    """Paragraphs, those of fewer than `least` words joined with the next under their heading, long ones cut."""
    marks = [(m.start(), m[0].strip(), len(m[1])) for m in HEADING.finditer(text)] if headings else []
    held: list[list] = []  # [start, end, heading, level]
    k = 0
    for i, j in between(text, BLANK):
        while k < len(marks) and marks[k][0] <= i:
            k += 1
        heading, level = marks[k - 1][1:] if k else (None, 0)
        if headings and all(HEADING.fullmatch(x.strip()) for x in text[i:j].splitlines() if x.strip()):
            continue
        if held and held[-1][2:] == [heading, level]:
            have = n_words(text[held[-1][0] : held[-1][1]])
            if have < least and have + n_words(text[i:j]) <= most:
                held[-1][1] = j
                continue
        held.append([i, j, heading, level])
    out = []
    for i, j, heading, level in held:
        for s, e in word_cuts(text, i, j, most, 0.7) if n_words(text[i:j]) > most else [(i, j)]:
            body = text[s:e]
            out.append(Chunk(f"{heading}\n\n{body}" if heading and not body.startswith(heading) else body, heading, level, s, e))
    return out


def heading(text: str, least_tokens: int = 50, most_tokens: int = 256) -> list[Chunk]:
    return _merged(text, True, int(least_tokens * 0.75), int(most_tokens * 0.75))


def paragraphs(text: str, least_tokens: int = 50, most_tokens: int = 512) -> list[Chunk]:
    return _merged(text, False, int(least_tokens * 0.75), int(most_tokens * 0.75))


def sentences(text: str, most_tokens: int = 200, floor: int = 20) -> list[Chunk]:
    """Sentences of a section packed up to a token budget that leaves room for the heading; longer sentences by words."""
    out = []
    for s in sections(text):
        budget = max(floor, most_tokens - n_tokens(s.heading or ""))
        size = counted(text, TOKEN, s.start, s.end)  # no sentence and no word ends within a token
        parts: list[Span] = []
        for i, j in sentence_spans(text, s.start, s.end):
            if size(i, j) <= budget:
                parts.append((i, j))
            else:
                parts += filled([m.span() for m in WORD.finditer(text, i, j)], size, budget)
        last = max((size(i, j) for i, j in parts), default=0)
        out += [Chunk(text[i:j], s.heading, s.level, i, j) for i, j in filled(parts, size, budget, min(last, budget // 4))]
    return out


def fixed_size(text: str, size: int = 512, overlap: int = 0) -> list[Chunk]:
    """Windows of 0.75 * size words; ends move back to a sentence end in their second half."""
    return [Chunk(text[i:j], None, 0, i, j) for i, j in word_cuts(text, 0, len(text), max(1, int(size * 0.75)), 0.5, int(overlap * 0.75), ENDS)]


def _pieces(text: str, start: int, end: int, size: int, separators: tuple[str, ...]) -> Iterator[Span]:
    if end - start <= size:
        yield start, end
        return
    k = next(k for k, x in enumerate(separators) if text.find(x, start, end) >= 0)
    sep, at = separators[k], start
    while at < end:
        cut = text.find(sep, at, end) if sep else -1
        to = min(at + size, end) if not sep else end if cut < 0 else cut + len(sep)
        yield from _pieces(text, at, to, size, separators[k + 1 :] or ("",))
        at = to


def recursive(text: str, size: int = 1000, overlap: int = 0) -> list[Chunk]:
    """Pieces cut at the coarsest separator that is there, then at finer ones, joined up to `size` characters."""
    spans = (trimmed(text, i, j) for i, j in filled(list(_pieces(text, 0, len(text), size, SEPARATORS)), lambda i, j: j - i, size, overlap))
    return [Chunk(text[i:j], None, 0, i, j) for i, j in spans if i < j]


def heading_based(text: str, deepest: int = 3) -> list[Chunk]:
    """A chunk for each section; heading: the path of headings."""
    out = []
    for s in sections(text, deepest):
        i, j = trimmed(text, s.start, s.end)
        if i < j:
            out.append(Chunk(text[i:j], " > ".join(s.path) or None, s.level, i, j))
    return out


def heading_limited(text: str, deepest: int = 3, most_tokens: int = 512, overlap: int = 0) -> list[Chunk]:
    """heading_based, its long sections cut at a sentence end past 80 % of the size."""
    most = int(most_tokens * 0.75)
    return [Chunk(text[i:j], c.heading, c.level, i, j) for c in heading_based(text, deepest) for i, j in (word_cuts(text, c.start, c.end, most, 0.8, overlap) if n_words(c.text) > most else [(c.start, c.end)])]


def heading_paragraph(text: str, deepest: int = 3) -> list[Chunk]:
    """Both granularities: each section (level 1), followed by its paragraphs (level 2)."""
    out = []
    for c in heading_based(text, deepest):
        out.append(c._replace(level=1))
        out += [Chunk(text[i:j], c.heading, 2, i, j) for i, j in between(text, BLANK, c.start, c.end)]
    return out


def windows(text: str, size: int = 1000, overlap: int = 200) -> list[Chunk]:
    """Character windows of each section; a window ends after the last of the first stop that it has past half of it.

    The next window starts `overlap` before that end, also behind a section's end: a last window may repeat the tail.
    """
    out = []
    for s in sections(text):
        first, last = trimmed(text, s.start, s.end)
        at = first
        while at < last:
            to = at + size
            if to < last:
                cuts = ((text.rfind(x, at, to), len(x)) for x in STOPS)
                to = next((i + n for i, n in cuts if i - at > size // 2), to)
            i, j = trimmed(text, at, min(to, last))
            if i < j:
                out.append(Chunk(text[i:j], s.heading, s.level, i, j))
            at = max(to - overlap, at + 1)
    return out


def markdown_semantic(text: str, least: int = 50, most: int = 800, target: int = 400) -> list[Chunk]:
    """Sections, short neighbours joined in pairs, long ones cut at paragraphs around `target` words; code fences stay whole.

    Cut sections go on with their heading and "(continued)" and the last sentence before the cut.
    """
    own = [(s, *trimmed(text, s.start, s.end)) for s in sections(text)]
    own = [list(x) for x in own if x[1] < x[2]]
    joined: list[list] = []
    for s, i, j in own:
        if joined and n_words(text[joined[-1][1] : joined[-1][2]]) < least and n_words(text[i:j]) < least:
            joined[-1][2] = j
        else:
            joined.append([s, i, j])
    out = []
    for s, i, j in joined:
        if n_words(text[i:j]) <= most:
            out.append(Chunk(text[i:j], s.heading, s.level, i, j))
            continue
        fences = [(m.start(), m.end()) for m in re.finditer(r"```.*?(?:```|\Z)", text[i:j], re.S)]
        gaps = [m for m in BLANK.finditer(text, i, j) if not any(a <= m.start() - i < b for a, b in fences)]
        edges = [i, *(m.end() for m in gaps), j]
        parts = [trimmed(text, a, b) for a, b in zip(edges, edges[1:])]
        for k, (a, b) in enumerate(filled([p for p in parts if p[0] < p[1]], counted(text, WORD, i, j), target)):
            before = sentence_spans(text, i, a)[-1:] if k else []
            start = before[0][0] if before else a
            head = f"{s.heading} (continued)\n\n" if k and s.heading else ""
            out.append(Chunk(head + text[start:b], s.heading, s.level, start, b))
    return out


def cluster_semantic(text: str, target: int = 200, most: int = 400) -> list[Chunk]:
    """Sentences up to `most` words a chunk; past `target` words the cut is where neighbours are least alike.

    Likeness is the cosine of bags of words, a stand-in for sentence vectors.
    """
    parts = sentence_spans(text)
    bags = [Counter(text[i:j].lower().split()) for i, j in parts]
    norm = [sqrt(sum(v * v for v in b.values())) or 1.0 for b in bags]
    alike = [sum(n * b[w] for w, n in a.items()) / (x * y) for a, b, x, y in zip(bags, bags[1:], norm, norm[1:])]
    out, at = [], 0
    while at < len(parts):
        words, k, options = 0, at, []
        while k < len(parts) and (words + n_words(text[parts[k][0] : parts[k][1]]) <= most or k == at):
            words += n_words(text[parts[k][0] : parts[k][1]])
            if words >= target and k + 1 < len(parts):
                options.append((alike[k], k))
            k += 1
        to = k if k == len(parts) or not options else min(options)[1] + 1
        out.append(Chunk(text[parts[at][0] : parts[to - 1][1]], None, 0, parts[at][0], parts[to - 1][1]))
        at = to
    return out


def hierarchical(text: str, deepest: int = 6) -> list[Chunk]:
    """The leaves of the tree of sections, each with the headings above it and their own text's first line as context."""
    all_ = sections(text, deepest)
    out = []
    for k, s in enumerate(all_):
        i, j = trimmed(text, s.start, s.end)
        if i < j and (k + 1 == len(all_) or all_[k + 1].level <= s.level or s.level == 0):
            above = [f"{'#' * (n + 1)} {p}" for n, p in enumerate(s.path)]
            out.append(Chunk("\n".join([*above, text[i:j]]), " > ".join(s.path) or None, s.level, i, j))
    return out


def fields(text: str) -> dict[str, str]:
    """heading, first paragraph, body and code of a chunk, for search by weighted fields."""
    code = "\n".join(m[1].strip() for m in re.finditer(r"```[^\n]*\n(.*?)```", text, re.S))
    plain = re.sub(r"```.*?```", "", text, flags=re.S)
    head = HEADING.search(plain)
    body = HEADING.sub("", plain).strip()
    return {"heading": head[2] if head else "", "first": body[: body.find("\n\n")] if "\n\n" in body else body, "body": body, "code": code}


def outline(text: str, summary: int = 500, deepest: int = 4) -> list[tuple[str, int, str, str]]:
    """(title, level, heading, summary) of each section; title: the document's first top heading."""
    all_ = sections(text, deepest)
    title = next((s.path[0] for s in all_ if s.level == 1), "")
    return [(title, s.level, s.path[-1] if s.path else "", text[slice(*trimmed(text, s.start, s.end))][:summary]) for s in all_]


def clauses(text: str, most_tokens: int = 100) -> list[Chunk]:
    """Sentences, and clauses of longer ones, packed up to a size in words; one sentence of overlap where it fits."""
    parts: list[Span] = []
    for i, j in between(text, re.compile(r"[.!?\n]+")):
        parts += [(i, j)] if n_words(text[i:j]) <= most_tokens else between(text, re.compile(r"[,;:]"), i, j)
    return [Chunk(text[i:j], None, 0, i, j) for i, j in filled(parts, counted_words(text), most_tokens, most_tokens // 4)]


CHUNKERS: dict[str, Callable[..., list[Chunk]]] = {f.__name__: f for f in (whole, heading, paragraphs, sentences, fixed_size, recursive, heading_based, heading_limited, heading_paragraph, windows, clauses, markdown_semantic, cluster_semantic, hierarchical)}


def chunker(name: str) -> Callable[..., list[Chunk]]:
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; there are {', '.join(sorted(CHUNKERS))}")
    return CHUNKERS[name]


def chunked(docs: DataFrame, name: str, **options: int) -> DataFrame:
    """The chunks of docs (doc_id, text) by a chunker of that name."""
    cut = chunker(name)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(d, k, *c) for d, t in zip(pdf["doc_id"], pdf["text"]) if t and t.strip() for k, c in enumerate(cut(t, **options))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "heading", "level", "start_char", "end_char"])

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
