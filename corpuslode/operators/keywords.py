"""Keywords of single documents by YAKE's statistics (Campos et al., 2020): no corpus, no model.

A term's score is small if it is important: written with a capital, early, frequent, in many sentences, and not between just
anything. A keyword's score joins its terms' with its own frequency; keywords nearly like a better one are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise
from math import log
from statistics import fmean, pstdev
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslode.operators.sentences import split

# English words that no keyword begins or ends with.
STOP = frozenset(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its just may me might more most must my no nor not now of off on "
    "once only or other our out over own same shall she should so some such than that the their them then there these they this those through to too under until up upon us "
    "very was we were what when where which while who whom why will with would you your".split()
)
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|[^\w\s]")


class Features(NamedTuple):
    tf: int
    case: float
    position: float
    frequency: float
    related: float
    spread: float
    score: float


def tokenized(text: str) -> list[list[str]]:
    """The words and marks of every sentence."""
    return [_TOKEN.findall(s) for s in split(text)]


def plain(token: str) -> bool:
    """Whether a token can be a term: a word that is no number and no stop word, of more than two characters."""
    return token[0].isalnum() and len(token) > 2 and not token.isdigit() and token.lower() not in STOP


def _lowered(sentences: list[list[str]]) -> tuple[dict[str, str | None], list[str | None]]:
    """Each token in lower case, marks as None; and all tokens so, in order, with None after each sentence."""
    lows = {t: t.lower() if t[0].isalnum() else None for t in {t for tokens in sentences for t in tokens}}
    return lows, [lows.get(t) for tokens in sentences for t in [*tokens, None]]


def features(sentences: list[list[str]]) -> dict[str, Features]:
    """The statistics of every term, in lower case; neighbours are words one place away in the same stretch without marks."""
    return _features(sentences, *_lowered(sentences))


def _features(sentences: list[list[str]], lows: dict[str, str | None], flat: list[str | None]) -> dict[str, Features]:
    counts, firsts = Counter(t for tokens in sentences for t in tokens), Counter(tokens[0] for tokens in sentences if tokens)
    acronyms, capitals, befores, afters, left, right = (defaultdict(int) for _ in range(6))
    for t, low in lows.items():
        if low is None or t == low:
            continue
        if t.isupper():
            acronyms[low] += counts[t] if len(t) > 1 else 0
        elif t[0].isupper():
            capitals[low] += counts[t] - firsts[t]
    tf = Counter(flat)
    del tf[None]
    # neighbours, and how many of them differ
    for (x, y), n in Counter(pairwise(flat)).items():
        if x is not None and y is not None:
            befores[y] += n
            afters[x] += n
            left[y] += 1
            right[x] += 1
    places: dict[str | None, list[int]] = defaultdict(list)  # sentences, each once
    for k, tokens in enumerate(sentences):
        for low in {lows[t] for t in tokens}:
            places[low].append(k)
    terms = [t for t in tf if plain(t)]
    if not terms:
        return {}
    counts = [tf[t] for t in terms]
    norm, most, n = fmean(counts) + pstdev(counts), max(tf.values()), len(sentences)
    dispersion = lambda several, every: several / every if every else 0.0
    out = {}
    for t in terms:
        where = places[t]
        case = max(acronyms[t], capitals[t]) / (1 + log(tf[t]))
        position = log(log(3 + (where[len(where) // 2] + where[(len(where) - 1) // 2]) / 2))  # 3 and the median
        frequency = tf[t] / norm
        related = 1 + (dispersion(left[t], befores[t]) + dispersion(right[t], afters[t])) * tf[t] / most
        spread = len(where) / n
        out[t] = Features(tf[t], case, position, frequency, related, spread, related * position / (case + frequency / related + spread / related))
    return out


def _alike(a: str, b: str, least: float) -> bool:
    """Whether the matcher's ratio of two strings reaches the least; its upper bounds are looked at first."""
    if 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < least:
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() >= least and m.ratio() >= least


def keywords(text: str, top: int = 10, widest: int = 2, alike: float = 0.9) -> list[tuple[str, float]]:
    """The `top` best (keyword in lower case, score) of up to `widest` words, best first, none `alike` or more to a better one."""
    sentences = tokenized(text)
    lows, flat = _lowered(sentences)
    own = _features(sentences, lows, flat)
    flat = [t if t in own else None for t in flat]
    found: Counter = Counter()
    for n in range(1, widest + 1):
        found.update(zip(*(flat[i:] for i in range(n))))
    scored = []
    for gram, n in found.items():
        if None in gram:
            continue
        parts = [own[t].score for t in gram]
        product = 1.0
        for s in parts:
            product *= s
        scored.append((product / (n * (1 + sum(parts))), " ".join(gram)))
    out: list[tuple[str, float]] = []
    for score, k in sorted(scored):
        if len(out) == top:
            break
        if not any(_alike(k, other, alike) for other, _ in out):
            out.append((k, score))
    return out


def extracted(docs: DataFrame, top: int = 10, least: int = 50) -> DataFrame:
    """(doc_id, rank, keyword, score) of docs (doc_id, text); texts of fewer than `least` characters have none, null ones too."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, rank, word, score = [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                for r, (w, s) in enumerate(keywords(text, top) if text and len(text.strip()) >= least else [], 1):
                    row.append(k), rank.append(r), word.append(w), score.append(round(s, 6))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(rank, pa.int32()), pa.array(word, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "rank", "keyword", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rank int, keyword string, score double")
