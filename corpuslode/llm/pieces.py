"""N-best segmentation into SentencePiece pieces, and decoding.

A text's pieces form a lattice; a path's score is the sum of its pieces' log-probabilities. The public model is a BPE model,
whose scores are only the order of its merges: that order is read as ranks under Zipf's law, so a piece of rank r has a
probability of 1 / (r H), H the harmonic number of all pieces. So the best path is not the merges' result that the library
returns for this model, but the likeliest of all segmentations into its pieces. No piece holds a space mark behind another
character, so the lattice falls apart into stretches that end before space marks, each solved once and kept. In a stretch a
forward Viterbi pass gives the best score up to every place. Those scores are exact heuristics for an A* search from the end
back to the start, which pops whole paths in descending order of score (Nagata, 1994). A document's n best are the stretches'
best with the cheapest deviations; only stretches whose second path is among the n - 1 closest can deviate.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslode.llm.common import batches, id_text
from corpuslode.llm.tokens import LONG, public

SPACE = "▁"
#: Stretches whose best paths a worker keeps; it starts anew when they are full.
KEPT = 1_200_000
#: A character without a piece becomes its bytes' pieces; its score is this much below the lowest of a piece.
PENALTY = 10.0


class Pieces(dict):
    """Stretch -> (ids of the best path as bytes, its score, how far below the second path is)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.text = [p.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-p.get_score(i), i))
        total = log(sum(1 / r for r in range(1, len(ranked) + 1)))
        self.vocab = {self.text[i]: (-log(r) - total, i) for r, i in enumerate(ranked, 1)}
        #: Every start of a piece; what is no piece itself has no score.
        self.starts = {x[:k]: () for x in self.vocab for k in range(1, len(x))} | self.vocab
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.unknown = min(s for s, _ in self.vocab.values()) - PENALTY
        self.widest = max(map(len, self.vocab))
        if any(SPACE in x.lstrip(SPACE) for x in self.vocab):
            raise ValueError("a piece holds a space mark behind another character")
        # a line break, or a mark behind a letter, that no piece holds also ends a stretch
        marks = "".join(c for c in ",.;:!?|$%&*#" if not any(re.search(rf"[^\W\d_]{re.escape(c)}", x) for x in self.vocab))
        stop = "" if any("\n" in x for x in self.vocab) else "\n"
        other = f"[^{SPACE}{stop}]+"
        self.stretches = re.compile((f"{SPACE}*[a-zA-Z]+(?=[{re.escape(marks)}])|" if marks else "") + f"{SPACE}*{other}|{SPACE}+|\n").findall
        self.raw = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(self.text)]

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def edges(self, s: str, end: int) -> list[tuple[int, float, int]]:
        """(start, score, id) of the pieces that end there; id -1: a character without a piece."""
        get, out = self.vocab.get, []
        for start in range(max(0, end - self.widest), end):
            found = get(s[start:end])
            if found:
                out.append((start, *found))
        if not out or out[-1][0] != end - 1:
            out.append((end - 1, self.unknown, -1))
        return out

    def ids(self, s: str, start: int, piece: int) -> tuple[int, ...]:
        return (piece,) if piece >= 0 else tuple(self.bytes[b] for b in s[start].encode("utf-8", "surrogatepass"))

    def forward(self, s: str) -> tuple[list[float], list[float], list[tuple]]:
        """The best and second-best score up to every place, and the best's last edge."""
        none, get, n = float("-inf"), self.starts.get, len(s)
        best, second, back = [none] * (n + 1), [none] * (n + 1), [()] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            x0, y0 = best[start], second[start]
            for end in range(start + 1, n + 1):
                found = get(s[start:end])
                if not found:
                    if end == start + 1:
                        score, piece = self.unknown, -1
                    elif found is None:
                        break
                    else:
                        continue
                else:
                    score, piece = found
                x = x0 + score
                a = best[end]
                if x > a:
                    y = y0 + score
                    second[end] = a if a > y else y
                    best[end], back[end] = x, (start, score, piece)
                elif x > second[end]:
                    second[end] = x
                if found is None:
                    break
        return best, second, back

    def __missing__(self, s: str) -> tuple[bytes, float, float]:
        best, second, back = self.forward(s)
        ids: list[int] = []
        at = len(s)
        while at:
            start, _, piece = back[at]
            ids += self.ids(s, start, piece)[::-1]
            at = start
        out = np.array(ids[::-1], "<u4").tobytes(), best[-1], best[-1] - second[-1]
        if len(s) <= LONG:
            self[s] = out
        return out

    def paths(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a stretch: A* from its end, guided by the forward scores.

        The heap is ordered by what a partial path loses against the best one, which the forward scores give exactly. Of
        equal losses the path nearest the start goes on, so equally good paths are finished one after the other. A place is
        on at most n of the n best paths' ways from the end, so it is taken up n times at most.
        """
        best, _, _ = self.forward(s)
        heap, out, order, taken = [(0.0, len(s), 0, None)], [], 0, [0] * (len(s) + 1)
        while heap and len(out) < n:
            loss, at, _, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((best[-1] - loss, tuple(ids)))
                continue
            taken[at] += 1
            if taken[at] > n:
                continue
            for start, score, piece in self.edges(s, at):
                order += 1
                heapq.heappush(heap, (loss + best[at] - (best[start] + score), start, order, (self.ids(s, start, piece), path)))
        return out

    def encode(self, text: str | None, n: int = 4) -> list[tuple[float, bytes]]:
        """(score, ids as bytes) of the n best segmentations, or of as many as there are, best first."""
        own = self.stretches(self.normal(text or ""))
        if len(self) > KEPT:
            self.clear()
        best, scores, gaps = zip(*map(self.__getitem__, own)) if own else ((), (), ())
        total, gaps = sum(scores), np.array(gaps)
        near = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= 4 * n else sorted(np.argpartition(gaps, n - 1)[:n].tolist(), key=lambda i: (gaps[i], i))[: n - 1]
        combos: list[tuple[float, list]] = [(0.0, [])]
        for i in near:
            if not np.isfinite(gaps[i]):
                continue
            ways = self.paths(own[i], n)
            more = [(loss + ways[0][0] - score, [*dev, (int(i), ids)] if k else dev) for loss, dev in combos for k, (score, ids) in enumerate(ways)]
            combos = heapq.nsmallest(n, more, key=lambda x: x[0])
        out = []
        for loss, dev in combos:
            data = best
            if dev:
                data = list(best)
                for i, ids in dev:
                    data[i] = np.array(ids, "<u4").tobytes()
            out.append((total - loss, b"".join(data)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One of each a worker process."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str | None = None, n: int = 4, ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, score, ids_crc32, nbest_scores, nbest_crc32, decodes, nbest_ids) for every row of docs.

    n_pieces, score and ids_crc32 are of the best segmentation; nbest_ids has the ids of the n best, or of as many as there
    are, by descending score; of equal scores any may come first, the same one each time. ids=False leaves nbest_ids out.
    decodes: whether decoding the best ids gives the text back (a space mark in a text reads as a space). Null and empty
    texts have no pieces, and one segmentation of score 0. Repeated rows are encoded as often as they come. Other columns,
    whatever their names, are left out. An empty table gives an empty result.
    """
    place = path or public("piece_bpe_32k.model")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpuslode.llm.orc_tokens import lists

        m = model(place)
        for doc, texts in batches(it, "doc_id", "text"):
            for lo in range(0, len(doc), 200):
                some = texts[lo : lo + 200]
                got = [m.encode(t, n) for t in some]
                same = [m.decode(np.frombuffer(g[0][1], "<u4")) == (t or "").replace(SPACE, " ") for g, t in zip(got, some)]
                crc = [[zlib.crc32(x) for _, x in g] for g in got]
                columns = [pa.array(doc[lo : lo + 200], pa.int64()), pa.array([len(g[0][1]) // 4 for g in got], pa.int64()), pa.array([g[0][0] for g in got], pa.float64()), pa.array([c[0] for c in crc], pa.int64())]
                columns += [pa.array([[s for s, _ in g] for g in got], pa.list_(pa.float64())), pa.array(crc, pa.list_(pa.int64())), pa.array(same, pa.bool_())]
                if ids:
                    at = np.cumsum([0, *map(len, got)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(at, lists([x for g in got for _, x in g])))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id long, n_pieces long, score double, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, decodes boolean" + (", nbest_ids array<array<int>>" if ids else "")
    names = [x.split()[0] for x in kinds.split(", ")]
    return id_text(docs).mapInArrow(run, kinds)
