"""Whole texts to token ids with the tokenizers library, a stretch of text at a time and each stretch once.

Both public vocabularies split a text before any merge: at white space (word vocabulary), or before a space that precedes a
non-space (byte vocabulary). Stretches between such places encode by themselves, so their ids are kept in a bounded table.
Of the byte vocabulary, the stretches of many texts are found together, and each different one is looked up once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpuslode.llm.common import trimmed

#: Stretches whose ids a worker keeps; it starts anew when they are full.
KEPT = 1_200_000
#: Characters of one stretch that are worth keeping.
LONG = 64
#: Bytes of text whose stretches are found together; a longer text is by itself.
TOGETHER = 8 << 20

#: What the pre-tokenizers take for white space (Unicode White_Space), spelt out: Python's \\s also has \x1c-\x1f.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
STRETCH = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
TAIL = re.compile(r"(?<=[A-Za-z])[,.;:!?|$%&*#]+\Z")
WORD = re.compile(f"[^{SPACE}]+")

# the same on UTF-8 bytes: white space of more than one byte by all its bytes, the letters and marks of TAIL by their one
_WIDE = [x.encode() for x in re.findall(f"[{SPACE}]", "".join(map(chr, range(0x80, 0x3100))))]
_LEAD, _LETTER, _MARK = (np.isin(np.arange(256), list(x)) for x in ({x[0] for x in _WIDE}, b"".join(bytes([i, i + 32]) for i in range(65, 91)), b",.;:!?|$%&*#"))
_WIDE_KEYS = np.array([int.from_bytes(x.ljust(3, b"\0"), "big") for x in _WIDE])

#: What byte vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {i: chr(i) for i in _SELF} | {i: chr(256 + k) for k, i in enumerate(sorted(set(range(256)) - set(_SELF)))}


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the stretches (STRETCH, cut before TAIL's marks) of texts begin in their UTF-8 bytes, text k from offsets[k] to offsets[k + 1]."""
    n = len(data)
    space = (data == 32) | (data - np.uint8(9) < 5)
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        a, b, c = (data[np.minimum(lead + i, n - 1)].astype(np.int64) for i in range(3))
        hit = np.isin(a << 16 | b << 8 | np.where(a < 0xE0, 0, c), _WIDE_KEYS)
        for i in range(3):
            space[lead[hit & (a >= (0, 0, 0xE0)[i])] + i] = True
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    out = first.copy()
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    out[edge[space[edge]]] = True
    # before a word: the last of its white space begins a stretch, and the word another one unless that is a blank
    word = edge[~space[edge] & ~first[edge]]
    last = word - 1
    out[word[data[last] != 32]] = True
    for _ in range(2):
        last -= data[last] & 0xC0 == 0x80
    out[last] = True
    out[1:n] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    return np.flatnonzero(out[:n])


def latin(text: str) -> bool:
    """Whether all characters are Latin-1: composed already, and lower-cased one by one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder(dict):
    """Stretch -> its ids as little-endian unsigned 32-bit integers. spaces: whether white space is encoded too."""

    def __init__(self, path: str, spaces: bool) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.spaces = self.tokenizer.model, spaces
        self.raw = spaces and self.tokenizer.normalizer is None
        self.stretches = (STRETCH if spaces else WORD).findall

    def __missing__(self, stretch: str) -> bytes:
        plain = stretch[self.spaces and stretch[:1] == " " :]
        if plain.isascii() and plain.isalpha():  # one word, past the steps before the merges
            plain = plain if self.spaces else plain.lower()
            ids = self._merged("\u0120" + plain if plain != stretch and self.spaces else plain)
        elif self.raw and plain.isalpha() and max(plain) < "\u0180":  # one word of Latin letters, by its bytes
            ids = self._merged("".join(map(BYTES.__getitem__, stretch.encode())))
        elif cut := TAIL.search(stretch):  # letters and the marks behind them are split before any merge
            ids = self[stretch[: cut.start()]] + self[cut.group()]
        else:
            ids = np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()
        if len(stretch) <= LONG:
            self[stretch] = ids
        return ids

    def _merged(self, word: str) -> bytes:
        found = [x.id for x in self.model.tokenize(word)]
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > KEPT:
            self.clear()
        if not self.spaces and latin(text):
            text = text.lower()  # as the vocabulary's normaliser does; fewer stretches differ
        return b"".join(map(self.__getitem__, self.stretches(text)))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of each text, white space included; each different stretch of some megabytes is looked up once."""
        column = texts.cast(pa.large_string()).fill_null("")
        if not len(column):
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        held, lo = column.buffers()[2], 0
        data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TOGETHER, "right")) - 1)
            yield from self._together(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi

    def _together(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        if len(self) > KEPT:
            self.clear()
        at = starts(data, offsets)
        bounds = np.append(at, len(data))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        stretches = found.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False)
        ids = pa.array(map(self.__getitem__, stretches), pa.large_binary()).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][np.searchsorted(at, offsets)].tolist()
        out = memoryview(ids.buffers()[2] or b"")
        for i, j in zip(ends, ends[1:]):
            yield bytes(out[i:j])


_ENCODERS: dict = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One of each a worker process."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]


def released() -> None:
    """Frees what a worker holds for encoding, when it goes on to another operator."""
    if _ENCODERS:
        _ENCODERS.clear()
        trimmed()


def public(name: str) -> str:
    """The default place of a public vocabulary; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
