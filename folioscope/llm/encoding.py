"""Exact token ids of whole texts, with each distinct stretch of text encoded once.

A text is cut where no tokenizer of the two kinds used here can join the sides: before a space that a
non-space follows; before and after a single line feed between visible characters; and where a letter meets a
punctuation mark (of ASCII, but for the apostrophe of contractions and < | > of special strings).  Byte-level BPE
starts a new pre-token at each of those places, and so does the word BPE (which drops white space).  The stretches
of a batch are dictionary-encoded, those a worker hasn't met are encoded by the library, and the rest come from
its memory.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import text_buffers

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: Bytes that can begin white space outside ASCII; a place before them is not taken as a cut.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_FOLLOWS_SPACE = ~(_SPACE | _UNSURE)
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b"!\"#$%&()*+,-./:;=?@[]^_{}~"]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 32
#: Bytes of strings and ids that an encoder remembers, about; characters of the longest stretch it remembers; bytes of an entry besides.
MEMORY_BYTES, KEPT_CHARS, ENTRY_BYTES = 40 << 20, 64, 160


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin, document beginnings included; ascending, with the end last."""
    if not len(data):
        return np.zeros(1, np.int64)
    flag = np.zeros(len(data), bool)
    here, before = data[1:], data[:-1]
    letter = _LETTER[data]
    # second bytes of U+00C0 to U+017F, all letters but two; U+0130 loses a mark when folded
    letter[1:] |= (before == 0xC4) & (here != 0xB0) | (before == 0xC5) | (before == 0xC3) & (here != 0x97) & (here != 0xB7)
    flag[1:] = letter[:-1] & _MARK[here]
    flag[:-1] |= (before == 0x20) & _FOLLOWS_SPACE[here]
    feed = np.flatnonzero(here == 0x0A) + 1
    feed = feed[letter[feed - 1] | _VISIBLE[data[feed - 1]]]
    flag[feed] = True
    after = feed[feed + 1 < len(data)] + 1
    flag[after[_FOLLOWS_SPACE[data[after]]]] = True
    starts = offsets[:-1]
    flag[starts[starts < len(data)]] = True
    return np.append(np.flatnonzero(flag), len(data))


def _byte_symbols() -> dict[int, str]:
    """What byte-level pre-tokenizers write for each byte: itself where it is visible Latin-1, else the next of 256, 257, ..."""
    out, n = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            out[b] = chr(b)
        else:
            out[b] = chr(n)
            n += 1
    return out


_SYMBOLS = _byte_symbols()


class Encoder:
    """Ids of texts by a tokenizers file, without added special tokens; stretches met before are remembered.

    The memory holds at most `entries` stretches and about `most` bytes of strings and ids; when it would hold more, those met in
    one batch only are forgotten, and all if that isn't enough.  Stretches over KEPT_CHARS (text without a cut place) are
    encoded each time and never remembered.  Results don't depend on any of it.  A stretch that is one plain word (Latin
    letters below U+0180, a space before them at most) goes to the library's model at once, as its pre-tokenizer would hand it on.
    """

    def __init__(self, path: str, entries: int = 250_000, most: int = MEMORY_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        kinds = [p["type"] for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", [rules["pre_tokenizer"] or {"type": ""}])]
        #: The normalizer lower-cases, and white space never reaches the model.
        self.folds = "Lowercase" in [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])] and kinds == ["Split", "ByteLevel"]
        self.plain = self.folds or (kinds == ["ByteLevel"] and rules["normalizer"] is None)
        self.entries, self.most = entries, most
        self._forget(np.zeros(0, np.int64))

    def _forget(self, kept: np.ndarray) -> None:
        """Keep only the stretches of these numbers."""
        names = list(self.known) if len(kept) else []
        length = self.bounds[kept + 1] - self.bounds[kept] if len(kept) else np.zeros(0, np.int64)
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(self.bounds[kept] - (ends - length), length) + np.arange(ends[-1])] if len(kept) else np.zeros(0, np.uint32)
        self.known: dict[str, int] = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.ids = np.concatenate([ids, np.zeros(1 << 16, np.uint32)])
        self.bounds = np.zeros(len(kept) + (1 << 14), np.int64)
        self.bounds[1 : len(kept) + 1] = ends
        self.met = np.zeros(len(self.bounds), np.uint8)
        self.weight = sum(map(len, self.known)) + len(kept) * ENTRY_BYTES + 4 * len(ids)

    def _ids(self, stretches: list[str]) -> list[list[int]]:
        out: list = [None] * len(stretches)
        rest = []
        if self.plain:
            tokenize, folds = self.tokenizer.model.tokenize, self.folds
            for i, s in enumerate(stretches):
                word = s[1:] if s[0] == " " else s
                if word.isalpha() and max(word) < "\u0180":
                    own = word.lower() if folds else s
                    if folds and not own.isalpha():  # a mark came off a letter
                        rest.append(i)
                        continue
                    if not folds or not word.isascii():
                        own = own.encode().decode("latin-1").translate(_SYMBOLS)
                    out[i] = [t.id for t in tokenize(own)]
                else:
                    rest.append(i)
        else:
            rest = list(range(len(stretches)))
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([stretches[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _numbers(self, stretches: list[str]) -> np.ndarray:
        """For each of unlike stretches its number: good until the next call, for those that are too long to be remembered."""
        found = self._found(stretches)
        new = np.flatnonzero(found < 0)
        if len(self.known) + len(new) > self.entries or self.weight > self.most:
            often = np.flatnonzero(self.met[: len(self.known)] > 1)
            room = len(new) + len(often) <= self.entries and self.weight * len(often) <= self.most // 2 * max(1, len(self.known))
            self._forget(often if room else np.zeros(0, np.int64))
            found = self._found(stretches)
            new = np.flatnonzero(found < 0)
        short = np.fromiter((len(stretches[i]) <= KEPT_CHARS for i in new), bool, len(new))
        n = len(self.known)
        for part in (*_parts(new[short]), *_parts(new[~short])):
            texts = [stretches[i] for i in part]
            lists = self._ids(texts)
            ends = self.bounds[n] + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
            if ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(ends[-1] - len(self.ids), len(self.ids) // 2), np.uint32)])
            if n + len(part) >= len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros(len(part) + len(self.bounds) // 2, np.int64)])
                self.met = np.concatenate([self.met, np.zeros(len(self.bounds) - len(self.met), np.uint8)])
            self.ids[self.bounds[n] : ends[-1]] = np.fromiter(chain.from_iterable(lists), np.uint32, ends[-1] - self.bounds[n])
            self.bounds[n + 1 : n + 1 + len(part)] = ends
            found[part] = np.arange(n, n + len(part))
            if n == len(self.known) and len(texts[0]) <= KEPT_CHARS:
                self.known.update(zip(texts, range(n, n + len(part))))
                self.met[n : n + len(part)] = 0
                self.weight += sum(map(len, texts)) + len(part) * ENTRY_BYTES + 4 * int(ends[-1] - self.bounds[n])
            n += len(part)
        self.met[found] = np.minimum(self.met[found], 254) + 1
        return found

    def _found(self, stretches: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, stretches, repeat(-1)), np.int64, len(stretches))

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch its number in memory; for each text the first of its stretches, with the end last."""
        data, offsets = text_buffers(texts)
        at = cuts(data, offsets)
        if self.folds and b"<|" not in data.tobytes():  # a special string is matched before the letters are folded
            data = _FOLDED[data]
        if len(at) == 1:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        numbers = self._numbers(pieces.dictionary.to_pylist())
        return numbers[pieces.indices.to_numpy()], np.searchsorted(at[:-1], offsets)

    def _shrink(self) -> None:
        """Give up room that only stretches too long to be remembered have needed."""
        used = int(self.bounds[len(self.known)])
        if len(self.ids) > 2 * used + (1 << 20):
            self.ids = self.ids[: used + (1 << 16)].copy()

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        number, first = self._stretches(texts)
        total = np.concatenate([[0], np.cumsum(self.bounds[number + 1] - self.bounds[number])])
        self._shrink()
        return total[first[1:]] - total[first[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin, with the end last."""
        number, first = self._stretches(texts)
        begin, length = self.bounds[number], self.bounds[number + 1] - self.bounds[number]
        total = np.concatenate([[0], np.cumsum(length)])
        where = np.repeat(begin - total[:-1], length) + np.arange(total[-1])
        ids = self.ids[where]
        self._shrink()
        return ids, total[first]


def _parts(numbers: np.ndarray, size: int = 4096) -> list[np.ndarray]:
    return [numbers[at : at + size] for at in range(0, len(numbers), size)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
