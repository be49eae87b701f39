"""Token ids of whole texts by the tokenizers library, behind a bounded cache, vectorised over bytes.

A byte-level pre-tokenizer cuts a text between letters, digits, signs and white space, a space going
with what follows it. Texts are cut here in the same places, but for the few that depend on more than
the two characters around them: those are left inside a unit. Units recur, so most ids come from a
table that is looked up for all units of a batch at once; the library encodes each unit that is new.
Texts with characters other than ASCII and Latin letters, and texts that hold one of the tokenizer's
added tokens such as an end mark, go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from . import wordhash

_SPACE, _BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[9:14] = _BLANK
_CLASS[0x20] = _SPACE
_CLASS[0x80:0xC0] = _CLASS[0xC3:0xC9] = _LETTER  # U+00C0 to U+023F, of which two are signs
_PURE = re.compile(r" ?(?:[A-Za-zÀ-ɏ]+|[0-9]+|[!-/:-@\[-`{-~]+)")
_AT_ONCE = 1 << 19


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(prints))
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def known(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which of the texts that start at `begin` have known characters only."""
    kind = _CLASS[data]
    odd = kind == _OTHER
    sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd[:-1] |= sign
    return np.add.reduceat(odd, begin, dtype=np.int64) == 0


def units(data: np.ndarray) -> np.ndarray:
    """Where units start. Texts end with a line break, which is no part of them, and start after one."""
    kind = _CLASS[data]
    n = len(data)
    start = np.ones(n, bool)
    if n < 2:
        return start
    a, b = kind[:-1], kind[1:]
    blank = kind <= _BLANK
    word = ~blank
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    alone = np.ones(n, bool)  # white space after a word
    alone[1:] = word[:-1]
    quote = data[:-1] == 0x27
    cut = word[:-1] & (blank[1:] | (a != b) & ~(quote & (b == _LETTER)))
    cut |= blank[:-1] & (b == _SPACE) & after[1:]
    cut |= (a == _BLANK) & alone[:-1] & word[1:]
    start[1:] = cut
    return start


class Encoder:
    """encode(texts): the ids of each as an array of `dtype`, the smallest that holds the vocabulary.

    The table has `slots` places, is emptied when half of them are taken, and so has a fixed size.
    """

    def __init__(self, path: str, slots: int = 1 << 21):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.zeros(1, self.dtype)
        self.slots, self.mask = slots, np.uint64(slots - 1)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.first, self.size, self.count = np.zeros(self.slots // 2 + 1, np.int64), np.zeros(self.slots // 2 + 1, np.int32), 0
        self.ids, self.used = np.zeros(1 << 20, self.dtype), 0

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _unit(self, data: bytes) -> list[int]:
        text = data.decode()
        if _PURE.fullmatch(text):  # one token of the pre-tokenizer: the model alone
            return [x.id for x in self.model.tokenize(data.decode("latin-1").translate(_LETTERS))]
        return self._whole(text)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, slot) of each hash; the place is -1 and the slot a free one where it isn't known."""
        slot = h & self.mask
        key = self.keys[slot]
        more = np.flatnonzero((key != h) & (key != 0))
        while len(more):
            s = (slot[more] + np.uint64(1)) & self.mask
            slot[more] = s
            key = self.keys[s]
            more = more[(key != h[more]) & (key != 0)]
        return np.where(self.keys[slot] == h, self.place[slot], -1), slot

    def _add(self, h: int, ids: list[int]) -> None:
        slot = h & int(self.mask)
        while self.keys[slot]:
            slot = (slot + 1) & int(self.mask)
        self.keys[slot], self.place[slot] = h, self.count
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), self.dtype)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.count], self.size[self.count] = self.used, len(ids)
        self.used += len(ids)
        self.count += 1

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, part in wordhash.batched((t.encode() if t else b"" for t in texts), _AT_ONCE):
            out += self._batch(part)
        return out

    def _batch(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        good = known(data, begin[:-1])
        raw = data.tobytes()
        for mark in self.marks:
            if mark in raw:
                good &= np.fromiter((mark not in t for t in texts), bool, len(texts))
        start = units(data)
        start[begin[:-1]] = start[begin[1:] - 1] = True
        at = np.flatnonzero(start)
        size = np.diff(np.concatenate((at, [len(data)])))
        of = np.searchsorted(begin, at, "right") - 1
        keep = good[of] & (at != begin[of + 1] - 1)
        at, size, of = at[keep], size[keep], of[keep]
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(wordhash._BYTE[data] * wordhash._power(wordhash._BASE, len(data)), out=prefix[1:])
        h = wordhash.mix((prefix[at + size] - prefix[at]) * wordhash._power(wordhash._INVERSE, len(data))[at] + size.astype(np.uint64)) | np.uint64(1 << 63)
        place, _ = self._find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, pick = np.unique(h[new], return_index=True)
            if self.count + len(pick) > self.slots // 2:
                self._clear()
                _, pick = np.unique(h, return_index=True)
                new = np.arange(len(h))
            if len(pick) <= self.slots // 2:
                for k in new[pick].tolist():
                    self._add(int(h[k]), self._unit(raw[at[k] : at[k] + size[k]]))
                place, _ = self._find(h)
            else:  # one text of more units than the table holds
                good[:] = False
        n = self.size[place].astype(np.int64)
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.first[place] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[np.searchsorted(of, np.arange(len(texts) + 1))]
        return [flat[cuts[i] : cuts[i + 1]] if good[i] else np.array(self._whole(t.decode()), self.dtype) for i, t in enumerate(texts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
