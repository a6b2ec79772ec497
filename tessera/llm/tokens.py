"""Token ids of whole texts by the tokenizers library, with a table of the words that recur."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tessera.llm.words import SEPARATORS, U64, eights, mix, raw, trim

#: White space beyond ASCII, by its bytes in UTF-8, and those that such a character begins with.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[0x1C:0x20] = True
#: Words that a worker keeps at most (about 80 bytes each); the half that was used last stays.
KEPT = 1 << 20
#: Bytes of text at a time: the more, the fewer calls.
PIECE_BYTES = 2 << 20
#: Words that are encoded in one call.
CALL = 20_000

#: Words of fewer bytes are their own keys: two integers that hold their bytes, and their length in the last one.  Longer ones are numbered.
SHORT = 16
#: Bytes of a word beyond which it is not looked for again.
RECURS = 1 << 12
_LENGTH, _LONG = U64(56), U64(0xFF << 56)


class WordTable:
    """Ids of words by 128-bit keys that are the words themselves, in arrays: open addressing, looked up and filled a batch at a time."""

    def __init__(self, kept: int):
        self.kept = kept
        self.slots = np.full(1 << int(np.ceil(np.log2(kept * 2.5))), -1, np.int32)
        self.mask = U64(self.slots.size - 1)
        self.h = np.zeros((2, 0), U64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.stamp = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.now = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (mix(h[0] + mix(h[1])) & self.mask).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 where there is none."""
        out = np.full(h.shape[1], -1, np.int64)
        left, at = np.arange(h.shape[1]), self._slot(h)
        while left.size:
            entry = self.slots[at]
            full = entry >= 0
            left, at, entry = left[full], at[full], entry[full]
            same = (self.h[0, entry] == h[0, left]) & (self.h[1, entry] == h[1, left])
            out[left[same]] = entry[same]
            left, at = left[~same], (at[~same] + 1) & int(self.mask)
        return out

    def _place(self, first: int) -> None:
        todo = np.arange(first, self.h.shape[1])
        at = self._slot(self.h[:, todo])
        while todo.size:
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & int(self.mask)

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.h.shape[1] + h.shape[1] > self.kept:
            self._shrink()
        first = self.h.shape[1]
        self.start = np.append(self.start, self.pool.size + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes.astype(np.int32))
        self.h = np.concatenate([self.h, h], 1)
        self.stamp = np.append(self.stamp, np.full(h.shape[1], self.now))
        self.pool = np.append(self.pool, ids)
        if self.h.shape[1] * 2 > self.slots.size:  # a batch of more words than are kept
            self.slots = np.full(1 << int(np.ceil(np.log2(self.h.shape[1] * 2.5))), -1, np.int32)
            self.mask = U64(self.slots.size - 1)
            first = 0
        self._place(first)

    def _shrink(self) -> None:
        # what the batch at hand uses stays in any case
        if not self.stamp.size:
            return
        keep = np.flatnonzero(self.stamp >= min(np.median(self.stamp) + 1, self.now))
        self.pool = self.gather(keep)[0]
        self.h, self.size, self.stamp = self.h[:, keep], self.size[keep], self.stamp[keep]
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.slots[:] = -1
        self._place(0)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries, one after another, and where each begins and the last ends."""
        size = self.size[entries]
        ends = np.append(0, np.cumsum(size, dtype=np.int64))
        at = np.arange(ends[-1])
        at += np.repeat(self.start[entries] - ends[:-1], size)
        return self.pool[at], ends


class Encoder:
    """Ids of texts as unsigned 32-bit integers.

    A byte-level pre-tokenizer never joins a character with a space that follows it, so a text falls into independent words, each with the space
    before it.  Words recur; the library encodes those that a table does not have yet, many in one call: of their tokens only the
    first of a word begins with a space.  Texts with runs of white space are encoded whole.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are then ordinary text
        vocab = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # a space as byte-level vocabularies write it
        self.table = WordTable(kept)
        self.long: dict[bytes, int] = {}  # numbers of long words; they go up for good, so no number means two words
        self.numbered = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words that begin with a space and have no other, and how many each has."""
        ids, sizes = [], []
        for lo in range(0, len(units), CALL):
            some = units[lo : lo + CALL]
            got = self.whole([b"".join(some).decode()])[0]
            at = np.flatnonzero(self.spaced[got])
            if at.size != len(some) or at[0]:
                each = self.whole([u.decode() for u in some])
                got, at = np.concatenate(each), np.cumsum([0, *(x.size for x in each)])[:-1]
            ids.append(got)
            sizes.append(np.diff(np.append(at, got.size)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _keys(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The key of each word."""
        h = np.stack([eights(data, starts, lens), eights(data, np.minimum(starts + 8, data.size), np.maximum(lens - 8, 0))])
        h[1] |= lens.astype(U64) << _LENGTH
        far = np.flatnonzero(lens >= SHORT)
        if far.size:
            if len(self.long) > self.table.kept // 8:
                self.long.clear()
            for i, a, n in zip(far.tolist(), starts[far].tolist(), lens[far].tolist()):
                word = data[a : a + n].tobytes()
                number = self.long.get(word)
                if number is None:
                    number, self.numbered = self.numbered, self.numbered + 1
                    if n <= RECURS:
                        self.long[word] = number
                h[0, i] = number
            h[1, far] = _LONG
        return h

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the len + 1 places where texts begin; null counts as empty."""
        data, off = raw(texts)
        n = off.size - 1
        odd = np.zeros(n, bool)
        space = data == 0x20
        mark = _CONTROL[data]
        mark[1:] |= space[1:] & SEPARATORS[data[:-1]]
        odd[np.searchsorted(off, np.flatnonzero(mark), side="right") - 1] = True
        if _LEADS[data].any() and _WIDE.search(body := data.tobytes()):
            odd |= [_WIDE.search(body, off[i], off[i + 1]) is not None for i in range(n)]
        if data.size:
            full = off[:-1] < off[1:]
            odd[full] |= space[off[:-1][full]]
        cut = space.copy()
        cut[off[:-1][off[:-1] < off[1:]]] = True
        if odd.any():
            use = np.repeat(~odd, np.diff(off))
            starts = np.flatnonzero(cut & use)
            inside = data[use]
            begin = (np.cumsum(use) - 1)[starts]  # places in the bytes of the texts that are cut
        else:
            starts = begin = np.flatnonzero(cut)
            inside = data
        if not starts.size:
            return self._merge(texts, odd, np.zeros(0, np.uint32), np.zeros(n + 1, np.int64))
        lens = np.diff(np.append(begin, inside.size))
        h = self._keys(inside, begin, lens)
        table = self.table
        table.now += 1
        entry = table.find(h)
        table.stamp[entry[entry >= 0]] = table.now
        new = np.flatnonzero(entry < 0)
        if new.size:
            order = new[np.lexsort(h[:, new])]
            own = order[np.append(True, (h[:, order[1:]] != h[:, order[:-1]]).any(0))]
            flat = inside.tobytes()
            units = [flat[a:b] for a, b in zip(begin[own].tolist(), (begin[own] + lens[own]).tolist())]
            spaced = inside[begin[own]] == 0x20
            pos = np.flatnonzero(spaced)
            ids, sizes = self._words([units[i] for i in pos]) if pos.size else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            heads = np.flatnonzero(~spaced)
            each = self.whole([units[i].decode() for i in heads])
            table.add(np.concatenate([h[:, own[pos]], h[:, own[heads]]], 1), np.concatenate([ids, *each]), np.append(sizes, [x.size for x in each]).astype(np.int64))
            entry = table.find(h)
        ids, ends = table.gather(entry)
        # the first word of each text
        of = np.searchsorted(starts, off)
        return self._merge(texts, odd, ids, ends[of])

    def _merge(self, texts: pa.Array, odd: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts in the texts that are encoded whole."""
        if not odd.any():
            return ids, at
        which = np.flatnonzero(odd)
        whole = dict(zip(which.tolist(), self.whole([t.as_py() for t in texts.take(pa.array(which))])))
        parts = [whole[i] if i in whole else ids[at[i] : at[i + 1]] for i in range(odd.size)]
        return np.concatenate(parts), np.append(0, np.cumsum([p.size for p in parts]))

    def with_end(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with the id `end` after each text."""
        ids, at = self.encode(texts)
        return np.insert(ids, at[1:], end).astype(np.uint32, copy=False), at + np.arange(at.size)


@lru_cache(maxsize=4)
def encoder(path: str, kept: int = KEPT) -> Encoder:
    """One for each Python worker, file and size of its table."""
    made = Encoder(path, kept)
    trim()
    return made
